"""Retrieval over many queries at once: BM25 over an inverted index, dense cosine, reciprocal-rank fusion, abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestead.functions.text import tokens
from lodestead.operators import nearest

K1, B, RRF = 1.5, 0.75, 60


def term_freq(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, term, tf, and the document's length in tokens."""
    d = docs.select(F.col(key).alias("doc"), tokens(F.col(text)).alias("t")).withColumn("doc_len", F.size("t").cast("long"))
    return d.select("doc", "doc_len", F.explode("t").alias("term")).groupBy("doc", "doc_len", "term").agg(F.count("*").alias("tf"))


def doc_freq(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    n = F.count("*")
    total = F.coalesce(F.sum(F.size(tokens(F.col(text)))), F.lit(0))
    return docs.agg(n.alias("n_docs"), total.cast("long").alias("total_tokens"), (total / F.greatest(n, F.lit(1))).alias("avg_doc_len"))


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def top(rows: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group; equal scores, to six places, go by the smaller id."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round(score, 6)), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def document_text(title: Column, locator: Column, body: Column) -> Column:
    """What lexical search reads of a section: its text, and its heading and title once more."""
    return F.concat_ws(" ", body, locator, title)


def lexical_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, doc_len and its tokens: what BM25 needs of the texts, which are read once. The stored index (operators.postings)
    answers any number of query sets from a table."""
    return docs.select(F.col(key).alias("doc"), tokens(F.col(text)).alias("tokens")).withColumn("doc_len", F.size("tokens").cast("long"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 4, keep: Column | None = None, query_key: str = "item_id") -> DataFrame:
    """qid, doc, score, rank. keep: filters the documents that may be found, not the statistics."""
    allowed = docs.where(keep).select(F.col("doc_id").alias("doc")) if keep is not None else None
    return search(lexical_index(docs), queries, k, allowed, query_key)


def search(index: DataFrame, queries: DataFrame, k: int = 4, allowed: DataFrame | None = None, query_key: str = "item_id") -> DataFrame:
    """qid, doc, score, rank over a lexical index. Query terms are counted first, so a repeated one multiplies rather than
    repeating rows; only places of their terms are counted, and these meet the queries in an equi-join on the term."""
    stats = index.agg(F.count("*").alias("n_docs"), (F.coalesce(F.sum("doc_len"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("avg_doc_len"))
    q = queries.select(F.col(query_key).alias("qid"), F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    wanted = q.select("term").distinct()
    post = index.select("doc", "doc_len", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi").groupBy("doc", "doc_len", "term").agg(F.count("*").alias("tf"))
    weights = doc_freq(post).join(F.broadcast(stats)).select("term", idf(F.col("df"), F.col("n_docs")).alias("idf"), "avg_doc_len")  # one row of statistics
    if allowed is not None:
        post = post.join(allowed, "doc", "left_semi")
    s = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.greatest("avg_doc_len", F.lit(1e-5))))
    hits = post.join(weights, "term").join(q, "term").groupBy("qid", "doc").agg(F.sum(F.col("qtf") * F.col("idf") * s).alias("score"))
    return top(hits.where("score > 0"), ["qid"], "score", "doc", k).select("qid", "doc", F.round("score", 6).alias("score"), "rank")


def line_of(model: Column) -> Column:
    """The product line that a session's model asks for; null: any."""
    m = F.lower(F.coalesce(model, F.lit("")))
    return F.when(m.contains("pro"), "Pro").when(m.contains("r1") | m.contains("n1"), "Standard")


def wants_archive(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    return m.contains("archive") | m.contains("superseded")


def permitted(hits: DataFrame, queries: DataFrame, docs: DataFrame, lexical: bool) -> DataFrame:
    """hits (qid, doc, score) that a query may see: archived documents only if it asks for them (archive), and of a product
    line (line: Standard or Pro) that line's and those for All; lexical hits of documents without a line as well.

    queries: qid, line, archive; docs: doc, product_line, is_archived.
    """
    own = F.col("product_line").isin("All") | (F.col("product_line") == F.col("line"))
    own = F.coalesce(own, F.lit(lexical))
    d = hits.join(docs.select("doc", "product_line", "is_archived"), "doc").join(queries.select("qid", "line", "archive"), "qid")
    filtered = F.coalesce(F.col("line").isin("Standard", "Pro"), F.lit(False))
    return d.where((F.col("archive") | ~F.coalesce("is_archived", F.lit(False))) & (~filtered | own)).select(*hits.columns)


def hybrid(dense_hits: DataFrame, lexical_hits: DataFrame, queries: DataFrame, docs: DataFrame, dense_floor: float, lexical_floor: float, k: int = 4, threshold: float = 0.015) -> DataFrame:
    """Hybrid retrieval of hydrated rows: qid, rank, score and the documents' columns.

    Both tracks (qid, doc, score) are filtered by what each query may see, cut to 3 k and ranked; a query whose best scores
    lie below both floors gets nothing; the others' lists are fused by reciprocal ranks, cut at the threshold and k, and
    joined with their documents.
    """
    tracks = []
    for hits, lexical in ((dense_hits, False), (lexical_hits, True)):
        d = permitted(hits.select("qid", "doc", "score"), queries, docs, lexical)
        tracks.append(top(d, ["qid"], "score", "doc", 3 * k))
    silent = abstain(*tracks, dense_floor, lexical_floor).where("abstains").select("qid")
    fused = rrf(tracks, k, threshold).join(silent, "qid", "left_anti")
    return fused.join(docs, "doc")


def dense(vectors: DataFrame, queries: DataFrame, k: int = 4, floor: float | None = None, key: str = "vec_id") -> DataFrame:
    """qid, doc, score, rank: exact cosine of a stated query set against all rows. Rows with a null key, vector or element find
    nothing and aren't found."""
    rows = lambda d: d.select(F.col(key).cast("long").alias("key"), F.col("embedding").alias("v")).where("key IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)").withColumn("size", F.size("v"))
    n_groups, n_chunks = nearest.groups(vectors.sparkSession, vectors.count(), queries.count())
    held = rows(vectors).withColumns({"group": F.pmod(F.xxhash64("key"), F.lit(n_groups)).cast("int"), "cell": F.lit(0)})
    asked = rows(queries).withColumns({"group": F.lit(None).cast("int"), "cells": F.lit(None).cast("array<int>")})
    met = nearest.meet(held, asked, n_groups, n_chunks, k, floor)
    return top(met, ["qid"], "score", "doc", k).select("qid", "doc", F.round("score", 6).alias("score"), "rank")


def rrf(tracks: list[DataFrame], k: int = 4, threshold: float | None = None, constant: int = RRF) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (qid, doc, rank)."""
    rows = tracks[0].select("qid", "doc", "rank")
    for t in tracks[1:]:
        rows = rows.unionByName(t.select("qid", "doc", "rank"))
    fused = rows.groupBy("qid", "doc").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    fused = fused if threshold is None else fused.where(F.col("score") >= threshold)
    return top(fused, ["qid"], "score", "doc", k).select("qid", "doc", F.round("score", 6).alias("score"), "rank")


def abstain(dense_hits: DataFrame, lexical_hits: DataFrame, dense_floor: float, lexical_floor: float) -> DataFrame:
    """qid, best_dense, best_lexical, abstains: both maxima lie below their floors; a missing track counts as 0."""
    a = dense_hits.groupBy("qid").agg(F.max("score").alias("best_dense"))
    b = lexical_hits.groupBy("qid").agg(F.max("score").alias("best_lexical"))
    d = a.join(b, "qid", "full_outer").select("qid", F.coalesce("best_dense", F.lit(0.0)).alias("best_dense"), F.coalesce("best_lexical", F.lit(0.0)).alias("best_lexical"))
    return d.withColumn("abstains", (F.col("best_dense") < dense_floor) & (F.col("best_lexical") < lexical_floor))


def calibrate(scores: DataFrame, default: float, places: int) -> DataFrame:
    """One row: the floor halfway between the least in-domain and the greatest out-of-domain best score, if they part."""
    d = scores.agg(F.min(F.when(F.col("in_domain"), F.col("score"))).alias("low"), F.max(F.when(~F.col("in_domain"), F.col("score"))).alias("high"))
    return d.withColumn("floor", F.when(F.col("low") > F.col("high"), F.round((F.col("low") + F.col("high")) / 2, places)).otherwise(F.lit(default)))


# Fixed values of a calibration by probes, for each track: the least in-domain and the greatest out-of-domain best score where
# no probe found anything, the floor where the classes overlap, its decimal places; and how many titles are probes.
TRACKS = {"dense": (0.68, 0.57, 0.62, 3), "sparse": (2.0, 0.0, 1.0, 2)}
TITLES = 5


def probes(inside: DataFrame, titles: DataFrame, outside: DataFrame) -> DataFrame:
    """qid, text, in_domain: the texts of both domains, and for the first TITLES titles (by pos), which may repeat and needn't all
    be named, one that asks for help with it."""
    t = titles.orderBy("pos").limit(TITLES).where(F.length("title") > 0).select(F.concat("title", F.lit(" troubleshooting")).alias("text"))
    t = inside.select("text").unionByName(t).distinct().withColumn("in_domain", F.lit(True))
    return t.unionByName(outside.select("text").withColumn("in_domain", F.lit(False))).select(F.xxhash64("text", "in_domain").alias("qid"), "text", "in_domain")


def calibrate_tracks(dense_best: DataFrame, sparse_best: DataFrame) -> DataFrame:
    """One row (dense_floor, sparse_floor) from the best scores (score, in_domain) of the probes in both tracks, each probe of
    a track once; probes that found nothing have no row."""
    out = None
    for name, best in (("dense", dense_best), ("sparse", sparse_best)):
        low, high, default, places = TRACKS[name]
        d = best.agg(F.coalesce(F.min(F.when(F.col("in_domain"), F.col("score"))), F.lit(low)).alias("low"), F.coalesce(F.max(F.when(~F.col("in_domain"), F.col("score"))), F.lit(high)).alias("high"))
        d = d.select(F.when(F.col("low") > F.col("high"), F.round((F.col("low") + F.col("high")) / 2, places)).otherwise(F.lit(default)).alias(f"{name}_floor"))
        out = d if out is None else out.join(F.broadcast(d))  # one row each
    return out
