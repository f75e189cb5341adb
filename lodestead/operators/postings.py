"""The stored inverted index: built once, kept up by deltas, read by every lexical query.

Tables of a snapshot (sources.snapshots), each grown by one folder (a segment) a change:
postings (term, doc, seg, tf, doc_len; partitioned by a hash of the term, sorted by term), docs (doc, seg, doc_len and the
document's own terms; partitioned by a hash of the document), terms (term, df) and stats (n_docs, total_tokens), both
signed, so that what holds now is their sum, and dead (doc, seg): copies of documents that a later segment replaced or removed.
A delta costs what it brings: its own texts are tokenized, and the terms of what goes are read from docs, whose partitions
without a changed document aren't touched. compact() writes all segments anew as one, without what is dead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestead.functions.text import tokens
from lodestead.operators.retrieval import B, K1, idf, top
from lodestead.sources import snapshots
from lodestead.sources.snapshots import Snapshot

#: Documents to a partition of docs and of postings, and how many partitions there are at most: so many numbers are gathered
#: to say which ones a query reads. The number is chosen when an index is built, and noted in its versions.
DOCS, MOST = 50_000, 4_096
#: Terms of queries that are sent to all partitions of the postings, at most.
SMALL = 100_000


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _documents(texts: DataFrame, seg: int, key: str, text: str, buckets: int, repeats: bool = True) -> DataFrame:
    """doc, seg, doc_len, terms (term, tf) and bucket of texts, dealt by bucket: the texts are shuffled, as they take less than
    their terms. Of rows that repeat a key one is taken; repeats: whether there may be any."""
    d = texts.select(F.col(key).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL")
    d = d.dropDuplicates(["doc"]) if repeats else d
    # sorted as texts, so that the terms needn't be sorted when they are written by bucket
    d = _dealt(d.withColumn("bucket", bucket("doc", buckets)), "doc", buckets).sortWithinPartitions("bucket")
    d = d.select("doc", "bucket", F.sort_array(tokens(F.col("text"))).alias("s")).withColumn("doc_len", F.size("s").cast("long"))
    # a sorted array's runs are the counts: each one ends where the next term differs
    ends = F.filter(F.transform("s", lambda w, i: F.struct(w.alias("term"), (i + 1).alias("at"), F.coalesce(F.get("s", i + 1) != w, F.lit(True)).alias("last"))), lambda x: x["last"])
    d = d.withColumn("e", ends)
    terms = F.transform("e", lambda x, i: F.struct(x["term"].alias("term"), (x["at"] - F.coalesce(F.get("e", i - 1)["at"], F.lit(0))).cast("long").alias("tf")))
    return d.select("doc", F.lit(seg).alias("seg"), "doc_len", terms.alias("terms"), "bucket")


def _dealt(d: DataFrame, key: str, buckets: int) -> DataFrame:
    """By bucket, each one in as many parts as fill the session's partitions; parts are numbered, so no two share a partition."""
    parts = max(1, -(-int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets))
    return d.repartitionById(buckets * parts, (F.col("bucket") * parts + F.pmod(F.xxhash64(key), F.lit(parts))).cast("int"))


def _postings(docs: DataFrame, buckets: int) -> DataFrame:
    d = docs.select("doc", "seg", "doc_len", F.explode("terms").alias("t")).select(F.col("t.term").alias("term"), "doc", "seg", F.col("t.tf").alias("tf"), "doc_len")
    # by bucket and document, so that a term's rows needn't meet in one task; sorted, so that a term is sought in few row groups
    return _dealt(d.withColumn("bucket", bucket("term", buckets)), "doc", buckets).sortWithinPartitions("bucket", "term")


def _sums(docs: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
    terms = docs.select(F.explode("terms.term").alias("term")).groupBy("term").agg((F.count("*") * sign).alias("df"))
    return terms, docs.agg((F.count("*") * sign).alias("n_docs"), (F.coalesce(F.sum("doc_len"), F.lit(0)) * sign).cast("long").alias("total_tokens"))


_PARTS = {"postings": ["bucket"], "docs": ["bucket"]}


def build(spark: SparkSession, root: str, texts: DataFrame, key: str = "doc_id", text: str = "text") -> Snapshot:
    """The index of texts as the next version under root, in place of what there was."""
    n = texts.agg(F.count(key).alias("all"), F.count_distinct(key).alias("some")).first()
    buckets = min(MOST, 1 + n["all"] // DOCS)

    def change(base: Snapshot) -> dict:
        docs = _documents(texts, base.version, key, text, buckets, n["all"] > n["some"])
        sums = lambda at: lambda made: _sums(made("docs"), 1)[at]
        return {"replace": {"docs": docs, "postings": lambda made: _postings(made("docs"), buckets), "terms": sums(0), "stats": sums(1), "dead": docs.select("doc", "seg").limit(0)}, "partitions": _PARTS, "note": {"buckets": buckets}}

    return snapshots.update(spark, root, change)


def live(snap: Snapshot, table: str = "docs") -> DataFrame:
    """The rows of documents as they are now."""
    return snap.read(table).join(snap.read("dead"), ["doc", "seg"], "left_anti")


def delta(spark: SparkSession, root: str, texts: DataFrame | None = None, removed: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> Snapshot:
    """The index after texts came in, new or in place of those with their keys, and the documents of removed (key) went."""

    def change(base: Snapshot) -> dict:
        gone = [d.select(F.col(key).alias("doc")) for d in (texts, removed) if d is not None]
        ids = (gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])).where("doc IS NOT NULL").distinct()
        buckets = base.note["buckets"]
        touched = [r[0] for r in ids.select(bucket("doc", buckets).alias("b")).distinct().collect()]
        old = live(base).where(F.col("bucket").isin(touched)).join(ids, "doc", "left_semi")
        terms, stats = _sums(old, -1)
        append = {"dead": old.select("doc", "seg")}
        if texts is None:
            return {"append": append | {"terms": terms, "stats": stats}, "partitions": _PARTS}
        new = texts if removed is None else texts.join(removed.select(key), key, "left_anti")
        more = lambda made: _sums(made("docs"), 1)
        append |= {"docs": _documents(new, base.version, key, text, buckets), "postings": lambda made: _postings(made("docs"), buckets)}
        append["terms"] = lambda made: terms.unionByName(more(made)[0]).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        append["stats"] = lambda made: stats.unionByName(more(made)[1])
        return {"append": append, "partitions": _PARTS}

    return snapshots.update(spark, root, change)


def compact(spark: SparkSession, root: str) -> Snapshot:
    """All segments as one, without dead copies, with one row for each term."""

    def change(base: Snapshot) -> dict:
        docs, buckets = live(base).withColumn("seg", F.lit(base.version)), base.note["buckets"]
        docs = _dealt(docs, "doc", buckets)
        return {"replace": {"docs": docs, "postings": lambda made: _postings(made("docs"), buckets), "terms": doc_freq(base), "stats": stats(base), "dead": docs.select("doc", "seg").limit(0)}, "partitions": _PARTS}

    return snapshots.update(spark, root, change)


def doc_freq(snap: Snapshot) -> DataFrame:
    """term, df of what is live."""
    return snap.read("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def stats(snap: Snapshot) -> DataFrame:
    """One row: n_docs, total_tokens."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return snap.read("stats").agg(zero("n_docs"), zero("total_tokens"))


def search(snap: Snapshot, queries: DataFrame, k: int = 4, allowed: DataFrame | None = None, query_key: str = "item_id") -> DataFrame:
    """qid, doc, score, rank by BM25 of queries (query_key, text) over the stored index; allowed (doc) limits what is found,
    not the statistics. Only the queries are tokenized, and only the partitions of their terms are read."""
    q = queries.select(F.col(query_key).alias("qid"), F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    counted = q.groupBy(bucket("term", snap.note["buckets"]).alias("b")).count().collect()
    read, asked = [r[0] for r in counted], sum(r[1] for r in counted)
    wanted = q.select("term").distinct()
    n = stats(snap).select("n_docs", (F.col("total_tokens") / F.greatest("n_docs", F.lit(1))).alias("mean"))
    df = snap.read("terms").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weights = df.where("df > 0").join(F.broadcast(n)).select("term", idf(F.col("df"), F.col("n_docs")).alias("idf"), "mean")  # one row of statistics
    q = q.join(weights, "term")
    # few terms go to the postings, which so needn't move; many are joined as they come
    found = snap.read("postings").where(F.col("bucket").isin(read)).join(F.broadcast(q) if asked <= SMALL else q, "term")
    if not snap.read("dead").isEmpty():
        found = found.join(snap.read("dead"), ["doc", "seg"], "left_anti")
    if allowed is not None:
        found = found.join(allowed, "doc", "left_semi")
    s = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.greatest("mean", F.lit(1e-5))))
    hits = found.groupBy("qid", "doc").agg(F.sum(F.col("qtf") * F.col("idf") * s).alias("score"))
    return top(hits.where("score > 0"), ["qid"], "score", "doc", k).select("qid", "doc", F.round("score", 6).alias("score"), "rank")


# ---------------------------------------------------------------- sparse vectors
#: Places of a hashed sparse vector.
DIMENSION = 1 << 20


def place(term: Column, dimension: int = DIMENSION) -> Column:
    return F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("long") % dimension


def query_terms(queries: DataFrame, key: str = "item_id") -> DataFrame:
    """doc and terms of queries, as the index has them of documents."""
    d = queries.select(F.col(key).alias("doc"), F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    return d.groupBy("doc").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))


def sparse(docs: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """doc and its sparse vector (indices, values): the occurrences of its terms by hashed place, scaled to length 1.

    docs: rows of the index (doc, terms). Terms that share a place add up; the vector of a document without terms is empty.
    """
    placed = docs.select("doc", F.explode("terms").alias("t")).groupBy("doc", place(F.col("t.term"), dimension).alias("i")).agg(F.sum("t.tf").cast("double").alias("v"))
    v = placed.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    v = v.select("doc", F.transform("x", lambda e: e["i"]).alias("indices"), F.transform("x", lambda e: e["v"] / F.col("length")).alias("values"))
    return docs.select("doc").join(v, "doc", "left").select("doc", F.struct(F.coalesce("indices", F.array().cast("array<bigint>")).alias("indices"), F.coalesce("values", F.array().cast("array<double>")).alias("values")).alias("sparse"))


def inner_products(rows: DataFrame, queries: DataFrame, k: int = 4) -> DataFrame:
    """qid, doc, score, rank: the k greatest inner products of sparse vectors (doc, sparse) with queries (qid, sparse), joined by place."""
    parts = lambda d, key: d.select(key, F.inline(F.arrays_zip("sparse.indices", "sparse.values"))).toDF(key, "i", "v")
    d = parts(rows, "doc").join(parts(queries, "qid").withColumnRenamed("v", "w"), "i").groupBy("qid", "doc").agg(F.sum(F.col("v") * F.col("w")).alias("score"))
    return top(d.where("score > 0"), ["qid"], "score", "doc", k).select("qid", "doc", F.round("score", 6).alias("score"), "rank")
