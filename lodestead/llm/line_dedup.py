"""Operator 7, line dedup: winnowed line fingerprints are joined, extended both ways, and later repeated runs deleted.

A line is a \\n-split piece with at least one word; lines are compared without outer white space. Runs are those of
`window` consecutive lines, and those of fewer lines, down to one, that hold `long_words` words. A run with an earlier
twin (smaller doc_id, or same document and earlier line) is deleted; a longer repeated passage is covered by its
overlapping runs, so it goes as a whole. Method:

1. Winnowing: every run selects its smallest line hash (leftmost of equals). The selected places, about half of all
   lines, are the document's fingerprints; two places that share a run share a fingerprint. Fingerprints that
   occur at one place only are dropped.
2. Each fingerprint is extended to both sides as far as any run around it can reach (its context). Places with
   an equal context later than its first one are repeats over their whole extent: each line of a context lies in a run
   through the fingerprint. So a group of copies costs a row for each fingerprint, and only first places go on.
3. Where first places of differing contexts share a fingerprint, the match ends inside the contexts: there the runs that
   selected it are compared with their first place.

Only DataFrame functions; the texts are split and hashed once. A hot line never makes a pair of places: places meet their
group's minimum, which is pre-aggregated, in joins whose hot keys Spark can split. Sequences are compared by a 64-bit and
a 32-bit hash beside the fingerprint.

Results on odd input: null and empty texts stay as they are; rows with a null doc_id pass unchanged and are nobody's
first place; rows that repeat a doc_id and text are one document, each gets the same result; with differing texts
under one doc_id the deleted places are those found in any of them; blank lines stay unless a deleted run encloses
them; other columns of any name pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.llm.common import WS, anew, materialize, table

WINDOW, LONG_WORDS = 3, 50
_STRIP = " \t\n\x0b\f\r"


def _lines(docs: DataFrame, text: str, key: str) -> DataFrame:
    """One row per document with a line: doc, its lines' numbers (at), two hashes (h, g) and the words (w) of each."""
    d = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.split(F.coalesce(text, F.lit("")), "\n").alias("raw"))
    d = d.select("doc", F.filter(F.transform("raw", lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(_STRIP)).alias("x"))), lambda s: s["x"] != "").alias("l"))
    parts = F.transform("l", lambda s: F.struct(s["i"].alias("at"), F.xxhash64(s["x"]).alias("h"), F.hash(s["x"]).alias("g"), F.size(F.split(s["x"], f"[{WS}]+")).alias("w")))
    return d.select("doc", parts.alias("l")).where(F.size("l") > 0).select("doc", *[F.col(f"l.{c}").alias(c) for c in ("at", "h", "g", "w")])


def _runs(lines: DataFrame, window: int, long_words: int) -> DataFrame:
    """lines with the runs (s, m: first line and lines) of each document and the places that they select.

    lines is a table: were its arrays still to be computed, a function over their places would compute them for each place.
    """
    starts = F.sequence(F.lit(0), F.size("h") - 1)
    runs = [F.transform(F.filter(starts, lambda s: s + window <= F.size("h")), lambda s: F.struct(s.alias("s"), F.lit(window).alias("m")))]
    for m in range(1, window):
        some = F.filter(starts, lambda s: (s + m <= F.size("h")) & (sum((F.get("w", s + k) for k in range(1, m)), F.get("w", s)) >= long_words))  # noqa: B023
        runs.append(F.transform(some, lambda s: F.struct(s.alias("s"), F.lit(m).alias("m"))))  # noqa: B023
    return lines.select("doc", "at", "h", "g", F.concat(*runs).alias("runs"))


def _selected(s: Column, m: Column) -> Column:
    run = F.slice("h", s + 1, m)
    return (s + F.array_position(run, F.array_min(run)) - 1).cast("int")


def _part(s: Column, m: Column) -> list[Column]:
    """Two hashes of the lines of a run."""
    return [F.xxhash64(F.slice("h", s + 1, m)), F.hash(F.slice("g", s + 1, m))]


def _later(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows (doc, p, from_line, to_line) with an equal one earlier; the first place of each key."""
    first = rows.groupBy(*keys).agg(F.min(F.struct("doc", "p")).alias("o"), F.count("*").alias("n"))
    met = rows.join(anew(first.where("n > 1").select(*keys, "o"), *keys), keys).where("doc > o.doc OR (doc = o.doc AND p > o.p)")
    return met.select("doc", "from_line", "to_line"), first


def repeated_runs(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", long_words: int = LONG_WORDS) -> DataFrame:
    """Rows (doc, from_line, to_line), line numbers from 0, that together cover all runs with an earlier twin."""
    lines = _runs(materialize(_lines(docs, text, key), "lines"), window, long_words)
    p, n = F.col("p"), F.size("h")
    lo, hi = F.greatest(F.lit(0), p - window + 1), F.least(n, p + window)
    selected = F.array_distinct(F.transform("runs", lambda r: _selected(r["s"], r["m"])))
    d = lines.select("doc", "at", "h", "g", F.explode(selected).alias("p"))
    c1, c2 = _part(lo, hi - lo)
    d = d.select("doc", "p", F.get("h", p).alias("fp"), c1.alias("c1"), c2.alias("c2"), (p - lo).alias("off"), F.get("at", lo).alias("from_line"), F.get("at", hi - 1).alias("to_line"))
    d = materialize(d, "fingerprints")
    often = d.groupBy("fp").agg(F.min(F.struct("doc", "p")).alias("a"), F.max(F.struct("doc", "p")).alias("z")).where("a < z").select("fp")
    some = materialize(d.join(anew(often, "fp"), "fp"), "fingerprints")
    out, first = _later(some, ["fp", "off", "c1", "c2"])

    first = materialize(first.select("fp", "o.doc", "o.p"), "contexts")
    met = first.groupBy("fp").agg(F.count("*").alias("k")).where("k > 1").select("fp")
    wanted = first.join(anew(met, "fp"), "fp").groupBy("doc").agg(F.collect_set(F.struct("p", "fp")).alias("wanted"))
    r = lines.join(wanted, "doc").withColumn("x", F.explode("wanted")).where("get(h, x.p) = x.fp")
    r = r.withColumn("r", F.explode(F.filter("runs", lambda r: (r["s"] <= F.col("x.p")) & (r["s"] + r["m"] > F.col("x.p")) & (_selected(r["s"], r["m"]) == F.col("x.p")))))
    s, m = F.col("r.s"), F.col("r.m")
    r1, r2 = _part(s, m)
    r = r.select("doc", s.alias("p"), F.col("x.fp").alias("fp"), m.alias("m"), r1.alias("r1"), r2.alias("r2"), F.get("at", s).alias("from_line"), F.get("at", s + m - 1).alias("to_line"))
    within, _ = _later(materialize(r, "runs"), ["fp", "m", "r1", "r2"])
    return out.unionByName(within)


def drop_repeated_lines(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", count: str | None = None) -> DataFrame:
    """docs, same columns, with later repeated runs of lines deleted from the text. count: gets the number of deleted lines."""
    gone = repeated_runs(docs, window, text, key).select("doc", F.explode(F.sequence("from_line", "to_line")).alias("i"))
    gone = gone.groupBy("doc").agg(F.collect_set("i").alias("gone"))
    d = docs.select(F.struct("*").alias("row"), F.col(key).alias("k")).join(gone.withColumnRenamed("doc", "k"), "k", "left")
    raw = F.split(F.col(f"row.`{text}`"), "\n")
    d = d.withColumn("raw", F.when(F.col("gone").isNotNull(), raw))
    d = d.withColumn("left", F.array_except(F.sequence(F.lit(0), F.size("raw") - 1), "gone"))
    kept = F.when(F.col("gone").isNull(), F.col(f"row.`{text}`")).otherwise(F.array_join(F.transform("left", lambda i: F.get("raw", i)), "\n"))
    lost = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size(F.filter("raw", lambda x: F.btrim(x, F.lit(_STRIP)) != "")) - F.size(F.filter(F.transform("left", lambda i: F.get("raw", i)), lambda x: F.btrim(x, F.lit(_STRIP)) != "")))
    out = d.select("row", kept.alias("kept"), *([lost.cast("long").alias("lost")] if count else []))
    new = {text: F.col("kept")} | ({"n_chars": F.length("kept").cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns], *([F.col("lost").alias(count)] if count else []))


def op7_line_dedup(spark, sf_dir) -> DataFrame:
    d = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_removed_lines")
    return d.select("doc_id", "n_removed_lines", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def _sql_runs() -> str:
    """All runs of each number of lines: those of WINDOW lines, and shorter ones with LONG_WORDS words."""
    one = "SELECT doc_id, s, {m} AS m, i AS a, lead(i, {last}) OVER w AS z, {run} AS run, {words} AS words FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY s)"
    lead = lambda c, k: f"lead({c}, {k}) OVER w"
    parts = [one.format(m=m, last=m - 1, run=f"concat_ws(chr(10), {', '.join(lead('y', k) for k in range(m))})", words=" + ".join(lead("n", k) for k in range(m))) for m in range(1, WINDOW + 1)]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE z IS NOT NULL AND (m = {WINDOW} OR words >= {LONG_WORDS})"


_SQL = rf"""
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l0 AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i FROM raw),
t AS (SELECT doc_id, i, regexp_replace(regexp_replace(x, '^[{WS}]+', ''), '[{WS}]+$', '') AS y FROM l0 WHERE regexp_matches(x, '[^{WS}]')),
l AS (SELECT *, len(regexp_split_to_array(y, '[{WS}]+')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s FROM t),
f AS (SELECT *, row_number() OVER (PARTITION BY m, run ORDER BY doc_id, s) AS k FROM ({_sql_runs()})),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM f WHERE k > 1),
kept AS (SELECT l0.doc_id, string_agg(x, chr(10) ORDER BY l0.i) FILTER (WHERE gone.i IS NULL) AS t,
                count(*) FILTER (WHERE gone.i IS NOT NULL AND regexp_matches(x, '[^{WS}]')) AS n
         FROM l0 LEFT JOIN gone ON l0.doc_id = gone.doc_id AND l0.i = gone.i GROUP BY l0.doc_id)
SELECT doc_id, n AS n_removed_lines, length(coalesce(t, ''))::BIGINT AS kept_chars, sha256(coalesce(t, '')) AS kept_sha256 FROM kept"""
QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES = {"op7_line_dedup": _SQL}
