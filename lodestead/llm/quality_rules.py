"""Operator 3, quality rules: a threshold table compiled into one Spark projection, without user functions.

Results on odd input: a null text is an empty one (no words; it fails the base rule); other columns, null or not,
and columns of any name pass through untouched; repeated rows are judged alike; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.llm.common import WS, table, words

#: Function words of the four languages, lower case.
STOP_WORDS = {
    "en": "the be to of and that have with is are was for in on it as at by this from a or an not",
    "fr": "le la les de des du un une et est que qui dans pour par sur pas avec en au aux ce elle il",
    "de": "der die das und ist nicht ein eine den dem des von zu mit auf für im in als auch es an sich",
    "es": "el la los las de del un una y que en es por con para no se su al lo como más o sur",
}
#: (rule, ratio, "min" or "max", threshold): a document is kept if it meets every row.
RULES = (
    ("long_enough", "n_words", "min", 20.0),
    ("words_not_short", "mean_word_chars", "min", 2.0),
    ("words_not_long", "mean_word_chars", "max", 14.0),
    ("few_symbols", "symbols_per_word", "max", 0.1),
    ("has_stop_words", "stop_word_ratio", "min", 0.06),
    ("lines_differ", "dup_line_ratio", "max", 0.5),
    ("text_not_repeated", "repeat_word_ratio", "max", 0.3),
    ("words_have_letters", "letter_word_ratio", "min", 0.7),
)
WINDOW = 8


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def measure(docs: DataFrame, text: str = "text", stop_words: dict[str, str] | None = None) -> DataFrame:
    """One row per document: `row` (all its columns) and the measured counts and ratios.

    Repeated windows are found by 64-bit hashes of 8 words within one document. Steps that an expression uses more
    than once are columns of their own, so that Spark computes them once.
    """
    stops = sorted({w for v in (stop_words or STOP_WORDS).values() for w in v.split()})
    t = F.coalesce(F.col("row." + f"`{text}`"), F.lit(""))
    d = docs.select(F.struct("*").alias("row"))
    d = d.withColumn("_w", words(t)).withColumn("_l", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != ""))
    n = F.size("_w")
    d = d.withColumn("_h", F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.withColumn("_s", F.when(twice, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, j: F.coalesce(F.get("_s", j + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_s", j - 1)["h"] == x["h"], F.lit(False))
    d = d.withColumn("_r", F.sort_array(F.transform(F.filter("_s", same), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_r", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_r", j + 1), x + WINDOW) - x)), F.lit(0), lambda a, x: a + x)
    # adding nothing, but not deterministic: so filters stay above this projection. Pushed below, they would repeat its
    # nested expressions many times over
    once = F.least(F.monotonically_increasing_id(), F.lit(0))
    d = d.select(
        "row",
        (n + once).cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(stops))).cast("long").alias("n_stop_words"),
        (n - F.regexp_count(t, F.lit(rf"(?<![^{WS}])[^{WS}\p{{L}}]+(?![^{WS}])"))).cast("long").alias("n_letter_words"),
    )
    return d.withColumns(
        {
            "mean_word_chars": _ratio(F.col("word_chars"), F.col("n_words")),
            "symbols_per_word": _ratio(F.col("n_symbols"), F.col("n_words")),
            "stop_word_ratio": _ratio(F.col("n_stop_words"), F.col("n_words")),
            "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
            "repeat_word_ratio": _ratio(F.col("n_repeat_words"), F.col("n_words")),
            "letter_word_ratio": _ratio(F.col("n_letter_words"), F.col("n_words")),
        }
    )


def verdict(rules: tuple = RULES) -> Column:
    """The threshold table as one boolean expression over measure()'s columns."""
    out = F.lit(True)
    for _, ratio, side, limit in rules:
        out = out & (F.col(ratio) >= limit if side == "min" else F.col(ratio) <= limit)
    return out


def failed_rules(rules: tuple = RULES) -> Column:
    """The names of the rules that a document breaks."""
    return F.array_compact(F.array(*[F.when(~verdict(((name, *rest),)), F.lit(name)) for name, *rest in rules]))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass the base rule and every row of the table, with their own columns."""
    return measure(docs, text).where(~base_failed() & verdict()).select("row.*")


def op3_quality_rules(spark, sf_dir) -> DataFrame:
    d = measure(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & verdict()).alias("kept"), F.array_join(failed_rules(), ",").alias("failed_rules"),
    )


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({w for v in STOP_WORDS.values() for w in v.split()}))
    rule = lambda r: f"{r[1]} {'>=' if r[2] == 'min' else '<='} {r[3]}"
    return rf"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[{WS}]+'), lambda x: x <> '') AS ws, coalesce(text, '') AS t,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{WS}]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls) AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop, len(list_filter(ws, lambda x: regexp_matches(x, '\pL'))) AS n_letter
  FROM w LEFT JOIN c USING (doc_id)),
q AS (
  SELECT *, CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE word_chars::DOUBLE / n_words END AS mean_word_chars,
    CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE n_symbols::DOUBLE / n_words END AS symbols_per_word,
    CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE n_stop::DOUBLE / n_words END AS stop_word_ratio,
    CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE n_repeat_words::DOUBLE / n_words END AS repeat_word_ratio,
    CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE n_letter::DOUBLE / n_words END AS letter_word_ratio,
    CASE WHEN n_lines = 0 THEN 0.0::DOUBLE ELSE n_dup_lines::DOUBLE / n_lines END AS dup_line_ratio,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(map(rule, RULES))} AS kept,
  concat_ws(',', {', '.join(f"CASE WHEN NOT ({rule(r)}) THEN '{r[0]}' END" for r in RULES)}) AS failed_rules
FROM q"""


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES = {"op3_quality_rules": _sql()}
