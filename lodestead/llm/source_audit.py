"""Operator 12, source divergence audit: how far each source of a language lies from its others, and in which terms.

Identical texts of a language are collapsed into one row with the number of copies that each source holds, so that a text
is tokenized once however often it is copied; its term counts and its one document count are weighted by the copies.
Sources are compared by exact smoothed shares in parts of 10^9, and only what occurs is worked on: a pair's sum over all
kept terms is the sum it would have if nothing occurred, corrected by each source's terms alone (by classes of equal
shares) and by the terms that both hold. The last are summed up in arrays within a task, which holds a term's rows of all
sources, so no pair of sources is emitted for a term.

Results on odd input: a null text, lang or source reads as ''. Texts without terms make their group known, with counts of
0. A language without kept terms has pairs of value 0 and no terms; a group that is its language's only one has no pairs.
Repeated rows count as documents of their own. Ties in value go by the item's UTF-8 bytes. Texts of any length are read
whole. Other columns, of any name, are left out. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestead.llm.common import materialize, pieces, small_batches, table

#: Documents of a language that a term must occur in, and the ranks that are reported of a group's terms.
LEAST_DOCS, TOP_TERMS = 3, 200
#: Parts that a share is counted in.
PARTS = 1_000_000_000
#: Bytes of text tokenized at once, rows expanded or summed up at once, and terms that a task counts before it sends them on.
PIECE, ROWS, TERMS = 1 << 22, 1 << 20, 1 << 20
_GAP = bytes.maketrans(bytes(b for b in range(0x80) if not chr(b).isalpha()), b" " * (0x80 - 52))


def collapse(docs: DataFrame) -> DataFrame:
    """lang, text, sources (source, n): each different text of a language once, with its copies in each source.

    Texts are told apart by their SHA-256, so that a text is shuffled once for each task that holds it, and its copies as counts.
    """
    known = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "text", "source")])
    known = known.withColumn("digest", F.unhex(F.sha2("text", 256)))
    texts = known.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    copies = known.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
    copies = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    return texts.join(copies, ["lang", "digest"]).drop("digest")


def _codes(column, known: dict) -> np.ndarray:
    """Numbers of a string column's values, the same in all batches of a task."""
    d = column.dictionary_encode()
    return np.array([known.setdefault(x, len(known)) for x in d.dictionary.to_pylist()], np.int64)[d.indices.to_numpy(zero_copy_only=False)] if len(column) else np.zeros(0, np.int64)


def _add_up(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Different keys, ascending, and the sums of the values at each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return [key[first], *(np.add.reduceat(v[order], first) if len(key) else v for v in values)]


def _tokenize(batches):
    """lang, term, sources, n, docs of collapsed texts: a row a language and term, with its occurrences and documents by source,
    added up over what a task reads until that are TERMS terms or 4 ROWS counts."""
    terms, groups, parts, held = {}, {}, [], 0
    for whole in batches:
        for b in pieces(whole, "text", PIECE):
            found = [t.as_py().encode().lower().translate(_GAP).split() for t in b.column("text")]  # bytes: only A-Z become lower case
            words = pa.array([w for x in found for w in x], pa.binary()).dictionary_encode()
            if not len(words):
                continue
            v, size = len(words.dictionary), np.array([len(x) for x in found], np.int64)
            seen, tf = np.unique(np.repeat(np.arange(len(found)), size) * v + words.indices.to_numpy().astype(np.int64), return_counts=True)
            at = np.searchsorted(seen // v, np.arange(len(found) + 1))
            number = np.array([terms.setdefault(w, len(terms)) for w in words.dictionary.to_pylist()], np.int64)
            # each text's (source, copies) pairs, as many at once as give ROWS rows
            of = b.column("sources")
            flat = of.flatten()
            text = np.repeat(np.arange(len(found)), pc.list_value_length(of).to_numpy(zero_copy_only=False).astype(np.int64))
            langs = b.column("lang").to_pylist()
            group = np.array([groups.setdefault((langs[t], x), len(groups)) for t, x in zip(text.tolist(), flat.field(0).to_pylist())], np.int64)
            copies, rows = flat.field(1).to_numpy(zero_copy_only=False), np.cumsum(at[text + 1] - at[text])
            lo = 0
            while lo < len(text):
                hi = max(lo + 1, int(np.searchsorted(rows, (rows[lo - 1] if lo else 0) + ROWS, "right")))
                k = at[text[lo:hi] + 1] - at[text[lo:hi]]
                pair = np.repeat(np.arange(lo, hi), k)
                row = np.arange(len(pair)) - np.repeat(np.cumsum(k) - k, k) + at[text[pair]]
                parts.append(_add_up(number[seen[row] % v] << 31 | group[pair], tf[row] * copies[pair], copies[pair]))
                held += len(parts[-1][0])
                lo = hi
                if held > 4 * ROWS or len(terms) > TERMS:
                    parts = [_add_up(*map(np.concatenate, zip(*parts)))]
                    held = len(parts[0][0])
                    if held > 2 * ROWS or len(terms) > TERMS:
                        yield from _packed(parts[0], list(terms), list(groups))
                        parts, held = [], 0
            if not parts:
                terms, groups = {}, {}
    if parts:
        yield from _packed(_add_up(*map(np.concatenate, zip(*parts))), list(terms), list(groups))


def _packed(rows: list[np.ndarray], terms: list[bytes], groups: list[tuple[str, str]]):
    """Rows (term << 31 | group, occurrences, documents) as batches of lists by language and term."""
    key, n, docs = rows
    langs = sorted({x for x, _ in groups})
    lang = np.array([langs.index(x) for x, _ in groups], np.int64)[key & (1 << 31) - 1]
    order = np.lexsort((lang, key >> 31))
    key, n, docs, lang = key[order], n[order], docs[order], lang[order]
    term = key >> 31
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])]))
    names, words, tongues = pa.array([x for _, x in groups], pa.string()), pa.array(terms, pa.binary()), pa.array(langs, pa.string())
    for lo in range(0, len(first), 20_000):
        at = np.append(first[lo : lo + 20_000], len(key) if lo + 20_000 >= len(first) else first[lo + 20_000])
        s = slice(at[0], at[-1])
        lists = [pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), x) for x in (names.take(pa.array(key[s] & (1 << 31) - 1)), pa.array(n[s]), pa.array(docs[s]))]
        yield pa.RecordBatch.from_arrays([tongues.take(pa.array(lang[at[:-1]])), words.take(pa.array(term[at[:-1]])).cast(pa.string()), *lists], ["lang", "term", "sources", "n", "docs"])


def kept_terms(texts: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, lang_n, source, n of the terms that at least so many documents of their language hold. texts: collapsed."""
    small_batches(texts.sparkSession)
    rows = texts.mapInArrow(_tokenize, "lang string, term string, sources array<string>, n array<long>, docs array<long>")
    # all that follows keeps a term's rows, some for each task, where this exchange puts them
    rows = rows.repartition("lang", "term").select("lang", "term", F.inline(F.arrays_zip("sources", "n", "docs"))).toDF("lang", "term", "source", "n", "docs")
    rows = rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = rows.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by"))
    return whole.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n", F.inline("by"))


def _share(count: str | Column, total: str, terms: str) -> Column:
    """1 + floor(PARTS (count + 1) / (total + terms)), exact at any size; null without terms."""
    c = (F.col(count) if isinstance(count, str) else count).cast("decimal(20,0)") + 1
    return F.call_function("div", c * F.lit(PARTS).cast("decimal(10,0)"), F.nullif(F.col(total) + F.col(terms), F.lit(0)).cast("decimal(20,0)")) + 1


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _common(batches):
    """lang, source, other, value: of the terms that both hold, what a pair's sum differs by from the sums of its two sources alone.

    Rows come by lang and term; those of a term that a batch's end cuts wait for the next one.
    """
    langs, sources, rest = {}, {}, None
    keys, sums, held = [], [], 0

    def emit():
        key, value = _add_up(np.concatenate(keys), np.concatenate(sums))
        lang, source = list(langs), list(sources)
        a, b = key >> 31, key & (1 << 31) - 1
        names = lambda of, at: pa.array(of, pa.string()).take(pa.array(at))
        whose = np.array(groups, np.int64)
        return pa.RecordBatch.from_arrays([names(lang, whose[a, 0]), names(source, whose[a, 1]), names(source, whose[b, 1]), pa.array(value)], ["lang", "source", "other", "value"])

    numbers, groups = {}, []
    for b in _with_end(batches):
        t = pa.concat_batches([rest, b]) if rest is not None and b is not None else rest if b is None else b
        if t is None or not t.num_rows:
            continue
        lang, term = _codes(t.column("lang"), langs), t.column("term")
        new = np.ones(t.num_rows, bool)
        new[1:] = (lang[1:] != lang[:-1]) | pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
        cut = t.num_rows if b is None else int(np.flatnonzero(new)[-1])
        rest = None if b is None else t.slice(cut)
        if not cut:
            continue
        at = np.cumsum(new)[:cut]
        source = _codes(t.column("source"), sources)[:cut]
        both = lang[:cut] << 31 | source
        different, where = np.unique(both, return_inverse=True)
        for x in different.tolist():
            if x not in numbers:
                numbers[x] = len(groups)
                groups.append((x >> 31, x & (1 << 31) - 1))
        group = np.array([numbers[x] for x in different.tolist()], np.int64)[where]
        p, p0 = (t.column(c).to_numpy(zero_copy_only=False)[:cut] for c in ("p", "p0"))
        away = 1
        while True:
            i = np.flatnonzero(at[away:] == at[:-away])
            if not len(i):
                break
            for x, y in ((i, i + away), (i + away, i)):
                f = lambda u, w: (u - w) ** 2 // w
                keys.append(group[x] << 31 | group[y])
                sums.append(f(p[x], p[y]) - f(p[x], p0[y]) - f(p0[x], p[y]) + f(p0[x], p0[y]))
                held += len(x)
            if held > ROWS:
                key, value = _add_up(np.concatenate(keys), np.concatenate(sums))
                keys, sums, held = [key], [value], 0
                if len(key) > ROWS // 2:
                    yield emit()
                    keys, sums = [], []
            away += 1
    if keys:
        yield emit()


def _with_end(batches):
    yield from batches
    yield None


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source)."""
    held = materialize(kept_terms(collapse(docs), least_docs), "kept-terms")
    per_group = held.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    once = held.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    per_lang = once.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_n"))
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0, ["n", "terms", "lang_n"])
    groups = materialize(groups.select("lang", "source", F.col("n").alias("total"), "terms", F.col("lang_n").alias("lang_total"), _share(F.lit(0), "n", "terms").alias("p0")), "groups")

    shares = held.join(groups, ["lang", "source"]).select("lang", "source", "term", _share("n", "total", "terms").alias("p"), _share("lang_n", "lang_total", "terms").alias("q"), "p0")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))

    wide = lambda c: F.sum(c.cast("decimal(38,0)")).alias("value")
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("o0"))
    pairs = groups.join(other, "lang").where("source <> other")
    nothing = pairs.select("lang", "source", "other", F.coalesce(F.col("terms") * _gap(F.col("p0"), F.col("o0")).cast("decimal(20,0)"), F.lit(0)).alias("value"))
    # one source's terms alone: a row for each share that it has, and how many terms have it
    classes = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k")).join(other, "lang").where("source <> other")
    own = classes.groupBy("lang", "source", "other").agg(wide(F.col("k") * (_gap(F.col("p"), F.col("o0")) - _gap(F.col("p0"), F.col("o0"))).cast("decimal(20,0)")))
    its = classes.groupBy("lang", F.col("other").alias("source"), F.col("source").alias("other")).agg(wide(F.col("k") * (_gap(F.col("o0"), F.col("p")) - _gap(F.col("o0"), F.col("p0"))).cast("decimal(20,0)")))
    dealt = shares.select("lang", "source", "term", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    common = dealt.mapInArrow(_common, "lang string, source string, other string, value long")
    value = nothing.unionByName(own).unionByName(its).unionByName(common)
    value = value.groupBy("lang", "source", "other").agg(wide(F.col("value")))
    value = value.select("lang", "source", F.col("other").alias("item"), F.col("value").cast("long").alias("value"))
    value = value.withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit("pair"))
    return value.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op12_source_audit(spark, sf_dir) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS terms, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.total, 0) + v.terms) AS p,
    1 + 1000000000::HUGEINT * (k.n + 1) // (v.total + v.terms) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
u AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200"""

QUERIES = {"op12_source_audit": op12_source_audit}
ORACLES = {"op12_source_audit": _SQL}
