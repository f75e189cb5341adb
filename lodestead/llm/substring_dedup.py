"""Operator 5, substring dedup: seed and extend over winnowed anchors; later occurrences of long repeats are removed.

A window is `length` consecutive words of one document. A word is removed if a window that covers it has the same
words as one that starts earlier (smaller doc_id, or the same document and an earlier start). Removal is judged on the
input. Method:

1. Each document selects anchors by winnowing: of every `length` words, the smallest hash of SEED words. Equal windows
   select equal anchors. Anchors whose hash occurs once in the corpus are dropped.
2. Each anchor is extended both ways as far as any window around it can reach (its context). Occurrences of an equal
   context later than its first one are repeats over their whole extent. So a group of copies costs a row for each
   anchor, and only the contexts' first occurrences go on.
3. Where first occurrences of differing contexts share an anchor, a repeat may end inside them: there the windows
   themselves are compared with their first occurrence.

The union of the found extents is the set of maximal repeats. No pairs of documents are made; what is compared with a
first occurrence meets in pre-aggregated minima and in joins whose hot keys Spark can split. Sequences are compared by
two 64-bit hashes, that of the anchor and that of the context or window.

Results on odd input: null, empty and blank texts have no words; texts shorter than a window lose nothing; rows with a
null doc_id pass and are nobody's first occurrence; rows that repeat a doc_id share their removals; other columns
aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.llm.common import anew, discard, hash_words, materialize, mix, pieces, small_batches, spans, table, text_bytes

LENGTH, SEED = 20, 6
_U = np.uint64


class _Winnowed:
    """Word hashes of a piece of texts, its windows' starts and each one's anchor."""

    def __init__(self, texts: pa.Array, length: int, seed: int) -> None:
        buf, at = text_bytes(texts)
        self.h, self.first = hash_words(buf, at)
        n = len(self.h)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        self.end = self.first[1:][self.doc] if n else np.zeros(0, np.int64)
        idx = np.arange(n)
        self.start = idx[idx + length <= self.end]
        ok = idx[idx + seed <= self.end]
        self.seeds = np.zeros(n, _U)
        self.seeds[ok] = mix(spans(self.h, ok, ok + seed))
        bits = _U(max(24, int(n).bit_length()))
        v = np.full(n + length, np.iinfo(np.uint64).max, _U)
        v[ok] = (self.seeds[ok] >> bits << bits) | ok.astype(_U)
        width, have = length - seed + 1, 1
        while have * 2 <= width:
            v[: len(v) - have] = np.minimum(v[: len(v) - have], v[have:])
            have *= 2
        if have < width:
            v[: len(v) - (width - have)] = np.minimum(v[: len(v) - (width - have)], v[width - have :])
        self.anchor = (v[self.start] & ((_U(1) << bits) - _U(1))).astype(np.int64)


def _again(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether the same keys occur earlier in the same document; rows are in text order."""
    order = np.lexsort((np.arange(len(doc)), *keys, doc))
    same = np.ones(len(doc), bool)
    for x in (doc, *keys):
        same[1:] &= x[order][1:] == x[order][:-1]
    if len(same):
        same[0] = False
    out = np.empty(len(doc), bool)
    out[order] = same
    return out


def _anchors(length: int, seed: int):
    reach = length - seed

    def run(batches):
        for whole in batches:
            for b in pieces(whole):
                w = _Winnowed(b.column("text"), length, seed)
                i = w.anchor[np.flatnonzero(np.diff(w.anchor, prepend=-1))]
                d = w.doc[i] if len(i) else np.zeros(0, np.int64)
                lo, hi = np.maximum(i - reach, w.first[d]), np.minimum(i + seed + reach, w.end[i] if len(i) else 0)
                c = mix(spans(w.h, lo, hi) + (i - lo).astype(_U) * _U(0x9E3779B97F4A7C15) + (hi - i).astype(_U) * _U(0xC2B2AE3D27D4EB4F))
                base = w.first[d]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc").take(pa.array(d)), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32)), pa.array(w.seeds[i].view(np.int64)), pa.array(c.view(np.int64)), pa.array(_again(d, w.seeds[i], c))],
                    ["doc", "lo", "hi", "g", "c", "again"],
                )

    return run


def _windows(length: int, seed: int):
    def run(batches):
        for whole in batches:
            for b in pieces(whole):
                w = _Winnowed(b.column("text"), length, seed)
                want, size = b.column("wanted").flatten().to_numpy().view(np.uint64), np.diff(b.column("wanted").offsets.to_numpy())
                both = np.unique(np.stack([np.repeat(np.arange(len(size)), size).astype(_U), want]), axis=1)
                s, a = w.start, w.anchor
                d = w.doc[s] if len(s) else np.zeros(0, np.int64)
                code = mix(both[1] + both[0] * _U(0x9E3779B97F4A7C15))  # of document and anchor; a rare false match only adds windows
                on = np.isin(mix(w.seeds[a] + d.astype(_U) * _U(0x9E3779B97F4A7C15)), code)
                s, a, d = s[on], a[on], d[on]
                c = mix(spans(w.h, s, s + length))
                at = s - w.first[d]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc").take(pa.array(d)), pa.array(at.astype(np.int32)), pa.array((at + length).astype(np.int32)), pa.array(w.seeds[a].view(np.int64)), pa.array(c.view(np.int64)), pa.array(_again(d, w.seeds[a], c))],
                    ["doc", "lo", "hi", "g", "c", "again"],
                )

    return run


_ROW = "doc long, lo int, hi int, g long, c long, again boolean"


def _later(rows: DataFrame, first: DataFrame) -> DataFrame:
    """The extents of rows that repeat an earlier occurrence of their sequence."""
    met = rows.where("NOT again").join(anew(first.where("n > 1").select("g", "c", "d0"), "g", "c"), ["g", "c"]).where("doc > d0")
    return met.select("doc", "lo", "hi").unionByName(rows.where("again").select("doc", "lo", "hi"))


def _first(rows: DataFrame) -> DataFrame:
    return rows.where("NOT again").groupBy("g", "c").agg(F.min("doc").alias("d0"), F.count("*").alias("n"))


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document with repeats: doc and its extents (lo, hi: words from 0, hi excluded), which may overlap."""
    small_batches(docs.sparkSession)
    t = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    all_ = materialize(t.mapInArrow(_anchors(length, seed), _ROW), "anchors")
    often = all_.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    some = materialize(all_.join(anew(often, "g"), "g"), "anchors")
    discard(all_)
    first = materialize(_first(some), "contexts")
    met = first.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g")
    wanted = first.join(anew(met, "g"), "g").groupBy("d0").agg(F.collect_set("g").alias("wanted")).withColumnRenamed("d0", "doc")
    near = t.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(_windows(length, seed), _ROW)
    near = materialize(near, "windows")
    out = _later(some, first).unionByName(_later(near, _first(near)))
    return out.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("extents"))


def _cut(batches):
    for whole in batches:
        for b in pieces(whole):
            n, gone, kept = [], [], []
            for text, cuts in zip(b.column("text"), b.column("extents"), strict=True):
                ws = text.as_buffer().to_pybytes().split() if text.is_valid else []  # splits at the rule's white space
                off = np.zeros(len(ws) + 1, np.int64)
                if cuts.is_valid:
                    x = cuts.values
                    lo, hi = (np.minimum(x.field(k).to_numpy(zero_copy_only=False), len(ws)) for k in ("lo", "hi"))
                    np.add.at(off, lo, 1)
                    np.add.at(off, hi, -1)
                on = np.cumsum(off)[: len(ws)] == 0
                n.append(len(ws))
                gone.append(int(len(ws) - on.sum()))
                kept.append((b" ".join(ws) if on.all() else b" ".join([w for w, k in zip(ws, on, strict=True) if k])).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept, the words that stay joined by one space."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ext = repeats(docs, length, seed, text, key).withColumnRenamed("doc", "doc_id")
    return d.join(ext, "doc_id", "left").select("doc_id", "text", "extents").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


def op5_substring_dedup(spark, sf_dir) -> DataFrame:
    d = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, list_aggregate(ws[i:i + 19], 'string_agg', ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
m AS (SELECT x.doc_id, x.i, x.word, max(r.i) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
      FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.i = x.i)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS t FROM m GROUP BY doc_id) k USING (doc_id)"""
QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES = {"op5_substring_dedup": _SQL}
