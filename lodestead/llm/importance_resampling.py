"""Operator 11, target-distribution importance resampling: documents are drawn by how much likelier the target makes them.

Runs of words are hashed into buckets; a bucket's gain is the logarithm of its share in the target against its share in
all documents, and a document's weight is the sum of its runs' gains, both from numpy arrays. Gumbel noise, a function of
the document's id, makes the greatest weights plus noise a draw without replacement. The k-th greatest composite key
(score, id) is found by distributed quickselect: each round takes random keys as pivots, counts all keys before, at and
behind each of them, and goes on with the keys between two pivots. Only the rows up to that key are sorted, by ranges,
and ranked. What reaches the driver is one number a bucket and the pivots' counts, both of a set size.

Results on odd input: a null text has no words, weight 0 and the score of its noise; it counts among no drawn documents,
as texts of fewer than `least` words don't. A null doc_id reads as an empty id in its noise and comes behind other ids at
ties. Rows that repeat a doc_id are rows of their own: they share the noise, and of equal keys each is drawn by itself.
Texts of any length are read whole, in pieces. Other columns are left out. Without a target all buckets are compared
with an even share. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestead.llm.common import materialize, pieces, small_batches, table, text_bytes

BUCKETS, GRAMS, SEED = 10_000, 1, 2024
#: Per cent of the documents of at least LEAST words that are drawn.
PERCENT, LEAST = 10, 20
#: Pivots of a round of the quickselect.
PIVOTS = 31
#: Words worked on at once, and the bytes up to which a word's checksum is computed beside others'.
BLOCK, SHORT = 1 << 18, 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def checksums(buf: np.ndarray, at: np.ndarray, to: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of buf[at:to] for each pair, carried on from the checksums `before`, if there are such."""
    c = np.zeros(len(at), np.uint32) if before is None else before.astype(np.uint32)
    n = to - at
    order = np.argsort(-n, kind="stable")
    n, a, c = n[order], at[order], ~c[order]
    long = int(np.searchsorted(-n, -SHORT, "left"))
    for i in range(long):
        c[i] = ~np.uint32(zlib.crc32(buf[a[i] : a[i] + n[i]].tobytes(), int(~c[i])))
    left = len(n)
    for j in range(int(n[long]) if long < left else 0):
        left = int(np.searchsorted(-n, -j, "left"))
        s = slice(long, left)
        c[s] = _CRC[(c[s] ^ buf[a[s] + j]) & 255] ^ (c[s] >> 8)
    out = np.empty_like(c)
    out[order] = ~c
    return out


def _starts(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])


def runs(batch: pa.RecordBatch, text: int, buckets: int, grams: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of each run of 1 to `grams` words of a batch's texts, block by block."""
    buf, starts = text_bytes(batch.column(text))
    buf = _LOWER[buf]
    word = np.concatenate([[False], _IN_WORD[buf], [False]])
    cut = np.zeros(len(word), bool)
    cut[starts] = True  # between texts
    at = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-2])) if len(buf) else np.zeros(0, np.int64)
    to = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:-1])) + 1 if len(buf) else np.zeros(0, np.int64)
    row = np.searchsorted(starts, at, "right") - 1
    space = np.array([32], np.uint8)
    for lo in range(0, len(at), BLOCK):
        hi = min(len(at), lo + BLOCK)
        c = checksums(buf, at[lo:hi], to[lo:hi])
        yield row[lo:hi], c % np.uint32(buckets)
        for m in range(1, grams):
            i = np.arange(lo, min(hi, len(at) - m))
            i = i[row[i] == row[i + m]]
            if not len(i):
                break
            full = np.zeros(hi - lo, np.uint32)
            zero = np.zeros(len(i), np.int64)
            full[i - lo] = checksums(buf, at[i + m], to[i + m], checksums(space, zero, zero + 1, c[i - lo]))
            c = full
            yield row[i], c[i - lo] % np.uint32(buckets)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """bucket, n: the runs of all texts by bucket. Each task adds up its own before anything is shuffled."""
    small_batches(texts.sparkSession)

    def count(batches):
        n = np.zeros(buckets, np.int64)
        for whole in batches:
            for b in pieces(whole):
                for _, at in runs(b, 0, buckets, grams):
                    n += np.bincount(at, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    got = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "bucket long, n long")
    return got.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS) -> np.ndarray:
    """Each bucket's gain; the counts, one row a bucket and side, are gathered here."""
    sides = [bucket_counts(d, buckets, grams).withColumn("side", F.lit(i)) for i, d in enumerate((docs, target))]
    n = np.zeros((2, buckets), np.int64)
    for r in sides[0].unionByName(sides[1]).collect():
        n[r.side, r.bucket] = r.n
    total = n.sum(1).tolist()
    return np.array([math.floor(1000 * math.log((t + 1) * float(total[0] + buckets) / ((s + 1) * float(total[1] + buckets)))) for s, t in n.T.tolist()], np.int64)


def _noise(doc_id: int | None, seed: int) -> int:
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, grams: int = GRAMS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""
    small_batches(docs.sparkSession)
    buckets = len(gain)

    def score(batches):
        for whole in batches:
            for b in pieces(whole):
                n, w = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
                for row, at in runs(b, 1, buckets, grams):
                    w += _sums(gain[at], row, b.num_rows)
                    n += np.bincount(row, minlength=b.num_rows)
                words = n if grams == 1 else sum((np.bincount(row, minlength=b.num_rows) for row, _ in runs(b, 1, 1, 1)), np.zeros(b.num_rows, np.int64))
                total = [a + _noise(i, seed) for a, i in zip(w.tolist(), b.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words, n, w, total))], ["doc_id", "n_words", "n_features", "weight", "score"])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return got.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def _sums(x: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sums of x by row; rows ascend."""
    total = _starts(x)
    edge = np.searchsorted(row, np.arange(rows + 1))
    return total[edge[1:]] - total[edge[:-1]]


_KEY = ("neg", "late", "id", "tie")


def _key(values: tuple | None = None) -> Column:
    """The composite key of a row, or of values; the least comes first."""
    kinds = ("long", "boolean", "long", "long")
    return F.struct(*[(F.col(c) if values is None else F.lit(values[i])).cast(t).alias(c) for i, (c, t) in enumerate(zip(_KEY, kinds))])


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS, seed: int = SEED) -> tuple | None:
    """The k-th composite key (from 1) of rows, whose keys all differ; None if there are fewer, or k is 0.

    A round reads the rows between two known keys twice: for the pivots, those of least hash, and for the counts. Each
    round's pivots split what is left, so that about log(rows) / log(pivots) rounds find the key.
    """
    if k < 1:
        return None
    low = high = None
    turn = 0
    while True:
        left = rows
        if low is not None:
            left = left.where(_key() > _key(low))
        if high is not None:
            left = left.where(_key() < _key(high))
        some = [tuple(r) for r in left.orderBy(F.xxhash64(*_KEY, F.lit(seed + turn)), *_KEY).select(*_KEY).limit(pivots).collect()]
        if not some:
            return None
        some.sort()
        # 2 i: before pivot i and behind the one before it; 2 i + 1: pivot i itself
        place = sum((F.when(_key() > _key(p), 2).when(_key() == _key(p), 1).otherwise(0) for p in some), F.lit(0))
        count = dict(left.groupBy(place.alias("place")).count().collect())
        turn += 1
        for i in range(2 * len(some) + 1):
            here = count.get(i, 0)
            if k > here:
                k -= here
            elif i % 2:
                return some[i // 2]
            else:
                low, high = (some[i // 2 - 1] if i else low), (some[i // 2] if i // 2 < len(some) else high)
                break
        else:
            return None


def draw(rows: DataFrame, percent: int = PERCENT, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """Scored rows with rank, 1, 2, 3, ... of the drawn ones by falling score, and null elsewhere."""
    d = rows.withColumns({"neg": -F.col("score"), "late": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)).cast("long"), "tie": F.monotonically_increasing_id()})
    d = materialize(d, "scored")
    able = d.where(F.col("n_words") >= least)
    last = kth_key(able.select(*_KEY), percent * able.count() // 100, seed=seed)
    if last is None:
        return d.withColumn("rank", F.lit(None).cast("long")).drop(*_KEY)
    first = (F.col("n_words") >= least) & (_key() <= _key(last))
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    won = materialize(d.where(first).repartitionByRange(parts, *_KEY).withColumn("part", F.spark_partition_id()), "drawn")
    sizes = won.groupBy("part").count().collect()  # one row a partition
    total, before = 0, {}
    for part, n in sorted(sizes):
        before[part] = total
        total += n
    offset = won.sparkSession.createDataFrame(sorted(before.items()), "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*_KEY))
    ranked = won.join(F.broadcast(offset), "part").withColumn("rank", F.col("before") + place).drop("part", "before")
    return ranked.unionByName(d.where(~first).withColumn("rank", F.lit(None).cast("long"))).drop(*_KEY)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, buckets: int = BUCKETS, grams: int = GRAMS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document of docs (doc_id, text) against target (text)."""
    return draw(scored(docs, gains(docs, target, buckets, grams), grams, seed), percent, least, seed)


def op11_importance_resampling(spark, sf_dir) -> DataFrame:
    d = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_features", "weight", "score", "rank")


_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
w AS (SELECT rid, unnest(ws) AS w FROM d),
v AS (
  SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode(w))), lambda i: ('0x' || hex(encode(w))[2 * i + 1:2 * i + 2])::BIGINT)),
      lambda c, x: xor(tbl[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS k
  FROM (SELECT w FROM w UNION SELECT w FROM b), crc),
s AS (SELECT k, count(*) AS s FROM w JOIN v USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM b JOIN v USING (w) GROUP BY k),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (k), n),
f AS (SELECT rid, sum(gain)::BIGINT AS weight FROM w JOIN v USING (w) JOIN g USING (k) GROUP BY rid),
x AS (SELECT rid, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d LEFT JOIN f USING (rid)),
y AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS c FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * c // 100 THEN r END::BIGINT AS rank FROM z"""

QUERIES = {"op11_importance_resampling": op11_importance_resampling}
ORACLES = {"op11_importance_resampling": _SQL}
