"""Greatest cosines of many queries against many vectors, matrix against matrix in Spark's tasks.

Vectors are dealt out to groups and queries to chunks of at most CHUNK; each pair of a group and a chunk is a partition. A task
holds its chunk's queries with their best hits so far, and takes the vectors as they come, a batch at a time, so its memory doesn't
depend on how many there are. No pair of vectors is ever a row: a partition gives at most k rows a query. The work is the product
of both numbers, as that of all exact search is; what is shuffled are the vectors once a chunk, and the queries once a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Queries that a task holds at most, about; vectors to a group at least; queries and vectors multiplied at once.
CHUNK, GROUP, STRIP, BATCH = 16_384, 1_000, 512, 8_192
#: Scores are compared to so many parts of one: six places.
PLACES = 1e6


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, lists or the bytes of doubles, as rows."""
    if not len(column):
        return np.zeros((0, 1))
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Best:
    """The k best hits of some queries so far: by score to six places, equal ones by the smaller key."""

    def __init__(self, keys: np.ndarray, q: np.ndarray, k: int, floor: float | None, itself: bool) -> None:
        self.keys, self.q, self.k, self.floor, self.itself = keys, q, k, floor, itself
        self.score = np.full((len(keys), k), -np.inf)
        self.hit = np.full((len(keys), k), np.iinfo(np.int64).max)

    def see(self, keys: np.ndarray, v: np.ndarray, of: np.ndarray) -> None:
        """Take vectors in for the queries of these places."""
        order = np.argsort(keys, kind="stable")
        keys, v = keys[order], v[order]
        for a in range(0, len(keys), BATCH):
            for b in range(0, len(of), STRIP):
                self._meet(keys[a : a + BATCH], v[a : a + BATCH], of[b : b + STRIP])

    def _meet(self, keys: np.ndarray, v: np.ndarray, of: np.ndarray) -> None:
        n, k = len(keys), self.k
        s = self.q[of] @ v.T
        low = None if self.floor is None else s < self.floor
        # one number says it all: the score's parts times n, less the place among the keys
        np.rint(np.multiply(s, PLACES, out=s), out=s)
        s *= n
        s -= np.arange(n)
        if low is not None:
            s[low] = -np.inf
        if not self.itself:
            own = self.keys[of]
            first, last = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
            for i in np.flatnonzero(last > first):
                s[i, first[i] : last[i]] = -np.inf
        least = self.score[of, -1] * n - np.searchsorted(keys, self.hit[of, -1])
        better = s > least[:, None]
        if n > k and np.count_nonzero(better) > 4 * k * len(of):
            at = np.argpartition(s, n - k, 1)[:, n - k :]
            row, col = np.repeat(np.arange(len(of)), k), at.ravel()
            ok = better[row, col]
            row, col = row[ok], col[ok]
        else:
            row, col = np.nonzero(better)
        if not len(row):
            return
        touched, place = np.unique(row, return_inverse=True)
        held = of[touched]
        score = np.concatenate([self.score[held].ravel(), np.ceil(s[row, col] / n)])
        hit = np.concatenate([self.hit[held].ravel(), keys[col]])
        place = np.concatenate([np.repeat(np.arange(len(held)), k), place])
        order = np.lexsort((hit, -score, place))
        place = place[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        keep = order[rank < k]
        self.score[held], self.hit[held] = score[keep].reshape(-1, k), hit[keep].reshape(-1, k)

    def rows(self):
        for a in range(0, len(self.keys), BATCH):
            score = self.score[a : a + BATCH]
            row, col = np.nonzero(score > -np.inf)
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(self.keys[a : a + BATCH][row]), pa.array(self.hit[a : a + BATCH][row, col]), pa.array(score[row, col] / PLACES)], ["qid", "doc", "score"])


def _runs(*columns: np.ndarray):
    """(start, end) of the runs of equal rows."""
    change = np.zeros(len(columns[0]) + 1, bool)
    change[0] = change[-1] = True
    for c in columns:
        change[1:-1] |= c[1:] != c[:-1]
    edge = np.flatnonzero(change)
    return zip(edge[:-1], edge[1:])


def _task(k: int, floor: float | None, itself: bool):
    """Rows (slot, size, side, cell, key, v, cells) that come sorted by the first four, as hits."""

    def run(batches):
        now, asked, best, looks = None, [], None, None
        everyone = np.zeros(0, np.int64)

        def begin():
            """The queries of a slot are all there."""
            nonlocal best, looks, everyone
            keys = np.concatenate([a for a, _, _ in asked]) if asked else np.zeros(0, np.int64)
            looks, everyone = None, np.arange(len(keys))
            if not asked:
                best = Best(keys, np.zeros((0, 1)), k, floor, itself)
                return
            best = Best(keys, unit(np.concatenate([q for _, q, _ in asked])), k, floor, itself)
            if asked[0][2] is not None:
                cell = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for _, _, c in asked])
                of = np.repeat(everyone, np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for _, _, c in asked]))
                order = np.argsort(cell, kind="stable")
                cell, of = cell[order], of[order]
                looks = {int(cell[a]): of[a:z] for a, z in _runs(cell)} if len(cell) else {}

        for b in batches:
            if not b.num_rows:
                continue
            slot, size, side, cell, key = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            for a, z in _runs(slot, size, side, cell):
                if now != (slot[a], size[a]):
                    if best is not None:
                        yield from best.rows()
                    now, asked, best = (slot[a], size[a]), [], None
                v = matrix(b.column(5).slice(a, z - a))
                if not side[a]:
                    cells = b.column(6).slice(a, z - a)
                    asked.append((key[a:z].copy(), v, None if cells.null_count else cells))
                    continue
                if best is None:
                    begin()
                of = everyone if looks is None else looks.get(int(cell[a]))
                if of is not None and len(of):
                    best.see(key[a:z], unit(v), of)
        if best is not None:
            yield from best.rows()

    return run


def groups(spark: SparkSession, vectors: int, queries: int) -> tuple[int, int]:
    """How many groups of vectors and chunks of queries there are."""
    chunks = max(1, -(-queries // CHUNK))
    tasks = max(24, 3 * spark.sparkContext.defaultParallelism)
    return max(1, min(-(-tasks // chunks), -(-vectors // GROUP))), chunks


def meet(vectors: DataFrame, queries: DataFrame, n_groups: int, n_chunks: int, k: int, floor: float | None = None, itself: bool = False) -> DataFrame:
    """qid, doc, score: for each query the k best of each group.

    vectors: group int, cell int, key long, size int, v; queries: group (null: all groups), cells (whose vectors are looked at; null:
    all), key, size, v. Only vectors and queries of one size meet.
    """
    chunk = F.pmod(F.xxhash64("key"), F.lit(n_chunks)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    held = vectors.withColumn("chunk", F.explode(all_of(n_chunks)))
    asked = queries.withColumn("chunk", chunk).withColumn("group", F.explode(F.when(F.col("group").isNull(), all_of(n_groups)).otherwise(F.array("group"))))
    slot = (F.col("group") * n_chunks + F.col("chunk")).cast("int").alias("slot")
    both = held.select(slot, "size", F.lit(1).alias("side"), "cell", "key", "v", F.lit(None).cast("array<int>").alias("cells"))
    both = both.unionByName(asked.select(slot, "size", F.lit(0).alias("side"), F.lit(0).alias("cell"), "key", "v", "cells"))
    d = both.repartitionById(n_groups * n_chunks, F.col("slot")).sortWithinPartitions("slot", "size", "side", "cell")
    return d.mapInArrow(_task(k, floor, itself), "qid long, doc long, score double")
