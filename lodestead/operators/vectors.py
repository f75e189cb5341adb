"""Approximate dense search: vectors in cells around fitted centroids, searched by a join on the cells next to each query.

The centroids come from a bounded sample (LEARN_FROM vectors, about, those of least hash), every vector is in the index. Vectors
lie in blocks of one cell; a query meets the vectors of the `probes` cells closest to it, matrix against matrix
(operators.nearest), so no pair of vectors is ever a row. Cells are dealt out to groups, a query goes once to each group that has
some of its cells, and a cell's vectors are dealt to SPREAD tasks, as many may share it. How many cells a query must look
into is measured on the sample, by where its own nearest neighbours lie: directions without clusters need many, others few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestead.operators import nearest
from lodestead.operators.nearest import matrix as _matrix
from lodestead.operators.nearest import unit as _unit
from lodestead.operators.retrieval import top
from lodestead.sources import snapshots
from lodestead.sources.snapshots import Snapshot

#: Vectors that the centroids are fitted on, cells at most, rounds of the fit, and vectors of a block.
LEARN_FROM, CELLS, ROUNDS, BLOCK = 20_000, 1_024, 12, 256
#: How many of the sample's vectors ask for how many neighbours each, and the share to find, when the number of probes is chosen.
ASKED, NEIGHBOURS, TARGET = 500, 10, 0.95
#: Tasks that the vectors of one cell are dealt to in a search.
SPREAD = 4


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centroids of length 1 of a sample's directions; a cell that loses its vectors starts anew at the one that fits worst."""
    x = _unit(sample)
    c = x[np.random.default_rng(seed).permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        near = x @ c.T
        own = near.argmax(1)
        for k in range(len(c)):
            mine = x[own == k]
            c[k] = mine.sum(0) if len(mine) else x[near.max(1).argmin()]
        c = _unit(c)
    return c


def probes_for(sample: np.ndarray, centroids: np.ndarray, target: float = TARGET) -> int:
    """The fewest closest cells that hold this share of the sample's nearest neighbours, asked from ASKED of its vectors."""
    x = _unit(sample)
    asked = x[:: max(1, len(x) // ASKED)][:ASKED]
    near = np.concatenate([np.argsort(-(asked[i : i + 20] @ x.T), 1, kind="stable")[:, 1 : NEIGHBOURS + 1] for i in range(0, len(asked), 20)])
    order = np.argsort(-(asked @ centroids.T), 1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
    own = np.concatenate([(x[i : i + 1_000] @ centroids.T).argmax(1) for i in range(0, len(x), 1_000)])
    needed = np.take_along_axis(place, own[near], 1) + 1
    return int(np.quantile(needed, target, method="higher")) if needed.size else 1


def _blocks(keys: str):
    """Rows (cell, key, v) that come by cell as blocks (cell, keys, data) of BLOCK vectors, the data as float64."""

    def run(batches):
        rest = None
        for b in batches:
            t = b if rest is None else pa.concat_batches([rest, b])
            rest, cell = None, t.column("cell").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]])) if len(cell) else np.zeros(1, np.int64)
            cuts = [(lo, min(lo + BLOCK, z)) for a, z in zip(edge[:-1], edge[1:]) for lo in range(a, z, BLOCK)]
            if cuts and cuts[-1][1] - cuts[-1][0] < BLOCK:
                rest = t.slice(cuts[-1][0])
                cuts.pop()
            yield from _packed(t, cuts)
        if rest is not None and rest.num_rows:
            yield from _packed(rest, [(0, rest.num_rows)])

    def _packed(t, cuts):
        if cuts:
            data = _matrix(t.column("v"))
            lists = pa.array([t.column("key").slice(a, z - a).to_pylist() for a, z in cuts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([t.column("cell")[a].as_py() for a, _ in cuts], pa.int32()), lists, pa.array([data[a:z].tobytes() for a, z in cuts], pa.binary())], ["cell", keys, "data"])

    return run


def _placed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """key, v, cell: each vector with its closest cell."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                cell = (_unit(_matrix(b.column("v"))) @ centroids.T).argmax(1)
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("v"), pa.array(cell.astype(np.int32))], ["key", "v", "cell"])

    return rows.mapInArrow(run, "key long, v array<double>, cell int")


def _asked(rows: DataFrame, centroids: np.ndarray, probes: int, parts: int) -> DataFrame:
    """key, v (its doubles' bytes), part, cells: each vector once for each part of the cells (the cell's number modulo parts) that
    has some of its `probes` closest ones, and these."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"))
            cells = np.argsort(-(_unit(x) @ centroids.T), 1, kind="stable")[:, :probes].astype(np.int32)
            data = pa.array([v.tobytes() for v in x], pa.binary())
            for part in range(parts):
                mine = cells % parts == part
                size = mine.sum(1)
                at = pa.array(np.flatnonzero(size))
                ends = pa.array(np.concatenate([[0], np.cumsum(size[size > 0])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("key").take(at), data.take(at), pa.array(np.full(len(at), part, np.int32)), pa.ListArray.from_arrays(ends, pa.array(cells[mine]))], ["key", "v", "part", "cells"])

    return rows.mapInArrow(run, "key long, v binary, part int, cells array<int>")


def _rows(vectors: DataFrame, key: str, dimension: int | None = None) -> DataFrame:
    """key and v; rows with a null key or vector, or with another dimension than the index has, are left out."""
    d = vectors.select(F.col(key).cast("long").alias("key"), F.col("embedding").cast("array<double>").alias("v")).where("key IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    return d if dimension is None else d.where(F.size("v") == dimension)


def _table(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    d = _placed(rows, centroids).repartition("cell", F.pmod(F.xxhash64("key"), F.lit(parts))).sortWithinPartitions("cell")
    return d.mapInArrow(_blocks("docs"), "cell int, docs array<long>, data binary")


def build(spark: SparkSession, root: str, vectors: DataFrame, key: str = "vec_id", cells: int | None = None) -> Snapshot:
    """The index of vectors (key, embedding) as the next version under root. cells: by default the root of their number."""
    size = _rows(vectors, key).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return snapshots.update(spark, root, lambda base: {"note": {"centroids": [], "dimension": 0, "probes": 0}})
    rows = _rows(vectors, key, size.d)
    # the least hashes by a bound on them, so that no more than the sample reaches the driver
    bound = int(min(1.0, LEARN_FROM / size["count"]) * 2.0**64) - 2**63
    few = rows.withColumn("h", F.xxhash64("key")).where(F.col("h") <= min(bound, 2**63 - 1)).select("h", "key", "v").toArrow()
    few = few.sort_by([("h", "ascending"), ("key", "ascending")]).column("v").combine_chunks()
    sample = _matrix(few)
    n = cells or min(CELLS, len(sample), max(1, round(size["count"] ** 0.5)))
    c = fit(sample, n)
    return snapshots.update(spark, root, lambda base: {"replace": {"blocks": _table(rows, c)}, "partitions": {"blocks": ["cell"]}, "note": {"centroids": c.tolist(), "dimension": size.d, "probes": probes_for(sample, c)}})


def add(spark: SparkSession, root: str, vectors: DataFrame, key: str = "vec_id") -> Snapshot:
    """The index with more vectors in its cells; the centroids stay."""

    def change(base: Snapshot) -> dict:
        return {"append": {"blocks": _table(_rows(vectors, key, base.note["dimension"]), np.array(base.note["centroids"]))}, "partitions": {"blocks": ["cell"]}}

    return snapshots.update(spark, root, change)


def search(snap: Snapshot, queries: DataFrame, k: int = 4, probes: int | None = None, key: str = "vec_id", itself: bool = False) -> DataFrame:
    """qid, doc, score, rank: the k greatest cosines of each query (key, embedding) in the cells next to it, by
    default as many as the index has measured to be enough. itself: whether a document of the query's own key counts."""
    c, d = np.array(snap.note["centroids"]), snap.note["dimension"]
    if not d:
        return snap.spark.createDataFrame([], "qid long, doc long, score double, rank int")
    blocks = snap.read("blocks").select("cell", "docs", "data")
    held = blocks.agg(F.coalesce(F.sum(F.size("docs")), F.lit(0))).first()[0]
    wanted = _rows(queries, key, d)
    n_groups, n_chunks = nearest.groups(snap.spark, held, wanted.count())
    parts = max(1, min(n_groups // SPREAD, len(c)))
    group = lambda part, share: (part * SPREAD + share).cast("int").alias("group")
    rows = blocks.select("cell", "data", F.posexplode("docs").alias("i", "key"))
    rows = rows.select(group(F.col("cell") % parts, F.pmod(F.xxhash64("key"), F.lit(SPREAD))), "cell", "key", F.lit(d).alias("size"), F.substring("data", F.col("i") * (8 * d) + 1, F.lit(8 * d)).alias("v"))
    asked = _asked(wanted, c, probes or snap.note["probes"], parts).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    asked = asked.select(group(F.col("part"), F.col("share")), "cells", "key", F.lit(d).alias("size"), "v")
    met = nearest.meet(rows, asked, parts * SPREAD, n_chunks, k, itself=itself)
    return top(met, ["qid"], "score", "doc", k).select("qid", "doc", F.round("score", 6).alias("score"), "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: n_queries, n_exact and the share of the exact hits (qid, doc) that were found."""
    d = exact.select("qid", "doc").join(found.select("qid", "doc", F.lit(1).alias("hit")), ["qid", "doc"], "left")
    return d.agg(F.countDistinct("qid").alias("n_queries"), F.count("*").alias("n_exact"), (F.coalesce(F.sum("hit"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("recall"))
