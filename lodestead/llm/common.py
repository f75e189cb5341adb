"""Shared helpers of the training-data operators: tables, intermediate results, word hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestead.sources.shared import shared_dir

#: White space of the word rule, as a Java/RE2 character class body.
WS = r"\x20\x09-\x0D"
WORD = f"[^{WS}]+"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session has the default of 10,000: whole texts are wide rows, and a batch
    lies in the memory of the JVM and of a Python worker at once. Also ships the package."""
    ship(spark)
    if spark.conf.get(_BATCH, None) == "10000":
        spark.conf.set(_BATCH, "1000")


_ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which needn't have it: once a session, as a zip file through Spark."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED and (_ROOT / "lodestead").is_dir():
        _SHIPPED.add(app)
        folder = tempfile.mkdtemp(prefix="lodestead-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/lodestead.zip", "w") as z:
            for f in sorted((_ROOT / "lodestead").rglob("*.py")):
                z.write(f, f.relative_to(_ROOT))
        spark.sparkContext.addPyFile(f"{folder}/lodestead.zip")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(columns: Iterable[str]) -> list[Column]:
    """Columns by their exact names, whatever characters these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def words(text: str | Column) -> Column:
    """Words of a text, in order; a null text has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), f"[{WS}]+"), "")


_MADE: dict[str, SparkSession] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts its lineage.

    The table survives lost executors, and the shuffle files of the job that made it are freed at once
    rather than kept until the driver collects its garbage.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    if before is not None:
        spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEAN, before)
    if not _MADE:
        atexit.register(clear)
    _MADE[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestead_path = path
    return out


def _delete(path: str, spark: SparkSession) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later result reads."""
    for df in tables:
        if (path := getattr(df, "_lodestead_path", None)) and (spark := _MADE.pop(path, None)):
            _delete(path, spark)


def clear() -> None:
    """Delete all materialized tables; callers do so once their results are written, and the driver's exit does."""
    for path in list(_MADE):
        spark = _MADE.pop(path)
        if spark.sparkContext._jsc is not None:
            _delete(path, spark)


def anew(df: DataFrame, *keys: str) -> DataFrame:
    """df with its integer keys computed anew. What an aggregate has dealt out by a key is joined in place, and then Spark
    can't split the other side's hot key; if both sides are dealt out for the join, it can."""
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0)) for k in keys})


# ---------------------------------------------------------------- word hashing in numpy
_U = np.uint64
_BASE, _INV = _U(0x9E3779B97F4A7C15 | 5), None
_MIX1, _MIX2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POW = np.ones(1, _U), np.ones(1, _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(33))
    x = x * _MIX1
    x ^= x >> _U(33)
    x *= _MIX2
    x ^= x >> _U(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    global _POW
    if len(_POW[0]) < n:
        n = max(n, 1 << 20)
        inv = pow(int(_BASE), -1, 1 << 64)
        out = []
        for b in (_BASE, _U(inv)):
            p = np.full(n, b, _U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=_U))
        _POW = tuple(out)
    return _POW[0][:n], _POW[1][:n]


def spans(x: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Position-free polynomial hashes of x[at:to] for each pair of at and to."""
    pw, inv = powers(len(x) + 1)
    total = np.zeros(len(x) + 1, _U)
    np.cumsum(x * pw[: len(x)], out=total[1:])
    return (total[to] - total[at]) * inv[at]


PIECE = 1 << 20


def hash_words(buf: np.ndarray, starts: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie one behind another in buf.

    starts: the texts' first bytes, then the end. Returns the hashes and, likewise, the texts' first words.
    """
    space = _SPACE[buf]
    first = ~space
    bound = np.zeros(len(buf) + 1, bool)
    bound[starts] = True
    if len(buf) > 1:
        first[1:] &= space[:-1] | bound[1:-1]
    last = ~space
    if len(buf) > 1:
        last[:-1] &= space[1:] | bound[1:-1]
    at, to = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(at), _U)
    lo = 0
    while lo < len(at):  # pieces bound the memory; no word is cut
        hi = max(lo + 1, int(np.searchsorted(to, at[lo] + PIECE, "right")))
        a, z = at[lo], to[hi - 1]
        x = (_LOWER[buf[a:z]] if lower else buf[a:z]).astype(_U) + _U(1)
        n = to[lo:hi] - at[lo:hi]
        out[lo:hi] = mix(spans(x, at[lo:hi] - a, to[lo:hi] - a) + n.astype(_U) * _MIX2)
        lo = hi
    return out, np.searchsorted(at, starts)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and each row's first byte, then the end."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if offs is not None and len(offs) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[o[0] : o[-1]], o - o[0]


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text (or one row), so that numpy's copies stay small."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def ragged(values: np.ndarray, starts: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values, kind))


# ---------------------------------------------------------------- connected components
def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b: long): one row (node, component: its smallest node) for each node with an edge.

    Alternating large-star and small-star contractions (Kiveris et al., 2014); each round is written to the
    shared folder. Nodes are never gathered: a node's neighbours only meet in a pre-aggregated minimum, in joins that
    can split a hot node. Every round that changes anything makes an edge's nodes smaller, so the rounds end.
    """
    now = materialize(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), name)
    before = None
    while True:
        both = now.unionByName(now.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) m")
        large = both.join(anew(least, "a"), "a").where("b > a").selectExpr("b a", "m b").where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(anew(least, "a"), "a").selectExpr("b a", "m b").unionByName(least.selectExpr("a", "m b")).where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct()
        after = materialize(small, name)
        sign = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if sign == before:
            return now.selectExpr("a node", "b component").unionByName(now.selectExpr("b node", "b component").distinct())
        before = sign
