"""Streamed session state: each batch is folded into a table of states, by the plan that also folds a whole table at once.

A batch reads the states of the highest number below its own and writes its own, under its number, to the shared folder. A batch
that is run again, after a failure or a restart, reads the same states and writes the same, so each turn counts once. This
suits any fold of whole tables; streaming.keyed and running_counts() hold their state in Spark's store instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestead.operators import turns as machine
from lodestead.sources.shared import scratch


def counts(turns: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Running state of each conversation: counts, last turn, characters; stored states are added."""
    new = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("n_chars"))
    if stored is None:
        return new
    return new.unionByName(stored).groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.max("last_turn").alias("last_turn"), F.sum("n_chars").alias("n_chars"))


def session_states(turns: DataFrame, stored: DataFrame | None, quotes: dict[str, str]) -> DataFrame:
    """session_id and state of all sessions after these turns, untouched ones included."""
    new = machine.fold(machine.prepare(turns, quotes), stored, quotes).select("session_id", "state")
    return new if stored is None else new.unionByName(stored.join(new.select("session_id"), "session_id", "left_anti"))


def _states(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches whose states are written in full, ascending."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/states")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    done = [f.getPath() for f in fs.listStatus(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("batch-")) for p in done)


def fold_batch(spark: SparkSession, root: str, batch: DataFrame, number: int, fold: Callable[[DataFrame, DataFrame | None], DataFrame]) -> None:
    """Write the states after a batch under its number, from those of the highest number below it: running a batch again, also
    after a restart, reads the same states and writes the same ones. States older than the last two are deleted."""
    before = [n for n in _states(spark, root) if n < number]
    stored = spark.read.parquet(f"{root}/states/batch-{before[-1]}") if before else None
    fold(batch, stored).write.mode("overwrite").parquet(f"{root}/states/batch-{number}")
    for n in before[:-1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/states/batch-{n}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run_once(stream: DataFrame, fold: Callable[[DataFrame, DataFrame | None], DataFrame], spark: SparkSession, root: str | None = None) -> DataFrame:
    """Fold all that a stream has now, batch by batch, and return the last states. fold: (batch, stored states) -> states.
    root: where the states and the checkpoint lie, given again to go on after a restart."""
    root = root or scratch(spark, "stream")
    q = stream.writeStream.foreachBatch(lambda batch, number: fold_batch(spark, root, batch, number, fold)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    done = _states(spark, root)
    return spark.read.parquet(f"{root}/states/batch-{done[-1]}") if done else fold(spark.createDataFrame([], stream.schema), None)


def write_batches(out: DataFrame, root: str, mode: str = "update"):
    """Start a stream whose batches are written under their numbers, so that one that runs again replaces what it wrote; ends
    when all that there is now is worked off."""
    step = lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
    q = out.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def running_counts(stream: DataFrame, spark: SparkSession, root: str | None = None) -> DataFrame:
    """counts() of a stream by Spark's own keyed state: a batch reads and writes only the conversations that it has turns of,
    and the last row that any batch wrote of a conversation is its state."""
    root = root or scratch(spark, "counts")
    write_batches(counts(stream), root)
    rows = spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out")
    cols = ["n_turns", "last_turn", "n_chars"]
    return rows.groupBy("conv_id").agg(F.max_by(F.struct(*cols), "batch").alias("s")).select("conv_id", *[F.col(f"s.{c}").alias(c) for c in cols])


def read_stream(spark: SparkSession, path: str, pattern: str, files: int = 1) -> DataFrame:
    """The matching Parquet files of a folder as a stream, so many files a batch; a matching folder counts with the files in it,
    as a table is one file or a folder of parts."""
    matching = f"{path}/{pattern}"
    schema = spark.read.parquet(matching).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(matching)
