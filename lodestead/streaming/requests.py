"""Requests as a stream of JSON lines, and their answers as lines and events, each batch written once under its number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestead.functions import policies
from lodestead.operators import turns
from lodestead.sources.corpus import event_line
from lodestead.streaming.sessions import write_batches

# The session of a request without one, and what answers a line that can't be read or that fails.
DEFAULT_SESSION = "default-session"
FAILED = "An error occurred while processing your request. Escalating to support."

_LINE = "session_id string, message string, _corrupt string"


def parse(lines: DataFrame) -> DataFrame:
    """line, session_id, message, readable of JSON lines (value): blank lines go; of an object, a missing session is the default
    one and a missing message empty; a line that is no JSON object isn't readable."""
    text = F.trim("value")
    r = F.from_json(text, _LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    d = lines.where(text != "").select("value", r.alias("r"), text.startswith("{").alias("object"))
    ok = F.col("object") & F.col("r._corrupt").isNull()
    return d.select(F.sha2(F.col("value").cast("binary"), 256).alias("line"), F.when(ok, F.coalesce("r.session_id", F.lit(DEFAULT_SESSION))).alias("session_id"), F.when(ok, F.coalesce("r.message", F.lit(""))).alias("message"), ok.alias("readable"))


def read(spark: SparkSession, folder: str, files: int = 1_000) -> DataFrame:
    """The lines of a folder's text files as a stream of requests, so many files a batch."""
    return parse(spark.readStream.option("maxFilesPerTrigger", files).text(folder))


def respond(requests: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """requests with their answer envelope: answer gives readable requests an `answer` column; what isn't readable, or gets
    none, is answered by the fixed escalation."""
    fixed = policies.envelope(F.lit(FAILED), [], "escalate")
    none = F.lit(None).cast(policies.ENVELOPE)
    d = answer(requests.where("readable")).select("line", "session_id", "message", "readable", F.col("answer").cast(policies.ENVELOPE).alias("answer"))
    d = d.unionByName(requests.where("NOT readable").withColumn("answer", none))
    return d.withColumn("answer", F.coalesce("answer", fixed))


def response_lines(answers: DataFrame) -> DataFrame:
    """Answers as JSON lines (value)."""
    return answers.select(F.to_json("answer").alias("value"))


def event_text(answers: DataFrame) -> DataFrame:
    """Answers as the text of their event streams: one row (line, value) each, its events in order."""
    d = answers.select(F.coalesce("session_id", F.lit(DEFAULT_SESSION)).alias("session_id"), F.col("line").alias("turn"), F.col("answer.response").alias("proposed"), "answer")
    e = turns.events(d).select("turn", "seq", event_line(F.col("event"), F.col("data")).alias("text"))
    e = e.groupBy("turn").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("all"))
    return e.select(F.col("turn").alias("line"), F.array_join(F.transform("all", lambda x: x["text"]), "").alias("value"))


def run(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], spark: SparkSession, root: str) -> DataFrame:
    """Answer all requests that a stream has now. Returns the answers of this and earlier runs under root, with the batch that
    each came in; a batch that runs again replaces its own answers, so none is written twice."""
    write_batches(respond(requests, answer), root, "append")
    return spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out")
