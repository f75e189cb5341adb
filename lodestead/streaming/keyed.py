"""The turn fold as a keyed stateful stream: each session's state lies in Spark's state store, under its own key.

A batch touches only the sessions that it has turns of. What a turn says is computed in columns before (turns.prepare); the
processor carries the state from turn to turn. Sessions that were stored before come in as the initial state, and an
event-time timer lets a session go when the watermark has passed its last turn by the time to live. A session has one timer: one
that ends before the session is due is set anew, which costs less than to move it with each turn. A restart goes on from the
checkpoint, and a batch that runs again finds the state as it was before it.

Turns are dealt out by their sessions before they are prepared: what a turn takes then doesn't depend on how many files it came in.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lodestead.functions import guards, policies
from lodestead.operators import turns as machine
from lodestead.streaming.sessions import write_batches

PARTITIONS = "spark.sql.shuffle.partitions"
#: A batch writes its changes to the checkpoint, not the store's files.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: A batch opens and commits the store of each partition, also of those without turns: so many for each core suffice, or in all where there are few cores.
PER_CORE, AT_LEAST = 4, 32
#: A session's state as it is stored: the window as JSON, as the store takes no lists of structures; due: when it may go, in milliseconds.
STATE = "pending string, confirmed boolean, model string, steps array<string>, turns int, resolved boolean, escalated boolean, window string, version int, due long"
OUTPUT = f"session_id string, turn long, kind string, answer {policies.ENVELOPE}, step string"
NEW = (None, False, None, [], 0, False, False, "[]", 0, 0)


def prepare(turns: DataFrame, quotes: dict[str, str]) -> DataFrame:
    """turns (session_id, turn, message, answer, at) with what the processor needs of each."""
    label = lambda c: guards.step_label(F.col(f"{c}.action"), F.col(f"{c}.response"))
    d = machine.prepare(turns.withColumn("turn", F.struct("turn", "at")), quotes)
    d = d.withColumns({"at": F.col("turn.at"), "turn": F.col("turn.turn")} | {f"{c}_label": label(c) for c in ("late", "as_is", "warned_safe")})
    return d


class Turns(StatefulProcessor):
    """Carries a session's state through its turns, in their order."""

    def __init__(self, fixed: dict[str, dict], ttl: float) -> None:
        self.fixed, self.ttl = fixed, int(ttl * 86_400_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update(tuple(getattr(initialState, c.split(" ")[0]) for c in STATE.split(", ") if c != "due long") + (0,))

    def handleInputRows(self, key, rows, timerValues):
        s = list(self.state.get() or NEW)
        last = 0
        for x in sorted(rows, key=lambda r: r.turn):
            s, kind, answer, step = self.turn(s, x)
            last = max(last, int(x.at.timestamp() * 1000))
            yield Row(session_id=key[0], turn=x.turn, kind=kind, answer=answer, step=step)
        due = max(s[9], last + self.ttl)
        if not s[9]:
            self.handle.registerTimer(due)
        self.state.update((*s[:9], due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = self.state.get()[9]
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
            return
        self.state.clear()
        yield Row(session_id=key[0], turn=None, kind="expired", answer=None, step=None)

    def turn(self, s: list, x: Row) -> tuple:
        pending, confirmed, model, steps, turns, resolved, escalated, window, version, due = s
        waits, label, asks = pending == "factory_reset", None, False
        if x.hazard is not None:
            kind, answer, label = "hazard", x.hazard, "hazard_escalation"
        elif not x.safe:
            kind, answer = "injection", self.fixed["injection"]
        elif waits and x.no and not x.yes:
            kind, answer = "cancelled", self.fixed["cancelled"]
        elif waits and x.yes and not x.no:
            kind, label = "confirmed", "factory_reset"
            answer = self.fixed["confirmed_pro" if "pro" in (x.model or model or "").lower() else "confirmed"]
        elif waits and x.other:
            kind, answer = "other_way", self.fixed["other_way"]
        else:
            kind, which = "answered", "late" if x.late is not None else "as_is" if confirmed else "warned_safe"
            answer, label = x[which], x[f"{which}_label"]
            before = x.answer if confirmed else x.warned
            asks = which != "late" and ((before["response"] or "").startswith("Warning: A factory reset") or (x.reset_words and before["action"] == "ask"))
        if kind not in ("hazard", "injection"):
            pending, model = None, x.model or model
        if asks:
            pending = "factory_reset"
        if label is not None and label not in steps:
            steps = [*steps, label]
        said = [{"role": "user", "content": x.said}, {"role": "assistant", "content": answer["response"]}]
        window = json.dumps([*json.loads(window), *said][-machine.WINDOW :])
        resolved |= kind == "answered" and answer["action"] == "resolved"
        escalated |= kind == "hazard" or kind == "answered" and answer["action"] == "escalate"
        return [pending, confirmed or kind == "confirmed", model, steps, turns + 1, resolved, escalated, window, version + 1, due], kind, answer, label


def run(turns: DataFrame, quotes: dict[str, str], spark: SparkSession, root: str, stored: DataFrame | None = None, ttl_days: float = 30, late: str = "30 days") -> DataFrame:
    """Work off what a stream of turns (session_id, turn, message, answer, at) has now; what every turn of this and earlier
    runs under root was answered: session_id, turn, kind, answer, step, batch. stored: sessions to begin with (session_id, state)."""
    fixed = spark.range(1).select(*[c.alias(k) for k, c in machine.fixed_answers(quotes).items()]).first().asDict(True)
    most = max(PER_CORE * spark.sparkContext.defaultParallelism, AT_LEAST)
    conf = STORE | {PARTITIONS: str(min(int(spark.conf.get(PARTITIONS)), most))}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        begin = None if stored is None else stored.select("session_id", F.col("state").cast(machine.STATE).alias("state")).select("session_id", "state.*").withColumn("window", F.to_json("window")).groupBy("session_id")
        out = prepare(turns.repartition("session_id"), quotes).withWatermark("at", late).groupBy("session_id").transformWithState(Turns(fixed, ttl_days), OUTPUT, "update", "eventTime", begin)
        write_batches(out, root)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    return spark.read.schema(f"{OUTPUT}, batch long").option("basePath", f"{root}/out").parquet(f"{root}/out")


def states(spark: SparkSession, root: str) -> DataFrame:
    """session_id and state of the sessions that are live, read from the state store."""
    d = spark.read.format("statestore").option("stateVarName", "session").load(f"{root}/checkpoint")
    window = F.from_json("value.window", f"array<{machine.MESSAGE}>")
    return d.select("key.session_id", F.col("value").withField("window", window).dropFields("due").alias("state"))
