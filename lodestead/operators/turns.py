"""The turn fold: conversations as a keyed state machine, in one plan for a table of turns and for a stream of them.

A turn is (session_id, turn, message, answer envelope, raised): what was said, and what the answering operators made of
it. The fold goes through a session's turns in order with its state: the pending confirmation of a reset, the confirmed
facts, the model, steps, flags, the last messages. Everything about a single turn is computed beforehand in columns, so the fold itself
only carries the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.functions import guards, policies
from lodestead.functions.text import any_match, let

WINDOW = 8
MESSAGE = "struct<role:string,content:string>"
STATE = f"struct<pending:string,confirmed:boolean,model:string,steps:array<string>,turns:int,resolved:boolean,escalated:boolean,window:array<{MESSAGE}>,version:int>"
# What points to another way while a reset waits for its confirmation, and what names a reset.
OTHER_WAYS = ("anything else", "try before", "alternative", "before wiping", "before resetting")
_RESET_WORDS = ("factory reset", "full reset", "reset everything")


def new_session() -> Column:
    """The state of a session that hasn't been seen: nothing pending, no facts, no turns."""
    return F.from_json(F.lit('{"confirmed": false, "steps": [], "turns": 0, "resolved": false, "escalated": false, "window": [], "version": 0}'), STATE)


def prepare(turns: DataFrame, quotes: dict[str, str]) -> DataFrame:
    """turns (session_id, turn, message, answer) with what the fold needs of each, independent of the state."""
    clean = guards.inspect(F.col("message"))
    d = turns.select("session_id", "turn", clean["redacted"].alias("said"), clean["is_safe"].alias("safe"), "answer")
    low = F.lower("said")
    hit = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    d = d.withColumns({"hazard": policies.hazard_envelope(policies.hazard(F.col("said"), F.lit("")), quotes), "model": guards.model(low), "yes": any_match(low, guards.YES), "no": any_match(low, guards.NO), "other": hit(OTHER_WAYS), "reset_words": hit(_RESET_WORDS)})
    kind = policies.reset_kind(F.col("said"), F.col("answer.response"), F.lit(False), F.lit(None).cast("int"))
    late = policies.hazard_envelope(policies.hazard(F.col("said"), F.col("answer.response")), quotes)
    return d.withColumns({"late": late, "warned": F.coalesce(policies.reset_envelope(kind, quotes), F.col("answer")), "as_is": policies.without_solicitation(F.col("answer"), quotes)}).withColumn("warned_safe", policies.without_solicitation(F.col("warned"), quotes))


def fixed_answers(quotes: dict[str, str]) -> dict[str, Column]:
    """The answers that don't depend on what was proposed."""
    q, text, reset = {k: F.lit(v) for k, v in quotes.items()}, F.lit, [(policies.RESET_GUIDE, policies.RESTART)]
    return {
        "injection": policies.envelope(text("I can only assist with device troubleshooting and network configuration. How can I help?"), [], "ask"),
        "cancelled": policies.envelope(F.concat_ws(" ", text("Understood, skipping factory reset. As a non-destructive alternative:"), policies.first_sentence(q["restart"]), text("Would you like to try this?")), reset, "ask"),
        "other_way": policies.envelope(text("Before performing a factory reset, try power cycling the device: disconnect power for 10 seconds and reconnect."), reset, "ask"),
        "confirmed": policies.envelope(q["hold"], [(policies.RESET_GUIDE, policies.ERASE)], "instruct"),
        "confirmed_pro": policies.envelope(q["hold_pro"], [(policies.PRO_GUIDE, "Factory reset")], "instruct"),
    }


def fold(prepared: DataFrame, stored: DataFrame | None, quotes: dict[str, str]) -> DataFrame:
    """One row per session: session_id, state after its turns, and outputs (turn, answer, step, kind) of each turn.

    stored: session_id and state of sessions that were seen before. A session's turns are gathered in one row, as its state
    passes from one to the next; sessions are bounded by what one conversation holds.
    """
    cols = ["turn", "said", "safe", "answer", "hazard", "model", "yes", "no", "other", "reset_words", "late", "warned", "as_is", "warned_safe"]
    d = prepared.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("all"))
    if stored is None:
        d = d.withColumn("state", new_session())
    else:
        d = d.join(stored.select("session_id", F.col("state").cast(STATE).alias("state")), "session_id", "left").withColumn("state", F.coalesce("state", new_session()))
    text = F.lit
    outside, skipped, gentle, do_it, do_pro = fixed_answers(quotes).values()
    output = f"struct<turn:bigint,kind:string,answer:{policies.ENVELOPE},step:string>"

    def step(acc, x):
        s = acc["state"]
        waits = F.coalesce(s["pending"] == "factory_reset", F.lit(False))
        kind = (
            F.when(x["hazard"].isNotNull(), "hazard").when(~x["safe"], "injection").when(waits & x["no"] & ~x["yes"], "cancelled")
            .when(waits & x["yes"] & ~x["no"], "confirmed").when(waits & x["other"], "other_way").otherwise("answered")
        )
        return let(F.struct(kind.alias("kind"), F.coalesce(x["model"], s["model"]).alias("model")), lambda k: let(replied(s, x, k["kind"], k["model"]), lambda y: after(acc, x, k["kind"], k["model"], y["answer"], y["label"])))

    def replied(s, x, kind, model):
        answered = F.coalesce(x["late"], F.when(s["confirmed"], x["as_is"]).otherwise(x["warned_safe"]))
        answer = (
            F.when(kind == "hazard", x["hazard"]).when(kind == "injection", outside).when(kind == "cancelled", skipped)
            .when(kind == "confirmed", F.when(F.lower(model).contains("pro"), do_pro).otherwise(do_it)).when(kind == "other_way", gentle).otherwise(answered)
        )
        label = lambda a: F.when(kind == "hazard", "hazard_escalation").when(kind == "confirmed", "factory_reset").when(kind == "answered", guards.step_label(a["action"], a["response"]))
        return let(answer, lambda a: F.struct(a.alias("answer"), label(a).alias("label")))

    def after(acc, x, kind, model, answer, label):
        s = acc["state"]
        before = F.when(s["confirmed"], x["answer"]).otherwise(x["warned"])  # as the reset check leaves it
        asks = (kind == "answered") & x["late"].isNull() & (before["response"].startswith("Warning: A factory reset") | (x["reset_words"] & (before["action"] == "ask")))
        early = kind.isin("hazard", "injection")
        pending = F.when(F.coalesce(asks, F.lit(False)), "factory_reset").when(early, s["pending"])
        steps = F.when(label.isNotNull(), F.array_distinct(F.concat(s["steps"], F.array(label)))).otherwise(s["steps"])
        said = F.array(F.struct(text("user").alias("role"), x["said"].alias("content")), F.struct(text("assistant").alias("role"), answer["response"].alias("content")))
        window = F.concat(F.slice(s["window"], F.greatest(text(1), F.size(s["window"]) - WINDOW + 3), text(WINDOW)), said)
        state = F.struct(
            pending.alias("pending"), (s["confirmed"] | (kind == "confirmed")).alias("confirmed"), F.when(early, s["model"]).otherwise(model).alias("model"), steps.alias("steps"), (s["turns"] + 1).alias("turns"),
            (s["resolved"] | ((kind == "answered") & (answer["action"] == "resolved"))).alias("resolved"), (s["escalated"] | (kind == "hazard") | ((kind == "answered") & (answer["action"] == "escalate"))).alias("escalated"),
            window.alias("window"), (s["version"] + 1).alias("version"),
        ).cast(STATE)
        out = F.struct(x["turn"].cast("long").alias("turn"), kind.alias("kind"), answer.alias("answer"), label.alias("step")).cast(output)
        return F.struct(state.alias("state"), F.concat(acc["outputs"], F.array(out)).alias("outputs"))

    start = F.struct(F.col("state").alias("state"), F.array().cast(f"array<{output}>").alias("outputs"))
    return d.select("session_id", F.aggregate("all", start, step).alias("r")).select("session_id", "r.state", "r.outputs")


def outputs(folded: DataFrame) -> DataFrame:
    """One row per turn: session_id, turn, kind, answer, step."""
    return folded.select("session_id", F.inline("outputs"))


def events(answers: DataFrame) -> DataFrame:
    """The event stream of answers (session_id, turn, answer, proposed): start, status twice, a delta for each word of what
    was proposed, replace where the guards changed it, citations, done."""
    words = F.split(F.coalesce("proposed", F.lit("")), " ")
    one = lambda event, data: F.struct(F.lit(event).alias("event"), F.coalesce(data, F.lit("")).alias("data"))
    head = F.array(one("start", F.col("session_id")), one("status", F.lit("retrieving")), one("status", F.lit("answering")))
    changed = F.when(~F.col("proposed").eqNullSafe(F.col("answer.response")), F.array(one("replace", F.col("answer.response")))).otherwise(F.array().cast("array<struct<event:string,data:string>>"))
    tail = F.array(one("citations", F.to_json("answer.citations")), one("done", F.col("answer.action")))
    every = F.concat(head, F.transform(words, lambda w: one("delta", w)), changed, tail)
    return answers.select("session_id", "turn", F.posexplode(every).alias("seq", "e")).select("session_id", "turn", F.col("seq").cast("long").alias("seq"), "e.event", "e.data")


def reassemble(stream: DataFrame) -> DataFrame:
    """What a client shows of each turn's events: the deltas in order, or what the last replace put in their place."""
    d = stream.where("event IN ('delta', 'replace')").groupBy("session_id", "turn").agg(
        F.max_by(F.when(F.col("event") == "replace", F.col("data")), F.when(F.col("event") == "replace", F.col("seq"))).alias("put"),
        F.array_sort(F.collect_list(F.when(F.col("event") == "delta", F.struct("seq", "data")))).alias("parts"),
    )
    return d.select("session_id", "turn", F.coalesce("put", F.array_join(F.transform("parts", lambda x: x["data"]), " ")).alias("text"))
