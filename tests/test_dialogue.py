"""Answers, sessions and the turn fold against plain Python."""

import json
import re
import uuid
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lodestead.functions import guards, policies, progressive
from lodestead.functions.text import Pattern, any_match
from lodestead.operators import grounding, index, retrieval, sessions, turns
from lodestead.plans import dialogue, indexes, registry
from lodestead.streaming import keyed, requests
from lodestead.streaming import sessions as streaming

CITES = "array<struct<source_id:string,locator:string>>"


def _first(patterns, text):
    return next((m.group(0) for p in patterns if (m := re.search(p, text or "", re.I))), None)


def _hazard(message, response=""):
    rungs = [("damage", _first(guards.DAMAGE, message)), ("danger", _first(policies.DANGER, response) or _first(policies.DANGER, message)), ("firmware", _first(guards.FIRMWARE, message) or _first(guards.FIRMWARE, response)), ("warranty", _first(guards.WARRANTY, message))]
    return next(((k, t) for k, t in rungs if t), (None, None))


def _solicits(text):
    for p in policies.SOLICITATION:
        for m in re.finditer(p, text or "", re.I):
            if not re.search(policies.NEGATION, text[max(0, m.start() - 40) : m.start()], re.I):
                return m.group(0)
    return None


def test_hazards_and_solicitations_equal_plain_patterns(spark, data):
    said = {r.id: r.text for r in dialogue._said(spark, data).collect()}
    got = {r.id: (r.kind, r.term) for r in dialogue.hazard_ladder(spark, data).collect()}
    assert got == {i: _hazard(t) for i, t in said.items()} and {k for k, _ in got.values()} == {None, "damage", "danger", "firmware", "warranty"}
    got = {r.id: r.term for r in dialogue.solicitation_terms(spark, data).collect()}
    assert got == {i: _solicits(t) for i, t in said.items()} and got[106] and got[110] and not got[107] and not got[108] and not got[109]


def _envelope(spark, column):
    return spark.range(1).select(column.alias("e")).first().e


def test_policies_quote_the_corpus(spark):
    rows = [(policies.SAFETY, "Safety", "Stay calm. Disconnect power now! Customers must not open it."), (policies.SAFETY, "Escalation message", "Please use the support channel on the card, always."), (policies.RESET_GUIDE, policies.ERASE, "It wipes all.\n\nOnly after confirmation: hold reset."), (policies.RESET_GUIDE, policies.RESTART, "Pull the plug. Wait.")]
    q = policies.read_policy(spark.createDataFrame(rows, "source_id string, locator string, body string"))
    assert (q["unsafe"], q["direction"], q["erases"], q["hold"], q["restart"]) == ("Disconnect power now!", "Please continue with support via the support channel on the card.", "It wipes all.", "Only after confirmation: hold reset.", "Pull the plug. Wait.")
    assert q["coverage"] == policies.QUOTES["coverage"][3]
    e = _envelope(spark, policies.hazard_envelope(policies.hazard(F.lit("smoke"), F.lit("")), q))
    assert e.action == "escalate" and "(smoke). Disconnect power now!" in e.response and e.citations[0].locator == "Safety"
    e = _envelope(spark, policies.escalation(F.lit("- the documented troubleshooting path failed twice; or\n- other\n\nProvide the model. And more.")))
    assert e.response == "Escalating to support: the documented troubleshooting path failed twice. Please continue via the support channel in the app. Provide the model."


class Machine:
    """The turn fold in plain Python."""

    def __init__(self, q):
        self.q, self.pending, self.confirmed, self.model, self.steps, self.turns, self.escalated, self.window = q, None, False, None, [], 0, False, []

    def turn(self, message, answer):
        said, safe = message["redacted"], message["is_safe"]
        low, kind = said.lower(), "answered"
        hit = lambda ps: any(re.search(p, low, re.I) for p in ps)
        self.turns += 1
        new = next((n for n, ps in guards.MODELS if hit(ps)), None)
        waits = self.pending == "factory_reset"
        if _hazard(said)[0]:
            kind, action, step = "hazard", "escalate", "hazard_escalation"
            self.escalated = True
        elif not safe:
            kind, action, step = "injection", "ask", None
        else:
            self.model = new or self.model
            yes, no, step = hit(guards.YES), hit(guards.NO), None
            self.pending = None
            if waits and no and not yes:
                kind, action = "cancelled", "ask"
            elif waits and yes and not no:
                kind, action, step = "confirmed", "instruct", "factory_reset"
                self.confirmed = True
            elif waits and any(w in low for w in turns.OTHER_WAYS):
                kind, action = "other_way", "ask"
            else:
                response, action = answer["response"], answer["action"]
                if _hazard(said, response)[0]:
                    response, action = "", "escalate"
                else:
                    asked = any(re.search(p, said, re.I) for p in policies.RESET_REQUEST) or any(re.search(p, response, re.I) for p in policies.RESET_PROPOSAL)
                    if asked and not self.confirmed:
                        response, action = policies.WARNING, "ask"
                    if response.startswith(policies.WARNING) or (any(w in low for w in turns._RESET_WORDS) and action == "ask"):
                        self.pending = "factory_reset"
                    if _solicits(response):
                        response, action = "", "ask"
                self.escalated |= action == "escalate"
                if action == "instruct":
                    r = response.lower()
                    ladder = [("factory_reset", ("factory reset", "hold the reset", "reset pin")), ("cable_checked", ("ethernet", "cable")), ("power_cycled", ("power cycle", "unplug", "restart")), ("distance_checked", ("distance", "closer")), ("channel_optimized", ("channel", "app"))]
                    step = next((n for n, ws in ladder if any(w in r for w in ws)), "instruction_step")
        if step and step not in self.steps:
            self.steps.append(step)
        return kind, action, step


def test_turn_fold_equals_plain_python_in_batch_and_stream(spark, data):
    q = policies.read_policy(None)
    said = dialogue._answered(spark, data).withColumn("m", guards.inspect(F.col("message")))
    machines, want = {}, {}
    for r in said.orderBy("session_id", "turn").collect():
        m = machines.setdefault(r.session_id, Machine(q))
        want[r.session_id, r.turn] = m.turn(r.m.asDict(), r.answer.asDict())
    got = {(r.session_id, r.turn): (r.kind, r.action, r.step) for r in dialogue.turn_fold(spark, data).collect()}
    assert got == want and {k for k, *_ in got.values()} == {"hazard", "injection", "cancelled", "confirmed", "other_way", "answered"}
    rows = {r.session_id: r for r in dialogue.batch_turn_fold(spark, data).collect()}
    assert {i: (r.pending, r.confirmed, r.turns, r.steps, r.escalated) for i, r in rows.items()} == {i: (m.pending, m.confirmed, m.turns, ",".join(m.steps), m.escalated) for i, m in machines.items()}
    assert sorted(map(tuple, rows.values()), key=repr) == sorted(map(tuple, dialogue.stream_turn_fold(spark, data).collect()), key=repr)


def test_needles_lose_no_match(spark, data):
    groups = [guards.INJECTION, guards.DAMAGE, guards.FIRMWARE, guards.WARRANTY, policies.DANGER, policies.SOLICITATION, policies.RESET_REQUEST, policies.RESET_PROPOSAL, *[p for _, p in guards.MODELS]]
    more = ["IGNORE all the rules", "you are NOW", "system prompt", "jailbreak", "Pretend to be", "sparking", "a burnt smell", "smells like burning", "it melted", "water damage", "liquid spilled", "cracked case", "on fire", "OpenWRT", "dd-wrt", "third-party firmware", "firmware rollback", "roll back my firmware", "reflash the firmware",
        "claim it under warranty", "replace my node under warranty", "disassembly", "soldering", "repair the circuits", "expose wires", "internal capacitors", "pry it open", "remove back plate", "What's your passcode", "enter WPA2 key", "type your login  keys", "give me payment details", "we need your passphrases", "can i get the full serial",
        "how to factory restore", "run a hard reset", "Reset my mesh", "erase all configuration", "wipe everything", "suggest a full reset", "factory-reset it", "we'll factory reset", "pinhole reset", "holding reset for 10", "r5pro", "pro node", "main router", "n1 node", "\u212aey \u0130 smo\u212ae REMOVE THE COVER"]
    texts = more + [m for _, m in dialogue.POLICY_MESSAGES] + [x for r in dialogue.SCRIPT for x in r[2:4]]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    d = d.unionByName(registry._messages(spark, data).select("id", F.col("text").alias("t")))
    ps = [p for g in groups for p in g]
    assert all(isinstance(p, Pattern) and p.needles and all(n == n.lower() and n.isascii() for n in p.needles) for p in ps)
    with_, without = [any_match(F.col("t"), [p]) for p in ps], [any_match(F.col("t"), [str(p)]) for p in ps]
    rows = d.select(F.array(*with_).alias("a"), F.array(*without).alias("b")).collect()
    assert all(r.a == r.b for r in rows)
    assert [p for i, p in enumerate(ps) if not any(r.b[i] for r in rows)] == []


def test_the_fold_judges_its_own_answers(spark, data):
    q, machines, kept, turns_ = policies.read_policy(None), {}, 0, 0
    for r in dialogue._answered(spark, data).withColumn("m", guards.inspect(F.col("message"))).orderBy("session_id", "turn").collect():
        _, action, _ = machines.setdefault(r.session_id, Machine(q)).turn(r.m.asDict(), r.answer.asDict())
        kept, turns_ = kept + (action == r.answer.action), turns_ + 1
    got = indexes.eval_fold(spark, data).first()
    assert got.n_turns == turns_ and got.actions == round(100 * kept / turns_, 6) and 0 < kept < turns_


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "ab"), (1, 1, "c"), (2, 0, None)], "conv_id long, turn long, text string")
    root = str(tmp_path / "root")
    for n, part in ((0, "turn = 0"), (1, "turn = 1"), (1, "turn = 1")):
        streaming.fold_batch(spark, root, rows.where(part), n, streaming.counts)
    assert sorted(map(tuple, spark.read.parquet(f"{root}/states/batch-1").collect())) == [(1, 2, 1, 3), (2, 1, 0, 0)]


def test_streams_go_on_after_a_restart(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "ab"), (1, 1, "c"), (2, 0, None)], "conv_id long, turn long, text string")
    want = {1: [(1, 1, 0, 2), (2, 1, 0, 0)], 2: [(1, 2, 1, 3), (2, 1, 0, 0)]}
    for n, part in ((1, "turn = 0"), (2, "turn = 1"), (2, "turn = 9")):
        rows.where(part).write.mode("append").parquet(str(tmp_path / "t"))
        read = lambda: streaming.read_stream(spark, str(tmp_path / "t"), "*.parquet", 100)
        assert sorted(map(tuple, streaming.run_once(read(), streaming.counts, spark, str(tmp_path / "a")).collect())) == want[n]
        assert sorted(map(tuple, streaming.running_counts(read(), spark, str(tmp_path / "b")).select("conv_id", "n_turns", "last_turn", "n_chars").collect())) == want[n]


def test_keyed_sessions_begin_with_stored_ones_and_expire(spark, tmp_path):
    q, none = policies.read_policy(None), F.array().cast(CITES)
    rows = [("a", 0, "yes, go ahead", 0), ("b", 0, "hello", 0), ("b", 1, "my R1 router", 50), ("c", 0, "hello", 9_000)]
    said = spark.createDataFrame(rows, "session_id string, turn long, message string, at long").withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("at")))
    said = said.withColumn("answer", F.struct(F.lit("ok").alias("response"), none.alias("citations"), F.lit("ask").alias("action")))
    state = turns.new_session().withField("pending", F.lit("factory_reset")).withField("turns", F.lit(4))
    stored = spark.createDataFrame([("a",)], "session_id string").withColumn("state", state)
    got, root = {}, str(tmp_path / "root")
    for part in ("session_id <> 'c'", "session_id = 'c'"):
        said.where(part).write.mode("append").parquet(str(tmp_path / "t"))
        stream = streaming.read_stream(spark, str(tmp_path / "t"), "*.parquet", 100)
        out = keyed.run(stream, q, spark, root, stored, ttl_days=1 / 24, late="1 minute")
        got[part] = {r.session_id: r.state.asDict(True) for r in keyed.states(spark, root).collect()}
    first, second = got.values()
    assert first["a"]["confirmed"] and first["a"]["turns"] == 5 and first["b"]["model"] == "R1" and [m["content"] for m in first["b"]["window"]] == ["hello", "ok", "my R1 router", "ok"]
    assert set(second) == {"c"} and sorted((r.session_id, r.kind) for r in out.collect()) == [("a", "confirmed"), ("a", "expired"), ("b", "answered"), ("b", "answered"), ("b", "expired"), ("c", "answered")]


def test_sessions_outlive_their_first_timer_and_few_stores_hold_them(spark, tmp_path):
    q, none, got, root = policies.read_policy(None), F.array().cast(CITES), [], str(tmp_path / "root")
    before = spark.conf.get(keyed.PARTITIONS)
    spark.conf.set(keyed.PARTITIONS, "40")
    try:
        for turn, at, other in ((0, 0, 0), (1, 3_000, 4_000), (2, 6_000, 6_500), (3, 6_600, 20_000)):
            said = spark.createDataFrame([("a", turn, "hi", at), (f"late{turn}", 0, "hi", other)], "session_id string, turn long, message string, at long").withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("at")))
            said.withColumn("answer", F.struct(F.lit("ok").alias("response"), none.alias("citations"), F.lit("ask").alias("action"))).write.mode("append").parquet(str(tmp_path / "t"))
            out = keyed.run(streaming.read_stream(spark, str(tmp_path / "t"), "*.parquet", 100), q, spark, root, ttl_days=1 / 24, late="1 minute")
            got.append({r.session_id: r.state.turns for r in keyed.states(spark, root).collect()})
        assert spark.conf.get(keyed.PARTITIONS) == "40"
    finally:
        spark.conf.set(keyed.PARTITIONS, before)
    assert [x.get("a") for x in got] == [1, 2, 3, None] and set(got[-1]) == {"late3"}
    assert out.where("kind = 'expired'").groupBy("session_id").count().where("count > 1").count() == 0
    assert sum(p.name.isdigit() for p in (tmp_path / "root/checkpoint/state/0").iterdir()) == max(4 * spark.sparkContext.defaultParallelism, 32)


def test_requests_that_fail_are_answered_once(spark, tmp_path):
    root, echo = str(tmp_path / "root"), lambda x: x.withColumn("answer", F.when(F.col("message") != "die", policies.envelope(F.upper("message"), [], "ask")))
    got = []
    for lines in (['{"session_id": "s", "message": "hi"}', "", "{broken", "[1]"], ['{"message": "die"}', '{"session_id": "s"}']):
        spark.createDataFrame([(x,) for x in lines], "value string").write.mode("append").text(str(tmp_path / "in"))
        got = requests.run(requests.read(spark, str(tmp_path / "in")), echo, spark, root)
    rows = sorted(((r.session_id or "-", r.answer.response, r.answer.action) for r in got.collect()), key=repr)
    assert rows == sorted([("s", "HI", "ask"), ("-", requests.FAILED, "escalate"), ("-", requests.FAILED, "escalate"), ("default-session", requests.FAILED, "escalate"), ("s", "", "ask")], key=repr)
    again = requests.run(requests.read(spark, str(tmp_path / "in")), echo, spark, root)
    assert again.count() == 5 and sum("HI" in r.value for r in requests.response_lines(again).collect()) == 1
    text = {r.value for r in requests.event_text(again.where("message = 'hi'")).collect()}
    assert text == {"event: start\ndata: s\n\nevent: status\ndata: retrieving\n\nevent: status\ndata: answering\n\nevent: delta\ndata: HI\n\nevent: citations\ndata: []\n\nevent: done\ndata: ask\n\n"}


def test_every_chunking_shows_the_same_string(spark):
    full = '{"x": 1, "response" : "a \\"b\\" \\\\\\\\ \\n c\\t\\/é", "action": "ask"}'
    want = 'a "b" \\\\ \n c\t/é'
    rows = [(f"{i}-{j}", k, full[a:b]) for i in range(len(full) + 1) for j in range(i, len(full) + 1, 3) for k, (a, b) in enumerate([(0, i), (i, j), (j, len(full))])]
    rows += [("each", k, c) for k, c in enumerate(full)] + [("cut", 0, full[:20]), ("cut", 1, None), ("none", 0, None)]
    d = progressive.deltas(spark.createDataFrame(rows, "id string, seq int, chunk string"))
    got = {}
    for r in d.orderBy("id", "seq").collect():
        got.setdefault(r.id, []).append(r.delta)
    assert {i for i, x in got.items() if "".join(x) != want} == {"cut", "none"} and got["none"] == [""] and want.startswith("".join(got["cut"]))
    assert len(got["each"]) == len(full) and max(map(len, got["each"])) == 1


def test_sections_and_their_paths_equal_a_stack(spark, data):
    want = {}
    for r in registry._markdown(spark, data).collect():
        stack, n = [], 0
        for line in r.text.splitlines():
            if m := re.match(r"^(#{1,6})\s+(.*)$", line):
                n += 1
                stack = [x for x in stack if x[0] < len(m[1])] + [(len(m[1]), m[2].strip())]
                want[str(r.source_id), n] = " > ".join(x[1] for x in stack)
    got = {(r.source_id, r.section): r.path for r in registry.section_paths(spark, data).where("section > 0").collect()}
    assert got == want


def _extract(message, model, shown):
    """The extraction in plain Python; shown: (rank, source, locator, title, line, body)."""
    msg = message.lower().strip()
    words = dict.fromkeys(re.findall(r"\w+", msg))
    if not shown:
        return "ask", None
    score = lambda x: sum(2 for t in words if t in x[5].lower() and len(t) > 2) + (3 if model in (x[4] or "").lower() else 0)
    best = max(sorted(shown), key=score)
    body = best[5].strip()
    if "|" in body and "\n|" in body:
        for line in body.splitlines():
            low = line.lower()
            if line.startswith("|") and not line.startswith("|---") and "meaning" not in low and (any(s in low for s in grounding.STATES if s in msg) or sum(t in low for t in words if len(t) > 3) >= 2):
                cells = [c.strip() for c in line.split("|") if c.strip()]
                if len(cells) >= 3:
                    return ("escalate" if "escalate" in cells[2].lower() and not any(w in cells[2].lower() for w in ("check", "restart", "keep", "action")) else "instruct"), f"{cells[0]} indicates: {cells[1]}. Action: {cells[2]}."
                break
    paras = [p.strip() for p in body.split("\n\n") if p.strip() and not p.strip().startswith("#")]
    para = next((p for p in paras if any(t in p.lower() for t in words if len(t) > 3)), paras[0] if paras else body)
    return ("ask" if "?" in para else "instruct"), f"According to {best[3]} ({best[2]}): {para}"


def test_extraction_equals_plain_python(spark, data):
    table = "Lights\n\n| State | Meaning | Action |\n|---|---|---|\n| Solid amber | starting | Keep waiting |\n| Flashing red | broken | Escalate |"
    rows = [("a", 1, "s", "Lights", "Guide", "All", table), ("a", 2, "t", "Power", "Guide", "Pro", "# Power\n\nPlug it in.\n\nIs the outlet live? Check the cable."), ("b", 1, "t", "Power", "Guide", "Pro", "# Power\n\nPlug it in.\n\nCheck the cable first.")]
    said = [("a", "my node shows flashing red"), ("b", "the cable is loose"), ("c", "what?"), ("d", "thanks, it works"), ("e", "it failed, still not ok"), ("f", "blnk lights")]
    rows += [("f", 1, *rows[0][2:])]
    shown = spark.createDataFrame(rows, "id string, rank int, source_id string, locator string, title string, line string, body string")
    m = spark.createDataFrame([(i, t, 3, "pro") for i, t in said], "id string, message string, n_steps int, model string")
    got = {r.id: r.answer for r in grounding.extract_answers(m, shown, policies.escalation(F.lit(None).cast("string"))).collect()}
    assert {i: got[i].action for i in "abcdef"} == {"a": "escalate", "b": "instruct", "c": "ask", "d": "resolved", "e": "escalate", "f": "ask"}
    for i in "ab":
        assert (got[i].action, got[i].response) == _extract(dict(said)[i], "pro", [r[1:] for r in rows if r[0] == i])
    assert [(c.source_id, c.locator) for c in got["a"].citations] == [("s", "Lights"), ("t", "Power")]
    shown = {}
    for r in dialogue._shown(spark, data).collect():
        shown.setdefault(r.id, []).append(tuple(r)[1:])
    msg = dict(dialogue._sections(spark, data).where("pos > 0").groupBy("source_id").agg(F.min("locator")).collect())
    got = {r.id: (r.action, r.digest) for r in dialogue.grounded_extract(spark, data).collect()}
    for i, (action, digest) in got.items():
        a, text = _extract("please tell about " + msg[i], "pro", shown[i])
        assert (action, digest) == (a, sha256(text.encode()).hexdigest())


def test_names_of_any_length_and_place_are_found(spark):
    long = "Guide to " + "very " * 60 + "long names"
    some = spark.createDataFrame([(long, "Setup", "x", 1), ("Kit", "Setup", "y", 2)], "source_id string, locator string, body string, pos long")
    cited = spark.createDataFrame([(1, 1, "see " + "x" * 500 + " the KIT", "setup"), (2, 1, "the " + long.upper(), "setup"), (3, 1, "K", "setup")], "id long, pos long, source_id string, locator string")
    shown = spark.createDataFrame([], "id long, rank long, source_id string, locator string")
    assert sorted(map(tuple, grounding.repair_citations(cited, some, shown).collect())) == [(1, 1, "Kit", "Setup"), (2, 1, long, "Setup")]


def test_citations_of_an_empty_index_and_answer(spark):
    none = spark.createDataFrame([], "source_id string, locator string, body string, pos long")
    cited = spark.createDataFrame([(1, 1, "a", "b"), (2, 1, None, None)], "id long, pos long, source_id string, locator string")
    shown = spark.createDataFrame([(1, 1, "a", "b")], "id long, rank long, source_id string, locator string")
    assert grounding.repair_citations(cited, none, shown).count() == 0
    some = spark.createDataFrame([("Guide", "Setup", "x", 1), ("Guide", "Reset and recovery", "y", 2)], none.schema)
    cited = spark.createDataFrame([(1, 1, "the guide", "setup"), (1, 2, "Guide", "Reset"), (1, 3, "Guide", "Setup"), (2, 1, "Guide", "??"), (3, 1, "zzz", "Setup")], cited.schema)
    shown = spark.createDataFrame([(2, 1, "Guide", "Setup"), (3, 1, "Guide", "Reset and recovery")], shown.schema)
    got = sorted(map(tuple, grounding.repair_citations(cited, some, shown).collect()))
    assert got == [(1, 1, "Guide", "Setup"), (1, 2, "Guide", "Reset and recovery"), (2, 1, "Guide", "Setup"), (3, 1, "Guide", "Reset and recovery")]


@pytest.mark.parametrize(
    "raw, response",
    [('{"response": "a", "action": "ask", "citations": []}', "a"), ('```json\n{"response": "b"}\n```', "b"), ('say ```{"response": "c"}``` now', "c"), ('Well: {"response": "d", "citations": [{"source_id": "s", "locator": "l"}]} ok', "d"), ("no json", None), ("", None), ("[1]", None), (None, None)],
)
def test_lenient_parsing(spark, raw, response):
    e = spark.createDataFrame([(raw,)], "t string").select(grounding.parse_envelope(F.col("t")).alias("e")).first().e
    assert (e and e.response) == response


def test_progressive_reading(spark):
    full = '{"citations": [], "response" : "a \\"b\\" \\\\ \\n c\\u", "action": "ask"}'
    seen = spark.createDataFrame([(n, full[:n]) for n in range(len(full) + 1)], "n int, t string").select("n", grounding.streamed_response(F.col("t")).alias("r")).orderBy("n").collect()
    assert seen[-1].r == 'a "b" \\ \n cu' and all(b.r.startswith(a.r) for a, b in zip(seen, seen[1:], strict=False))


def test_contract(spark):
    none = []
    rows = [("a", none, "ask"), (" ", none, "ask"), ("a", none, "sing"), ("a", None, "ask"), ("a", [("s", None)], "ask"), ("a", [("s", "l")], "resolved")]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, e {policies.ENVELOPE}").unionByName(spark.createDataFrame([(9, None)], f"i int, e {policies.ENVELOPE}"))
    assert {r.i for r in d.where(grounding.contract(F.col("e"))).collect()} == {0, 5}


def test_fixtures_and_keys(spark):
    m = [{"role": "system", "content": 'é "q" \\ \n/'}, {"role": "user", "content": "日本"}]
    key = sha256(json.dumps(m, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    d = spark.createDataFrame([(m,)], "m array<struct<role:string,content:string>>")
    assert d.select(sessions.fixture_key(F.col("m")).alias("k")).first().k == key
    fx = spark.createDataFrame([(key, "x", ("hi", [], "ask"))], f"key string, model string, envelope {policies.ENVELOPE}")
    known, lost = spark.createDataFrame([(1, key)], "id long, key string"), spark.createDataFrame([(1, "nokey")], "id long, key string")
    assert sessions.answer("replay", known, fx)[0].first().envelope.response == "hi"
    with pytest.raises(Exception, match="nokey"):
        sessions.answer("replay", lost, fx)[0].collect()
    model = lambda p: p.withColumn("envelope", policies.envelope(F.concat(F.lit("to "), "key"), [], "ask"))
    answered, after = sessions.answer("record", known.unionByName(lost), fx, model)
    assert answered.count() == 2 and {r.key: r.envelope.response for r in after.collect()} == {key: "hi", "nokey": "to nokey"}
    assert sessions.answer("replay", lost, after)[0].first().envelope.response == "to nokey" and sessions.answer("mock", known, fx, model)[1] is fx
    with pytest.raises(ValueError, match="unknown mode"):
        sessions.answer("dream", known)
    assert sessions.record(fx, fx.unionByName(fx.withColumn("key", F.lit("new")))).count() == 2
    lines = spark.createDataFrame([("s", None)], f"session_id string, envelope {policies.ENVELOPE}")
    assert json.loads(sessions.response_lines(lines).first().value)["action"] == "escalate"


def test_index_marks_and_point_ids(spark, data):
    got = {r.doc_id: r.point_id for r in dialogue.point_ids(spark, data).collect()}
    assert got == {i: str(uuid.uuid5(uuid.NAMESPACE_DNS, f"doc-{i}")) for i in got}
    meta = index.meta_row(spark, index.fingerprint("small", 384), "v1", spark.createDataFrame([(0.0, 1.5)], "dense_floor double, sparse_floor double"))
    assert tuple(index.floors(meta, 0.62, 1.0).first()) == (0.62, 1.5)
    rows = spark.range(3)
    assert index.checked(rows, meta, "small:384").count() == 3 and index.checked(rows, meta.limit(0), "other:1").count() == 3
    with pytest.raises(Exception, match="small:384"):
        index.checked(rows, meta, "other:1").collect()
    d = spark.createDataFrame([("s", "s_1", None, "", None)], "source_id string, section_id string, product_line string, version string, effective_date string")
    assert index.payload(d).first().product_line == "All"


def test_ingestion_is_idempotent_and_keeps_all_on_empty_input(spark):
    row = "source_id string, section_id string, body string"
    a = spark.createDataFrame([("s", "1", "x"), ("s", "2", "y"), ("t", "1", "z")], row)
    b = spark.createDataFrame([("s", "2", "new text"), ("s", "3", "w"), ("s", "3", "w")], row)
    listed = spark.createDataFrame([("s",)], "source_id string")
    after, stats = index.ingest(a, b, listed)
    assert sorted(map(tuple, after.collect())) == [("s", "2", "y"), ("s", "3", "w")] and tuple(stats.first()) == (2, 1, 1, 1, 1)
    again, stats = index.ingest(after, b, listed)
    assert again.count() == 2 and tuple(stats.first()) == (2, 0, 2, 0, 0)
    same, stats = index.ingest(a, b.limit(0), listed)
    assert same.count() == 3 and tuple(stats.first()) == (0, 0, 0, 0, 0)


def test_hybrid_retrieval_abstains_and_follows_rights(spark):
    docs = spark.createDataFrame([(1, "Pro", False), (2, "Standard", False), (3, None, False), (4, "All", True)], "doc long, product_line string, is_archived boolean")
    q = spark.createDataFrame([(1, "Pro", False), (2, None, True), (3, "Standard", False)], "qid long, line string, archive boolean")
    dense = spark.createDataFrame([(i, d, 0.9 - d / 10 if i < 3 else 0.1) for i in (1, 2, 3) for d in (1, 2, 3, 4)], "qid long, doc long, score double")
    lexical = dense.withColumn("score", F.col("score") * 10)
    got = {}
    for r in retrieval.hybrid(dense, lexical, q, docs, 0.5, 5.0).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.doc)
    assert got == {1: [1, 3], 2: [1, 2, 3, 4]}
    rows = spark.createDataFrame([("my Pro",), ("R1 unit",), (None,)], "m string").select(retrieval.line_of(F.col("m")).alias("l"), retrieval.wants_archive(F.lit("the Archived one")).alias("a")).collect()
    assert [r.l for r in rows] == ["Pro", "Standard", None] and rows[0].a


def test_requests_and_lifecycle(spark):
    d = sessions.valid_requests(spark.createDataFrame([("s", "hi"), (" ", "hi"), (None, "hi"), ("x", ""), ("y", None)], "session_id string, message string")).collect()
    assert len(d) == 3 and sum(bool(re.fullmatch(r"web-[0-9a-f]{8}", r.session_id)) for r in d) == 2
    assert tuple(_envelope(spark, sessions.lifecycle(F.lit("resolved")))) == (True, False)
    old = spark.createDataFrame([("s", 1.0), ("t", 2.0)], "session_id string, created_at double")
    assert [r.session_id for r in sessions.newest_first(old).collect()] == ["t", "s"]
    assert sessions.clear(old).count() == 0 and sessions.clear(old, old.limit(1)).count() == 1


def test_a_stream_reads_a_table_that_is_a_folder_of_parts(spark, tmp_path):
    turns = spark.createDataFrame([(i % 3, i, "user", "x" * i) for i in range(9)], "conv_id long, turn long, role string, text string")
    turns.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {tuple(r) for r in dialogue.stream_session_fold(spark, str(tmp_path)).collect()}
    assert got == {(0, 3, 6, 9), (1, 3, 7, 12), (2, 3, 8, 15)}


def test_words_end_where_sql_lets_them_end(spark, tmp_path):
    from conftest import same
    from lodestead.plans import registry

    said = ["Yesó a", "ñno", "pro gatewayé", "étan r1", "a yes b", "yesterday", "go\x0bahead", "is smokeñ", "elñwarranty claim", "you are now", "éon fire"]
    rows = [(i, 0, "assistant", x) for i, x in enumerate(said)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for name, plans in (("slots", registry), ("guard_flags", registry), ("first_terms", dialogue), ("reset_check", dialogue)):
        assert same(spark, plans.QUERIES[name], plans.ORACLES[name], tmp_path)


def test_pages_are_parsed_once_for_all_that_read_their_sections(spark, data):
    plan = dialogue.citation_repair(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "html" not in plan and "regexp_replace" not in plan.split("locator")[-1]
    assert dialogue._sections(spark, data).inputFiles() == dialogue._sections(spark, data).inputFiles()
