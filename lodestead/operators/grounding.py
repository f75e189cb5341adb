"""Grounding of answers: section lookup, citation repair, extraction from retrieved sections, lenient envelope parsing.

Sections are rows (source_id, pos, locator, body); retrieved sections rows (id, rank, source_id, locator, title, line, body)
of an answer's id. All answers are worked on at once; matches by containment are joins on the parts of the shorter names,
never pairs of everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestead.functions.policies import ENVELOPE
from lodestead.functions.progressive import unescape
from lodestead.functions.text import TOKEN, strip

_CITES = "array<struct<source_id:string,locator:string>>"


def first_of(rows: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def section_map(sections: DataFrame) -> DataFrame:
    """One row per (source_id, locator): of repeated headings the last, with the place of the first."""
    return sections.groupBy("source_id", "locator").agg(F.max_by("body", "pos").alias("body"), F.min("pos").alias("pos"))


def citation_index(sections: DataFrame) -> DataFrame:
    """source_id and its distinct headings."""
    return sections.groupBy("source_id").agg(F.array_sort(F.collect_set("locator")).alias("locators"))


def lookup(wanted: DataFrame, sections: DataFrame) -> DataFrame:
    """wanted (id, source_id, locator) with found and body: the section of that heading, else the first in document order
    whose heading contains it or is contained in it, in any case; both null where there is none."""
    s = section_map(sections).select("source_id", F.col("locator").alias("found"), "body", "pos")
    low, own = F.lower("locator"), F.lower("found")
    d = wanted.select("id", "source_id", "locator").distinct().join(s, "source_id").withColumn("exact", F.col("found") == F.col("locator"))
    d = d.where(F.col("exact") | own.contains(low) | low.contains(own))
    best = first_of(d, ["id", "source_id", "locator"], F.desc("exact"), "pos").select("id", "source_id", "locator", "found", "body")
    return wanted.join(best, ["id", "source_id", "locator"], "left")


def _known_source(cited: DataFrame, sources: DataFrame) -> DataFrame:
    """cited with known: its source, else the smallest source whose name is it in another case or stands within it."""
    known = sources.select(F.col("source_id").alias("known")).distinct()
    d = cited.join(known, cited["source_id"] == known["known"], "left")
    rest = d.where("known IS NULL").select(F.lower("source_id").alias("low")).distinct().where(F.length("low") > 0)
    # parts of the lengths that names have, and no others; what reaches the driver are these lengths
    sizes = sorted(r[0] for r in known.select(F.length("known").alias("n")).where("n > 0").distinct().collect())
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length("low") - (n - 1)), lambda i: F.substr("low", i, F.lit(n)))
    none = F.array().cast("array<string>")
    parts = [F.when(F.length("low") >= n, cut(n)).otherwise(none) for n in sizes] or [none]
    near = rest.select("low", F.explode(F.array_distinct(F.concat(*parts))).alias("part")).join(known.select(F.col("known").alias("near"), F.lower("known").alias("part")), "part")
    near = near.groupBy("low").agg(F.min("near").alias("near"))
    return d.withColumn("low", F.lower("source_id")).join(near, "low", "left").withColumn("known", F.coalesce("known", "near")).drop("low", "near")


def repair_citations(cited: DataFrame, sections: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Valid citations (id, pos, source_id, locator) of each answer, in order and without repeats.

    cited: id, pos, source_id, locator. An unknown source is matched by name or dropped. A heading is taken as it is, else
    in another case, else the one closest in length of those that contain it or are contained in it, else that of the
    first retrieved section of the source. An answer left without any cites its first retrieved section.
    """
    heads = sections.select("source_id", "locator").distinct()
    d = cited.select("id", "pos", strip(F.coalesce("source_id", F.lit(""))).alias("source_id"), strip(F.coalesce("locator", F.lit(""))).alias("locator")).where("source_id <> ''")
    d = _known_source(d, heads).where("known IS NOT NULL").select("id", "pos", F.col("known").alias("source_id"), "locator")
    low, own = F.lower("locator"), F.lower("head")
    tier = F.when(F.col("head") == F.col("locator"), 0).when(own == low, 1).when(own.contains(low) | low.contains(own), 2)
    met = d.join(heads.select("source_id", F.col("locator").alias("head")), "source_id").withColumn("tier", tier).where("tier IS NOT NULL")
    gap = F.when(F.col("tier") == 2, F.abs(F.length("head") - F.length("locator"))).otherwise(0)
    met = first_of(met, ["id", "pos"], "tier", gap, "head").select("id", "pos", "head")
    valid = retrieved.join(heads, ["source_id", "locator"], "left_semi").select("id", "rank", "source_id", "locator")
    own_first = first_of(retrieved.select("id", "rank", "source_id", "locator"), ["id", "source_id"], "rank").join(heads, ["source_id", "locator"], "left_semi").select("id", "source_id", F.col("locator").alias("other"))
    d = d.join(met, ["id", "pos"], "left").join(own_first, ["id", "source_id"], "left").withColumn("locator", F.coalesce("head", "other")).where("locator IS NOT NULL")
    d = d.groupBy("id", "source_id", "locator").agg(F.min("pos").alias("pos"))
    top = first_of(retrieved.select("id", "rank", "source_id", "locator"), ["id"], "rank").join(valid, ["id", "rank", "source_id", "locator"], "left_semi")
    bare = top.join(d.select("id").distinct(), "id", "left_anti").select("id", "source_id", "locator", F.lit(0).cast("long").alias("pos"))
    d = d.select("id", "source_id", "locator", F.col("pos").cast("long").alias("pos")).unionByName(bare)
    return d.select("id", F.row_number().over(Window.partitionBy("id").orderBy("pos")).cast("long").alias("pos"), "source_id", "locator")


# What a message says of the conversation's state, and rows of status tables.
RESOLVED = ("fixed", "worked", "it works", "all good", "thank you", "thanks", "resolved", "up and running", "all resolved")
NOT_RESOLVED = ("not", "didn't", "won't", "doesn't")
EXHAUSTED = ("still not", "not working", "failed", "didn't work", "persists")
UNCLEAR = ("yellow", "blnk", "wifey", "worky", "nod1")
STATES = ("solid amber", "flashing amber", "solid red", "flashing red", "pulsing blue", "solid white", "pulsing white", "pulsing red", "solid purple", "e11", "e17", "e24", "e31", "e42")


def holds(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def overlap(tokens: Column, text: Column, longer_than: int) -> Column:
    """How many of the tokens of more than so many characters the text contains."""
    return F.size(F.filter(tokens, lambda t: (F.length(t) > longer_than) & text.contains(t)))


def table_row(message: Column, tokens: Column, text: Column) -> Column:
    """The cells of the first row of a Markdown table that the message names by a state or by two of its words; null if there is none."""
    body = F.filter(F.split(text, r"\R"), lambda x: x.startswith("|") & ~x.startswith("|---") & ~F.lower(x).contains("meaning"))
    state = lambda x: F.exists(F.filter(F.array(*map(F.lit, STATES)), lambda s: message.contains(s)), lambda s: F.lower(x).contains(s))
    row = F.get(F.filter(body, lambda x: state(x) | (overlap(tokens, F.lower(x), 3) >= 2)), F.lit(0))
    cells = F.filter(F.transform(F.split(row, r"\|"), strip), lambda c: c != "")
    return F.when(text.contains("|") & text.contains("\n|") & (F.size(cells) >= 3), cells)


def row_action(cell: Column) -> Column:
    low = F.lower(cell)
    return F.when(low.contains("restart once; escalate"), "instruct").when(low.contains("escalate") & ~holds(low, ("check", "restart", "keep", "action")), "escalate").otherwise("instruct")


def paragraph(tokens: Column, text: Column) -> Column:
    """The first paragraph, headings aside, that contains a token of more than three characters, else the first one, else all."""
    paras = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: (p != "") & ~p.startswith("#"))
    named = F.filter(paras, lambda p: F.exists(tokens, lambda t: (F.length(t) > 3) & F.lower(p).contains(t)))
    return F.coalesce(F.get(named, F.lit(0)), F.get(paras, F.lit(0)), text)


def extract_answers(messages: DataFrame, retrieved: DataFrame, escalation: Column) -> DataFrame:
    """One row (id, answer envelope) per message (id, message, n_steps, model), answered from its retrieved sections alone.

    In order: thanks resolve; exhausted steps escalate; without sections it asks; unclear words ask; else a row of a status
    table or a paragraph of the section that shares most with the message, which is cited first.
    """
    msg = strip(F.lower(F.coalesce("message", F.lit(""))))
    m = messages.select("id", msg.alias("msg"), F.array_distinct(F.regexp_extract_all(msg, F.lit(TOKEN), F.lit(0))).alias("tokens"), "n_steps", F.lower("model").alias("model"))
    r = m.join(retrieved, "id")
    score = 2 * overlap(F.col("tokens"), F.lower("body"), 2) + F.when(F.lower(F.coalesce("line", F.lit(""))).contains(F.col("model")), 3).otherwise(0)
    best = r.groupBy("id").agg(F.min(F.struct((-score).alias("s"), F.col("rank"))).alias("b"))
    r = retrieved.join(best, "id").withColumn("order", F.when(F.col("rank") == F.col("b.rank"), 0).otherwise(F.col("rank") + 1))
    gathered = r.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("order", strip("source_id").alias("source_id"), strip("locator").alias("locator")))), lambda x: F.struct(x["source_id"].alias("source_id"), x["locator"].alias("locator"))).alias("cites"),
        *[F.max(F.when(F.col("order") == 0, F.col(c))).alias(c) for c in ("title", "locator", "body")],
    )
    d = m.join(gathered, "id", "left").withColumn("cites", F.array_distinct(F.coalesce("cites", F.array().cast(_CITES)))).withColumn("text", strip("body"))
    d = d.withColumn("cells", table_row(F.col("msg"), F.col("tokens"), F.col("text"))).withColumn("para", paragraph(F.col("tokens"), F.col("text")))
    make = lambda text, cites, action: F.struct(text.alias("response"), cites.alias("citations"), action.alias("action"))
    none, c, say = F.array().cast(_CITES), F.col("cells"), F.lit
    row = make(F.concat(c[0], say(" indicates: "), c[1], say(". Action: "), c[2], say(".")), F.col("cites"), row_action(c[2]))
    prose = make(F.concat(say("According to "), F.col("title"), say(" ("), F.col("locator"), say("): "), F.col("para")), F.col("cites"), F.when(F.col("para").contains("?"), "ask").otherwise("instruct"))
    answer = (
        F.when(holds(F.col("msg"), RESOLVED) & ~holds(F.col("msg"), NOT_RESOLVED), make(say("I am glad to hear your system is working properly now!"), none, say("resolved")))
        .when((F.col("n_steps") >= 3) & holds(F.col("msg"), EXHAUSTED), escalation)
        .when(F.col("body").isNull(), make(say("I could not find documentation for that request. Which device are you using, and what are you observing?"), none, say("ask")))
        .when(holds(F.col("msg"), UNCLEAR), make(say("Could you please clarify your device model and the exact light behavior you are observing?"), F.col("cites"), say("ask")))
        .when(c.isNotNull(), row)
        .otherwise(prose)
    )
    return d.select("id", answer.alias("answer"))


def parse_envelope(raw: Column) -> Column:
    """An envelope from a model's text: fences go, then the whole, else the first to the last brace, is read as JSON; null if neither is an object."""
    text = strip(raw)
    fenced = F.regexp_extract(text, r"(?s)```json(.*?)(?:```|\z)", 1)
    plain = F.regexp_extract(text, r"(?s)```(.*?)(?:```|\z)", 1)
    text = strip(F.when(text.contains("```json"), fenced).when(text.contains("```"), plain).otherwise(text))
    read = lambda t: F.when(strip(t).startswith("{"), F.from_json(t, ENVELOPE))
    whole, inner = read(text), read(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    valid = lambda x: F.when(x.isNotNull() & (x["response"].isNotNull() | x["citations"].isNotNull() | x["action"].isNotNull()), x)
    return F.coalesce(valid(whole), valid(inner))


def contract(answer: Column) -> Column:
    """Whether an envelope keeps the contract: a response, a known action, citations with a source and a locator each."""
    cites = answer["citations"]
    whole = F.forall(cites, lambda c: c["source_id"].isNotNull() & c["locator"].isNotNull())
    return F.coalesce(answer.isNotNull() & (F.length(strip(answer["response"])) > 0) & answer["action"].isin("ask", "instruct", "resolved", "escalate") & cites.isNotNull() & whole, F.lit(False))


def streamed_response(text: Column) -> Column:
    """What a progressive reader has shown of a JSON text's response string so far: up to its closing quote or the text's end."""
    body = F.regexp_extract(text, r'(?s)"response"\s*:\s*"((?:[^"\\]|\\.)*)', 1)
    return unescape(body)
