"""Progressive reading of a streamed JSON text: what each chunk adds to its response string, whatever chunks cut in two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.functions.text import let

STATE = "struct<inside:boolean,done:boolean,rest:string,shown:array<string>>"
OPENING = r'(?s)^.*?"response"\s*:\s*"'
_BODY = r'(?s)^((?:[^"\\]|\\.)*+)'


def unescape(body: Column) -> Column:
    """The characters that a string's escapes stand for: line end, return and tab, or the character itself."""
    body = F.replace(body, F.lit("\\\\"), F.lit("\u0000"))
    for a, b in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r")):
        body = F.replace(body, F.lit(a), F.lit(b))
    return F.replace(F.regexp_replace(body, r"(?s)\\(.)", "$1"), F.lit("\u0000"), F.lit("\\"))


def start() -> Column:
    return F.from_json(F.lit('{"inside": false, "done": false, "rest": "", "shown": []}'), STATE)


def feed(state: Column, chunk: Column) -> Column:
    """The state after a chunk: what isn't read yet (text before the string, or a backslash whose second half is to come) is its
    rest, and what the chunk added to the string is put behind what is shown."""

    def read(text, inside, cut):
        def after(body):
            left = F.substr(cut, F.length(body) + 1)
            ended = left.startswith('"')
            return F.struct(F.lit(True).alias("inside"), ended.alias("done"), F.when(ended, "").otherwise(left).alias("rest"), F.concat(state["shown"], F.array(unescape(body))).alias("shown")).cast(STATE)

        waits = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("done"), text.alias("rest"), F.concat(state["shown"], F.array(F.lit(""))).alias("shown")).cast(STATE)
        return F.when(inside, let(F.regexp_extract(cut, _BODY, 1), after)).otherwise(waits)

    def begun(text):
        opened = text.rlike(OPENING)
        cut = F.when(state["inside"], text).when(opened, F.regexp_replace(text, OPENING, "")).otherwise("")
        return let(cut, lambda c: read(text, state["inside"] | opened, c))

    over = F.struct(F.lit(True).alias("inside"), F.lit(True).alias("done"), F.lit("").alias("rest"), F.concat(state["shown"], F.array(F.lit(""))).alias("shown")).cast(STATE)
    return F.when(state["done"], over).otherwise(let(F.concat(state["rest"], F.coalesce(chunk, F.lit(""))), begun))


def deltas(chunks: DataFrame) -> DataFrame:
    """id, seq, delta: what each chunk (id, seq, chunk) shows of its stream's response string. A stream's chunks are folded in
    one row, which holds one response."""
    d = chunks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk"))).alias("all"))
    d = d.select("id", "all", F.aggregate("all", start(), lambda s, x: feed(s, x["chunk"]))["shown"].alias("shown"))
    return d.select("id", F.inline(F.transform("all", lambda x, i: F.struct(x["seq"].alias("seq"), F.get("shown", i).alias("delta")))))
