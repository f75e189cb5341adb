"""Operator 1, chat formatting: conversations become windows of at most `budget` tokens, with a loss mask.

Prefix sums of the turns' tokens choose the spans: a span holds the turns that begin and end between the same two
multiples of the room for new turns (budget - history - system turn), or a single turn that crosses a multiple. So
windows are aligned with turns, none is cut, and only a turn larger than the room makes a window larger than the
budget. Each window begins with the conversation's first system turn and repeats at most `history` tokens of whole
turns before the span; the mask covers the assistant texts of the span, never a repeated one.

A turn is written `### role`, its text and `</turn>` on lines of their own. Inside texts and roles, backslashes, the
two markers and, in roles, line ends are escaped by a backslash and a letter, so a window can be read back exactly.

Only DataFrame functions. Prefix sums are taken in blocks of BLOCK turn numbers and then over the blocks, so a
conversation with very many turns isn't sorted in one task; windows are bounded by the budget.

Results on odd input: null texts and roles are empty ones; turns with equal numbers are ordered by role, then text,
null numbers come first; repeated rows are repeated turns; rows with a null conv_id are one conversation with that id;
other columns of any name are ignored; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestead.llm.common import materialize, table, words

BUDGET, HISTORY, OVERHEAD, BLOCK = 512, 128, 2, 1024
_MARKS = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
_END = "\n</turn>\n"


def _swap(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _swap(c, _MARKS)


def unescape(c: Column) -> Column:
    return _swap(c, [(b, a) for a, b in reversed(_MARKS)])


def _ordered(conv: DataFrame) -> DataFrame:
    """Turns with their place in the conversation and the prefix sums of tokens before and after them."""
    d = conv.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("k"), F.col("conv_id").isNull().alias("nil"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    d = d.withColumn("tokens", (F.size(words("text")) + OVERHEAD).cast("long")).withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    keys = ["k", "nil"]
    own = Window.partitionBy(*keys, "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    d = d.withColumn("i", F.row_number().over(own).cast("long"))
    d = d.withColumn("sum", F.sum("tokens").over(Window.partitionBy(*keys, "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    blocks = d.groupBy(*keys, "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("c"), F.min(F.when(F.col("role") == "system", F.struct("i", "tokens"))).alias("s"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    system = F.min(F.when(F.col("s").isNotNull(), F.struct("block", "s.i", "s.tokens"))).over(Window.partitionBy(*keys))
    blocks = blocks.select(*keys, "block", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(y) for x, y in (("n", "n0"), ("c", "c0"))], system.alias("s"))
    d = d.join(blocks, [*keys, "block"])
    first = F.coalesce((F.col("block") == F.col("s.block")) & (F.col("i") == F.col("s.i")), F.lit(False))
    # the system turn isn't counted in the sums of the turns behind it
    behind = F.coalesce((F.col("block") > F.col("s.block")) | ((F.col("block") == F.col("s.block")) & (F.col("i") > F.col("s.i"))), F.lit(False))
    d = d.withColumn("is_system", first).withColumn("room_taken", F.coalesce(F.col("s.tokens"), F.lit(0)))
    d = d.withColumn("end", F.col("c0") + F.col("sum") - F.when(first | behind, F.col("room_taken")).otherwise(0))
    start = F.col("end") - F.when(first, F.lit(0)).otherwise(F.col("tokens"))
    return d.select(*keys, (F.col("n0") + F.col("i")).alias("ord"), "role", "text", "is_system", "room_taken", start.alias("start"), "end")


def windows(conv: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, first_turn (place of its first new turn), text, turns (place and kind of each turn in
    the text; kinds: system or history, repeated, and new) and mask (first character, characters of each target)."""
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.col("room_taken"))
    d = materialize(_ordered(conv), "turns").withColumns({"s0": F.floor(F.col("start") / room), "s1": F.floor(F.greatest(F.col("end") - 1, F.col("start")) / room)})
    # windows are made of turns' numbers; their texts join at the end
    keys = ["k", "nil"]
    at = d.select(*keys, "ord", "is_system", "start", "end", "s0", "s1")
    span = at.groupBy(*keys, "s0", "s1").agg(F.min("start").alias("from"), F.min("ord").alias("head"), F.max("is_system").alias("own"))
    new = at.select(*keys, "s0", "s1", (~F.col("is_system")).cast("int").alias("late"), "ord", F.lit("new").alias("kind"))
    sys = at.where("is_system").select(*keys, "ord").join(span.where("NOT own").select(*keys, "s0", "s1"), keys)
    sys = sys.select(*keys, "s0", "s1", F.lit(0).alias("late"), "ord", F.lit("system").alias("kind"))
    at = at.where("NOT is_system").select(*keys, "ord", "start", "end", F.explode(F.array(F.floor(F.col("start") / history), F.floor(F.col("start") / history) + 1)).alias("h"))
    old = at.join(span.withColumn("h", F.floor(F.col("from") / history)), [*keys, "h"]).where((F.col("start") >= F.col("from") - history) & (F.col("end") <= F.col("from")) & (F.col("ord") < F.col("head")))
    old = old.select(*keys, "s0", "s1", F.lit(1).alias("late"), "ord", F.lit("history").alias("kind"))
    turn = F.concat(F.lit("### "), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"), escape(F.col("text")), F.lit(_END))
    piece = d.select(*keys, "ord", turn.alias("piece"), F.length(escape(F.col("text"))).alias("body"), (F.col("role") == "assistant").alias("target"))
    rows = new.unionByName(sys).unionByName(old).join(piece, [*keys, "ord"]).withColumn("target", F.col("target") & (F.col("kind") == "new"))
    rows = rows.groupBy(*keys, "s0", "s1").agg(F.sort_array(F.collect_list(F.struct("late", "ord", "kind", "piece", "body", "target"))).alias("t"))
    rows = rows.withColumn("size", F.transform("t", lambda x: F.length(x["piece"])))
    ends = F.transform("t", lambda x, i: F.struct((F.aggregate(F.slice("size", 1, i + 1), F.lit(0), lambda a, y: a + y) - len(_END) - x["body"]).alias("from"), x["body"].alias("chars"), x["ord"].alias("ord"), x["target"].alias("target")))
    mask = F.transform(F.filter(ends, lambda x: x["target"]), lambda x: F.struct(x["from"].alias("from"), x["chars"].alias("chars"), x["ord"].alias("ord")))
    return rows.select(
        F.when(~F.col("nil"), F.col("k")).alias("conv_id"), F.array_min(F.transform(F.filter("t", lambda x: x["kind"] == "new"), lambda x: x["ord"])).alias("first_turn"),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("text"), F.transform("t", lambda x: F.struct(x["ord"].alias("ord"), x["kind"].alias("kind"))).alias("turns"), mask.alias("mask"),
    )


def read_turns(win: DataFrame) -> DataFrame:
    """The conversations' turns, read back from the windows' texts: conv_id, ord, role, text."""
    d = win.select("conv_id", F.explode(F.arrays_zip("turns", F.slice(F.split("text", _END), F.lit(1), F.size("turns")).alias("piece"))).alias("x")).where("x.turns.kind = 'new'")
    head = F.substring_index("x.piece", "\n", 1)
    role = unescape(F.replace(F.expr("substring(substring_index(x.piece, '\n', 1), 5)"), F.lit("\\n"), F.lit("\n")))
    return d.select("conv_id", F.col("x.turns.ord").alias("ord"), role.alias("role"), unescape(F.col("x.piece").substr(F.length(head) + 2, F.length("x.piece"))).alias("text"))


def read_targets(win: DataFrame) -> DataFrame:
    """The texts under the mask, unescaped: conv_id, ord, text."""
    d = win.select("conv_id", "text", F.explode("mask").alias("m"))
    return d.select("conv_id", F.col("m.ord").alias("ord"), unescape(F.col("text").substr(F.col("m.from") + 1, F.col("m.chars"))).alias("text"))


def digests(win: DataFrame) -> DataFrame:
    """What the windows hold, read back, as one row per conversation; a digest needs its conversation's text in one row."""
    turn = F.struct("ord", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("s"))
    none = F.lit(None).cast("struct<ord: bigint, s: string>")
    rows = read_turns(win).select("conv_id", turn.alias("turn"), none.alias("loss"), F.lit(0).alias("chars"))
    rows = rows.unionByName(read_targets(win).select("conv_id", none.alias("turn"), F.struct("ord", F.col("text").alias("s")).alias("loss"), F.lit(0).alias("chars")))
    rows = rows.unionByName(win.select("conv_id", none.alias("turn"), none.alias("loss"), F.length("text").alias("chars")))
    both = [F.sort_array(F.collect_list(x)).alias(x) for x in ("turn", "loss")]
    d = rows.groupBy("conv_id").agg(*both, F.count("turn").alias("n_turns"), F.sum(F.length("loss.s")).alias("lost"), F.sum("chars").alias("formatted_chars"), F.count_if(F.col("turn").isNull() & F.col("loss").isNull()).alias("n_windows"))
    digest = lambda x: F.sha2(F.array_join(F.transform(x, lambda y: y["s"]), "").cast("binary"), 256)
    return d.select("conv_id", "n_turns", digest("turn").alias("turns_sha256"), F.coalesce("lost", F.lit(0)).cast("long").alias("loss_chars"), digest("loss").alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"), "n_windows")


TRICKY = "\\### Assistant: </turn> ok"


def op1_chat_format(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return digests(materialize(windows(rows.unionByName(extra)), "windows"))


_ESC = "replace(replace(replace({}, '\\', '\\b'), '###', '\\h'), '</turn>', '\\t')"
_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{TRICKY}' FROM range(2) t(i)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS ord,
        len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) + {OVERHEAD} AS tokens,
        4 + length({_ESC.format('role')}) + 1 + length({_ESC.format('text')}) + {len(_END)} AS size FROM c),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY ord) = 1 AND role = 'system' AS is_system FROM o),
p AS (SELECT *, sum(CASE WHEN is_system THEN 0 ELSE tokens END) OVER w AS e, greatest(1, {BUDGET - HISTORY} - coalesce(max(CASE WHEN is_system THEN tokens END) OVER (PARTITION BY conv_id), 0)) AS room
      FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY ord)),
q AS (SELECT *, e - CASE WHEN is_system THEN 0 ELSE tokens END AS b FROM p),
r AS (SELECT *, floor(b / room) AS s0, floor(greatest(e - 1, b) / room) AS s1 FROM q),
span AS (SELECT conv_id, s0, s1, min(b) AS f, min(ord) AS head, bool_or(is_system) AS own, sum(size) AS size FROM r GROUP BY ALL),
old AS (SELECT span.conv_id, sum(r.size) AS size FROM span JOIN r ON r.conv_id = span.conv_id AND NOT r.is_system AND r.b >= f - {HISTORY} AND r.e <= f AND r.ord < head GROUP BY ALL),
sys AS (SELECT span.conv_id, sum(r.size) AS size FROM span JOIN r ON r.conv_id = span.conv_id AND r.is_system AND NOT span.own GROUP BY ALL),
total AS (SELECT conv_id, sum(size) AS size, count(*) AS n FROM span GROUP BY ALL),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY ord) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256 FROM o GROUP BY conv_id)
SELECT d.*, (total.size + coalesce(old.size, 0) + coalesce(sys.size, 0))::BIGINT AS formatted_chars, total.n AS n_windows
FROM d JOIN total USING (conv_id) LEFT JOIN old USING (conv_id) LEFT JOIN sys USING (conv_id)"""
QUERIES = {"op1_chat_format": op1_chat_format}
ORACLES = {"op1_chat_format": _SQL}
