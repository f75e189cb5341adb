"""Operator 4, URL filters: a temporal list join.

A list is a table of dated events (pattern, action, at): a pattern is added or removed on a day. Events become validity
intervals, from each addition to the pattern's next event, and a capture is judged by the entries that are valid on the
day of its fetch. Patterns are host suffixes (`example.net`, `m.shop.example.net`) or a host with a first path segment
(`shop.example.net/de`); of several valid ones the most specific is reported.

Only DataFrame functions. Each capture has a fixed number of keys, one for each kind and depth of pattern in the list,
and each is one left join with the intervals, so captures are neither multiplied nor regrouped. The intervals are
broadcast if there are at most BROADCAST_ROWS of them; a larger list is joined by shuffles, whose hot hosts Spark splits.

Results on odd input: a null or hostless URL and a null fetch day match nothing; list events with a null pattern or day
are ignored, other actions than `add` end an interval; of an addition and a removal on one day the removal wins;
repeated events and captures are harmless; other columns of captures pass through, but those named host, blocked,
pattern or since are replaced by the results; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestead.llm.common import table

BROADCAST_ROWS = 200_000


def host_of(url: Column) -> Column:
    """The host of a URL, lower case, without user, port and a final dot; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(found), r"\.+$", "")


def segment_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)


def intervals(events: DataFrame) -> DataFrame:
    """pattern, since, until (null: still valid), one row per addition that lasts."""
    e = events.where("pattern IS NOT NULL AND at IS NOT NULL").select(F.lower("pattern").alias("pattern"), F.when(F.col("action") == "add", 0).otherwise(1).alias("off"), F.col("at").cast("date").alias("since")).distinct()
    e = e.withColumn("until", F.lead("since").over(Window.partitionBy("pattern").orderBy("since", "off")))
    return e.where("off = 0 AND (until IS NULL OR until > since)").select("pattern", "since", "until")


def judge(captures: DataFrame, events: DataFrame, url: str = "url", at: str = "fetched_on") -> DataFrame:
    """captures with host, blocked, pattern (of the most specific entry valid at the fetch) and since."""
    valid = intervals(events)
    shape = valid.agg(F.count("*"), F.max(F.when(~F.col("pattern").contains("/"), F.size(F.split("pattern", r"\.")))), F.max(F.col("pattern").contains("/"))).first()
    if shape[0] <= BROADCAST_ROWS:
        valid = F.broadcast(valid)
    d = captures.select(F.struct("*").alias("row"), F.col(url).alias("u"), F.col(at).cast("date").alias("day"))
    d = d.withColumn("host", host_of(F.col("u")))
    keys = [F.concat("host", F.lit("/"), F.lower(segment_of(F.col("u"))))] if shape[2] else []
    labels = F.size(F.split("host", r"\."))
    keys += [F.when(labels >= n, F.substring_index("host", ".", -n)) for n in range(shape[1] or 0, 0, -1)]
    d = d.withColumns({f"k{i}": k for i, k in enumerate(keys)})
    for i in range(len(keys)):
        own = valid.select(F.col("pattern").alias(f"p{i}"), F.col("since").alias(f"s{i}"), F.col("until").alias(f"e{i}"))
        d = d.join(own, (F.col(f"k{i}") == F.col(f"p{i}")) & (F.col("day") >= F.col(f"s{i}")) & (F.col(f"e{i}").isNull() | (F.col("day") < F.col(f"e{i}"))), "left")
    pattern = F.coalesce(*[F.col(f"p{i}") for i in range(len(keys))], F.lit(None).cast("string"))
    since = F.coalesce(*[F.col(f"s{i}") for i in range(len(keys))], F.lit(None).cast("date"))
    new = {"host": F.col("host"), "blocked": pattern.isNotNull(), "pattern": pattern, "since": since}
    return d.select(*[F.col("row")[c].alias(c) for c in captures.columns if c not in new], *[x.alias(c) for c, x in new.items()])


def listed(pages: DataFrame) -> DataFrame:
    """A dated list for the query, since the tables hold none: from each host's MD5, days on which it comes and goes."""
    h = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct().withColumn("c", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int"))
    rows = F.array(
        F.when(F.col("c") % 3 == 0, F.struct(F.col("host").alias("pattern"), F.lit("add").alias("action"), (F.col("c") % 180).alias("n"))),
        F.when(F.col("c") % 6 == 0, F.struct(F.col("host").alias("pattern"), F.lit("remove").alias("action"), (F.col("c") % 180 + 60).alias("n"))),
        F.when(F.col("c") % 12 == 0, F.struct(F.col("host").alias("pattern"), F.lit("add").alias("action"), (F.col("c") % 180 + 120).alias("n"))),
        F.when(F.col("c") % 4 == 1, F.struct(F.concat("host", F.lit("/de")).alias("pattern"), F.lit("add").alias("action"), F.lit(90).alias("n"))),
    )
    own = h.select(F.inline(F.array_compact(rows)))
    fixed = pages.sparkSession.sql("SELECT * FROM VALUES ('example.org', 'add', 150), ('example.org', 'remove', 200) t(pattern, action, n)")
    return own.unionByName(fixed).select("pattern", "action", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")).alias("at"))


def op4_url_filters(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int")))
    return judge(captures, listed(pages)).select("page_id", "host", "fetched_on", "blocked", "pattern", "since")


_HOST = r"regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1)), '\.+$', '')"
_SQL = rf"""
WITH cap AS (SELECT page_id, {_HOST} AS host, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1)) AS seg,
               DATE '2024-01-01' + (page_id % 365)::INT AS fetched_on FROM pages),
h AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 4))::INT AS c FROM cap WHERE host <> ''),
ev AS (
  SELECT host AS pattern, 0 AS gone, c % 180 AS n FROM h WHERE c % 3 = 0 UNION SELECT host, 1, c % 180 + 60 FROM h WHERE c % 6 = 0
  UNION SELECT host, 0, c % 180 + 120 FROM h WHERE c % 12 = 0 UNION SELECT host || '/de', 0, 90 FROM h WHERE c % 4 = 1
  UNION SELECT 'example.org', 0, 150 UNION SELECT 'example.org', 1, 200),
iv AS (SELECT pattern, gone, DATE '2024-01-01' + n::INT AS since, lead(DATE '2024-01-01' + n::INT) OVER (PARTITION BY pattern ORDER BY n, gone) AS until FROM ev),
hit AS (
  SELECT page_id, pattern, since, row_number() OVER (PARTITION BY page_id ORDER BY contains(pattern, '/') DESC, length(pattern) DESC) AS k
  FROM cap JOIN iv ON gone = 0 AND fetched_on >= since AND (until IS NULL OR fetched_on < until)
    AND (pattern = host || '/' || seg OR pattern = host OR ends_with(host, '.' || pattern)))
SELECT cap.page_id, host, fetched_on, hit.pattern IS NOT NULL AS blocked, hit.pattern, hit.since FROM cap LEFT JOIN hit ON hit.page_id = cap.page_id AND k = 1"""
QUERIES = {"op4_url_filters": op4_url_filters}
ORACLES = {"op4_url_filters": _SQL}
