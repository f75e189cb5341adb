"""Sections of documents and the index's upkeep: heading paths, new / existing / stale / orphan rows, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestead.functions.text import section_hash, section_id, strip


def sections(docs: DataFrame, key: str = "source_id", text: str = "text", title: str = "Introduction") -> DataFrame:
    """One row per heading-delimited section with a body: key, section, locator, level, header_path, body, sha256, section_id.

    Headings are `#` to `######` lines; a section's text begins with its heading line, and what stands before the first
    heading is a section titled `title`. Lines are gathered per document and section.
    """
    heading = r"^(#{1,6})\s+(.*)$"
    d = docs.select(F.col(key).alias("source_id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\R")).alias("pos", "line"))
    d = d.withColumn("level", F.length(F.regexp_extract("line", heading, 1))).withColumn("name", strip(F.regexp_extract("line", heading, 2)))
    order = Window.partitionBy("source_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(order))
    body = d.groupBy("source_id", "section").agg(
        F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"), F.max(F.when(F.col("level") > 0, F.col("level"))).alias("level"), F.max(F.when(F.col("level") > 0, F.col("name"))).alias("name")
    )
    body = body.select("source_id", "section", F.coalesce("name", F.lit(title)).alias("locator"), F.coalesce("level", F.lit(0)).alias("level"), strip(F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("body"))
    # of each level the last heading so far; it is on the path unless one of a higher level came after it
    so_far = Window.partitionBy("source_id").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("level") == n, F.struct("section", "locator")), ignorenulls=True).over(so_far) for n in range(1, 7)]
    body = body.withColumns({f"_{n}": c for n, c in enumerate(last, 1)})
    after = lambda n: F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"_{m}.section"), F.lit(-1)) for m in range(1, n)])
    path = F.array_compact(F.array(*[F.when(F.col(f"_{n}.section") > after(n), F.col(f"_{n}.locator")) for n in range(1, 7)]))
    d = body.withColumn("header_path", path).drop(*[f"_{n}" for n in range(1, 7)]).where(F.length("body") > 0)
    d = d.withColumn("sha256", section_hash(F.col("source_id"), F.col("locator"), F.col("body")))
    return d.withColumn("section_id", section_id(F.col("source_id"), F.col("sha256")))


def reconcile(stored: DataFrame, incoming: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """One row per (source_id, section_id) with its status: new, existing, stale, orphan or kept.

    Both sides hold source_id and section_id. Stale rows are stored ones of an incoming source that come no more; orphans
    belong to sources neither incoming nor in the manifest, and exist only if there is a manifest. One full outer join.
    """
    keys = ["source_id", "section_id"]
    s = stored.select(*keys).distinct().withColumn("s", F.lit(True))
    i = incoming.select(*keys).distinct().withColumn("i", F.lit(True))
    d = s.join(i, keys, "full_outer").join(incoming.select("source_id").distinct().withColumn("live", F.lit(True)), "source_id", "left")
    known = F.lit(True)
    if manifest is not None:
        d = d.join(manifest.select("source_id").distinct().withColumn("listed", F.lit(True)), "source_id", "left")
        known = F.col("listed").isNotNull()
    status = F.when(F.col("s").isNull(), "new").when(F.col("i").isNotNull(), "existing").when(F.col("live").isNotNull(), "stale").when(~known, "orphan").otherwise("kept")
    return d.select(*keys, status.alias("status"))


def stats(status: DataFrame) -> DataFrame:
    n = lambda x: F.count_if(F.col("status") == x)
    return status.agg((n("new") + n("existing")).alias("total"), n("new").alias("indexed"), n("existing").alias("duplicates_skipped"), n("stale").alias("stale_deleted"), n("orphan").alias("orphans_deleted"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """stored with incoming rows put in place of those with the same keys; the last wins is the caller's to decide."""
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


DNS = "6ba7b8109dad11d180b400c04fd430c8"


def point_id(name: Column) -> Column:
    """The name-based (SHA-1) UUID of a name in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def payload(rows: DataFrame) -> DataFrame:
    """Section rows as they are stored: a point id and defaults for what is null or empty."""
    default = lambda c, x: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(x))
    return rows.withColumns({"point_id": point_id(F.col("section_id")), "product_line": default("product_line", "All"), "version": default("version", ""), "effective_date": default("effective_date", "")})


def ingest(stored: DataFrame, incoming: DataFrame, manifest: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the index after taking in the incoming sections, its statistics row). Rows hold source_id, section_id and more.

    Stale rows and orphans go, existing ones stay as they are, new ones come in; of repeated incoming rows one counts. An
    empty input changes nothing and counts nothing.
    """
    keys = ["source_id", "section_id"]
    once = incoming.dropDuplicates(keys)
    status = reconcile(stored, once, manifest)
    some = once.limit(1).agg((F.count("*") > 0).alias("some"))  # one row
    status = status.join(F.broadcast(some)).withColumn("status", F.when(~F.col("some") & F.col("status").isin("orphan", "stale"), "kept").otherwise(F.col("status"))).drop("some")
    keep = stored.join(status.where("status IN ('existing', 'kept')").select(*keys), keys, "left_semi")
    new = once.join(status.where("status = 'new'").select(*keys), keys, "left_semi")
    return keep.unionByName(new.select(*stored.columns)), stats(status)


def meta_row(spark, fingerprint: str, version: str, floors: DataFrame) -> DataFrame:
    """The index's one metadata row. floors: one row (dense_floor, sparse_floor)."""
    return floors.select(F.lit(fingerprint).alias("fingerprint"), F.lit(version).alias("manifest_version"), "dense_floor", "sparse_floor")


def fingerprint(model: str, dimension: int) -> str:
    return f"{model}:{dimension}"


def floors(meta: DataFrame, dense: float, sparse: float) -> DataFrame:
    """One row (dense_floor, sparse_floor): the stored ones, or the defaults where none, or zero, is stored."""
    pick = lambda c, x: F.coalesce(F.nullif(F.max(c), F.lit(0.0)), F.lit(x)).alias(c)
    return meta.agg(pick("dense_floor", dense), pick("sparse_floor", sparse))


def checked(rows: DataFrame, meta: DataFrame, own: str) -> DataFrame:
    """rows, which fail to be read if the index was made with another embedder than `own`; an index without a mark passes."""
    mark = F.broadcast(meta.agg(F.max("fingerprint").alias("_mark")))  # one row
    d = rows.join(mark)
    ok = F.coalesce(F.col("_mark") == own, F.lit(True))
    return d.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("the index was made with "), F.col("_mark"))).cast("boolean"))).drop("_mark")
