"""Sources and sinks: Markdown corpora with a manifest, JSONL requests and evaluation cases, JSONL responses, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "corpus string, version string, documents array<struct<id:string,title:string,path:string,format:string,version:string,effective_date:string,product_line:string>>"


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, stem and text of each Markdown file of a folder."""
    d = spark.read.option("pathGlobFilter", "*.md").option("ignoreMissingFiles", True).text(folder, wholetext=True)
    return d.select(F.col("_metadata.file_name").alias("file_name"), F.regexp_replace("_metadata.file_name", r"\.md$", "").alias("stem"), F.col("value").alias("text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a manifest; none where the file is missing or isn't what a manifest is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], MANIFEST).select(F.inline("documents"))
    return spark.read.text(path, wholetext=True).select(F.from_json("value", MANIFEST).alias("m")).select(F.inline("m.documents"))


def title_of(stem: Column) -> Column:
    """A file's name as a title: dashes are blanks, and each run of letters begins with a capital, also behind digits."""
    runs = F.regexp_extract_all(F.replace(stem, F.lit("-"), F.lit(" ")), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def with_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files with their manifest entry, found by stem or else by file name, and defaults where there is none."""
    m = manifest.select(F.struct("*").alias("m"), F.col("id"), F.col("path"))
    by_id = m.select(F.col("id").alias("stem"), F.col("m").alias("a"))
    by_path = m.select(F.col("path").alias("file_name"), F.col("m").alias("b"))
    d = files.join(by_id, "stem", "left").join(by_path, "file_name", "left").withColumn("m", F.coalesce("a", "b"))
    line = F.col("m.product_line")
    return d.select(
        F.coalesce("m.id", "stem").alias("source_id"), F.coalesce("m.title", title_of(F.col("stem"))).alias("title"),
        F.coalesce("m.version", F.lit("")).alias("version"), F.coalesce("m.effective_date", F.lit("")).alias("effective_date"),
        F.when(line.isin("Standard", "Pro", "All"), line).otherwise("All").alias("product_line"), "text",
    )


def read_requests(lines: DataFrame) -> DataFrame:
    """Requests from JSON lines (value): blank lines go, a missing session is default-session, a missing message empty."""
    d = lines.where(F.trim("value") != "").select(F.from_json("value", "session_id string, message string").alias("r"))
    return d.select(F.coalesce("r.session_id", F.lit("default-session")).alias("session_id"), F.coalesce("r.message", F.lit("")).alias("message"))


def read_cases(lines: DataFrame) -> DataFrame:
    """Evaluation turns from JSON lines; what is expected may be a string or a list of them."""
    many = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.when(c.isNotNull(), F.array(c)))
    d = lines.where(F.trim("value") != "").select(F.from_json("value", "id string, turns array<struct<input:string,expected_action:string,expected_source:string>>").alias("c"))
    d = d.select(F.col("c.id").alias("case_id"), F.posexplode("c.turns").alias("p", "t"))
    return d.select("case_id", (F.col("p") + 1).alias("turn"), F.col("t.input").alias("input"), many(F.col("t.expected_action")).alias("expected_action"), many(F.col("t.expected_source")).alias("expected_source"))


def event_line(event: Column, data: Column) -> Column:
    return F.format_string("event: %s\ndata: %s\n\n", event, data)
