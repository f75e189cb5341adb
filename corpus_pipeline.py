"""The corpus pipeline: rules, line dedup, near duplicates, decontamination, tokens; part of the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.

Results on odd input: null, empty and blank texts go with the quality rules, as all texts of few words do. Rows with a null
doc_id that pass the rules stay: they are nobody's earlier place, near copy or contaminated document. Rows that repeat a
doc_id and text are one document, kept or dropped together. Ties go to the smaller doc_id. Very long texts are
worked on whole. Further columns of any name pass through all stages but the last. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestead.llm import byte_bpe, decontamination, line_dedup, ngram_join, quality_rules
from lodestead.llm.common import materialize, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are deleted from the texts; no document goes."""
    return line_dedup.drop_repeated_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.keep_one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text of each document."""
    path = tokenizers.path(RANKS)
    d = byte_bpe.decode(byte_bpe.encode(docs, path, tokenizers.PATTERN), path, tokenizers.PATTERN)
    return d.selectExpr("doc_id", "size(ids) n_tokens", "ids", "decode(decoded, 'utf-8') text")


STAGES = [("quality_rules", good), ("line_dedup", lines), ("ngram_join", near), ("decontamination", clean), ("byte_bpe", tokens)]
#: The tokenizer and the edit-distance search can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
