"""The workers get the package through Spark: every operator works from another folder, without PYTHONPATH, as its first call."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
START = """
import sys; sys.path.insert(0, ROOT)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(i, "alpha beta gamma delta rho sigma " * 9, "en", f"s{i}") for i in range(6)], "doc_id long, text string, lang string, source string")
from lodestead.llm import CALL
"""
CALLS = {
    "ngram_join": "ngram_join.classes(docs)", "decontamination": "decontamination.matches(docs, docs.selectExpr('doc_id item_id', 'text'))", "substring_dedup": "substring_dedup.remove_repeats(docs)",
    "toxicity": "toxicity.score(docs, docs.selectExpr('doc_id', 'int(doc_id % 2) toxic'))", "importance_resampling": "importance_resampling.resample(docs, docs)", "source_audit": "source_audit.audit(docs)",
    "html_extraction": "html_extraction.extract(docs.selectExpr('doc_id', 'text html'))", "lm_scoring": "lm_scoring.score_texts(docs)",
}


@pytest.mark.parametrize("name", sorted(CALLS))
def test_an_operator_ships_the_package(name, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = START.replace("ROOT", repr(ROOT)).replace("CALL", name) + f"print('rows', {CALLS[name]}.count())"
    got = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows " in got.stdout, got.stderr[-2000:]
