import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", "/tmp/lodestead-test-warehouse").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def data():
    return DATA


def same(spark, query, sql, folder):
    """Whether a query and its SQL give the same rows in any order."""
    import duckdb

    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'" if p.is_file() else f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    df = query(spark, str(folder))
    cols = sorted(df.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    ours = sorted((tuple(norm(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    cur = con.execute(sql)
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    theirs = sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    return ours == theirs
