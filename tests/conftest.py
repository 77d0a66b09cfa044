import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    """The driver's smallest tables, documents cut to a test's size, and DuckDB views of them."""
    import duckdb

    out = tmp_path_factory.mktemp("small")
    con = duckdb.connect()
    for name in TABLES:
        source = f"'/root/testdata/sf0.001/{name}.parquet'"
        what = f"SELECT * FROM {source}"
        if name == "documents":
            what = f"SELECT doc_id, substr(text, 1, 900) AS text, lang, source, n_chars FROM {source} WHERE doc_id < 60 UNION ALL SELECT 1000, NULL, 'en', 'src1', 0 UNION ALL SELECT 1001, '', 'de', 'src2', 0"
        if name == "lineitem":
            what = f"SELECT * FROM {source} WHERE l_orderkey < 2000"
        con.execute(f"COPY ({what}) TO '{out}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{out}/{name}.parquet'")
    return str(out), con
