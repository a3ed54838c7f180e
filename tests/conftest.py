import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(v):
    if getattr(v, "shape", ()) or isinstance(v, list):
        return str([_plain(x) for x in v])
    if v is None or str(v) in ("<NA>", "NaT") or v != v:
        return "null"
    if hasattr(v, "item") and not getattr(v, "shape", ()):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.6g}" if isinstance(v, (int, float)) else str(v)


@pytest.fixture(scope="session")
def agree(spark):
    """Whether a query's rows are those of its SQL."""
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")

    def check(query, sql):
        a, b = query(spark, DATA).toPandas(), db.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        rows = [sorted(tuple(map(_plain, r)) for r in x[sorted(x.columns)].itertuples(index=False)) for x in (a, b)]
        assert rows[0] == rows[1]

    return check
