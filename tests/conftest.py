"""A local session, DuckDB views of the test tables, and a comparison of both."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import uuid
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def keep(spark, tmp_path):
    """Stores a middle result and reads it back."""

    def put(df):
        path = f"{tmp_path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return put


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        p = DATA / f"{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA)


def plain(v):
    """A value in a form that both engines share."""
    if isinstance(v, (list, tuple, np.ndarray)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if hasattr(v, "asDict"):
        return plain(v.asDict(True))
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return None if v != v else round(float(v), 6) + 0.0
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return None if v is pd.NaT else v


@pytest.fixture(scope="session")
def same():
    """Compare a DataFrame with a DuckDB query, order aside."""

    def check(df, con, sql):
        cur = con.execute(sql)
        names = [x[0] for x in cur.description]
        assert sorted(names) == sorted(df.columns)
        cols = sorted(names)
        got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
        want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
        assert got == want

    return check
