from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    builder = SparkSession.builder.master("local[4]")
    for k, v in conf.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows_of(frame):
    """Rows with their columns in order of name, as texts, in order."""
    import numpy as np
    import pandas as pd

    columns = sorted(frame.columns)

    def text(v):
        v = v.item() if isinstance(v, np.generic) else v
        if v is None or pd.isna(v):
            return "-"
        number = isinstance(v, int | float) and not isinstance(v, bool)
        return repr(round(float(v), 6) or 0.0) if number else str(v)

    return columns, sorted(tuple(map(text, r)) for r in frame[columns].astype(object).values.tolist())


@pytest.fixture(scope="session")
def same_rows():
    def check(a, b):
        left, right = rows_of(a), rows_of(b)
        assert left[0] == right[0]
        assert left[1] == right[1]

    return check
