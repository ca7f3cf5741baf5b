"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as Spark string functions take it.
WHITE = " \t\n\x0b\f\r"
#: Bytes of text that a task works on at once; a longer text is taken whole.
CHUNK = 2 << 20


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="voltaic-")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, ``spark.checkpoint.dir``. Where that is unset, local mode (tests) takes a new one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return f"{(path or _own_dir()).rstrip('/')}/{spark.sparkContext.applicationId}"


def stage(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back. ``drop`` deletes what was written, ``release`` everything."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def stage_by(df: DataFrame, key: str, n: int) -> DataFrame:
    """``stage`` in n buckets of ``key``, so that joins on it don't shuffle the table again."""
    spark = df.sparkSession
    name = f"voltaic_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/stage-{name}"
    df.write.bucketBy(n, key).sortBy(key).format("parquet").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._staged, out._table = path, name
    return out


def drop(*staged: DataFrame | None) -> None:
    """Delete staged tables that nothing will read again."""
    for df in staged:
        if df is not None:
            if "_table" in vars(df):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")
            _delete(df.sparkSession, df._staged)


def let_go(spark: SparkSession) -> None:
    """Have the driver's collector run: Spark deletes the shuffle files of plans that are collected, which can be long in coming on a large driver."""
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Delete this application's staged tables and token files, once results that are made from them have been written elsewhere."""
    _delete(spark, shared_dir(spark))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also when ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def texts(column: pa.Array) -> pa.Array:
    """Nulls as empty texts, with 64-bit offsets."""
    return column.cast(pa.large_string()).fill_null("")


def chunks(batch: pa.RecordBatch, text_col: str = "text", limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts in runs of about ``limit`` bytes: (first row, end row, their UTF-8 bytes, offsets of each text in them)."""
    column = texts(batch.column(text_col))
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
