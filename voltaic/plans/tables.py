"""The driver's tables in the roles of the domain: epochs, signals, events, trials, channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import known


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial, label, condition A/B, feature 0-7, t_idx 0-7, time_s, v (some missing) and the trial's predictor x."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial"), F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("pos", "v"))
    missing = (F.col("trial") * 7 + F.col("pos")) % 97 == 0
    t = F.col("pos").cast("long") % 8
    return rows.select(
        "trial", "label", F.when(F.col("label") % 2 == 0, "A").otherwise("B").alias("condition"), F.expr("pos DIV 8").alias("feature"), t.alias("t_idx"),
        ((t - 2) / F.lit(10.0)).alias("time_s"), F.when(~missing, known("v")).alias("v"), ((F.col("trial") % 13).cast("double") * 0.5).alias("x"),
    )


#: The same for DuckDB, as a common table expression.
EPOCHS = """e AS (SELECT vec_id AS trial, label::BIGINT AS label, CASE WHEN label % 2 = 0 THEN 'A' ELSE 'B' END AS condition,
 (i - 1) // 8 AS feature, (i - 1) % 8 AS t_idx, ((i - 1) % 8 - 2)::DOUBLE / 10 AS time_s,
 CASE WHEN (vec_id * 7 + i - 1) % 97 = 0 THEN NULL ELSE embedding[i]::DOUBLE END AS v, (vec_id % 13)::DOUBLE * 0.5 AS x
 FROM embeddings, range(1, 65) AS r(i))"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, recording, onset (whole seconds of the epoch), code, value and k of the properties."""
    e = read(spark, sf_dir, "events")
    onset = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("long")
    return e.select("event_id", F.col("user_id").alias("recording"), onset.alias("onset"), F.col("event_type").alias("code"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


ANNOTATIONS = """a AS (SELECT event_id, user_id AS recording, floor(epoch(ts))::BIGINT AS onset, event_type AS code, value, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """The columns (all, if none are named), doubles to six places and integers as bigint."""
    types = dict(df.dtypes)

    def each(c: str) -> Column:
        if types[c] in ("double", "float"):
            return F.round(F.col(c).cast("double"), 6).alias(c)
        return F.col(c).cast("long").alias(c) if types[c] in ("int", "smallint", "tinyint") else F.col(c)

    return df.select(*(each(c) for c in (columns or df.columns)))
