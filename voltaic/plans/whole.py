"""Queries over whole tables beside those of ``domain`` and ``statistics`` whose SQL takes a part of the ids. Roles come from columns; what is absent is null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as ct
from ..operators import epochs as ep
from ..operators import groups as gr
from ..operators import resample as rs
from ..operators import trials as tr
from . import domain, pipelines, statistics
from .domain import _PATHS, _paths
from .tables import ANNOTATIONS, annotations, read, rounded

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its name with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(domain.SQL["best_entity_match"].replace(" WHERE event_id < 400", "").replace(" WHERE event_id < 300", ""))
def best_entity_match_all(spark: SparkSession, d: str) -> DataFrame:
    all_ = ct.with_entities(_paths(spark, d))
    targets = all_.select("path", "sub", "ses", "task", "run", "entities").dropDuplicates(["path"])
    some = all_.select(F.when(F.col("event_id") % 7 > 0, F.col("sub")).alias("sub"), F.when(F.col("event_id") % 2 > 0, F.col("ses")).alias("ses"), "task").distinct()
    path = F.concat_ws("_", *(F.concat(F.lit(f"{k}-"), F.col(k)) for k in ("sub", "ses", "task")), F.lit("electrodes.tsv"))
    return rounded(ct.best_match(targets, ct.with_entities(some.select(path.alias("path")))))


@query(f"WITH {_PATHS}, g AS (SELECT DISTINCT path FROM f JOIN events USING (event_id) WHERE event_type NOT IN ('error', 'signup')) SELECT DISTINCT path FROM f WHERE path NOT IN (SELECT path FROM g)")
def skip_existing_all(spark: SparkSession, d: str) -> DataFrame:
    """Errors and signups have no output yet."""
    f = ct.with_entities(_paths(spark, d))
    done = f.select(F.when(~F.col("task").isin("error", "signup"), F.col("path")).alias("path"))
    return ct.still_to_do(f.select("path").distinct(), done)


@query(f"""WITH {_PATHS}, x AS (SELECT (u % 20)::VARCHAR AS sub, path FROM f), g AS (SELECT sub, count(*) AS n FROM x GROUP BY sub),
 p AS (SELECT sub, unnest(['sub', 'ses', 'task', 'run']) AS key, unnest([sub, nullif(regexp_extract(path, '_ses-([^_/]+)', 1), ''), regexp_extract(path, '_task-([^_/]+)', 1), regexp_extract(path, '_run-([^_/]+)', 1)]) AS value FROM x)
 SELECT sub, key, value FROM p JOIN g USING (sub) WHERE value IS NOT NULL GROUP BY sub, key, value, n HAVING count(*) = n""")
def shared_entities_all(spark: SparkSession, d: str) -> DataFrame:
    return ct.shared_entities(ct.with_entities(_paths(spark, d)), "sub")


@query(domain.SQL["roi_thresholds"].replace(" AND c_custkey % 4 = 0", ""))
def roi_thresholds_all(spark: SparkSession, d: str) -> DataFrame:
    return gr.region_thresholds(domain._channels(spark, d), 36, 12)


@query("SELECT DISTINCT c_nationkey::BIGINT AS channel FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 2000)")
def missing_channels_all(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with a low balance have no channel."""
    wanted = read(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("channel"))
    present = read(spark, d, "supplier").select(F.when(F.col("s_acctbal") > 2000, F.col("s_nationkey").cast("long")).alias("channel"))
    return gr.missing_channels(wanted, present, ["channel"])


@query(f"WITH {ANNOTATIONS}, x AS (SELECT event_id, recording, code, row_number() OVER (PARTITION BY recording, code ORDER BY event_id) AS i FROM a), y AS (SELECT recording, code, k AS duration, row_number() OVER (PARTITION BY recording, code ORDER BY event_id) AS i FROM (SELECT * REPLACE (CASE WHEN value < 50 THEN code END AS code) FROM a)) SELECT event_id, duration FROM x LEFT JOIN y ON x.recording = y.recording AND x.code = y.code AND x.i = y.i")
def duration_pairing_all(spark: SparkSession, d: str) -> DataFrame:
    """Durations of large values have no code."""
    a = annotations(spark, d)
    durations = a.select("recording", F.when(F.col("value") < 50, F.col("code")).alias("code"), "event_id", F.col("k").alias("duration"))
    return tr.pair_durations(a, durations, ["recording", "code"], "event_id").select("event_id", "duration")


@query(f"WITH {domain._REGION}, w AS (SELECT 'R' || (c_custkey % 3) AS roi, CASE WHEN c_acctbal > 0 THEN c_custkey END AS c_custkey FROM customer) SELECT w.roi, count(*) AS n, round(avg(v), 6) AS mean FROM w JOIN ch USING (c_custkey) GROUP BY roi")
def manual_roi_records_all(spark: SparkSession, d: str) -> DataFrame:
    """Wanted channels of customers without a positive balance are unknown."""
    c = read(spark, d, "customer")
    name = F.col("c_custkey").cast("string")
    inputs = c.select(F.lit("s").alias("subject"), name.alias("channel"), F.lit(0).alias("t_idx"), "c_acctbal")
    wanted = c.select(F.concat(F.lit("R"), (F.col("c_custkey") % 3).cast("string")).alias("roi"), F.lit("s").alias("subject"), F.when(F.col("c_acctbal") > 0, name).alias("channel"))
    records = pipelines.contributions(inputs, wanted, "c_acctbal")
    return rounded(records.groupBy("roi").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")))


@query("SELECT o_orderkey, o_orderkey::BIGINT % 3 AS run_idx FROM orders")
def union_runs_all(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", F.lit(1000.0).alias("fs"))
    return rounded(ep.union_runs([o.where(F.col("o_orderkey") % 3 == i) for i in range(3)]), "o_orderkey", "run_idx")


@query(statistics.SQL["cluster_pvalue"].replace(" WHERE label < 5", ""))
def cluster_pvalue_all(spark: SparkSession, d: str) -> DataFrame:
    p = statistics._pseudo_p(spark, d)
    null = p.select("feature", ((F.col("p") - 0.5) * 20).alias("null"))
    observed = p.groupBy("label", "feature").agg(F.sum(1 - F.col("p")).alias("t_sum"))
    return rounded(rs.cluster_pvalue(observed, null, ["feature"]), "label", "feature", "p_cluster")


@query(statistics.SQL["perm_t_maps"])
def perm_t_matrix(spark: SparkSession, d: str) -> DataFrame:
    """``perm_t_maps`` by matrix products."""
    t = rs.permuted_t(statistics.epochs(spark, d), statistics._dealt(spark, d, 5), list(statistics.CELL))
    return rounded(t, "perm", *statistics.CELL, "t")
