"""Queries of result kinds, windows of envelopes, grids and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import results as rs
from .tables import ANNOTATIONS, EPOCHS, annotations, epochs, read, rounded

QUERIES, SQL = {}, {}


def query(sql: str):
    """Register a query under its name with its SQL."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"""WITH {EPOCHS} SELECT 'f' || feature AS feature, time_s, 'none' AS activity_zscore, 0.0::DOUBLE AS t, 1.0::DOUBLE AS p, 1.0::DOUBLE AS p_uncorrected,
 round(avg(CASE WHEN condition = 'A' THEN v END), 6) AS mean_a, round(avg(CASE WHEN condition = 'B' THEN v END), 6) AS mean_b, 0.0::DOUBLE AS sem_a, 0.0::DOUBLE AS sem_b,
 count(CASE WHEN condition = 'A' THEN v END) AS n_a, count(CASE WHEN condition = 'B' THEN v END) AS n_b, 'channel' AS analysis_level, NULL::VARCHAR AS atlas_name, 0.05::DOUBLE AS significance_alpha,
 'fdr_bh' AS correction, 0::BIGINT AS n_permutations, count(*) AS n_all FROM e GROUP BY feature, time_s""")
def result_conformed(spark: SparkSession, d: str) -> DataFrame:
    """A table of means as a condition test: what it lacks has its default, what it has beyond that stays."""
    a, b = (F.when(F.col("condition") == c, F.col("v")) for c in "AB")
    means = epochs(spark, d).groupBy(F.concat(F.lit("f"), F.col("feature").cast("string")).alias("feature"), "time_s").agg(
        F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.count(a).cast("int").alias("n_a"), F.count(b).cast("int").alias("n_b"), F.lit("none").alias("activity_zscore"), F.count(F.lit(1)).alias("n_all")
    )
    return rounded(rs.conform(means, "condition_test"))


@query(f"""WITH {EPOCHS} SELECT 'r' || label AS recording, 'c' || feature AS channel, trial * 8 + t_idx AS sample, round(CASE WHEN label % 3 = 0 THEN v * 2 ELSE v END, 6) AS v, 100.0::DOUBLE AS sfreq,
 CASE WHEN label % 3 = 0 THEN 'hilbert' ELSE 'brainvision' END AS source FROM e""")
def envelope_or_signal(spark: SparkSession, d: str) -> DataFrame:
    """Recordings with an envelope give its window of 20 ms, the others their signal."""
    e = epochs(spark, d)
    signals = e.select(F.concat(F.lit("r"), F.col("label").cast("string")).alias("recording"), F.concat(F.lit("c"), F.col("feature").cast("string")).alias("channel"), (F.col("trial") * 8 + F.col("t_idx")).alias("sample"), "v", F.lit(100.0).alias("sfreq"), "label")
    windows = F.explode(F.array(F.lit(10), F.lit(20))).alias("window_ms")
    envelopes = signals.where("label % 3 = 0").select("recording", "channel", "sample", "v", "sfreq", windows).withColumn("v", F.col("v") * (F.col("window_ms") / 10))
    return rounded(rs.signals_or_envelopes(signals, envelopes, 20))


@query("""WITH l AS (SELECT l_orderkey, l_quantity::DOUBLE AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS i FROM lineitem),
 o AS (SELECT DISTINCT l_orderkey FROM l), g AS (SELECT l_orderkey, f, t FROM o, range(2) a(f), range(3) b(t))
 SELECT g.l_orderkey, f AS feature, t AS t_idx, q AS v FROM g LEFT JOIN l ON l.l_orderkey = g.l_orderkey AND i = f * 3 + t""")
def feature_time_grid(spark: SparkSession, d: str) -> DataFrame:
    """Each order's quantities, a flat array of any length, as two features of three times."""
    flat = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q")))).getField("q").alias("a"))
    rows = flat.select("l_orderkey", F.posexplode(rs.feature_time(F.col("a"), 2, 3, nested=False)).alias("feature", "row"))
    return rounded(rows.select("l_orderkey", "feature", F.posexplode("row").alias("t_idx", "v")))


@query("""SELECT l_suppkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN least(a, r) = 0 THEN 'missing' ELSE 'repeated' END AS problem FROM (SELECT l_suppkey, l_linenumber, count(*) FILTER (l_returnflag = 'A') AS a,
 count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL) WHERE least(a, r) = 0 OR greatest(a, r) > 1""")
def result_uneven_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells that two conditions don't share, or have more than once."""
    return rounded(rs.uneven_cells(read(spark, d, "lineitem"), ["l_suppkey"], ["l_linenumber"], ("A", "R"), "l_returnflag"))


@query(f"""WITH {ANNOTATIONS} SELECT 'sub-' || recording AS source_file, event_id::VARCHAR AS anchor_event_index, code AS anchor_event_code, onset::VARCHAR AS anchor_onset_s, '' AS trial_id,
 CASE WHEN k % 2 = 0 THEN 'A' ELSE '' END AS resolved_label, CASE WHEN event_id % 5 = 0 THEN 'nan' ELSE ((event_id % 100)::DOUBLE / 4)::VARCHAR END AS trial_activity_summary_response_time_s,
 CASE WHEN event_id % 4 = 0 THEN '[]' ELSE '["e", "f' || event_id % 4 || '"]' END AS nan_masked_features, '[]' AS baseline_outlier_masked_features, '' AS activity_summary_skip_reason,
 code AS predictor_raw, 'nan' AS predictor_raw_value, 'nan' AS predictor_transformed_value, ((event_id % 7)::DOUBLE)::VARCHAR AS predictor_value, 'nan' AS predictor_transform_scale, 'nan' AS predictor_transform_offset,
 '{{"code":"' || code || '","user":"' || recording || '"}}' AS condition_inputs, '' AS condition_resolution_reason, CASE WHEN event_id % 3 = 1 THEN 'true' ELSE 'false' END AS keep,
 CASE WHEN event_id % 3 = 2 THEN 'late' ELSE '' END AS exclusion_reason FROM a""")
def trial_audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit of a regression's trials, a row of texts for each."""
    text = F.col("recording").cast("string")
    number = F.col("event_id").cast("double")
    trials = annotations(spark, d).select(
        F.concat(F.lit("sub-"), text).alias("source_file"), F.col("event_id").alias("anchor_event_index"), F.col("code").alias("anchor_event_code"), F.col("onset").alias("anchor_onset_s"),
        F.when(F.col("k") % 2 == 0, "A").alias("resolved_label"), F.when(number % 5 == 0, F.lit(float("nan"))).otherwise(number % 100 / 4).alias("trial_activity_summary_response_time_s"),
        F.when(number % 4 != 0, F.array(F.concat(F.lit("f"), (F.col("event_id") % 4).cast("string")), F.lit("e"))).alias("nan_masked_features"), F.col("code").alias("predictor_raw"), (number % 7).alias("predictor_value"),
        F.create_map(F.lit("user"), text, F.lit("code"), "code").alias("condition_inputs"), F.when(number % 3 < 2, number % 3 == 1).alias("keep"), F.when(number % 3 == 2, "late").alias("exclusion_reason"),
    )
    return rs.audit(trials, "regression")
