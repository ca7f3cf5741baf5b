"""Queries of subject and group statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import affine
from ..operators import epochs as ep
from ..operators import resample as rs
from ..operators import stats as st
from .tables import EPOCHS, epochs, read, rounded

CELL = ["feature", "t_idx"]
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its name, with SQL that begins with the epochs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {EPOCHS} {sql.strip()}"
        return f

    return add


_AB = """, s AS (SELECT {k}, avg(v) FILTER (condition = 'A') AS ma, avg(v) FILTER (condition = 'B') AS mb, var_samp(v) FILTER (condition = 'A') AS va,
 var_samp(v) FILTER (condition = 'B') AS vb, count(v) FILTER (condition = 'A') AS na, count(v) FILTER (condition = 'B') AS nb FROM {src} GROUP BY ALL)"""
_WELCH = "va / na + vb / nb"
_WELCH_DF = "pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1))"
_ONE = "round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem, count(v) AS n_obs, round(avg(v) / (stddev_samp(v) / sqrt(count(v))), 6) AS t, (count(v) - 1)::DOUBLE AS df"


@query(_AB.format(k="feature, t_idx", src="e") + f"SELECT feature, t_idx, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, na AS n_a, nb AS n_b, round(ma - mb, 6) AS diff, round((ma - mb) / sqrt({_WELCH}), 6) AS t, round({_WELCH_DF}, 6) AS df FROM s")
def welch_contrast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.two_sample_t(epochs(spark, d), CELL), *CELL, "mean_a", "mean_b", "n_a", "n_b", "diff", "t", "df")


@query(_AB.format(k="feature, t_idx", src="e") + "SELECT feature, t_idx, round(ma - mb, 6) AS diff, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0::DOUBLE / na + 1.0::DOUBLE / nb)), 6) AS t, (na + nb - 2)::DOUBLE AS df FROM s")
def pooled_contrast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.two_sample_t(epochs(spark, d), CELL, equal_var=True), *CELL, "diff", "t", "df")


@query("SELECT condition, feature, t_idx, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(*)), 6) AS sem, count(*) AS n_trials FROM e GROUP BY ALL")
def condition_mean_sem(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.condition_mean_sem(epochs(spark, d), CELL))


@query("SELECT label, feature, t_idx, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem, count(v) AS n_obs FROM e GROUP BY ALL")
def group_sem(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.group_sem(epochs(spark, d), ["label", *CELL]))


@query(_AB.format(k="feature, t_idx", src="e") + f"SELECT feature, t_idx, round(ma - mb, 6) AS diff, round({_WELCH_DF}, 6) AS df, round(sqrt({_WELCH}), 6) AS se FROM s")
def difference_ci_df(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.two_sample_t(epochs(spark, d), CELL), *CELL, "diff", "df", "se")


@query()
def difference_ci95(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.difference_ci95(epochs(spark, d), CELL), *CELL, "diff", "ci_low", "ci_high")


@query()
def t_pvalues(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.two_sample_t(epochs(spark, d), CELL, p=True), *CELL, "t", "p")


@query(f"SELECT label, feature, t_idx, {_ONE} FROM e GROUP BY ALL")
def one_sample_timecourse(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.one_sample_t(epochs(spark, d), ["label", *CELL]))


@query(f", m AS (SELECT trial, feature, avg(v) AS v FROM e GROUP BY ALL) SELECT feature, {_ONE} FROM m GROUP BY feature")
def one_sample_epoch_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.one_sample_t(st.row_means(epochs(spark, d), ["trial", "feature"]), ["feature"]))


@query(", m AS (SELECT trial, feature, condition, avg(v) AS v FROM e GROUP BY ALL)" + _AB.format(k="feature", src="m") + f"SELECT feature, round(ma - mb, 6) AS diff, round((ma - mb) / sqrt({_WELCH}), 6) AS t, (na + nb - 2)::DOUBLE AS df FROM s")
def welch_epoch_summary(spark: SparkSession, d: str) -> DataFrame:
    """The degrees of freedom reported are those of the pooled test, though the test is Welch's."""
    m = st.row_means(epochs(spark, d), ["trial", "feature", "condition"])
    out = st.two_sample_t(m, ["feature"])
    return rounded(out.withColumn("df", (F.col("n_a") + F.col("n_b") - 2).cast("double")), "feature", "diff", "t", "df")


_PAIRS = ", p AS (SELECT trial // 2 AS unit, {k}, avg(v) FILTER (condition = 'A') - avg(v) FILTER (condition = 'B') AS v FROM e GROUP BY ALL)"


@query(_PAIRS.format(k="feature, t_idx") + f"SELECT feature, t_idx, {_ONE} FROM p GROUP BY ALL")
def paired_timecourse(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.paired_t(epochs(spark, d).withColumn("unit", F.expr("trial DIV 2")), "unit", CELL))


@query(_PAIRS.format(k="feature, t_idx") + f", q AS (SELECT unit, feature, avg(v) AS v FROM p GROUP BY ALL) SELECT feature, {_ONE} FROM q GROUP BY ALL")
def paired_epoch_summary(spark: SparkSession, d: str) -> DataFrame:
    sides = epochs(spark, d).withColumn("unit", F.expr("trial DIV 2")).groupBy("unit", *CELL)
    diff = sides.agg((F.avg(F.when(F.col("condition") == "A", F.col("v"))) - F.avg(F.when(F.col("condition") == "B", F.col("v")))).alias("v"))
    return rounded(st.one_sample_t(st.row_means(diff, ["unit", "feature"]), ["feature"]))


_REG = """SELECT condition, feature, t_idx, n AS n_obs, CASE WHEN {ok} THEN round(c / vx, 6) END AS slope, CASE WHEN {ok} THEN round(my - c / vx * mx, 6) END AS intercept,
 CASE WHEN {ok} THEN round(c / sqrt(vx * vy), 6) END AS r FROM (SELECT condition, feature, t_idx, count(*) AS n_all, count(v) AS n, avg(x) FILTER (v IS NOT NULL) AS mx, avg(v) AS my,
 var_pop(x) FILTER (v IS NOT NULL) AS vx, var_pop(v) AS vy, covar_pop(x, v) AS c FROM {src} GROUP BY ALL)"""


@query(_REG.format(src="e", ok="n >= 3 AND vx > 0 AND n = n_all"))
def regression_dense(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.regression(epochs(spark, d), ["condition", *CELL], policy="dense"), "condition", *CELL, "n_obs", "slope", "intercept", "r")


@query(_REG.format(src="(SELECT * FROM (SELECT *, first_value(v) OVER (PARTITION BY trial, feature ORDER BY t_idx) AS f FROM e) WHERE f IS NOT NULL)", ok="n >= 3 AND vx > 0 AND n = n_all"))
def regression_time0_null(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.regression(epochs(spark, d), ["condition", *CELL], policy="feature_time0"), "condition", *CELL, "n_obs", "slope", "intercept", "r")


@query(_REG.format(src="e", ok="n >= 3 AND vx > 0 AND vy > 0"))
def regression_pointwise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.regression(epochs(spark, d), ["condition", *CELL]), "condition", *CELL, "n_obs", "slope", "intercept", "r")


@query(", s AS (" + _REG.format(src="e", ok="n >= 3 AND vx > 0 AND vy > 0").replace("round(c / sqrt(vx * vy), 6)", "c / sqrt(vx * vy)") + ") SELECT condition, feature, t_idx, round(r * sqrt((n_obs - 2) / (1 - r * r)), 6) AS t FROM s")
def r_to_t(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.regression(epochs(spark, d), ["condition", *CELL]), "condition", *CELL, "t")


@query(", b AS (SELECT *, avg(CASE WHEN time_s < 0.1 THEN v END) OVER w AS m, stddev_samp(CASE WHEN time_s < 0.1 THEN v END) OVER w AS s FROM e WINDOW w AS (PARTITION BY trial, feature)) SELECT trial, feature, t_idx, round((v - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS z FROM b")
def zscore_trial(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.zscore(epochs(spark, d), ["trial", "feature"], baseline=F.col("time_s") < 0.1), "trial", *CELL, "z")


_MEANS = ", m AS (SELECT trial, condition, feature, avg(v) AS m FROM e WHERE time_s < 0.1 GROUP BY ALL), r AS (SELECT {k}, avg(m) AS a, stddev_samp(m) AS s FROM m GROUP BY ALL) SELECT trial, feature, t_idx, round((v - a) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS z FROM e JOIN r USING ({k})"


@query(_MEANS.format(k="condition, feature"))
def zscore_condition(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.zscore_by_trial_means(epochs(spark, d), ["condition", "feature"], F.col("time_s") < 0.1), "trial", *CELL, "z")


@query(_MEANS.format(k="feature"))
def zscore_global(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.zscore_by_trial_means(epochs(spark, d), ["feature"], F.col("time_s") < 0.1), "trial", *CELL, "z")


@query(", b AS (SELECT *, avg(v) OVER w AS m, stddev_samp(v) OVER w AS s, count(v) OVER w AS n FROM e WINDOW w AS (PARTITION BY condition, feature, t_idx)) SELECT trial, feature, t_idx, CASE WHEN n >= 3 AND s > 0 THEN round((v - m) / s, 6) END AS z FROM b")
def zscore_across_trials(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.zscore(epochs(spark, d), ["condition", *CELL], least=3, zero="null"), "trial", *CELL, "z")


@query(", t AS (SELECT DISTINCT trial, condition, x FROM e), b AS (SELECT *, avg(x) OVER w AS m, stddev_samp(x) OVER w AS s, count(x) OVER w AS n FROM t WINDOW w AS (PARTITION BY condition)) SELECT trial, CASE WHEN n >= 3 AND s > 0 THEN round((x - m) / s, 6) END AS z FROM b")
def predictor_zscore_scope(spark: SparkSession, d: str) -> DataFrame:
    t = epochs(spark, d).select("trial", "condition", F.col("x").alias("v")).distinct()
    return rounded(st.zscore(t, ["condition"], least=3, zero="null"), "trial", "z")


@query(", t AS (SELECT DISTINCT trial, condition, x FROM e) SELECT trial, round(CASE WHEN condition = 'A' THEN 2.5 ELSE 1 END * x + CASE WHEN condition = 'A' THEN 0 ELSE -0.75 END, 6) AS x FROM t")
def affine_predictor(spark: SparkSession, d: str) -> DataFrame:
    t = epochs(spark, d).select("trial", "condition", "x").distinct()
    scale, offset = F.when(F.col("condition") == "A", 2.5), F.when(F.col("condition") == "B", -0.75)
    return rounded(t.withColumn("x", affine("x", scale, offset)), "trial", "x")


#: A stand-in for p that both engines compute alike.
_PSEUDO = "(hash_id * 2654435761 % 100003)::DOUBLE / 100003"


def _pseudo_p(spark: SparkSession, d: str) -> DataFrame:
    cells = epochs(spark, d).select("label", *CELL).distinct().withColumn("_i", F.col("label") * 64 + F.col("feature") * 8 + F.col("t_idx") + 1)
    return cells.withColumn("p", (F.pmod(F.col("_i") * 2654435761, F.lit(100003))).cast("double") / 100003.0).drop("_i")


_P = ", c AS (SELECT DISTINCT label, feature, t_idx, label * 64 + feature * 8 + t_idx + 1 AS hash_id FROM e), p AS (SELECT label, feature, t_idx, " + _PSEUDO + " AS p FROM c)"


@query(_P + ", k AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY p) + count(*) OVER (PARTITION BY label, p) - 1 AS r, count(*) OVER (PARTITION BY label) AS m FROM p) SELECT label, feature, t_idx, round(least(min(p * m / r) OVER (PARTITION BY label ORDER BY p DESC RANGE UNBOUNDED PRECEDING), 1), 6) AS p_corr FROM k")
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.benjamini_hochberg(_pseudo_p(spark, d), by=["label"]), "label", *CELL, "p_corr")


@query(_P + "SELECT label, feature, t_idx, round(least(p * count(p) OVER (PARTITION BY label), 1), 6) AS p_corr FROM p")
def bonferroni(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.bonferroni(_pseudo_p(spark, d), by=["label"]), "label", *CELL, "p_corr")


@query("SELECT trial, feature, least(t_idx // 3, 2) AS bin, round(avg(v), 6) AS v, round(avg(t_idx), 6) AS bin_time FROM e GROUP BY ALL")
def temporal_bins_window(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ep.bin_by_samples(epochs(spark, d), ["trial", "feature"], 3, 8))


@query(", b AS (SELECT i AS bin, i * 8 // 3 AS s, (i + 1) * 8 // 3 AS f FROM range(3) AS g(i)) SELECT trial, feature, bin, round(avg(v), 6) AS v, round(avg(t_idx), 6) AS bin_time FROM e JOIN b ON t_idx >= s AND t_idx < f GROUP BY ALL")
def temporal_bins_n(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ep.bin_by_count(epochs(spark, d), ["trial", "feature"], 3, 8))


@query(", n AS (SELECT trial, feature, t_idx, coalesce(v, 0) AS v FROM e) SELECT a.trial, a.feature, a.t_idx, round(sum(b.v) / 4, 6) AS smooth FROM n a JOIN n b ON a.trial = b.trial AND a.feature = b.feature AND b.t_idx BETWEEN CASE WHEN a.t_idx <= 2 THEN 0 ELSE a.t_idx - 1 END AND CASE WHEN a.t_idx <= 2 OR a.t_idx < 6 THEN a.t_idx + 2 ELSE 7 END GROUP BY ALL")
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    rows = epochs(spark, d).withColumn("v", F.coalesce("v", F.lit(0.0)))
    return rounded(ep.moving_average(rows, ["trial", "feature"], 4), "trial", *CELL, "smooth")


@query(", n AS (SELECT trial, feature, t_idx, coalesce(v, 0) AS v FROM e) SELECT a.trial, a.feature, a.t_idx, round(sum(b.v) / 4, 6) AS smooth FROM n a JOIN n b ON a.trial = b.trial AND a.feature = b.feature AND b.t_idx BETWEEN a.t_idx - 1 AND a.t_idx + 2 GROUP BY ALL")
def conv_same_average(spark: SparkSession, d: str) -> DataFrame:
    rows = epochs(spark, d).withColumn("v", F.coalesce("v", F.lit(0.0)))
    return rounded(ep.same_convolution(rows, ["trial", "feature"], 4), "trial", *CELL, "smooth")


_MID = ", b AS (SELECT *, avg(CASE WHEN t_idx >= 2 AND t_idx < 6 THEN v END) OVER (PARTITION BY trial, feature) AS base FROM (SELECT trial, feature, t_idx, abs(v) AS v FROM e))"


@query(_MID + "SELECT trial, feature, t_idx, round(v / CASE WHEN base = 0 THEN 1 ELSE base END * 100, 6) AS norm FROM b")
def percent_normalise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ep.normalise(epochs(spark, d).withColumn("v", F.abs("v")), ["trial", "feature"]), "trial", *CELL, "norm")


@query(_MID + "SELECT trial, feature, t_idx, CASE WHEN v IS NOT NULL THEN round(20 * log10(greatest(v, 1e-10) / greatest(base, 1e-10)), 6) END AS norm FROM b")
def db_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = ep.normalise(epochs(spark, d).withColumn("v", F.abs("v")), ["trial", "feature"], "db")
    return rounded(rows.withColumn("norm", F.when(F.col("v").isNotNull(), F.col("norm"))), "trial", *CELL, "norm")


def _qc(kind: str) -> str:
    return f", s AS (SELECT trial, feature, {kind} AS m FROM e GROUP BY ALL), r AS (SELECT feature, avg(m) AS a, stddev_samp(m) AS d FROM s GROUP BY ALL) SELECT trial, feature, round(m, 6) AS summary, coalesce(d > 0 AND abs(m - a) > 2 * d, FALSE) AS masked FROM s JOIN r USING (feature)"


@query(_qc("avg(v)"))
def epoch_qc_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ep.mask_trials(epochs(spark, d), factor=2.0))


@query(_qc("max(abs(v))"))
def epoch_qc_max(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ep.mask_trials(epochs(spark, d), by="max", factor=2.0))


@query(", s AS (SELECT trial, feature, avg(v) AS m FROM e GROUP BY ALL), f AS (SELECT feature, stddev_samp(m) AS spread FROM s GROUP BY ALL), r AS (SELECT avg(spread) AS a, stddev_samp(spread) AS d, count(spread) AS n FROM f) SELECT feature, round(spread, 6) AS spread, coalesce(n >= 2 AND d > 0 AND abs(spread - a) > d, FALSE) AS excluded FROM f, r")
def epoch_qc_spread(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ep.spread_outliers(epochs(spark, d)))


@query(", s AS (SELECT trial, feature, max((v IS NULL)::INT) AS x FROM e GROUP BY ALL) SELECT feature, round(avg(x), 6) AS ratio, avg(x) >= 0.08 AS excluded FROM s GROUP BY feature")
def epoch_qc_nan_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ep.missing_ratio(epochs(spark, d), most=0.08))


@query(", m AS (SELECT trial, feature, avg(v) AS m FROM e GROUP BY ALL), c AS (SELECT feature, median(m) AS c FROM m GROUP BY ALL), s AS (SELECT feature, 1.4826 * median(abs(m - c)) AS s, count(m) AS n FROM m JOIN c USING (feature) GROUP BY ALL) SELECT trial, feature, coalesce(n >= 3 AND s > 0 AND abs(m - c) > 3 * s, FALSE) AS outlier FROM m JOIN c USING (feature) JOIN s USING (feature)")
def mad_outliers(spark: SparkSession, d: str) -> DataFrame:
    m = epochs(spark, d).groupBy("trial", "feature").agg(F.avg("v").alias("m"))
    return st.mask_outliers(m, ["feature"], "m").select("trial", "feature", "outlier")


@query(", g AS (SELECT DISTINCT trial, (trial % 11)::DOUBLE / 10 - 0.1 AS rt FROM e), l AS (SELECT trial, CASE WHEN rt <= 0 THEN NULL ELSE least(rt, 0.5) END AS rt FROM g) SELECT trial, feature, round(avg(CASE WHEN time_s BETWEEN -1e-12 AND rt + 1e-12 THEN v END), 6) AS activity FROM e JOIN l USING (trial) GROUP BY ALL")
def anchor_to_response_mean(spark: SparkSession, d: str) -> DataFrame:
    e = epochs(spark, d)
    r = e.select("trial").distinct().withColumn("rt", (F.col("trial") % 11).cast("double") / 10.0 - 0.1)
    return rounded(ep.activity_to_response(e, r, ["trial", "feature"], 0.5))


@query("SELECT trial, feature, t_idx, round(v - avg(CASE WHEN t_idx < 3 THEN v END) OVER (PARTITION BY trial, feature), 6) AS corrected FROM e")
def tf_baseline(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ep.baseline_db(epochs(spark, d), ["trial", "feature"], -0.25, 0.05), "trial", *CELL, "corrected")


@query(f", b AS (SELECT trial, feature, t_idx, v - avg(v) OVER (PARTITION BY trial, feature) AS v FROM e) SELECT feature, t_idx, {_ONE} FROM b GROUP BY ALL")
def tf_grand_average(spark: SparkSession, d: str) -> DataFrame:
    b = ep.baseline_db(epochs(spark, d), ["trial", "feature"], -9.0, 9.0).withColumn("v", F.col("corrected"))
    return rounded(st.one_sample_t(b, CELL))


@query(", m AS (SELECT trial, condition, feature, CASE WHEN count(v) = count(*) THEN avg(v) END AS v FROM e GROUP BY ALL)" + _AB.format(k="feature", src="m") + f"SELECT feature, round((ma - mb) / sqrt({_WELCH}), 6) AS t FROM s")
def single_bin_significance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.two_sample_t(ep.single_bin(epochs(spark, d), ["trial", "condition", "feature"]), ["feature"]), "feature", "t")


@query(_P + "SELECT label, feature, coalesce(sum((p < 0.3)::INT) * 0.1 * 1000 >= 250, FALSE) AS significant FROM p GROUP BY ALL")
def duration_significance(spark: SparkSession, d: str) -> DataFrame:
    p = _pseudo_p(spark, d).withColumns({"sig": F.col("p") < 0.3, "time_s": (F.col("t_idx") - 2) / F.lit(10.0)})
    return st.duration_significance(p, ["label", "feature"], "sig", "time_s", 250.0)


@query(_P + """, s AS (SELECT label, feature, t_idx, (CASE WHEN p * 1000 % 2 < 1 THEN 1 ELSE -1 END) AS sg, (1 - p) * CASE WHEN p * 1000 % 2 < 1 THEN 1 ELSE -1 END AS t FROM p WHERE p < 0.5),
 g AS (SELECT *, t_idx - row_number() OVER (PARTITION BY label, feature, sg ORDER BY t_idx) AS g FROM s)
 SELECT label, feature, sg::BIGINT AS sign, min(t_idx) AS start, max(t_idx) AS "end", round(sum(t), 6) AS t_sum FROM g GROUP BY label, feature, sg, g""")
def temporal_clusters(spark: SparkSession, d: str) -> DataFrame:
    p = _pseudo_p(spark, d).withColumn("t", (1 - F.col("p")) * F.when(F.col("p") * 1000 % 2 < 1, 1).otherwise(-1))
    return rounded(rs.temporal_clusters(p, ["label", "feature"], 0.5))


def _dealt(spark: SparkSession, d: str, n: int) -> DataFrame:
    trials = epochs(spark, d).select("trial", "condition").distinct()
    return rs.shuffled_labels(trials, n, order=F.pmod((F.col("trial") + 1) * (F.col("perm") * 7919 + 104729), F.lit(99991)))


_DEAL = """, t AS (SELECT DISTINCT trial, condition FROM e), q AS (SELECT trial, condition, perm::BIGINT AS perm FROM t, range({n}) AS g(perm)),
 o AS (SELECT perm, condition, row_number() OVER (PARTITION BY perm ORDER BY trial) AS k FROM q),
 w AS (SELECT perm, trial, row_number() OVER (PARTITION BY perm ORDER BY (trial + 1) * (perm * 7919 + 104729) % 99991, trial) AS k FROM q),
 dealt AS (SELECT w.perm, w.trial, o.condition FROM w JOIN o USING (perm, k)), pe AS (SELECT perm, trial, dealt.condition, feature, t_idx, v, x FROM dealt JOIN e USING (trial))"""


@query(_DEAL.format(n=5) + _AB.format(k="perm, feature, t_idx", src="pe") + f"SELECT perm, feature, t_idx, round((ma - mb) / sqrt({_WELCH}), 6) AS t FROM s")
def perm_t_maps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.two_sample_t(rs.permuted(epochs(spark, d), _dealt(spark, d, 5)), ["perm", *CELL]), "perm", *CELL, "t")


@query(""", t AS (SELECT DISTINCT trial, x FROM e), q AS (SELECT trial, x, perm::BIGINT AS perm FROM t, range(5) AS g(perm)),
 o AS (SELECT perm, x, row_number() OVER (PARTITION BY perm ORDER BY trial) AS k FROM q),
 w AS (SELECT perm, trial, row_number() OVER (PARTITION BY perm ORDER BY (trial + 1) * (perm * 7919 + 104729) % 99991, trial) AS k FROM q),
 pe AS (SELECT w.perm, feature, t_idx, v, o.x FROM w JOIN o USING (perm, k) JOIN e USING (trial))
 SELECT perm, feature, t_idx, round(covar_pop(x, v) / var_pop(x) FILTER (v IS NOT NULL), 6) AS slope FROM pe GROUP BY ALL""")
def perm_slopes(spark: SparkSession, d: str) -> DataFrame:
    e = epochs(spark, d)
    order = F.pmod((F.col("trial") + 1) * (F.col("perm") * 7919 + 104729), F.lit(99991))
    dealt = rs.shuffled_labels(e.select("trial", "x").distinct(), 5, condition="x", order=order)
    return rounded(st.regression(rs.permuted(e, dealt, condition="x"), ["perm", *CELL]), "perm", *CELL, "slope")


@query(""", t AS (SELECT DISTINCT trial, condition FROM e), m AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY trial) - 1 AS k, count(*) OVER (PARTITION BY condition) AS n FROM t),
 d AS (SELECT boot::BIGINT AS boot, condition, (k * (boot * 31 + 17) + boot * boot + 5) % n AS k FROM m, range(20) AS g(boot)),
 c AS (SELECT boot, condition, trial FROM d JOIN m USING (condition, k)),
 z AS (SELECT boot, feature, avg(v) FILTER (c.condition = 'A') - avg(v) FILTER (c.condition = 'B') AS df FROM c JOIN e USING (trial) GROUP BY ALL)
 SELECT feature, round(quantile_cont(df, 0.025), 6) AS ci_low, round(quantile_cont(df, 0.975), 6) AS ci_high FROM z GROUP BY ALL""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    draw = (F.col("_k") * (F.col("boot") * 31 + 17) + F.col("boot") * F.col("boot") + 5) % F.col("_n")
    return rounded(rs.bootstrap_interval(epochs(spark, d), 20, ["feature"], draw=draw))


@query(_P + ", n AS (SELECT feature, (p - 0.5) * 20 AS x FROM p WHERE label < 5), o AS (SELECT label, feature, sum(1 - p) AS t_sum FROM p GROUP BY ALL) SELECT label, feature, round((sum((abs(x) >= abs(t_sum))::INT) + 1)::DOUBLE / (count(*) + 1), 6) AS p_cluster FROM o JOIN n USING (feature) GROUP BY label, feature, t_sum")
def cluster_pvalue(spark: SparkSession, d: str) -> DataFrame:
    p = _pseudo_p(spark, d)
    null = p.where("label < 5").select("feature", ((F.col("p") - 0.5) * 20).alias("null"))
    observed = p.groupBy("label", "feature").agg(F.sum(1 - F.col("p")).alias("t_sum"))
    return rounded(rs.cluster_pvalue(observed, null, ["feature"]), "label", "feature", "p_cluster")


@query()
def signflip_null(spark: SparkSession, d: str) -> DataFrame:
    flips = rs.sign_flips(epochs(spark, d), 5, "trial").withColumn("v", F.col("v") * F.col("sign"))
    return rounded(st.one_sample_t(flips, ["perm", *CELL]), "perm", *CELL, "t")


@query(_P + ", n AS (SELECT a.label, a.feature, a.t_idx, a.p, max(b.p) AS m, count(*) AS c FROM p a JOIN p b ON a.label = b.label AND abs(a.feature - b.feature) <= 1 AND abs(a.t_idx - b.t_idx) <= 1 GROUP BY ALL) SELECT label, feature, t_idx, round(p, 6) AS p FROM n WHERE c = 9 AND p >= m AND p > 0")
def local_maxima(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rs.local_maxima(_pseudo_p(spark, d), ["label"], "feature", "t_idx", "p"), "label", *CELL, "p")


@query()
def tf_clusters(spark: SparkSession, d: str) -> DataFrame:
    p = _pseudo_p(spark, d).withColumn("t", 1 - F.col("p"))
    return rounded(rs.grid_clusters(p, "label", 0.4, "feature", "t_idx"))


#: Cells that a cell reaches, and of these the first: a number for each part.
SQL["tf_clusters"] = f"""WITH RECURSIVE {EPOCHS} {_P}, m AS (SELECT label, feature AS f, t_idx AS t, p FROM p WHERE p <= 0.4),
 r AS (SELECT label, f, t, f * 8 + t AS root FROM m UNION SELECT m.label, m.f, m.t, r.root FROM r JOIN m ON m.label = r.label AND abs(m.f - r.f) <= 1 AND abs(m.t - r.t) <= 1),
 k AS (SELECT label, f, t, min(root) AS root FROM r GROUP BY ALL)
 SELECT k.label, count(*) AS n_cells, round(sum(1 - p), 6) AS t_sum FROM k JOIN m ON k.label = m.label AND k.f = m.f AND k.t = m.t GROUP BY k.label, root"""


@query(""", t AS (SELECT trial, any_value(x) AS x, avg(v) AS y FROM e GROUP BY trial),
 b AS (SELECT i, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3, min(x) AS q0, max(x) AS q4 FROM t, range(4) AS g(i) GROUP BY i)
 SELECT i AS bin, round(avg(y), 6) AS mean, count(y) AS n FROM t, b WHERE x BETWEEN [q0, q1, q2, q3, q4][i + 1] AND [q0, q1, q2, q3, q4][i + 2] GROUP BY i""")
def quantile_scatter(spark: SparkSession, d: str) -> DataFrame:
    """Both edges of a bin are in it, so a trial on an edge is in two bins."""
    t = epochs(spark, d).groupBy("trial").agg(F.any_value("x").alias("x"), F.avg("v").alias("y"))
    edges = t.agg(F.percentile("x", F.array(*(F.lit(i * 0.25) for i in range(5)))).alias("_q")).withColumn("_k", F.lit(1))
    rows = t.join(F.broadcast(edges), F.lit(1) == F.col("_k")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(3))))
    rows = rows.where(F.col("x").between(F.get("_q", F.col("bin")), F.get("_q", F.col("bin") + 1)))
    return rounded(rows.groupBy("bin").agg(F.avg("y").alias("mean"), F.count("y").alias("n")))


@query("SELECT c_nationkey::BIGINT AS nation, c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY GROUPING SETS ((c_nationkey, c_mktsegment), (c_nationkey), ())")
def subtotal_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    return rounded(c.rollup("nation", "segment").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean")))

