"""Statistics over long tables: one row per trial (or contribution), cell and value; NULL is missing.

A cell is named by ``keys`` (feature, time, frequency ...). All of these are plain grouped aggregates, so Spark sums partially before it shuffles,
and what crosses the network is a row per cell and task, not per value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import divide, scale_or_one
from ..functions.tdist import t_pvalue, t_quantile_975

Keys = Sequence[str]


def _sem(sd: Column, n: Column) -> Column:
    return F.when(n >= 2, sd / F.sqrt(n.cast("double")))


def condition_mean_sem(df: DataFrame, keys: Keys, value: str = "v", condition: str = "condition") -> DataFrame:
    """Mean and error by condition and cell. The error divides by all trials, missing ones too."""
    n = F.count(F.lit(1))
    return df.groupBy(condition, *keys).agg(F.avg(value).alias("mean"), _sem(F.stddev_samp(value), n).alias("sem"), n.alias("n_trials"))


def group_sem(df: DataFrame, keys: Keys, value: str = "v") -> DataFrame:
    """Mean and error by cell; the error divides by the values there are."""
    n = F.count(value)
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), _sem(F.stddev_samp(value), n).alias("sem"), n.alias("n_obs"))


def _sides(value: str, condition: str, a: str, b: str) -> list[Column]:
    out = []
    for name, label in (("a", a), ("b", b)):
        v = F.when(F.col(condition) == label, F.col(value))
        out += [F.avg(v).alias(f"mean_{name}"), F.var_samp(v).alias(f"_v{name}"), F.count(v).alias(f"n_{name}")]
    return out


def two_sample_t(df: DataFrame, keys: Keys, a: str = "A", b: str = "B", value: str = "v", condition: str = "condition", equal_var: bool = False, p: bool = False) -> DataFrame:
    """Difference of two conditions by cell: means, t and degrees of freedom (Welch, or pooled). Means stay where t is undefined."""
    s = df.groupBy(*keys).agg(*_sides(value, condition, a, b))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    if equal_var:
        dof = na + nb - 2
        pooled = divide((na - 1) * F.col("_va") + (nb - 1) * F.col("_vb"), dof)
        se2 = pooled * (divide(F.lit(1.0), na) + divide(F.lit(1.0), nb))
    else:
        qa, qb = divide("_va", na), divide("_vb", nb)
        se2 = qa + qb
        dof = divide(se2 * se2, divide(qa * qa, na - 1) + divide(qb * qb, nb - 1))
    enough = (na >= 2) & (nb >= 2)
    out = s.select(
        *keys, "mean_a", "mean_b", "n_a", "n_b", (F.col("mean_a") - F.col("mean_b")).alias("diff"),
        F.when(enough, divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(se2))).alias("t"), F.when(enough, dof).alias("df"), F.when(enough, F.sqrt(se2)).alias("se"),
    )
    return out.withColumn("p", t_pvalue("t", "df")) if p else out


def difference_ci95(df: DataFrame, keys: Keys, **options) -> DataFrame:
    """Analytic 95 % interval of the difference."""
    t = two_sample_t(df, keys, **options)
    half = t_quantile_975("df") * F.col("se")
    return t.withColumns({"ci_low": F.col("diff") - half, "ci_high": F.col("diff") + half})


def one_sample_t(df: DataFrame, keys: Keys, value: str = "v", p: bool = False) -> DataFrame:
    """Mean against 0 by cell; two values at least."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"), F.count(value).alias("n_obs"))
    sem = _sem(F.col("_sd"), F.col("n_obs"))
    out = s.select(*keys, "mean", sem.alias("sem"), "n_obs", divide("mean", sem).alias("t"), (F.col("n_obs") - 1).cast("double").alias("df"))
    return out.withColumn("p", t_pvalue("t", "df")) if p else out


def row_means(df: DataFrame, row: Keys, value: str = "v") -> DataFrame:
    """One mean per row (trial, contribution) over its cells."""
    return df.groupBy(*row).agg(F.avg(value).alias("v"))


def paired_t(df: DataFrame, unit: str, keys: Keys, a: str = "A", b: str = "B", value: str = "v", condition: str = "condition", p: bool = False) -> DataFrame:
    """One-sample t of A less B over units that have both. Units are paired by grouping, not by a self join."""
    sides = df.groupBy(unit, *keys).agg(*(F.avg(F.when(F.col(condition) == x, F.col(value))).alias(n) for n, x in (("_a", a), ("_b", b))))
    return one_sample_t(sides.withColumn("v", F.col("_a") - F.col("_b")), keys, p=p)


def regression(df: DataFrame, keys: Keys, x: str = "x", y: str = "v", policy: str = "pointwise", trial: str = "trial", feature: str = "feature", time: str = "t_idx", p: bool = False, by: Keys = ()) -> DataFrame:
    """Least-squares line by cell: slope, intercept, r, t and the number of trials.

    ``dense``: a cell with any missing value has no line. ``pointwise``: missing values are left out cell by cell. ``feature_time0``: a trial is
    left out of a feature if its first sample is missing; any other missing value leaves its cell without a line. Three trials and a varying x
    are needed (pointwise: a varying y too). ``by``: whose trials they are, if several subjects number theirs alike.
    """
    rows = df
    if policy == "feature_time0":
        first = F.first(y).over(Window.partitionBy(*by, trial, feature).orderBy(time))
        rows = df.withColumn("_first", first).where(F.col("_first").isNotNull())
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs, ys = F.when(both, F.col(x)), F.when(both, F.col(y))
    s = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_all"), F.count(xs).alias("n_obs"), F.avg(xs).alias("_mx"), F.avg(ys).alias("_my"),
        F.var_pop(xs).alias("_vx"), F.var_pop(ys).alias("_vy"), F.covar_pop(xs, ys).alias("_c"),
    )
    ok = (F.col("n_obs") >= 3) & (F.col("_vx") > 0)
    ok = ok & (F.col("_vy") > 0) if policy == "pointwise" else ok & (F.col("n_obs") == F.col("_all"))
    slope = divide("_c", "_vx")
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), divide("_c", F.sqrt(F.col("_vx") * F.col("_vy")))))
    out = s.select(*keys, "n_obs", F.when(ok, slope).alias("slope"), F.when(ok, F.col("_my") - slope * F.col("_mx")).alias("intercept"), F.when(ok, r).alias("r"))
    out = out.withColumn("t", r_to_t(F.col("r"), F.col("n_obs")))
    if p:
        out = out.withColumn("p", F.when(F.abs("r") == 1, F.lit(0.0)).otherwise(t_pvalue("t", (F.col("n_obs") - 2).cast("double"))))
    return out


def r_to_t(r: Column, n: Column) -> Column:
    """t of a correlation; infinite where |r| is 1."""
    plain = r * F.sqrt(F.try_divide((n - 2).cast("double"), 1 - r * r))
    return F.when(F.abs(r) >= 1, F.when(r > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(plain)


def bonferroni(df: DataFrame, p: str = "p", by: Keys = ()) -> DataFrame:
    """p times the number of known p of the map, 1 at most."""
    m = df.groupBy(*by).agg(F.count(p).alias("_m"))
    out = df.join(m, list(by)) if by else df.join(F.broadcast(m.withColumn("_k", F.lit(1))), F.lit(1) == F.col("_k")).drop("_k")
    return out.withColumn("p_corr", F.when(F.col(p).isNotNull(), F.least(F.col(p) * F.col("_m"), F.lit(1.0)))).drop("_m")


def benjamini_hochberg(df: DataFrame, p: str = "p", by: Keys = ()) -> DataFrame:
    """False-discovery-rate step-up over all known p of each map (``by``: what names a map, one task per map)."""
    m, known = df, df.where(F.col(p).isNotNull())
    up = Window.partitionBy(*by).orderBy(p)
    down = Window.partitionBy(*by).orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, 0)
    ranked = known.withColumn("_r", F.rank().over(up) + F.count(F.lit(1)).over(Window.partitionBy(*by, p)) - 1).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    ranked = ranked.withColumn("p_corr", F.least(F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down), F.lit(1.0))).drop("_r", "_m")
    return ranked.unionByName(m.where(F.col(p).isNull()).withColumn("p_corr", F.lit(None).cast("double")))


def zscore(df: DataFrame, by: Keys, value: str = "v", baseline: Column | None = None, least: int = 1, zero: str = "one") -> DataFrame:
    """Values against mean and spread of their group, or of its ``baseline`` rows. Zero or unknown spread is 1, or makes the value missing (``zero="null"``)."""
    w = Window.partitionBy(*by)
    base = F.col(value) if baseline is None else F.when(baseline, F.col(value))
    mean, sd, n = F.avg(base).over(w), F.stddev_samp(base).over(w), F.count(base).over(w)
    sd = scale_or_one(sd) if zero == "one" else F.when(sd > 0, sd)
    return df.withColumn("z", F.when(n >= least, (F.col(value) - mean) / sd))


def zscore_by_trial_means(df: DataFrame, by: Keys, baseline: Column, trial: str = "trial", value: str = "v", outliers: str | None = None) -> DataFrame:
    """Values against the distribution of the trials' baseline means in their group (``by``), optionally without outlying trials."""
    means = df.where(baseline).groupBy(trial, *by).agg(F.avg(value).alias("_m"))
    if outliers:
        means = mask_outliers(means, by, "_m", outliers).where(~F.col("outlier"))
    ref = means.groupBy(*by).agg(F.avg("_m").alias("_mean"), scale_or_one(F.stddev_samp("_m")).alias("_sd"))
    return df.join(ref, list(by), "left").withColumn("z", (F.col(value) - F.col("_mean")) / F.col("_sd")).drop("_mean", "_sd")


def mask_outliers(df: DataFrame, by: Keys, value: str, method: str = "median_mad") -> DataFrame:
    """``outlier``: over 3 scaled median deviations from the median, or over 3 deviations from the mean. Three values at least; no spread, no outliers."""
    v = F.col(value)
    if method == "mean":
        ref = df.groupBy(*by).agg(F.avg(value).alias("_c"), F.stddev_samp(value).alias("_s"), F.count(value).alias("_n"))
    else:
        mid = df.groupBy(*by).agg(F.median(value).alias("_c"))
        away = df.join(mid, list(by)).withColumn("_d", F.abs(v - F.col("_c")))
        ref = away.groupBy(*by).agg(F.first("_c").alias("_c"), (1.4826 * F.median("_d")).alias("_s"), F.count(value).alias("_n"))
    far = (F.col("_n") >= 3) & (F.col("_s") > 0) & (F.abs(v - F.col("_c")) > 3 * F.col("_s"))
    return df.join(ref, list(by)).withColumn("outlier", F.coalesce(far, F.lit(False))).drop("_c", "_s", "_n")


def duration_significance(df: DataFrame, by: Keys, significant: str, time: str, threshold_ms: float) -> DataFrame:
    """Whether the samples marked significant add up to the threshold; the step is that of the first two samples."""
    times = F.array_sort(F.collect_set(time))
    s = df.groupBy(*by).agg(F.sum(F.col(significant).cast("int")).alias("_n"), times.alias("_t"))
    step = F.try_element_at("_t", F.lit(2)) - F.try_element_at("_t", F.lit(1))
    return s.select(*by, F.coalesce(F.col("_n") * step * 1000 >= threshold_ms, F.lit(False)).alias("significant"))
