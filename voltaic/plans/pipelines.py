"""The documented analyses as plans: from epochs or arrays to tables of results.

Each is a function of DataFrames; nothing runs before a result is written. ``options`` are plain keyword arguments.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dsp, group_tests, groups, resample, stats
from ..operators import epochs as ep

CELL = ("feature", "t_idx")


def correct(df: DataFrame, method: str, by: Sequence[str] = ()) -> DataFrame:
    """``p_corr`` by ``none``, ``bonferroni`` or ``fdr`` over each map."""
    if method == "none":
        return df.withColumn("p_corr", F.col("p"))
    if method not in ("bonferroni", "fdr"):
        raise ValueError(f"unknown correction: {method}")
    return (stats.bonferroni if method == "bonferroni" else stats.benjamini_hochberg)(df, "p", by)


def significant(df: DataFrame, alpha: float) -> DataFrame:
    return df.withColumn("significant", F.coalesce(F.col("p_corr") < alpha, F.lit(False)))


def envelope(signals: DataFrame, samples: str = "samples", **options) -> DataFrame:
    """Band envelopes of continuous signals, an array per row."""
    return dsp.map_arrays(signals, samples, "envelope", lambda x: dsp.band_envelope(x, **options))


def time_frequency(epochs: DataFrame, samples: str = "samples", frequencies: Sequence[float] = (), **options) -> DataFrame:
    """Multitaper power of epochs as rows (f_idx, frequency, step, power_db); windows that leave the epoch are missing."""
    wanted = list(frequencies)
    out = dsp.map_arrays(epochs, samples, "_p", lambda x: dsp.multitaper_db(x, frequencies=wanted, **options).reshape(-1)).drop(samples)
    rows = out.select(*(c for c in out.columns if c != "_p"), F.size("_p").alias("_n"), F.posexplode("_p").alias("_i", "v"))
    per = F.expr(f"int(_n DIV {len(wanted)})")
    rows = rows.withColumns({"f_idx": F.expr(f"int(_i DIV int(_n DIV {len(wanted)}))"), "t_idx": F.col("_i") % per, "v": F.when(~F.isnan("v"), F.col("v"))})
    return rows.withColumn("frequency", F.get(F.array(*(F.lit(float(f)) for f in wanted)), F.col("f_idx"))).drop("_n", "_i")


def clean_epochs(epochs: DataFrame, mean_factor: float | None = 3.0, max_factor: float | None = 3.0, spread_factor: float | None = None, most_missing: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Quality control in order: trials' outlying means, then largest values, then features by spread and by missing trials. Each subject (``by``) is judged by its own trials."""
    out, by = epochs, list(by)
    for factor, summary in ((mean_factor, "mean"), (max_factor, "max")):
        if factor:
            out = ep.apply_mask(out, ep.mask_trials(out, by=summary, factor=factor, subject=by), [*by, "trial", "feature"])
    bad = ([ep.spread_outliers(out, factor=spread_factor, subject=by)] if spread_factor else []) + ([ep.missing_ratio(out, most=most_missing, subject=by)] if most_missing else [])
    for b in bad:
        out = out.join(b.where("excluded").select(*by, "feature"), [*by, "feature"], "left_anti")
    return out


def condition_test(epochs: DataFrame, a: str = "A", b: str = "B", baseline: tuple[float, float] | None = None, scope: str = "condition", correction: str = "fdr", alpha: float = 0.05, equal_var: bool = False, keys: Sequence[str] = CELL, by: Sequence[str] = (), unit: str | None = None) -> DataFrame:
    """Two conditions by cell: means, difference with its interval, t, p, corrected p. ``scope`` of the baseline: trial, condition or global.

    ``by`` names a subject (or a recording): baselines, tests and corrections are each subject's own, in one plan over all of them; trials may have the same numbers in
    several. With ``unit`` the test is paired: A less B over the units that have both.
    """
    rows, by = epochs, list(by)
    if baseline:
        inside = F.col("time_s").between(*baseline)
        if scope == "trial":
            rows = stats.zscore(rows, [*by, "trial", "feature"], baseline=inside)
        else:
            rows = stats.zscore_by_trial_means(rows, [*by, "condition", "feature"] if scope == "condition" else [*by, "feature"], inside)
        rows = rows.withColumn("v", F.col("z"))
    if unit:
        t = stats.paired_t(rows, unit, [*by, *keys], a=a, b=b)
    else:
        t = stats.difference_ci95(rows, [*by, *keys], a=a, b=b, equal_var=equal_var)
    return significant(correct(t.withColumn("p", stats.t_pvalue("t", "df")), correction, by), alpha)


def against_zero(epochs: DataFrame, correction: str = "fdr", alpha: float = 0.05, keys: Sequence[str] = CELL, by: Sequence[str] = ()) -> DataFrame:
    """Each condition's mean against 0 by cell, corrected over each condition's map (of each subject)."""
    return significant(correct(stats.one_sample_t(epochs, [*by, "condition", *keys], p=True), correction, [*by, "condition"]), alpha)


def regression_test(epochs: DataFrame, policy: str = "feature_time0", correction: str = "fdr", alpha: float = 0.05, zscore_x: bool = False, keys: Sequence[str] = CELL, by: Sequence[str] = ()) -> DataFrame:
    """A line on the predictor x for each condition and cell, corrected over each condition's map (of each subject, by the columns ``by``, which may be none of the cell's)."""
    rows, by = epochs, list(by)
    if zscore_x:
        x = stats.zscore(epochs.select(*by, "trial", "condition", F.col("x").alias("v")).distinct(), [*by, "condition"], least=3, zero="null")
        rows = epochs.drop("x").join(x.select(*by, "trial", F.col("z").alias("x")), [*by, "trial"])
    fits = stats.regression(rows, [*by, "condition", *keys], policy=policy, p=True, by=by)
    return significant(correct(fits, correction, [*by, "condition"]), alpha)


def contributions(results: DataFrame, region_map: DataFrame, value: str) -> DataFrame:
    """(roi, subject, channel, t_idx, v) of the channels that the map names; channels that no result has are skipped."""
    return results.join(region_map, ["subject", "channel"]).select("roi", "subject", "channel", "t_idx", F.col(value).alias("v"))


def group_test(rows: DataFrame, method: str = "fdr", min_channels: int = 1, min_subjects: int = 1, n_iter: int = 1000, alpha: float = 0.05, perms: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Regions against 0 over time. ``method``: a correction of samples over the whole (roi, time) map, or ``cluster`` with stored permutations or sign flips.

    ``by``: contrasts (or other analyses) that have thresholds, maps, nulls and corrections of their own.
    """
    by = list(by)
    rows = rows.withColumn("_roi", F.struct(*by, "roi"))
    keep = groups.region_thresholds(rows, min_channels, min_subjects, region="_roi").where("excluded is null").select("_roi")
    rows = rows.join(keep, "_roi", "left_semi")
    if method != "cluster":
        return significant(correct(stats.one_sample_t(rows.drop("_roi"), [*by, "roi", "t_idx"], p=True), method, by), alpha)
    if perms is not None:
        null = group_tests.null_of_permutations(perms.withColumn("_roi", F.struct(*by, "roi")).join(keep, "_roi", "left_semi"), n_iter, alpha, "_roi")
    else:
        null = group_tests.null_of_sign_flips(rows, n_iter, alpha, "_roi")
    found = group_tests.cluster_test(rows, null, alpha, roi="_roi").withColumn("significant", F.col("p_cluster") < alpha)
    return found.select(*(F.col("_roi")[c].alias(c) for c in (*by, "roi")), *(c for c in found.columns if c != "_roi"))


def permutation_maps(epochs: DataFrame, n_perm: int, keys: Sequence[str] = CELL, by: Sequence[str] = ()) -> DataFrame:
    """t maps of dealt labels (of each subject, ``by``), to be stored beside a subject's result for the group's null."""
    by = list(by)
    dealt = resample.shuffled_labels(epochs.select(*by, "trial", "condition").distinct(), n_perm, by=by)
    return stats.two_sample_t(resample.permuted(epochs, dealt, by=by), [*by, "perm", *keys]).select(*by, "perm", *keys, F.col("t").alias("v"))


def run(inputs: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Steps of one's own, in order."""
    for step in steps:
        inputs = inputs.transform(step)
    return inputs
