"""Epochs: cutting them out of signals, binning, smoothing, normalising and quality control, over long tables (trial, feature, t_idx, v)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_even

Keys = Sequence[str]


def window_samples(fs: float, ms: Column | float) -> Column:
    """Samples of a window, one at least."""
    ms = ms if isinstance(ms, Column) else F.lit(ms)
    return F.greatest(F.lit(1), half_even(ms / 1000.0 * fs).cast("int"))


def time_axis(fs: float, tmin: float, tmax: float) -> Column:
    """Times of an epoch's samples, both ends included, as an array."""
    first = half_even(F.lit(tmin * fs)).cast("int")
    n = half_even(F.lit((tmax - tmin) * fs)).cast("int")
    return F.transform(F.sequence(first, first + n), lambda i: i / F.lit(float(fs)))


def extract(signal: DataFrame, anchors: DataFrame, first: int, last: int, recording: str = "recording", trial: str = "trial") -> DataFrame:
    """Samples anchor + first .. anchor + last of each anchor, as t_idx; anchors whose epoch is not whole are left out.

    The join is on (recording, block of samples): blocks are as long as an epoch, so an epoch touches two.
    """
    size = last - first + 1
    block = F.floor((F.col("anchor_sample") + first) / size)
    a = anchors.select(recording, trial, "anchor_sample").withColumn("_b", F.explode(F.array(block, block + 1)))
    s = signal.withColumn("_b", F.floor(F.col("sample") / size))
    cut = s.join(a, [recording, "_b"]).withColumn("t_idx", (F.col("sample") - F.col("anchor_sample") - first).cast("int")).where(F.col("t_idx").between(0, size - 1)).drop("_b", "sample")
    whole = F.count(F.lit(1)).over(Window.partitionBy(recording, trial, *(c for c in cut.columns if c == "channel")))
    return cut.withColumn("_n", whole).where(F.col("_n") == size).drop("_n")


def bin_by_samples(df: DataFrame, by: Keys, width: int, n_times: int, time: str = "t_idx", value: str = "v") -> DataFrame:
    """Means over bins of ``width`` samples; a last bin of one sample joins the one before."""
    last = (n_times - 1) // width
    if n_times > width and n_times % width == 1:
        last -= 1
    b = F.least(F.floor(F.col(time) / width), F.lit(last)).cast("int")
    return df.withColumn("bin", b).groupBy(*by, "bin").agg(F.avg(value).alias("v"), F.avg(F.col(time).cast("double")).alias("bin_time"))


def bin_by_count(df: DataFrame, by: Keys, bins: int, n_times: int, time: str = "t_idx", value: str = "v") -> DataFrame:
    """Means over ``bins`` bins, of which bin i begins at i * n_times // bins."""
    b = F.expr(f"int(((int({time}) + 1) * {bins} - 1) DIV {n_times})")
    return df.withColumn("bin", b).groupBy(*by, "bin").agg(F.avg(value).alias("v"), F.avg(F.col(time).cast("double")).alias("bin_time"))


def moving_average(df: DataFrame, by: Keys, width: int, time: str = "t_idx", value: str = "v") -> DataFrame:
    """Centred sums over ``width`` samples divided by ``width``, also where an edge leaves fewer; 1 or less changes nothing."""
    if width <= 1:
        return df.withColumn("smooth", F.col(value))
    half = width // 2
    w = Window.partitionBy(*by).orderBy(time)
    n, i = F.count(F.lit(1)).over(Window.partitionBy(*by)), F.row_number().over(w) - 1
    # The head reaches one sample further back than the interior's frame, which begins half - 1 before.
    inner = F.sum(value).over(w.rowsBetween(-(half - 1), half))
    head = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, half))
    tail = F.sum(value).over(w.rowsBetween(-(half - 1), Window.unboundedFollowing))
    return df.withColumn("smooth", F.when(i <= half, head).when(i >= n - half, tail).otherwise(inner) / width)


def same_convolution(df: DataFrame, by: Keys, width: int, time: str = "t_idx", value: str = "v") -> DataFrame:
    """Convolution with ``width`` equal weights, of the signal's own length, zeros beyond its ends."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(-(width - 1 - width // 2), width // 2)
    return df.withColumn("smooth", F.sum(value).over(w) / width)


def normalise(df: DataFrame, by: Keys, mode: str = "percent", time: str = "t_idx", value: str = "v") -> DataFrame:
    """Each series by the mean of its middle half: in percent of it (0 counts as 1), or in dB to it."""
    n, i = F.count(F.lit(1)).over(Window.partitionBy(*by)), F.row_number().over(Window.partitionBy(*by).orderBy(time)) - 1
    rows = df.withColumns({"_i": i, "_q": half_even(n / 4.0)})
    base = F.avg(F.when((F.col("_i") >= F.col("_q")) & (F.col("_i") < 3 * F.col("_q")), F.col(value))).over(Window.partitionBy(*by))
    if mode == "percent":
        out = F.col(value) / F.when(base == 0, F.lit(1.0)).otherwise(base) * 100
    else:
        out = 20 * F.log10(F.greatest(F.col(value), F.lit(1e-10)) / F.greatest(base, F.lit(1e-10)))
    return rows.withColumn("norm", out).drop("_i", "_q")


def mask_trials(df: DataFrame, feature: str = "feature", trial: str = "trial", value: str = "v", by: str = "mean", factor: float = 3.0, subject: Keys = ()) -> DataFrame:
    """``masked``: (subject, trial, feature) whose mean (or largest absolute value) is over ``factor`` deviations from the mean of them of the subject's feature."""
    summary = F.avg(value) if by == "mean" else F.max(F.abs(value))
    s = df.groupBy(*subject, trial, feature).agg(summary.alias("summary"))
    ref = s.groupBy(*subject, feature).agg(F.avg("summary").alias("_m"), F.stddev_samp("summary").alias("_s"))
    far = (F.col("_s") > 0) & (F.abs(F.col("summary") - F.col("_m")) > factor * F.col("_s"))
    return s.join(ref, [*subject, feature]).select(*subject, trial, feature, "summary", F.coalesce(far, F.lit(False)).alias("masked"))


def apply_mask(df: DataFrame, mask: DataFrame, keys: Keys, value: str = "v") -> DataFrame:
    """Values of masked (trial, feature) become missing."""
    m = mask.where("masked").select(*keys, F.lit(True).alias("_x"))
    return df.join(m, list(keys), "left").withColumn(value, F.when(F.col("_x").isNull(), F.col(value))).drop("_x")


def spread_outliers(df: DataFrame, feature: str = "feature", trial: str = "trial", value: str = "v", by: str = "mean", factor: float = 1.0, subject: Keys = ()) -> DataFrame:
    """Features whose spread of trial means (or of largest values) over trials is ``factor`` deviations from the mean spread of the (subject's) features."""
    summary = F.avg(value) if by == "mean" else F.max(value)
    spread = df.groupBy(*subject, feature, trial).agg(summary.alias("_s")).groupBy(*subject, feature).agg(F.stddev_samp("_s").alias("spread"))
    # A window over a subject's features, which are few against values.
    w = Window.partitionBy(*subject)
    m, d, n = F.avg("spread").over(w), F.stddev_samp("spread").over(w), F.count("spread").over(w)
    far = (n >= 2) & (d > 0) & (F.abs(F.col("spread") - m) > factor * d)
    return spread.select(*subject, feature, "spread", F.coalesce(far, F.lit(False)).alias("excluded"))


def missing_ratio(df: DataFrame, feature: str = "feature", trial: str = "trial", value: str = "v", most: float = 0.5, subject: Keys = ()) -> DataFrame:
    """Features (of a subject) with a share of trials with any missing sample of ``most`` or more."""
    any_missing = df.groupBy(*subject, feature, trial).agg(F.max(F.col(value).isNull().cast("int")).alias("_x"))
    return any_missing.groupBy(*subject, feature).agg(F.avg("_x").alias("ratio")).withColumn("excluded", F.col("ratio") >= most)


def activity_to_response(df: DataFrame, responses: DataFrame, by: Keys, tmax: float, time: str = "time_s", value: str = "v", clamp: bool = True, trial: str = "trial") -> DataFrame:
    """Mean from 0 to the trial's response time. Later responses count as tmax (or leave nothing); none, or one at 0 or before, leaves nothing."""
    rt = F.col("rt")
    limit = F.when(rt <= 0, None).when(rt > tmax, F.lit(tmax) if clamp else F.lit(None).cast("double")).otherwise(rt)
    rows = df.join(responses.select(trial, limit.alias("_rt")), trial, "left")
    inside = F.col(time).between(-1e-12, F.col("_rt") + 1e-12)
    return rows.groupBy(*by).agg(F.avg(F.when(inside, F.col(value))).alias("activity"))


def baseline_db(df: DataFrame, by: Keys, t0: float, t1: float, time: str = "time_s", value: str = "v") -> DataFrame:
    """Values less their series' mean over the baseline window."""
    base = F.avg(F.when(F.col(time).between(t0, t1), F.col(value))).over(Window.partitionBy(*by))
    return df.withColumn("corrected", F.col(value) - base)


def single_bin(df: DataFrame, by: Keys, value: str = "v") -> DataFrame:
    """Plain mean over time: missing if any sample is."""
    whole = F.count(value) == F.count(F.lit(1))
    return df.groupBy(*by).agg(F.when(whole, F.avg(value)).alias("v"))



def time_window(df: DataFrame, t0: float, t1: float, selection: str = "inclusive", time: str = "time_s") -> DataFrame:
    """Samples from t0 to t1, ends included or (``strict``) not."""
    if selection not in ("inclusive", "strict"):
        raise ValueError(f"unknown selection: {selection}")
    t = F.col(time)
    return df.where(t.between(t0, t1) if selection == "inclusive" else (t > t0) & (t < t1))


def region_means(df: DataFrame, by: Keys, value: str = "v") -> DataFrame:
    """Mean of a region's channels; missing if one of them is."""
    return single_bin(df, by, value)


def decimate(samples: Column, factor: int) -> Column:
    """Every ``factor``-th sample of an array."""
    return F.filter(samples, lambda x, i: i % factor == 0)


def demean(samples: Column) -> Column:
    """An array less its mean."""
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x) / F.size(samples)
    return F.element_at(F.transform(F.array(mean), lambda m: F.transform(samples, lambda x: x - m)), 1)


def power_mode(df: DataFrame, mode: str, stored_corrected: bool, value: str = "v", baseline: str = "baseline_db") -> DataFrame:
    """Power as stored, without its baseline correction, or with it, whichever way it is stored."""
    v, b = F.col(value), F.col(baseline)
    out = {"stored": v, "raw": v + b if stored_corrected else v, "baseline_corrected": v if stored_corrected else v - b}
    if mode not in out:
        raise ValueError(f"unknown power mode: {mode}")
    return df.withColumn("power", out[mode])


def union_runs(runs: list[DataFrame], facts: Keys = ("fs",)) -> DataFrame:
    """Epochs of runs as one table, with their number; a query over runs that differ in ``facts`` fails."""
    out = None
    for i, run in enumerate(runs):
        part = run.withColumn("run_idx", F.lit(i))
        out = part if out is None else out.unionByName(part)
    ends = out.agg(*(F.count_distinct(f).alias(f) for f in facts)).first()
    if any(ends[f] > 1 for f in facts):
        raise ValueError(f"runs differ in {', '.join(f for f in facts if ends[f] > 1)}")
    return out
