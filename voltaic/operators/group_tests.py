"""Cluster tests over contributions of regions.

Contributions are rows (roi, subject, channel, t_idx, v); stored permutations have a column perm besides. Null iterations are made inside tasks as arrays
(``nulls``), so what leaves them is one number a region and iteration.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nulls import group_null
from .resample import cluster_pvalue, grid_clusters, temporal_clusters
from .stats import one_sample_t

UNIT = ("subject", "channel")


def draw_permutations(perms: DataFrame, n_iter: int, seed: int = 41, roi: str = "roi", unit: Sequence[str] = UNIT) -> DataFrame:
    """For each iteration one stored permutation of each contribution: its rows, with a column iter."""
    stored = perms.groupBy(roi, *unit).agg(F.max("perm").alias("_p"))
    picks = stored.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1)))).withColumn("perm", F.pmod(F.xxhash64(F.lit(seed), "iter", roi, *unit), F.col("_p") + 1).cast("int")).drop("_p")
    return perms.withColumn("perm", F.col("perm").cast("int")).join(picks, [roi, *unit, "perm"])


def null_of_permutations(perms: DataFrame, n_iter: int, alpha: float = 0.05, roi: str = "roi", unit: Sequence[str] = UNIT) -> DataFrame:
    """(roi, iter, null): largest cluster of the one-sample test of permutations that are drawn from each contribution's stored ones."""
    return group_null(perms.select(roi, F.xxhash64(*unit).alias("unit"), "perm", "t_idx", "v"), n_iter, [roi], alpha=alpha)


def null_of_paired_permutations(perms_a: DataFrame, perms_b: DataFrame, n_iter: int, alpha: float = 0.05, roi: str = "roi", unit: Sequence[str] = UNIT) -> DataFrame:
    """As above, for differences of independent draws of two conditions; a contribution that one of them lacks is left out."""
    keys = [roi, *unit, "perm", "t_idx"]
    both = perms_a.select(*keys, F.col("v")).join(perms_b.select(*keys, F.col("v").alias("v_b")), keys, "full")
    return group_null(both.withColumn("unit", F.xxhash64(*unit)), n_iter, [roi], alpha=alpha)


def null_of_sign_flips(rows: DataFrame, n_iter: int, alpha: float = 0.05, roi: str = "roi", unit: Sequence[str] = UNIT) -> DataFrame:
    """As above, for contributions whose sign is dealt anew in each iteration."""
    return group_null(rows.select(roi, F.xxhash64(*unit).alias("unit"), "t_idx", "v"), n_iter, [roi], alpha=alpha, flip=True)


def cluster_test(rows: DataFrame, null: DataFrame, alpha: float = 0.05, keep: int | None = None, roi: str = "roi") -> DataFrame:
    """Observed clusters with their p against the null, largest first; ``keep``: how many of each region."""
    from pyspark.sql import Window

    found = temporal_clusters(one_sample_t(rows, [roi, "t_idx"], p=True), [roi], alpha)
    if keep is not None:
        w = Window.partitionBy(roi).orderBy(F.abs("t_sum").desc(), "start")
        found = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")
    return cluster_pvalue(found, null, [roi])


def mark_windows(times: DataFrame, windows: DataFrame, roi: str = "roi") -> DataFrame:
    """Samples within a significant window, ends included."""
    w = windows.select(F.col(roi), "start", "end")
    hit = times.join(w, (times[roi] == w[roi]) & times["t_idx"].between(w["start"], w["end"]), "left_semi").select(roi, "t_idx").withColumn("significant", F.lit(True))
    return times.join(hit, [roi, "t_idx"], "left").withColumn("significant", F.coalesce("significant", F.lit(False)))


def signed_null_of_maps(perms: DataFrame, alpha: float = 0.05, roi: str = "roi") -> DataFrame:
    """(roi, perm, null): the signed sum of the largest grid cluster of each permutation's mean map. Permutations that not every contribution has are left out."""
    counts = perms.groupBy(roi, *UNIT).agg(F.max("perm").alias("_m")).groupBy(roi).agg(F.min("_m").alias("_least"))
    whole = perms.join(counts, roi).where(F.col("perm") <= F.col("_least"))
    t = one_sample_t(whole, [roi, "perm", "f_idx", "t_idx"], p=True).withColumn("map", F.concat_ws("#", F.col(roi).cast("string"), F.col("perm").cast("string")))
    sums = grid_clusters(t.withColumn("t", F.col("mean")), "map", alpha).groupBy("map").agg(F.max_by("t_sum", F.abs("t_sum")).alias("null"))
    maps = t.select(roi, "perm", "map").distinct()
    return maps.join(sums, "map", "left").select(roi, "perm", F.coalesce("null", F.lit(0.0)).alias("null"))


def outside_signed_null(clusters: DataFrame, null: DataFrame, percentile: float = 0.005, roi: str = "roi") -> DataFrame:
    """Clusters whose sum is below the lower or above the upper percentile of the signed null."""
    edges = null.groupBy(roi).agg(F.percentile("null", percentile).alias("_low"), F.percentile("null", 1 - percentile).alias("_high"))
    return clusters.join(edges, roi).withColumn("significant", (F.col("t_sum") < F.col("_low")) | (F.col("t_sum") > F.col("_high"))).drop("_low", "_high")
