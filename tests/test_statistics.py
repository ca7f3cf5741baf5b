import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaic.functions import tdist
from voltaic.operators import resample, stats


def test_t_distribution_closed_forms():
    t = np.array([0.0, 1.0, 2.0, -3.0, np.inf, np.nan])
    one = tdist.two_sided(t, np.ones(6))
    assert np.allclose(one[:4], 1 - 2 / math.pi * np.arctan(np.abs(t[:4]))) and one[4] == 0 and np.isnan(one[5])
    two = tdist.two_sided(t[:4], np.full(4, 2.0))
    assert np.allclose(two, 1 - np.abs(t[:4]) / np.sqrt(2 + t[:4] ** 2))
    assert np.isnan(tdist.two_sided(np.array([1.0]), np.array([0.0])))[0]
    assert np.allclose(tdist.quantile(0.975, np.array([1.0, 10.0, 1e6])), [12.7062047, 2.2281389, 1.9599664], atol=1e-5)


def cells(spark, rows):
    return spark.createDataFrame(rows, "trial long, condition string, feature int, t_idx int, x double, v double")


def test_two_sample_keeps_means_without_t(spark):
    df = cells(spark, [(1, "A", 0, 0, 0.0, 2.0), (2, "B", 0, 0, 0.0, 1.0), (3, "B", 0, 0, 0.0, 3.0)])
    r = stats.two_sample_t(df, ["feature", "t_idx"], p=True).first()
    assert (r.mean_a, r.mean_b, r.t, r.df, r.p) == (2.0, 2.0, None, None, None)


def test_regression_policies(spark):
    rows = [(i, "A", 0, t, float(i), None if (i, t) in ((0, 0), (1, 1)) else 2.0 * i + t) for i in range(6) for t in range(2)]
    df = cells(spark, rows)
    get = lambda policy: {r.t_idx: (r.n_obs, r.slope) for r in stats.regression(df, ["feature", "t_idx"], policy=policy).collect()}
    assert get("dense") == {0: (5, None), 1: (5, None)}
    assert get("pointwise") == {0: (5, 2.0), 1: (5, 2.0)}
    assert get("feature_time0") == {0: (5, 2.0), 1: (4, None)}


def test_perfect_correlation_has_infinite_t(spark):
    df = cells(spark, [(i, "A", 0, 0, float(i), 3.0 * i) for i in range(5)])
    r = stats.regression(df, ["feature"], p=True).first()
    assert r.r == 1 and r.t == math.inf and r.p == 0


def test_corrections_ignore_unknown_p(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, None), (4, 0.9)], "i int, p double")
    assert {r.i: r.p_corr for r in stats.benjamini_hochberg(df).collect()} == pytest.approx({1: 0.03, 2: 0.03, 3: None, 4: 0.9})
    assert {r.i: r.p_corr for r in stats.bonferroni(df).collect()} == pytest.approx({1: 0.03, 2: 0.06, 3: None, 4: 1.0})


def test_false_discovery_rates_of_maps(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for by in ("a", None, "one", "unknown"):
        p = {"one": [0.04], "unknown": [None, None]}.get(by) or [0.0, 0.0, 5e-324, 1e-300, 2**-10, 1.0, 1.0, None, *rng.choice(rng.uniform(0, 1, 40) ** 4, 200).tolist()]
        known = sorted(x for x in p if x is not None)
        for i, x in enumerate(p):
            rows.append((by, i, x))
            want[by, i] = None if x is None else min(1.0, min(y * len(known) / np.searchsorted(known, y, side="right") for y in known if y >= x))
    got = stats.benjamini_hochberg(spark.createDataFrame(rows, "m string, i int, p double"), by=["m"])
    assert got.columns == ["m", "i", "p", "p_corr"]
    assert {(r.m, r.i): r.p_corr for r in got.collect()} == pytest.approx(want)
    alone = [x for x in rows if x[0] == "a"]
    got = stats.benjamini_hochberg(spark.createDataFrame(alone, "m string, i int, p double"))
    assert {(r.m, r.i): r.p_corr for r in got.collect()} == pytest.approx({k: v for k, v in want.items() if k[0] == "a"})
    assert stats.benjamini_hochberg(spark.createDataFrame([], "m string, p double"), by=["m"]).count() == 0


def test_zero_spread(spark):
    df = cells(spark, [(i, "A", 0, 0, 0.0, 5.0) for i in range(4)])
    assert stats.zscore(df, ["feature"]).first().z == 0
    assert stats.zscore(df, ["feature"], zero="null").first().z is None
    assert not stats.mask_outliers(df, ["feature"], "v").where("outlier").count()


def test_clusters_split_by_sign(spark):
    df = spark.createDataFrame([(0, i, t, p) for i, (t, p) in enumerate([(2.0, 0.01), (3.0, 0.02), (-4.0, 0.01), (-1.0, 0.5), (-2.0, 0.05), (-2.0, 0.04)])], "roi int, t_idx int, t double, p double")
    found = sorted((r.start, r.end, r.t_sum) for r in resample.temporal_clusters(df, ["roi"], 0.05).collect())
    assert found == [(0, 1, 5.0), (2, 2, -4.0), (5, 5, -2.0)]


def test_cluster_pvalue_without_null(spark):
    observed = spark.createDataFrame([("a", -3.0), ("b", 1.0)], "roi string, t_sum double")
    null = spark.createDataFrame([("a", 1.0), ("a", -4.0), ("a", 3.0)], "roi string, null double")
    assert {r.roi: r.p_cluster for r in resample.cluster_pvalue(observed, null, ["roi"]).collect()} == {"a": 0.75, "b": 1.0}


def test_grid_labels_join_diagonals():
    mask = np.array([[1, 0, 0, 0], [0, 1, 0, 1], [0, 0, 0, 1]], bool)
    labels = resample.label_grid(mask)
    assert labels[0, 0] == labels[1, 1] != labels[1, 3] == labels[2, 3] and len(set(labels[mask])) == 2


def test_shuffled_labels_keep_counts(spark):
    trials = spark.createDataFrame([(i, "A" if i < 7 else "B") for i in range(20)], "trial long, condition string")
    dealt = resample.shuffled_labels(trials, 3)
    counts = {(r["perm"], r["condition"]): r["count"] for r in dealt.groupBy("perm", "condition").count().collect()}
    assert counts == {(p, c): n for p in range(3) for c, n in (("A", 7), ("B", 13))}
    assert dealt.groupBy("trial").agg(F.countDistinct("condition").alias("n")).where("n > 1").count() > 0
