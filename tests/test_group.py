"""Group tests against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaic.functions.tdist import two_sided
from voltaic.operators import group_tests
from voltaic.plans import pipelines


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(8, 20)) + np.where((np.arange(20) >= 5) & (np.arange(20) < 10), 2.0, 0.0)
    data = [("R", f"s{i}", "c", t, float(x[i, t])) for i in range(8) for t in range(20)]
    return x, spark.createDataFrame(data, "roi string, subject string, channel string, t_idx int, v double")


def clusters(x, alpha=0.05):
    t = x.mean(axis=0) / (x.std(axis=0, ddof=1) / np.sqrt(len(x)))
    p = two_sided(t, np.full(len(t), len(x) - 1.0))
    out, run = [], []
    for i in range(len(t) + 1):
        if i < len(t) and p[i] < alpha and (not run or np.sign(t[i]) == np.sign(t[run[-1]])):
            run.append(i)
        else:
            if run:
                out.append((run[0], run[-1], t[run].sum()))
            run = [i] if i < len(t) and p[i] < alpha else []
    return out


def test_observed_clusters_and_null(rows):
    x, df = rows
    null = group_tests.null_of_sign_flips(df, 50)
    assert null.count() == 50
    found = group_tests.cluster_test(df, null).collect()
    assert sorted((r.start, r.end, round(r.t_sum, 6)) for r in found) == sorted((a, b, round(t, 6)) for a, b, t in clusters(x))
    best = max(found, key=lambda r: abs(r.t_sum))
    assert best.start <= 6 and best.end >= 8 and best.p_cluster <= 0.1
    assert group_tests.cluster_test(df, null, keep=1).count() == 1
    values = [r["null"] for r in null.collect()]
    assert best.p_cluster == (sum(v >= abs(best.t_sum) for v in values) + 1) / 51


def test_stored_permutations(rows, spark):
    _, df = rows
    perms = df.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("v", F.col("v") * F.when(F.pmod(F.xxhash64("perm", "subject"), F.lit(2)) == 0, 1).otherwise(-1))
    drawn = group_tests.draw_permutations(perms, 6)
    assert drawn.groupBy("iter", "subject").agg(F.countDistinct("perm").alias("n"), F.count("v").alias("k")).where("n <> 1 or k <> 20").count() == 0
    assert group_tests.null_of_permutations(perms, 6).count() == 6 and group_tests.null_of_paired_permutations(perms, perms, 6).count() == 6


def test_marks_windows(spark):
    times = spark.createDataFrame([("R", t) for t in range(6)], "roi string, t_idx int")
    windows = spark.createDataFrame([("R", 1, 2), ("R", 5, 9)], "roi string, start int, end int")
    assert [r.t_idx for r in group_tests.mark_windows(times, windows).where("significant").orderBy("t_idx").collect()] == [1, 2, 5]


def test_signed_null(spark):
    perms = [("R", s, "c", p, f, t, float((p + 1) * (1 + 0.01 * i))) for i, s in enumerate("abcd") for p in range(3) for f in range(2) for t in range(3)]
    perms += [("R", "a", "c", 3, f, t, 9.0) for f in range(2) for t in range(3)]
    null = {r["perm"]: r["null"] for r in group_tests.signed_null_of_maps(spark.createDataFrame(perms, "roi string, subject string, channel string, perm int, f_idx int, t_idx int, v double")).collect()}
    assert null == pytest.approx({0: 6 * 1.015, 1: 12 * 1.015, 2: 18 * 1.015})
    seen = spark.createDataFrame([("R", 0.1), ("R", 8.0), ("R", 99.0)], "roi string, t_sum double")
    bounds = spark.createDataFrame([("R", i, v) for i, v in null.items()], "roi string, perm int, null double")
    assert [r.significant for r in group_tests.outside_signed_null(seen, bounds).orderBy("t_sum").collect()] == [True, False, True]


def test_corrections_are_named(rows):
    with pytest.raises(ValueError, match="unknown correction"):
        pipelines.group_test(rows[1], "sidak")
    assert pipelines.group_test(rows[1], "bonferroni").where("significant").count() >= 3
    assert pipelines.group_test(rows[1], min_subjects=9).count() == 0


def test_queries_take_every_contribution(spark, sf, duck):
    """Against numpy over the whole table: every trial and feature of a label is in its region's t."""
    from voltaic.plans import signals, tables

    e = duck.execute(f"WITH {tables.EPOCHS} SELECT label, t_idx, v + 0.2 AS v FROM e WHERE v IS NOT NULL").df()
    assert signals._contributions(spark, sf).where("v is not null").count() == len(e)
    want = {(f"R{k[0]}", int(k[1])): g.mean() / (g.std(ddof=1) / np.sqrt(len(g))) for k, g in e.groupby(["label", "t_idx"]).v}
    got = {(r.roi, r.t_idx): r.t for r in signals.group_fdr_test(spark, sf).collect()}
    assert got == pytest.approx(want, abs=1e-5)
    found = {(r.roi, r.start, r.end): r.t_sum for r in signals.group_cluster_test(spark, sf).collect()}
    assert found == pytest.approx({k: sum(want[k[0], i] for i in range(k[1], k[2] + 1)) for k in found}, abs=1e-4) and found


def test_subjects_are_judged_apart(spark):
    """Quality control, permutations and group tests of two at once are those of each alone, though trials have the same numbers."""
    rng = np.random.default_rng(2)
    data = []
    for subject, scale in (("s1", 1.0), ("s2", 40.0)):
        x = rng.normal(size=(20, 4, 5)) * scale
        x[3] *= 9
        x[:, 2] *= 1 + np.arange(20)[:, None]
        data += [(subject, i, f, t, "AB"[i % 2], None if rng.random() < 0.02 else float(x[i, f, t])) for i in range(20) for f in range(4) for t in range(5)]
    both = spark.createDataFrame(data, "subject string, trial int, feature int, t_idx int, condition string, v double")
    options = dict(mean_factor=2.0, max_factor=2.0, spread_factor=1.0, most_missing=0.5)

    def rows(df, *columns):
        return sorted(tuple(str(round(x, 9) if isinstance(x, float) else x) for x in r) for r in df.select(*columns).collect())

    cell, seen = ("subject", "trial", "feature", "t_idx", "v"), []
    for subject in ("s1", "s2"):
        alone = pipelines.clean_epochs(both.where(F.col("subject") == subject), **options)
        seen += rows(alone, *cell)
    assert rows(pipelines.clean_epochs(both, by=["subject"], **options), *cell) == sorted(seen)
    assert any(r[-1] == "None" for r in seen) and len({r[:1] + r[2:3] for r in seen}) < 8
    maps, seen = ("subject", "perm", "feature", "t_idx", "v"), []
    for subject in ("s1", "s2"):
        seen += rows(pipelines.permutation_maps(both.where(F.col("subject") == subject), 3).withColumn("subject", F.lit(subject)), *maps)
    assert rows(pipelines.permutation_maps(both, 3, by=["subject"]), *maps) == sorted(seen)
    given = both.select(F.col("condition").alias("contrast"), F.col("feature").cast("string").alias("roi"), "subject", F.col("trial").cast("string").alias("channel"), "t_idx", (F.col("v") + 0.4).alias("v"))
    for method, columns in (("fdr", ("roi", "t_idx", "p_corr", "significant")), ("cluster", ("roi", "start", "end", "p_cluster", "significant"))):
        seen = []
        for contrast in "AB":
            seen += rows(pipelines.group_test(given.where(F.col("contrast") == contrast), method, n_iter=20).withColumn("contrast", F.lit(contrast)), "contrast", *columns)
        assert rows(pipelines.group_test(given, method, n_iter=20, by=["contrast"]), "contrast", *columns) == sorted(seen)
