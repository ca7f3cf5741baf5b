"""Null distributions of clusters: runs over blocks, and iterations against loops."""

import numpy as np
import pytest

from voltaic.operators import nulls


def brute_runs(t, limit):
    """Largest |sum| of neighbouring values over the limit and of one sign."""
    best = now = 0.0
    for x in t:
        if np.isfinite(x) and abs(x) > limit:
            now = now + x if x * now > 0 else x
        else:
            now = 0.0
        best = max(best, abs(now))
    return best


def test_runs_join_wherever_blocks_are_cut():
    rng = np.random.default_rng(0)
    for spread in (1.0, 6.0):
        t = rng.normal(size=(200, 24)) * spread
        t[:, 5:19] = np.abs(t[:, 5:19])
        t[rng.random(t.shape) < 0.03] = np.nan
        want = [brute_runs(row, 0.9) for row in t]
        for cuts in ([], [12], [1, 2, 3], [6, 7, 20], list(range(1, 24))):
            parts = [nulls.Runs.of(x, 0.9) for x in np.split(t, cuts, axis=1)]
            left = parts[0]
            for p in parts[1:]:
                left = left.then(p)
            right = parts[-1]
            for p in parts[-2::-1]:
                right = p.then(right)
            assert np.allclose(left.best, want) and np.allclose(right.best, want)
            assert np.allclose(left.head, right.head) and np.allclose(left.tail, right.tail) and (left.whole == right.whole).all()


def test_critical_t():
    """Values of printed tables."""
    for alpha, df, t in ((0.05, 1, 12.706), (0.05, 10, 2.228), (0.01, 5, 4.032), (0.001, 120, 3.373), (0.05, 1e6, 1.95996)):
        assert abs(nulls.critical_t(alpha, df) - t) < 6e-4


def one_sample(x):
    n = (~np.isnan(x)).sum(axis=0)
    with np.errstate(all="ignore"):
        return np.where(n >= 2, np.nanmean(x, axis=0) / (np.nanstd(x, axis=0, ddof=1) / np.sqrt(n)), np.nan), n


@pytest.mark.filterwarnings("ignore:Mean of empty slice", "ignore:Degrees of freedom")
@pytest.mark.parametrize("kind", ["draw", "paired", "flip"])
def test_group_nulls(spark, kind):
    rng = np.random.default_rng(3)
    pools, rows = {}, []
    for roi in ("r1", "r2"):
        for u in range(7):
            size = 1 if kind == "flip" else 3 + u % 3
            pools[roi, u] = maps = np.stack([rng.normal(0.4, 1, (size, 20)), rng.normal(size=(size, 20))])
            maps[:, :, 11] = np.nan if roi == "r2" else maps[:, :, 11]
            maps[0, 0, 3] = np.nan
            if size > 1:
                maps[:, -1, 12:] = np.nan  # the last map lacks whole blocks
            rows += [(roi, u, p, t, *(None if np.isnan(maps[c, p, t]) else float(maps[c, p, t]) for c in (0, 1))) for p in range(size) for t in range(20) if (p, t) != (0, 4)]
            maps[:, 0, 4] = np.nan
    df = spark.createDataFrame(rows, "roi string, unit long, perm int, t_idx int, v double, v_b double").repartition(3)
    if kind != "paired":
        df = df.drop("v_b")
    got = {(r.roi, r["iter"]): r["null"] for r in nulls.group_null(df, 40, ["roi"], alpha=0.2, flip=kind == "flip", width=6).collect()}
    assert len(got) == 80
    first, second, it = nulls.hash_draw(), nulls.hash_draw(43), np.arange(40)
    for roi in ("r1", "r2"):
        for i in range(40):
            x = []
            for u in range(7):
                a, b = pools[roi, u]
                if kind == "flip":
                    x.append(a[0] * (1 if first(it, u, 2)[i] == 0 else -1))
                else:
                    x.append(a[first(it, u, len(a))[i]] - (b[second(it, u, len(b))[i]] if kind == "paired" else 0))
            t, n = one_sample(np.array(x))
            t = np.where(np.abs(t) > [nulls.critical_t(0.2, k - 1) if k > 1 else np.inf for k in n], t, np.nan)
            assert abs(got[roi, i] - brute_runs(t, 0)) < 1e-9
    assert len(set(got.values())) > 20


def test_ten_thousand_iterations_leave_a_number_each(spark):
    rng = np.random.default_rng(1)
    rows = [("r", u, t, float(rng.normal(0.2))) for u in range(30) for t in range(100)]
    df = spark.createDataFrame(rows, "roi string, unit long, t_idx int, v double")
    null = nulls.group_null(df, 10_000, ["roi"], flip=True)
    assert null.count() == 10_000


def test_label_nulls(spark):
    rng = np.random.default_rng(5)
    rows, data = [], {}
    for subject in ("s1", "s2"):
        labels = ["A" if x else "B" for x in rng.random(24) < 0.5]
        for feature in (0, 1):
            x = rng.normal(size=(24, 15))
            x[rng.random(x.shape) < 0.05] = np.nan
            data[subject, feature] = labels, x
            rows += [(subject, feature, i, labels[i], t, None if np.isnan(x[i, t]) else float(x[i, t])) for i in range(24) for t in range(15)]
    df = spark.createDataFrame(rows, "subject string, feature int, trial long, condition string, t_idx int, v double").repartition(3)
    got = {(r.subject, r.feature, r["iter"]): r["null"] for r in nulls.label_null(df, 25, ["feature"], threshold=1.2, subject=["subject"], width=4).collect()}
    keys = nulls.hash_order()(np.arange(25), np.arange(24))
    for (subject, feature), (labels, x) in data.items():
        for i in range(25):
            dealt = np.empty(24, object)
            dealt[np.argsort(keys[i], kind="stable")] = labels
            sides = [x[dealt == c] for c in "AB"]
            se = sum(np.nanvar(s, axis=0, ddof=1) / (~np.isnan(s)).sum(axis=0) for s in sides)
            t = (np.nanmean(sides[0], axis=0) - np.nanmean(sides[1], axis=0)) / np.sqrt(se)
            assert abs(got[subject, feature, i] - brute_runs(t, 1.2)) < 1e-9
    alone = nulls.label_null(df.where("subject = 's1'").drop("subject"), 25, ["feature"], threshold=1.2).collect()
    assert all(abs(r["null"] - got["s1", r.feature, r["iter"]]) < 1e-9 for r in alone)
