"""Detections in long recordings: chunks against the whole, extents and selection against brute force, planted events."""

import math

import numpy as np
import pytest

from voltaic.operators import detection
from voltaic.operators.detection import OSCILLATION, Settings, Sweep

FS = 1024.0


def recording(seconds=30, seed=0):
    """Noise, with ripples of several periods and sharp spikes."""
    rng = np.random.default_rng(seed)
    n = int(seconds * FS)
    x = rng.normal(size=n)
    t = np.arange(n)
    ripples, spikes = [3000, 9000, 9800, 20_000], [5000, 15_000, 26_000]
    for at in ripples:
        x += 14 * np.exp(-(((t - at) / 40) ** 2)) * np.sin(2 * np.pi * 128 * (t - at) / FS)
    for at in spikes:
        x += 150 * np.exp(-(((t - at) / 6) ** 2))
    return x, ripples, spikes


def segments(spark, signals, length):
    rows = [(k, i, x[i : i + length].tolist()) for k, x in signals.items() for i in range(0, len(x), length)]
    return spark.createDataFrame(rows, "channel string, first bigint, samples array<double>").repartition(4)


def found(df):
    return {(r.channel, r.kind, r["sample"], r.scale): (r.event_type, r.strength, r.later, r.earlier, r.up, r.down) for r in df.collect()}


@pytest.mark.parametrize("threshold", [40.0, None])
def test_chunks_give_what_the_whole_gives(spark, threshold):
    x, ripples, spikes = recording()
    y, *_ = recording(7, 1)
    s = Settings(FS, threshold=threshold)
    given = {"a": x, "b": y, "c": np.zeros(100)}
    whole = found(detection.detect(segments(spark, given, 5000), ["channel"], s, size=1 << 20))
    for length, size in ((700, 4096), (5000, 8192)):
        parts = found(detection.detect(segments(spark, given, length), ["channel"], s, size=size))
        assert set(parts) == set(whole)
        for k, v in whole.items():
            assert parts[k][0] == v[0] and np.allclose(parts[k][1:], v[1:], rtol=1e-6)
    for at in ripples:
        assert any(k[0] == "a" and k[1] == OSCILLATION and abs(k[2] - at) < 40 and v[0] == "Ripple" for k, v in whole.items())
    for at in spikes:
        assert any(k[0] == "a" and k[1] == "Spike" and abs(k[2] - at) < 40 and v[0] == "Spike" for k, v in whole.items())
    assert not any(k[0] == "c" for k in whole)


def test_chunks_hold_every_sample_once_and_their_margins(spark):
    x = np.arange(1000.0)
    rows = detection.chunked(segments(spark, {"a": x}, 37), ["channel"], 50, 120).collect()
    assert sorted((r.own, r.end) for r in rows) == [(120 * i, 120 * (i + 1)) for i in range(7)] + [(840, 1000)]
    for r in rows:
        assert r["at"] == r.own - 50 and r.samples == [x[i % 1000] for i in range(r.own - 50, r.end + 50)]
    (one,) = detection.chunked(segments(spark, {"a": x}, 37), ["channel"], 50, 600).collect()
    assert one["at"] == 0 and one.samples == x.tolist()
    with pytest.raises(ValueError, match="shorter than the margin"):
        detection.chunked(segments(spark, {"a": x}, 37), ["channel"], 50, 40)


def brute_reach(p, s, t, fs):
    n_scales, n = p.shape
    v = p[s, t]
    out = lambda x: x < v / 2 or x > v
    reach = int(fs / 2)
    if t + reach > n:
        reach = n - t
    elif t <= reach:
        reach = t - 1
    reach = max(reach, 1)
    later = next((k for k in range(reach) if out(p[s, t + 1 + k])), None) if t + reach <= n - 1 else None
    earlier = next((k for k in range(reach + 1) if out(p[s, t - k])), None) if t - reach >= 0 else None
    up = next((k for k in range(1, n_scales - s) if out(p[s + k, t])), None)
    down = next((k for k in range(1, s + 1) if out(p[s - k, t])), None)
    return (
        reach / 2 if later is None else later, reach / 2 if earlier is None else earlier + 1,
        (n_scales - s if down is None else down) if up is None else up, (s - 1 if up is None else up) if down is None else down,
    )


def test_extents():
    rng = np.random.default_rng(1)
    for smooth in (1, 9):
        p = rng.random((7, 60)) ** 2
        p = np.array([np.convolve(r, np.ones(smooth) / smooth, "same") for r in p])
        for s, t in zip(*detection.local_peaks(p), strict=True):
            assert detection.half_height(p, s, t, 0, 60, 20.0) == brute_reach(p, s, t, 20.0)
            assert (p[s - 1 : s + 2, t - 1 : t + 2] <= p[s, t]).all()
    with_plateau = np.ones((4, 5))
    assert len(detection.local_peaks(with_plateau)[0]) == 6


def brute_selection(rows, fs, kind):
    """rows: (t, scale, v, later, earlier, up, down, sigma) in order of time; whole matrix at hand."""
    alive = [True] * len(rows)
    a = 2 if kind == OSCILLATION else 1
    for i, (t1, f1, v1, l1, e1, u1, d1, s1) in enumerate(rows):
        for j, (t2, f2, v2, l2, e2, u2, d2, s2) in enumerate(rows):
            if j == i or not alive[j] or abs(t1 - t2) >= fs:
                continue
            if not (t2 - a * e2 <= t1 + a * l1 and t1 - a * e1 <= t2 + a * l2):
                continue
            if kind != OSCILLATION:
                beaten = f1 >= f2
            elif f2 - d2 <= f1 + u1 and f1 - d1 <= f2 + u2:
                beaten = v2 >= v1
            else:
                beaten = 12 + f2 - 3 < f1 < 12 + f2 + 3 and v2 * s2**2 >= v1 * s1**2
            if beaten:
                alive[i] = False
                break
    return [i for i, x in enumerate(alive) if x]


def made_peaks(rng, n, span):
    t = np.sort(rng.integers(0, span, n))
    return np.column_stack([t, rng.integers(0, 40, n), rng.integers(1, 6, n), *rng.integers(0, 12, (2, n)), *rng.integers(1, 4, (2, n)), rng.integers(1, 4, n)]).astype(float)


@pytest.mark.parametrize("kind", [OSCILLATION, "Spike"])
def test_selection_in_any_batches(kind):
    rng = np.random.default_rng(5)
    for span in (300, 3000):
        rows = made_peaks(rng, 200, span)
        want = brute_selection(rows.tolist(), 50, kind)
        for size in (1, 7, 200):
            sweep, got, most = Sweep(50.0, kind), [], 0
            numbered = np.column_stack([rows, np.arange(len(rows))])
            for i in range(0, len(rows), size):
                got += sweep.push(numbered[i : i + size], False).tolist()
                most = max(most, len(sweep.rows))
            got += sweep.push(numbered[:0], True).tolist()
            assert got == want
            density = max(((rows[:, 0] >= a) & (rows[:, 0] <= a + 100)).sum() for a in rows[:, 0])
            assert most <= density + size


def test_selection_over_streams(spark):
    rng = np.random.default_rng(6)
    kinds, given, want = (OSCILLATION, "Spike"), [], set()
    for channel in "abc":
        for kind in kinds:
            rows = made_peaks(rng, 150, 6000)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            rows = rows[np.append(True, (np.diff(rows[:, 0]) > 0) | (np.diff(rows[:, 1]) > 0))]
            given += [(channel, int(r[0]), int(r[1]), 1.0, r[2], r[3], r[4], r[5], r[6], 1.0, kind, r[7]) for r in rows.tolist()]
            want |= {(channel, kind, int(rows[i][0]), int(rows[i][1])) for i in brute_selection(rows.tolist(), 50, kind)}
    df = spark.createDataFrame(given, "channel string, " + ", ".join(f"{k} {t}" for k, t in detection.PEAK.items())).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = [(r.channel, r.kind, r["sample"], r.scale) for r in detection.sparse(df, ["channel"], 50.0).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == want


def test_false_discovery_bounds():
    rng = np.random.default_rng(0)
    noise = rng.normal(size=50_000)
    low, high = detection.fdr_bounds(np.concatenate([noise, rng.normal(9, 0.5, 2000)]), 0.005)
    assert low == -high and 5 < high < 9
    low, high = detection.fdr_bounds(np.concatenate([noise, rng.normal(9, 0.5, 2000), rng.normal(-7, 0.5, 2000)]), 0.005)
    assert -7 < low < -3.5 and 5 < high < 9
    assert detection.fdr_bounds(np.ones(50), 0.05) == (-math.inf, math.inf) == detection.fdr_bounds(np.zeros(0), 0.05)


def test_the_threshold_of_high_rates_is_by_octaves():
    """Above 1000 Hz and up to a quarter of the rate, low scales and the three highest octaves have bounds of their own."""
    s = Settings(2048.0, bands=((80.0, 500.0),), threshold=None)
    frequency = s.transform(np.ones(2))[1]
    assert s.octaves == (0, 6) and frequency[-1] == 512
    rng = np.random.default_rng(2)
    real = rng.normal(size=(3000, s.n_scales))
    real[:300, :10] = rng.normal(8, 0.3, (300, 10))
    split = detection.automatic_threshold(real, frequency, s)
    both = detection.fdr_bounds(real[:, : s.n_scales - 38], s.alpha), detection.fdr_bounds(real[:, s.n_scales - 37 : -1], s.alpha)
    assert split == np.float32(((min(b[1] for b in both) - max(b[0] for b in both)) / 2) ** 2)
    slow = Settings(1000.0, bands=((80.0, 250.0),), threshold=None)
    low, high = detection.fdr_bounds(real[:, : slow.n_scales].ravel(), slow.alpha)
    assert detection.automatic_threshold(real[:, : slow.n_scales], slow.transform(np.ones(2))[1], slow) == np.float32(((high - low) / 2) ** 2)


def test_settings():
    assert Settings(2048.0, bands=((80.0, 500.0),), spikes=False).octaves == (0, 3)
    assert Settings(2048.0, oscillations=False).octaves == (2, 6)
    with pytest.raises(ValueError, match="neither"):
        Settings(2048.0, oscillations=False, spikes=False)
