"""Filter designs against direct evaluation, envelopes, notch in chunks, resampling and tapers."""

import numpy as np
import pytest

from voltaic.operators import dsp, filters


def test_grid_by_hand():
    g = filters.breakpoint_grid(100, [0, 0.2, 0.4, 0.6, 0.8, 1.0], [0, 0, 1, 1, 0, 0])
    assert len(g) == 101 and (g[:20] == 0).all() and (g[40:60] == 1).all() and (g[80:] == 0).all()
    assert np.allclose(np.diff(g[20:40]), np.diff(g[20:40])[0]) and g[20] == 0 and g[39] == 1
    step = filters.breakpoint_grid(100, [0, 0.5, 0.5, 1.0], [0, 0, 1, 1])
    assert (step[:48] == 0).all() and (step[53:] == 1).all()
    with pytest.raises(ValueError, match="must not fall"):
        filters.breakpoint_grid(100, [0, 0.5, 0.4], [0, 1, 0])


@pytest.mark.parametrize("n", [61, 200])
def test_taps_by_sums(n):
    """Both designs as sums of cosines over the grid."""
    places, gains = [0, 0.3, 0.32, 0.5, 0.52, 1.0], [0, 0, 1, 1, 0, 0]
    m = filters.grid_points(n)
    g = filters.breakpoint_grid(m, places, gains)
    size, i = 2 * (m - 1), np.arange(n)
    want = sum(g[k] * np.cos(2 * np.pi * k * (i - (n - 1) / 2) / size) * (2 if 0 < k < m - 3 else 1) for k in range(m)) / size
    assert np.allclose(filters.sampled_taps(n, places, gains), want * (0.54 - 0.46 * np.cos(2 * np.pi * i / n)), atol=1e-12)
    m = 1 + (1 << int(np.ceil(np.log2(n))))
    g = np.interp(np.linspace(0, 1, m), places, gains)
    size = 2 * (m - 1)
    want = sum(g[k] * np.cos(2 * np.pi * k * (i - (n - 1) / 2) / size) * (2 if 0 < k < m - 1 else 1) for k in range(m)) / size
    assert np.allclose(filters.window_taps(n, places, gains), want * np.hamming(n), atol=1e-12)


def test_bands_pass_their_waves():
    n, fs = 2048, 512.0
    t = np.arange(n) / fs
    for design in ("grid", "window"):
        w = filters.analytic_bands(n, fs, ((50.0, 60.0), (60.0, 70.0)), design)
        for band, f in ((0, 55.0), (1, 65.0)):
            e = np.abs(np.fft.ifft(np.fft.fft(3 * np.cos(2 * np.pi * f * t)) * w, axis=1))
            assert abs(e[band, 500:1500].mean() - 3) < 0.05 and e[1 - band, 500:1500].max() < 0.05


def test_smoothing_as_sums():
    x = np.random.default_rng(0).normal(size=30)
    for width in (1, 4, 7):
        half = width // 2
        for i, got in enumerate(filters.trailing_mean(x, width)):
            begin, end = (0, i + half) if i - half <= 0 else (i - half + 1, 29) if i >= 30 - half else (i - half + 1, i + half)
            assert abs(got - (x[i] if width == 1 else x[begin : min(end, 29) + 1].sum() / width)) < 1e-12


def test_envelope_variants(spark):
    fs, n = 512.0, 4096
    t = np.arange(n) / fs
    x = np.cos(2 * np.pi * 62 * t) * (1 + (np.abs(t - 4) < 0.5))
    df = spark.createDataFrame([("a", x.tolist()), ("b", None)], "channel string, samples array<double>")
    for first in (False, True):
        v = filters.Envelope((55.0, 65.0, 75.0), 64, (0, 250), first=first)
        rows = {r.smooth_ms: np.array(r.envelope) for r in filters.envelopes(df, "samples", fs, v).collect()}
        assert set(rows) == {0, 250} and all(len(e) == 512 for e in rows.values())
        assert rows[0][250:260].mean() > 1.4 * rows[0][100:110].mean() and np.abs(np.diff(rows[250])).max() < np.abs(np.diff(rows[0])).max()
        centred = filters.Envelope((55.0, 65.0, 75.0), 64, (250,), centred=True, first=first).of(x, fs)[0]
        assert np.abs((centred + 100 - rows[250])[20:-20]).max() < (1e-9 if not first else 0.5)
    level = filters.Envelope((55.0, 65.0), None, (0,), mode="db").of(x, fs)[0]
    assert len(level) == n and abs(level[2048] - level[700] - 6.02) < 0.4
    for bad in (dict(edges=(1.0,)), dict(edges=(1.0, 2.0), mode="z"), dict(edges=(1.0, 2.0), mode="db", centred=True)):
        with pytest.raises(ValueError):
            filters.Envelope(**bad)


def test_notch_in_chunks(spark):
    fs, n = 128.0, 6000
    t = np.arange(n) / fs
    rng = np.random.default_rng(0)
    x = np.sin(2 * np.pi * 10 * t) + 2 * np.sin(2 * np.pi * 50 * t) + 0.1 * rng.normal(size=n)
    df = spark.createDataFrame([("a", i, x[i : i + 700].tolist()) for i in range(0, n, 700)] + [("short", 0, x[:40].tolist())], "channel string, first long, samples array<double>")

    def joined(size):
        rows = filters.notch(df, ["channel"], fs, [50], size=size).orderBy("first").collect()
        return {c: np.concatenate([r.samples for r in rows if r.channel == c]) for c in ("a", "short")}

    whole, parts = joined(1 << 16), joined(1000)
    assert len(whole["a"]) == n and len(whole["short"]) == 40
    assert np.allclose(whole["a"], parts["a"], atol=1e-10) and np.allclose(whole["short"], parts["short"], atol=1e-10)
    power = lambda y, f: abs((y[1000:5000] * np.exp(-2j * np.pi * f * t[1000:5000])).mean())
    assert power(whole["a"], 50) < 0.01 * power(x, 50) and abs(power(whole["a"], 10) / power(x, 10) - 1) < 0.01
    taps = filters.notch_taps(fs, (50.0,))
    direct = np.convolve(x, taps)[len(taps) // 2 : len(taps) // 2 + n]
    assert np.allclose(direct[800:-800], whole["a"][800:-800], atol=1e-9) and (taps == taps[::-1]).all()
    for bad in ([64.0], [0.0], [float("nan")]):
        with pytest.raises(ValueError):
            filters.notch(df, ["channel"], fs, bad)


@pytest.mark.parametrize("up,down", [(1, 4), (3, 2), (2, 3), (64, 500)])
def test_resampling_is_the_stuffed_convolution(up, down):
    x = np.random.default_rng(1).normal(size=301)
    g = np.gcd(up, down)
    u, d = up // g, down // g
    most = max(u, d)
    k = np.arange(-10 * most, 10 * most + 1)
    taps = np.sinc(k / most) / most * np.kaiser(len(k), 5.0)
    taps *= u / taps.sum()
    wide = np.zeros(301 * u)
    wide[::u] = x
    want = np.convolve(wide, taps)[10 * most : 10 * most + len(wide) : d]
    assert np.allclose(dsp.resample(x, up, down), want)


@pytest.mark.parametrize("n,nw,k", [(40, 2.0, 3), (301, 4.0, 7)])
def test_tapers_are_the_dense_ones(n, nw, k):
    i = np.arange(n)
    m = np.diag(((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * nw / n)) + np.diag(i[1:] * (n - i[1:]) / 2, 1) + np.diag(i[1:] * (n - i[1:]) / 2, -1)
    want = np.linalg.eigh(m)[1][:, ::-1][:, :k].T
    assert np.allclose(np.abs((dsp.dpss(n, nw, k) * want).sum(axis=1)), 1, atol=1e-10)


def test_multitaper_is_windows_times_kernels():
    rng = np.random.default_rng(2)
    x, fs, window, smoothing = rng.normal(size=200), 100.0, 0.5, 8.0
    got = dsp.multitaper_db(x, fs, [10.0, 23.0], window, smoothing, 3)
    tapers, c = dsp.dpss(50, 4.0, 7), x - x.mean()
    for i, f in enumerate((10.0, 23.0)):
        kernel = tapers * np.exp(-2j * np.pi * f * (np.arange(50) - 24.5) / fs)
        for j, t in enumerate(range(0, 200, 3)):
            if t < 25 or t + 25 > 200:
                assert np.isnan(got[i, j])
            else:
                assert abs(got[i, j] - 10 * np.log10((np.abs(kernel @ c[t - 25 : t + 25]) ** 2).mean() * 2 / 200)) < 1e-8
