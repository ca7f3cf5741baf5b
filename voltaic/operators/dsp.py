"""Signals held as arrays: band envelopes, multitaper power, wavelets and their backgrounds (``detection`` finds events in them).

Each function takes one row's samples and gives arrays or rows; Spark splits recordings and channels into rows, and Arrow batches carry them to numpy.
Filters, tapers and wavelets depend on lengths and parameters only: they are made once per worker and kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def map_arrays(df: DataFrame, samples: str, output: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``df`` with ``output``: f of each row's samples (missing ones are NaN). Null arrays stay null."""
    schema = f"{', '.join(f'`{x.name}` {x.dataType.simpleString()}' for x in df.schema if x.name != output)}, {output} array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(samples)).to_pylist()
            out = [None if r is None else f(np.array([np.nan if x is None else x for x in r], dtype=float)).tolist() for r in rows]
            keep = [i for i, name in enumerate(batch.schema.names) if name != output]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(out, pa.list_(pa.float64()))], [*(batch.schema.names[i] for i in keep), output])

    return df.mapInArrow(run, schema)


# Envelopes


def frequency_bins(low: float, high: float, step: float) -> list[tuple[float, float]]:
    """Neighbouring bands of equal width; edges are multiples of the step, so they do not drift."""
    n = int(math.floor((high - low) / step + 1e-9))
    edges = [low + i * step for i in range(n + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def clamp_bins(bins: list[tuple[float, float]], fs: float, low: float, step: float) -> list[tuple[float, float]]:
    """Bands that the sampling rate allows, if it is too low for the highest."""
    if not bins or fs > 2 * bins[-1][1]:
        return bins
    return frequency_bins(low, (fs // 2) // int(step) * step, step)


@lru_cache(maxsize=256)
def analytic_multiplier(n: int) -> np.ndarray:
    """Weights of the spectrum that leave an analytic signal."""
    h = np.zeros(n)
    h[0] = 1
    if n % 2 == 0:
        h[n // 2] = 1
        h[1 : n // 2] = 2
    else:
        h[1 : n // 2] = 2  # one less than the textbook's: the middle weight stays 0
    return h


@lru_cache(maxsize=256)
def band_gain(n: int, fs: float, low: float, high: float, skirt: float = 0.5) -> np.ndarray:
    """Gains of a zero-phase band pass with straight flanks of half a hertz, for each bin of the spectrum."""
    f = np.abs(np.fft.fftfreq(n, 1 / fs))
    return np.interp(f, [low - skirt, low + skirt, high - skirt, high + skirt], [0.0, 1.0, 1.0, 0.0], left=0.0, right=0.0)


def envelopes(x: np.ndarray, fs: float, bins: list[tuple[float, float]]) -> np.ndarray:
    """Amplitude of each band over time: one transform of the signal, one inverse transform for all bands together."""
    n = len(x)
    weights = analytic_multiplier(n) * np.array([band_gain(n, fs, a, b) for a, b in bins])
    return np.abs(np.fft.ifft(np.fft.fft(x) * weights, axis=1))


def percent_of_middle(x: np.ndarray) -> np.ndarray:
    """In percent of the mean of the middle half."""
    q = int(np.rint(x.shape[-1] / 4))
    base = x[..., q : 3 * q].mean(axis=-1, keepdims=True)
    return x / np.where(base == 0, 1, base) * 100


def moving_mean(x: np.ndarray, width: int) -> np.ndarray:
    if width <= 1:
        return x
    return np.convolve(x, np.ones(width) / width)[width // 2 : width // 2 + len(x)]


def resample(x: np.ndarray, up: int, down: int, half: int = 10, beta: float = 5.0) -> np.ndarray:
    """Polyphase resampling by up/down with a Kaiser-windowed low pass."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return x
    most = max(up, down)
    k = np.arange(-half * most, half * most + 1)
    taps = np.sinc(k / most) / most * np.kaiser(len(k), beta)
    taps *= up / taps.sum()
    # Output j is at j * down on the finer grid, where only every up-th sample is there: of the taps too only those are used.
    at = np.arange(-(-len(x) * up // down)) * down + half * most
    out = np.empty(len(at))
    for phase in range(up):
        mine = np.flatnonzero(at % up == phase)
        used = taps[phase::up]
        wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(len(used) - 1), x, np.zeros(len(used))]), len(used))
        for part in np.array_split(mine, max(1, len(mine) // 16_384)):
            out[part] = wide[at[part] // up] @ used[::-1]
    return out


def band_envelope(x: np.ndarray, fs: float, low: float, high: float, step: float, smooth_ms: float, fs_out: int, normalise_first: bool = False) -> np.ndarray:
    """Mean of the bands' normalised envelopes, smoothed. Resampled before (or after everything, if ``normalise_first``)."""
    every = envelopes(x, fs, clamp_bins(frequency_bins(low, high, step), fs, low, step))
    if not normalise_first:
        every = np.array([resample(e, fs_out, int(fs)) for e in every])
    one = percent_of_middle(every).mean(axis=0)
    rate = fs if normalise_first else fs_out
    one = moving_mean(one, max(1, int(np.rint(smooth_ms / 1000 * rate))))
    return resample(one, fs_out, int(fs)) if normalise_first else one


# Time-frequency power


@lru_cache(maxsize=256)
def dpss(n: int, half_bandwidth: float, k: int) -> np.ndarray:
    """The first k discrete prolate spheroidal sequences, of unit energy: eigenvectors of a tridiagonal matrix, by bisection for its k largest eigenvalues and inverse iteration."""
    i = np.arange(n)
    diagonal = ((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * half_bandwidth / n)
    beside = i[1:] * (n - i[1:]) / 2
    reach = np.append(beside, 0) + np.append(0, beside)
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    squares, tiny = np.append(0, beside**2), np.finfo(float).tiny
    for _ in range(80):
        middle, above = (low + high) / 2, np.zeros(k, int)
        q = np.ones(k)
        for d, e in zip(diagonal, squares, strict=True):  # signs of the pivots of the matrix less the middle
            q = d - middle - e / np.where(q == 0, tiny, q)
            above += q > 0
        more = above > np.arange(k)
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    out = np.empty((k, n))
    for j, value in enumerate((low + high) / 2):
        v = np.random.default_rng(j).normal(size=n)
        for _ in range(4):
            v = _solve_tridiagonal(diagonal - value, beside, v)
            for u in out[:j]:
                v = v - (v @ u) * u
            v /= np.linalg.norm(v)
        # Symmetric ones have a positive mean, others begin upwards.
        out[j] = -v if (v.sum() if j % 2 == 0 else v[np.argmax(np.abs(v) > 1e-7)]) < 0 else v
    return out


def _solve_tridiagonal(diagonal: np.ndarray, beside: np.ndarray, right: np.ndarray) -> np.ndarray:
    """By elimination with row exchanges; pivots of zero are nudged, as inverse iteration wants."""
    n = len(diagonal)
    a, b, c, r = diagonal.tolist(), [*beside.tolist(), 0.0], [0.0] * n, right.tolist()
    tiny = np.finfo(float).eps * float(np.abs(diagonal).max() + (np.abs(beside).max() if len(beside) else 0))
    for i in range(n - 1):
        below = float(beside[i])
        if abs(below) > abs(a[i]):
            factor = a[i] / below
            a[i], b[i], a[i + 1], c[i], b[i + 1], r[i], r[i + 1] = below, a[i + 1], b[i] - factor * a[i + 1], b[i + 1], -factor * b[i + 1], r[i + 1], r[i] - factor * r[i + 1]
        else:
            a[i] = a[i] or tiny
            factor = below / a[i]
            a[i + 1] -= factor * b[i]
            r[i + 1] -= factor * r[i]
    out = [0.0] * (n + 2)
    for i in range(n - 1, -1, -1):
        out[i] = (r[i] - b[i] * out[i + 1] - c[i] * out[i + 2]) / (a[i] if abs(a[i]) > tiny else tiny)
    return np.array(out[:n])


def n_tapers(window_s: float, smoothing_hz: float) -> int:
    return max(1, int(math.floor(2 * window_s * smoothing_hz - 1)))


@lru_cache(maxsize=1024)
def taper_spectra(size: int, fs: float, f: float, m: int, half_bandwidth: float, k: int) -> np.ndarray:
    """Spectra of ``size`` points of the tapered waves of one frequency, turned around so that a product with a spectrum correlates."""
    wave = np.exp(-2j * np.pi * f * (np.arange(m) - (m - 1) / 2) / fs)
    return np.fft.fft((dpss(m, half_bandwidth, k) * wave)[:, ::-1], size, axis=1)


def multitaper_db(x: np.ndarray, fs: float, frequencies: list[float], window_s: float, smoothing_hz: float, step: int = 1) -> np.ndarray:
    """Power in dB (frequency, time), the mean over tapers; NaN where a window leaves the epoch. One transform of the epoch, and an inverse one for each frequency's tapers."""
    n = len(x)
    m = int(np.rint(window_s * fs))
    at = np.arange(0, n, step)
    out = np.full((len(frequencies), len(at)), np.nan)
    whole = (at - m // 2 >= 0) & (at - m // 2 + m <= n)
    if not whole.any():
        return out
    size = 1 << (n + m - 2).bit_length()
    spectrum = np.fft.fft(x - np.nanmean(x), size)
    # A window's correlation ends up where its last sample is.
    ends = at[whole] - m // 2 + m - 1
    for i, f in enumerate(frequencies):
        waves = np.fft.ifft(spectrum * taper_spectra(size, fs, f, m, window_s * smoothing_hz, n_tapers(window_s, smoothing_hz)), axis=1)[:, ends]
        out[i, whole] = 10 * np.log10(np.maximum((np.abs(waves) ** 2).mean(axis=0) * 2 / n, 1e-20))
    return out


# Wavelets


def dog_wavelet(x: np.ndarray, fs: float, octaves: tuple[int, int], voices: int = 12, moment: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Analytic wavelet transform (scale, time) by a derivative of a Gaussian in the frequency domain, of the octaves from the first up to
    but without the last; frequencies ascend. A scale s has its peak at a quarter of the sampling rate over s."""
    n = len(x)
    u = 2 * np.pi * np.arange(n) / n
    spectrum = np.fft.fft(x)
    scales = 2.0 ** (octaves[1] - (1 + np.arange((octaves[1] - octaves[0]) * voices)) / voices)
    out = np.empty((len(scales), n), complex)
    for i, s in enumerate(scales):
        v = s * u
        out[i] = np.fft.ifft(spectrum * v**moment * np.exp(-moment * (2 * v / np.pi) ** 2 / 2)) * math.sqrt(s)
    return out, fs / (4 * scales)


def hazen(x: np.ndarray, q: float) -> float:
    return float(np.quantile(x, q, method="hazen"))


def tukey(n: int, share: float) -> np.ndarray:
    """A window of n ones whose ends, ``share`` of it together, rise and fall like a cosine."""
    if share <= 0 or n < 2:
        return np.ones(n)
    place = np.arange(n) / (n - 1)
    inside = np.minimum(np.minimum(place, 1 - place) / (min(share, 1.0) / 2), 1.0)
    return (1 - np.cos(np.pi * inside)) / 2


def background_samples(n: int, fs: float) -> np.ndarray:
    """The samples that backgrounds are judged by: all but a second at either end, 15,000 of them if there are over 16,000 samples, and the
    first 1,000 of what is too short for that."""
    if n > 16_000:
        return np.clip(np.linspace(fs, n - fs, 15_000).astype(np.int64) - 1, 0, n - 1)
    first, end = max(0, int(fs) - 1), min(n, int(n - fs))
    return np.arange(first, end) if first < end else np.arange(min(n, 1000))


def whiten(tf: np.ndarray, fs: float) -> np.ndarray:
    """Power of each scale over its background's: the spread of those real parts that lie within 1.5 quartile ranges of the quartiles. The ends fade in and out."""
    n = tf.shape[1]
    at = background_samples(n, fs)
    window = tukey(n, 0.25 * fs / n) if n else np.ones(0)
    out = np.empty(tf.shape)
    for i, row in enumerate(tf):
        every = row.real[at]
        a, b = hazen(every, 0.25), hazen(every, 0.75)
        inner = every[(every >= a - 1.5 * (b - a)) & (every <= b + 1.5 * (b - a))]
        sd = inner.std(ddof=1) if len(inner) > 1 else 0.0
        out[i] = np.abs(row / (sd if sd > 0 else 1.0)) ** 2 * window
    return out


# Grids


def octave_range(low_hz: float, high_hz: float, fs: float) -> tuple[int, int]:
    """Octaves of scales whose frequencies, fs / (4 scale), reach from low to high."""
    return max(0, math.floor(math.log2(fs / (4 * high_hz)))), max(0, math.ceil(math.log2(fs / (4 * low_hz))))


def snap_frequencies(wanted: list[float], n: int, fs: float) -> np.ndarray:
    """Nearest frequencies that n samples resolve, each once, without 0."""
    length = n / fs
    out = np.unique(np.rint(np.asarray(wanted) * length) / length)
    return out[out > 0]


def snap_times(times: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the samples nearest to the wanted times, each once."""
    at = np.clip(np.searchsorted(times, wanted), 1, len(times) - 1)
    at = at - (np.abs(times[at - 1] - wanted) <= np.abs(times[at] - wanted))
    return np.unique(at)


def detrend(x: np.ndarray, order: int) -> np.ndarray:
    """Less the polynomial that fits best; -1 changes nothing, 0 takes the mean away."""
    if order < 0:
        return x
    basis = np.vander(np.linspace(-1, 1, len(x)), order + 1)
    return x - basis @ np.linalg.lstsq(basis, x, rcond=None)[0]


def time_frequency_grid(frequencies: list[float], duration_s: float, split_hz: float = 30.0, cycles: float = 6.0, high_window_s: float = 0.2) -> list[tuple[float, float, float, int]]:
    """(frequency, window, smoothing, tapers): below the split six cycles and a third of the frequency, above it a fixed window with as many tapers as the same smoothing allows."""
    out = []
    for f in frequencies:
        window = min(duration_s, cycles / f if f < split_hz else high_window_s)
        k = 1 if f < split_hz else max(1, math.floor(2 * window * f / 3 - 1))
        out.append((f, window, f / 3 if f < split_hz else (k + 1) / (2 * window), k))
    return out
