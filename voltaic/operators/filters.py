"""Filters made for a length, a rate and bands, and what is done with them: band envelopes in their variants, and a zero-phase notch.

A design is made once in a worker and kept: a matrix of weights of the spectrum, one row for each band. A notch is short against a recording, so it works on chunks with margins and
gives what it gives on the whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from . import dsp
from .detection import _arrays, _lists, chunked

#: Hz of a band's flank on either side, of a notch's flank, and the ratio of a notch's frequency to its width.
SKIRT, FLANK, NARROW = 0.5, 0.5, 200.0
#: Output samples that are resampled at once.
AT_ONCE = 1 << 14


def grid_points(n: int) -> int:
    """Points between zero and the Nyquist frequency: a power of two."""
    return 512 if n < 1024 else 1 << math.ceil(math.log2(n))


def breakpoint_grid(n_points: int, places: Sequence[float], gains: Sequence[float]) -> np.ndarray:
    """Gains on n_points + 1 places from 0 to 1, straight between breakpoints. Breakpoints at one place get a ramp over a twenty-fifth of the grid around it."""
    grid = np.zeros(n_points + 1)
    grid[0], begin, lap = gains[0], 1, n_points // 25
    for (a, b), (g, h) in zip(zip(places[:-1], places[1:], strict=True), zip(gains[:-1], gains[1:], strict=True), strict=True):
        if b < a:
            raise ValueError("breakpoints must not fall")
        if a == b:
            begin = max(1, begin - lap // 2)
        end = min(begin + lap if a == b else int(b * (n_points + 1)), n_points + 1)
        n = end - begin + 1
        if n > 0:
            share = np.arange(n) / max(1, n - 1)
            grid[begin - 1 : end] = h * share + g * (1 - share)
        begin = end + 1
    return grid


def _breakpoints(low: float, high: float, fs: float) -> tuple[list[float], list[float]]:
    places = np.clip(np.array([0, low - SKIRT, low, high, high + SKIRT, fs / 2], np.float32) / np.float32(fs / 2), 0, 1)
    return places.astype(float).tolist(), [0.0, 0.0, 1.0, 1.0, 0.0, 0.0]


def sampled_taps(n: int, places: Sequence[float], gains: Sequence[float]) -> np.ndarray:
    """n taps by frequency sampling on the breakpoint grid, delayed to their middle, under a periodic Hamming window. The two highest mirrored frequencies are left out."""
    m = grid_points(n)
    half = breakpoint_grid(m, places, gains)[:m] * np.exp(-0.5j * (n - 1) * np.pi * np.arange(m) / (m - 1))
    full = np.zeros(2 * (m - 1), complex)
    full[:m] = half
    full[m + 2 :] = np.conj(half[m - 4 : 0 : -1])
    return np.fft.ifft(full).real[:n] * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n))


def window_taps(n: int, places: Sequence[float], gains: Sequence[float]) -> np.ndarray:
    """n taps by frequency sampling of straight lines, under a symmetric Hamming window."""
    m = 1 + (1 << math.ceil(math.log2(n)))
    at = np.linspace(0, 1, m)
    return np.fft.irfft(np.interp(at, places, gains) * np.exp(-0.5j * (n - 1) * np.pi * at))[:n] * np.hamming(n)


@lru_cache(maxsize=32)
def analytic_bands(n: int, fs: float, bands: tuple[tuple[float, float], ...], design: str = "grid") -> np.ndarray:
    """Weights of the spectrum (band, frequency) that leave each band's analytic signal, of zero phase. ``design``: ``grid`` (``sampled_taps``) or ``window`` (``window_taps``)."""
    taps = {"grid": sampled_taps, "window": window_taps}[design]
    return np.array([np.abs(np.fft.fft(taps(n, *_breakpoints(a, b, fs)))) for a, b in bands]) * dsp.analytic_multiplier(n)


def trailing_mean(x: np.ndarray, width: int) -> np.ndarray:
    """Sums around each sample over ``width``, whatever number of samples the ends leave."""
    if width <= 1:
        return x
    half, i = width // 2, np.arange(len(x))
    total = np.append(0.0, np.cumsum(x))
    return (total[np.minimum(i + half, len(x) - 1) + 1] - total[np.where(i <= half, 0, i - half + 1)]) / width


@dataclass(frozen=True)
class Envelope:
    """Variants of a band envelope. ``edges`` of neighbouring bands; ``first``: bands are normalised and averaged at the recording's rate (and filtered by the ``window`` design, smoothed by a
    plain convolution), and resampled last. ``mode``: percent, db or none; ``centred``: less 100. ``smooth_ms``: a result for each; 0 leaves it unsmoothed."""

    edges: tuple[float, ...]
    fs_out: int | None = 64
    smooth_ms: tuple[int, ...] = (0,)
    mode: str = "percent"
    centred: bool = False
    first: bool = False

    def __post_init__(self) -> None:
        if len(self.edges) < 2:
            raise ValueError("a band has two edges")
        if self.mode not in ("percent", "db", "none") or self.centred and self.mode != "percent":
            raise ValueError("a mode is percent, db or none, and only percent is centred")

    def of(self, x: np.ndarray, fs: float) -> np.ndarray:
        """(window, sample)."""
        bands = tuple(zip(self.edges[:-1], self.edges[1:], strict=True))
        every = np.abs(np.fft.ifft(np.fft.fft(x) * analytic_bands(len(x), fs, bands, "window" if self.first else "grid"), axis=1))
        if self.fs_out and not self.first:
            every = np.array([dsp.resample(e, self.fs_out, int(fs)) for e in every])
        q = round(every.shape[1] / 4)
        base = every[:, q : 3 * q].mean(axis=1, keepdims=True) if q else np.zeros((len(every), 1))
        if self.mode == "percent":
            every = 100 * every / np.where(base != 0, base, 1)
        elif self.mode == "db":
            every = 20 * np.log10(np.maximum(every, 1e-10) / np.maximum(base, 1e-10))
        one, out = every.mean(axis=0), []
        rate = fs if self.first or not self.fs_out else self.fs_out
        for ms in self.smooth_ms:
            width = int(rate * ms / 1000)
            e = (dsp.moving_mean if self.first else trailing_mean)(one, width) - (100 if self.centred else 0)
            out.append(dsp.resample(e, self.fs_out, int(fs)) if self.first and self.fs_out else e)
        return np.array(out)


def envelopes(df: DataFrame, samples: str, fs: float, variant: Envelope) -> DataFrame:
    """``df`` without its samples, with ``smooth_ms`` and ``envelope``: a row for each of the variant's windows. Null arrays give none."""
    keep = [f for f in df.schema if f.name != samples]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(variant.smooth_ms)
            rows = [e for x in _arrays(batch.column(samples)) for e in variant.of(x, fs)]
            at = pa.array(np.repeat(np.arange(batch.num_rows), n))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(at) for f in keep), pa.array(list(variant.smooth_ms) * batch.num_rows, pa.int64()), _lists(rows)], [*(f.name for f in keep), "smooth_ms", "envelope"])

    some = df.where(df[samples].isNotNull())
    return some.mapInArrow(run, StructType([*keep, StructField("smooth_ms", LongType()), StructField("envelope", ArrayType(DoubleType()))]))


@lru_cache(maxsize=32)
def notch_taps(fs: float, frequencies: tuple[float, ...]) -> np.ndarray:
    """A symmetric band stop around each frequency, a two-hundredth of it wide, with flanks of half a hertz and a Hamming window that these ask for."""
    if any(not (math.isfinite(f) and f > 0) for f in frequencies):
        raise ValueError("frequencies of a notch must be finite and positive")
    if any(f >= fs / 2 for f in frequencies):
        raise ValueError(f"frequencies of a notch must be below {fs / 2:g} Hz")
    half = math.ceil(3.3 / FLANK * fs) // 2
    k, taps = np.arange(-half, half + 1), np.zeros(2 * half + 1)
    taps[half] = 1.0
    for f in frequencies:
        edge = f / NARROW / 2 + FLANK / 2
        for cut, sign in ((f + edge, -1), (max(0.0, f - edge), 1)):
            taps += sign * (2 * cut / fs) * np.sinc(2 * cut / fs * k) * np.hamming(2 * half + 1)
    return taps / taps.sum()


def convolve_blocks(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The samples of the convolution that need nothing beyond x, by transforms of blocks that overlap (overlap and save)."""
    m = len(taps)
    size = 1 << max(10, math.ceil(math.log2(4 * m)))
    step, spectrum = size - m + 1, np.fft.rfft(taps, size)
    out = [np.fft.irfft(np.fft.rfft(x[i : i + size], size) * spectrum, size)[m - 1 : min(size, len(x) - i)] for i in range(0, len(x) - m + 1, step)]
    return np.concatenate(out) if out else np.zeros(0)


def _reflected(x: np.ndarray, n: int) -> np.ndarray:
    """n samples before x: x turned around its first sample, zeros beyond its length."""
    some = 2 * x[0] - x[min(n, len(x) - 1) : 0 : -1] if len(x) > 1 else np.zeros(0)
    return np.concatenate([np.zeros(n - len(some)), some])


def notch(segments: DataFrame, keys: Sequence[str], fs: float, frequencies: Sequence[float], size: int = 1 << 16, first: str = "first", samples: str = "samples") -> DataFrame:
    """keys, ``first`` and ``samples``: recordings without the frequencies, in chunks of ``size`` samples. Both ends are continued by reflection."""
    taps = notch_taps(fs, tuple(float(f) for f in frequencies))
    half, keys = len(taps) // 2, list(keys)
    chunks = chunked(segments, keys, half, max(size, half), first, samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            bounds = zip(*(batch.column(c).to_pylist() for c in ("n", "own", "end", "at")), strict=True)
            for x, (n, own, end, at) in zip(_arrays(batch.column("samples")), bounds, strict=True):
                # Margins around the recording's ends are of its other end: they are not wanted here.
                x = x[max(0, -at) : len(x) - max(0, at + len(x) - n)]
                x = np.concatenate([_reflected(x, half) if own == 0 else x[:0], x, _reflected(x[::-1], half)[::-1] if end == n else x[:0]])
                rows.append(convolve_blocks(x, taps))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("own"), _lists(rows)], [*keys, "first", "samples"])

    return chunks.mapInArrow(run, StructType([*(chunks.schema[k] for k in keys), StructField("first", LongType()), StructField("samples", ArrayType(DoubleType()))]))
