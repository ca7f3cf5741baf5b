"""Oscillations and spikes of recordings: wavelet power over its background, peaks with their half-height extents, classes, and a sparse selection.

A recording may be longer than memory. It is cut into chunks that share margins with their neighbours, as wide as the slowest wavelet reaches; the ends of
a recording are each other's margins, as in a transform of the whole. Each chunk owns its middle:

1. Backgrounds: chunks give the wavelet's real parts at some 15,000 samples of the whole recording; a recording's spread of each scale, and the
   threshold if it is automatic, come from these alone.
2. Peaks: chunks give the local maxima over the threshold with the extents of the region above half their height, in time and across scales.
3. Selection: a stream over the peaks in order of time that holds two seconds of them at most. Choices don't cross a second without peaks, so a recording may
   have several streams.

Segments of a recording (``first``: number of the first sample, ``samples``) must follow each other without gaps. Rows without samples are left out; a missing sample
makes its chunk (and its background) unknown, and nothing is found there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from . import dsp
from .groups import SPIKE, classify_band

#: Samples that a chunk owns.
CHUNK = 1 << 15
#: The slowest frequency of spikes, the highest they are looked for at, and the one above which none is.
SPIKE_LOW, SPIKE_HIGH, SPIKE_LIMIT = 8.0, 80.0, 120.0
#: An octave has so many scales in the rule for harmonics, and these lie between so many scales apart.
HARMONIC = (9, 15)
OSCILLATION = "Osc"


@dataclass(frozen=True)
class Settings:
    """``threshold`` None: automatic, at ``alpha``. Widths (across scales) are for 12 voices; spans are in half-height durations of the wavelet."""

    fs: float
    bands: tuple[tuple[float, float], ...] = ((80.0, 250.0), (250.0, 500.0))
    oscillations: bool = True
    spikes: bool = True
    threshold: float | None = 40.0
    alpha: float = 0.005
    voices: int = 12
    moment: int = 20
    oscillation_span: float = 1.4
    oscillation_width: float = 10.0
    spike_span: float = 1.3
    spike_width: float = 11.0

    def __post_init__(self) -> None:
        if not self.oscillations and not self.spikes:
            raise ValueError("neither oscillations nor spikes are asked for")

    @property
    def octaves(self) -> tuple[int, int]:
        low = min(min(b) for b in self.bands) if self.oscillations and not self.spikes else SPIKE_LOW
        high = max(max(b) for b in self.bands) if self.oscillations else SPIKE_HIGH
        first = math.floor(math.log2(self.fs / (4 * high)))
        return (first if first >= -1 else 0), math.ceil(math.log2(self.fs / (4 * low)))

    @property
    def n_scales(self) -> int:
        return (self.octaves[1] - self.octaves[0]) * self.voices

    @property
    def margin(self) -> int:
        """Samples beyond which neither the slowest wavelet nor an extent reaches."""
        spread = 2 * math.sqrt(self.moment) / math.pi * 2.0 ** self.octaves[1]
        return max(math.ceil(16 * spread), int(0.5 * self.fs) + 2)

    def transform(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return dsp.dog_wavelet(x, self.fs, self.octaves, self.voices, self.moment)


def chunked(segments: DataFrame, keys: Sequence[str], margin: int, size: int = CHUNK, first: str = "first", samples: str = "samples") -> DataFrame:
    """keys, ``n`` (samples of the recording), ``chunk``, ``own`` and ``end`` (the samples it owns), ``at`` (number of its first sample, margin included) and ``samples``."""
    if margin > size:
        raise ValueError(f"chunks of {size} samples are shorter than the margin of {margin}")
    parts = segments.where(F.col(samples).isNotNull()).select(*keys, F.col(first).cast("long").alias("_f"), F.col(samples).alias("_x")).withColumn("_e", F.col("_f") + F.size("_x"))
    length = parts.groupBy(*keys).agg(F.max("_e").alias("n"))
    rows = parts.join(length, list(keys)).withColumn("_k", F.expr(f"greatest(1L, n DIV {size})")).withColumn("_m", F.expr(f"IF(_k = 1, 0L, {margin}L)"))
    # Chunks that the segment has samples of; around the ends as well, so many samples earlier or later.
    last = "_k - 1"
    inside = f"transform(sequence(least({last}, greatest(0L, floor((_f - _m) / {size}))), least({last}, greatest(0L, floor((_e - 1 + _m) / {size})))), c -> struct(c as chunk, 0L as shift))"
    around = f"filter(array(struct(0L as chunk, -n as shift), struct({last} as chunk, n as shift)), w -> _k > 1 and IF(w.shift < 0, _e > n - _m, _f < _m))"
    rows = rows.withColumn("_w", F.explode(F.expr(f"concat({inside}, {around})"))).select("*", "_w.chunk", "_w.shift")
    rows = rows.withColumns({"own": F.expr(f"chunk * {size}L"), "end": F.expr(f"IF(chunk = {last}, n, (chunk + 1) * {size}L)")})
    rows = rows.withColumns({"_a": F.greatest(F.col("_f") + F.col("shift"), F.col("own") - F.col("_m")), "_b": F.least(F.col("_e") + F.col("shift"), F.col("end") + F.col("_m"))}).where("_a < _b")
    piece = F.expr("slice(_x, int(_a - _f - shift + 1), int(_b - _a))")
    grouped = rows.select(*keys, "n", "chunk", "own", "end", F.struct(F.col("_a").alias("a"), piece.alias("x")).alias("_p")).groupBy(*keys, "n", "chunk", "own", "end").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    return grouped.select(*keys, "n", "chunk", "own", "end", F.col("_p")[0]["a"].alias("at"), F.flatten(F.transform("_p", lambda p: p["x"])).cast("array<double>").alias("samples"))


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    """Each row's numbers; missing ones are NaN."""
    values = column.values.to_numpy(zero_copy_only=False).astype(float)
    ends = column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0), pa.float64()))


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Rows of one key each, from batches in order of key."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        names = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True))
        begin = 0
        for i, name in enumerate(names):
            if name != current:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, current = [], i, name
        if len(names) > begin:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def fdr_bounds(y: np.ndarray, alpha: float) -> tuple[float, float]:
    """The values next to 0, below and above it, at which the local false-discovery rate against a standard normal is under alpha. Where one side has none, the other's is
    taken; without either they are infinite."""
    y = y[np.isfinite(y)]
    n = len(y)
    span = np.ptp(y) if n else 0.0
    if not span > 0:
        return -math.inf, math.inf
    if n <= 1000:
        a, b = np.sort(y)[[int(0.25 * (n - 1)), int(0.75 * (n - 1))]]
    else:
        a, b = np.quantile(y, [0.25, 0.75], method="hazen")
    best: tuple[int, float] = (0, 0.0)
    for width in (2 * (b - a), 3.5 * y.std(ddof=1)):  # Freedman and Diaconis, Scott
        width *= n ** (-1 / 3)
        if not width > 0:
            continue
        wanted, unit = math.ceil(span / width), 10.0 ** math.floor(math.log10(width))
        nice = min((k * unit for k in (1, 2, 5, 10)), key=lambda w: abs(math.ceil(span / w) - wanted))
        best = max(best, (math.ceil(span / nice), nice), key=lambda c: c[0])
    if best[0]:
        n_bins, width = best
        start = math.floor(y.min() / width) * width
        edges = start + width * np.arange(min(max(n_bins, math.ceil((y.max() - start) / width)), 1 << 16) + 1)
    else:
        edges = np.linspace(y.min(), y.max(), max(7, int(math.log2(n)) + 1) + 1)
    middle = (edges[:-1] + edges[1:]) / 2
    density = np.histogram(y, edges)[0] / (n * np.diff(edges))
    found = middle[-(middle**2) / 2 - 0.5 * math.log(2 * math.pi) - np.log(np.maximum(density, 1e-15)) < math.log(alpha)]
    low = found[found < 0].max(initial=-math.inf)
    high = found[found > 0].min(initial=math.inf)
    return float(low if np.isfinite(low) else -high), float(high if np.isfinite(high) else -low)


def automatic_threshold(real: np.ndarray, frequency: np.ndarray, s: Settings) -> float:
    """Power from whitened real parts (sample, scale). At sampling rates over 1000 Hz up to a quarter of it, the three highest octaves are judged apart from those below."""
    parts = [real]
    low = s.n_scales - 3 * s.voices
    if s.oscillations and low > 0 and s.fs > 1000 and abs(frequency[-1] - s.fs / 4) < 1e-10:
        parts = [real[:, : low - 2], real[:, low - 1 : s.n_scales - 1]]
    bounds = [fdr_bounds(p.ravel(), s.alpha) for p in parts]
    return float(np.float32(((min(h for _, h in bounds) - max(b for b, _ in bounds)) / 2) ** 2))


def spread(values: np.ndarray) -> float:
    """Of those within one and a half quartile ranges of the quartiles; 1 where they have none."""
    if not len(values):
        return 1.0
    a, b = np.quantile(values, [0.25, 0.75], method="hazen")
    inner = values[(values >= a - 1.5 * (b - a)) & (values <= b + 1.5 * (b - a))]
    sd = inner.std(ddof=1) if len(inner) > 1 else 0.0
    return float(sd) if sd > 0 else 1.0


def backgrounds(chunks: DataFrame, keys: Sequence[str], s: Settings) -> DataFrame:
    """keys, ``sigma`` (spread of each scale) and ``threshold`` of power, a row per recording."""
    keys = list(keys)
    kinds = [chunks.schema[k] for k in keys]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, firsts, values = [], [], []
            bounds = zip(*(batch.column(c).to_pylist() for c in ("n", "own", "end", "at")), strict=True)
            for i, (x, (n, own, end, at)) in enumerate(zip(_arrays(batch.column("samples")), bounds, strict=True)):
                place = dsp.background_samples(n, s.fs)
                mine = np.flatnonzero((place >= own) & (place < end))
                if len(mine):
                    rows.append(i)
                    firsts.append(int(mine[0]))
                    values.append(s.transform(x)[0].real[:, place[mine] - at].T.ravel())
            some = batch.select(keys).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(firsts, pa.int64()), _lists(values)], [*keys, "_first", "_values"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = s.transform(np.ones(2))[1]
        for table in _runs(batches, len(keys)):
            parts = table.column("_values").combine_chunks()
            parts = parts if isinstance(parts, pa.ListArray) else parts.chunk(0)
            real = np.concatenate([v.reshape(-1, s.n_scales) for v in _arrays(parts)])
            sigma = np.array([spread(v) for v in real.T])
            threshold = automatic_threshold(real / sigma, frequency, s) if s.threshold is None else float(np.float32(s.threshold))
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in table.select(keys).slice(0, 1).columns), _lists([sigma]), pa.array([threshold])], [*keys, "sigma", "threshold"])

    values = chunks.select(*keys, "n", "own", "end", "at", "samples").mapInArrow(sampled, StructType([*kinds, StructField("_first", LongType()), StructField("_values", ArrayType(DoubleType()))]))
    by_key = values.repartition(*keys).sortWithinPartitions(*keys, "_first")
    return by_key.mapInArrow(judged, StructType([*kinds, StructField("sigma", ArrayType(DoubleType())), StructField("threshold", DoubleType())]))


def fade(place: np.ndarray, n: int, fs: float) -> np.ndarray:
    """Weights of samples of a recording of n: an eighth of a second at either end rises and falls like a cosine."""
    share = min(max(0.25 * fs / n, 0.0), 1.0)
    if share <= 0 or n < 2:
        return np.ones(len(place))
    x = place / (n - 1)
    return (1 - np.cos(np.pi * np.minimum(np.minimum(x, 1 - x) / (share / 2), 1.0))) / 2


def local_peaks(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale, sample) of inner cells that are positive and not less than any of their eight neighbours, in order of sample, then of scale."""
    rows, columns = np.nonzero(image[1:-1, 1:-1] > 0)
    rows, columns = rows + 1, columns + 1
    top = image[rows, columns]
    good = np.ones(len(rows), bool)
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            good &= top >= image[rows + i, columns + j]
    rows, columns = rows[good], columns[good]
    by = np.lexsort((rows, columns))
    return rows[by], columns[by]


def _first(outside: np.ndarray) -> int | None:
    k = int(outside.argmax()) if len(outside) else 0
    return k if len(outside) and outside[k] else None


def half_height(power: np.ndarray, scale: int, sample: int, at: int, n: int, fs: float) -> tuple[float, float, float, float]:
    """How far the region around a peak reaches later, earlier, up and down the scales: to the first cell under half its height or over it.

    ``sample`` counts from the recording's start, ``at`` is that of the first column. Time is followed for half a second at most, less at the ends; where no such
    cell is met, half of that counts. A side without one across the scales is taken to be as wide as the other, or reaches the edge.
    """
    column = power[:, sample - at]
    top = column[scale]
    outside = lambda x: (x < top / 2) | (x > top)
    reach = int(0.5 * fs)
    reach = max(1, n - sample if sample + reach > n else min(reach, sample - 1))
    here = sample - at
    later = _first(outside(power[scale, here + 1 : here + reach + 1])) if sample + reach < n else None
    earlier = _first(outside(power[scale, here - reach : here + 1][::-1])) if sample >= reach else None
    up, down = _first(outside(column[scale + 1 :])), _first(outside(column[:scale][::-1]))
    high = up if up is not None else down
    low = down if down is not None else up
    return (
        float(reach / 2 if later is None else later), float(reach / 2 if earlier is None else earlier + 1),
        float(len(column) - scale if high is None else high + 1), float(scale - 1 if low is None else low + 1),
    )


#: Columns of a peak besides its keys: where it is, how strong, how far it reaches, its class and its scale's spread.
PEAK = {
    "sample": "bigint", "scale": "bigint", "frequency": "double", "strength": "double", "later": "double", "earlier": "double", "up": "double", "down": "double",
    "span": "double", "kind": "string", "sigma": "double",
}


def _classes(rows: np.ndarray, frequency: np.ndarray, s: Settings) -> np.ndarray:
    """Oscillation, spike or nothing. rows: scale, later, earlier, up, down, span."""
    scale = rows[:, 0].astype(np.int64)
    span, width = (rows[:, 1] + rows[:, 2]) / rows[:, 5], rows[:, 3] + rows[:, 4]
    out = np.full(len(rows), None, object)
    unit = s.voices / 12
    if s.oscillations:
        f = frequency[scale]
        inside = (f >= min(min(b) for b in s.bands)) & (f <= max(max(b) for b in s.bands))
        out[inside & (span >= s.oscillation_span) & (width < s.oscillation_width * unit)] = OSCILLATION
    if s.spikes:
        out[(span < s.spike_span) & (width >= s.spike_width * unit) & (frequency[scale] <= SPIKE_LIMIT)] = SPIKE
    return out


def peaks(chunks: DataFrame, known: DataFrame, keys: Sequence[str], s: Settings) -> DataFrame:
    """Classified peaks over the threshold, with keys and the columns of ``PEAK``; each chunk gives those among the samples that it owns."""
    keys = list(keys)
    kinds = ", ".join(f"`{k}` {chunks.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, parts = [], []
            bounds = zip(*(batch.column(c).to_pylist() for c in ("n", "own", "end", "at", "threshold")), strict=True)
            for i, (x, sigma, (n, own, end, at, threshold)) in enumerate(zip(_arrays(batch.column("samples")), _arrays(batch.column("sigma")), bounds, strict=True)):
                tf, frequency = s.transform(x)
                power = np.abs(tf / sigma[:, None]) ** 2 * fade(np.arange(at, at + len(x)), n, s.fs)
                # A peak in the first or last sample of what a chunk owns needs its neighbours, and no others are looked at.
                lo, hi = max(0, own - at - 1), min(len(x), end - at + 1)
                view = power[:, lo:hi]
                scale, sample = local_peaks(np.where(view > threshold, view, 0.0))
                sample = sample + lo + at
                reach = np.array([half_height(power, a, b, at, n, s.fs) for a, b in zip(scale.tolist(), sample.tolist(), strict=True)]).reshape(-1, 4)
                span = np.ceil(math.sqrt(2 * math.log(2) * s.moment) / math.pi * s.fs / frequency[scale])
                kind = _classes(np.column_stack([scale, reach, span]), frequency, s)
                keep = np.array([k is not None for k in kind], bool)
                owner.append(np.full(keep.sum(), i))
                spread_of = np.float32(sigma).astype(float)[scale]
                parts.append([c[keep] for c in (sample, scale, frequency[scale], power[scale, sample - at], *reach.T, span, kind, spread_of)])
            some = batch.select(keys).take(pa.array(np.concatenate(owner) if owner else [], pa.int64()))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * len(PEAK)
            types = [{"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[t] for t in PEAK.values()]
            yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array(c.tolist(), t) for c, t in zip(columns, types, strict=True))], [*keys, *PEAK])

    rows = chunks.join(known, keys).select(*keys, "n", "own", "end", "at", "threshold", "samples", "sigma")
    return rows.mapInArrow(run, f"{kinds}, " + ", ".join(f"{k} {t}" for k, t in PEAK.items()))


class Sweep:
    """Which peaks of one kind stay, from rows in order of time. It holds the peaks of the last second, and those that later ones may still decide."""

    COLUMNS = ("sample", "scale", "strength", "later", "earlier", "up", "down", "sigma")

    def __init__(self, fs: float, kind: str) -> None:
        self.fs, self.kind = fs, kind
        self.rows = np.zeros((0, len(self.COLUMNS) + 1))
        self.alive = np.zeros(0, bool)
        self.next = 0

    def push(self, rows: np.ndarray, ended: bool) -> np.ndarray:
        """Numbers (the last column of what was pushed) of those that are decided now and stay."""
        self.rows = np.concatenate([self.rows, rows])
        self.alive = np.append(self.alive, np.ones(len(rows), bool))
        time, begin = self.rows[:, 0], self.next
        until = len(time) if ended else int(np.searchsorted(time, time[-1] - self.fs, side="right")) if len(time) else 0
        for i in range(begin, until):
            lo, hi = int(np.searchsorted(time, time[i] - self.fs, side="right")), int(np.searchsorted(time, time[i] + self.fs))
            self.alive[i] = not self._beaten(i, lo, hi)
        self.next = max(begin, until)
        out = self.rows[begin : self.next, -1][self.alive[begin : self.next]]
        past = int(np.searchsorted(time, time[self.next] - self.fs, side="right")) if self.next < len(time) else self.next
        self.rows, self.alive, self.next = self.rows[past:], self.alive[past:], self.next - past
        return out

    def _beaten(self, i: int, lo: int, hi: int) -> bool:
        """By a live one less than a second away: an oscillation by one as strong that it overlaps in time and scales, or by one an octave below that is as strong before whitening;
        a spike by one of no higher frequency that it overlaps in time."""
        wide = 2 if self.kind == OSCILLATION else 1
        t, scale, strength, later, earlier, up, down, sigma = self.rows[lo:hi, :-1].T
        me = i - lo
        live = self.alive[lo:hi].copy()
        live[me] = False
        begin, end = t - wide * earlier, t + wide * later
        live &= (begin <= end[me]) & (begin[me] <= end)
        if self.kind != OSCILLATION:
            return bool((live & (scale[me] >= scale)).any())
        low, high = scale - down, scale + up
        shared = (low <= high[me]) & (low[me] <= high)
        apart = scale[me] - scale
        power = strength * np.float32(sigma) ** 2
        return bool((live & np.where(shared, strength >= strength[me], (apart > HARMONIC[0]) & (apart < HARMONIC[1]) & (power >= power[me]))).any())


def sparse(found: DataFrame, keys: Sequence[str], fs: float) -> DataFrame:
    """Peaks that no other one outdoes, kinds apart. Streams are a recording's peaks between seconds without any."""
    keys = list(keys)
    order = Window.partitionBy(*keys, "kind").orderBy("sample", "scale")
    gap = F.coalesce(F.col("sample") - F.lag("sample").over(order) >= fs, F.lit(True))
    rows = found.withColumn("_gap", gap.cast("int")).withColumn("_stream", F.sum("_gap").over(order)).drop("_gap")
    schema = found.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep: Sweep | None = None
        current: tuple | None = None
        held: pa.Table | None = None
        base = 0

        def step(new: pa.Table | None, ended: bool) -> pa.Table:
            """Pushes ``new``; rows whose number is before the sweep's oldest are let go of."""
            nonlocal held, base
            assert sweep is not None
            n = new.num_rows if new is not None else 0
            before = held.num_rows if held is not None else 0
            values = np.column_stack([*(new.column(c).to_numpy() for c in Sweep.COLUMNS), np.arange(n) + base + before]) if n else np.zeros((0, len(Sweep.COLUMNS) + 1))
            held = pa.concat_tables([t for t in (held, new) if t is not None])
            stay = sweep.push(values.astype(float), ended).astype(np.int64) - base
            out = held.take(pa.array(np.sort(stay)))
            gone = held.num_rows if ended or sweep.next >= len(sweep.rows) else int(sweep.rows[sweep.next, -1]) - base
            held, base = held.slice(gone), base + gone
            return out

        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = list(zip(*(table.column(c).to_pylist() for c in (*keys, "kind", "_stream")), strict=True))
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if names[a] != current:
                    if sweep is not None:
                        yield from step(None, True).select(schema.names).to_batches()
                    sweep, current, held, base = Sweep(fs, names[a][len(keys)]), names[a], None, 0
                yield from step(table.slice(a, b - a), False).select(schema.names).to_batches()
        if sweep is not None:
            yield from step(None, True).select(schema.names).to_batches()

    parts = rows.repartition(*keys, "kind", "_stream").sortWithinPartitions(*keys, "kind", "_stream", "sample", "scale")
    return parts.mapInArrow(run, StructType(schema.fields))


def detect(segments: DataFrame, keys: Sequence[str], settings: Settings, size: int = CHUNK, first: str = "first", samples: str = "samples") -> DataFrame:
    """Detections of recordings: keys, event_type (``Spike`` or the band of the peak's frequency), onset_s, area (of the region, as an ellipse) and the columns of ``PEAK``."""
    chunks = chunked(segments, keys, settings.margin, max(size, settings.margin), first, samples)
    found = sparse(peaks(chunks, backgrounds(chunks, keys, settings), keys, settings), keys, settings.fs)
    name = F.when(F.col("kind") == SPIKE, F.lit(SPIKE)).otherwise(F.coalesce(classify_band(F.col("frequency")), F.lit("Oscillation")))
    area = F.lit(math.pi / 4) * (F.col("later") + F.col("earlier")) * (F.col("up") + F.col("down"))
    return found.select(*keys, name.alias("event_type"), (F.col("sample") / settings.fs).alias("onset_s"), area.alias("area"), *PEAK)


def grid_peaks(df: DataFrame, key: str, power: str, n_scales: int, fs: float) -> DataFrame:
    """Local maxima of each row's grid (``power``: one scale's samples after the other's) with their half-height extents."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, x in enumerate(_arrays(batch.column(1))):
                grid = x.reshape(n_scales, -1)
                for a, b in zip(*(v.tolist() for v in local_peaks(grid)), strict=True):
                    owner.append(i)
                    rows.append((a, b, float(grid[a, b]), *half_height(grid, a, b, 0, grid.shape[1], fs)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64(), pa.int64(), *[pa.float64()] * 5]
            names = ["scale", "sample", "strength", "later", "earlier", "up", "down"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [key, *names])

    return df.where(F.col(power).isNotNull()).select(key, power).mapInArrow(run, f"{key} {kind}, scale bigint, sample bigint, strength double, later double, earlier double, up double, down double")
