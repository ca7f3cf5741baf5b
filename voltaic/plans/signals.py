"""Queries of signals held as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detection, dsp, filters
from . import pipelines
from .tables import read, rounded

QUERIES, SQL = {}, {}


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))


def _event_segments(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.expr("event_id DIV 1000 * 1000").alias("first"), F.struct("event_id", F.coalesce("value", F.lit(0.0)).alias("v")).alias("s"))
    return e.groupBy("first").agg(F.array_sort(F.collect_list("s")).alias("s")).select(F.lit("events").alias("recording"), "first", F.transform("s", lambda x: x["v"]).alias("samples"))


def query(sql: str | None = None):
    """Register a query under its name with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _band_power(x: np.ndarray) -> np.ndarray:
    spectrum = np.fft.fft(x)
    keep = np.zeros(len(x))
    keep[4:9] = 1
    return np.abs(np.fft.ifft(spectrum * keep)) * 2


@query("""WITH s AS (SELECT vec_id, i - 1 AS n, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) AS r(i)), k AS (SELECT k FROM range(4, 9) AS g(k)),
 f AS (SELECT vec_id, k, sum(v * cos(2 * pi() * k * n / 64)) AS re, -sum(v * sin(2 * pi() * k * n / 64)) AS im FROM s, k GROUP BY ALL),
 b AS (SELECT vec_id, n, sum(re * cos(2 * pi() * k * n / 64) - im * sin(2 * pi() * k * n / 64)) / 64 AS re, sum(re * sin(2 * pi() * k * n / 64) + im * cos(2 * pi() * k * n / 64)) / 64 AS im FROM f, range(0, 64) AS g(n) GROUP BY ALL)
 SELECT vec_id, n::BIGINT AS pos, round(2 * sqrt(re * re + im * im), 4) AS amplitude FROM b""")
def ideal_band_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Amplitude of bins 4 to 8 of the spectrum."""
    out = dsp.map_arrays(_signals(spark, d), "samples", "envelope", _band_power)
    return out.select("vec_id", F.posexplode("envelope").alias("pos", "amplitude")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("amplitude", 4).alias("amplitude"))


@query()
def hilbert_envelope(spark: SparkSession, d: str) -> DataFrame:
    out = dsp.map_arrays(_signals(spark, d), "samples", "envelope", lambda x: dsp.band_envelope(x, 256.0, 20.0, 60.0, 10.0, 16.0, 128))
    return rounded(out.select("vec_id", F.posexplode("envelope").alias("pos", "value")))


@query()
def envelope_windows(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes by the grid's filters, smoothed over three windows and centred."""
    variant = filters.Envelope((20.0, 30.0, 40.0, 50.0, 60.0), 128, (0, 16, 40), centred=True)
    out = filters.envelopes(_signals(spark, d), "samples", 256.0, variant)
    return rounded(out.select("vec_id", "smooth_ms", F.posexplode("envelope").alias("pos", "value")))


@query()
def notch_events(spark: SparkSession, d: str) -> DataFrame:
    """The values of all events as one long recording, without 50 and 100 Hz, in chunks."""
    out = filters.notch(_event_segments(spark, d), ["recording"], 256.0, [50.0, 100.0], size=4096)
    return rounded(out.select("recording", "first", F.posexplode("samples").alias("pos", "value")))


@query()
def multitaper_power(spark: SparkSession, d: str) -> DataFrame:
    out = dsp.map_arrays(_signals(spark, d), "samples", "power", lambda x: dsp.multitaper_db(x, 64.0, [8.0, 12.0, 16.0, 20.0], 0.5, 4.0, 4).reshape(-1))
    rows = out.select("vec_id", F.posexplode("power").alias("cell", "power_db"))
    return rounded(rows.withColumn("power_db", F.when(~F.isnan("power_db"), F.col("power_db"))))


@query("""WITH s AS (SELECT vec_id, i - 1 AS n, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) AS r(i)),
 f AS (SELECT vec_id, k, sum(v * cos(2 * pi() * k * n / 64)) AS re, sum(v * sin(2 * pi() * k * n / 64)) AS im FROM s, range(0, 64) AS g(k) GROUP BY ALL),
 w AS (SELECT i AS scale, power(2, (7 - i) / 4.0::DOUBLE) AS s FROM range(0, 8) AS g(i)),
 h AS (SELECT scale, s, k, power(s * 2 * pi() * k / 64, 4) * exp(-8 / (pi() * pi()) * power(s * 2 * pi() * k / 64, 2)) AS h FROM w, range(0, 64) AS g(k))
 SELECT vec_id, scale::BIGINT AS scale, round(any_value(s) * sum((re * re + im * im) * h * h) / 4096, 4) AS power FROM f JOIN h USING (k) GROUP BY vec_id, scale""")
def dog_cwt(spark: SparkSession, d: str) -> DataFrame:
    """Mean power of each scale; by SQL the same from the spectrum (Parseval)."""
    out = dsp.map_arrays(_signals(spark, d), "samples", "power", lambda x: (np.abs(dsp.dog_wavelet(x, 64.0, (0, 2), 4, 4)[0]) ** 2).mean(axis=1))
    return out.select("vec_id", F.posexplode("power").alias("scale", "power")).select("vec_id", F.col("scale").cast("long").alias("scale"), F.round("power", 4).alias("power"))


@query()
def lfdr_threshold(spark: SparkSession, d: str) -> DataFrame:
    out = dsp.map_arrays(_signals(spark, d), "samples", "threshold", lambda x: np.array([detection.fdr_bounds((x - x.mean()) / x.std(), 0.2)[1]]))
    return rounded(out.select("vec_id", F.nullif(F.get("threshold", F.lit(0)), F.lit(float("inf"))).alias("threshold")))


@query()
def hfo_detect(spark: SparkSession, d: str) -> DataFrame:
    """Each row is a recording of its own."""
    settings = detection.Settings(64.0, bands=((8.0, 16.0),), threshold=8.0)
    return rounded(detection.detect(_signals(spark, d).withColumn("first", F.lit(0)), ["vec_id"], settings), "vec_id", "event_type", "sample", "frequency", "strength")


@query()
def event_detections(spark: SparkSession, d: str) -> DataFrame:
    """The values of all events, by their numbers, as one long recording in segments of a thousand, cut into chunks; the threshold is automatic."""
    settings = detection.Settings(256.0, bands=((12.0, 64.0),), threshold=None, alpha=0.2)
    return rounded(detection.detect(_event_segments(spark, d), ["recording"], settings, size=4096))


@query("""WITH g AS (SELECT vec_id, (i - 1) // 8 AS s, (i - 1) % 8 AS t, embedding[i]::DOUBLE * embedding[i]::DOUBLE AS p FROM embeddings, range(1, 65) AS r(i)),
 k AS (SELECT a.*, greatest(1, CASE WHEN t + 4 > 8 THEN 8 - t ELSE least(4, t - 1) END) AS reach FROM g a WHERE s BETWEEN 1 AND 6 AND t BETWEEN 1 AND 6 AND p > 0
  AND NOT EXISTS (SELECT 1 FROM g b WHERE b.vec_id = a.vec_id AND b.s BETWEEN a.s - 1 AND a.s + 1 AND b.t BETWEEN a.t - 1 AND a.t + 1 AND b.p > a.p)),
 o AS (SELECT k.vec_id, k.s, k.t, min(CASE WHEN g.s = k.s AND g.t > k.t AND g.t <= k.t + reach AND k.t + reach < 8 THEN g.t - k.t - 1 END) AS later,
  min(CASE WHEN g.s = k.s AND g.t < k.t AND g.t >= k.t - reach AND k.t >= reach THEN k.t - g.t + 1 END) AS earlier,
  min(CASE WHEN g.t = k.t AND g.s > k.s THEN g.s - k.s END) AS up, min(CASE WHEN g.t = k.t AND g.s < k.s THEN k.s - g.s END) AS down
  FROM k JOIN g ON g.vec_id = k.vec_id AND (g.p < k.p / 2 OR g.p > k.p) GROUP BY ALL)
 SELECT k.vec_id, k.s::BIGINT AS scale, k.t::BIGINT AS sample, round(p, 6) AS strength, coalesce(later, reach / 2)::DOUBLE AS later, coalesce(earlier, reach / 2)::DOUBLE AS earlier,
  coalesce(up, down, 8 - k.s)::DOUBLE AS up, coalesce(down, up, k.s - 1)::DOUBLE AS down FROM k LEFT JOIN o ON k.vec_id = o.vec_id AND k.s = o.s AND k.t = o.t""")
def half_height_extents(spark: SparkSession, d: str) -> DataFrame:
    """Squares of each row's 64 values as eight scales of eight samples."""
    grid = _signals(spark, d).select("vec_id", F.transform("samples", lambda x: x * x).alias("power"))
    return rounded(detection.grid_peaks(grid, "vec_id", "power", 8, 8.0))


def _contributions(spark: SparkSession, d: str) -> DataFrame:
    """Epoch means of labels as regions: trial as subject, feature as channel."""
    from .tables import epochs

    return epochs(spark, d).select(F.concat(F.lit("R"), F.col("label").cast("string")).alias("roi"), F.col("trial").cast("string").alias("subject"), F.col("feature").cast("string").alias("channel"), "t_idx", (F.col("v") + 0.2).alias("v"))


@query()
def group_cluster_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pipelines.group_test(_contributions(spark, d), "cluster", n_iter=20))


@query()
def group_fdr_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pipelines.group_test(_contributions(spark, d)))


@query()
def condition_test_pipeline(spark: SparkSession, d: str) -> DataFrame:
    from .tables import epochs

    return rounded(pipelines.condition_test(pipelines.clean_epochs(epochs(spark, d)), baseline=(-0.2, 0.0)))


@query()
def regression_pipeline(spark: SparkSession, d: str) -> DataFrame:
    from .tables import epochs

    return rounded(pipelines.regression_test(epochs(spark, d), zscore_x=True))


@query()
def time_frequency_pipeline(spark: SparkSession, d: str) -> DataFrame:
    out = pipelines.time_frequency(_signals(spark, d), frequencies=(8.0, 12.0, 16.0), fs=64.0, window_s=0.5, smoothing_hz=4.0, step=4)
    return rounded(out)
