"""Records of recordings and regions: atlas lookup through a result's sources, event files, annotations of envelopes, detections, pairs for scatter plots."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import field_name
from .catalog import KEYS, compatible_pairs, modify_entities
from .groups import BANDS, SPIKE, channel_key, no_region

#: Columns of a table of detections, in order, and what stands where a detection has none.
DETECTION = {
    "onset": 0.0, "duration": 0.0, "channel": "", "event_type": "", "peak_frequency": 0.0,
    "sample_index": 0, "frequency_index": 0, "detection_strength": 0.0, "color": "#808080",
}
#: Label, unit and scale of values by the way they were normalised.
UNITS = {"none": ("amplitude", "µV", 1e-6), "percent": ("percent", "%", 1.0), "percent_centered": ("percent", "%", 1.0), "db": ("dB", "dB", 1.0)}
#: Columns that may have a channel's name, by preference.
CHANNEL_COLUMNS = ("name", "channel", "label")


def select_column(columns: Sequence[str], preferred: Sequence[str]) -> str | None:
    """The first preferred name that is a column, in any case; of columns alike but for case the last."""
    known = {c.casefold(): c for c in columns}
    return next((known[p.casefold()] for p in preferred if p.casefold() in known), None)


def atlas_rows(table: DataFrame, atlas: str, keep: Sequence[str] = ("file",), without: str = "error") -> DataFrame:
    """(file, name, region) of an electrode table: the channel's column by preference, and the atlas's, in any case.

    A table without these columns is an error, or gives no rows (``without="skip"``, as group statistics of time and frequency take them).
    """
    if without not in ("error", "skip"):
        raise ValueError(f"unknown way with tables without the columns: {without}")
    name, region = select_column(table.columns, CHANNEL_COLUMNS), select_column(table.columns, [atlas])
    if name is None or region is None:
        if without == "skip":
            return table.where(F.lit(False)).select(*keep, F.lit("").alias("name"), F.lit("").alias("region"))
        raise ValueError(f"the table has no column of {'channels' if name is None else atlas}")
    return table.select(*keep, F.trim(name).alias("name"), F.trim(region).alias("region"))


def _labelled(electrodes: DataFrame) -> DataFrame:
    """Rows with a name and a region, with the name's key."""
    return electrodes.where((F.trim("name") != "") & ~no_region(F.col("region"))).withColumns({"_k": channel_key(F.col("name")), "region": F.trim("region")})


def _one(region: str, what: Column) -> Column:
    """The only region of a group; several are an error."""
    return F.when(F.min(region) == F.max(region), F.min(region)).otherwise(F.raise_error(F.concat(what, F.lit(" has several regions: "), F.min(region), F.lit(", "), F.max(region))))


def assign_regions(channels: DataFrame, sources: DataFrame, electrodes: DataFrame, item: str = "item") -> DataFrame:
    """(item, channel, region): a result's channels looked up in the electrode tables of its sources.

    ``sources`` has (item, file): the table that matches each recording best. Names are compared without case and blanks around them. A channel with several regions, in
    one table or across an item's tables, is an error; channels without a region go.
    """
    tables = _labelled(electrodes).groupBy("file", "_k").agg(_one("region", F.concat(F.first("file").cast("string"), F.lit(": "), F.first("name"))).alias("region"))
    rows = channels.select(item, "channel", channel_key(F.col("channel")).alias("_k")).join(sources.select(item, "file").distinct(), item).join(tables, ["file", "_k"])
    return rows.groupBy(item, "_k").agg(F.max("channel").alias("channel"), _one("region", F.max("channel")).alias("region")).drop("_k")


def last_regions(channels: DataFrame, sources: DataFrame, electrodes: DataFrame, item: str = "item") -> DataFrame:
    """As ``assign_regions``, but later tables (``place`` in the sources) and later rows (``row_index``) win over earlier ones without an error."""
    rows = channels.select(item, "channel", channel_key(F.col("channel")).alias("_k")).join(sources.select(item, "file", "place"), item).join(_labelled(electrodes).select("file", "row_index", "_k", "region"), ["file", "_k"])
    return rows.groupBy(item, "_k").agg(F.max("channel").alias("channel"), F.max_by("region", F.struct("place", "row_index")).alias("region")).drop("_k")


def region_fields(records: DataFrame, region: str = "region", clash: str = "error") -> DataFrame:
    """Records with ``field``, the region's name as a field. Two regions of one field are an error, or are merged (``clash="merge"``)."""
    if clash not in ("error", "merge"):
        raise ValueError(f"unknown way with a clash: {clash}")
    out = records.withColumn("field", field_name(F.col(region)))
    if clash == "merge":
        return out
    names = out.groupBy("field").agg(F.min(region).alias("_a"), F.max(region).alias("_b"))
    why = F.concat(F.lit("regions "), "_a", F.lit(" and "), "_b", F.lit(" are one field"))
    return out.join(names, "field").withColumn("field", F.when(F.col("_a") == F.col("_b"), F.col("field")).otherwise(F.raise_error(why))).drop("_a", "_b")


def events_files(recordings: DataFrame, files: DataFrame, path: str = "path", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(recording, events_file): the one compatible events table of each recording, unknown without one; several are an error. Both sides have their entities."""
    tables = files.where((F.col("suffix") == "events") & (F.lower("extension") == ".tsv"))
    pairs = compatible_pairs(recordings, tables, path, keys).groupBy("target").agg(F.min("candidate").alias("_a"), F.max("candidate").alias("_b"))
    why = F.concat("target", F.lit(" has several events tables: "), "_a", F.lit(", "), "_b")
    one = pairs.select(F.col("target").alias("recording"), F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.raise_error(why)).alias("events_file"))
    return recordings.select(F.col(path).alias("recording")).distinct().join(one, "recording", "left")


def secondary_files(frames: Iterable[DataFrame], path: str = "path") -> DataFrame:
    """Files of several searches, each path once."""
    return reduce(lambda a, b: a.unionByName(b), frames).dropDuplicates([path])


def group_entities(found: Column) -> Column:
    """Entities of a group's result: its subject is ``group``."""
    return modify_entities(found, {"sub": "group"})


def envelope_annotations(events: DataFrame, fs: float) -> DataFrame:
    """Events of an envelope file (onset and duration in samples) as annotations in seconds: stimuli get ``S`` before their code, responses ``R``; a description with a slash stays."""
    kind = F.trim(F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("Stimulus")))
    what = F.trim(F.coalesce("description", F.lit("")))
    prefix = F.when(kind == "Stimulus", "Stimulus/S ").when(kind == "Response", "Response/R ")
    text = (
        F.when(what.contains("/"), what)
        .when((what != "") & prefix.isNotNull(), F.concat(prefix, what))
        .otherwise(F.concat_ws("/", F.nullif(kind, F.lit("")), F.coalesce(F.nullif(what, F.lit("")), F.lit("n/a"))))
    )
    seconds = {c: F.coalesce(F.col(c), F.lit(0)) / F.lit(float(fs)) for c in ("onset", "duration")}
    return events.withColumns({**seconds, "text": text})


def detection_table(detections: DataFrame) -> DataFrame:
    """The columns of a table of detections, in their order; what is missing has its default."""
    have = set(detections.columns)
    return detections.select(*((F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v)).alias(c) for c, v in DETECTION.items()))


def band_counts(detections: DataFrame, channels: DataFrame, channel: str = "channel", kind: str = "event_type", frequency: str = "peak_frequency") -> DataFrame:
    """Per channel how many oscillations lie in each band (a column per band, by its name as a field), and how many spikes; 0 where there are none."""
    names = {name.lower().replace(" ", "_"): (F.col(kind) != SPIKE) & (F.col(frequency) >= low) & (F.col(frequency) < high) for name, low, high in BANDS}
    names["n_spikes"] = F.col(kind) == SPIKE
    counts = detections.groupBy(channel).agg(*(F.count_if(test).alias(name) for name, test in names.items()))
    return channels.select(channel).distinct().join(counts, channel, "left").select(channel, *(F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names))


def scatter_pairs(records: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """A row per trial of the arrays x and y; records whose arrays differ in length, or that have none, are left out."""
    same = records.where(F.coalesce((F.size(x) == F.size(y)) & (F.size(x) > 0), F.lit(False)))
    return same.select(*keys, F.posexplode(F.arrays_zip(F.col(x).alias("x"), F.col(y).alias("y"))).alias("pos", "_p")).select(*keys, "pos", "_p.x", "_p.y")


def valued_rows(df: DataFrame, values: str = "values") -> DataFrame:
    """Rows whose array has a finite value."""
    return df.where(F.coalesce(F.exists(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)))


def require_metric(results: DataFrame, metric: str, available: str = "available_metrics", path: str = "path") -> DataFrame:
    """Results, all of which must offer the metric."""
    has = F.coalesce(F.array_contains(available, metric), F.lit(False))
    return results.where(F.when(has, True).otherwise(F.raise_error(F.concat(F.lit(f"{metric} is not available in "), F.col(path))).cast("boolean")))


def flat_feature(channel: Column, frequency: Column, n_frequencies: int) -> Column:
    """One number for a channel and a frequency."""
    return channel * n_frequencies + frequency


def channel_and_frequency(feature: Column, n_frequencies: int) -> tuple[Column, Column]:
    """What ``flat_feature`` was made of."""
    f = F.pmod(feature, F.lit(n_frequencies))
    return ((feature - f) / n_frequencies).cast("long"), f


def merged_parameters(base: dict, changes: dict) -> dict:
    """Nested parameters with changes; dictionaries on both sides are merged, other values replaced."""
    both = {k: merged_parameters(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in changes.items()}
    return {**base, **both}
