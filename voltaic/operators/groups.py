"""Channels, regions and group statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import one_sample_t

#: Region labels that mean none, once all but letters and digits is gone.
NO_REGION = ("na", "notavailable", "notapplicable")
#: Frequency bands of detections, from - to below, in Hz.
BANDS = (
    ("Infra slow", 0.0, 1.0), ("Delta", 1.0, 3.5), ("Theta", 3.5, 7.4), ("Alpha", 7.4, 12.4), ("Beta", 12.4, 24.0), ("Gamma", 24.0, 80.0),
    ("Ripple", 80.0, 250.0), ("Fast Ripple", 250.0, 500.0), ("Very Fast Osc", 500.0, float("inf")),
)
#: Fixed value: the class of detections that have no band.
SPIKE = "Spike"


def channel_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def channel_parts(name: Column) -> tuple[Column, Column]:
    """Prefix and trailing number of a contact's name; unknown without either."""
    pattern = r"^(.*\D)(\d+)$"
    clean = F.trim(name)
    prefix, number = F.regexp_extract(clean, pattern, 1), F.regexp_extract(clean, pattern, 2)
    return F.nullif(prefix, F.lit("")), F.nullif(number, F.lit("")).try_cast("int")


def no_region(label: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(label), "[^a-z0-9]", "").isin(*NO_REGION, ""), F.lit(True))


def bipolar_pairs(channels: DataFrame, by: Sequence[str] = (), name: str = "name") -> DataFrame:
    """Neighbouring contacts of one electrode: index and index + 1 of the same prefix, labelled ``first-second``.

    A window over each electrode's contacts instead of a self join.
    """
    prefix, number = channel_parts(F.col(name))
    rows = channels.withColumns({"prefix": prefix, "number": number}).where("prefix is not null and number is not null")
    w = Window.partitionBy(*by, "prefix").orderBy("number", name)
    rows = rows.withColumns({"second": F.lead(name).over(w), "_n": F.lead("number").over(w)}).where(F.col("_n") == F.col("number") + 1)
    return rows.select(*by, F.col(name).alias("first"), "second", F.concat_ws("-", name, "second").alias("label"), "prefix", "number")


def lookup_regions(channels: DataFrame, atlas: DataFrame, channel: str = "channel", name: str = "name", region: str = "region") -> DataFrame:
    """Channels with their region by normalised name; unmatched ones and those without a region go; ``conflict`` where the atlas disagrees."""
    named = atlas.where(~no_region(F.col(region))).groupBy(channel_key(F.col(name)).alias("_k")).agg(F.min(region).alias("region"), (F.countDistinct(region) > 1).alias("conflict"))
    return channels.join(named, channel_key(F.col(channel)) == F.col("_k")).drop("_k")


def region_thresholds(records: DataFrame, min_channels: int, min_subjects: int, region: str = "region", subject: str = "subject", channel: str = "channel") -> DataFrame:
    """Channels and subjects of each region, and why it is left out (channels are looked at first)."""
    s = records.groupBy(region).agg(F.countDistinct(subject, channel).alias("n_channels"), F.countDistinct(subject).alias("n_subjects"))
    few_c = F.concat(F.lit("insufficient_channels:"), F.col("n_channels").cast("string"), F.lit(f"<{min_channels}"))
    few_s = F.concat(F.lit("insufficient_subjects:"), F.col("n_subjects").cast("string"), F.lit(f"<{min_subjects}"))
    why = F.when(F.col("n_channels") == 0, "no_channels").when(F.col("n_channels") < min_channels, few_c).when(F.col("n_subjects") < min_subjects, few_s)
    return s.withColumn("excluded", why)


def region_statistics(records: DataFrame, keys: Sequence[str], region: str = "region", value: str = "v", p: bool = False) -> DataFrame:
    """Mean against 0 over a region's contributions."""
    return one_sample_t(records, [region, *keys], value, p=p)


def missing_channels(wanted: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wanted channels that no input has, each once."""
    return wanted.select(*keys).distinct().join(present.select(*keys).distinct(), list(keys), "left_anti")


def event_rates(events: DataFrame, channels: DataFrame, types: Sequence[str], channel: str = "channel", kind: str = "event_type", duration_s: float = 1.0) -> DataFrame:
    """Rate of each type by channel (a column per type), 0 where there is none; every channel has a row."""
    counts = events.groupBy(channel).pivot(kind, list(types)).count()
    out = channels.select(channel).distinct().join(counts, channel, "left")
    return out.select(channel, *(F.round(F.coalesce(F.col(t), F.lit(0)) / duration_s, 6).alias(t) for t in types))


def classify_band(frequency: Column) -> Column:
    """The band's name, by ``BANDS``."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(BANDS):
        out = F.when((frequency >= low) & (frequency < high), F.lit(name)).otherwise(out)
    return out


def compatible_groups(inputs: DataFrame, parts: Sequence[str], path: str = "path") -> DataFrame:
    """Inputs that may be pooled: a row per signature, with its first file and size."""
    return inputs.groupBy(*parts).agg(F.min(path).alias("primary"), F.count(F.lit(1)).alias("n_files"))


def select_channels(channels: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), name: str = "name") -> DataFrame:
    """Channels whose whole name is one of, or matches one of, ``include`` (all without it) and none of ``exclude``. A term that matches nothing is an error."""

    def test(terms: Sequence[str]) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | (F.col(name) == t) | F.col(name).rlike(f"^(?:{t})$")
        return out

    terms = [*include, *exclude]
    if terms:
        counts = channels.agg(*(F.count(F.when(test([t]), 1)).alias(f"n{i}") for i, t in enumerate(terms))).first()
        if lost := [t for i, t in enumerate(terms) if not counts[i]]:
            raise ValueError(f"no channel matches {', '.join(lost)}")
    out = channels.where((test(include) if include else F.lit(True)) & ~test(exclude))
    if out.isEmpty():
        raise ValueError("no channel is left")
    return out


def anchors_or_numbers(events: DataFrame, n: int, by: str, order: str = "onset") -> DataFrame:
    """The first n anchors of each recording, or, where it has fewer, n synthetic ones at 0, 1, ..."""
    w = Window.partitionBy(by)
    rows = events.withColumns({"_k": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    real = rows.where((F.col("_n") >= n) & (F.col("_k") < n)).select(by, F.col("_k").cast("long").alias("trial"), F.col(order).cast("double").alias("onset"))
    few = rows.where(F.col("_n") < n).select(by).distinct().withColumn("trial", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return real.unionByName(few.withColumn("onset", F.col("trial").cast("double")))


def check_compatible(inputs: DataFrame, parts: Sequence[str], level: str = "feature_level") -> None:
    """Raises if inputs are not all of channels, or differ in a part of their signature. One row is looked at on the driver."""
    facts = inputs.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(level) != "channel", 1)).alias("other"), *(F.count_distinct(p).alias(p) for p in parts)).first()
    if not facts["n"]:
        raise ValueError("there is no input")
    if facts["other"]:
        raise ValueError("inputs must be of channels")
    if different := [p for p in parts if facts[p] > 1]:
        raise ValueError(f"inputs differ in {', '.join(different)}")


def total_rates(events: DataFrame, classes: Sequence[str], duration_s: float, kind: str = "event_type") -> DataFrame:
    """Rate of each class and of all, 0 for classes without events."""
    spark = events.sparkSession
    counts = events.groupBy(F.col(kind).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    named = spark.createDataFrame([(c,) for c in classes], "class string").join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))
    every = events.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("class"), "n")
    return named.unionByName(every).select("class", "n", (F.col("n") / duration_s).alias("rate"))
