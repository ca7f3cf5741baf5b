"""Result tables by kind, in long form, and the audits of trials that go with them.

A kind has columns that a table must have and columns that older or smaller tables leave out, with what then stands for them. A table
is conformed before it is written and after it is read: missing columns that are needed are named all at once, optional ones get their default, types are
cast so that a value that doesn't fit fails the query, further columns stay behind the known ones. Missing cells of a column that is there stay missing:
only a column that is not there has a default.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stable_json
from .sinks import write_result, write_text
from .tables import read_result

_CELL = {"feature": "string", "time_s": "double"}
_TF_CELL = {"feature": "string", "frequency_hz": "double", "time_s": "double"}
_TEST = {"t": ("double", 0.0), "p": ("double", 1.0), "p_uncorrected": ("double", 1.0)}
_COMMON = {"analysis_level": ("string", "channel"), "atlas_name": ("string", None), "significance_alpha": ("double", 0.05), "correction": ("string", "fdr_bh"), "n_permutations": ("bigint", 0)}
_MEANS = {"mean_a": ("double", 0.0), "mean_b": ("double", 0.0), "sem_a": ("double", 0.0), "sem_b": ("double", 0.0), "n_a": ("bigint", 0), "n_b": ("bigint", 0)}
_LINE = {"slope": ("double", None), "intercept": ("double", None), "r": ("double", None), "p": ("double", 1.0), "p_corrected": ("double", 1.0), "significant": ("boolean", False)}


@dataclass(frozen=True)
class Kind:
    """``needed``: columns and types; ``optional``: columns with type and default."""

    needed: dict[str, str]
    optional: dict[str, tuple[str, object]] = field(default_factory=dict)
    version: str = "1.0"


KINDS = {
    "hilbert": Kind({"recording": "string", "channel": "string", "window_ms": "bigint", "sample": "bigint", "v": "double"}, {"sfreq": ("double", 0.0), "original_fs": ("double", 0.0)}),
    "time_frequency": Kind({"recording": "string", "trial_id": "string", "channel": "string", "frequency_hz": "double", "time_s": "double", "power_db": "double"}, {"baseline_db": ("double", None), "original_fs": ("double", 0.0)}),
    "condition_test": Kind({**_CELL, "activity_zscore": "string"}, {**_TEST, **_MEANS, **_COMMON}),
    "regression": Kind({**_CELL, "condition": "string", "activity_zscore": "string"}, {**_LINE, "mean": ("double", None), "sem": ("double", None), **_COMMON}),
    "time_frequency_condition_test": Kind(_TF_CELL, {**_TEST, **_MEANS, **_COMMON}),
    "time_frequency_regression": Kind({**_TF_CELL, "condition": "string"}, {**_LINE, **_COMMON}),
    "condition_test_group": Kind(_CELL, {**_TEST, "n_contributions": ("bigint", 0), **_COMMON, "analysis_level": ("string", "roi")}),
    "regression_group": Kind({**_CELL, "condition": "string"}, {**_TEST, "n_contributions": ("bigint", 0), **_COMMON, "analysis_level": ("string", "roi")}),
    "time_frequency_condition_test_group": Kind(_TF_CELL, {**_TEST, "n_contributions": ("bigint", 0), **_COMMON, "analysis_level": ("string", "roi")}),
    "time_frequency_regression_group": Kind({**_TF_CELL, "condition": "string"}, {**_TEST, "n_contributions": ("bigint", 0), **_COMMON, "analysis_level": ("string", "roi")}),
    "hfo_spike_detection": Kind(
        {"recording": "string", "channel": "string", "onset": "double", "duration": "double", "event_type": "string", "peak_frequency": "double"},
        {"sample_index": ("bigint", None), "frequency_index": ("bigint", None), "detection_strength": ("double", None), "color": ("string", None), "original_fs": ("double", 0.0)},
    ),
}

#: Columns of the audits, in order.
AUDIT_FRONT = ("source_file", "anchor_event_index", "anchor_event_code", "anchor_onset_s", "trial_id", "resolved_label")
AUDIT_SHARED = ("trial_activity_summary_response_time_s", "nan_masked_features", "baseline_outlier_masked_features", "activity_summary_skip_reason")
AUDIT_PREDICTOR = ("predictor_raw", "predictor_raw_value", "predictor_transformed_value", "predictor_value", "predictor_transform_scale", "predictor_transform_offset")
AUDIT_BACK = ("condition_inputs", "condition_resolution_reason", "keep", "exclusion_reason")
AUDIT_TIME_FREQUENCY = (*AUDIT_FRONT, "keep", "exclusion_reason", "condition_inputs")
#: Columns of an audit whose missing values are ``nan``, and those that are lists of features.
_NUMBERS = {"trial_activity_summary_response_time_s", *AUDIT_PREDICTOR[1:]}
_LISTS = {"nan_masked_features", "baseline_outlier_masked_features"}


def _kind(name: str) -> Kind:
    if name not in KINDS:
        raise ValueError(f"unknown kind of result: {name}")
    return KINDS[name]


def conform(df: DataFrame, kind: str) -> DataFrame:
    """``df`` with the columns of the kind, in their order, and then its own further ones."""
    k = _kind(kind)
    missing = [c for c in k.needed if c not in df.columns]
    if missing:
        raise ValueError(f"a {kind} result needs the columns {', '.join(missing)}")
    known = {**{c: (t, None) for c, t in k.needed.items()}, **k.optional}
    cells = [(F.col(f"`{c}`") if c in df.columns else F.lit(default)).cast(t).alias(c) for c, (t, default) in known.items()]
    return df.select(*cells, *(F.col(f"`{c}`") for c in df.columns if c not in known))


def load_result(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A written table of this kind; rows of another kind or version fail the query."""
    return conform(read_result(spark, path, kind, _kind(kind).version), kind)


def save_result(df: DataFrame, path: str, kind: str, by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    write_result(conform(df, kind), path, kind, by, _kind(kind).version, mode)


def choose_window(envelopes: DataFrame, window_ms: int, recording: str = "recording") -> DataFrame:
    """The samples of one smoothing window, without its column. A recording that lacks it fails the query with the windows that it has; so does one without
    a positive sampling rate."""
    have = envelopes.groupBy(recording).agg(F.array_sort(F.collect_set("window_ms")).alias("_have"), F.min("sfreq").alias("_low"), F.max("sfreq").alias("_fs"))
    name = F.coalesce(F.col(recording).cast("string"), F.lit("unnamed"))
    lacking = F.concat(name, F.lit(f": smoothing window {window_ms} ms is not available. Available windows: "), F.when(F.size("_have") > 0, F.array_join("_have", ", ")).otherwise("none"))
    rate = F.concat(name, F.lit(": the sampling rate must be a positive number"))
    good = (F.col("_low") > 0) & ~F.isnan("_fs") & (F.col("_fs") < float("inf"))
    state = F.when(~F.array_contains("_have", F.lit(window_ms).cast("bigint")), F.raise_error(lacking)).when(good, F.lit(True)).otherwise(F.raise_error(rate)).cast("boolean")
    right = have.where(state).select(F.col(recording).alias("_r"))
    return envelopes.where(F.col("window_ms") == window_ms).join(right, F.col(recording).eqNullSafe(F.col("_r")), "left_semi").drop("window_ms")


def signals_or_envelopes(signals: DataFrame | None, envelopes: DataFrame | None, window_ms: int) -> DataFrame:
    """recording, channel, sample, v, sfreq and ``source``: a recording's envelope where it has one, else its raw signal."""
    columns = ["recording", "channel", "sample", "v", "sfreq"]
    if envelopes is None:
        if signals is None:
            raise ValueError("there are neither signals nor envelopes")
        return signals.select(*columns, F.lit("brainvision").alias("source"))
    chosen = choose_window(envelopes, window_ms).select(*columns, F.lit("hilbert").alias("source"))
    if signals is None:
        return chosen
    raw = signals.join(envelopes.select("recording").distinct(), "recording", "left_anti")
    return chosen.unionByName(raw.select(*columns, F.lit("brainvision").alias("source")))


def feature_time(values: Column, n_features: int, n_times: int, nested: bool) -> Column:
    """Arrays as n_features rows of n_times values. Rows and columns that were exchanged are exchanged back, a flat array is cut into rows; what is too much goes, what is
    missing is null."""

    def grid(cell):
        return F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(n_times - 1)), lambda j: cell(i, j)))

    if n_features < 1 or n_times < 1:
        raise ValueError("there must be a feature and a time")
    if not nested:
        return F.when(values.isNotNull(), grid(lambda i, j: F.get(values, i * n_times + j)))
    exchanged = (F.size(values) == n_times) & (F.size(F.get(values, 0)) == n_features) & F.lit(n_features != n_times)
    return F.when(exchanged, grid(lambda i, j: F.get(F.get(values, j), i))).when(values.isNotNull(), grid(lambda i, j: F.get(F.get(values, i), j)))


def uneven_cells(df: DataFrame, keys: Sequence[str], cell: Sequence[str], conditions: Sequence[str] = ("a", "b"), condition: str = "condition") -> DataFrame:
    """keys, cell and what is wrong with it: ``missing`` from a condition or ``repeated`` in one. No row: all conditions share their cells."""
    counts = [F.count_if(F.col(condition) == c).alias(f"_{i}") for i, c in enumerate(conditions)]
    least, most = F.least(*(f"_{i}" for i in range(len(counts)))), F.greatest(*(f"_{i}" for i in range(len(counts))))
    if len(counts) < 2:
        raise ValueError("cells are compared between two conditions or more")
    rows = df.groupBy(*keys, *cell).agg(*counts).withColumn("problem", F.when(least == 0, "missing").when(most > 1, "repeated"))
    return rows.where("problem is not null").select(*keys, *cell, "problem")


def audit(trials: DataFrame, kind: str = "condition_test", more: Sequence[str] = ()) -> DataFrame:
    """A row of texts per trial, with the columns of the kind's audit (and ``more`` before the last four; at the end for time-frequency kinds).

    Columns that ``trials`` lacks and missing values are empty, numbers ``nan``, lists ``[]`` (their features in order), inputs ``{}`` (by key), ``keep`` false.
    """
    _kind(kind)
    if kind.startswith("time_frequency"):
        columns = (*AUDIT_TIME_FREQUENCY, *more)
    else:
        columns = (*AUDIT_FRONT, *AUDIT_SHARED, *(AUDIT_PREDICTOR if kind.startswith("regression") else ()), *more, *AUDIT_BACK)

    def cell(c: str) -> Column:
        have = c in trials.columns
        value = F.col(f"`{c}`")
        if c == "keep":
            return F.coalesce(value.cast("boolean").cast("string"), F.lit("false")) if have else F.lit("false")
        if c == "condition_inputs":
            return F.coalesce(stable_json(value), F.lit("{}")) if have else F.lit("{}")
        if c in _LISTS:
            quoted = F.transform(F.array_sort(value), lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")) if have else None
            return F.coalesce(F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")), F.lit("[]")) if have else F.lit("[]")
        empty = "nan" if c in _NUMBERS else ""
        text = F.when(F.isnan(value.cast("double")), "nan").otherwise(value.cast("double").cast("string")) if have and c in _NUMBERS else value.cast("string")
        return F.coalesce(text, F.lit(empty)) if have else F.lit(empty)

    return trials.select(*(cell(c).alias(c) for c in columns))


def write_audit(trials: DataFrame, path: str, kind: str = "condition_test", more: Sequence[str] = (), mode: str = "errorifexists") -> None:
    write_text(audit(trials, kind, more), path, mode=mode)


def audit_path(path: Column) -> Column:
    """Where the audit of a result goes: ``.tsv`` for its extension, and ``_trials`` for ``_stats`` at its end."""
    stem = F.regexp_replace(path, r"(?<=[^/.])\.[^./]+$", "")
    return F.concat(F.regexp_replace(stem, "_stats$", "_trials"), F.lit(".tsv"))
