"""Annotators of trials: an ordered chain of steps over trials and the events in their windows.

A step takes a state and gives the next one, so one's own steps are functions beside the five here. Events in windows, masks and deferred exclusions are tables of their own, keyed by recording and
trial; nothing is gathered into a trial's row. Rules are those of ``predicates``; events are judged by their own columns, trials by theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .predicates import matches
from .trials import events_in_window

KEYS = ("recording", "trial")
PREFIX = "event_"


@dataclass(frozen=True)
class State:
    """``trials``: recording, trial, onset, keep, exclusion_reason and what is known of them. ``tmin``, ``tmax``: the epoch's window. ``channels``: recording and channel, the names that masks may have."""

    trials: DataFrame
    tmin: float
    tmax: float
    channels: DataFrame | None = None
    events: dict[str, DataFrame] = field(default_factory=dict)
    masks: DataFrame | None = None
    deferred: DataFrame | None = None

    def events_of(self, key: str, rule: dict | None) -> DataFrame:
        """recording, trial and the columns of the events that match."""
        if key not in self.events:
            raise ValueError(f"no step before has annotated events as {key}")
        e = self.events[key]
        return e if rule is None else e.where(matches(rule, [c for c in e.columns if c not in KEYS]))

    def excluded(self, failing: DataFrame, reason: str, overwrite: bool) -> State:
        """With the trials of ``failing`` (recording, trial) left out. An earlier reason stays, unless only kept trials are judged."""
        hit = failing.select(*KEYS).distinct().withColumn("_hit", F.lit(True))
        out = self.trials.join(hit, list(KEYS), "left")
        new = F.col("_hit").isNotNull() & (F.col("keep") if overwrite else F.lit(True))
        why = F.when(new & (F.lit(overwrite) | F.col("exclusion_reason").isNull()), reason).otherwise(F.col("exclusion_reason"))
        return replace(self, trials=out.withColumns({"exclusion_reason": why, "keep": F.col("keep") & ~new}).drop("_hit").select(*self.trials.columns))


Step = Callable[[State], State]


def _named(value: str, what: str) -> str:
    if not value or not value.strip():
        raise ValueError(f"{what} must not be empty")
    return value.strip()


def _more(have: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if have is None else have.unionByName(new)


@dataclass(frozen=True)
class WindowEvents:
    """Annotates trials with the rows of ``table`` (recording, and an onset in seconds) in their windows, ends included, by ``key``. Rows without an onset are in none."""

    key: str
    table: DataFrame
    onset: str = "onset"
    tmin: float | None = None
    tmax: float | None = None

    def __post_init__(self) -> None:
        _named(self.key, "a key of events")
        _named(self.onset, "a column of onsets")

    def __call__(self, state: State) -> State:
        table = self.table.withColumn("onset", F.expr(f"try_cast(`{self.onset}` AS double)")).where("not isnan(onset)")
        tmin, tmax = (state.tmin if self.tmin is None else self.tmin), (state.tmax if self.tmax is None else self.tmax)
        near = events_in_window(state.trials.select(*KEYS, F.col("onset").cast("double").alias("onset")), table, tmin, tmax)
        near = near.select(*KEYS, *(F.col(f"{PREFIX}{c}").alias(c) for c in table.columns if c not in KEYS))
        return replace(state, events={**state.events, self.key: near})


@dataclass(frozen=True)
class CountRule:
    """Leaves out trials with ``least`` matching events or more."""

    key: str
    rule: dict | None = None
    least: int = 1
    reason: str = "event_in_window"

    def __post_init__(self) -> None:
        if self.least < 1:
            raise ValueError("at least one event is counted")
        _named(self.reason, "a reason")

    def __call__(self, state: State) -> State:
        many = state.events_of(self.key, self.rule).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= self.least)
        return state.excluded(many, self.reason, overwrite=False)


@dataclass(frozen=True)
class FeatureMask:
    """Has the channels that matching events name (whatever their case) masked in the trial, which is kept. Names that the recording lacks are skipped."""

    key: str
    rule: dict | None = None
    channel: str = "channel"
    reason: str = "annotated_feature_mask"

    def __post_init__(self) -> None:
        _named(self.channel, "a column of channels")
        _named(self.reason, "a reason")

    def __call__(self, state: State) -> State:
        if state.channels is None:
            raise ValueError("masks need the recordings' channels")
        found = state.events_of(self.key, self.rule)
        if self.channel not in found.columns:
            found = found.withColumn(self.channel, F.lit(None).cast("string"))
        names = state.channels.select("recording", F.col("channel").alias("feature"), F.lower("channel").alias("_name")).distinct()
        hits = found.select(*KEYS, F.lower(F.trim(F.col(self.channel).cast("string"))).alias("_name")).distinct().join(names, ["recording", "_name"])
        return replace(state, masks=_more(state.masks, hits.select(*KEYS, "feature", F.lit(self.reason).alias("reason"))))


@dataclass(frozen=True)
class MetadataRule:
    """Leaves out kept trials that don't match."""

    rule: dict
    reason: str = "metadata_rule"

    def __call__(self, state: State) -> State:
        return state.excluded(state.trials.where("keep").where(~matches(self.rule, state.trials.columns)), _named(self.reason, "a reason"), overwrite=True)


@dataclass(frozen=True)
class DeferredRule:
    """Notes kept trials that don't match, to be left out in a later ``phase``."""

    rule: dict
    reason: str
    phase: str

    def __call__(self, state: State) -> State:
        failing = state.trials.where("keep").where(~matches(self.rule, state.trials.columns))
        return replace(state, deferred=_more(state.deferred, failing.select(*KEYS, F.lit(_named(self.reason, "a reason")).alias("reason"), F.lit(self.phase).alias("phase"))))


def annotate(state: State, steps: Sequence[Step]) -> State:
    """The steps in order."""
    return reduce(lambda s, step: step(s), steps, state)


def mask_epochs(epochs: DataFrame, state: State, value: str = "v") -> DataFrame:
    """Values of masked (recording, trial, feature) become missing, in kept trials."""
    if state.masks is None:
        return epochs
    hit = state.masks.join(state.trials.where("keep").select(*KEYS), list(KEYS), "left_semi").select(*KEYS, F.lower("feature").alias("_name")).distinct().withColumn("_x", F.lit(True))
    rows = epochs.withColumn("_name", F.lower("feature")).join(hit, [*KEYS, "_name"], "left")
    return rows.withColumn(value, F.when(F.col("_x").isNull(), F.col(value))).select(*epochs.columns)


def mask_audit(state: State) -> DataFrame:
    """recording, trial, feature and the reasons in order of name, of kept trials."""
    if state.masks is None:
        raise ValueError("no step has masked anything")
    kept = state.masks.join(state.trials.where("keep").select(*KEYS), list(KEYS), "left_semi")
    return kept.groupBy(*KEYS, "feature").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
