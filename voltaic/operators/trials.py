"""Trials: events and labels joined by id or by place, events joined to anchors by time, and rules that take trials out.

Time joins work within a recording, whose events one task can hold: an as-of or interval join is a join on (recording, time bucket) where the
bucket is as wide as the window, so a recording's events do not all meet one another.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a block, at whose borders a recording may be cut.
CUT = 1 << 20


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def merged(label: Column, event: Column) -> Column:
    """The label's value unless blank, then the event's, else the blank there is."""
    return F.coalesce(blank_to_null(label), blank_to_null(event), label, event)


def join_on_trial_id(events: DataFrame, labels: DataFrame, trial_id: str = "trial_id", order: str = "row_index") -> DataFrame:
    """Labels with their events; of events with one id the last counts. Event columns get the prefix ``event_``."""
    last = events.withColumn("_r", F.row_number().over(Window.partitionBy(trial_id).orderBy(F.col(order).desc()))).where("_r = 1").drop("_r")
    renamed = last.select(F.col(trial_id), *(F.col(c).alias(f"event_{c}") for c in last.columns if c != trial_id))
    return labels.join(renamed, trial_id)


def join_by_position(left: DataFrame, right: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The k-th row of each side within ``by``; the longer side's rest is dropped. Right columns get the prefix ``other_``."""
    w = Window.partitionBy(by).orderBy(*order)
    a = left.withColumn("position", F.row_number().over(w))
    b = right.withColumn("position", F.row_number().over(w))
    return a.join(b.select(by, "position", *(F.col(c).alias(f"other_{c}") for c in right.columns if c != by)), [by, "position"])


def events_in_window(anchors: DataFrame, events: DataFrame, tmin: float, tmax: float, recording: str = "recording", onset: str = "onset") -> DataFrame:
    """(anchor columns, event columns with the prefix ``event_``) for events from anchor + tmin to anchor + tmax, both included.

    Events are bucketed by the width of the window; an anchor's window touches two buckets at most.
    """
    width = max(tmax - tmin, 1e-9)
    bucket = F.floor((F.col(onset) + tmin) / width)
    a = anchors.withColumn("_b", F.explode(F.array(bucket, bucket + 1)))
    b = events.where(F.col(onset).isNotNull()).select(F.col(recording), F.floor(F.col(onset) / width).alias("_b"), *(F.col(c).alias(f"event_{c}") for c in events.columns if c != recording))
    near = a.join(b, [recording, "_b"])
    return near.where(F.col(f"event_{onset}").between(F.col(onset) + tmin, F.col(onset) + tmax)).drop("_b")


def event_counts(anchors: DataFrame, events: DataFrame, key: str, tmin: float, tmax: float, recording: str = "recording", onset: str = "onset") -> DataFrame:
    """``n_events`` in each anchor's window; anchors without events count 0."""
    counts = events_in_window(anchors, events, tmin, tmax, recording, onset).groupBy(key).agg(F.count(F.lit(1)).alias("n_events"))
    return anchors.join(counts, key, "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)).cast("long"))


def invalidate_by_count(trials: DataFrame, least: int, reason: str) -> DataFrame:
    """Trials with so many events are out; an earlier reason stays."""
    hit = F.col("n_events") >= least
    return trials.withColumns({"keep": F.col("keep") & ~hit, "exclusion_reason": F.when(hit & F.col("exclusion_reason").isNull(), reason).otherwise(F.col("exclusion_reason"))})


def next_response(anchors: DataFrame, responses: DataFrame, key: str, recording: str = "recording", onset: str = "onset") -> DataFrame:
    """The first response strictly after an anchor and strictly before the next one, as ``response``.

    Both are put on one time line and the next response is looked up from behind, so it costs one sort per recording. Anchors of one time are in order of
    ``key``, so only the last of them has a response. Without a recording there is none.
    """
    line = anchors.select(recording, F.col(onset).alias("_t"), F.col(key), F.lit(1).alias("_anchor")).unionByName(responses.select(recording, F.col(onset).alias("_t"), F.lit(None).cast(anchors.schema[key].dataType).alias(key), F.lit(0).alias("_anchor")))
    # From late to early, what was seen last is next. At equal times anchors come first, so responses of an anchor's own time are not after it.
    after = Window.partitionBy(recording).orderBy(F.col("_t").desc(), F.col("_anchor").desc(), F.col(key).desc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.last(F.when(F.col("_anchor") == 0, F.col("_t")), ignorenulls=True).over(after)
    stop = F.last(F.when(F.col("_anchor") == 1, F.col("_t")), ignorenulls=True).over(after)
    line = line.withColumns({"_next": nxt, "_stop": stop}).where("_anchor = 1")
    response = F.when(F.col(recording).isNotNull() & (F.col("_next") > F.col("_t")) & (F.col("_stop").isNull() | (F.col("_next") < F.col("_stop"))), F.col("_next"))
    return line.select(recording, key, F.col("_t").alias(onset), response.alias("response"))


def nearest_rows(anchors: DataFrame, rows: DataFrame, key: str, row_key: str, tolerance: float = 1e-3, recording: str = "recording", onset: str = "onset", code: str = "code") -> DataFrame:
    """Anchors in order with the nearest unused row within the tolerance whose code is equal or unknown; each row is used once.

    Candidates come from a bucketed join. Choosing is in order of anchors; anchors more than twice the tolerance apart can't want one row, so recordings are cut
    where buckets between two blocks of buckets are free, and a task forgets what was chosen at each such gap. Keys are taken to be unique within a recording.
    """
    import pyarrow as pa

    bucket = F.floor(F.col("_ta") / (2 * tolerance))
    a = anchors.select(recording, F.col(key).alias("anchor"), F.col(onset).alias("_ta"), F.col(code).alias("_ca")).withColumn("_p", bucket).withColumn("_block", F.floor(F.col("_p") / CUT))
    # A block goes on in the next one unless two buckets or more are free between their anchors. Blocks are few beside anchors.
    blocks = a.groupBy(recording, "_block").agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    in_order = Window.partitionBy(recording).orderBy("_block")
    border = blocks.withColumn("_cut", F.coalesce(F.col("_first") - F.lag("_last").over(in_order) > 2, F.lit(False)).cast("long"))
    a = a.join(border.select(recording, "_block", F.sum("_cut").over(in_order).alias("_part")), [recording, "_block"])
    b = rows.select(recording, F.col(row_key).alias("row"), F.col(onset).alias("_tb"), F.col(code).alias("_cb"))
    near = a.withColumn("_b", F.explode(F.array(F.col("_p") - 1, F.col("_p"), F.col("_p") + 1))).join(b.withColumn("_b", F.floor(F.col("_tb") / (2 * tolerance))), [recording, "_b"])
    near = near.where((F.abs(F.col("_ta") - F.col("_tb")) <= tolerance) & (F.col("_cb").isNull() | (F.col("_cb") == F.col("_ca"))))
    near = near.select(recording, "anchor", "row", F.abs(F.col("_ta") - F.col("_tb")).alias("gap"), "_ta", "_part")
    near = near.repartition(recording, "_part").sortWithinPartitions(recording, "_part", "_ta", "anchor", "gap", "row")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, done, used = object(), 0.0, set(), set()
        for batch in batches:
            take = []
            for rec, anchor, row, ta, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)), strict=True):
                # Half a bucket more than needed, for rounding.
                if (rec, piece) != now or ta - last > 3 * tolerance:
                    now, done, used = (rec, piece), set(), set()
                last = ta
                good = anchor not in done and row not in used
                if good:
                    done.add(anchor)
                    used.add(row)
                take.append(good)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(take, pa.bool_()))

    types = {f.name: f.dataType.simpleString() for f in near.schema}
    return near.mapInArrow(choose, f"{recording} {types[recording]}, anchor {types['anchor']}, row {types['row']}, gap double")


def anchors_within(events: DataFrame, codes: list[str], start: str | None, end: str | None, recording: str = "recording", onset: str = "onset", code: str = "code") -> DataFrame:
    """Events of the codes, strictly after the first start event and strictly before the last end event of their recording."""
    w = Window.partitionBy(recording)
    rows = events.withColumns({"_s": F.min(F.when(F.col(code) == start, F.col(onset))).over(w), "_e": F.max(F.when(F.col(code) == end, F.col(onset))).over(w)})
    keep = F.col(code).isin(codes)
    if start is not None:
        keep = keep & (F.col(onset) > F.col("_s"))
    if end is not None:
        keep = keep & (F.col(onset) < F.col("_e"))
    return rows.where(keep).drop("_s", "_e")


def mark_duplicate_anchors(anchors: DataFrame, sample: str = "sample", recording: str = "recording", order: str = "event_idx") -> DataFrame:
    """Of kept anchors at one sample the first stays; the others get the reason ``duplicate_anchor_sample``."""
    first = F.row_number().over(Window.partitionBy(recording, sample, "keep").orderBy(order)) == 1
    again = F.col("keep") & ~first
    return anchors.withColumns({"exclusion_reason": F.when(again, "duplicate_anchor_sample").otherwise(F.col("exclusion_reason")), "keep": F.col("keep") & ~again})


def normalise_trials(df: DataFrame, labels: list[str], predictor: str | None = None, label: str = "label") -> DataFrame:
    """Kept trials with a label that the test does not know are out, and (with a predictor) those whose predictor is no finite number."""
    unknown = F.col("keep") & ~F.coalesce(F.col(label).isin(labels), F.lit(False))
    out = df.withColumns({"exclusion_reason": F.when(unknown, "unsupported_label").otherwise(F.col("exclusion_reason")), "keep": F.col("keep") & ~unknown})
    if predictor is None:
        return out
    x = F.col(predictor).cast("string").try_cast("double")
    bad = F.col("keep") & ~F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return out.withColumns({"exclusion_reason": F.when(bad, "invalid_predictor_value").otherwise(F.col("exclusion_reason")), "keep": F.col("keep") & ~bad})


def keep_only(df: DataFrame, condition: Column, reason: str) -> DataFrame:
    """Kept trials that do not meet a condition are out for this reason."""
    out = F.col("keep") & ~F.coalesce(condition, F.lit(False))
    return df.withColumns({"exclusion_reason": F.when(out, reason).otherwise(F.col("exclusion_reason")), "keep": F.col("keep") & ~out})


def in_order(df: DataFrame, by: str, order: str = "order", onset: str = "onset", row: str = "row_index") -> DataFrame:
    """``place`` of each row by order, onset and row, unknown ones last."""
    w = Window.partitionBy(by).orderBy(F.asc_nulls_last(order), F.asc_nulls_last(onset), row)
    return df.withColumn("place", F.row_number().over(w))


def match_in_order(anchors: DataFrame, rows: DataFrame, recording: str = "recording") -> DataFrame:
    """Anchors (recording, anchor, onset, code) with rows (recording, row, place, code, label) one after the other.

    A row whose code is not the anchor's is used up all the same. Anchors without a row, or whose row has no label, are not kept. The walk is
    sequential by definition, so a task takes one recording's anchors and rows at a time.
    """
    import pandas as pd

    def walk(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rest = iter(b.sort_values("place").itertuples())
        out = []
        for x in a.sort_values(["onset", "anchor"]).itertuples():
            found = next((r for r in rest if r.code is None or pd.isna(r.code) or r.code == x.code), None)
            label = None if found is None or pd.isna(found.label) else found.label
            reason = "no_matching_table_row" if found is None else "missing_label" if label is None else None
            out.append((key[0], x.anchor, None if found is None else found.row, label, reason is None, reason))
        return pd.DataFrame(out, columns=[recording, "anchor", "row", "label", "keep", "exclusion_reason"])

    t = {f.name: f.dataType.simpleString() for f in [*anchors.schema, *rows.schema]}
    schema = f"{recording} {t[recording]}, anchor {t['anchor']}, row {t['row']}, label string, keep boolean, exclusion_reason string"
    return anchors.groupBy(recording).cogroup(rows.groupBy(recording)).applyInPandas(walk, schema)


def pair_durations(anchors: DataFrame, durations: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The k-th anchor of a key takes the k-th duration of it; anchors beyond have none."""
    w = Window.partitionBy(*keys).orderBy(order)
    a = anchors.withColumn("_k", F.row_number().over(w))
    b = durations.withColumn("_k", F.row_number().over(w)).select(*keys, "_k", "duration")
    return a.join(b, [*keys, "_k"], "left").drop("_k")


def response_time(df: DataFrame, column: str, units: str = "s") -> Column:
    """Seconds of a text column in seconds or milliseconds."""
    x = F.col(column).cast("string").try_cast("double")
    return x * 0.001 if units == "ms" else x


def skip_reason(rt: Column, tmax: float, clamp: bool) -> Column:
    """Why a trial has no activity up to its response."""
    return F.when(rt.isNull(), "missing_response_time").when(rt <= 0, "nonpositive_response_time").when((rt > tmax) & F.lit(not clamp), "response_after_epoch_end")


def defer(df: DataFrame, condition: Column, reason: str, phase: str) -> DataFrame:
    """Kept trials that do not meet a condition are marked to go at a later phase."""
    late = F.col("keep") & ~F.coalesce(condition, F.lit(False))
    mark = F.struct(F.lit(reason).alias("reason"), F.lit(phase).alias("phase"))
    old = F.col("deferred") if "deferred" in df.columns else F.array().cast("array<struct<reason:string,phase:string>>")
    return df.withColumn("deferred", F.when(late, F.concat(old, F.array(mark))).otherwise(old))


def apply_deferred(df: DataFrame, phase: str) -> DataFrame:
    """Trials marked for this phase are out, for the first reason marked."""
    mine = F.filter("deferred", lambda d: d["phase"] == phase)
    goes = F.col("keep") & (F.size(mine) > 0)
    return df.withColumns({"exclusion_reason": F.when(goes, F.get(mine, F.lit(0))["reason"]).otherwise(F.col("exclusion_reason")), "keep": F.col("keep") & ~goes})


def build_rows(events: DataFrame | None, labels: DataFrame | None, condition_columns: set[str], anchor_column: str = "anchor_event_code", trial_id: str = "trial_id", by: str = "recording") -> tuple[DataFrame, str]:
    """Trial rows and where they come from: events alone if they have the anchors and all columns of the conditions, else labels with events by
    trial id, or by place if a side has no ids, else labels alone."""
    if events is not None and anchor_column in events.columns and condition_columns <= set(events.columns):
        return events.where(blank_to_null(F.col(anchor_column)).isNotNull()), "events"
    if labels is None:
        raise ValueError("no table has the columns of the conditions")
    if events is None:
        return labels, "labels"
    if trial_id in events.columns and trial_id in labels.columns:
        return join_on_trial_id(events, labels, trial_id), "trial_id"
    order = [F.asc_nulls_last(c) for c in ("order", "onset", "row_index") if c in events.columns and c in labels.columns]
    return join_by_position(labels, events, by, order), "position"
