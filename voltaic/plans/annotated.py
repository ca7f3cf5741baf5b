"""Queries of annotator chains, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotators as an
from .tables import ANNOTATIONS, annotations

QUERIES, SQL = {}, {}

_TRIALS = f"""WITH {ANNOTATIONS}, tr AS (SELECT recording, event_id AS trial, onset, k FROM a WHERE code = 'click'),
 ev AS (SELECT recording, onset, code, value, 'Ch' || event_id % 6 AS channel FROM a WHERE code <> 'click'),
 w AS (SELECT tr.trial, ev.* FROM tr JOIN ev ON tr.recording = ev.recording AND ev.onset BETWEEN tr.onset - 36000 AND tr.onset + 72000),
 n AS (SELECT tr.*, (SELECT count(*) FROM w WHERE w.trial = tr.trial AND code = 'error' AND value > 5) AS bad FROM tr),
 f AS (SELECT *, bad < 1 AND k >= 20 AS keep, CASE WHEN bad >= 1 THEN 'event_in_window' WHEN k IS NULL OR k < 20 THEN 'low_k' END AS reason FROM n)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"{_TRIALS} {sql}"
        return f

    return add


def _state(spark: SparkSession, d: str) -> an.State:
    """Clicks as trials; other events in the window from ten hours before to twenty after."""
    a = annotations(spark, d)
    trials = a.where("code = 'click'").select("recording", F.col("event_id").alias("trial"), "onset", "k", F.lit(True).alias("keep"), F.lit(None).cast("string").alias("exclusion_reason"))
    events = a.where("code <> 'click'").select("recording", "onset", "code", "value", F.concat(F.lit("Ch"), (F.col("event_id") % 6).cast("string")).alias("channel"))
    channels = trials.select("recording").distinct().withColumn("channel", F.explode(F.array(*(F.lit(f"CH{i}") for i in range(4)))))
    bad = {"all": [{"column": "code", "op": "==", "value": "error"}, {"column": "value", "op": ">", "value": 5, "cast": "float"}]}
    steps = [
        an.WindowEvents("near", events), an.CountRule("near", bad), an.FeatureMask("near", {"column": "code", "op": "==", "value": "view"}, reason="view"),
        an.FeatureMask("near", {"column": "value", "op": "<", "value": 2, "cast": "float"}, reason="low_value"), an.MetadataRule({"column": "k", "op": ">=", "value": 20, "cast": "int"}, "low_k"),
        an.DeferredRule({"column": "k", "op": "<", "value": 80, "cast": "int"}, "high_k", "after_baseline"),
    ]
    return an.annotate(an.State(trials, -36000.0, 72000.0, channels), steps)


@query("SELECT recording, trial, coalesce(keep, FALSE) AS keep, reason AS exclusion_reason FROM f")
def annotator_chain(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).trials.select("recording", "trial", "keep", "exclusion_reason")


@query("""SELECT f.recording, f.trial, 'CH' || right(channel, 1) AS feature, array_to_string(list_sort(list_distinct(list(r))), ',') AS reasons
 FROM f JOIN (SELECT trial, channel, 'view' AS r FROM w WHERE code = 'view' UNION ALL SELECT trial, channel, 'low_value' FROM w WHERE value < 2) x ON f.trial = x.trial
 WHERE f.keep AND right(channel, 1)::INT < 4 GROUP BY ALL""")
def feature_mask_events(spark: SparkSession, d: str) -> DataFrame:
    """Channels that events in the window name."""
    return an.mask_audit(_state(spark, d)).select("recording", "trial", "feature", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT recording, trial, 'high_k' AS reason, 'after_baseline' AS phase FROM f WHERE keep AND k >= 80")
def deferred_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).deferred


@query("""SELECT recording, trial, feature, CASE WHEN keep AND EXISTS (SELECT 1 FROM w WHERE w.trial = f.trial AND (code = 'view' OR value < 2) AND right(channel, 1) = right(feature, 1) AND right(feature, 1)::INT < 4)
 THEN NULL ELSE k + right(feature, 1)::DOUBLE END AS v FROM f, (SELECT 'ch' || i AS feature FROM range(6) AS r(i))""")
def masked_epochs(spark: SparkSession, d: str) -> DataFrame:
    """A value of each trial and of six channels, four of which the recordings have."""
    s = _state(spark, d)
    epochs = s.trials.select("recording", "trial", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"), "k").select("recording", "trial", F.concat(F.lit("ch"), F.col("i").cast("string")).alias("feature"), (F.col("k") + F.col("i")).cast("double").alias("v"))
    return an.mask_epochs(epochs, s)
