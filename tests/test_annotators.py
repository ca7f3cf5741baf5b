"""Chains of annotators: their order, their windows and what they refuse."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from voltaic.operators import annotators as an

IS_BAD = {"column": "kind", "op": "==", "value": "bad"}


@pytest.fixture(scope="module")
def state(spark):
    trials = spark.createDataFrame([("r", 1, 10.0, True, None, "x"), ("r", 2, 20.0, True, None, None), ("r", 3, 30.0, False, "before", "x"), ("q", 1, 10.0, True, None, "y")], "recording string, trial int, onset double, keep boolean, exclusion_reason string, group string")
    channels = spark.createDataFrame([("r", "A1"), ("r", "b2"), ("q", "A1")], "recording string, channel string")
    return an.State(trials, -1.0, 2.0, channels)


@pytest.fixture(scope="module")
def events(spark):
    rows = [("r", "9", "bad", " a1 "), ("r", "12.0", "good", "B2"), ("r", "12.5", "bad", "A1"), ("r", "19.0", "bad", "zz"), ("r", "22", "good", None), ("r", "29.5", "bad", "A1"), ("r", "n/a", "bad", "A1"), ("r", None, "bad", "A1"), ("q", "40", "bad", "A1")]
    return spark.createDataFrame(rows, "recording string, start string, kind string, channel string")


def kept(s):
    return {(r.recording, r.trial): (r.keep, r.exclusion_reason) for r in s.trials.collect()}


def test_windows_have_both_ends(state, events):
    s = an.WindowEvents("e", events, "start")(state)
    assert sorted((r.recording, r.trial, r.start, r.kind) for r in s.events["e"].collect()) == [("r", 1, "12.0", "good"), ("r", 1, "9", "bad"), ("r", 2, "19.0", "bad"), ("r", 2, "22", "good"), ("r", 3, "29.5", "bad")]
    wide = an.WindowEvents("e", events, "start", tmax=2.5)(state)
    assert wide.events["e"].where("trial = 1").count() == 3


def test_counts_and_reasons(state, events):
    s = an.annotate(state, [an.WindowEvents("e", events, "start"), an.CountRule("e", IS_BAD, 1, "bad_event")])
    assert kept(s) == {("r", 1): (False, "bad_event"), ("r", 2): (False, "bad_event"), ("r", 3): (False, "before"), ("q", 1): (True, None)}
    assert kept(an.CountRule("e", None, 2)(s)) == kept(s)
    assert kept(an.annotate(state, [an.WindowEvents("e", events, "start"), an.CountRule("e", None, 2)]))["r", 1] == (False, "event_in_window")


def test_order_matters(state, events):
    only_x = an.MetadataRule({"column": "group", "op": "==", "value": "x"}, "not_x")
    window, count = an.WindowEvents("e", events, "start"), an.CountRule("e", IS_BAD)
    first = kept(an.annotate(state, [window, only_x, count]))
    last = kept(an.annotate(state, [window, count, only_x]))
    assert first["r", 2] == (False, "not_x") and last["r", 2] == (False, "event_in_window")
    assert first["q", 1] == last["q", 1] == (False, "not_x") and first["r", 3] == last["r", 3] == (False, "before")


def test_masks_of_named_channels(state, events, spark):
    s = an.annotate(state, [an.WindowEvents("e", events, "start"), an.FeatureMask("e", IS_BAD, reason="bad"), an.FeatureMask("e", reason="any")])
    assert {(r.recording, r.trial, r.feature): r.reasons for r in an.mask_audit(s).collect()} == {("r", 1, "A1"): ["any", "bad"], ("r", 1, "b2"): ["any"]}
    epochs = spark.createDataFrame([(r, t, f, 1.0) for r in "rq" for t in (1, 3) for f in ("a1", "B2")], "recording string, trial int, feature string, v double")
    assert {(r.recording, r.trial, r.feature) for r in an.mask_epochs(epochs, s).where("v is null").collect()} == {("r", 1, "a1"), ("r", 1, "B2")}
    assert an.mask_epochs(epochs, state).where("v is null").count() == 0
    gone = an.FeatureMask("e", channel="no_such_column")(an.WindowEvents("e", events, "start")(state))
    assert gone.masks.count() == 0


def test_deferred_and_own_steps(state):
    rule = {"column": "group", "op": "==", "value": "x"}

    def halve(s):
        return replace(s, trials=s.trials.withColumn("onset", F.col("onset") / 2))

    s = an.annotate(state, [an.DeferredRule(rule, "not_x", "late"), halve])
    assert sorted(tuple(r) for r in s.deferred.collect()) == [("q", 1, "not_x", "late"), ("r", 2, "not_x", "late")] and kept(s)["q", 1] == (True, None)
    assert s.trials.where("trial = 2").first().onset == 10.0


def test_what_is_refused(state, events):
    with pytest.raises(ValueError, match="no step before"):
        an.CountRule("e")(state)
    with pytest.raises(ValueError, match="recordings' channels"):
        an.FeatureMask("e")(replace(state, channels=None))
    for bad in (lambda: an.CountRule("e", least=0), lambda: an.WindowEvents(" ", events), lambda: an.CountRule("e", reason=""), lambda: an.FeatureMask("e", channel="")):
        with pytest.raises(ValueError):
            bad()
