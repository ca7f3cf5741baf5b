"""Kinds of results, windows of envelopes, grids and audits; their queries are compared with SQL in test_queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaic.operators import records
from voltaic.sources import results as rs
from voltaic.sources import tables


def test_missing_columns_have_defaults_and_missing_cells_stay(spark):
    df = spark.createDataFrame([("f", 0.5, "none", None, 7)], "feature string, time_s float, activity_zscore string, p double, extra int")
    out = rs.conform(df, "condition_test")
    row = out.first()
    assert (row.t, row.p, row.p_uncorrected, row.significance_alpha, row.correction, row.extra) == (0.0, None, 1.0, 0.05, "fdr_bh", 7)
    assert dict(out.dtypes)["time_s"] == "double" and out.columns[:3] == ["feature", "time_s", "activity_zscore"] and out.columns[-1] == "extra"


def test_needed_columns_are_named(spark):
    with pytest.raises(ValueError, match="time_s, activity_zscore"):
        rs.conform(spark.createDataFrame([("f",)], "feature string"), "condition_test")
    with pytest.raises(ValueError, match="unknown kind"):
        rs.conform(spark.range(1), "x")


@pytest.mark.parametrize("kind", sorted(rs.KINDS))
def test_every_kind_is_written_and_read(spark, tmp_path, kind):
    k = rs.KINDS[kind]
    empty = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in k.needed.items()))
    one = empty.unionByName(spark.range(1).select(*(F.lit("1").cast(t).alias(c) for c, t in k.needed.items())))
    path = str(tmp_path / kind)
    rs.save_result(one, path, kind)
    got = rs.load_result(spark, path, kind)
    assert got.columns == [*k.needed, *k.optional]
    assert got.collect() == rs.conform(one, kind).collect()
    other = next(x for x in rs.KINDS if x != kind)
    with pytest.raises(Exception, match=f"expected {other}|needs the columns"):
        rs.load_result(spark, path, other).collect()


def _envelopes(spark, rows):
    return spark.createDataFrame(rows, "recording string, channel string, window_ms int, sample long, v double, sfreq double")


def test_window_is_chosen_or_the_others_are_listed(spark):
    rows = [("a", "c", 0, 0, 1.0, 64.0), ("a", "c", 250, 0, 2.0, 64.0), ("b", "c", 250, 0, 3.0, 64.0)]
    assert sorted(r.v for r in rs.choose_window(_envelopes(spark, rows), 250).collect()) == [2.0, 3.0]
    with pytest.raises(Exception, match="b: smoothing window 0 ms is not available. Available windows: 250"):
        rs.choose_window(_envelopes(spark, rows), 0).collect()
    for fs in (0.0, -1.0, float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="must be a positive number"):
            rs.choose_window(_envelopes(spark, [("a", "c", 0, 0, 1.0, fs)]), 0).collect()
    assert rs.choose_window(_envelopes(spark, []), 0).count() == 0


def test_envelopes_come_before_signals(spark):
    signals = spark.createDataFrame([("a", "c", 0, 9.0, 512.0), ("b", "c", 0, 8.0, 512.0)], "recording string, channel string, sample long, v double, sfreq double")
    got = rs.signals_or_envelopes(signals, _envelopes(spark, [("a", "c", 0, 0, 1.0, 64.0)]), 0).collect()
    assert sorted((r.recording, r.v, r.sfreq, r.source) for r in got) == [("a", 1.0, 64.0, "hilbert"), ("b", 8.0, 512.0, "brainvision")]
    assert rs.signals_or_envelopes(signals, None, 0).count() == 2
    with pytest.raises(ValueError, match="neither"):
        rs.signals_or_envelopes(None, None, 0)


@pytest.mark.parametrize("shape", [(2, 3), (3, 2), (1, 3), (4, 5), (2, 2)])
def test_grids(spark, shape):
    x = np.arange(shape[0] * shape[1], dtype=float).reshape(shape)
    want = np.full((2, 3), np.nan)
    part = x.T if shape == (3, 2) else x
    want[: part.shape[0], : part.shape[1]] = part[:2, :3]
    df = spark.createDataFrame([(x.tolist(), x.reshape(-1).tolist())], "a array<array<double>>, b array<double>")
    row = df.select(rs.feature_time(F.col("a"), 2, 3, nested=True).alias("a"), rs.feature_time(F.col("b"), 2, 3, nested=False).alias("b")).first()
    assert np.array_equal(np.array(row.a, dtype=float), want, equal_nan=True)
    flat = np.full(6, np.nan)
    flat[: min(6, x.size)] = x.reshape(-1)[:6]
    assert np.array_equal(np.array(row.b, dtype=float), flat.reshape(2, 3), equal_nan=True)


def test_cells_that_conditions_do_not_share(spark):
    df = spark.createDataFrame([("s", 0, "a"), ("s", 0, "b"), ("s", 1, "a"), ("s", 2, "a"), ("s", 2, "b"), ("s", 2, "b"), ("t", 1, "b"), ("t", 1, "a"), ("t", 5, "c")], "sub string, t int, condition string")
    got = {(r.sub, r.t, r.problem) for r in rs.uneven_cells(df, ["sub"], ["t"]).collect()}
    assert got == {("s", 1, "missing"), ("s", 2, "repeated"), ("t", 5, "missing")}


def test_audits(spark, tmp_path):
    trials = spark.createDataFrame([("f", 1, True, {"b": "1", "a": 'say "x"'}, ["z", 'q"'], 1.5), (None, None, None, None, None, None)], "source_file string, anchor_event_index long, keep boolean, condition_inputs map<string,string>, nan_masked_features array<string>, predictor_value double")
    assert len(rs.audit(trials).columns) == 14 and len(rs.audit(trials, "time_frequency_condition_test").columns) == 9 and len(rs.audit(trials, "regression").columns) == 20
    rs.write_audit(trials, str(tmp_path / "a.tsv"), "regression", more=["note"])
    rows = {r.source_file: r for r in tables.read_table(spark, str(tmp_path / "a.tsv")).collect()}
    assert (rows["f"].keep, rows["f"].condition_inputs, rows["f"].nan_masked_features, rows["f"].predictor_value) == ("true", r'{"a":"say \"x\"","b":"1"}', r'["q\"", "z"]', "1.5")
    assert (rows[""].keep, rows[""].condition_inputs, rows[""].nan_masked_features, rows[""].predictor_value, rows[""].anchor_event_index, rows[""].note) == ("false", "{}", "[]", "nan", "", "")
    text = "".join(p.read_text() for p in (tmp_path / "a.tsv").glob("part-*"))
    assert '""a"":' in text


def test_audit_path(spark):
    paths = ["d.x/sub-1_stats.h5", "sub-1_other.mat", "sub_stats", "a_stats_b.h5"]
    got = [r.p for r in spark.createDataFrame([(p,) for p in paths], "p string").select(rs.audit_path(F.col("p")).alias("p")).collect()]
    assert got == ["d.x/sub-1_trials.tsv", "sub-1_other.tsv", "sub_trials.tsv", "a_stats_b.tsv"]


def test_tables_without_the_columns(spark):
    table = spark.createDataFrame([("f", "n1")], "file string, name string")
    with pytest.raises(ValueError, match="no column of aal"):
        records.atlas_rows(table, "aal")
    got = records.atlas_rows(table, "aal", without="skip")
    assert got.columns == ["file", "name", "region"] and got.count() == 0
