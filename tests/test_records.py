"""Records of recordings and regions, and plans over many subjects against plans over one."""

import pytest
from pyspark.sql import functions as F

from voltaic.operators import catalog as ct
from voltaic.operators import records as rc
from voltaic.plans import pipelines
from voltaic.plans.tables import epochs


def test_columns_and_parameters():
    assert rc.select_column(["Name", "AAL"], ["channel", "name"]) == "Name"
    assert rc.select_column(["x"], ["name"]) is None
    assert rc.merged_parameters({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"c": 4}, "d": {"e": 5}}) == {"a": {"b": 1, "c": 4}, "d": {"e": 5}}
    assert rc.UNITS["none"][1:] == ("µV", 1e-6)


def atlas(spark, rows):
    channels = spark.createDataFrame([("i", " a1 "), ("i", "B2"), ("i", "c3")], "item string, channel string")
    sources = spark.createDataFrame([("i", "f", 0), ("i", "g", 1)], "item string, file string, place int")
    return channels, sources, spark.createDataFrame([(f, i, n, r) for i, (f, n, r) in enumerate(rows)], "file string, row_index int, name string, region string")


def test_atlas(spark):
    rows = [("f", "A1", " Hip "), ("f", "b2", "n/a"), ("g", "b2", "Amy"), ("g", "a1", "Hip"), ("g", "C3", None), ("h", "c3", "Ins"), ("g", "", "Amy")]
    found = rc.assign_regions(*atlas(spark, rows)).collect()
    assert sorted((r["channel"].strip(), r["region"]) for r in found) == [("B2", "Amy"), ("a1", "Hip")]


@pytest.mark.parametrize("rows", [[("f", "A1", "Hip"), ("f", "a1", "Amy")], [("f", "A1", "Hip"), ("g", "a1", "Amy")]])
def test_atlas_conflict(spark, rows):
    with pytest.raises(Exception, match="several regions"):
        rc.assign_regions(*atlas(spark, rows)).collect()
    assert [r["region"] for r in rc.last_regions(*atlas(spark, rows)).collect()] == ["Amy"]


def test_field_clash(spark):
    df = spark.createDataFrame([("a b",), ("a-b",)], "region string")
    assert {r["field"] for r in rc.region_fields(df, clash="merge").collect()} == {"a_b"}
    with pytest.raises(Exception, match="are one field"):
        rc.region_fields(df).collect()


def test_events_files(spark):
    def files(*names):
        return ct.with_entities(spark.createDataFrame([(f"/d/{n}",) for n in names], "path string"))

    recordings = files("sub-1_task-a_ieeg.vhdr", "sub-2_task-a_ieeg.vhdr")
    found = rc.events_files(recordings, files("sub-1_events.tsv", "sub-1_channels.tsv", "sub-2_events.json", "sub-3_events.TSV")).collect()
    assert {(r["recording"], r["events_file"]) for r in found} == {("/d/sub-1_task-a_ieeg.vhdr", "/d/sub-1_events.tsv"), ("/d/sub-2_task-a_ieeg.vhdr", None)}
    with pytest.raises(Exception, match="several events tables"):
        rc.events_files(recordings, files("sub-1_events.tsv", "sub-1_task-a_events.tsv")).collect()


def test_metric(spark):
    df = spark.createDataFrame([("p", ["t"]), ("q", None)], "path string, available_metrics array<string>")
    assert rc.require_metric(df.where("path = 'p'"), "t").count() == 1
    with pytest.raises(Exception, match="t is not available in q"):
        rc.require_metric(df, "t").collect()


def test_empty_and_missing(spark):
    df = spark.createDataFrame([(1, [1.0], [2.0]), (2, [], []), (3, None, [1.0]), (4, [1.0, 2.0], [1.0])], "i int, x array<double>, y array<double>")
    assert [tuple(r) for r in rc.scatter_pairs(df, ["i"]).collect()] == [(1, 0, 1.0, 2.0)]
    assert rc.valued_rows(df.select("i", F.col("x").alias("values"))).count() == 2
    assert rc.detection_table(df.limit(0)).count() == 0
    row = rc.detection_table(df.select(F.lit(None).cast("string").alias("channel"))).first()
    assert tuple(row) == (0.0, 0.0, "", "", 0.0, 0, 0, 0.0, "#808080")


@pytest.mark.parametrize("options", [{}, {"unit": "unit"}, {"baseline": (-0.2, 0.0)}])
def test_subjects_are_their_own(spark, sf, options):
    rows = epochs(spark, sf).withColumns({"subject": F.col("label") % 2, "trial": F.expr("trial DIV 2"), "condition": F.when(F.col("trial") % 3 == 0, "A").otherwise("B"), "unit": F.col("trial") % 7})
    check(pipelines.condition_test, rows, options)


def test_regression_subjects(spark, sf):
    rows = epochs(spark, sf).withColumns({"subject": F.col("label") % 2, "trial": F.expr("trial DIV 2"), "condition": F.lit("A")})
    check(pipelines.regression_test, rows.groupBy("subject", "trial", "condition", "feature", "t_idx").agg(F.first("v").alias("v"), F.max("trial").cast("double").alias("x")), {"zscore_x": True})
    check(pipelines.against_zero, rows, {})


def check(test, rows, options):
    rows = rows.cache()
    both = test(rows, by=["subject"], **options).toPandas()
    for s in (0, 1):
        one = test(rows.where(F.col("subject") == s).drop("subject"), **options).toPandas()
        keys = [k for k in ("condition", "feature", "t_idx") if k in one]
        a, b = (x.sort_values(keys).reset_index(drop=True)[[*keys, "t", "p", "p_corr"]] for x in (both[both["subject"] == s], one))
        assert len(a) == len(b) > 0
        assert (a[keys] == b[keys]).all().all()
        assert ((a[["t", "p", "p_corr"]] - b[["t", "p", "p_corr"]]).abs().fillna(0) < 1e-6).all().all()
    rows.unpersist()


def test_permuted_t_by_matrices(spark):
    """Missing values, cells with too few trials, and two subjects with the same trials, against the join."""
    from voltaic.operators import resample, stats

    data = [(s, i, c, None if (i + c) % 5 == 0 or (c == 2 and i > 1) else float((i * 7 + c * 3 + s * 11) % 13)) for s in (0, 1) for i in range(9) for c in range(3)]
    values = spark.createDataFrame(data, "subject int, trial int, cell int, v double")
    dealt = spark.createDataFrame([(s, p, i, "AB-"[(i * (p + 2) + s) % 3]) for s in (0, 1) for p in range(4) for i in range(9)], "subject int, perm int, trial int, condition string")
    got = {tuple(r)[:3]: r["t"] for r in resample.permuted_t(values, dealt, ["cell"], by=["subject"], blocks=2).collect()}
    want = {tuple(r)[:3]: r["t"] for r in stats.two_sample_t(values.join(dealt, ["subject", "trial"]), ["perm", "subject", "cell"]).collect()}
    assert set(got) == set(want)
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)
    assert resample.permuted_t(values.limit(0), dealt, ["cell"], by=["subject"]).count() == 0


def test_permuted_t_streams_slices(spark, monkeypatch):
    """In small slices that are sent on at once: cells without any value or with one value only, labels that lack a permutation, trials of one side only, other types of keys; no task holds a block."""
    from voltaic.operators import resample, stats

    monkeypatch.setattr(resample, "STEP", 12)
    monkeypatch.setattr(resample, "HELD", 8)
    data = [(f"t{i:02}", c, None if c == "none" or i % 7 == 0 else 0.1 if c == "same" else 1e6 + float((i * i * 7 + len(c)) % 13)) for i in range(40) for c in ("none", "same", "x", "long")]
    values = spark.createDataFrame(data, "trial string, cell string, v double")
    dealt = spark.createDataFrame([(p, f"t{i:02}", "AB-"[(i * (p + 2)) % 3]) for p in range(4) for i in range(3, 44) if (i + p) % 6], "perm int, trial string, condition string")
    made = resample.permuted_t(values, dealt, ["cell"], blocks=2, slices=3)
    got = {tuple(r)[:2]: r["t"] for r in made.collect()}
    want = {tuple(r)[:2]: r["t"] for r in stats.two_sample_t(values.join(dealt, "trial"), ["perm", "cell"]).collect()}
    assert set(got) == set(want)
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-6) for k in want)
    assert sum(t is not None for t in got.values()) == 6
    assert "CoGroups" not in made._jdf.queryExecution().toString()
