import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaic.operators import catalog, dsp, epochs, predicates, trials


def values(spark, rules, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*(predicates.compile_rule(predicates.validate(r), df.columns)["matched"].alias(f"m{i}") for i, r in enumerate(rules))).collect()]


def test_rules(spark):
    leaf = lambda op, **k: {"column": "x", "op": op, **k}
    rules = [leaf("==", value="yes"), leaf(">", value=2), leaf("in", values=[True]), {"not": leaf(">", value=2)}, {"column": "gone", "op": "==", "value": 1}, {"any": [leaf("==", value="yes"), {"column": "gone", "op": "==", "value": 1}]}]
    got = values(spark, rules, [(" YES ",), ("3.5",), ("",), (None,), ("1",)], "x string")
    assert got == [(True, False, True, False, False, True), (False, True, False, False, False, False), (False,) * 6, (False,) * 6, (False, False, True, True, False, False)]


@pytest.mark.parametrize("rule", [{}, {"all": []}, {"all": [], "any": []}, {"column": "x", "op": "~", "value": 1}, {"column": "x", "op": "<", "value": "a"}, {"column": "x", "op": "in", "value": 1}, {"column": "x", "op": "between", "values": [1]}, {"column": "x", "op": "==", "value": 1, "values": [1]}])
def test_rules_that_mean_nothing(rule):
    with pytest.raises(predicates.RuleError):
        predicates.validate(rule)


def test_strict_match_needs_no_issue(spark):
    rule = {"any": [{"column": "a", "op": "==", "value": "1"}, {"column": "b", "op": ">", "value": 1}]}
    df = spark.createDataFrame([("1", "2"), ("1", ""), ("0", "x")], "a string, b string")
    assert [r[0] for r in df.select(predicates.matches(rule, df.columns)).collect()] == [True, False, False]
    assert predicates.referenced_columns(rule) == {"a", "b"}


def test_entities_and_names(spark):
    df = catalog.with_entities(spark.createDataFrame([("/d/sub-01/ieeg/subject-01_session-02_task-rest_run-1_desc-a-b_ieeg.vhdr",), ("/d/x.tsv",)], "path string"))
    a, b = df.orderBy("path").collect()
    assert (a.sub, a.ses, a.task, a.run, a.suffix, a.extension, a.datatype) == ("01", "02", "rest", "1", "ieeg", ".vhdr", "ieeg") and a.entities["desc"] == "a-b"
    assert (b.sub, b.suffix, b.extension) == (None, "x", ".tsv")
    assert df.select(catalog.build_name(df.entities, df.suffix, df.extension)).first()[0] == "sub-01_ses-02_task-rest_run-1_desc-a-b_ieeg.vhdr"


def test_best_match_prefers_score_then_few_entities(spark):
    t = catalog.with_entities(spark.createDataFrame([("sub-1_ses-1_task-a_ieeg.vhdr",), ("sub-2_ieeg.vhdr",), ("sub-9_ieeg.vhdr",)], "path string"))
    c = catalog.with_entities(spark.createDataFrame([("sub-1_electrodes.tsv",), ("sub-1_ses-1_electrodes.tsv",), ("sub-1_ses-1_space-x_electrodes.tsv",), ("sub-2_ses-1_electrodes.tsv",), ("sub-2_ses-2_electrodes.tsv",)], "path string"))
    got = {r.target: (r.candidate, r.score, r.ambiguous) for r in catalog.best_match(t, c).collect()}
    assert got == {"sub-1_ses-1_task-a_ieeg.vhdr": ("sub-1_ses-1_electrodes.tsv", 2, False), "sub-2_ieeg.vhdr": ("sub-2_ses-1_electrodes.tsv", 1, True)}


def test_next_response_is_strict_on_both_sides(spark):
    a = spark.createDataFrame([("r", 1, 1.0), ("r", 2, 2.0), ("r", 3, 5.0)], "recording string, id int, onset double")
    b = spark.createDataFrame([("r", 1.0), ("r", 2.0), ("r", 2.5), ("r", 2.7), ("r", 9.0)], "recording string, onset double")
    assert {r.id: r.response for r in trials.next_response(a, b, "id").collect()} == {1: None, 2: 2.5, 3: 9.0}


def test_next_response_goes_to_the_last_anchor_of_a_time(spark):
    """Whatever the order of rows; anchors of unknown recordings have none."""
    rows = [("r", 3, 1.0), ("r", 1, 1.0), ("r", 2, 1.0), (None, 4, 1.0), ("r", 5, 2.0)]
    b = spark.createDataFrame([("r", 1.5), (None, 1.5), ("r", 2.0), ("r", 3.0)], "recording string, onset double")
    for given in (rows, rows[::-1]):
        a = spark.createDataFrame(given, "recording string, id int, onset double")
        assert {r.id: r.response for r in trials.next_response(a, b, "id").collect()} == {1: None, 2: None, 3: 1.5, 4: None, 5: 3.0}


def test_nearest_rows_are_used_once(spark):
    a = spark.createDataFrame([("r", 1, 1.0, "x"), ("r", 2, 1.0004, "x"), ("r", 3, 4.0, "y")], "recording string, id int, onset double, code string")
    b = spark.createDataFrame([("r", 10, 1.0003, None), ("r", 11, 1.0009, "x"), ("r", 12, 4.0, "z")], "recording string, k int, onset double, code string")
    assert {(r.anchor, r.row) for r in trials.nearest_rows(a, b, "id", "k").collect()} == {(1, 10), (2, 11)}


@pytest.mark.parametrize("cut", [1, 3, 1 << 20])
def test_nearest_rows_with_recordings_cut(spark, monkeypatch, cut):
    monkeypatch.setattr(trials, "CUT", cut)
    rng = np.random.default_rng(cut)
    a = [(r, i, float(t), str(c)) for r in "rs" for i, (t, c) in enumerate(zip(np.sort(rng.uniform(0, 3 if r == "r" else 0.2, 120)), rng.choice(["x", "y"], 120), strict=True))]
    b = [(r, i, t + float(rng.normal(0, 0.004)), c if rng.random() < 0.7 else None) for r, i, t, c in a]
    want = set()
    for rec in "rs":
        used = set()
        for _, i, t, c in sorted((x for x in a if x[0] == rec), key=lambda x: (x[2], x[1])):
            near = sorted((abs(t - u), j) for q, j, u, d in b if q == rec and abs(t - u) <= 0.01 and d in (None, c) and j not in used)
            if near:
                used.add(near[0][1])
                want.add((rec, i, near[0][1]))
    schema = "recording string, {} int, onset double, code string"
    got = trials.nearest_rows(spark.createDataFrame(a, schema.format("id")), spark.createDataFrame(b, schema.format("k")), "id", "k", tolerance=0.01)
    assert {(r.recording, r.anchor, r.row) for r in got.collect()} == want


def test_windows_include_their_ends(spark):
    a = spark.createDataFrame([("r", 1, 10.0)], "recording string, id int, onset double")
    b = spark.createDataFrame([("r", x) for x in (8.999, 9.0, 10.0, 12.0, 12.001, None)], "recording string, onset double")
    assert sorted(r.event_onset for r in trials.events_in_window(a, b, -1.0, 2.0).collect()) == [9.0, 10.0, 12.0]


def test_last_bin_takes_a_single_sample(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(7)], "trial int, t_idx int, v double")
    assert {r.bin: r.v for r in epochs.bin_by_samples(df, ["trial"], 3, 7).collect()} == {0: 1.0, 1: 4.5}


def test_epochs_are_whole(spark):
    s = spark.createDataFrame([("r", i, float(i)) for i in range(20)], "recording string, sample long, v double")
    a = spark.createDataFrame([("r", 1, 2), ("r", 2, 5), ("r", 3, 18)], "recording string, trial int, anchor_sample long")
    got = sorted((r.trial, r.t_idx, r.v) for r in epochs.extract(s, a, -3, 2).collect())
    assert got == [(2, i, 2.0 + i) for i in range(6)]


def test_envelope_finds_amplitude():
    fs, n = 512.0, 1024
    t = np.arange(n) / fs
    x = 3 * np.sin(2 * np.pi * 55 * t)
    e = dsp.envelopes(x, fs, [(50.0, 60.0), (100.0, 110.0)])
    assert abs(np.median(e[0]) - 3) < 0.05 and e[1].max() < 0.2
    assert dsp.clamp_bins(dsp.frequency_bins(50, 150, 10), 200.0, 50, 10)[-1] == (90, 100)


def test_tapers_are_orthonormal():
    v = dsp.dpss(64, 4.0, 7)
    assert np.allclose(v @ v.T, np.eye(7), atol=1e-9) and v[0].min() > 0


def test_multitaper_peaks_at_the_tone():
    x = np.sin(2 * np.pi * 16 * np.arange(256) / 128)
    power = dsp.multitaper_db(x, 128.0, [8.0, 16.0, 32.0], 0.5, 4.0)
    assert np.isnan(power[:, 0]).all() and (np.nanargmax(power[:, 100:150], axis=0) == 1).all()


def test_resample_keeps_a_slow_wave():
    x = np.sin(2 * np.pi * 3 * np.arange(600) / 300)
    y = dsp.resample(x, 100, 300)
    assert len(y) == 200 and np.abs(y[20:180] - np.sin(2 * np.pi * 3 * np.arange(200) / 100)[20:180]).max() < 0.02


def test_names_keep_all_entities(spark):
    """All 35 fixed entities have their places; others have none."""
    df = spark.createDataFrame([({"zeta": "1", "desc": "d", "scale": "2", "atlas": "x", "sub": "01", "cohort": "c", "tpl": "t", "seg": "s", "beta": "2"},)], "e map<string,string>")
    name = df.select(catalog.build_name(F.col("e"), F.lit("ieeg"), F.lit(".tsv"))).first()[0]
    assert name == "sub-01_tpl-t_cohort-c_atlas-x_seg-s_scale-2_desc-d_ieeg.tsv"
    assert len(catalog.ORDER) == 35


def test_wavelet_by_sums():
    """Against the transform written out as sums; a wave is strongest at the scale of its frequency."""
    rng = np.random.default_rng(1)
    x, n, moment = rng.normal(size=24), 24, 6
    got, frequency = dsp.dog_wavelet(x, 100.0, (0, 2), 3, moment)
    assert got.shape == (6, n) and (np.diff(frequency) > 0).all() and frequency[-1] == 25.0
    for row, f in zip(got, frequency, strict=True):
        s = 100.0 / (4 * f)
        for t in (0, 7):
            total = 0
            for k in range(n):
                u = s * 2 * np.pi * k / n
                spectrum = sum(x[m] * np.exp(-2j * np.pi * k * m / n) for m in range(n))
                total += spectrum * u**moment * np.exp(-(4 * moment / np.pi**2) * u**2 / 2) * np.exp(2j * np.pi * k * t / n)
            assert abs(row[t] - total / n * np.sqrt(s)) < 1e-9
    wave = np.cos(2 * np.pi * 12.5 * np.arange(400) / 100.0)
    tf, frequency = dsp.dog_wavelet(wave, 100.0, (0, 3), 12)
    assert abs(frequency[np.abs(tf[:, 200]).argmax()] - 12.5) < 0.8


def test_whitening_is_by_the_background():
    rng = np.random.default_rng(2)
    tf = 3 * rng.normal(size=(1, 2000)) + 3j * rng.normal(size=(1, 2000))
    tf[0, 1000] = 900
    power = dsp.whiten(tf, 100.0)
    assert power[0, 0] == 0 and abs(power[0, 1000] / 300**2 - 1) < 0.15
    assert dsp.background_samples(2000, 100.0).tolist() == list(range(99, 1900)) and len(dsp.background_samples(20_000, 100.0)) == 15_000
    assert dsp.background_samples(50, 100.0).tolist() == list(range(50))
    assert np.allclose(dsp.tukey(9, 0.5), [0, 0.5, 1, 1, 1, 1, 1, 0.5, 0])


def test_ordered_match_uses_rows_up(spark):
    a = spark.createDataFrame([("r", i, float(i), c) for i, c in enumerate("xyxz")], "recording string, anchor int, onset double, code string")
    b = spark.createDataFrame([("r", 10, 1, "x", "A"), ("r", 11, 2, "q", "A"), ("r", 12, 3, None, None), ("r", 13, 4, "x", "B")], "recording string, row int, place int, code string, label string")
    got = {r.anchor: (r.row, r.label, r.keep, r.exclusion_reason) for r in trials.match_in_order(a, b).collect()}
    assert got == {0: (10, "A", True, None), 1: (12, None, False, "missing_label"), 2: (13, "B", True, None), 3: (None, None, False, "no_matching_table_row")}


def test_channels_that_match_nothing(spark):
    from voltaic.operators import groups

    c = spark.createDataFrame([("A1",), ("A2",), ("B1",)], "name string")
    assert {r.name for r in groups.select_channels(c, ["A\\d", "B1"], ["A2"]).collect()} == {"A1", "B1"}
    with pytest.raises(ValueError, match="no channel matches C"):
        groups.select_channels(c, ["C"])
    with pytest.raises(ValueError, match="no channel is left"):
        groups.select_channels(c, exclude=[".*"])


def test_runs_must_agree(spark):
    a = spark.range(2).selectExpr("id", "1000.0 as fs")
    assert epochs.union_runs([a, a]).count() == 4
    with pytest.raises(ValueError, match="runs differ in fs"):
        epochs.union_runs([a, a.selectExpr("id", "500.0 as fs")])


def test_grids():
    assert dsp.octave_range(80, 500, 2048) == (0, 3)
    assert dsp.snap_frequencies([0.1, 4.2, 4.3, 8.0], 500, 1000.0).tolist() == [4.0, 8.0]
    assert dsp.snap_times(np.arange(10) / 10, np.array([0.04, 0.06, 0.88, 3.0])).tolist() == [0, 1, 9]
    x = np.arange(50.0) ** 2
    assert np.abs(dsp.detrend(x, 2)).max() < 1e-8 and abs(dsp.detrend(x, 0).mean()) < 1e-9 and (dsp.detrend(x, -1) == x).all()
    grid = dsp.time_frequency_grid([10.0, 60.0], 2.0)
    assert grid == [(10.0, 0.6, 10 / 3, 1), (60.0, 0.2, 20.0, 7)]


def test_incompatible_inputs(spark):
    from voltaic.operators import groups

    a = spark.createDataFrame([("p", "channel", 1), ("q", "channel", 1)], "path string, feature_level string, fs int")
    groups.check_compatible(a, ["fs"])
    with pytest.raises(ValueError, match="inputs differ in fs"):
        groups.check_compatible(a.unionByName(spark.createDataFrame([("r", "channel", 2)], a.schema)), ["fs"])
    with pytest.raises(ValueError, match="must be of channels"):
        groups.check_compatible(spark.createDataFrame([("r", "roi", 2)], a.schema), ["fs"])
    with pytest.raises(ValueError, match="no input"):
        groups.check_compatible(a.limit(0), ["fs"])


def test_row_sources(spark):
    events = spark.createDataFrame([("r", "7", "A", "1", 0)], "recording string, anchor_event_code string, choice string, trial_id string, row_index int")
    labels = spark.createDataFrame([("r", "1", "B")], "recording string, trial_id string, mood string")
    assert trials.build_rows(events, labels, {"choice"})[1] == "events"
    rows, how = trials.build_rows(events, labels, {"mood"})
    assert how == "trial_id" and rows.first().event_choice == "A"
    assert trials.build_rows(None, labels, {"mood"})[1] == "labels"
    with pytest.raises(ValueError):
        trials.build_rows(events, None, {"mood"})


def test_catalog_queries_take_every_event(spark, sf, duck):
    """Every path of the table has its best match, by brute force, and is either done or still to do."""
    from voltaic.plans import domain, queries

    paths = {r.path: r.asDict() for r in catalog.with_entities(domain._paths(spark, sf)).collect()}
    events = duck.execute("SELECT event_id, user_id, event_type FROM events").fetchall()
    some = {(str(u % 20) if i % 7 else None, str(i % 4) if i % 2 and u % 3 else None, t) for i, u, t in events}
    want = {}
    for path, r in paths.items():
        pairs = [(-sum(a is not None and a == b for a, b in zip((r["sub"], r["ses"], r["task"]), c)), sum(x is not None for x in c), c) for c in some if all(a is None or b is None or a == b for a, b in zip((r["sub"], r["ses"], r["task"]), c))]
        best = [c for c in pairs if c[:2] == min(pairs, key=lambda x: x[:2])[:2]]
        want[path] = (min("_".join([f"{k}-{v}" for k, v in zip(("sub", "ses", "task"), c) if v is not None] + ["electrodes.tsv"]) for *_, c in best), -best[0][0], len(best) > 1)
    assert {r.target: (r.candidate, r.score, r.ambiguous) for r in queries.QUERIES["best_entity_match_all"](spark, sf).collect()} == want
    assert {r.path for r in queries.QUERIES["skip_existing_all"](spark, sf).collect()} == {p for p, r in paths.items() if r["task"] in ("error", "signup")}


def test_ordered_match_takes_every_row(spark, sf, duck):
    """Against a walk over all clicks and views."""
    from voltaic.plans import queries, tables

    a = duck.execute(f"WITH {tables.ANNOTATIONS} SELECT recording, event_id, onset, code, value FROM a WHERE code IN ('click', 'view')").df()
    want = {}
    for _, part in a.groupby("recording"):
        rest = iter(part.sort_values("event_id").itertuples())
        for x in part.sort_values(["onset", "event_id"]).itertuples():
            want[x.event_id] = next((r.event_id for r in rest if r.event_id % 2 == 0 or (r.value < 100 and r.code == x.code)), None)
    got = queries.QUERIES["ordered_match"](spark, sf).collect()
    assert {r.anchor: r.row for r in got} == want and any(v % 3 == 0 for v in want.values() if v is not None)
    assert all(r.exclusion_reason == ("no_matching_table_row" if r.row is None else None if r.row % 5 else "missing_label") for r in got) and None in want.values()


def test_whole_queries_leave_no_row_out(spark, sf, duck):
    from voltaic.plans import queries

    q = lambda name: queries.QUERIES[name](spark, sf)
    one = lambda sql: duck.execute(sql).fetchone()[0]
    assert q("union_runs_all").count() == one("SELECT count(*) FROM orders")
    assert q("manual_roi_records_all").groupBy().sum("n").first()[0] == one("SELECT count(*) FROM customer WHERE c_acctbal > 0")
    assert {r.key for r in q("shared_entities_all").collect()} == {"sub"}
