"""Datasets listed by folders that filters choose, loaders by extension, and recordings written and read again."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from voltaic.sources import brainvision, catalog, files


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("dataset")
    for name in (
        "participants.tsv", "dataset_description.json", "sub-01/ses-1/ieeg/sub-01_ses-1_task-rest_ieeg.vhdr", "sub-01/ses-1/ieeg/sub-01_ses-1_task-rest_events.tsv", "sub-02/ieeg/sub-02_task-rest_ieeg.vhdr",
        "code/run.py", "derivatives/bands/sub-01/sub-01_desc-a_tfr.h5", "derivatives/bands/sub-01/sub-01_desc-0_power.h5", "derivatives/bands/notes.json", "derivatives/other/sub-02/sub-02_x.mat",
    ):
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("{}")
    return str(top)


def test_every_file_once_with_its_scope(spark, root):
    rows = catalog.scan(spark, root).collect()
    assert sorted(r.path for r in rows) == sorted(p for p, _ in files.walk(root))
    by = {files.name_of(r.path): r for r in rows}
    r = by["sub-01_ses-1_task-rest_ieeg.vhdr"]
    assert (r.scope, r.sub, r.ses, r.datatype, r.suffix, r.extension, r.entities, r.bytes) == ("raw", "01", "1", "ieeg", "ieeg", ".vhdr", {"sub": "01", "ses": "1", "task": "rest"}, 2)
    assert by["notes.json"].scope == "bands" and by["run.py"].scope == "raw" and by["sub-02_x.mat"].scope == "other"
    assert {r.scope for r in catalog.scan(spark, root, derivatives=False).collect()} == {"raw"}


def test_filters_choose_the_folders(spark, root, monkeypatch):
    reader = catalog.Reader({"path": root})
    assert list(reader.pushFilters([EqualTo(("sub",), "01"), EqualTo(("suffix",), "ieeg")])) == [EqualTo(("sub",), "01"), EqualTo(("suffix",), "ieeg")]
    listed = []
    own = files.children
    monkeypatch.setattr(files, "children", lambda path: listed.append(path.removeprefix(root)) or own(path))
    assert [p.path.removeprefix(root) for p in reader.partitions()] == ["/sub-01", "/derivatives/bands/sub-01"]
    assert listed == ["/derivatives", "", "/derivatives/bands", "/derivatives/other"]
    one = catalog.Reader({"path": root})
    list(one.pushFilters([In(("sub",), ("01", "03")), EqualTo(("scope",), "raw")]))
    listed.clear()
    parts = one.partitions()
    assert [p.path.removeprefix(root) for p in parts] == ["/sub-01"] and listed == [""]
    list(one.read(parts[0]))
    assert listed == ["", "/sub-01", "/sub-01/ses-1", "/sub-01/ses-1/ieeg"]
    monkeypatch.undo()
    chosen = catalog.scan(spark, root).where("sub = '01' and scope = 'raw'")
    assert chosen.count() == 2 and chosen.rdd.getNumPartitions() == 1
    assert catalog.scan(spark, root).where("sub = '01'").count() == 4


def test_loaders(spark, root, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2\n")
    assert catalog.load(spark, str(tmp_path / "a.tsv")).collect()[0].asDict() == {"x": "1", "y": "2"}
    own = {".tsv": lambda s, p: s.range(3), ".edf": lambda s, p: s.range(2)}
    assert catalog.load(spark, "a.tsv", own).count() == 3 and catalog.load(spark, "b.edf", own).count() == 2
    for name in ("b.edf", "noending"):
        with pytest.raises(ValueError, match="no loader"):
            catalog.load(spark, name)


def test_time_frequency_files(spark, root):
    found = {(r.scope, r.sub): files.name_of(r.path) for r in catalog.time_frequency_file(catalog.scan(spark, root)).collect()}
    assert found == {("bands", "01"): "sub-01_desc-a_tfr.h5", ("other", "02"): "sub-02_x.mat"}


def blocks(spark, n=1000, size=300):
    rng = np.random.default_rng(0)
    data = {(r, c): rng.normal(size=n).astype("f4").astype(float) for r in ("sub-1_ieeg", "sub-2_ieeg") for c in ("A1", "A,2", "B")}
    rows = []
    for (r, c), x in data.items():
        for i in range(0, n, size):
            marks = [("Stimulus", "S 1, left", i + 5, 1)] if c == "A1" and i else None
            rows.append((r, c, ("A1", "A,2", "B").index(c), 512.0, i, x[i : i + size].tolist(), marks))
    return data, spark.createDataFrame(rows, f"recording string, channel string, ch_ord int, sfreq double, first_sample bigint, samples array<double>, markers {brainvision.MARKERS}").repartition(7)


def test_recordings_written_and_read(spark, tmp_path):
    data, df = blocks(spark)
    brainvision.write_recordings(df, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(f"sub-{i}_ieeg.{e}" for i in (1, 2) for e in ("eeg", "vhdr", "vmrk"))
    rows = spark.read.format("brainvision").option("block", 170).load(str(tmp_path)).orderBy("recording", "ch_ord", "block").collect()
    got = {}
    for r in rows:
        got.setdefault((r.recording, r.channel), []).extend(r.samples)
        assert r.sfreq == 512.0
    assert {k: list(v) for k, v in data.items()} == got
    marks = brainvision.parse_markers((tmp_path / "sub-1_ieeg.vmrk").read_text())
    assert marks == [("New Segment", "", 0, 1), ("Stimulus", "S 1, left", 305, 1), ("Stimulus", "S 1, left", 605, 1), ("Stimulus", "S 1, left", 905, 1)]
    with pytest.raises(Exception, match="there already"):
        brainvision.write_recordings(df, str(tmp_path))
    assert not any("_temporary" in p.name for p in tmp_path.iterdir())
    brainvision.write_recordings(df.withColumn("samples", F.transform("samples", lambda x: x * 0)), str(tmp_path), replace=True)
    assert spark.read.format("brainvision").load(str(tmp_path)).where(F.exists("samples", lambda x: x != 0)).count() == 0


@pytest.mark.parametrize("fault", ["gap", "channel", "task"])
def test_an_aborted_job_leaves_nothing(spark, tmp_path, fault):
    _, df = blocks(spark)
    if fault == "gap":
        df = df.where("not (recording = 'sub-2_ieeg' and first_sample = 300)")
    elif fault == "channel":
        df = df.where("not (recording = 'sub-2_ieeg' and first_sample = 600 and channel = 'B')")
    else:
        df = df.withColumn("samples", F.when((F.col("recording") == "sub-2_ieeg") & (F.col("first_sample") == 900), F.raise_error(F.lit("lost")).cast("array<double>")).otherwise(F.col("samples")))
    with pytest.raises(Exception, match="doesn't go on|lost"):
        brainvision.write_recordings(df, str(tmp_path))
    assert list(tmp_path.iterdir()) == []
