import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaic.sources import brainvision, sinks, tables
from voltaic.streaming import rates

HEADER = """Brain Vision Data Exchange Header File Version 1.0
[Common Infos]
DataFile=a.eeg
MarkerFile=a.vmrk
DataFormat=BINARY
DataOrientation={orientation}
NumberOfChannels=2
SamplingInterval=1000
[Binary Infos]
BinaryFormat=INT_16
[Channel Infos]
Ch1=A1,,0.5,uV
Ch2=A2,,1,uV
"""


@pytest.mark.parametrize("orientation", ["MULTIPLEXED", "VECTORIZED"])
def test_brainvision(spark, tmp_path, orientation):
    x = np.arange(20, dtype="<i2").reshape(2, 10)
    (tmp_path / "a.vhdr").write_text(HEADER.format(orientation=orientation))
    (tmp_path / "a.eeg").write_bytes((x.T if orientation == "MULTIPLEXED" else x).copy().tobytes())
    brainvision.register(spark)
    rows = spark.read.format("brainvision").option("block", 4).load(str(tmp_path)).orderBy("ch_ord", "block").collect()
    assert [r.channel for r in rows] == ["A1"] * 3 + ["A2"] * 3 and {r.sfreq for r in rows} == {1000.0}
    assert sum((r.samples for r in rows[:3]), []) == (x[0] / 2).tolist() and sum((r.samples for r in rows[3:]), []) == x[1].tolist()
    assert brainvision.parse_markers("Mk1=Stimulus,S  7,11,1,0\nMk2=New Segment,,1,1") == [("Stimulus", "S  7", 10, 1), ("New Segment", "", 0, 1)]


def test_tables_are_text_with_provenance(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("onset\tcode\n 1.5 \t007\n2\t\n")
    (tmp_path / "b.tsv").write_text("onset\tcode\n3\tx\n")
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "a.tsv")).collect()] == [("1.5", "007"), ("2", "")]
    rows = tables.read_rows(spark, str(tmp_path / "*.tsv")).collect()
    assert sorted((r.file[-5:], r.row_index, r.onset) for r in rows) == [("a.tsv", 0, "1.5"), ("a.tsv", 1, "2"), ("b.tsv", 0, "3")]


def test_results_carry_their_schema(spark, tmp_path):
    path = str(tmp_path / "r")
    sinks.write_result(spark.range(3).withColumn("sub", F.lit("01")), path, "tfr", ("sub",))
    assert tables.read_result(spark, path, "tfr").count() == 3
    with pytest.raises(Exception, match="expected envelope 1.0, found tfr"):
        tables.read_result(spark, path, "envelope").collect()


def test_text_and_description(spark, tmp_path):
    df = spark.sql("select 1 as trial_id, true as keep, map('a', '1') as condition_inputs, cast(null as string) as exclusion_reason")
    sinks.write_text(df, str(tmp_path / "t"), sinks.TRIAL_AUDIT)
    text = next((tmp_path / "t").glob("*.csv")).read_text()
    assert text.splitlines()[0] == "trial_id\tkeep\texclusion_reason\tcondition_inputs"
    assert json.loads(sinks.dataset_description("n", "p", "1", {"a": 1}))["GeneratedBy"][0]["Parameters"] == {"a": 1}


def test_event_sources():
    assert tables.resolve_events("a", "b") == ("b", "exact_time")
    assert tables.resolve_events("a", None) == ("a", "sample_quantized")
    with pytest.raises(ValueError):
        tables.resolve_events("a", None, "events_tsv")


def test_stream_gives_what_a_batch_gives(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = tmp_path / "in"
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(str(source))
    stream = rates.windowed_rates(rates.read_stream(spark, str(source), events), "6 hours", "30 days")
    rates.run_once(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    batch = rates.windowed_rates(events, "6 hours")
    got = {tuple(r)[:3] for r in spark.read.schema(batch.schema).parquet(str(tmp_path / "out")).collect()}
    assert got <= {tuple(r)[:3] for r in batch.collect()}
