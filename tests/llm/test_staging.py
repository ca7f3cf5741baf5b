from pathlib import Path

from voltaic.llm import _common


def test_staged_tables_go(spark):
    df = _common.stage(spark.range(3))
    folder = Path(_common.shared_dir(spark).removeprefix("file://"))
    assert df.count() == 3 and folder.is_dir()
    _common.release(spark)
    assert not folder.exists()


def test_empty_batches_and_long_texts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "", "x" * 100, "é"])], ["text"])
    got = [(i, j, bytes(d), o.tolist()) for i, j, d, o in _common.chunks(batch, limit=10)]
    assert got == [(0, 3, b"ab", [0, 2, 2, 2]), (3, 4, b"x" * 100, [0, 100]), (4, 5, "é".encode(), [0, 2])]
    assert list(_common.chunks(batch.slice(0, 0))) == []
    sliced = [(i, j, bytes(d)) for i, j, d, _ in _common.chunks(batch.slice(3, 2), limit=1000)]
    assert sliced == [(0, 2, b"x" * 100 + "é".encode())]
