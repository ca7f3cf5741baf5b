"""BrainVision recordings (header, markers, binary samples) as a Spark data source, to be read and written.

``spark.read.format("brainvision").load(folder or header)``: a row per (recording, channel, block of samples). Files are split over tasks by recording and block, so no task
holds a whole recording. Options: ``block`` (samples of a block, 60,000).

``write_recordings(df, folder)`` writes such rows. A recording's blocks pass one task in order, which appends them to files in a folder of the job's own; the commit
moves the files to their places, headers last, so whoever looks for headers sees whole recordings only, and a job that is aborted leaves nothing.
"""

from __future__ import annotations

import configparser
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import files

#: Binary formats of the file format.
FORMATS = {"INT_16": "<i2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4"}
SCHEMA = "recording string, channel string, ch_ord int, sfreq double, block int, first_sample bigint, samples array<double>"
MARKERS = "array<struct<type:string,description:string,sample:bigint,length:bigint>>"


@dataclass
class Header:
    data: str
    markers: str | None
    fs: float
    names: list[str]
    scales: list[float]
    kind: str
    multiplexed: bool


def parse_header(text: str) -> Header:
    """The parts of a .vhdr file."""
    _, _, body = text.partition("[Common Infos]")
    body = "[Common Infos]" + body.partition("[Comment]")[0]
    ini = configparser.ConfigParser(interpolation=None, comment_prefixes=(";",), strict=False)
    ini.optionxform = str
    ini.read_string(body)
    common = ini["Common Infos"]
    names, scales = [], []
    for i in range(int(common["NumberOfChannels"])):
        parts = ini["Channel Infos"][f"Ch{i + 1}"].split(",")
        names.append(parts[0].replace(r"\1", ","))
        scales.append(float(parts[2]) if len(parts) > 2 and parts[2] else 1.0)
    kind = FORMATS[ini["Binary Infos"]["BinaryFormat"]] if "Binary Infos" in ini else "<i2"
    return Header(common["DataFile"], common.get("MarkerFile"), 1e6 / float(common["SamplingInterval"]), names, scales, kind, common.get("DataOrientation", "MULTIPLEXED").upper() == "MULTIPLEXED")


def parse_markers(text: str) -> list[tuple[str, str, int, int]]:
    """(type, description, first sample from 0 on, samples) of each marker of a .vmrk file."""
    out = []
    for line in text.splitlines():
        if line.startswith("Mk") and "=" in line:
            parts = line.split("=", 1)[1].split(",")
            out.append((parts[0], parts[1].replace(r"\1", ","), int(parts[2]) - 1, int(parts[3] or 1)))
    return out


class Block(InputPartition):
    def __init__(self, path: str, block: int, first: int, n: int) -> None:
        self.path, self.block, self.first, self.n = path, block, first, n


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("block", 60_000))

    def _headers(self) -> list[str]:
        if self.path.endswith(".vhdr"):
            return [self.path]
        return [p for p, _ in files.walk(self.path) if p.endswith(".vhdr")]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self._headers():
            h = _open(path)
            total = files.size(files.join(files.parent(path), h.data)) // (np.dtype(h.kind).itemsize * len(h.names))
            out += [Block(path, i, first, min(self.size, total - first)) for i, first in enumerate(range(0, total, self.size))]
        return out

    def read(self, partition: Block) -> Iterator[tuple]:
        h = _open(partition.path)
        file, c = files.join(files.parent(partition.path), h.data), len(h.names)
        width, n = np.dtype(h.kind).itemsize, partition.n
        if h.multiplexed:
            x = np.frombuffer(files.read(file, partition.first * c * width, n * c * width), h.kind).reshape(n, c).T
        else:
            total = files.size(file) // (width * c)
            x = np.array([np.frombuffer(files.read(file, (k * total + partition.first) * width, n * width), h.kind) for k in range(c)])
        for k, (name, scale) in enumerate(zip(h.names, h.scales, strict=True)):
            yield files.name_of(partition.path).removesuffix(".vhdr"), name, k, h.fs, partition.block, partition.first, (x[k] * scale).astype(float).tolist()


def _open(path: str) -> Header:
    return parse_header(files.read(path).decode("utf-8", errors="replace"))


@dataclass
class Written(WriterCommitMessage):
    """Recordings of a task: name, folder of its files, channels, rate."""

    recordings: list[tuple[str, str, list[str], float]]


class Writer(DataSourceWriter):
    """Samples as 32-bit floats, channels in turn, microvolts."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool) -> None:
        self.folder, self.columns, self.overwrite = options["path"], columns, overwrite
        self.job = files.join(self.folder, f"_temporary-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        done: list[tuple[str, str, list[str], float]] = []
        task = files.join(self.job, uuid.uuid4().hex)  # of this attempt: one that failed leaves files that nobody names
        for name, blocks in _recordings(dict(zip(self.columns, row, strict=True)) for row in iterator):
            at, names, fs, n, k = files.join(task, name), None, 0.0, 0, 1
            with files.write(f"{at}.eeg") as data, files.write(f"{at}.vmrk") as marks:
                marks.write(b"Brain Vision Data Exchange Marker File, Version 1.0\n\n[Common Infos]\nCodepage=UTF-8\nDataFile=" + f"{name}.eeg\n\n[Marker Infos]\nMk1=New Segment,,1,1,0\n".encode())
                for first, rows in blocks:
                    own = [r["channel"] for r in rows]
                    names, fs = names or own, fs or rows[0]["sfreq"]
                    if own != names or first != n or any(r["sfreq"] != fs for r in rows) or len({len(r["samples"]) for r in rows}) > 1:
                        raise ValueError(f"{name}: the block at sample {first} doesn't go on with the channels, samples and rate of those before")
                    x = np.array([[np.nan if v is None else v for v in r["samples"]] for r in rows], "<f4")
                    data.write(np.ascontiguousarray(x.T).tobytes())
                    n += x.shape[1]
                    for kind, text, sample, length in rows[0].get("markers") or []:
                        k += 1
                        marks.write(f"Mk{k}={_text(kind)},{_text(text)},{sample + 1},{length or 1},0\n".encode())
            done.append((name, task, names, fs))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        every = [r for m in messages if m is not None for r in m.recordings]
        names = [r[0] for r in every]
        twice = sorted({x for x in names if names.count(x) > 1})
        there = [x for x in names if files.exists(files.join(self.folder, f"{x}.vhdr"))]
        if twice or there and not self.overwrite:
            files.delete(self.job)
            raise ValueError(f"recordings in several tasks: {twice}" if twice else f"recordings that are there already: {sorted(there)}")
        for name, task, channels, fs in every:
            for ending in ("eeg", "vmrk"):
                files.move(files.join(task, f"{name}.{ending}"), files.join(self.folder, f"{name}.{ending}"))
            with files.write(files.join(self.folder, f"{name}.vhdr")) as f:
                f.write(header_text(name, channels, fs).encode())
        files.delete(self.job)

    def abort(self, messages: list[Written | None]) -> None:
        files.delete(self.job)


def _text(x: str | None) -> str:
    return (x or "").replace(",", r"\1").replace("\n", " ")


def header_text(name: str, channels: list[str], fs: float) -> str:
    rows = "\n".join(f"Ch{i + 1}={_text(c)},,1,µV" for i, c in enumerate(channels))
    return (
        f"Brain Vision Data Exchange Header File Version 1.0\n\n[Common Infos]\nCodepage=UTF-8\nDataFile={name}.eeg\nMarkerFile={name}.vmrk\nDataFormat=BINARY\nDataOrientation=MULTIPLEXED\n"
        f"NumberOfChannels={len(channels)}\nSamplingInterval={1e6 / fs!r}\n\n[Binary Infos]\nBinaryFormat=IEEE_FLOAT_32\n\n[Channel Infos]\n{rows}\n"
    )


def _recordings(rows: Iterator[dict]) -> Iterator[tuple[str, Iterator[tuple[int, list[dict]]]]]:
    """Of rows in order: each recording with its blocks (first sample, the channels' rows), one block in memory."""
    ahead = next(rows, None)

    def blocks(name: str) -> Iterator[tuple[int, list[dict]]]:
        nonlocal ahead
        while ahead is not None and ahead["recording"] == name:
            first, block = ahead["first_sample"], []
            while ahead is not None and (ahead["recording"], ahead["first_sample"]) == (name, first):
                block.append(ahead)
                ahead = next(rows, None)
            yield first, block

    while ahead is not None:
        yield ahead["recording"], blocks(ahead["recording"])


class BrainVision(DataSource):
    @classmethod
    def name(cls) -> str:
        return "brainvision"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options, schema.names, overwrite or json.loads(str(self.options.get("replace", "false")).lower()))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BrainVision)


def write_recordings(df: DataFrame, folder: str, replace: bool = False) -> None:
    """A header, markers and samples for each recording of rows (recording, channel, ch_ord, sfreq, first_sample, samples), with ``markers`` of a block at its first channel, if they have them.

    Blocks follow each other without gaps and have all channels. ``replace``: recordings that are there already are written anew; else they fail the job.
    """
    register(df.sparkSession)
    rows = df.repartition("recording").sortWithinPartitions("recording", "first_sample", "ch_ord")
    rows.write.format("brainvision").mode("append").option("replace", str(replace).lower()).save(folder)
