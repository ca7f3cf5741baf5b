"""A dataset's files as a Spark data source, and tables of what they hold.

``spark.read.format("dataset").load(root)``: a row per file, with its scope (``raw``, or the name of a folder under ``derivatives``) and entities. A task lists one subject's folder. With
``spark.sql.python.filterPushdown.enabled``, filters on ``sub`` and ``scope`` choose the folders before any is listed. Option ``derivatives``: false leaves them out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..operators.catalog import ALIASES
from . import brainvision, files, tables

SCHEMA = "path string, scope string, sub string, ses string, datatype string, suffix string, extension string, entities map<string,string>, bytes bigint"
RAW, DERIVATIVES = "raw", "derivatives"
#: How files are read, by extension.
Loader = Callable[[SparkSession, str], DataFrame]


def _signals(spark: SparkSession, path: str) -> DataFrame:
    brainvision.register(spark)
    return spark.read.format("brainvision").load(path)


LOADERS: dict[str, Loader] = {".vhdr": _signals, ".tsv": tables.read_table, ".csv": tables.read_table, ".json": tables.read_json}


def loader_of(path: str, more: dict[str, Loader] | None = None) -> Loader:
    """The loader of a path's extension; ``more`` adds to the known ones or replaces them."""
    name = files.name_of(path)
    known = {**LOADERS, **(more or {})}
    ending = name[name.index(".") :] if "." in name else ""
    if ending not in known:
        raise ValueError(f"no loader for {ending or 'files without an extension'}: {name}")
    return known[ending]


def load(spark: SparkSession, path: str, more: dict[str, Loader] | None = None) -> DataFrame:
    return loader_of(path, more)(spark, path)


def name_parts(name: str) -> tuple[dict[str, str], str | None, str]:
    """Entities (short names, the first of a key counts), suffix and extension of a file's name."""
    stem, dot, rest = name.partition(".")
    found: dict[str, str] = {}
    for part in stem.split("_"):
        key, dash, value = part.partition("-")
        if dash:
            found.setdefault(ALIASES.get(key, key), value)
    last = stem.rsplit("_", 1)[-1]
    return found, None if "-" in last else last, dot + rest


class Folder(InputPartition):
    def __init__(self, path: str, scope: str, sub: str | None) -> None:
        self.path, self.scope, self.sub = path, scope, sub


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].rstrip("/")
        self.derivatives = str(options.get("derivatives", "true")).lower() != "false"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - Spark's name
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("sub",), ("scope",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                at = f.attribute[0]
                self.wanted[at] = self.wanted.get(at, values) & values
            # Spark looks at every row again: a name's entities may say otherwise than its folder.
            yield f

    def _may(self, what: str, value: str) -> bool:
        return what not in self.wanted or value in self.wanted[what]

    def partitions(self) -> list[InputPartition]:
        """Folders of subjects, and what lies beside them as one more of each scope."""
        scopes = [(RAW, self.root)] if self._may("scope", RAW) else []
        if self.derivatives and self.wanted.get("scope") != {RAW}:
            base = files.join(self.root, DERIVATIVES)
            scopes += [(n, files.join(base, n)) for n, folder, _ in files.children(base) if folder and self._may("scope", n)]
        out: list[InputPartition] = []
        for scope, path in scopes:
            for name, folder, _ in files.children(path):
                if folder and (m := re.fullmatch(r"sub-(.+)", name)) and self._may("sub", m[1]):
                    out.append(Folder(files.join(path, name), scope, m[1]))
            if "sub" not in self.wanted:
                out.append(Folder(path, scope, None))
        return out

    def read(self, partition: Folder) -> Iterator[tuple]:
        if partition.sub is not None:
            found = files.walk(partition.path)
        else:
            found = [(files.join(partition.path, n), size) for n, folder, size in files.children(partition.path) if not folder]
            others = [n for n, folder, _ in files.children(partition.path) if folder and not n.startswith("sub-") and not (partition.scope == RAW and n == DERIVATIVES)]
            found += [f for n in others for f in files.walk(files.join(partition.path, n))]
        for path, size in found:
            entities, suffix, extension = name_parts(files.name_of(path))
            yield path, partition.scope, entities.get("sub"), entities.get("ses"), files.name_of(files.parent(path)), suffix, extension, entities, size


class Dataset(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dataset"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


def scan(spark: SparkSession, root: str, derivatives: bool = True) -> DataFrame:
    """The files of a dataset, none of them opened; filters on ``sub`` and ``scope`` choose the folders that are listed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Dataset)
    return spark.read.format("dataset").option("derivatives", str(derivatives).lower()).load(root)


def time_frequency_file(catalog: DataFrame, endings: tuple[str, ...] = (".h5", ".hdf5", ".mat", ".parquet")) -> DataFrame:
    """Of each (scope, sub, ses) the file of time-frequency results: the first by path with the suffix ``tfr``, else the first with one of the endings."""
    from pyspark.sql import functions as F

    rank = F.struct((F.col("suffix") != "tfr") | F.col("suffix").isNull(), "path")
    some = catalog.where((F.col("suffix") == "tfr") | F.col("extension").isin(*endings))
    return some.groupBy("scope", "sub", "ses").agg(F.min(rank).alias("_r")).select("scope", "sub", "ses", F.col("_r.path").alias("path"))
