"""Table and JSON files as all-text tables with provenance, and result tables with a checked schema name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A .tsv (tabs) or .csv file: a header, every value a trimmed text, missing values empty texts."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    df = reader.option("sep", "\t" if ".tsv" in path else ",").csv(path)
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows with the file they come from and their place in it, from 0 on."""
    reader = spark.read.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("sep", "\t" if ".tsv" in path else ",")
    df = reader.csv(path)
    columns = df.columns
    # The id ascends along a file, whatever the splits; counting it within the file makes it dense.
    df = df.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_i"))
    df = df.withColumn("row_index", (F.row_number().over(Window.partitionBy("file").orderBy("_i")) - 1).cast("long"))
    return df.select("file", "row_index", *(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """The paths under a folder; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("length").alias("bytes"))


def read_result(spark: SparkSession, path: str, schema_name: str, version: str = "1.0") -> DataFrame:
    """A result table whose rows all carry this schema name and version; rows of another fail the query."""
    df = spark.read.parquet(path)
    right = (F.col("schema_name") == schema_name) & (F.col("schema_version") == version)
    return df.where(F.when(right, True).otherwise(F.raise_error(F.concat(F.lit(f"expected {schema_name} {version}, found "), F.coalesce("schema_name", F.lit("none")))).cast("boolean"))).drop("schema_name", "schema_version")


def resolve_events(annotations: DataFrame | None, events: DataFrame | None, source: str = "auto") -> tuple[DataFrame, str]:
    """The events to use and how exact their onsets are: a table's are exact, annotations' lie on samples. ``auto`` prefers the table."""
    if source not in ("auto", "events_tsv", "annotations"):
        raise ValueError(f"unknown source of events: {source}")
    if source != "annotations" and events is not None:
        return events, "exact_time"
    if source == "events_tsv" or annotations is None:
        raise ValueError("there is no table of events")
    return annotations, "sample_quantized"
