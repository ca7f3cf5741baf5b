"""Event rates over a stream, for recordings that are still running."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_rates(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Events and mean value by window and type. On a stream, windows are final once the watermark has passed them; state is a row per open window and type."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), kind, "n", "mean")


def read_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(like.schema).parquet(path)


def run_once(df: DataFrame, path: str, checkpoint: str) -> None:
    """All that there is now, in as many batches as needed, appended to ``path``; a later call takes up what came since, each row once."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
