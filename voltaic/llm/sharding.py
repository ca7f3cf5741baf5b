"""Proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled within each source by a seeded hash and ranked; the fractional rank (rank - 1/2) / rows of the
source spreads every source evenly over (0, 1); all rows sorted by it are cut into shards of equal row counts
(law ``rows``), so that each shard has every source in its proportion.

No task ever ranks a whole source: rows are dealt into buckets by leading hash bits (then by fractional rank),
ranked inside a bucket, and the buckets' running counts are added.

Nulls: a null text has size 1 and crc32 0; null sources are one stratum; rows are hashed by id, size and crc32, also where the id is null.
Repeated rows are rows of their own. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, stage

#: Rows that a bucket has on average.
BUCKET = 4096


def _bucket(unit: Column, n: int) -> Column:
    """``unit``, in [0, 1), as one of n buckets."""
    return F.least(F.lit(n - 1), F.floor(unit * n)).cast("long")


def _ranked(df: DataFrame, keys: list[str], order: list[str], total: str | None = None) -> DataFrame:
    """``rank`` from 1, by bucket ``_b`` and then ``order``, within ``keys``; with the key's rows as ``total``."""
    counts = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*keys).orderBy("_b")
    # One row per bucket, 1/4096 of the rows, so even a hot source's running counts are few.
    before = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_kb"), (F.sum("_n").over(running) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"))
    same = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    out = local.join(before, same).withColumn("rank", F.col("_r") + F.col("_before"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_r", "_b", "_kb", "_before", "_total", *(f"_k{i}" for i in range(len(keys))))


def interleave(docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, shard and the gapless slot within it, a row per document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # Of the text too, so that null and repeated ids don't fill one bucket.
    rows = rows.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32"), 1))
    n = docs.count()
    n_buckets = max(1, n // BUCKET)
    unit = F.shiftright("_h", 10).cast("double") / float(1 << 53)
    first = _ranked(rows.withColumn("_b", _bucket(unit, n_buckets)), ["source"], ["_h", "doc_id", "text_crc32"], "_of")
    first = stage(first.withColumn("_f", (F.col("rank") - 0.5) / F.col("_of")).drop("rank", "_of"))
    second = _ranked(first.withColumns({"_b": _bucket(F.col("_f"), n_buckets), "_all": F.lit(0)}), ["_all"], ["_f", "source", "_h", "doc_id", "text_crc32"])
    at = F.col("rank") - 1
    # Cut k begins at ceil(k * n / shards): counts are at most one apart.
    second = second.withColumn("shard", F.expr(f"int((rank - 1) * {shards} DIV {max(n, 1)})"))
    start = F.expr(f"(shard * {n}L + {shards - 1}) DIV {shards}")
    return second.select("doc_id", "source", "size", "text_crc32", "shard", (at - start).cast("long").alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
