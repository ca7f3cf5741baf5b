"""From raw documents to token ids, in five stages, each written as Parquet and read again:

quality rules (rejected documents go), n-gram Jaccard join (one document of each group of near copies stays), benchmark decontamination
(documents with a benchmark passage go), secret scans (secrets are replaced) and byte-level BPE (ids, and what they decode to).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.llm._common import documents, stage
from voltaic.llm.bpe import round_trip
from voltaic.llm.decontamination import decontaminate
from voltaic.llm.jaccard import keep_one
from voltaic.llm.quality import keep_good
from voltaic.llm.secrets import redact

#: Near copies: a Jaccard similarity of so many hundredths or more of the shingles of so many words.
WORDS, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group stays."""
    return keep_one(docs, WORDS, PERCENT)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_free),
    ("secret_scans", secret_free),
    ("byte_level_bpe", tokens),
]
#: Similarity components and BPE can't be said in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = documents(spark, sf_dir)
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
