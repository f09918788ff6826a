"""From raw documents to token ids, each stage on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikelab.llm import bpe, decontam, jaccard, surrogates, toxicity
from strikelab.llm.common import stored


#: Bytes of a batch between Spark and Python at most: texts are long, and several batches of a task are held at a time.
ARROW_BYTES = 16 << 20


def bounded(stage):
    """The stage with small Arrow batches: a setting that the session keeps, as the stage's rows are made when they are written."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; odd rows as in toxicity.without_toxic."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, 0.8; odd rows as in jaccard.keep_one."""
    return jaccard.keep_one(docs, 5, 80)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words on end of a benchmark item go; odd rows as in decontam.without_benchmark."""
    return decontam.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_replaced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates; n_chars follows the new text. All rows and other columns stay; null and empty texts too."""
    name = "_entities"
    while name in docs.columns:
        name += "_"
    out = surrogates.surrogates(docs, "a secret of the caller", name=name).drop(name)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids of each text, ready for training: a row for each row, null texts as empty ones."""
    out = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", bounded(toxic_out)),
    ("near_duplicates", bounded(near_copies_out)),
    ("decontamination", bounded(benchmark_out)),
    ("pii", bounded(pii_replaced)),
    ("bpe", bounded(encoded)),
]

#: A learned model, a join by components and tokenizers: tests/llm/test_pipeline.py compares each stage with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
