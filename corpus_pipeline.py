"""A corpus pipeline of five stages, each applying one operator of ``timeweave.llm`` to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm.decontam import drop_contaminated
from timeweave.llm.mixing import mixed_rows
from timeweave.llm.neardup import drop_near_duplicates
from timeweave.llm.quality import filter_quality
from timeweave.llm.sharding import sharded
from timeweave.llm.store import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and the ratio fitted on this stage's own input."""
    return filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    return drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix draws it."""
    return mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot."""
    return sharded(docs).select("doc.*", F.col("shard"), F.col("slot"))


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Order MinHash, the hashed n-gram ratio and the index are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with each stage's rows stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
