"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local master falls back to the context's own checkpoint folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir("/tmp/checkpoints")
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read back: later jobs start from the files, so an executor that
    is lost costs one task of the reader and random or partition-dependent columns keep their values."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
