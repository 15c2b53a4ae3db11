"""Writers: JSON lines, CSV rankings, pruned block tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.operators.skew import slice_build_side, slice_counts


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows; parallel tasks write their own part files, so no merge step."""
    df.write.mode("append").json(path)


def overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def write_blocks(df: DataFrame, path: str, buckets: int = 256, mode: str = "append", rows_per_task: int = 1_000_000) -> None:
    """Blocks laid out by a hash of the user, so that reads of a few users prune
    files.  A bucket column keeps the folder count fixed however many users exist;
    buckets beyond ``rows_per_task`` (a hot user) are written by several tasks."""
    spread = df.withColumn("user_bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))
    hot = slice_counts(spread, ["user_bucket"], rows_per_task)
    sliced = slice_build_side(spread, hot, ["user_bucket"], ["block_id"])
    sliced.repartition("user_bucket", "_slice").drop("_slice").write.mode(mode).partitionBy("user_bucket").parquet(path)


def ranking_rows(ranked: DataFrame) -> DataFrame:
    """Long ranking -> one row per question with ids in rank order (top-k sized)."""
    pairs = F.sort_array(F.collect_list(F.struct("rank", "block_id")))
    return ranked.groupBy("user_id", "qa_idx").agg(F.transform(pairs, lambda p: p["block_id"]).alias("ranking"))


def write_ranking_csv(ranked: DataFrame, path: str) -> None:
    """CSV with a header; the ranking list is written as JSON text."""
    rows = ranking_rows(ranked).withColumn("ranking", F.to_json("ranking"))
    rows.write.mode("overwrite").option("header", True).csv(path)
