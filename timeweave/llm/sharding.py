"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters records uniformly by a seeded hash into buckets small enough for one task's memory; pass two permutes each
bucket and lays the buckets end to end.  That is one uniform order of all records, of which every shard is an equal stretch, so
shards hold numbers of rows at most one apart (law ``rows``).

Pass two is the permutation by sorted seeded keys, which has the law of a Fisher-Yates shuffle.  Spark's own array ``shuffle``
draws from a generator that depends on partition number and row order, so a task run again after a lost executor would give
another order; sorted keys always give the same one.  A bucket that is larger than memory is sorted on disk.

Defined results: the size is the UTF-8 bytes of the text, 0 for null, plus 8; copies of one text scatter by their ids; rows that
are equal in id and text are interchangeable and share a bucket; an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeweave.llm.store import written


@dataclass(frozen=True)
class Shuffle:
    """``bucket_bytes`` is what a bucket should hold, ``least_buckets`` a lower bound of their number."""

    shards: int = 24
    bucket_bytes: int = 64 << 20
    least_buckets: int = 192
    seed: int = 20
    broadcast_rows: int = 100_000


def sharded(docs: DataFrame, id_col: str = "doc_id", text: str = "text", options: Shuffle = Shuffle(), keep: list[str] | None = None) -> DataFrame:
    """(doc, size, text_crc32, bucket, shard, slot) per row; ``doc`` has the columns ``keep``, all by default."""
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    total, n = docs.agg(F.sum(size), F.count(F.lit(1))).first()
    buckets = max(options.least_buckets, -(-(total or 0) // options.bucket_bytes))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"), size.alias("size"), crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.lit(options.seed), id_col, text), F.lit(buckets)).alias("bucket"),
        F.xxhash64(F.lit(options.seed + 1), id_col, text).alias("key"), F.col(id_col).alias("id"),
    )
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select(F.col("bucket").alias("b"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")))
    offsets = F.broadcast(offsets) if buckets <= options.broadcast_rows else offsets
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("key", "id", "text_crc32"))
    placed = rows.withColumn("place", within - 1).join(offsets, F.col("bucket") == F.col("b")).withColumn("place", F.col("place") + F.col("offset"))
    n, shards = max(n, 1), options.shards
    placed = placed.withColumn("shard", F.expr(f"CAST(place * {shards}L DIV {n}L AS INT)"))
    start = F.expr(f"(shard * {n}L + {shards - 1}L) DIV {shards}L")
    return placed.select("doc", "size", "text_crc32", "bucket", "shard", (F.col("place") - start).alias("slot"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard; files hold whole buckets in slot order, so no task holds a whole shard."""
    ordered = placed.repartition("shard", "bucket").sortWithinPartitions("shard", "slot")
    ordered.select("doc.*", F.col("slot").alias("__slot"), F.col("shard").alias("__shard")).write.partitionBy("__shard").parquet(path)
