"""Partitioning helpers shared by every pool-shaped operator.

A "pool" is all blocks of one user.  One user may own a third of all blocks, so
no operator may assume that a pool fits in a task.  Pools larger than
``rows_per_slice`` are cut into slices; the probing side (questions) is
replicated to exactly the slices its user has.  Users with one slice pay
nothing beyond the counting pass, which reads the key column only and combines
map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ROWS_PER_SLICE = 50_000
ROWS_PER_BATCH = 5_000


def slice_counts(df: DataFrame, key: Sequence[str], rows_per_slice: int, name: str = "n_slices") -> DataFrame:
    """Keys that need more than one slice.  Non-hot keys are absent, so the
    table stays small: at most ``rows / rows_per_slice`` keys."""
    return (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_slice)
        .select(*key, F.ceil(F.col("_n") / F.lit(rows_per_slice)).cast("int").alias(name))
    )


def slice_build_side(df: DataFrame, hot: DataFrame, key: Sequence[str], spread_by: Sequence[str], slice_col: str = "_slice",
                     n_col: str = "n_slices") -> DataFrame:
    """Give every row of the large side one slice number, by hash of ``spread_by``."""
    joined = df.join(hot, list(key), "left")
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.coalesce(F.col(n_col), F.lit(1)).cast("bigint"))
    return joined.withColumn(slice_col, salt.cast("int")).drop(n_col)


def slice_probe_side(df: DataFrame, hot: DataFrame, key: Sequence[str], slice_col: str = "_slice",
                     n_col: str = "n_slices") -> DataFrame:
    """Replicate every probing row to all slices of its key."""
    joined = df.join(hot, list(key), "left")
    return joined.withColumn(
        slice_col, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n_col), F.lit(1)) - 1))
    ).drop(n_col)


def pool_join(probe: DataFrame, build: DataFrame, key: Sequence[str] = ("user_id",), spread_by: Sequence[str] = ("block_id",),
              rows_per_slice: int = ROWS_PER_SLICE, batch_by: Sequence[str] = ("qa_idx",), rows_per_batch: int = ROWS_PER_BATCH) -> DataFrame:
    """Inner join question -> pool on ``key`` that stays balanced under hot keys.

    A hot key is tiled on both sides: its pool into slices, its questions into
    batches, one (slice, batch) tile per join key.  Each output pair appears once,
    since a row owns one slice or batch and is replicated along the other axis
    only.  The pairs are meant to be reduced in the same stage (count, top-k,
    filter).
    """
    hot = slice_counts(build, key, rows_per_slice)
    busy = slice_counts(probe, key, rows_per_batch, "n_batches")
    left = slice_probe_side(slice_build_side(probe, busy, key, batch_by, "_batch", "n_batches"), hot, key)
    right = slice_probe_side(slice_build_side(build, hot, key, spread_by), busy, key, "_batch", "n_batches")
    return left.join(right, [*key, "_slice", "_batch"]).drop("_slice", "_batch")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per key.  Spark plans a partial group limit before the
    shuffle, so each map task ships at most ``k`` rows per key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(window)).filter(F.col(rank_col) <= k)
