"""Interval joins planned as equi-joins on day buckets.

Spark has no range join.  Both sides are exploded to the buckets their interval
touches and joined on (key, bucket); a pair that shares several buckets is kept
only in the first shared one, so no ``distinct`` is needed.  The bucket in the
join key also splits a hot user over time, and a hot (key, bucket) is tiled on
both sides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of either side of a tile, and pairs that one task tries where the caller has them counted.
ROWS_PER_TILE = 4_096
PAIRS_PER_TASK = 1 << 24


def bucket_of(day: Column, days: int) -> Column:
    return F.floor(F.unix_date(day) / F.lit(days)).cast("int")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_iv: tuple[str, str],
    right_iv: tuple[str, str],
    keys: Sequence[str] = (),
    bucket_days: int = 30,
    clip: bool = False,
    rows_per_tile: int = ROWS_PER_TILE,
    pairs_per_task: int | None = None,
) -> DataFrame:
    """All pairs whose closed date intervals overlap, on equal ``keys`` if given.

    Rows with a missing bound are on no axis and drop out.  Intervals much
    longer than ``bucket_days`` touch many buckets: choose the bucket near the
    typical length of the longer side.  ``clip`` bounds the buckets of a row by
    the date range of the other side (a one-row aggregate), which keeps open-ended
    intervals small without changing the result.  A (key, bucket) with more than ``rows_per_tile`` rows on a side is cut into
    tiles of that many rows on both sides, so one key or one day may own most rows.  Rows of a key may be few bytes and many pairs:
    with ``pairs_per_task`` the pairs to try are counted first, at once, and the join gets as many tasks as they need.
    """

    def spread(df: DataFrame, iv: tuple[str, str], first: str, other: tuple[DataFrame, tuple[str, str]] | None) -> DataFrame:
        lo, hi = F.least(*iv), F.greatest(*iv)
        known = df.filter(F.col(iv[0]).isNotNull() & F.col(iv[1]).isNotNull())
        if other is not None:
            o_lo, o_hi = F.least(*other[1]), F.greatest(*other[1])
            span = other[0].agg(F.min(o_lo).alias("_o_lo"), F.max(o_hi).alias("_o_hi")).withColumn("_one", F.lit(1))
            known = known.withColumn("_one", F.lit(1)).join(F.broadcast(span), "_one").filter((lo <= F.col("_o_hi")) & (hi >= F.col("_o_lo")))
            lo, hi = F.greatest(lo, F.col("_o_lo")), F.least(hi, F.col("_o_hi"))
        return known.withColumn(first, bucket_of(lo, bucket_days)).withColumn(
            "_bucket", F.explode(F.sequence(F.col(first), bucket_of(hi, bucket_days)))
        ).drop("_one", "_o_lo", "_o_hi")

    a = spread(left, left_iv, "_first_l", (right, right_iv) if clip else None)
    b = spread(right, right_iv, "_first_r", (left, left_iv) if clip else None)
    at = [*keys, "_bucket"]
    own_l, own_r = ([c for c in df.columns if c not in at] for df in (a, b))
    # rows of both sides in one counting pass; only (key, bucket)s that need tiles are kept
    sides = a.select(*at, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionAll(b.select(*at, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    met = sides.groupBy(*at).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    hot = met.filter(F.greatest("_l", "_r") > rows_per_tile)
    n_tiles = lambda side: F.ceil(F.col(side) / rows_per_tile).cast("int").alias(f"_n{side}")
    hot = hot.select(*at, n_tiles("_l"), n_tiles("_r"))

    def tiled(df: DataFrame, own: list[str], mine: str, other: str) -> DataFrame:
        n = lambda c: F.coalesce(F.col(f"_n{c}"), F.lit(1))
        placed = df.join(hot, at, "left").withColumn(f"_t{mine}", F.pmod(F.xxhash64(*[F.col(c) for c in own]), F.greatest(n(mine), F.lit(1))).cast("int"))
        return placed.withColumn(f"_t{other}", F.explode(F.sequence(F.lit(0), F.greatest(n(other), F.lit(1)) - 1))).drop("_n_l", "_n_r")

    l, r, tile = tiled(a, own_l, "_l", "_r"), tiled(b, own_r, "_r", "_l"), [*at, "_t_l", "_t_r"]
    if pairs_per_task is not None:
        pairs = met.agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0
        tasks = max(left.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / pairs_per_task))
        l, r = l.repartition(tasks, *tile), r.repartition(tasks, *tile)
    joined = l.join(r, tile).drop("_t_l", "_t_r")
    first_shared = F.col("_bucket") == F.greatest("_first_l", "_first_r")
    lo_l, hi_l = F.least(*left_iv), F.greatest(*left_iv)
    lo_r, hi_r = F.least(*right_iv), F.greatest(*right_iv)
    return joined.filter(first_shared & (lo_l <= hi_r) & (hi_l >= lo_r)).drop("_bucket", "_first_l", "_first_r")


def open_counts(points: DataFrame, day: str, intervals: DataFrame, iv: tuple[str, str], keys: Sequence[str] = (), name: str = "n_open") -> DataFrame:
    """``points`` with the number of closed intervals of equal ``keys`` that hold their day, without pairing the two.

    Starts count +1 and the days after ends -1; the running sum over the distinct days of a key is the answer, so the window
    sees calendar days, not rows.  Intervals with a missing bound are left out, points without a day too.
    """
    lo, hi = F.least(*iv), F.greatest(*iv)
    known = intervals.filter(F.col(iv[0]).isNotNull() & F.col(iv[1]).isNotNull())
    steps = known.select(*keys, lo.alias("_day"), F.lit(1).alias("_step")).unionAll(known.select(*keys, F.date_add(hi, 1).alias("_day"), F.lit(-1).alias("_step")))
    asked = points.select(*keys, F.col(day).alias("_day"), F.lit(0).alias("_step")).filter("_day is not null")
    per_day = steps.unionAll(asked).groupBy(*keys, "_day").agg(F.sum("_step").alias("_step"))
    so_far = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = per_day.select(*keys, "_day", F.sum("_step").over(so_far).alias(name))
    return points.withColumn("_day", F.col(day)).join(running, [*keys, "_day"]).drop("_day")
