"""Numbers of rows in a sort order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.llm.store import written

#: The bits below the partition number of ``monotonically_increasing_id``.
ROW_BITS = 33


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """``df`` with its rows numbered from 0 by ``order``, stored in the shared folder.

    Rows are dealt by ranges and sorted; a row's number is its place in its range plus the rows of the ranges before, of which
    there is one each.  Rows that are equal in ``order`` share a range, which is sorted on disk where it exceeds memory."""
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__range", F.shiftright("__at", ROW_BITS))
    counts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    number = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return placed.join(offsets, "__range").select(*[F.col(f"`{c}`") for c in df.columns], number.alias(name))
