"""Interval joins on order histories: [order date, last ship date] per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.catalog.fixtures import BLK, QRY, blocks, questions, with_sql
from timeweave.catalog.registry import query, table
from timeweave.operators import temporal as tp
from timeweave.operators.intervals import PAIRS_PER_TASK, open_counts, overlap_join

IV = """iv AS (SELECT o_custkey, o_orderkey, least(a, b) AS iv_start, greatest(a, b) AS iv_end FROM (
  SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL))"""


def order_intervals(spark, d):
    last_ship = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").cast("date").alias("_ship")
    )
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("_day"))
    lo, hi = tp.repaired(F.col("_day"), F.col("_ship"))
    return orders.join(last_ship, "o_orderkey").select("o_custkey", "o_orderkey", lo.alias("iv_start"), hi.alias("iv_end"))


@query(
    "c9_result_order",
    with_sql(IV)
    + "SELECT o_custkey, o_orderkey, iv_start, iv_end, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY iv_start, iv_end, o_orderkey) AS INTEGER) AS pos FROM iv",
)
def c9(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("iv_start", "iv_end", "o_orderkey")
    return order_intervals(spark, d).withColumn("pos", F.row_number().over(w)).orderBy("o_custkey", "pos")


@query(
    "j2_interval_join",
    with_sql(BLK, QRY)
    + """SELECT q.user_id, q.qa_idx, b.block_id FROM qry q JOIN blk b ON q.user_id = b.user_id
         AND b.event_start <= q.base_day + 6 AND b.event_end >= q.base_day""",
)
def j2(spark, d):
    q = questions(spark, d).select("user_id", "qa_idx", "base_day", F.date_add("base_day", 6).alias("q_end"))
    b = blocks(spark, d).select("user_id", "block_id", "event_start", "event_end")
    pairs = overlap_join(q, b, ("base_day", "q_end"), ("event_start", "event_end"), ["user_id"], 14, pairs_per_task=PAIRS_PER_TASK)
    return pairs.select("user_id", "qa_idx", "block_id")


@query(
    "j2_order_overlap_pairs",
    with_sql(IV)
    + """SELECT a.o_custkey, count(*) AS n_pairs, max(least(a.iv_end, b.iv_end)) AS last_common_day FROM iv a JOIN iv b
         ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.iv_start <= b.iv_end AND a.iv_end >= b.iv_start GROUP BY a.o_custkey""",
)
def j2_orders(spark, d):
    a = order_intervals(spark, d)
    b = a.select("o_custkey", F.col("o_orderkey").alias("k2"), F.col("iv_start").alias("s2"), F.col("iv_end").alias("e2"))
    pairs = overlap_join(a, b, ("iv_start", "iv_end"), ("s2", "e2"), ["o_custkey"], 365).filter("o_orderkey < k2")
    return pairs.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.max(F.least("iv_end", "e2")).alias("last_common_day")
    )


@query(
    "j2_days_without_key",
    with_sql(IV)
    + """, days AS (SELECT CAST(ts AS DATE) - 9000 + CAST(event_id % 8000 AS INTEGER) AS day, event_id FROM events)
       SELECT d.event_id, count(*) AS open_orders FROM days d JOIN iv ON iv.iv_start <= d.day AND iv.iv_end >= d.day GROUP BY d.event_id""",
)
def j2_no_key(spark, d):
    ev = table(spark, d, "events").select(
        "event_id",
        F.date_add(F.date_sub(F.col("ts").cast("date"), 9000), (F.col("event_id") % 8000).cast("int")).alias("day"),
    )
    counted = open_counts(ev, "day", order_intervals(spark, d), ("iv_start", "iv_end"), name="open_orders")
    return counted.filter("open_orders > 0").select("event_id", "open_orders")
