"""Readers and writers exercised on files derived from the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from timeweave.catalog.building import CLEAN, conversation_json
from timeweave.catalog.fixtures import BLK, QRY, blocks, questions, with_sql
from timeweave.catalog.phrases import BASE
from timeweave.catalog.pools import TOP5
from timeweave.catalog.registry import query, table
from timeweave.functions import dates as dt
from timeweave.operators import blocks as bl
from timeweave.operators import rank
from timeweave.plans.annotate import inferred_axis
from timeweave.plans.annotate_old import annotate_old
from timeweave.session import shared_folder
from timeweave.sources import scans, sinks


def scratch(spark) -> str:
    """A new folder under the one that ``spark.checkpoint.dir`` names."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query(
    "a1_a2_conversation_files",
    f"SELECT CAST(conv_id AS VARCHAR) AS user_id, CAST(turn // 3 + 1 AS INTEGER) AS session_no, CAST(turn % 3 + 1 AS INTEGER) AS msg_idx, {CLEAN.format(x='text')} AS text FROM conversations",
)
def a1(spark, d):
    path = scratch(spark) + "/conversations"
    conversation_json(spark, d).withColumnRenamed("user_id", "sample_id").write.json(path)
    back = scans.read_conversations(spark, path, array_files=False)
    return bl.messages_from_session_keys(back.withColumn("user_id", F.col("sample_id"))).select("user_id", "session_no", "msg_idx", "text")


@query(
    "a3_a10_a12_block_log",
    with_sql(BLK) + "SELECT user_id, count(*) * 2 AS n, CAST(sum(block_id) * 2 AS BIGINT) AS ids FROM blk WHERE block_id % 10 <> 0 GROUP BY user_id",
)
def a3(spark, d):
    path = scratch(spark) + "/blocks"
    user = F.when(F.col("block_id") % 10 != 0, F.col("user_id"))
    rows = blocks(spark, d).select(user.alias("user_id"), F.when(F.col("block_id") % 2 == 0, F.col("block_id")).alias("block_id"), F.when(F.col("block_id") % 2 == 1, F.col("block_id")).alias("box_id"))
    sinks.append_jsonl(rows, path)
    sinks.append_jsonl(rows, path)
    return scans.read_blocks(spark, path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("block_id").alias("ids"))


@query(
    "a11_a13_ranking_csv",
    with_sql(BLK, QRY, TOP5)
    + "SELECT user_id, CAST(qa_idx AS VARCHAR) AS qa_idx, '[' || string_agg(CAST(block_id AS VARCHAR), ',' ORDER BY rank) || ']' AS ranking FROM ranked WHERE rank <= 5 GROUP BY ALL",
)
def a11(spark, d):
    path = scratch(spark) + "/ranking"
    ranked = rank.tiled_top_k(questions(spark, d), blocks(spark, d), 5)
    sinks.write_ranking_csv(ranked.limit(0), path)
    sinks.write_ranking_csv(ranked, path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query(
    "t34_date_expressions",
    """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders)
       SELECT k, CASE k % 8 WHEN 4 THEN CAST(date_trunc('month', day) AS DATE) WHEN 5 THEN CAST(date_trunc('month', day) AS DATE) WHEN 6 THEN make_date(year(day), 1, 1) WHEN 7 THEN NULL ELSE day END AS s,
         CASE k % 8 WHEN 4 THEN last_day(day) WHEN 5 THEN last_day(day) WHEN 6 THEN make_date(year(day), 12, 31) WHEN 7 THEN NULL ELSE day END AS e FROM o""",
)
def t34(spark, d):
    day = F.col("o_orderdate")
    forms = ["yyyy-MM-dd", "yyyy/M/d", "MMM. d, yyyy", "d MMMM,yyyy", "MMMM yyyy", "yyyy-MM", "yyyy"]
    texts = F.array(*[F.concat(F.lit(" "), F.date_format(day, f), F.lit(";")) for f in forms], F.lit("tomorrow"))
    span = dt.date_span(F.element_at(texts, (F.col("o_orderkey") % 8 + 1).cast("int")))
    return table(spark, d, "orders", spread=True).select(F.col("o_orderkey").alias("k"), span["start"].alias("s"), span["end"].alias("e"))


@query(
    "t40_axis_inference",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'SESSION' WHEN 1 THEN 'EVENT' WHEN 2 THEN 'BOTH_UNION' WHEN 3 THEN 'BOTH_UNION' ELSE 'NONE' END AS axis FROM orders""",
)
def t40(spark, d):
    k = F.col("o_orderkey")
    texts = ["When did I tell you about order ", "Where did I travel with order ", "I said we moved order ", "Which of these is order ", "I told you of order "]
    text = F.concat(F.element_at(F.array(*[F.lit(t) for t in texts]), (k % 5 + 1).cast("int")), k)
    kind = F.when(k % 5 == 4, "NONE").otherwise("ABSOLUTE")
    return table(spark, d, "orders").select("o_orderkey", inferred_axis(text, kind).alias("axis"))


@query(
    "t46_earlier_preset",
    f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)
       SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN day WHEN 1 THEN make_date(year(day), 1, 1) WHEN 2 THEN make_date(year(day), 5, 1) WHEN 3 THEN DATE '{BASE}' - 1 ELSE make_date(year(day), 1, 1) - 60 END AS tc_start,
         CASE o_orderkey % 5 WHEN 0 THEN day WHEN 1 THEN make_date(year(day), 12, 31) WHEN 2 THEN make_date(year(day), 8, 31) WHEN 3 THEN DATE '{BASE}' - 1 ELSE make_date(year(day), 12, 31) + 60 END AS tc_end,
         CASE o_orderkey % 5 WHEN 0 THEN 'AFTER' WHEN 1 THEN 'BEFORE' WHEN 2 THEN 'RANGE' WHEN 3 THEN 'POINT' ELSE 'RANGE' END AS tc_type FROM o""",
)
def t46(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    phrases = [
        F.concat(F.lit("after "), F.date_format(day, "MMMM d, yyyy")), F.concat(F.lit("before "), F.year(day)), F.concat(F.lit("mid "), F.year(day)),
        F.lit("yesterday"), F.concat(F.lit("around "), F.year(day)),
    ]
    q = table(spark, d, "orders", spread=True).select(
        "o_orderkey", F.concat(F.lit("What happened "), F.element_at(F.array(*phrases), (k % 5 + 1).cast("int")), F.lit("?")).alias("question"), F.lit(BASE).cast("date").alias("base_day")
    )
    return annotate_old(q).select("o_orderkey", F.col("tc.start").alias("tc_start"), F.col("tc.end").alias("tc_end"), F.col("tc.type").alias("tc_type"))


@query("a6_first_items", "SELECT o_custkey % 16 AS part, min(o_orderkey) AS o_orderkey, count(*) > 0 AS named FROM orders GROUP BY 1")
def a6_first(spark, d):
    """Files of many items each, in order of their key; the first item of each file comes back."""
    path = scratch(spark) + "/items"
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_custkey") % 16).alias("part"))
    rows.repartition("part").sortWithinPartitions("part", "o_orderkey").write.partitionBy("part").json(path)
    first = scans.read_first_items(spark, path, "o_custkey long, o_orderkey long")
    return first.select((F.col("o_custkey") % 16).alias("part"), "o_orderkey", F.col("source_id").startswith("part-").alias("named"))
