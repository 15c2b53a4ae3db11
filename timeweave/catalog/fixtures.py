"""Blocks, questions and gold sets derived from the driver tables, in Spark and
as matching SQL common table expressions.  Every row of the source table is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.catalog.registry import table

DAY0 = "2024-01-01"


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """One block per vector: user = label, two date axes from the id."""
    v = F.col("vec_id").cast("int")
    day0 = F.lit(DAY0).cast("date")
    return (
        table(spark, d, "embeddings")
        .select(
            F.col("label").cast("string").alias("user_id"),
            F.col("vec_id").alias("block_id"),
            "embedding",
            F.date_add(day0, (v * 7) % 60).alias("session_start"),
        )
        .withColumn("session_end", F.date_add("session_start", (F.col("block_id") % 3).cast("int")))
        .withColumn("_e", F.date_sub("session_start", ((F.col("block_id") * 5) % 40).cast("int")))
        .withColumn("event_start", F.when(F.col("block_id") % 11 != 0, F.col("_e")))
        .withColumn("event_end", F.date_add("event_start", (F.col("block_id") % 4).cast("int")))
        .drop("_e")
    )


BLK = f"""blk AS (
  SELECT CAST(label AS VARCHAR) AS user_id, vec_id AS block_id, CAST(embedding AS DOUBLE[]) AS emb,
         DATE '{DAY0}' + CAST((vec_id * 7) % 60 AS INTEGER) AS session_start,
         DATE '{DAY0}' + CAST((vec_id * 7) % 60 AS INTEGER) + CAST(vec_id % 3 AS INTEGER) AS session_end,
         CASE WHEN vec_id % 11 <> 0 THEN DATE '{DAY0}' + CAST((vec_id * 7) % 60 AS INTEGER) - CAST((vec_id * 5) % 40 AS INTEGER) END AS event_start,
         CASE WHEN vec_id % 11 <> 0 THEN DATE '{DAY0}' + CAST((vec_id * 7) % 60 AS INTEGER) - CAST((vec_id * 5) % 40 AS INTEGER) + CAST(vec_id % 4 AS INTEGER) END AS event_end
  FROM embeddings)"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    """One question per vector with a constraint, an axis and an intent by id."""
    step = F.floor(F.col("vec_id") / 25).cast("bigint")
    pick = lambda names, m: F.element_at(F.array(*[F.lit(n) for n in names]), (step % m + 1).cast("int"))
    base = F.date_add(F.lit(DAY0).cast("date"), ((F.col("vec_id") * 3) % 60).cast("int"))
    return (
        table(spark, d, "embeddings")
        .select(
            F.col("label").cast("string").alias("user_id"),
            F.col("vec_id").alias("qa_idx"),
            "embedding",
            base.alias("base_day"),
            pick(["RANGE", "POINT", "AFTER", "BEFORE", "NONE"], 5).alias("tc_type"),
            pick(["EVENT", "SESSION", "BOTH_UNION", "BOTH_INTERSECT"], 4).alias("axis"),
            pick(["WINDOW", "AS_OF", "STATIC"], 3).alias("intent"),
        )
        .withColumn("tc_start", F.when(F.col("tc_type").isin("RANGE", "POINT", "AFTER"), F.col("base_day")))
        .withColumn(
            "tc_end",
            F.when(F.col("tc_type") == "RANGE", F.date_add("base_day", 6))
            .when(F.col("tc_type").isin("POINT", "BEFORE"), F.col("base_day")),
        )
    )


QRY = f"""qry AS (
  SELECT *, CASE WHEN tc_type IN ('RANGE','POINT','AFTER') THEN base_day END AS tc_start,
         CASE WHEN tc_type = 'RANGE' THEN base_day + 6 WHEN tc_type IN ('POINT','BEFORE') THEN base_day END AS tc_end
  FROM (SELECT CAST(label AS VARCHAR) AS user_id, vec_id AS qa_idx, CAST(embedding AS DOUBLE[]) AS qemb,
               DATE '{DAY0}' + CAST((vec_id * 3) % 60 AS INTEGER) AS base_day,
               (['RANGE','POINT','AFTER','BEFORE','NONE'])[1 + (vec_id // 25) % 5] AS tc_type,
               (['EVENT','SESSION','BOTH_UNION','BOTH_INTERSECT'])[1 + (vec_id // 25) % 4] AS axis,
               (['WINDOW','AS_OF','STATIC'])[1 + (vec_id // 25) % 3] AS intent
        FROM embeddings))"""


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Gold blocks of a question: blocks of the same user whose id is within 20 of the question's."""
    near = F.explode(F.sequence(F.col("qa_idx") - 20, F.col("qa_idx") + 20)).alias("block_id")
    q = questions(spark, d).select("user_id", "qa_idx", near)
    return q.join(blocks(spark, d).select("user_id", "block_id"), ["user_id", "block_id"]).select("user_id", "qa_idx", "block_id")


GOLD = """gold AS (SELECT q.user_id, q.qa_idx, b.block_id FROM qry q JOIN blk b
  ON q.user_id = b.user_id AND abs(q.qa_idx - b.block_id) <= 20)"""

#: Axis verdicts per pair, the SQL twin of the time predicates.
PAIRS = """pairs AS (SELECT q.*, b.block_id, b.emb, b.session_start, b.session_end, b.event_start, b.event_end,
    CASE WHEN tc_type = 'NONE' THEN TRUE WHEN b.event_start IS NULL THEN FALSE
         WHEN tc_type = 'RANGE' THEN b.event_start <= tc_end AND b.event_end >= tc_start
         WHEN tc_type = 'POINT' THEN b.event_start <= tc_start AND b.event_end >= tc_start
         WHEN tc_type = 'BEFORE' THEN b.event_end <= tc_end ELSE b.event_start >= tc_start END AS ok_event,
    CASE WHEN tc_type = 'NONE' THEN TRUE
         WHEN tc_type = 'RANGE' THEN b.session_start <= tc_end AND b.session_end >= tc_start
         WHEN tc_type = 'POINT' THEN b.session_start <= tc_start AND b.session_end >= tc_start
         WHEN tc_type = 'BEFORE' THEN b.session_end <= tc_end ELSE b.session_start >= tc_start END AS ok_session
  FROM qry q JOIN blk b ON q.user_id = b.user_id)"""

#: Pool sizes and the decided mode per question (empty-pool rule).
DECIDED = PAIRS + """,
  cnt AS (SELECT user_id, qa_idx, any_value(tc_type) AS tc_type, any_value(axis) AS axis, any_value(intent) AS intent,
    count(*) AS n_pool, count(*) FILTER (ok_event) AS n_event, count(*) FILTER (ok_session) AS n_session,
    count(*) FILTER (ok_event AND ok_session) AS n_intersect, count(*) FILTER (ok_event OR ok_session) AS n_union
    FROM pairs GROUP BY ALL),
  act AS (SELECT *, (intent IN ('STATIC','PLANNING') OR tc_type = 'NONE') AS skipped,
    CASE WHEN axis = 'BOTH_INTERSECT' AND n_intersect = 0 THEN 'BOTH_UNION' ELSE axis END AS mode FROM cnt),
  dec AS (SELECT *, CASE mode WHEN 'EVENT' THEN n_event WHEN 'SESSION' THEN n_session
    WHEN 'BOTH_INTERSECT' THEN n_intersect ELSE n_union END AS n FROM act)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SCORED = """scored AS (SELECT user_id, qa_idx, block_id,
  round(list_cosine_similarity(qemb, emb), 9) AS score FROM qry q JOIN blk b USING (user_id))"""
