"""From question text to ranked blocks: every stage of retrieval in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.catalog.fixtures import BLK, QRY, blocks, questions, with_sql
from timeweave.catalog.graph import FINE, SCORED, event_vectors
from timeweave.catalog.registry import dealt, query, table
from timeweave.functions.text import content_key
from timeweave.plans.retrieval import answer_context, retrieve

KEY = ["user_id", "qa_idx"]

# one question per order, in seven forms; the vector of "text" k is that of vector k + 7, found by the rewritten text
ASKED = """ask AS (SELECT o_orderkey AS k, DATE '2024-01-01' + CAST(o_orderkey % 60 AS INTEGER) AS base_day, CAST(o_orderkey % 7 AS INTEGER) AS form FROM orders),
  size AS (SELECT count(*) AS n FROM embeddings),
  qry AS (SELECT CAST(e.label AS VARCHAR) AS user_id, k AS qa_idx, CAST(r.embedding AS DOUBLE[]) AS qemb, base_day, form
          FROM ask CROSS JOIN size JOIN embeddings e ON e.vec_id = k % n JOIN embeddings r ON r.vec_id = (k + 7) % n)"""
SCORED_ONCE = SCORED.replace("scored AS (", "scored AS MATERIALIZED (", 1)
CONSTRAINED = """w AS (SELECT c.user_id, c.qa_idx, min(event_end) AS e0 FROM cand c JOIN okk USING (user_id, qa_idx) JOIN blk b ON b.user_id = c.user_id AND b.block_id = c.block_id
      WHERE accepted AND c.score > 0.4 AND event_start IS NOT NULL GROUP BY ALL),
  con AS (SELECT q.user_id, q.qa_idx,
      CASE form WHEN 0 THEN 'POINT' WHEN 1 THEN 'RANGE' WHEN 2 THEN 'AFTER' WHEN 3 THEN 'BEFORE' WHEN 4 THEN 'POINT' WHEN 5 THEN 'RANGE' ELSE CASE WHEN e0 IS NULL THEN 'NONE' ELSE 'AFTER' END END AS kind,
      CASE form WHEN 0 THEN base_day WHEN 1 THEN DATE '2024-01-01' WHEN 2 THEN base_day + 1 WHEN 4 THEN base_day - 1 WHEN 5 THEN DATE '2024-01-05' WHEN 6 THEN e0 END AS s,
      CASE form WHEN 1 THEN DATE '2024-01-31' WHEN 3 THEN base_day - 1 WHEN 5 THEN base_day + 5 END AS e,
      CASE form WHEN 1 THEN 'SESSION' WHEN 3 THEN 'BOTH_UNION' WHEN 4 THEN 'SESSION' ELSE 'EVENT' END AS axis
    FROM qry q LEFT JOIN w ON form = 6 AND w.user_id = q.user_id AND w.qa_idx = q.qa_idx),
  seen AS (SELECT c.user_id, c.qa_idx, b.block_id, axis, kind,
      CASE kind WHEN 'NONE' THEN TRUE WHEN 'POINT' THEN event_start <= s AND event_end >= s WHEN 'RANGE' THEN event_start <= e AND event_end >= s WHEN 'AFTER' THEN event_start >= s ELSE event_end <= e END AS ev,
      CASE kind WHEN 'NONE' THEN TRUE WHEN 'POINT' THEN session_start <= s AND session_end >= s WHEN 'RANGE' THEN session_start <= e AND session_end >= s WHEN 'AFTER' THEN session_start >= s ELSE session_end <= e END AS ss
    FROM con c JOIN blk b USING (user_id)),
  kept AS (SELECT user_id, qa_idx, block_id, CASE axis WHEN 'EVENT' THEN coalesce(ev, FALSE) WHEN 'SESSION' THEN ss ELSE coalesce(ev, FALSE) OR ss END AS ok FROM seen),
  pool AS (SELECT user_id, qa_idx, block_id, ok, bool_or(ok) OVER (PARTITION BY user_id, qa_idx) AS any_ok FROM kept),
  top AS (SELECT user_id, qa_idx, block_id, score, CAST(row_number() OVER (PARTITION BY user_id, qa_idx ORDER BY score DESC, block_id) AS INTEGER) AS rank
          FROM pool JOIN scored USING (user_id, qa_idx, block_id) WHERE ok OR NOT any_ok)"""


@query(
    "e2_question_text_to_blocks",
    with_sql(BLK, ASKED, SCORED_ONCE, FINE, CONSTRAINED) + "SELECT user_id, qa_idx, block_id, score, rank FROM top WHERE rank <= 5",
)
def e2(spark, d):
    vectors = table(spark, d, "embeddings")
    size = vectors.agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey").withColumn("_one", F.lit(1)).join(size, "_one")
    o = o.withColumn("base_day", F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int"))).withColumn("vec_id", k % F.col("n")).withColumn("other", (k + 7) % F.col("n"))
    day = F.col("base_day").cast("string")
    about = F.concat(F.lit("What happened to order "), k.cast("string"))
    said = F.concat(F.lit("What did we say of order "), k.cast("string"))
    forms = [
        F.concat(about, F.lit(" on "), day), F.concat(said, F.lit(" in January 2024?")), F.concat(about, F.lit(" after "), day, F.lit("?")),
        F.concat(F.lit("Who got order "), k.cast("string"), F.lit(" before "), day, F.lit("?")), F.concat(said, F.lit(" yesterday?")),
        F.concat(about, F.lit(" between 2024-01-05 and "), F.date_add("base_day", 5).cast("string"), F.lit("?")), F.concat(about, F.lit(" after I graduated?")),
    ]
    stems = [about, said, about, F.concat(F.lit("Who got order "), k.cast("string")), said, about, about]
    pick = lambda xs: F.element_at(F.array(*xs), (k % 7 + 1).cast("int"))
    asked = o.join(vectors.select("vec_id", F.col("label").cast("string").alias("user_id")), "vec_id").select(
        "user_id", k.alias("qa_idx"), pick(forms).alias("question"), "base_day", "other", pick(stems).alias("stem")
    )
    known = asked.join(vectors.select(F.col("vec_id").alias("other"), "embedding"), "other").select("user_id", content_key(F.col("stem")).alias("text_key"), "embedding")
    told = dealt(asked.select(*KEY, "question", "base_day"), table(spark, d, "orders").count())
    out = answer_context(told, blocks(spark, d), event_vectors(spark, d), known)
    return out.select(*KEY, "block_id", "score", "rank")


# constraints widened by intent, every fifth question in a category that is never filtered
WIDE = QRY.replace("qry AS (", "narrow AS (", 1) + """, qry AS (SELECT * REPLACE (
    CASE WHEN qa_idx % 5 = 0 THEN 'NONE' WHEN tc_type IN ('RANGE', 'POINT') THEN 'RANGE' ELSE tc_type END AS tc_type,
    CASE WHEN tc_type <> 'BEFORE' THEN tc_start - days END AS tc_start, CASE WHEN tc_type <> 'AFTER' THEN coalesce(tc_end, tc_start) + days END AS tc_end)
  FROM (SELECT *, CASE intent WHEN 'WINDOW' THEN 365 WHEN 'AS_OF' THEN 180 ELSE 1500 END AS days FROM narrow))"""


@query(
    "e3_retrieve_with_buffers",
    with_sql(BLK, WIDE, SCORED)
    + """, seen AS (SELECT q.user_id, q.qa_idx, b.block_id, q.axis, (intent = 'STATIC' OR tc_type = 'NONE') AS open,
        coalesce(CASE tc_type WHEN 'RANGE' THEN event_start <= tc_end AND event_end >= tc_start WHEN 'BEFORE' THEN event_end <= tc_end ELSE event_start >= tc_start END, FALSE) AS ev,
        coalesce(CASE tc_type WHEN 'RANGE' THEN session_start <= tc_end AND session_end >= tc_start WHEN 'BEFORE' THEN session_end <= tc_end ELSE session_start >= tc_start END, FALSE) AS ss
        FROM qry q JOIN blk b USING (user_id)),
      kept AS (SELECT user_id, qa_idx, block_id, open OR CASE axis WHEN 'EVENT' THEN ev WHEN 'SESSION' THEN ss WHEN 'BOTH_INTERSECT' THEN ev AND ss ELSE ev OR ss END AS ok FROM seen),
      top AS (SELECT user_id, qa_idx, block_id, score, CAST(row_number() OVER (PARTITION BY user_id, qa_idx ORDER BY score DESC, block_id) AS INTEGER) AS rank
        FROM kept JOIN scored USING (user_id, qa_idx, block_id) WHERE ok)
      SELECT user_id, qa_idx, block_id, score, rank FROM top WHERE rank <= 5""",
)
def e3(spark, d):
    q = questions(spark, d).withColumn("category", F.when(F.col("qa_idx") % 5 == 0, "Memory Conflict").otherwise("Other"))
    out = retrieve(q, blocks(spark, d), buffer=True, bypass=("Memory Conflict",))
    return out.select(*KEY, "block_id", "score", "rank")
