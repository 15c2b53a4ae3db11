"""Time predicates, pool fallbacks, set operations and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.catalog.fixtures import BLK, DECIDED, GOLD, PAIRS, QRY, SCORED, blocks, gold, questions, with_sql
from timeweave.catalog.registry import query
from timeweave.operators import pools, rank
from timeweave.operators import temporal as tp
from timeweave.plans.retrieval import retrieve

PAIR_COLS = ["user_id", "qa_idx", "block_id"]


def _typed(spark, d, kind):
    """Questions turned into one constraint type, over the whole tables."""
    q = questions(spark, d).withColumn("tc_type", F.lit(kind)).withColumn("tc_start", F.col("base_day"))
    end = F.date_add("base_day", 6) if kind == "RANGE" else F.lit(None).cast("date")
    return q.withColumn("tc_end", end)


def _counts(spark, d, kind):
    """Matches per question and axis for one constraint type."""
    return pools.with_pool_counts(_typed(spark, d, kind), blocks(spark, d), joint=False, ordered=True).select("user_id", "qa_idx", "n_event", "n_session")


def _count_sql(cond: str) -> str:
    def on(axis):
        c = cond.format(s=f"b.{axis}_start", e=f"b.{axis}_end")
        return f"count(*) FILTER (b.{axis}_start IS NOT NULL AND {c})"

    return with_sql(BLK, QRY) + (
        f"SELECT q.user_id, q.qa_idx, {on('event')} AS n_event, {on('session')} AS n_session "
        "FROM qry q JOIN blk b USING (user_id) GROUP BY ALL"
    )


@query("c1_range_overlap", _count_sql("{s} <= q.base_day + 6 AND {e} >= q.base_day"))
def c1(spark, d):
    return _counts(spark, d, "RANGE")


@query("c2_range_open_end", _count_sql("{e} >= q.base_day"))
def c2(spark, d):
    q = _typed(spark, d, "RANGE").withColumn("tc_end", F.lit(None).cast("date"))
    return pools.with_pool_counts(q, blocks(spark, d), joint=False, ordered=True).select("user_id", "qa_idx", "n_event", "n_session")


@query("c3_point", _count_sql("{s} <= q.base_day AND {e} >= q.base_day"))
def c3(spark, d):
    return _counts(spark, d, "POINT")


@query("c4_before_cutoff", _count_sql("{e} <= q.base_day"))
def c4(spark, d):
    return _counts(spark, d, "BEFORE")


@query("c5_after_start", _count_sql("{s} >= q.base_day"))
def c5(spark, d):
    return _counts(spark, d, "AFTER")


@query(
    "c6_unfiltered",
    with_sql(BLK, QRY)
    + "SELECT q.user_id, q.qa_idx, count(*) AS n_event, count(*) AS n_session FROM qry q JOIN blk b USING (user_id) GROUP BY ALL",
)
def c6(spark, d):
    return _counts(spark, d, "NONE")


@query(
    "c7_inverted_repair",
    """WITH iv AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b
         FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
       SELECT o_custkey, o_orderkey, least(a, b) AS iv_start, greatest(a, b) AS iv_end FROM iv""",
)
def c7(spark, d):
    from timeweave.catalog.intervals import order_intervals

    return order_intervals(spark, d).select("o_custkey", "o_orderkey", "iv_start", "iv_end")


@query(
    "c8_axis_membership",
    with_sql(BLK) + "SELECT user_id, count(*) FILTER (event_start IS NOT NULL AND event_end IS NOT NULL) AS on_event, "
    "count(*) FILTER (session_start IS NOT NULL AND session_end IS NOT NULL) AS on_session FROM blk GROUP BY user_id",
)
def c8(spark, d):
    return blocks(spark, d).groupBy("user_id").agg(
        F.count_if(tp.on_axis(F.col("event_start"), F.col("event_end"))).alias("on_event"),
        F.count_if(tp.on_axis(F.col("session_start"), F.col("session_end"))).alias("on_session"),
    )


@query(
    "c10_axis_dispatch",
    with_sql(BLK, QRY, PAIRS)
    + """SELECT user_id, qa_idx, count(*) FILTER (CASE axis WHEN 'EVENT' THEN ok_event WHEN 'SESSION' THEN ok_session
         WHEN 'BOTH_INTERSECT' THEN ok_event AND ok_session ELSE ok_event OR ok_session END) AS n FROM pairs GROUP BY ALL""",
)
def c10(spark, d):
    q = pools.with_pool_counts(questions(spark, d), blocks(spark, d))
    return q.select("user_id", "qa_idx", pools.size_on(F.col("axis")).alias("n"))


@query(
    "c11_intersect_degrade",
    with_sql(BLK, QRY, DECIDED)
    + """SELECT user_id, qa_idx, CASE WHEN skipped THEN 'FULL' WHEN axis = 'BOTH_INTERSECT' AND n_intersect = 0
         THEN 'BOTH_INTERSECT_DEGRADED_UNION' ELSE mode END AS pool_label, n_intersect, n_union FROM dec""",
)
def c11(spark, d):
    return pools.decide_pool(questions(spark, d), blocks(spark, d)).select(
        "user_id", "qa_idx", "pool_label", "n_intersect", "n_union"
    )


@query(
    "c12_event_first",
    with_sql(BLK, QRY, DECIDED)
    + """SELECT user_id, qa_idx, CASE WHEN skipped OR greatest(n_event, n_session) = 0 THEN 'FULL'
           WHEN n_event > 0 THEN 'EVENT' WHEN n_session > 0 THEN 'SESSION' ELSE 'FULL' END AS pool_mode,
         CASE WHEN skipped THEN n_pool WHEN n_event > 0 THEN n_event WHEN n_session > 0 THEN n_session ELSE n_pool END AS pool_size
         FROM dec""",
)
def c12(spark, d):
    return pools.decide_pool(questions(spark, d), blocks(spark, d), rule="event_first").select(
        "user_id", "qa_idx", "pool_mode", "pool_size"
    )


@query(
    "c13_axis_override",
    with_sql(BLK, QRY, DECIDED)
    + """SELECT user_id, qa_idx, CASE WHEN skipped OR n_session = 0 THEN 'FULL' ELSE 'SESSION' END AS session_mode,
         CASE WHEN skipped OR n_event = 0 THEN 'FULL' ELSE 'EVENT' END AS event_mode, 'FULL' AS none_mode FROM dec""",
)
def c13(spark, d):
    q, b = questions(spark, d), blocks(spark, d)
    out = None
    for mode in ("session", "event", "none"):
        part = pools.decide_pool(q, b, axis_mode=mode).select("user_id", "qa_idx", F.col("pool_mode").alias(f"{mode}_mode"))
        out = part if out is None else out.join(part, ["user_id", "qa_idx"])
    return out


@query(
    "c14_intent_gate",
    with_sql(QRY) + "SELECT user_id, qa_idx, (intent NOT IN ('STATIC','PLANNING') AND tc_type <> 'NONE') AS use_time FROM qry",
)
def c14(spark, d):
    return questions(spark, d).select("user_id", "qa_idx", tp.uses_time(F.col("intent"), F.col("tc_type")).alias("use_time"))


def _widened_sql(days: str) -> str:
    return with_sql(QRY) + f"""SELECT user_id, qa_idx,
      CASE WHEN tc_type = 'NONE' THEN 'NONE' WHEN tc_type IN ('RANGE','POINT') THEN 'RANGE' ELSE tc_type END AS w_type,
      tc_start - {days} AS w_start,
      CASE WHEN tc_type IN ('RANGE','POINT','BEFORE') THEN tc_end + {days} END AS w_end FROM qry"""


@query("c15_intent_buffer", _widened_sql("(CASE intent WHEN 'WINDOW' THEN 365 WHEN 'AS_OF' THEN 180 ELSE 1500 END)"))
def c15(spark, d):
    q = pools.buffered(questions(spark, d))
    return q.select("user_id", "qa_idx", F.col("tc_type").alias("w_type"), F.col("tc_start").alias("w_start"), F.col("tc_end").alias("w_end"))


@query("c16_wide_buffer", _widened_sql("1500"))
def c16(spark, d):
    q = pools.buffered(questions(spark, d).withColumn("intent", F.lit("MISC")))
    return q.select("user_id", "qa_idx", F.col("tc_type").alias("w_type"), F.col("tc_start").alias("w_start"), F.col("tc_end").alias("w_end"))


@query(
    "c17_category_bypass",
    with_sql(QRY)
    + "SELECT user_id, qa_idx, CASE WHEN qa_idx % 5 = 0 THEN 'NONE' ELSE tc_type END AS tc_type FROM qry",
)
def c17(spark, d):
    q = questions(spark, d).withColumn("category", F.when(F.col("qa_idx") % 5 == 0, "Memory Conflict").otherwise("Other"))
    return pools.bypass_categories(q).select("user_id", "qa_idx", "tc_type")


@query(
    "c18_empty_pool_fallback",
    with_sql(BLK, QRY, DECIDED)
    + """SELECT user_id, qa_idx, (NOT skipped AND n = 0) AS fell_back, CASE WHEN skipped OR n = 0 THEN n_pool ELSE n END AS pool_size,
         CASE WHEN skipped OR n = 0 THEN 'FULL' ELSE mode END AS pool_mode FROM dec""",
)
def c18(spark, d):
    return pools.decide_pool(questions(spark, d), blocks(spark, d)).select("user_id", "qa_idx", "fell_back", "pool_size", "pool_mode")


@query(
    "c19_min_pool_fallback",
    with_sql(BLK, QRY, DECIDED)
    + """SELECT user_id, qa_idx, (NOT skipped AND n < 3) AS fell_back,
         CASE WHEN skipped OR n < 3 THEN n_pool ELSE n END AS pool_size FROM dec""",
)
def c19(spark, d):
    return pools.decide_pool(questions(spark, d), blocks(spark, d), rule="min_pool").select("user_id", "qa_idx", "fell_back", "pool_size")


@query(
    "c20_small_pool_fallback",
    with_sql(BLK, QRY, DECIDED)
    + """, s1 AS (SELECT *, CASE WHEN n < 20 AND n < 0.1 * n_pool AND axis <> 'BOTH_UNION' AND n_union > n THEN 'BOTH_UNION' ELSE mode END AS mode2,
           CASE WHEN n < 20 AND n < 0.1 * n_pool AND axis <> 'BOTH_UNION' AND n_union > n THEN n_union ELSE n END AS n2 FROM dec)
       SELECT user_id, qa_idx, CASE WHEN skipped OR n2 = 0 OR (n2 < 20 AND n2 < 0.1 * n_pool) THEN 'FULL' ELSE mode2 END AS pool_mode,
         CASE WHEN skipped OR n2 = 0 OR (n2 < 20 AND n2 < 0.1 * n_pool) THEN n_pool ELSE n2 END AS pool_size FROM s1""",
)
def c20(spark, d):
    return pools.decide_pool(questions(spark, d), blocks(spark, d), rule="small_pool").select("user_id", "qa_idx", "pool_mode", "pool_size")


@query(
    "c23_pool_audit",
    with_sql(BLK, QRY, DECIDED, GOLD)
    + """, g AS (SELECT g.user_id, g.qa_idx, count(*) AS gold_total, count(*) FILTER (
             CASE WHEN dec.skipped OR dec.n = 0 THEN TRUE WHEN dec.mode = 'EVENT' THEN ok_event WHEN dec.mode = 'SESSION' THEN ok_session
             WHEN dec.mode = 'BOTH_INTERSECT' THEN ok_event AND ok_session ELSE ok_event OR ok_session END) AS gold_after_time
           FROM gold g JOIN dec USING (user_id, qa_idx) JOIN pairs p ON p.user_id = g.user_id AND p.qa_idx = g.qa_idx AND p.block_id = g.block_id
           GROUP BY ALL)
       SELECT user_id, qa_idx, n_pool, CASE WHEN skipped OR n = 0 THEN n_pool ELSE n END AS pool_size, (NOT skipped AND n = 0) AS fell_back,
         gold_total, gold_after_time, gold_total - gold_after_time AS gold_lost_time FROM dec JOIN g USING (user_id, qa_idx)""",
)
def c23(spark, d):
    b = blocks(spark, d)
    return pools.pool_audit(pools.decide_pool(questions(spark, d), b), b, gold(spark, d))


TOP5 = SCORED + """, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, qa_idx ORDER BY score DESC, block_id) AS INTEGER) AS rank FROM scored)"""


@query(
    "c24_trace_from_rankings",
    with_sql(BLK, QRY, GOLD, TOP5)
    + """SELECT g.user_id, g.qa_idx, count(*) AS gold_total, count(*) FILTER (r.rank <= 5) AS gold_in_topk, count(*) AS gold_after_time,
         CAST(0 AS BIGINT) AS gold_lost_time FROM gold g LEFT JOIN ranked r USING (user_id, qa_idx, block_id) GROUP BY g.user_id, g.qa_idx""",
)
def c24(spark, d):
    ranked = rank.tiled_top_k(questions(spark, d), blocks(spark, d), 5)
    return pools.trace_from_rankings(ranked, gold(spark, d), 5)


# ---- set operations on axis results -------------------------------------------------

SET_SQL = with_sql(BLK, QRY, PAIRS)


@query("s1_axis_union", SET_SQL + "SELECT user_id, qa_idx, count(*) FILTER (ok_event OR ok_session) AS n FROM pairs GROUP BY ALL")
def s1(spark, d):
    return pools.with_pool_counts(questions(spark, d), blocks(spark, d)).select("user_id", "qa_idx", F.col("n_union").alias("n"))


@query("s2_axis_intersect", SET_SQL + "SELECT user_id, qa_idx, count(*) FILTER (ok_event AND ok_session) AS n FROM pairs GROUP BY ALL")
def s2(spark, d):
    return pools.with_pool_counts(questions(spark, d), blocks(spark, d)).select("user_id", "qa_idx", F.col("n_intersect").alias("n"))


@query(
    "s3_pool_restriction",
    with_sql(BLK, QRY, GOLD)
    + "SELECT DISTINCT g.user_id, g.block_id FROM gold g SEMI JOIN (SELECT user_id, block_id FROM blk WHERE event_start IS NOT NULL) b USING (user_id, block_id)",
)
def s3(spark, d):
    pool = blocks(spark, d).filter("event_start is not null").select("user_id", "block_id")
    return gold(spark, d).select("user_id", "block_id").distinct().join(pool, ["user_id", "block_id"], "left_semi")


@query(
    "s4_gold_lost",
    with_sql(BLK, QRY, GOLD, PAIRS)
    + "SELECT user_id, qa_idx, block_id FROM gold EXCEPT ALL SELECT user_id, qa_idx, block_id FROM pairs WHERE ok_event",
)
def s4(spark, d):
    decided = pools.with_bounds(questions(spark, d)).withColumn("pool_mode", F.lit("EVENT"))
    return pools.lost_gold(decided, blocks(spark, d), gold(spark, d)).select(*PAIR_COLS)


# ---- ranking ------------------------------------------------------------------------


@query(
    "f1_rank_in_pool",
    with_sql(BLK, QRY, DECIDED)
    + """, kept AS (SELECT p.user_id, p.qa_idx, p.block_id, round(list_cosine_similarity(p.qemb, p.emb), 9) AS s
           FROM pairs p JOIN dec USING (user_id, qa_idx) WHERE CASE WHEN dec.skipped OR dec.n = 0 THEN TRUE WHEN dec.mode = 'EVENT' THEN ok_event
             WHEN dec.mode = 'SESSION' THEN ok_session WHEN dec.mode = 'BOTH_INTERSECT' THEN ok_event AND ok_session ELSE ok_event OR ok_session END)
       SELECT user_id, qa_idx, block_id, s AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, qa_idx ORDER BY s DESC, block_id) AS INTEGER) AS rank FROM kept)
       WHERE rank <= 20""",
)
def f1(spark, d):
    return retrieve(questions(spark, d), blocks(spark, d), k=20).select(*PAIR_COLS, "score", "rank")


@query(
    "f2_baseline_rank",
    with_sql(BLK, QRY, TOP5) + "SELECT user_id, qa_idx, block_id, score, rank FROM ranked WHERE rank <= 20",
)
def f2(spark, d):
    out = retrieve(questions(spark, d), blocks(spark, d), k=20, time_filter=False)
    return out.select(*PAIR_COLS, "score", "rank")


@query(
    "f3_time_decay",
    with_sql(BLK, QRY)
    + """, p AS (SELECT user_id, qa_idx, CASE WHEN tc_start IS NULL THEN 1.0 ELSE exp(-abs(session_end - tc_start) / 1500.0)
         * CASE WHEN intent IN ('AS_OF','STATIC') AND session_end > tc_start THEN 0.3 ELSE 1.0 END END AS decay FROM qry JOIN blk USING (user_id))
         SELECT user_id, qa_idx, round(sum(decay), 4) AS total, round(max(decay), 6) AS best, round(min(decay), 6) AS worst FROM p GROUP BY ALL""",
)
def f3(spark, d):
    """Weights of a question's whole pool: days are counted first, constraints made distinct, so no pair of rows meets."""
    q = questions(spark, d).select("user_id", "qa_idx", "tc_start", "intent")
    days = blocks(spark, d).groupBy("user_id", F.coalesce("session_end", "session_start").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    asks = q.select("user_id", "tc_start", "intent").distinct()
    weight = rank.time_decay(F.col("day"), F.col("tc_start"), F.col("intent"))
    weights = asks.join(days, "user_id").withColumn("w", weight).groupBy("user_id", F.col("tc_start").alias("start"), F.col("intent").alias("i")).agg(
        F.round(F.sum(F.col("w") * F.col("n")), 4).alias("total"), F.round(F.max("w"), 6).alias("best"), F.round(F.min("w"), 6).alias("worst")
    )
    w = weights.withColumnRenamed("user_id", "u")
    return q.join(w, (F.col("user_id") == F.col("u")) & F.col("tc_start").eqNullSafe(F.col("start")) & (F.col("intent") == F.col("i"))).select("user_id", "qa_idx", "total", "best", "worst")


def _decayed_sql(applies: str) -> str:
    return with_sql(BLK, QRY, DECIDED) + f""", kept AS (SELECT p.user_id, p.qa_idx, p.block_id,
        round(list_cosine_similarity(p.qemb, p.emb) * CASE WHEN p.tc_start IS NULL OR NOT ({applies}) THEN 1.0 ELSE
          exp(-abs(p.session_end - p.tc_start) / 1500.0) * CASE WHEN p.intent IN ('AS_OF','STATIC') AND p.session_end > p.tc_start THEN 0.3 ELSE 1.0 END END, 9) AS s
        FROM pairs p JOIN dec USING (user_id, qa_idx) WHERE CASE WHEN dec.skipped OR dec.n = 0 THEN TRUE WHEN dec.mode = 'EVENT' THEN ok_event
          WHEN dec.mode = 'SESSION' THEN ok_session WHEN dec.mode = 'BOTH_INTERSECT' THEN ok_event AND ok_session ELSE ok_event OR ok_session END),
      rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, qa_idx ORDER BY s DESC, block_id) AS INTEGER) AS rank FROM kept)
      SELECT user_id, qa_idx, block_id, s AS score, rank FROM rk WHERE rank <= 5"""


@query("f4_decayed_rank", _decayed_sql("p.intent IN ('STATIC','PLANNING')"))
def f4(spark, d):
    out = retrieve(questions(spark, d), blocks(spark, d), decay="history")
    return out.select(*PAIR_COLS, "score", "rank")


@query("f6_time_only_mode", _decayed_sql("p.tc_type <> 'NONE'"))
def f6(spark, d):
    out = retrieve(questions(spark, d), blocks(spark, d), decay="dated")
    return out.select(*PAIR_COLS, "score", "rank")


@query(
    "e1_retrieve_top5",
    _decayed_sql("FALSE"),
)
def e1(spark, d):
    out = retrieve(questions(spark, d), blocks(spark, d), k=5)
    return out.select(*PAIR_COLS, "score", "rank")


@query(
    "f8_top_k_depths",
    with_sql(BLK, QRY, TOP5)
    + "SELECT r.user_id, r.qa_idx, r.block_id, r.rank, CAST(k.topn AS INTEGER) AS topn FROM ranked r JOIN (VALUES (1),(3),(5)) k(topn) ON r.rank <= k.topn",
)
def f8(spark, d):
    ranked = rank.tiled_top_k(questions(spark, d), blocks(spark, d), 5)
    return rank.at_each_k(ranked, [1, 3, 5]).select(*PAIR_COLS, "rank", "topn")


@query(
    "f9_last_write_wins",
    "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type",
)
def f9(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "event_id", "value")
    return rank.last_write_wins(ev.withColumn("load_no", F.col("event_id")), ["user_id", "event_type"], "load_no").drop("load_no")


@query(
    "f10_gold_in_top_k",
    with_sql(BLK, QRY, GOLD, TOP5)
    + "SELECT g.user_id, g.qa_idx, count(*) FILTER (r.rank <= 5) AS gold_in_topk FROM gold g JOIN ranked r USING (user_id, qa_idx, block_id) GROUP BY ALL",
)
def f10(spark, d):
    ranked = rank.tiled_top_k(questions(spark, d), blocks(spark, d), 5)
    return rank.gold_in_top_k(ranked, gold(spark, d), 5)


@query(
    "j1_question_pool",
    with_sql(BLK, QRY) + "SELECT q.user_id, q.qa_idx, count(*) AS pool_size FROM qry q JOIN blk b USING (user_id) GROUP BY ALL",
)
def j1(spark, d):
    sizes = blocks(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("pool_size"))
    return questions(spark, d).select("user_id", "qa_idx").join(sizes, "user_id").select("user_id", "qa_idx", "pool_size")


@query(
    "x22_cosine",
    with_sql(BLK, QRY)
    + """SELECT q.user_id, q.qa_idx, round(max(s), 6) AS best_other, round(min(s), 6) AS worst, round(avg(s), 6) AS mean
         FROM (SELECT q.user_id, q.qa_idx, round(CASE WHEN b.block_id % 13 = 0 THEN -1.0 WHEN b.block_id % 17 = 0 THEN 0.0
                 ELSE list_cosine_similarity(q.qemb, b.emb) END, 9) AS s
               FROM qry q JOIN blk b ON q.user_id = b.user_id AND q.qa_idx <> b.block_id) q GROUP BY ALL""",
)
def x22(spark, d):
    b = blocks(spark, d)
    vec = (
        F.when(b.block_id % 13 == 0, F.lit(None).cast("array<float>"))
        .when(b.block_id % 17 == 0, F.transform("embedding", lambda x: x * F.lit(0.0).cast("float")))
        .otherwise(F.col("embedding"))
    )
    s = rank.score_summary(questions(spark, d), b.select("user_id", "block_id", vec.alias("embedding")))
    return s.select("user_id", "qa_idx", F.round("best", 6).alias("best_other"), F.round("worst", 6).alias("worst"), F.round("mean", 6).alias("mean"))
