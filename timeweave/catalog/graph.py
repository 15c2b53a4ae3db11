"""Anchors, event graph, relations, context text and the remaining joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from timeweave.catalog.fixtures import BLK, QRY, blocks, questions, with_sql
from timeweave.catalog.pools import TOP5
from timeweave.catalog.registry import query, table
from timeweave.functions import text as tx
from timeweave.operators import anchors as an
from timeweave.operators import context as cx
from timeweave.operators import graph as gr
from timeweave.operators import pools, rank
from timeweave.operators.intervals import PAIRS_PER_TASK, overlap_join
from timeweave.operators.rank import event_type_score
from timeweave.sources import scans

KEY = ["user_id", "qa_idx"]

# ---- anchors: every question's vector is the anchor; a block has two events, its own vector
# ---- and a blend with the previous block of the user


def event_vectors(spark, d):
    b = blocks(spark, d).select("user_id", "block_id", "embedding")
    w = Window.partitionBy("user_id").orderBy("block_id")
    before = b.select("user_id", "block_id", F.lag("block_id").over(w).alias("_before")).filter("_before IS NOT NULL")  # ids only
    blend = F.zip_with("_p", "embedding", lambda p, o: p.cast("double") * 0.6 + o.cast("double") * 0.8)
    pairs = b.join(before, ["user_id", "block_id"]).join(b.select("user_id", F.col("block_id").alias("_before"), F.col("embedding").alias("_p")), ["user_id", "_before"])
    two = b.withColumn("embedding", F.col("embedding").cast("array<double>")).unionByName(pairs.select("user_id", "block_id", blend.alias("embedding")))
    return two


EVV = """evv AS (SELECT user_id, block_id, emb FROM blk UNION ALL
    SELECT user_id, block_id, list_transform(range(1, 65), lambda i: p[i] * 0.6 + emb[i] * 0.8) FROM (SELECT user_id, block_id, emb, lag(emb) OVER (PARTITION BY user_id ORDER BY block_id) AS p FROM blk) WHERE p IS NOT NULL)"""
FINE = EVV + """, coarse AS (SELECT user_id, qa_idx, block_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, qa_idx ORDER BY score DESC, block_id) AS rn FROM scored) WHERE rn <= 30),
  fine AS (SELECT c.user_id, c.qa_idx, c.block_id, max(round(list_cosine_similarity(q.qemb, e.emb), 9)) AS score FROM coarse c JOIN evv e USING (user_id, block_id) JOIN qry q USING (user_id, qa_idx) GROUP BY ALL),
  cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, qa_idx ORDER BY score DESC, block_id) AS rn FROM fine) WHERE rn <= 10),
  gate AS (SELECT user_id, qa_idx, count(*) FILTER (score > 0.4) AS n_matches, max(score) FILTER (score > 0.4) AS top1, quantile_cont(score, 0.5) FILTER (score > 0.4) AS median,
     avg(score) FILTER (score > 0.4 AND rn <= 3) AS avg_top3 FROM cand GROUP BY ALL),
  okk AS (SELECT *, coalesce(n_matches >= 1 AND top1 >= 0.5 AND top1 - median >= 0.05 AND avg_top3 >= 0.45, FALSE) AS accepted FROM gate)"""
SCORED = """scored AS (SELECT user_id, qa_idx, block_id, round(list_cosine_similarity(qemb, emb), 9) AS score FROM qry q JOIN blk b USING (user_id))"""


def _anchors(spark, d):
    rel = F.element_at(F.array(F.lit("DURING"), F.lit("BEFORE"), F.lit("AFTER")), (F.col("qa_idx") % 3 + 1).cast("int"))
    return questions(spark, d).select(*KEY, "embedding", rel.alias("anchor_relation"))


@query(
    "an1_an3_anchor_candidates",
    with_sql(BLK, QRY, SCORED, FINE) + "SELECT user_id, qa_idx, block_id, round(score, 6) AS score, CAST(rn AS INTEGER) AS rank FROM cand WHERE score > 0.4",
)
def an1(spark, d):
    c = an.score_candidates(_anchors(spark, d), blocks(spark, d), event_vectors(spark, d))
    return c.filter("score > 0.4").select(*KEY, "block_id", F.round("score", 6).alias("score"), "rank")


@query(
    "an4_an5_confidence_gates",
    with_sql(BLK, QRY, SCORED, FINE) + "SELECT user_id, qa_idx, n_matches, round(top1, 6) AS top1, round(median, 6) AS median, round(avg_top3, 6) AS avg_top3, accepted FROM okk",
)
def an4(spark, d):
    g = an.gate(an.score_candidates(_anchors(spark, d), blocks(spark, d), event_vectors(spark, d)))
    return g.select(*KEY, "n_matches", *[F.round(c, 6).alias(c) for c in ("top1", "median", "avg_top3")], "accepted")


@query(
    "an5_lone_peaks",
    with_sql(BLK, QRY, SCORED, FINE)
    + """, peaks AS (SELECT user_id, qa_idx, max(score) FILTER (rn = 1) AS first, coalesce(max(score) FILTER (rn = 2), -1.0) AS second FROM cand GROUP BY ALL),
      judged AS (SELECT *, coalesce(n_matches >= 1 AND top1 >= 0.8 AND top1 - median >= 0.05 AND avg_top3 >= 0.45, FALSE) AS cluster, coalesce(top1 >= 0.5 AND first - second >= 0.05, FALSE) AS peak FROM okk JOIN peaks USING (user_id, qa_idx)),
      taken AS (SELECT *, peak AND NOT cluster AS lone FROM judged WHERE cluster OR peak)
      SELECT c.user_id, c.qa_idx, c.block_id, CAST(c.rn AS INTEGER) AS rank, lone FROM cand c JOIN taken USING (user_id, qa_idx) WHERE c.score > 0.4 AND (NOT lone OR c.rn = 1)""",
)
def an5(spark, d):
    rules = an.AnchorRules(cluster_top1=0.8, lone_peak=True)
    scored = an.score_candidates(_anchors(spark, d), blocks(spark, d), event_vectors(spark, d), rules)
    gates = an.gate(scored, rules)
    return an.anchor_blocks(scored, gates, rules).join(gates.select(*KEY, "lone"), KEY).select(*KEY, "block_id", "rank", "lone")


@query(
    "an6_an10_anchor_windows",
    with_sql(BLK, QRY, SCORED, FINE)
    + """, w AS (SELECT c.user_id, c.qa_idx, min(event_start) AS s0, max(event_start) AS s1, min(event_end) AS e0, max(event_end) AS e1 FROM cand c JOIN okk USING (user_id, qa_idx) JOIN blk b ON b.user_id = c.user_id AND b.block_id = c.block_id
           WHERE accepted AND c.score > 0.4 AND event_start IS NOT NULL GROUP BY ALL)
       SELECT q.user_id, q.qa_idx, CASE WHEN s0 IS NULL THEN 'NONE' WHEN q.qa_idx % 3 = 0 THEN 'RANGE' WHEN q.qa_idx % 3 = 1 THEN 'BEFORE' ELSE 'AFTER' END AS tc_type,
         CASE q.qa_idx % 3 WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE e0 END AS tc_start, CASE WHEN q.qa_idx % 3 = 0 THEN e1 END AS tc_end FROM qry q LEFT JOIN w USING (user_id, qa_idx)""",
)
def an10(spark, d):
    return an.resolve(_anchors(spark, d), blocks(spark, d), event_vectors(spark, d)).select(*KEY, "tc_type", "tc_start", "tc_end")


@query(
    "an8_earlier_anchor_variant",
    with_sql(BLK, QRY, SCORED)
    + """, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, qa_idx ORDER BY score DESC, block_id) AS rn FROM scored) WHERE rn <= 5 AND score > 0.3),
       w AS (SELECT c.user_id, c.qa_idx, min(coalesce(event_start, session_start)) AS s, max(coalesce(event_end, session_end)) AS e FROM c JOIN blk b ON b.user_id = c.user_id AND b.block_id = c.block_id GROUP BY ALL)
       SELECT user_id, qa_idx, CASE qa_idx % 3 WHEN 0 THEN s WHEN 1 THEN s - 3650 ELSE e END AS tc_start, CASE qa_idx % 3 WHEN 0 THEN e WHEN 1 THEN s ELSE e + 3650 END AS tc_end FROM w""",
)
def an8(spark, d):
    a, b = _anchors(spark, d), blocks(spark, d)
    c = rank.tiled_top_k(a, b, an.OLD_RULES.candidates).filter(F.col("score") > an.OLD_RULES.min_score)
    return an.old_windows(c, b, a.select(*KEY, "anchor_relation")).select(*KEY, "tc_start", "tc_end")


@query(
    "an9_merge_anchor_blocks",
    with_sql(BLK, QRY, SCORED)
    + """SELECT DISTINCT user_id, qa_idx, block_id FROM (SELECT q.user_id, q.qa_idx, b.block_id FROM qry q JOIN blk b ON q.user_id = b.user_id AND b.event_start <= q.base_day AND b.event_end >= q.base_day
         UNION ALL SELECT user_id, qa_idx, block_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, qa_idx ORDER BY score DESC, block_id) AS rn FROM scored) WHERE rn <= 2)""",
)
def an9(spark, d):
    q = questions(spark, d).select(*KEY, "base_day")
    dated = blocks(spark, d).select("user_id", "block_id", "event_start", "event_end")
    kept = overlap_join(q, dated, ("base_day", "base_day"), ("event_start", "event_end"), ["user_id"], 4, pairs_per_task=PAIRS_PER_TASK)
    best = rank.tiled_top_k(_anchors(spark, d), blocks(spark, d), 2).join(q, KEY).join(dated, ["user_id", "block_id"])
    return an.merge_anchor_blocks(kept, best, F.col("base_day").between(F.col("event_start"), F.col("event_end")))


# ---- similar-event edges: one event per block -------------------------------------------------


def _edges(spark, d):
    ev = blocks(spark, d).select("user_id", F.col("block_id").alias("event_id"), F.col("block_id").alias("seq"), "embedding")
    return gr.link_similar(ev, threshold=0.3)


EDGES = """edges AS (SELECT user_id, a_id, b_id, score FROM (SELECT a.user_id, a.block_id AS a_id, b.block_id AS b_id, round(list_cosine_similarity(a.emb, b.emb), 9) AS score,
    row_number() OVER (PARTITION BY a.user_id, a.block_id ORDER BY round(list_cosine_similarity(a.emb, b.emb), 9) DESC, b.block_id) AS rn
    FROM blk a JOIN blk b ON a.user_id = b.user_id AND b.block_id < a.block_id AND round(list_cosine_similarity(a.emb, b.emb), 9) >= 0.3) WHERE rn <= 20)"""
SEEDS = """seeds AS (SELECT user_id, qa_idx, block_id AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, qa_idx ORDER BY score DESC, block_id) AS rn FROM scored) WHERE rn <= 3),
  two AS (SELECT user_id, a_id AS f, b_id AS t, score FROM edges UNION ALL SELECT user_id, b_id, a_id, score FROM edges)"""


def _seeds(spark, d):
    ranked = rank.tiled_top_k(questions(spark, d), blocks(spark, d), 3)
    return gr.seed_events(ranked, blocks(spark, d).select("user_id", "block_id", F.col("block_id").alias("event_id")))


@query("k1_similar_edges", with_sql(BLK, EDGES) + "SELECT user_id, a_id, b_id, round(score, 6) AS score FROM edges")
def k1(spark, d):
    return _edges(spark, d).select("user_id", "a_id", "b_id", F.round("score", 6).alias("score"))


@query(
    "k2_node_upsert",
    "SELECT user_id, event_type AS event_id, max(ts) AS ts, arg_max(props, ts) AS description FROM events GROUP BY ALL",
)
def k2(spark, d):
    ev = table(spark, d, "events").select("user_id", F.col("event_type").alias("event_id"), "ts", F.col("props").alias("description"))
    return gr.upsert_nodes(ev.withColumn("load_no", F.col("ts")), "load_no").drop("load_no")


@query(
    "k3_seed_events",
    with_sql(BLK, QRY, SCORED, EDGES, SEEDS) + "SELECT user_id, qa_idx, event_id FROM seeds",
)
def k3(spark, d):
    return _seeds(spark, d)


@query(
    "k4_one_hop_edges",
    with_sql(BLK, QRY, SCORED, EDGES, SEEDS)
    + "SELECT DISTINCT s.user_id, s.qa_idx, least(a_id, b_id) AS a_id, greatest(a_id, b_id) AS b_id, round(score, 6) AS score FROM seeds s JOIN edges e ON s.user_id = e.user_id AND (s.event_id = e.a_id OR s.event_id = e.b_id)",
)
def k4(spark, d):
    return gr.one_hop_edges(_seeds(spark, d), _edges(spark, d), 0.3).select(*KEY, "a_id", "b_id", F.round("score", 6).alias("score"))


REACH = """h1 AS (SELECT s.user_id, qa_idx, t AS event_id, max(score) AS p FROM seeds s JOIN two ON s.user_id = two.user_id AND s.event_id = two.f GROUP BY ALL),
  h2 AS (SELECT h1.user_id, qa_idx, t AS event_id, max(least(p, score)) AS p FROM h1 JOIN two ON h1.user_id = two.user_id AND h1.event_id = two.f GROUP BY ALL),
  re AS (SELECT user_id, qa_idx, event_id, min(h) AS min_hop, max(p) AS p FROM (SELECT *, 1 AS h FROM h1 UNION ALL SELECT *, 2 FROM h2) x
    WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.user_id = x.user_id AND s.qa_idx = x.qa_idx AND s.event_id = x.event_id) GROUP BY ALL)"""


@query(
    "k5_two_hop_reach",
    with_sql(BLK, QRY, SCORED, EDGES, SEEDS, REACH)
    + "SELECT user_id, qa_idx, event_id, CAST(min_hop AS INTEGER) AS min_hop, round(p, 6) AS similarity_score, CAST(row_number() OVER (PARTITION BY user_id, qa_idx ORDER BY min_hop, p DESC, event_id) AS INTEGER) AS rank FROM re",
)
def k5(spark, d):
    r = gr.reachable(_seeds(spark, d), _edges(spark, d), 2, 0.3)
    return r.select(*KEY, "event_id", "min_hop", F.round("similarity_score", 6).alias("similarity_score"), "rank")


def _expanded(spark, d, min_similarity=None):
    b = blocks(spark, d)
    nodes = b.select("user_id", F.col("block_id").alias("event_id"), "embedding", F.concat(F.lit("event "), "block_id").alias("event_description"), F.col("event_start").cast("string").alias("event_start_time"))
    return gr.scored_expansion(_seeds(spark, d), _edges(spark, d), questions(spark, d), nodes, 2, 0.3, min_similarity)


@query(
    "k6_k7_scored_expansion",
    with_sql(BLK, QRY, SCORED, EDGES, SEEDS, REACH)
    + """SELECT re.user_id, re.qa_idx, re.event_id, 'event ' || re.event_id AS event_description, round(s.score, 6) AS query_similarity FROM re JOIN scored s
         ON s.user_id = re.user_id AND s.qa_idx = re.qa_idx AND s.block_id = re.event_id""",
)
def k7(spark, d):
    return _expanded(spark, d).select(*KEY, F.inline("events")).select(*KEY, "event_id", "event_description", F.round("query_similarity", 6).alias("query_similarity"))


@query(
    "k13_context_events",
    with_sql(BLK, QRY, SCORED, EDGES, SEEDS, REACH)
    + """SELECT re.user_id, re.qa_idx, count(*) AS total, count(*) FILTER (s.score >= 0.1) AS kept FROM re JOIN scored s
         ON s.user_id = re.user_id AND s.qa_idx = re.qa_idx AND s.block_id = re.event_id GROUP BY ALL""",
)
def k13(spark, d):
    return gr.context_counts(_expanded(spark, d), min_score=0.1)


@query("f12_best_edge", "SELECT least(s, b) AS a_id, greatest(s, b) AS b_id, max(p) AS score FROM (SELECT l_suppkey % 40 AS s, l_partkey % 40 AS b, l_extendedprice AS p FROM lineitem) GROUP BY ALL")
def f12(spark, d):
    e = table(spark, d, "lineitem").select(F.lit("u").alias("user_id"), (F.col("l_suppkey") % 40).alias("a_id"), (F.col("l_partkey") % 40).alias("b_id"), F.col("l_extendedprice").alias("score"))
    return gr.best_edges(e, 0.0).drop("user_id")


# ---- relations: suppliers located in nations, nations located in regions ------------------------


def relations(spark, d):
    n = table(spark, d, "nation")
    sup = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    a = sup.select(F.concat(F.lit("s"), "s_suppkey").alias("relation_id"), F.col("s_name").alias("source"), F.col("n_name").alias("destination"), F.col("s_suppkey").alias("k"))
    b = n.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("n"), "n_nationkey").alias("relation_id"), F.col("n_name").alias("source"), F.col("r_name").alias("destination"), F.col("n_nationkey").cast("bigint").alias("k")
    )
    return a.union(b).select(
        F.lit("0").alias("user_id"), "relation_id", "source", F.lit("located_in").alias("relationship"), "destination", F.col("k").cast("string").alias("event_id"),
        F.col("k").cast("string").alias("block_id"), F.concat(F.lit("0|"), "k").alias("block_key"), F.lit(None).cast("timestamp").alias("event_ts"), "k",
    )


def entities(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("Person").alias("entity_type"))
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("Location").alias("entity_type"))
    return s.union(n).withColumn("user_id", F.lit("0"))


REL = """rel AS (SELECT 's' || s_suppkey AS relation_id, s_name AS source, n_name AS destination, s_suppkey AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'n' || n_nationkey, n_name, r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query("k8_relations_of_events", with_sql(BLK, QRY, SCORED, EDGES, SEEDS, REL) + "SELECT s.qa_idx, r.relation_id, r.source FROM seeds s JOIN rel r ON s.user_id = '0' AND s.event_id = r.k")
def k8(spark, d):
    ev = _seeds(spark, d).withColumn("event_id", F.col("event_id").cast("string"))
    return gr.relations_of_events(ev, relations(spark, d)).select("qa_idx", "relation_id", "source")


@query("k8_relations_of_blocks", with_sql(BLK, QRY, SCORED, EDGES, SEEDS, REL) + "SELECT s.qa_idx, r.relation_id FROM seeds s JOIN rel r ON s.user_id = '0' AND s.event_id = r.k")
def k8_blocks(spark, d):
    ranked = rank.tiled_top_k(questions(spark, d), blocks(spark, d), 3)
    return gr.relations_of_blocks(ranked, relations(spark, d)).select("qa_idx", "relation_id")


@query("k9_distinct_relations", with_sql(REL) + "SELECT source, destination, count(*) AS n FROM rel GROUP BY ALL")
def k9(spark, d):
    r = relations(spark, d)
    return gr.distinct_relations(r.union(r)).groupBy("source", "destination").agg(F.count(F.lit(1)).alias("n"))


@query("j11_person_names", "SELECT s_name AS person FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation)")
def j11(spark, d):
    return gr.person_names(relations(spark, d), entities(spark, d)).select("person")


@query("j12_k10_person_relations", with_sql(REL) + "SELECT source AS person, relation_id FROM rel WHERE relation_id LIKE 's%'")
def j12(spark, d):
    r = relations(spark, d)
    return gr.relations_of_persons(gr.person_names(r, entities(spark, d)), r).select("person", "relation_id")


def _facts(spark, d):
    r = relations(spark, d)
    named = gr.relations_of_persons(gr.person_names(r, entities(spark, d)), r)
    vec = r.join(blocks(spark, d).select(F.col("block_id").alias("k"), "embedding"), "k").select(
        "user_id", tx.content_key(tx.fact_text(F.col("source"), F.col("relationship"), F.col("destination"))).alias("text_key"), "embedding"
    ).dropDuplicates(["user_id", "text_key"])
    return named, questions(spark, d), vec


FACTS = """facts AS (SELECT q.qa_idx, r.source AS person, r.relation_id, round(coalesce(list_cosine_similarity(q.qemb, b.emb), -1.0), 9) AS s
   FROM rel r JOIN qry q ON q.user_id = '0' LEFT JOIN blk b ON b.block_id = r.k WHERE r.relation_id LIKE 's%')"""


@query("k11_fact_scores", with_sql(BLK, QRY, REL, FACTS) + "SELECT qa_idx, relation_id, round(s, 6) AS query_similarity FROM facts")
def k11(spark, d):
    return gr.score_facts(*_facts(spark, d), columns=["relation_id"]).select("qa_idx", "relation_id", F.round("query_similarity", 6).alias("query_similarity"))


@query("k14_person_profiles", with_sql(BLK, QRY, REL, FACTS) + "SELECT qa_idx, person, relation_id, CAST(row_number() OVER (PARTITION BY qa_idx, person ORDER BY s DESC, relation_id) AS INTEGER) AS rank FROM facts WHERE s >= 0.1 QUALIFY rank <= 5")
def k14(spark, d):
    return gr.best_facts(*_facts(spark, d), k=5, min_score=0.1, columns=[]).select("qa_idx", "person", "relation_id", "rank")


@query("k14_all_profiles", with_sql(BLK, QRY, REL, FACTS) + "SELECT qa_idx, person, relation_id, CAST(row_number() OVER (PARTITION BY qa_idx, person ORDER BY s DESC, relation_id) AS INTEGER) AS rank FROM facts WHERE s >= 0.1")
def k14_all(spark, d):
    return gr.best_facts(*_facts(spark, d), k=None, min_score=0.1, columns=[]).select("qa_idx", "person", "relation_id", "rank")


@query(
    "k15_fact_conflicts",
    "SELECT user_id, event_type AS source, CAST(user_id % 3 AS VARCHAR) AS destination, max(event_id) AS relation_id, arg_max(props, event_id) AS relationship FROM events GROUP BY ALL",
)
def k15(spark, d):
    ev = table(spark, d, "events").select(
        "user_id", F.col("event_type").alias("source"), (F.col("user_id") % 3).cast("string").alias("destination"), F.col("event_id").alias("relation_id"),
        F.col("props").alias("relationship"), F.col("ts").cast("timestamp").alias("event_ts"),
    )
    return gr.resolve_conflicts(ev).drop("event_ts")


@query("b13_valid_relations", with_sql(REL) + "SELECT relation_id FROM rel WHERE relation_id LIKE 's%' AND k % 5 <> 0")
def b13(spark, d):
    r = relations(spark, d)
    return gr.valid_relations(r, entities(spark, d), (F.col("k") % 5 == 0) & F.col("relation_id").startswith("s")).select("relation_id")


def _graph_blocks(spark, d):
    """Blocks with one event each, for graph building and context text."""
    e = F.struct(
        F.concat_ws("_", "user_id", "block_id", F.lit("e0")).alias("event_id"), F.concat(F.lit("event "), "block_id").alias("description"),
        F.lit("STATE").alias("event_temporal_type"),
        F.struct(F.lit(None).cast("string").alias("observedTime"), F.col("event_start").cast("string").alias("startTime"), F.col("event_end").cast("string").alias("endTime"), F.lit("day").alias("granularity")).alias("time_metadata"),
    )
    return blocks(spark, d).withColumn("events", F.array(e))


@query(
    "k16_graph_tables",
    with_sql(BLK, EDGES) + "SELECT user_id, user_id || '_' || a_id || '_e0' AS a_id, user_id || '_' || b_id || '_e0' AS b_id, round(score, 6) AS score FROM edges",
)
def k16(spark, d):
    b = _graph_blocks(spark, d)
    vec = b.select("user_id", F.col("events")[0]["event_id"].alias("event_id"), "embedding")
    nodes, edges = gr.graph_tables(b.withColumn("load_no", F.col("block_id")), vec, "load_no", threshold=0.3)
    return edges.select("user_id", "a_id", "b_id", F.round("score", 6).alias("score"))


# ---- context text ---------------------------------------------------------------------------------

TXT = """txt AS (SELECT user_id, block_id, 'Topics: label ' || user_id || chr(10) || chr(10) || 'Events:' || chr(10) || '- [' ||
   CASE WHEN event_start IS NULL THEN CAST(session_start AS VARCHAR) WHEN event_start <> event_end THEN event_start || ' to ' || event_end ELSE CAST(event_start AS VARCHAR) END || '] event ' || block_id AS t FROM blk)"""
PACK = """pk AS (SELECT r.user_id, r.qa_idx, string_agg(t, chr(10) || chr(10) ORDER BY r.rank) AS context FROM ranked r JOIN txt USING (user_id, block_id) WHERE r.rank <= 3 GROUP BY ALL)"""


def _texts(spark, d):
    b = _graph_blocks(spark, d)
    text = cx.event_text(F.concat(F.lit("label "), "user_id"), F.col("events"), F.col("session_start").cast("string"))
    return b.select("user_id", "block_id", cx.block_context(F.lit(""), text, "content").alias("text"))


def _packed(spark, d):
    return cx.pack(rank.tiled_top_k(questions(spark, d), blocks(spark, d), 3), _texts(spark, d), 3)


@query("m15_event_text", with_sql(BLK, TXT) + "SELECT user_id, block_id, t AS text FROM txt")
def m15(spark, d):
    return _texts(spark, d)


@query("j4_m19_packed_context", with_sql(BLK, QRY, TOP5, TXT, PACK) + "SELECT user_id, qa_idx, context FROM pk")
def m19(spark, d):
    return _packed(spark, d)


@query(
    "j14_m16_trace_context",
    with_sql(BLK, QRY, TOP5)
    + """, t AS (SELECT user_id, block_id, '2024: note ' || (block_id // 100) AS t FROM blk), f AS (SELECT r.user_id, r.qa_idx, t, min(rank) AS rank FROM ranked r JOIN t USING (user_id, block_id) WHERE rank <= 3 GROUP BY ALL)
       SELECT user_id, qa_idx, string_agg('Events:' || chr(10) || t, chr(10) || chr(10) ORDER BY rank) AS context FROM f GROUP BY ALL""",
)
def m16(spark, d):
    b = blocks(spark, d)
    group = F.floor(F.col("block_id") / 100)
    entry = F.array(F.struct(F.lit("2024").alias("start_time"), F.array(F.concat(F.lit(" note "), group), F.lit(" ")).alias("events")))
    traces = b.groupBy("user_id", group.alias("line_no")).agg(F.collect_list("block_id").alias("box_ids"), F.first(entry).alias("entries")).withColumn("metric", F.lit("m"))
    later = traces.withColumn("line_no", F.col("line_no") + 1000).withColumn("entries", F.array(F.struct(F.lit("x").alias("start_time"), F.array(F.lit("late")).alias("events"))))
    first = scans.first_traces(traces.unionByName(later), "line_no")
    return cx.pack_traces(rank.tiled_top_k(questions(spark, d), b, 3), first, 3)


@query(
    "m17_graph_context",
    with_sql(BLK, QRY, REL, FACTS)
    + """, p AS (SELECT *, row_number() OVER (PARTITION BY qa_idx, person ORDER BY s DESC, relation_id) AS rk FROM facts WHERE s >= 0.2 QUALIFY rk <= 5),
       l AS (SELECT qa_idx, person, 'About ' || person || ', here is related history:' || chr(10) || string_agg(rk || '. ' || source || ' located_in ' || destination, chr(10) ORDER BY rk) AS a FROM p JOIN rel USING (relation_id) GROUP BY qa_idx, person),
       pr AS (SELECT qa_idx, 'Person profiles:' || chr(10) || string_agg(a, chr(10) ORDER BY person) AS t FROM l GROUP BY qa_idx),
       rl AS (SELECT qa_idx, 'Relations:' || chr(10) || string_agg('- Relation between ' || source || ' and ' || destination || ': located in.', chr(10) ORDER BY relation_id) AS t FROM p JOIN rel USING (relation_id) GROUP BY qa_idx)
       SELECT q.user_id, q.qa_idx, concat_ws(chr(10), rl.t, pr.t) AS graph_text FROM qry q LEFT JOIN rl ON rl.qa_idx = q.qa_idx LEFT JOIN pr ON pr.qa_idx = q.qa_idx""",
)
def m17(spark, d):
    found = gr.best_fact_lists(*_facts(spark, d), k=5, min_score=0.2, columns=["source", "relationship", "destination", "fact_text"])
    by_id = F.sort_array(F.transform("facts", lambda f: F.struct(*[f[c].alias(c) for c in ("relation_id", "source", "relationship", "destination")])))
    line = lambda f: cx.relation_line(f["source"], f["relationship"], f["destination"], F.lit(""), "sentence")
    text = F.concat_ws("\n", cx.listed(by_id, line, "Relations:"), cx.profiles_of(F.col("facts"), F.lit("")))
    return found.select(*KEY, text.alias("graph_text"))


@query(
    "m17_m19_event_section",
    with_sql(BLK, QRY, SCORED, EDGES, SEEDS, REACH, "ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, qa_idx ORDER BY score DESC, block_id) AS rank FROM scored)", TXT, PACK)
    + """, e AS (SELECT re.user_id, re.qa_idx, 'Expanded events (similarity-filtered):' || chr(10) || string_agg('- [query_score=' || printf('%.4f', s.score) ||
           CASE WHEN b.event_start IS NULL THEN '' ELSE ', event_time=' || b.event_start END || '] event ' || re.event_id, chr(10) ORDER BY s.score DESC, re.event_id) AS t
         FROM re JOIN scored s ON s.user_id = re.user_id AND s.qa_idx = re.qa_idx AND s.block_id = re.event_id JOIN blk b ON b.block_id = re.event_id WHERE s.score >= 0.25 GROUP BY ALL)
       SELECT pk.user_id, pk.qa_idx, CASE WHEN e.t IS NULL THEN context ELSE context || chr(10) || chr(10) || 'Supplementary Graph Evidence:' || chr(10) ||
         'Use the following graph-expanded events, relation facts, and person profiles only as supporting evidence. Prefer direct retrieved memories above, and ignore graph items that are irrelevant, weakly related, or contradicted by the main memories.' || chr(10) || e.t END AS context
       FROM pk LEFT JOIN e USING (user_id, qa_idx)""",
)
def m17_events(spark, d):
    null = F.lit(None).cast("string")
    meta = lambda e: tx.time_meta(e["event_start_time"], null, null, null, null)
    line = lambda e: cx.event_line(e["event_description"], e["event_id"].cast("string"), e["query_similarity"], e["graph_similarity_score"], meta(e))
    kept = _expanded(spark, d, 0.25).select(*KEY, cx.listed(F.col("events"), line, cx.EXPANDED_HEADING).alias("events_text"))
    text = cx.graph_text(questions(spark, d), kept)
    return cx.full_context(_packed(spark, d), text)


@query(
    "k12_m18_block_payload_text",
    with_sql(BLK, QRY, TOP5, EDGES, REL)
    + """, o AS (SELECT user_id, a_id, string_agg('- ' || a_id || ' -> ' || b_id || ' (score=' || 'x' || ')', chr(10) ORDER BY b_id) AS t, count(*) AS n FROM edges GROUP BY ALL),
       rr AS (SELECT k, string_agg('- ' || source || ' -- located_in -- ' || destination, chr(10) ORDER BY source, destination) AS t FROM rel GROUP BY k)
       SELECT r.user_id, r.qa_idx, r.block_id, 'Block ' || r.block_id || ':' || chr(10) || 'Events:' || chr(10) || '- ' || r.block_id || CASE WHEN o.t IS NULL THEN '' ELSE chr(10) || 'Similar events:' || chr(10) || o.t END ||
         CASE WHEN rr.t IS NULL THEN '' ELSE chr(10) || 'Relations:' || chr(10) || rr.t END AS text
       FROM ranked r LEFT JOIN o ON o.user_id = r.user_id AND o.a_id = r.block_id LEFT JOIN rr ON r.user_id = '0' AND rr.k = r.block_id WHERE r.rank <= 3""",
)
def m18(spark, d):
    b = blocks(spark, d)
    ranked = rank.tiled_top_k(questions(spark, d), b, 3)
    pay = gr.block_payload(ranked, b.select("user_id", "block_id", F.col("block_id").alias("event_id")), _edges(spark, d).withColumn("score", F.lit("x")), relations(spark, d))
    return pay.select(*KEY, "block_id", cx.legacy_block_text(F.col("block_id"), F.col("events"), F.col("similar_events"), F.col("relations")).alias("text"))


# ---- remaining joins, set operations, projections --------------------------------------------------


@query("j3_missing_vectors", with_sql(BLK, QRY) + "SELECT q.user_id, q.qa_idx, count(*) FILTER (b.block_id % 9 = 0) AS n_missing FROM qry q JOIN blk b USING (user_id) GROUP BY ALL")
def j3(spark, d):
    b = blocks(spark, d)
    missing = rank.missing_vectors(b, b.filter("block_id % 9 <> 0"))
    return questions(spark, d).select(*KEY).join(missing, "user_id").select(*KEY, "n_missing")


@query(
    "j3_unscored_blocks_rank_last",
    with_sql(BLK, QRY)
    + """, s AS (SELECT q.user_id, q.qa_idx, b.block_id, CASE WHEN b.block_id % 9 = 0 THEN -1.0 ELSE round(list_cosine_similarity(q.qemb, b.emb), 9) END AS score FROM qry q JOIN blk b USING (user_id))
       SELECT user_id, qa_idx, block_id, CAST(row_number() OVER (PARTITION BY user_id, qa_idx ORDER BY score DESC, block_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""",
)
def j3_ranked(spark, d):
    b = blocks(spark, d)
    vec = b.filter("block_id % 9 <> 0").select("user_id", "block_id", "embedding")
    return rank.tiled_top_k(questions(spark, d), b.drop("embedding").join(vec, ["user_id", "block_id"], "left"), 10).select(*KEY, "block_id", "rank")


@query("j7_prediction_to_question", with_sql(QRY) + "SELECT e.event_id, q.intent FROM events e JOIN qry q ON q.qa_idx = e.event_id")
def j7(spark, d):
    q = questions(spark, d).select("qa_idx", "intent")
    return table(spark, d, "events").select("event_id", F.col("event_id").alias("qa_idx")).join(q, "qa_idx").select("event_id", "intent")


@query("j9_seed_exclusion", with_sql(BLK, QRY, SCORED, EDGES, SEEDS) + "SELECT DISTINCT s.user_id, s.qa_idx, two.t AS event_id FROM seeds s JOIN two ON s.user_id = two.user_id AND s.event_id = two.f WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.user_id = s.user_id AND x.qa_idx = s.qa_idx AND x.event_id = two.t)")
def j9(spark, d):
    return gr.reachable(_seeds(spark, d), _edges(spark, d), 1, 0.3, ranked=False).select(*KEY, "event_id")


@query("s5_seed_and_expansion_union", with_sql(BLK, QRY, SCORED, EDGES, SEEDS, REACH) + "SELECT user_id, qa_idx, event_id FROM seeds UNION SELECT user_id, qa_idx, event_id FROM re")
def s5(spark, d):
    s = _seeds(spark, d)
    # seeds are distinct and what is reached holds none of them
    return s.union(gr.reachable(s, _edges(spark, d), 2, 0.3, ranked=False).select(*KEY, "event_id"))


@query("s6_a4_merge_runs", "SELECT printf('%08x', CAST(user_id AS INTEGER)) AS user_id, count(*) AS n FROM events WHERE user_id % 3 <> 0 OR event_type = 'click' OR user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click') GROUP BY 1")
def s6(spark, d):
    e = table(spark, d, "events").select(F.lpad(F.lower(F.hex("user_id")), 8, "0").alias("user_id"), "event_type", (F.col("user_id") % 3 == 0).alias("z"), "event_id")
    first = e.filter("event_type <> 'click' or not z").drop("z")
    second = e.filter("event_type = 'click' and z").drop("z")
    junk = e.filter("event_type = 'view'").withColumn("user_id", F.lit("not-hex!")).drop("z")
    return scans.merge_runs([first.union(junk), second]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c21_c22_category_and_keywords",
    """SELECT p_partkey, list_contains(['economy', 'promo'], lower(p_type)) AS any_category, (CASE WHEN split_part(p_name, ' ', 1) = 'red' THEN 1 ELSE 0 END + CASE WHEN list_contains(string_split(p_name, ' '), 'ring') THEN 1 ELSE 0 END) / 3 >= 0.3 AS keywords FROM part""",
)
def c21(spark, d):
    ask = tx.word_set(F.lit("the red ring of brass"))
    return table(spark, d, "part").select(
        "p_partkey", pools.any_category(F.array("p_type"), F.array(F.lit("Economy"), F.lit("PROMO"))).alias("any_category"),
        pools.keyword_overlap(ask, tx.word_set(F.col("p_name"))).alias("keywords"),
    )


@query(
    "f5_event_type_score",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 3 THEN 1.0 WHEN o_orderkey % 3 = 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 1.0 ELSE 0.7 END WHEN o_orderkey % 3 = 1 THEN CASE o_orderkey % 4 WHEN 1 THEN 1.0 ELSE 0.85 END ELSE 0.7 END AS DOUBLE) AS score FROM orders""",
)
def f5(spark, d):
    k = F.col("o_orderkey")
    have = F.element_at(F.array(F.array(F.lit("OCCURRENCE")), F.array(F.lit("STATE")), F.array(F.lit("X"))), (k % 3 + 1).cast("int"))
    intent = F.element_at(F.array(F.lit("WINDOW"), F.lit("AS_OF"), F.lit("STATIC"), F.lit("PLANNING")), (k % 4 + 1).cast("int"))
    from timeweave.plans.annotate import target_types

    return table(spark, d, "orders").select("o_orderkey", event_type_score(have, target_types(intent), intent).alias("score"))


@query("b4_user_remap", "SELECT event_id, event_type || CASE WHEN event_id % 2 = 0 THEN '_' ELSE '' END || (user_id % 3) AS user_id FROM events")
def b4(spark, d):
    """Even events come in files of three users, odd ones in files of one."""
    user = (F.col("user_id") % 3).cast("string")
    source = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.concat("event_type", user))
    r = table(spark, d, "events").select("event_id", source.alias("source_id"), user.alias("user_id"))
    return scans.remap_users(r, "source_id").select("event_id", "user_id")


@query("b5_a5_question_explode", "SELECT CAST(conv_id AS VARCHAR) AS user_id, CAST(turn AS INTEGER) AS qa_idx, CASE WHEN turn % 5 = 0 THEN NULL ELSE CAST(turn % 5 + 1 AS INTEGER) END AS category FROM conversations WHERE turn % 5 <> 4")
def b5(spark, d):
    item = F.struct("turn", F.struct(F.when(F.col("turn") % 5 != 0, (F.col("turn") % 5 + 1).cast("int")).alias("category")).alias("q"))
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("user_id")).agg(
        F.transform(F.sort_array(F.collect_list(item)), lambda x: x["q"]).alias("qa")
    )
    return scans.explode_questions(c)


@query("b6_first_conversations", "SELECT conv_id, turn FROM conversations WHERE conv_id < 7")
def b6(spark, d):
    return scans.first_conversations(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", 7)


@query(
    "b7_b9_retrieval_texts",
    """SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand || ' | ' || p_type AS full_text, p_type || ' ' || p_brand AS short_text, p_name || ' ' || p_brand || ' | ' || p_type || ' ' || p_type AS baseline_text FROM part""",
)
def b7(spark, d):
    ev = F.array(F.col("p_brand"), F.lit(""), F.col("p_type"), F.lit(None).cast("string"))
    return table(spark, d, "part").select(
        "p_partkey", tx.retrieval_text(F.col("p_name"), F.col("p_type"), ev).alias("full_text"), tx.retrieval_text(None, F.col("p_type"), ev, 1).alias("short_text"),
        tx.retrieval_text(F.col("p_name"), F.col("p_type"), ev, None, topic_last=True).alias("baseline_text"),
    )


@query("b1_b3_canonical_keys", """SELECT CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE event_id END AS block_id,
    CASE event_id % 3 WHEN 0 THEN '2024-01-01' WHEN 1 THEN '2024-02-01' ELSE 'Unknown' END AS start, CASE event_id % 3 WHEN 0 THEN '2024-01-01' WHEN 1 THEN '2024-03-01' ELSE 'Unknown' END AS end_ FROM events""")
def b1(spark, d):
    i = F.col("event_id")
    raw = table(spark, d, "events").select("user_id", F.when(i % 3 == 0, i).alias("block_id"), F.when(i % 3 == 1, i).alias("box_id"), i)
    null = F.lit(None).cast("string")
    start, end = scans.event_bounds(F.when(i % 3 == 0, "2024-01-01"), F.when(i % 3 == 1, "2024-02-01"), F.when(i % 3 == 0, F.lit("")), F.when(i % 3 == 1, "2024-03-01").otherwise(null))
    keyed = raw.withColumn("start", start).withColumn("end_", end)
    return scans.with_canonical_keys(keyed).select("user_id", "block_id", "start", "end_")


@query("b10_b11_ranked_windows", with_sql(BLK, QRY, TOP5) + "SELECT r.user_id, r.qa_idx, r.block_id, r.rank, coalesce(event_start, session_start) AS block_start, coalesce(event_end, session_end) AS block_end FROM ranked r JOIN blk USING (user_id, block_id) WHERE rank <= 5")
def b10(spark, d):
    b = blocks(spark, d)
    win = b.select("user_id", "block_id", F.coalesce("event_start", "session_start").alias("block_start"), F.coalesce("event_end", "session_end").alias("block_end"))
    return rank.tiled_top_k(questions(spark, d), b, 5).drop("score").join(win, ["user_id", "block_id"]).select(*KEY, "block_id", "rank", "block_start", "block_end")


@query("b12_category_gate", with_sql(BLK, QRY, TOP5, TXT, PACK) + "SELECT user_id, qa_idx, CASE WHEN qa_idx % 5 IN (1, 3) THEN strlen(context) + 1 ELSE 0 END > 0 AS has_graph FROM pk")
def b12(spark, d):
    packed = _packed(spark, d).select(*KEY, (F.col("qa_idx") % 5).cast("int").alias("category"), "context")
    graph = questions(spark, d).select(*KEY, F.lit("Relations:").alias("graph_text"))
    return cx.full_context(packed, graph, (1, 3)).select(*KEY, F.col("context").endswith("Relations:").alias("has_graph"))


@query("a7_latest_traces", "SELECT CAST(user_id AS VARCHAR) AS user_id, event_id % 20 AS block_id, max(event_id) AS newest FROM events GROUP BY ALL")
def a7(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").cast("string").alias("user_id"), F.array(F.col("event_id") % 20, F.col("event_id") + 1000000).alias("box_ids"), "event_id")
    last = scans.latest_traces(t, "event_id").filter("block_id < 20")
    return last.select("user_id", "block_id", (F.col("box_ids")[1] - 1000000).alias("newest"))


@query("a8_ground_truth", "SELECT CAST(conv_id AS VARCHAR) AS qa_idx, turn AS block_id FROM conversations")
def a8(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"))
    one = F.concat(F.lit('{"ground_truth": {"'), "conv_id", F.lit('": {"block_ids": ['), F.array_join("t", ","), F.lit("]}}}"))
    return scans.ground_truth(c.select(one.alias("value")))


@query("a9_event_vectors", with_sql(BLK) + "SELECT user_id, CAST(block_id AS VARCHAR) AS event_id, CAST(len(emb) AS INTEGER) AS dims FROM blk WHERE block_id % 2 = 0")
def a9(spark, d):
    b = blocks(spark, d)
    v = b.select("user_id", F.concat(F.when(F.col("block_id") % 2 == 0, "graph_event_").otherwise("qa_"), "block_id").alias("owner_key"), F.lit("event").alias("field"), "embedding")
    return scans.event_vectors(v).select("user_id", "event_id", F.size("embedding").alias("dims"))


@query("a6_question_files", "SELECT printf('%08x', CAST(c_custkey AS INTEGER)) AS user_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey % 2 = 0")
def a6(spark, d):
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    files = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, hexed("c_custkey")).otherwise("notes").alias("source_id"))
    return scans.question_files(files, table(spark, d, "orders").select(hexed("o_custkey").alias("user_id"))).select("user_id")


@query("a14_unprocessed_files", "SELECT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def a14(spark, d):
    p = table(spark, d, "pages").select("url", "page_id")
    return scans.unprocessed(p.select("url"), p.filter("page_id % 3 = 0"), "url")
