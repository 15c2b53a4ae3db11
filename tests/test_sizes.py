"""Plans and tasks that stay bounded when tables grow."""

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from timeweave.catalog import registry
from timeweave.functions import time_phrases
from timeweave.functions.time_phrases import NEEDS, PHRASE_MATCHERS, Options, first_match
from timeweave.plans import retrieval
from timeweave.plans.annotate import intent_of


def test_annotation_meets_no_join_in_its_plan(spark, monkeypatch):
    """Conditions of a join above the matchers were pushed through them, one copy of all at every mention."""

    class Cut(Exception):
        pass

    def first_cut(df):
        raise Cut(df._jdf.queryExecution().analyzed().toString())

    monkeypatch.setattr(retrieval, "cut_lineage", first_cut)
    q = spark.sql("SELECT 'u' AS user_id, 1L AS qa_idx, 'What happened in May 2024?' AS question, date'2024-06-01' AS base_day")
    b = spark.sql("SELECT 'u' AS user_id, 1L AS block_id, array(1.0) AS embedding, date'2024-05-02' AS event_start, date'2024-05-02' AS event_end")
    v = spark.sql("SELECT 'u' AS user_id, 'k' AS text_key, array(1.0) AS embedding")
    try:
        retrieval.answer_context(q, b, b.select("user_id", "block_id", "embedding"), v)
    except Cut as plan:
        assert "between" in str(plan) and "Join" not in str(plan)
    else:
        raise AssertionError("annotation was not cut")


def test_costly_scans_are_dealt_out_by_rows(spark, tmp_path, monkeypatch):
    spark.range(0, 1000, 1, 1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(registry, "SPREAD_ROWS", 100, raising=False)
    dealt = registry.table(spark, str(tmp_path), "orders", spread=True)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 1000
    assert registry.table(spark, str(tmp_path), "orders").rdd.getNumPartitions() < 10


def test_needed_words_lose_no_match(spark):
    texts = [
        "from 2023-01-02 to 3 May 2024", "by May 2024", "12/05/2024", "Q3 2021", "H2 2020", "last half of 2020", "mid 2021", "end of 2022", "fall 2021",
        "the 1990s", "June 1999", "in June", "2021-04", "last quarter", "a year ago", "few days", "the past few days", "this weekend", "next Tue", "tonight",
        "this  morning", "tomorrow", "a while back", "lately", "circa 1999", "NEXT WEEK", "20 weeks AGO", "", "order 1234", None,
    ]
    base = F.lit("2024-06-15").cast("date")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    each = F.coalesce(*[m(F.col("t"), base, Options()) for m in PHRASE_MATCHERS.values()])
    rows = df.select("t", first_match(F.col("t"), base, Options()).alias("a"), each.alias("b")).collect()
    assert len(NEEDS) == len(PHRASE_MATCHERS) - 1
    assert all(r.a == r.b for r in rows) and sum(r.a is not None for r in rows) >= 24


def _searches(pattern, text="yesterday"):
    """How often a phrase's pattern is searched for at most: its places in the expression of all matchers."""
    match = first_match(F.col("t"), F.lit("2024-06-15").cast("date"), Options())
    spark = SparkSession.getActiveSession()
    plan = spark.createDataFrame([(text,)], "t string").select(match.alias("m"))
    return plan._jdf.queryExecution().optimizedPlan().toString().count(pattern)


def _tasks_of(spark, tmp_path, monkeypatch, name):
    """Rows of each task of a query over 1,000 orders when a task may take 100."""
    from timeweave.catalog import load_all

    orders = spark.range(0, 1000, 1, 1).selectExpr("id AS o_orderkey", "id AS o_custkey", "timestamp'1995-03-07' AS o_orderdate")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(registry, "SPREAD_ROWS", 100, raising=False)
    out = load_all().QUERIES[name](spark, str(tmp_path))
    return [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]


def test_relative_spans_run_in_bounded_tasks_and_search_found_words(spark, tmp_path, monkeypatch):
    rows = _tasks_of(spark, tmp_path, monkeypatch, "t28_t29_relative_spans")
    assert sum(rows) == 1000 and max(rows) <= 125
    assert _searches(time_phrases.RELATIVE_SPAN) <= 5 and _searches(time_phrases.RELATIVE_WEEKDAY) <= 5


def test_near_days_run_in_bounded_tasks_and_search_found_words(spark, tmp_path, monkeypatch):
    rows = _tasks_of(spark, tmp_path, monkeypatch, "t30_t32_near_days")
    assert sum(rows) == 1000 and max(rows) <= 125
    assert _searches(time_phrases.NEAR_DAY) <= 3 and _searches(time_phrases.RECENTLY) <= 3


def test_directives_run_in_bounded_tasks_and_lower_a_question_once(spark, tmp_path, monkeypatch):
    rows = _tasks_of(spark, tmp_path, monkeypatch, "t37_t44_directives")
    assert sum(rows) == 1000 and max(rows) <= 125
    plan = spark.createDataFrame([("Was I there?",)], "t string").select(intent_of(F.col("t")).alias("i"))
    assert plan._jdf.queryExecution().analyzed().toString().count("lower(") == 1 and plan.first().i == "AS_OF"


def test_relaxed_months_run_in_bounded_tasks_and_search_found_words(spark, tmp_path, monkeypatch):
    rows = _tasks_of(spark, tmp_path, monkeypatch, "t26_relaxed_months")
    assert sum(rows) == 1000 and max(rows) <= 125
    assert _searches(time_phrases.N_AGO) <= 5 and _searches(time_phrases.LAST_N) <= 6


def test_facts_are_ranked_in_tiles_without_a_shuffle_of_pairs(spark):
    import numpy as np

    from timeweave.functions.text import content_key, fact_text
    from timeweave.operators.graph import best_facts, score_facts

    rng = np.random.default_rng(3)
    vec = rng.integers(-2, 3, size=(40, 3)).astype(float)
    q = spark.createDataFrame([("u", i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(12)], "user_id string, qa_idx long, embedding array<double>")
    # p0 owns half of the facts; one fact has no vector
    rel = spark.createDataFrame(
        [("u", f"p{0 if i % 2 else i % 5}", f"r{i:02d}", "a", "likes", f"d{i}", i) for i in range(40)],
        "user_id string, person string, relation_id string, source string, relationship string, destination string, n int",
    )
    key = content_key(fact_text(F.col("source"), F.col("relationship"), F.col("destination")))
    of = spark.createDataFrame([(i, vec[i].tolist()) for i in range(39)], "n int, embedding array<double>")
    v = rel.join(of, "n").select("user_id", key.alias("text_key"), "embedding")

    def cosine(a, b):
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(a @ b / size), 9) if size else 0.0

    asked, facts = q.collect(), rel.collect()
    pairs = [(x.qa_idx, f.person, f.relation_id, cosine(np.array(x.embedding), vec[f.n]) if f.n < 39 else -1.0) for x in asked for f in facts]
    got = score_facts(rel, q, v, columns=["person", "relation_id"]).collect()
    assert sorted((r.qa_idx, r.person, r.relation_id, round(r.query_similarity, 6) + 0.0) for r in got) == sorted((*p[:3], round(p[3], 6) + 0.0) for p in pairs)
    for k, bound in ((None, 100), (None, 6), (2, 6), (2, 100)):
        want = set()
        for i in range(12):
            for person in {f.person for f in facts}:
                own = sorted((p for p in pairs if p[:2] == (i, person) and p[3] >= 0.0), key=lambda p: (-p[3], p[2]))[:k]
                want |= {(i, person, p[2], n) for n, p in enumerate(own, 1)}
        got = best_facts(rel, q, v, k, 0.0, columns=[], facts_per_person=bound).collect()
        assert {(r.qa_idx, r.person, r.relation_id, r["rank"]) for r in got} == want and len(got) == len(want)


def test_score_summary_over_tiles(spark):
    import numpy as np

    from timeweave.operators.rank import score_summary

    rng = np.random.default_rng(5)
    vec = rng.normal(size=(30, 4))
    rows = [("u" if i < 29 else "alone", i, None if i % 13 == 0 else [0.0] * 4 if i % 7 == 0 else vec[i].tolist()) for i in range(30)]
    b = spark.createDataFrame(rows, "user_id string, block_id long, embedding array<double>")
    q = spark.createDataFrame([(u, i, vec[i].tolist()) for u, i, _ in rows], "user_id string, qa_idx long, embedding array<double>")
    unit = lambda x: np.asarray(x) / (np.linalg.norm(x) or 1.0)
    got = {r.qa_idx: r for r in score_summary(q, b, items_per_tile=7, questions_per_tile=5).collect()}
    assert set(got) == set(range(29))
    for i in got:
        s = [-1.0 if e is None else round(float(unit(vec[i]) @ unit(e)), 9) for u, j, e in rows if u == "u" and j != i]
        assert np.allclose([got[i].best, got[i].worst, got[i]["mean"]], [max(s), min(s), sum(s) / len(s)], atol=1e-8)


def test_pair_scores_over_tiles(spark):
    import numpy as np

    from timeweave.operators.graph import score_events

    rng = np.random.default_rng(7)
    vec = rng.normal(size=(30, 4))
    e = spark.createDataFrame([("u", i, None if i == 3 else [0.0] * 4 if i == 4 else vec[i].tolist()) for i in range(28)], "user_id string, event_id long, embedding array<double>")
    q = spark.createDataFrame([("u", i, vec[i].tolist()) for i in range(10)], "user_id string, qa_idx long, embedding array<double>")
    # events 28 and 29 have no row, question 10 neither
    asked = [("u", i, j, f"h{i + j}") for i in range(11) for j in range(30) if (i + j) % 3]
    pairs = spark.createDataFrame(asked, "user_id string, qa_idx long, event_id long, note string")
    found = score_events(pairs, q, e)
    got = {(r.qa_idx, r.event_id): (r.note, r.query_similarity) for r in found.collect()}
    assert found.columns == [*pairs.columns, "query_similarity"] and len(got) == sum(a[1] < 10 for a in asked)
    for (i, j), (note, score) in got.items():
        want = -1.0 if j in (3, 28, 29) else 0.0 if j == 4 else vec[i] @ vec[j] / np.linalg.norm(vec[i]) / np.linalg.norm(vec[j])
        assert note == f"h{i + j}" and abs(score - want) < 1e-8
    # no vector meets a pair in a join
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert all("event_id" not in line for line in joins)


def test_reach_walks_in_batches_without_a_shuffle_of_reached_events(spark, monkeypatch):
    import random

    from timeweave.operators import graph

    rnd = random.Random(5)
    names = [f"e{i:02d}" for i in range(30)]
    # e00 is a hub, some pairs come both ways and twice, one event of another user has the same name
    raw = [("u", "e00", n, 0.9 - i / 100) for i, n in enumerate(names[1:])] + [("u", *rnd.sample(names, 2), rnd.randint(1, 9) / 10) for _ in range(40)] + [("v", "e01", "e02", 0.6)]
    own = [("u", q, e) for q in range(12) for e in rnd.sample(names[1:], 1 + q % 3)] + [("v", 0, "e01"), ("w", 1, "e01")]
    edges = spark.createDataFrame(raw, "user_id string, a_id string, b_id string, score double")
    seeds = spark.createDataFrame(own, "user_id string, qa_idx long, event_id string")
    best = {}
    for u, a, b, s in raw:
        if s >= 0.3:
            best[u, a, b] = best[u, b, a] = max(s, best.get((u, a, b), 0))
    for hops, limit, per_batch, per_list in ((1, None, 100, 100), (2, None, 4, 5), (2, 7, 100, 5), (3, None, 4, 100)):
        want = set()
        for user, q in {(u, q) for u, q, _ in own}:
            start = {e for u, x, e in own if (u, x) == (user, q)}
            front, seen = dict.fromkeys(start, 9.0), {}
            for hop in range(1, hops + 1):
                step = {}
                for (u, a, b), s in best.items():
                    if u == user and a in front:
                        step[b] = max(step.get(b, 0), min(front[a], s))
                front = step
                for e, p in step.items():
                    first, top = seen.get(e, (hop, 0))
                    seen[e] = (first, max(top, p))
            rows = sorted((h, -p, e) for e, (h, p) in seen.items() if e not in start)[:limit]
            want |= {(user, q, e, h, -p, i) for i, (h, p, e) in enumerate(rows, 1)}
        monkeypatch.setattr(graph, "EDGES_PER_LIST", per_list)
        got = graph.reachable(seeds, edges, hops, 0.3, limit, seeds_per_batch=per_batch)
        assert {tuple(r) for r in got.select("user_id", "qa_idx", "event_id", "min_hop", "similarity_score", "rank").collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("FlatMapGroupsInArrow") < plan.index("Aggregate")


def test_interval_join_gets_tasks_by_the_pairs_it_tries(spark):
    from timeweave.operators.intervals import overlap_join

    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), c.cast("int"))
    left = spark.range(600).select(F.lit("u").alias("k"), F.col("id").alias("i"), day(F.col("id") % 20).alias("s"), day(F.col("id") % 20 + 2).alias("e"))
    right = left.select("k", F.col("i").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    plain = overlap_join(left, right, ("s", "e"), ("s2", "e2"), ["k"], 7)
    spread = overlap_join(left, right, ("s", "e"), ("s2", "e2"), ["k"], 7, rows_per_tile=32, pairs_per_task=5_000)
    per_task = spread.groupBy(F.spark_partition_id()).count().collect()
    # 5 kinds of days of 30 rows meet each of 20 but at the ends
    want = sum(900 for a in range(20) for b in range(20) if abs(a - b) <= 2)
    assert spread.count() == plain.count() == sum(r["count"] for r in per_task) == want
    assert sorted((r.i, r.j) for r in spread.select("i", "j").collect()) == sorted((r.i, r.j) for r in plain.select("i", "j").collect())
    assert len(per_task) > 12 and max(r["count"] for r in per_task) < want / 4
    assert overlap_join(left, right.limit(0), ("s", "e"), ("s2", "e2"), ["k"], 7, pairs_per_task=10).count() == 0


def test_anchor_blocks_are_merged_without_comparing_the_kept_pairs(spark, tmp_path):
    from timeweave.catalog import load_all

    rows = [(i, i % 2, [float(i % 3), 1.0, float(i % 7)]) for i in range(150)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    merged = load_all().QUERIES["an9_merge_anchor_blocks"](spark, str(tmp_path))
    got = [tuple(r) for r in merged.select("user_id", "qa_idx", "block_id").collect()]
    assert len(got) == len(set(got)) > 300
    node = merged._jdf.queryExecution().optimizedPlan()
    while node.nodeName() == "Project":
        node = node.children().head()
    assert node.nodeName() == "Union"


def test_bleu_counts_tokens_where_the_row_is(spark):
    import math
    from collections import Counter

    from timeweave.operators.answers import bleu1

    rows = [
        (1, "the the the cat", ["the cat the", "a cat"]), (2, "x\u00a0y, z", ["x y\u00a0", ", z z z z z"]), (3, None, ["a"]), (4, "a b", []), (5, "a b", None),
        (6, "w " * 30_000, ["w " * 20_000 + "v", None]), (7, "!!", [""]), (8, "a b c", ["a b", "a b c d"]),
    ]
    tokens = {1: (4, [3, 2], 3), 2: (5, [3, 6], 5), 6: (30_000, [20_001, 0], 20_000), 7: (2, [0], 0), 8: (3, [2, 4], 3)}
    want = {3: 0.0}
    for key, (n, refs, same) in tokens.items():
        near = min((abs(r - n), r) for r in refs)[1]
        want[key] = same / n * (1.0 if n > near else math.exp(1 - near / n)) if same else 0.0
    scored = bleu1(spark.createDataFrame(rows, "k int, pred string, golds array<string>"), ["k"])
    assert Counter({r.k: round(r.bleu, 9) for r in scored.collect()}) == Counter({k: round(v, 9) for k, v in want.items()})
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_a_tile_holds_no_matrix_of_all_its_pairs():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from timeweave.operators import rank

    rng = np.random.default_rng(1)
    q = pd.DataFrame({"ask_user_id": "u", "ask_qa_idx": np.arange(512), "ask_embedding": list(rng.integers(-3, 4, (512, 8)).astype(float))})
    b = pd.DataFrame({"user_id": "u", "block_id": np.arange(4096), "embedding": list(rng.integers(-3, 4, (4096, 8)).astype(float)), "parts": list(rng.integers(-3, 4, (4096, 16)).astype(float))})
    tracemalloc.start()
    out = rank._tile_function(30, False, False, None, False, True)(q, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    unit = lambda rows: rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-300)
    asked, own = unit(np.stack(q["ask_embedding"])), unit(np.stack(b["embedding"]))
    parts = unit(np.stack(b["parts"]).reshape(-1, 2, 8))
    for i in (0, 7, 511):
        score = np.round(own @ asked[i], 9)
        best = np.lexsort((np.arange(4096), -score))[:30]
        mine = out[out["qa_idx"] == i]
        assert list(mine["block_id"]) == list(best) and np.allclose(mine["score"], score[best])
        assert np.allclose(mine["part_score"], (parts[best] @ asked[i]).max(axis=1))
    assert peak < 512 * 4096 * 8


def test_scores_in_context_lines_are_printed_from_their_exact_value(spark):
    from timeweave.operators.context import event_line

    scores = [j / 20000 for j in range(-20000, 20001)] + [0.305450001, 0.0, -1e-9, 1234.00005]
    text = lambda c: F.lit(c).cast("string")
    line = event_line(text("x"), text("1"), F.col("s"), F.lit(None).cast("double"), text(""))
    graph = event_line(text("x"), text("1"), F.lit(None).cast("double"), F.col("s"), text(""))
    got = spark.createDataFrame([(s,) for s in scores], "s double").select("s", line.alias("line"), graph.alias("graph")).collect()
    assert {r.line for r in got if r.s == 0.30545} == {"- [query_score=0.3054] x"}
    assert [(r.line, r.graph) for r in got] == [(f"- [query_score={r.s:.4f}] x", f"- [graph_score={r.s:.4f}] x") for r in got]


def test_blocks_are_copied_to_few_batches_of_questions(spark, monkeypatch):
    import pandas as pd

    from timeweave.operators import rank

    def count_tile(*_):
        return lambda q, b: pd.DataFrame({"user_id": ["u"], "qa_idx": [len(q)], "block_id": [len(b)], "score": [0.0]})

    monkeypatch.setattr(rank, "_tile_function", count_tile)
    vec = F.array(F.lit(1.0), F.col("id").cast("double"))
    q = spark.range(6_000).select(F.lit("u").alias("user_id"), F.col("id").alias("qa_idx"), vec.alias("embedding"))
    b = spark.range(100).select(F.lit("u").alias("user_id"), F.col("id").alias("block_id"), vec.alias("embedding"))
    tiles = rank.tiled_scores(q, b, 5).collect()
    assert sum(t.block_id for t in tiles) <= 200 and sum(t.qa_idx for t in tiles) == 6_000
    # tiles that emit all their pairs stay small
    assert all(t.qa_idx * t.block_id <= 2_048 * 512 for t in rank.tiled_scores(q, b).collect())


def test_no_vector_is_in_a_cut_of_the_answer_plan(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(retrieval, "cut_lineage", lambda df: cuts.append(df.columns) or df.localCheckpoint())
    day = "make_date(2024, 5, CAST(id AS INT)) AS "
    b = spark.range(1, 7).selectExpr(
        "'u' AS user_id", "id AS block_id", "array(1.0D, CAST(id AS DOUBLE)) AS embedding", *(day + c for c in ("session_start", "session_end", "event_start", "event_end"))
    )
    # annotated already: by date, by anchor, without a constraint, by date; the same text comes twice, two questions have no vector
    asked = [(0, "a", "POINT", 3, None), (1, "b", "ANCHOR", None, "AFTER"), (2, "c", "NONE", None, None), (3, "d", "POINT", 4, None)]
    q = spark.createDataFrame(asked, "qa_idx long, rewritten_query string, tc_type string, day int, anchor_relation string").selectExpr(
        "'u' AS user_id", "*", "make_date(2024, 5, day) AS tc_start", "CAST(NULL AS DATE) AS tc_end", "'EVENT' AS axis", "'WINDOW' AS intent"
    )
    monkeypatch.setattr(retrieval, "directed", lambda df: df)
    v = q.filter("qa_idx < 2").select("user_id", retrieval.content_key(F.col("rewritten_query")).alias("text_key"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    got = retrieval.answer_context(q, b, b.select("user_id", "block_id", "embedding"), v.union(v), k=2).collect()
    assert len(cuts) == 2 and all("embedding" not in c for c in cuts)
    found = {(r.qa_idx, r["rank"]): r.block_id for r in got}
    assert found[0, 1] == 3 and (0, 2) not in found and found[1, 1] == 2 and found[2, 1] == 1 and found[2, 2] == 2
    assert found[3, 1] == 4 and (3, 2) not in found and len(found) == len(got)


def test_facts_are_copied_to_few_batches_and_rows_flow_out(spark, monkeypatch):
    from timeweave.operators import rank

    sizes, counted = {}, rank.slice_counts
    monkeypatch.setattr(rank, "slice_counts", lambda df, key, rows, name="n_slices": sizes.update({name: rows}) or counted(df, key, rows, name))
    vec = lambda: F.array(F.lit(1.0), F.col("id").cast("double"))
    q = spark.range(3_000).select(F.lit("u").alias("user_id"), F.col("id").alias("qa_idx"), vec().alias("embedding"))
    f = spark.range(200).select(F.lit("u").alias("user_id"), F.concat(F.lit("f"), "id").alias("relation_id"), vec().cast("array<float>").alias("embedding"))
    got = rank.tiled_rows(q, f, "relation_id").groupBy("user_id", "relation_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("qa_idx").alias("d"), F.min("score").alias("low")).collect()
    assert len(got) == 200 and all(r.n == r.d == 3_000 and r.low > 0 - 1e-9 for r in got)
    # 3,000 questions are one batch: every fact is shuffled once
    assert -(-3_000 // sizes["n_batches"]) == 1 and sizes["n_slices"] * sizes["n_batches"] > 2_048 * 256


def test_reached_events_are_scored_where_they_are_found(spark):
    import random

    from timeweave.operators import context, graph

    rnd = random.Random(11)
    vec = {f"e{i:02d}": [rnd.gauss(0, 1) for _ in range(4)] for i in range(30)} | {"e03": None, "e04": [0.0] * 4}
    names = sorted(vec)
    edges = spark.createDataFrame([("u", *rnd.sample(names, 2), rnd.randint(3, 9) / 10) for _ in range(60)] + [("v", "e01", "e02", 0.6)], "user_id string, a_id string, b_id string, score double")
    seeds = spark.createDataFrame([("u", q, e) for q in range(12) for e in rnd.sample(names, 2)] + [("v", 0, "e01")], "user_id string, qa_idx long, event_id string")
    # one event has no row, question 11 neither, and user v has no events
    events = spark.createDataFrame([("u", n, v, f"text {n}") for n, v in vec.items() if n != "e29"], "user_id string, event_id string, embedding array<float>, note string")
    q = spark.createDataFrame([("u", i, [rnd.gauss(0, 1) for _ in range(4)] if i != 5 else None) for i in range(11)] + [("v", 0, [1.0] * 4)], "user_id string, qa_idx long, embedding array<double>")
    reach = graph.reachable(seeds, edges, 2, 0.3, ranked=False).withColumnRenamed("similarity_score", "graph_similarity_score")
    apart = graph.attach_events(graph.score_events(reach, q, events), events.drop("embedding"))
    columns = ["user_id", "qa_idx", "event_id", "min_hop", "graph_similarity_score", "note"]
    want = {tuple(r[c] for c in columns): r.query_similarity for r in apart.collect()}
    for per_batch in (1_000, 4):
        found = graph.scored_expansion(seeds, edges, q, events, 2, 0.3, seeds_per_batch=per_batch)
        flat = found.select("user_id", "qa_idx", F.inline("events"))
        got = flat.collect()
        assert {tuple(r[c] for c in columns) for r in got} == set(want) and len(got) == len(want) > 50
        assert all(abs(r.query_similarity - want[tuple(r[c] for c in columns)]) < 2e-9 for r in got)
        for r in found.collect():
            assert [(-e.query_similarity, e.event_id) for e in r.events] == sorted((-e.query_similarity, e.event_id) for e in r.events)
            assert [e["rank"] for e in r.events] == list(range(1, len(r.events) + 1))
    # nothing above the walk shuffles or joins a reached event
    plan = flat.groupBy().count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("FlatMapGroupsInArrow")] and "Window" not in plan
    # counts and the cut at a score
    flat_stats = graph.context_events(apart, 0.1)[1].collect()
    assert {tuple(r[c] for c in ("user_id", "qa_idx", "total", "kept")) for r in graph.context_counts(found, 0.1).collect()} == {tuple(r[c] for c in ("user_id", "qa_idx", "total", "kept")) for r in flat_stats}
    kept = graph.scored_expansion(seeds, edges, q, events, 2, 0.3, 0.1)
    assert sum(len(r.events) for r in kept.collect()) == sum(r.kept for r in flat_stats)
    # the text of an array is that of its rows
    rows = graph.context_events(apart, 0.1)[0]
    line = lambda note: F.when(~note.endswith("7"), F.concat(F.lit("- "), note))
    whole = {(r.qa_idx, r.t) for r in context.section(rows, line(F.col("note")), ["rank"], "Head:", "t").collect()}
    assert {(r.qa_idx, r.t) for r in kept.select("qa_idx", context.listed(F.col("events"), lambda e: line(e["note"]), "Head:").alias("t")).collect() if r.t} == whole


def test_facts_of_a_question_come_out_as_one_row_without_a_shuffle(spark):
    import numpy as np

    from timeweave.functions.text import content_key, fact_text
    from timeweave.operators import context, graph

    rng = np.random.default_rng(9)
    q = spark.createDataFrame([(u, i, rng.normal(size=3).tolist()) for i in range(15) for u in ("u", "v", "none")], "user_id string, qa_idx long, embedding array<double>")
    rel = spark.createDataFrame(
        [(u, f"p{i % 4}", f"r{i:02d}", f"a{i}", "live_in", f"d{i}", rng.normal(size=3).tolist()) for u, n in (("u", 30), ("v", 9)) for i in range(n)],
        "user_id string, person string, relation_id string, source string, relationship string, destination string, embedding array<float>",
    )
    key = content_key(fact_text(F.col("source"), F.col("relationship"), F.col("destination")))
    v, rel = rel.select("user_id", key.alias("text_key"), "embedding"), rel.drop("embedding")
    columns = ["source", "relationship", "destination", "fact_text"]
    rows = graph.best_facts(rel, q, v, 3, 0.5, columns)
    want = {tuple(r[c] for c in ("user_id", "qa_idx", "person", "relation_id", "rank")) for r in rows.collect()}
    profiles = {(r.user_id, r.qa_idx): r.profiles_text for r in context.profile_section(rows, F.lit("")).collect()}
    for bound in (100, 10, 5):
        found = graph.best_fact_lists(rel, q, v, 3, 0.5, columns, facts_per_user=bound)
        got = found.select("*", context.profiles_of(F.col("facts"), F.lit("")).alias("text")).collect()
        assert len(got) == 45 and {(r.user_id, r.qa_idx, f.person, f.relation_id, f["rank"]) for r in got for f in r.facts or []} == want
        assert {(r.user_id, r.qa_idx): r.text for r in got if r.text} == profiles
    # questions without facts are there too
    assert len(profiles) < 45 and all(not r.facts for r in got if r.user_id == "none")
    plan = graph.best_fact_lists(rel, q, v, 3, 0.5, columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan[: plan.index("Join")] and "Aggregate" not in plan[: plan.index("FlatMapGroupsInArrow")]
