"""Pools, tiles, interval joins and positions against brute force."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from timeweave.operators import pools, rank
from timeweave.operators.intervals import open_counts, overlap_join
from timeweave.operators.skew import pool_join, slice_counts
from timeweave.operators.stats import exact_quantile, quantiles
from timeweave.plans.retrieval import retrieve

DAY = dt.date(2024, 1, 1)


def make_tables(spark, seed=7, hot=300, cold=6, questions=40):
    """One user owns almost all blocks; some vectors and dates are missing or tied."""
    rng = random.Random(seed)
    users = ["hot"] * hot + [f"u{i % 5}" for i in range(cold * 5)]
    blocks, asks = [], []
    for i, user in enumerate(users):
        vec = None if i % 17 == 0 else [0.0] * 4 if i % 19 == 0 else [float(rng.randint(-2, 2)) for _ in range(4)]
        s = DAY + dt.timedelta(days=rng.randint(0, 60))
        e = None if i % 11 == 0 else s - dt.timedelta(days=rng.randint(-3, 9))
        blocks.append((user, i, vec, s, s + dt.timedelta(days=rng.randint(-2, 3)), e, e and e + dt.timedelta(days=rng.randint(0, 4))))
    for i in range(questions):
        kind = rng.choice(["RANGE", "POINT", "AFTER", "BEFORE", "NONE"])
        start = DAY + dt.timedelta(days=rng.randint(-20, 80))
        asks.append((
            "hot" if i % 3 else f"u{i % 5}", i, [float(rng.randint(-2, 2)) for _ in range(4)], kind,
            start if kind in ("RANGE", "POINT", "AFTER") else None, start + dt.timedelta(days=5) if kind in ("RANGE", "BEFORE") else None,
            rng.choice(["EVENT", "SESSION", "BOTH_UNION", "BOTH_INTERSECT"]), rng.choice(["WINDOW", "STATIC", "AS_OF"]),
        ))
    b = spark.createDataFrame(blocks, "user_id string, block_id long, embedding array<double>, session_start date, session_end date, event_start date, event_end date")
    q = spark.createDataFrame(asks, "user_id string, qa_idx long, embedding array<double>, tc_type string, tc_start date, tc_end date, axis string, intent string")
    return b, q, blocks, asks


def model_cosine(a, b):
    if a is None or b is None:
        return -1.0
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return 0.0 if n == 0 else round(float(np.dot(a, b) / n), 9)


def model_pool(ask, blocks):
    """Sequential model: dict-style filter with fallbacks."""
    user, _, _, kind, start, end, axis, intent = ask
    pool = [b for b in blocks if b[0] == user]
    if intent in ("STATIC", "PLANNING") or kind == "NONE":
        return pool

    def ok(lo, hi):
        if lo is None or hi is None:
            return False
        lo, hi = min(lo, hi), max(lo, hi)
        if kind == "RANGE":
            return lo <= end and hi >= start
        if kind == "POINT":
            return lo <= start <= hi
        return hi <= end if kind == "BEFORE" else lo >= start

    ev, ss = {b[1] for b in pool if ok(b[5], b[6])}, {b[1] for b in pool if ok(b[3], b[4])}
    chosen = {"EVENT": ev, "SESSION": ss, "BOTH_UNION": ev | ss, "BOTH_INTERSECT": (ev & ss) or (ev | ss)}[axis]
    return [b for b in pool if b[1] in chosen] or pool


def expected_top(asks, blocks, k):
    out = set()
    for ask in asks:
        scored = sorted(((-model_cosine(ask[2], b[2]), b[1]) for b in model_pool(ask, blocks)))[:k]
        out |= {(ask[0], ask[1], bid, i + 1, round(-s, 6)) for i, (s, bid) in enumerate(scored)}
    return out


def test_retrieve_matches_model_across_tilings(spark):
    b, q, blocks, asks = make_tables(spark)
    want = expected_top(asks, blocks, 5)
    got = {(r.user_id, r.qa_idx, r.block_id, r.rank, round(r.score, 6)) for r in retrieve(q, b, 5).collect()}
    assert got == want
    decided = pools.decide_pool(q, b).select("user_id", "qa_idx", "pool_mode")
    tiny = rank.tiled_top_k(
        pools.with_bounds(q).join(decided, ["user_id", "qa_idx"]), pools.with_axis_days(b), 5, filtered=True, blocks_per_tile=7, questions_per_tile=3
    )
    assert {(r.user_id, r.qa_idx, r.block_id, r.rank, round(r.score, 6)) for r in tiny.collect()} == want


def test_top_k_with_a_third_of_the_rows_identical(spark):
    rows = [("u", i, [1.0, 0.0] if i % 3 == 0 else [float(i % 7), 1.0]) for i in range(300)]
    b = spark.createDataFrame(rows, "user_id string, block_id long, embedding array<double>")
    q = spark.createDataFrame([("u", 1, [1.0, 0.0])], "user_id string, qa_idx long, embedding array<double>")
    got = [r.block_id for r in rank.tiled_top_k(q, b, 10, blocks_per_tile=16).orderBy("rank").collect()]
    assert got == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27]


def test_pool_join_keeps_every_pair_once_under_skew(spark):
    b, q, blocks, asks = make_tables(spark)
    pairs = pool_join(q.select("user_id", "qa_idx"), b.select("user_id", "block_id"), rows_per_slice=10, rows_per_batch=4)
    want = {(a[0], a[1], x[1]) for a in asks for x in blocks if a[0] == x[0]}
    got = [(r.user_id, r.qa_idx, r.block_id) for r in pairs.collect()]
    assert len(got) == len(want) and set(got) == want
    hot = slice_counts(b, ["user_id"], 10).collect()
    assert [r.user_id for r in hot] == ["hot"]


def test_survivors_plus_full_mode_cover_the_pool(spark):
    b, q, blocks, asks = make_tables(spark)
    decided = pools.decide_pool(q, b)
    kept = {}
    for r in pools.surviving_pairs(decided, b).collect():
        kept.setdefault(r.qa_idx, set()).add(r.block_id)
    for r in decided.collect():
        ask = next(a for a in asks if a[1] == r.qa_idx)
        want = {x[1] for x in model_pool(ask, blocks)}
        assert r.pool_size == len(want)
        assert r.pool_mode == "FULL" or kept[r.qa_idx] == want


def test_before_compat_filters_nothing(spark):
    b, q, *_ = make_tables(spark)
    ask = q.filter("tc_type = 'BEFORE'")
    loose = pools.pool_counts(pools.axis_verdicts(ask, b, before_compat=True)).collect()
    assert loose and all(r.n_event == r.n_pool or r.n_event <= r.n_pool for r in loose)


def test_overlap_join_equals_theta_join(spark):
    rng = random.Random(3)
    day = lambda: DAY + dt.timedelta(days=rng.randint(0, 200))
    a = [(i, i % 3, *([day(), day()] if i % 9 else [day(), None])) for i in range(120)]
    b = [(i, i % 3, *[day(), day()]) for i in range(120)]
    left = spark.createDataFrame(a, "i int, k int, s date, e date")
    right = spark.createDataFrame(b, "j int, k int, s2 date, e2 date")
    want = {
        (x[0], y[0]) for x in a for y in b
        if x[1] == y[1] and x[3] and min(x[2:]) <= max(y[2:]) and max(x[2:]) >= min(y[2:])
    }
    for width in (1, 20, 500):
        got = [(r.i, r.j) for r in overlap_join(left, right, ("s", "e"), ("s2", "e2"), ["k"], width).collect()]
        assert len(got) == len(want) and set(got) == want
    far = left.withColumn("e", F.when(F.col("i") % 2 == 0, F.lit("9999-12-31").cast("date")).otherwise(F.col("e")))
    plain = {(r.i, r.j) for r in overlap_join(far, right, ("s", "e"), ("s2", "e2"), ["k"], 365).collect()}
    clipped = [(r.i, r.j) for r in overlap_join(far, right, ("s", "e"), ("s2", "e2"), ["k"], 7, clip=True).collect()]
    assert len(clipped) == len(plain) and set(clipped) == plain


def test_quantiles_of_tied_and_skewed_values(spark):
    values = [float(v) for v in range(97)] + [5.0] * 40 + [1e9]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", 4.0), (None, 7.0), ("c", None)], "g string, v double")
    for buckets in (2, 7, 4096):
        q = {r.g: r for r in quantiles(df, "v", {"p95": (0.95, "linear"), "low": (0.3, "floor"), "mid": (0.5, "nearest")}, ["g"], buckets).collect()}
        n = len(values)
        assert abs(q["a"].p95 - np.percentile(values, 95)) < 1e-9 and abs(q["b"].p95 - 3.85) < 1e-9 and q[None].mid == 7 and "c" not in q
        assert q["a"].low == sorted(values)[int(0.3 * n)] and q["a"].mid == sorted(values)[round(0.5 * n) - 1]
    assert [r.p50 for r in exact_quantile(df.filter("g = 'b'"), "v", 0.5).collect()] == [2.5]


def test_pool_size_equals_ranked_rows_with_missing_dates(spark):
    day = lambda n: DAY + dt.timedelta(days=n)
    b = spark.createDataFrame(
        [("u", 1, [1.0], day(1), day(1), day(1), day(2)), ("u", 2, [1.0], None, None, day(3), day(4)), ("u", 3, [1.0], day(5), day(5), None, None), ("u", 4, [1.0], None, None, None, None)],
        "user_id string, block_id long, embedding array<double>, session_start date, session_end date, event_start date, event_end date",
    )
    asks = [
        ("u", i, [1.0], kind, start, end, axis, "WINDOW")
        for i, (kind, start, end, axis) in enumerate(
            (k, s, e, a) for k in ("RANGE", "POINT", "AFTER", "BEFORE", "NONE") for s in (day(2), None) for e in (day(4), None) for a in ("EVENT", "SESSION", "BOTH_UNION", "BOTH_INTERSECT")
        )
    ]
    q = spark.createDataFrame(asks, "user_id string, qa_idx int, embedding array<double>, tc_type string, tc_start date, tc_end date, axis string, intent string")
    sizes = {r.qa_idx: r.pool_size for r in pools.decide_pool(q, b).collect()}
    ranked = {r.qa_idx: r["count"] for r in retrieve(q, b, 10).groupBy("qa_idx").count().collect()}
    assert sizes == ranked and len(sizes) == len(asks)
    slow = {r.qa_idx: tuple(r)[2:] for r in pools.pool_counts(pools.axis_verdicts(q, b)).collect()}
    fast = {r.qa_idx: (r.n_pool, r.n_event, r.n_session, r.n_intersect, r.n_union) for r in pools.with_pool_counts(q, b).collect()}
    assert fast == slow


def test_axis_counts_equal_the_pairs(spark):
    rng = random.Random(12)
    day = lambda n=40: DAY + dt.timedelta(days=rng.randrange(n))
    maybe = lambda: day() if rng.random() < 0.85 else None
    b = spark.createDataFrame(
        [("hot" if i % 3 else f"u{i % 7}", i, *(maybe() for _ in range(4))) for i in range(400)], "user_id string, block_id long, session_start date, session_end date, event_start date, event_end date"
    )
    kinds = ("RANGE", "POINT", "AFTER", "SINCE", "BEFORE", "UNTIL", "NONE", "ANCHOR")
    asks = [(u, i, kinds[i % 8], maybe(), maybe(), rng.choice(("EVENT", "SESSION", "BOTH_UNION", "BOTH_INTERSECT")), "WINDOW") for i, u in enumerate(["hot", "u0", "u3", "nobody"] * 60)]
    q = spark.createDataFrame(asks, "user_id string, qa_idx int, tc_type string, tc_start date, tc_end date, axis string, intent string")  # some ranges end before they start
    slow = {r.qa_idx: tuple(r)[2:] for r in pools.pool_counts(pools.axis_verdicts(q, b)).collect()}
    fast = {r.qa_idx: (r.n_pool, r.n_event, r.n_session, r.n_intersect, r.n_union) for r in pools.with_pool_counts(q, b).collect()}
    assert {k: v for k, v in fast.items() if asks[k][0] != "nobody"} == slow
    assert {fast[k] for k in fast if asks[k][0] == "nobody"} == {(0, 0, 0, 0, 0)}
    apart = {r.qa_idx: (r.n_event, r.n_session) for r in pools.with_pool_counts(q, b, joint=False).collect()}
    assert apart == {k: v[1:3] for k, v in fast.items()}
    some = pools.with_pool_counts(q, b, joint=F.col("axis") == "BOTH_INTERSECT").filter("axis = 'BOTH_INTERSECT'").collect()
    assert some and all((r.n_intersect, r.n_union) == fast[r.qa_idx][3:] for r in some)
    # without ranges that end before they start, the counts of one axis pair nothing: blocks and constraints meet in no join
    tidy = q.filter("tc_type <> 'RANGE' OR tc_end IS NULL OR tc_end >= tc_start")
    counted = pools.with_pool_counts(tidy, b, joint=False, ordered=True)
    assert {r.qa_idx: (r.n_event, r.n_session) for r in counted.collect()} == {k: v for k, v in apart.items() if k in {r.qa_idx for r in tidy.collect()}}
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "q_start_max" not in "".join(line for line in plan.split("\n") if "Join" in line) and "_batch" not in plan


def test_one_huge_value_does_not_press_the_others_together(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("CAST((id * 7919) % 1000003 AS DOUBLE) / 1000003 AS v").union(spark.sql("SELECT 1e12D AS v"))
    asked = {"p50": (0.5, "nearest"), "p95": (0.95, "floor"), "top": (1.0, "nearest")}
    values = sorted((k * 7919) % 1000003 / 1000003 for k in range(n)) + [1e12]
    found = quantiles(df, "v", asked)
    (row,) = found.collect()
    assert (row.p50, row.p95, row.top) == (values[round(0.5 * (n + 1)) - 1], values[int(0.95 * (n + 1))], 1e12)
    # rows that the windows order: ranges first, then the values of the last ranges
    plan = found._jdf.queryExecution().executedPlan()
    stack, windows = [plan], []
    while stack:
        node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            stack.append(node.plan())
        else:
            if node.nodeName() == "Window":
                child = node.child()
                while not child.metrics().contains("numOutputRows") and child.children().size():
                    child = child.children().head()
                windows.append(child.metrics().get("numOutputRows").get().value() if child.metrics().contains("numOutputRows") else 0)
            stack += [node.children().apply(k) for k in range(node.children().size())]
    assert len(windows) == 3 and max(windows) <= 5000


def test_one_key_may_own_half_of_an_interval_join(spark):
    rng = random.Random(6)
    iv = lambda: (lambda a: (DAY + dt.timedelta(days=a), DAY + dt.timedelta(days=a + rng.randrange(9))))(rng.randrange(30))
    left = [(i, "hot" if i % 2 else f"k{i % 13}", *iv()) for i in range(300)]
    right = [(i, "hot" if i % 2 else f"k{i % 13}", *iv()) for i in range(260)]
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] <= b[3] and a[3] >= b[2])
    l, r = spark.createDataFrame(left, "i int, k string, s date, e date"), spark.createDataFrame(right, "j int, k string, s2 date, e2 date")
    for tile in (7, 40, 50_000):
        joined = overlap_join(l, r, ("s", "e"), ("s2", "e2"), ["k"], 10, rows_per_tile=tile)
        assert joined.columns == ["k", "i", "s", "e", "j", "s2", "e2"]
        assert sorted((x.i, x.j) for x in joined.collect()) == want
    assert overlap_join(l, r.limit(0), ("s", "e"), ("s2", "e2"), ["k"], 10, rows_per_tile=7).count() == 0


def test_anchor_scores_are_the_best_event_of_the_best_blocks(spark):
    from timeweave.operators.anchors import AnchorRules, score_candidates
    from timeweave.operators.rank import tiled_scores

    rng = random.Random(17)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    b = [("u" if i % 4 else "v", i, vec() if i % 11 else None) for i in range(60)]
    events = [(u, i, vec()) for u, i, _ in b for _ in range(i % 4)]  # blocks with none to three events
    asks = [("u" if i % 3 else "v", i, vec() if i else None) for i in range(20)]
    rules = AnchorRules(coarse_blocks=12, candidates=5)
    frames = [spark.createDataFrame(x, f"user_id string, {k} long, embedding array<double>") for x, k in ((asks, "qa_idx"), (b, "block_id"), (events, "block_id"))]
    got = {(r.user_id, r.qa_idx, r["rank"]): (r.block_id, round(r.score, 6)) for r in score_candidates(*frames, rules).collect()}

    def cos(x, y):
        return -1.0 if x is None or y is None else round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 9)

    want = {}
    for u, q, a in asks:
        coarse = sorted(((-cos(a, v), i) for w, i, v in b if w == u))[:12]
        fine = sorted((-max(cos(a, e) for w, j, e in events if j == i), i) for _, i in coarse if i % 4)[:5]
        want |= {(u, q, k): (i, round(-s, 6)) for k, (s, i) in enumerate(fine, 1)}
    assert got == want
    small = tiled_scores(frames[0], frames[1].withColumn("parts", F.lit(None).cast("array<double>")), 3, parts=True, blocks_per_tile=7, questions_per_tile=4)
    assert small.count() and small.filter("part_score IS NOT NULL").count() == 0


def test_best_of_each_group_is_linear_in_questions(spark):
    from timeweave.operators.rank import tiled_group_top_k

    rng = random.Random(19)
    vec = lambda: [float(rng.randint(-2, 2)) for _ in range(3)]  # noqa: E731  many ties
    items = [("hot" if i % 3 else "v", f"p{i % 4}", f"r{i:03d}", vec() if i % 9 else None) for i in range(150)]
    asks = [("hot" if i % 2 else "v", i, vec() if i else None) for i in range(21)] + [("nobody", 50, vec())]
    frames = [spark.createDataFrame(asks, "user_id string, qa_idx long, embedding array<double>"), spark.createDataFrame(items, "user_id string, group string, item_id string, embedding array<double>")]

    def cos(x, y):
        if x is None or y is None:
            return -1.0
        return round(float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y) or 1.0)), 9)

    for least in (0.25, None):
        want = set()
        for u, q, a in asks:
            for p in ("p0", "p1", "p2", "p3"):
                own = sorted((-cos(a, v), i) for w, g, i, v in items if w == u and g == p and (least is None or cos(a, v) >= least))[:3]
                want |= {(u, q, p, i, n) for n, (_, i) in enumerate(own, 1)}
        for sizes in ({}, {"items_per_tile": 20, "questions_per_tile": 5}):
            found = tiled_group_top_k(*frames, 3, least, **sizes).collect()
            assert {(r.user_id, r.qa_idx, r.group, r.item_id, r["rank"]) for r in found} == want and len(found) == len(want)


def test_audit_keeps_gold_blocks_without_session_dates(spark):
    b = spark.createDataFrame(
        [("u", i, None, None, None, None) for i in range(3)], "user_id string, block_id long, session_start date, session_end date, event_start date, event_end date"
    )
    q = spark.createDataFrame([("u", 0, "NONE", None, None, "EVENT", "WINDOW")], "user_id string, qa_idx int, tc_type string, tc_start date, tc_end date, axis string, intent string")
    gold = spark.createDataFrame([("u", 0, i) for i in range(4)], "user_id string, qa_idx int, block_id long")
    (row,) = pools.pool_audit(pools.decide_pool(q, b), b, gold).collect()
    assert (row.gold_total, row.gold_after_time, row.gold_lost_time) == (4, 3, 1)


def test_open_counts_equal_the_theta_join(spark):
    rng = random.Random(9)
    day = lambda: DAY + dt.timedelta(days=rng.randint(0, 400))
    iv = [(i % 3, *([day(), day()] if i % 9 else [day(), None])) for i in range(200)]
    points = [(i, i % 4, day() if i % 11 else None) for i in range(150)]
    got = {
        r.i: r.n_open
        for r in open_counts(spark.createDataFrame(points, "i int, k int, day date"), "day", spark.createDataFrame(iv, "k int, s date, e date"), ("s", "e"), ["k"]).collect()
    }
    assert got == {i: sum(k == x[0] and x[2] is not None and min(x[1:]) <= d <= max(x[1:]) for x in iv) for i, k, d in points if d}


def test_links_follow_the_order_of_events_in_long_blocks(spark):
    from timeweave.operators.graph import graph_tables

    event = "struct<event_id:string,description:string>"
    blocks = spark.range(2).selectExpr("'u' AS user_id", "id AS block_id", "id AS seq", f"transform(sequence(0, 4999), i -> cast(named_struct('event_id', concat(id, '_', i), 'description', 'x') AS {event})) AS events")
    named = spark.createDataFrame([("u", "0_4998"), ("u", "0_4999"), ("u", "1_0")], "user_id string, event_id string").withColumn("embedding", F.array(F.lit(1.0)))
    _, edges = graph_tables(blocks, named, "seq")
    assert {(r.a_id, r.b_id) for r in edges.collect()} == {("0_4999", "0_4998"), ("1_0", "0_4998"), ("1_0", "0_4999")}
