"""Hard negatives against a search of all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeweave.llm import negatives
from timeweave.llm.numbering import numbered

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("id", "number", "block", "batch", "tiles", "score", "rank", "anchor"))])


def frame(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefgh") for r in rows], SCHEMA).repartition(3)


def all_pairs(rows) -> list[tuple]:
    """The contract, pair by pair."""
    kept = []
    for k, v, label in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((k, [math.floor(256 * float(np.float32(x))) for x in v], label))
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for i, (anchor, v, label) in enumerate(kept):
        if anchor is None or anchor % 50:
            continue
        scores = [(sum(a * b for a, b in zip(v, w, strict=False)), k, other == label) for j, (k, w, other) in enumerate(kept) if j != i]
        for p, positive, _ in sorted((s for s in scores if s[2]), key=key)[:5]:
            fits = sorted((s for s in scores if not s[2] and 50 * p <= 100 * s[0] <= 95 * p), key=key)[:3]
            out += [(anchor, positive, rank, n, p, s) for rank, (s, n, _) in enumerate(fits, 1)]
    return sorted(out, key=str)


def mined(spark, rows, **options) -> list[tuple]:
    return sorted((tuple(r) for r in negatives.mine(frame(spark, rows), F.col("vec_id") % 50 == 0, options=negatives.Mining(**options)).collect()), key=str)


def vectors(n: int, clusters: int = 6, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(12)] for _ in range(clusters)]
    return [(k, [c + rng.gauss(0, 0.15) for c in rng.choice(centres)], rng.randrange(3)) for k in range(n)]


def odd_rows() -> list[tuple]:
    nan, inf = float("nan"), float("inf")
    same = [0.25] * 12
    rows = [(1000, None, 1), (1001, [1.0] * 12, None), (1002, [nan] + [0.1] * 11, 0), (1003, [0.1] * 11 + [inf], 0), (1004, [None] + [0.1] * 11, 1), (None, [0.2] * 12, 1), (1050, [0.3] * 5, 1), (1100, [], 2)]
    rows += [(2000 + k, same, k % 3) for k in range(120)]  # one vector many times: ties
    return rows + [(2050, same, 2)] * 3 + [(3000, [-0.5] * 12, 0), (3001, [0.0] * 12, 0)]


@pytest.mark.parametrize("sizes", [{}, {"block": 64, "batch": 128, "tree": 3, "step": 20}])
def test_negatives_are_those_of_all_pairs(spark, sizes):
    rows = vectors(500) + odd_rows()
    want = all_pairs(rows)
    assert len(want) > 60
    assert mined(spark, rows, **sizes) == want


def test_one_label_may_own_most_rows_and_others_one_each(spark):
    rows = [(k, v, 7 if k % 3 else k) for k, v, _ in vectors(400, seed=4)]
    assert mined(spark, rows, block=50, batch=100, tree=4, step=16) == all_pairs(rows)


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    rows = [(k * 10, [float(rng.randrange(-(2**21), 2**21)) for _ in range(8)], k % 2) for k in range(60)]
    assert mined(spark, rows) == all_pairs(rows)


def test_trees_spare_scores_of_close_anchors():
    rng = np.random.default_rng(3)
    import pyarrow as pa

    centre = rng.normal(0, 40, 32)
    anchors = np.round(centre + rng.normal(0, 1, (200, 32))).astype(np.int64)
    candidates = np.round(rng.normal(0, 40, (2000, 32))).astype(np.int64)
    tile = negatives.Tile(pa.table({"v": anchors.tolist()}), pa.table({"v": candidates.tolist()}))
    exact = anchors @ candidates.T
    scored = 0

    def wanted(anchor, low, high):
        nonlocal scored
        assert (low <= exact[anchor] + 1e-6).all() and (high >= exact[anchor] - 1e-6).all()
        some = np.flatnonzero((high >= 9000) & (low <= 10_000))
        scored += len(some)
        inside = set(np.flatnonzero((exact[anchor] >= 9000) & (exact[anchor] <= 10_000)).tolist())
        assert inside <= set(some.tolist())
        return some, lambda scores: np.testing.assert_array_equal(scores, exact[anchor][some])

    tile.walk(np.arange(200), np.arange(2000), wanted)
    assert scored < 0.3 * exact.size
    order, parent = negatives.spanning_tree(anchors.astype(float))
    assert sorted(order.tolist()) == list(range(200)) and order[0] == 0
    place = np.argsort(order)
    assert (place[parent[order[1:]]] < place[order[1:]]).all()


def test_empty_and_lonely_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1)]) == []
    assert mined(spark, [(50, [1.0], 1), (51, [0.9], 1)]) == []


def test_rows_are_numbered_in_order(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "id % 3 AS g")
    found = numbered(rows, F.col("g"), F.col("k"), name="n").collect()
    assert [r["n"] for r in sorted(found, key=lambda r: (r["g"], r["k"]))] == list(range(1000))
    assert numbered(rows.where("false"), F.col("k")).count() == 0
