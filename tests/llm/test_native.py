"""Mixing and sharding, which use DataFrame operations only."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import empty, frame, texts
from timeweave.llm import mixing, sharding


def water_fill(sizes: dict, weights: dict, share: float, most: float) -> dict:
    """Targets by the rule as told: share by weight, stop at the most, share the excess again."""
    target = dict.fromkeys(sizes, 0.0)
    left, open_ = share * sum(sizes.values()), set(sizes)
    while open_ and left > 1e-9:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if target[s] + left * weights[s] / total >= most * sizes[s]}
        if not full:
            for s in open_:
                target[s] += left * weights[s] / total
            break
        for s in full:
            target[s] = most * sizes[s]
        open_ -= full
        left = share * sum(sizes.values()) - sum(target[s] for s in sizes if s not in open_)
        for s in open_:
            target[s] = 0.0
    return target


def test_targets_and_taken_words(spark):
    rows = texts()
    found = mixing.plan(frame(spark, rows)).collect()
    size = Counter()
    for _, text, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = water_fill(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    source_of = defaultdict(set)
    for k, _, s in rows:
        source_of[k].add(s)
    taken = Counter()
    for r in found:
        (source,) = source_of[r["doc_id"]]
        assert r["source_size"] == size[source] and r["target"] == pytest.approx(want[source]), source
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    for s in size:
        assert abs(taken[s] - want[s]) <= 1 + 0.01 * want[s] + len(rows) / 50
    assert sum(want.values()) == pytest.approx(1.5 * sum(size.values()))


def test_reruns_agree_and_shards_share_tokens(spark):
    one, two = ({(r["doc_id"], r["size"]): r for r in mixing.plan(frame(spark).repartition(n)).collect()} for n in (1, 7))
    assert one == two
    rows = [(k, f"word {k} " * 5, f"s{k % 3}") for k in range(3000)]
    shards = Counter(x for r in mixing.plan(frame(spark, rows)).collect() for x in r["shards"])
    assert len(shards) == 8 and max(shards.values()) < 1.3 * min(shards.values())


def test_tokens_split_evenly_between_any_number_of_shards(spark):
    quotas = spark.range(100).selectExpr("cast(id % 3 as string) AS source", "id AS block", "1 AS passes", "CAST(id % 2 AS double) AS part")
    for n in (1, 3, 8, 24):
        found = mixing.split(quotas, mixing.Mix(shards=n)).collect()
        counts = Counter(x for r in found for x in r["shards"])
        assert set(counts) == set(range(n)) and sum(counts.values()) == 150 and max(counts.values()) - min(counts.values()) <= 5


def test_mixed_rows_are_the_draws_that_are_counted(spark, tmp_path):
    """Very unequal sizes: every 40th text has 20,000 words."""
    rng = random.Random(3)
    rows = [(k, " \n".join(f"w{k}.{i}" for i in range(20_000 if k % 40 == 0 else rng.randrange(1, 60))) + "\t", f"s{k % 3}") for k in range(360)]
    rows += [(900, "a b\tc  d", "s1")] * 4 + [(None, "null id here", None), (901, "", "s0"), (902, None, "s2")]
    docs = frame(spark, rows)
    counted = mixing.plan(docs).collect()
    mix = mixing.mixed_rows(docs)
    assert mix.schema == docs.schema
    drawn, texts_of = Counter(), defaultdict(set)
    for k, text, _ in rows:
        texts_of[k].add(text)
    cut = 0
    for r in mix.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        drawn[r["doc_id"]] += n
        whole = r["text"] in texts_of[r["doc_id"]]
        cut += not whole
        assert whole or any(t and t.startswith(r["text"]) and not t.startswith(r["text"] + "w") for t in texts_of[r["doc_id"]])
    taken, by_source, target = Counter(), Counter(), {}
    source_of = {k: s for k, _, s in rows}
    for r in counted:
        taken[r["doc_id"]] += r["taken"]
        by_source[source_of[r["doc_id"]]] += r["taken"]
        target[source_of[r["doc_id"]]] = r["target"]
        assert len(r["shards"]) <= 2 and r["taken"] <= 2 * r["size"]
    assert {k: n for k, n in drawn.items() if n} == {k: n for k, n in taken.items() if n}
    assert all(target[s] - 4 < by_source[s] <= target[s] for s in target)  # copies of one id round down each
    assert 1 <= cut <= 3 + 4
    mixing.write_mix(docs, str(tmp_path / "mix"))
    assert spark.read.parquet(str(tmp_path / "mix")).count() == mix.count()


def test_first_words_keep_white_space(spark):
    df = spark.createDataFrame([("  a\n\nb\tc d  ", n) for n in (1, 2, 3, 4)], "t string, n long")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == ["  a", "  a\n\nb", "  a\n\nb\tc", "  a\n\nb\tc d"]


def test_mixing_takes_odd_rows(spark):
    assert mixing.plan(empty(spark)).count() == 0 and mixing.mixed_rows(empty(spark)).count() == 0
    found = mixing.plan(frame(spark)).collect()
    assert len(found) == len(texts())
    only_empty = mixing.plan(frame(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert [(r["target"], r["taken"]) for r in only_empty] == [(0.0, 0)] * 2
    assert mixing.mixed_rows(frame(spark)).schema == frame(spark).schema


def test_shards_are_even_and_slots_gapless(spark, tmp_path):
    rows = texts()
    docs = frame(spark, rows)
    placed = sharding.sharded(docs)
    found = placed.collect()
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["doc"]["text"] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((r["doc"]["text"] or "").encode())
    assert len(slots) == 24 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    copies = Counter(r["shard"] for r in found if r["doc"]["text"] == rows[7][1])
    assert len(copies) > 8  # copies scatter
    again = {(r["doc"]["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.sharded(docs.repartition(3)).collect()}
    assert len(again & {(r["doc"]["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in found}) == len(found)
    sharding.write_shards(placed, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def test_the_order_is_shuffled(spark):
    rows = [(k, f"t{k}", "s") for k in range(5000)]
    found = sharding.sharded(frame(spark, rows), keep=["doc_id"]).collect()
    order = [r["doc"]["doc_id"] for r in sorted(found, key=lambda r: (r["shard"], r["slot"]))]
    rises = sum(a < b for a, b in zip(order, order[1:], strict=False))
    assert 2300 < rises < 2700 and abs(sum(order[:2500]) / 2500 - 2500) < 120


def test_sharding_takes_odd_rows(spark):
    assert sharding.sharded(empty(spark)).count() == 0
    assert {(r["shard"], r["slot"]) for r in sharding.sharded(frame(spark, [(None, None, None)])).collect()} == {(0, 0)}
