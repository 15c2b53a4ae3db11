from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np

from tests.llm.cases import empty, frame, sentence, texts
from timeweave.llm import neardup as nd
from timeweave.llm.components import components


def brute_classes(rows) -> dict:
    """Least id of each class by all pairs, with the plain multiset of shingles (enough for these texts)."""
    words = {k: tuple((t or "").split()) for k, t, _ in rows}
    bags = {k: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for k, w in words.items() if w}
    parent = {k: k for k in words}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(bags, key=lambda k: (k is None, k or 0))
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = sum((bags[a] & bags[b]).values())
            if common >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - common):
                x, y = sorted((root(a), root(b)), key=lambda k: (k is None, k or 0))
                parent[y] = x
    return {k: root(k) for k in words}


def test_classes_match_brute_force(spark):
    rows = texts()
    found = nd.near_duplicate_classes(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    want = brute_classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in found} == want
    assert {r["class_rows"] for r in found if r["doc_id"] == 207} == {31}


def test_one_row_of_each_class_stays(spark):
    docs = frame(spark)
    kept = nd.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    want = brute_classes(texts())
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert set(ids) == {k for k, c in want.items() if k == c} and max(ids.values()) == 1


def test_loose_group_in_one_bucket_is_linked_where_similar(spark):
    """Many texts around one origin, most of them not similar to each other: links must not depend on the leader."""
    rng = random.Random(3)
    origin, rows = sentence(rng, 120), []
    for k in range(150):
        words = list(origin)
        for _ in range(rng.choice((0, 1, 2, 3, 8, 12))):
            words[rng.randrange(120)] = f"w{k}{rng.randrange(1000)}"
        rows.append((k, " ".join(words), "s"))
    found = {r["doc_id"]: r["class_id"] for r in nd.near_duplicate_classes(frame(spark, rows), small=8).collect()}
    want = brute_classes(rows)
    pairs = [(a, b) for a in want for b in want if a < b and want[a] == want[b]]
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(want[a] == want[b] for a in want for b in want if found[a] == found[b])


def test_every_candidate_link_of_a_loose_group_is_in_one_class(spark):
    """All pairs that agree in a sketch and are similar, by brute force, in buckets of many blocks."""
    rng = random.Random(11)
    origin, rows = sentence(rng, 120), []
    for k in range(400):
        words = list(origin)
        for _ in range(rng.choice((1, 2, 3, 4, 5, 6))):
            words[rng.randrange(120)] = f"w{k}{rng.randrange(1000)}"
        rows.append((k, " ".join(words), "s"))
    found = {r["doc_id"]: r["class_id"] for r in nd.near_duplicate_classes(frame(spark, rows), sketches=4, small=4, tile=32).collect()}
    number: dict[str, int] = {}
    keys = [nd.shingles(np.array([number.setdefault(w, len(number)) for w in t.split()], np.uint64)) for _, t, _ in rows]
    drawn = {r["row"]["id"]: r["sketches"] for r in nd.sketch(frame(spark, rows), "doc_id", "text", 4, 4).collect()}
    links = [(a, b) for b in range(400) for a in range(b) if any(x == y for x, y in zip(drawn[a], drawn[b], strict=True)) and nd.aligned_similarity(keys[a], keys[b], 0.8) >= 0.8]
    assert len(links) > 300
    assert [(a, b) for a, b in links if found[a] != found[b]] == []
    want = brute_classes(rows)
    assert all(want[a] == want[b] for a in want for b in want if found[a] == found[b])


def test_shared_counts_match_sets():
    rng = np.random.default_rng(3)
    a, b = ([rng.choice(300, n, replace=False).astype(np.uint64) for n in sizes] for sizes in ((5, 80, 1), (40, 200)))
    assert nd.shared_counts(a, b, 64).tolist() == [[len(set(x) & set(y)) for y in b] for x in a]
    assert nd.shared_counts([a[0]], [a[0] + np.uint64(1000)]).tolist() == [[0]]


def test_order_matters_to_sketch_and_alignment():
    rng = np.random.default_rng(1)
    a = nd.shingles(rng.integers(0, 1 << 62, 200).astype(np.uint64))
    swapped = np.concatenate([a[100:], a[:100]])
    assert nd.aligned_similarity(a, a, 0.8) == 1 and nd.aligned_similarity(a, swapped, 0.8) < 0.8
    assert (nd.order_min_hash(a, 64, 4) == nd.order_min_hash(swapped, 64, 4)).mean() < 0.5


def test_sketch_agreement_follows_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 62, 500).astype(np.uint64)
    b = a.copy()
    b[rng.choice(500, 55, replace=False)] += np.uint64(1)  # similarity 0.8 of unordered keys
    rate = (nd.order_min_hash(a, 512, 4) == nd.order_min_hash(b, 512, 4)).mean()
    assert 0.3 < rate < 0.5


def test_components_of_paths_and_stars(spark):
    rng = random.Random(5)
    names = [rng.randbytes(8) for _ in range(400)]
    edges = [(names[i], names[i + 1]) for i in range(199)] + [(names[200], names[i]) for i in range(201, 399)]
    got = defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a binary, b binary")).collect():
        got[bytes(r["component"])].add(bytes(r["node"]))
    assert sorted(map(len, got.values())) == [199, 200]


def test_empty(spark):
    assert nd.near_duplicate_classes(empty(spark)).count() == 0
    assert nd.drop_near_duplicates(empty(spark)).count() == 0
