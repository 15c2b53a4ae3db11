from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import UPPER, empty, frame, texts
from timeweave.llm import suffix_tree as st

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text: str | None) -> list[str]:
    return [*WORD.findall((text or "").translate(UPPER)), "\n"]


def held(key) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


def brute_tree(rows, tree: st.Tree):
    """Counts, tests and smoothing with dictionaries, context by context."""
    train = [(" ".join(tokens(t)[:-1]) + " ").encode() if len(tokens(t)) > 1 else b"" for k, t, _ in rows if not held(k)]
    counts: dict[bytes, Counter] = {}
    for line in train:
        padded = b"\n" * tree.depth + line + b"\n"
        for i in range(tree.depth, len(padded)):
            for d in range(tree.depth + 1):
                counts.setdefault(padded[i - d : i], Counter())[padded[i]] += 1
    kept = {context for context in counts if len(context) <= st.SHORT} | {b""}
    for context, own in counts.items():
        n = sum(own.values())
        if len(context) <= st.SHORT or n < tree.min_count:
            continue
        parent = counts[context[1:]]
        total = sum(parent.values())
        gain = sum(c * math.log(c / n / (parent[a] / total)) for a, c in own.items())
        if gain > tree.penalty * len(own) * math.log(n):
            kept |= {context[k:] for k in range(len(context) + 1)}

    def probability(context: bytes, byte: int) -> float:
        if context not in kept:
            return probability(context[1:], byte)
        own = counts[context]
        lower = probability(context[1:], byte) if context else 1 / 256
        spared = tree.smoothing * len(own)
        return (own[byte] + spared * lower) / (sum(own.values()) + spared)

    def score(text) -> float:
        words = tokens(text)[:-1]
        padded = b"\n" * tree.depth + "".join(w + " " for w in words).encode() + b"\n"
        return sum(math.log10(probability(padded[i - tree.depth : i], padded[i])) for i in range(tree.depth, len(padded)))

    return score, kept


def test_scores_match_brute_force(spark):
    rows = [r for r in texts() if r[0] is None or r[0] not in (400, 401)]
    tree = st.Tree(depth=4, chunk_bytes=3000)
    found = st.score(frame(spark, rows), tree=tree).collect()
    assert len(found) == len(rows)
    score, kept = brute_tree(rows, tree)
    assert max(map(len, kept)) >= 4
    c = Counter(w for k, t, _ in rows if not held(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    by_id = {}
    for k, t, _ in rows:
        by_id[k] = t
    for r in found:
        own = tokens(by_id[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in own))
        assert r["score"] == pytest.approx(score(by_id[r["doc_id"]]))


def whole_model(spark, rows, tree):
    stored = st.chunks(frame(spark, rows), "doc_id", "text", tree)
    short, model = st.short_levels(stored), st.Model()
    for entries, n in short:
        model = st.grown(model, entries, n, tree)
    (row,) = st.asked_keys(stored.coalesce(1), st.Tree(depth=tree.depth, unit=1 << 40), 1).collect()
    planes = [np.ascontiguousarray(st.unpacked(pa.scalar(bytes(row[c]))).reshape(8, -1).T) for c in ("keys", "counts")]
    return st.subtrees(short, model, np.cumsum(planes[0].view(np.uint64).ravel(), dtype=np.uint64), planes[1].view(np.int64).ravel(), tree)


def test_next_byte_distributions_sum_to_one(spark):
    rows = [r for r in texts() if r[0] is None or r[0] not in (400, 401)]
    model = whole_model(spark, rows, st.Tree(depth=4))
    assert len(model.contexts[3]) > 10 and len(model.contexts[4]) > 10
    for context in (b"    ", b" alp", b"zzzz", b"\n\n\n\n", b"lta1", b"n an"):
        prefix = sum(b << (56 - 8 * k) for k, b in enumerate(reversed(context)))
        keys = np.array([prefix | a for a in range(256)], np.uint64)
        assert (10 ** model.log10(keys)).sum() == pytest.approx(1)


def test_scores_depend_on_no_table_size_units_or_buckets(spark):
    """A text scores the same when rows without its contexts are added, but for the counts of what they share."""
    rows = [r for r in texts() if r[0] is None or r[0] not in (400, 401)]
    want = {(r["doc_id"], r["n_tokens"]): r["score"] for r in st.score(frame(spark, rows)).collect()}
    small = st.Tree(chunk_bytes=2000, unit=2, bucket_bytes=100)
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in st.score(frame(spark, rows).repartition(3), tree=small).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    # deep states stay when the table grows by other words: their own counts are what is tested
    tree = st.Tree(depth=4)
    few = whole_model(spark, rows, tree)
    other = [(5000 + k, " ".join(chr(0x4E00 + (k * 31 + i) % 900) * 2 for i in range(300)), "x") for k in range(60)]
    many = whole_model(spark, rows + other, tree)
    for d in (3, 4):
        assert np.isin(few.contexts[d], many.contexts[d]).mean() > 0.97


def test_long_texts(spark):
    found = {r["doc_id"]: r for r in st.score(frame(spark)).collect()}
    assert found[400]["n_tokens"] == 48_001 and found[401]["n_tokens"] == 2


def test_held_out_texts_with_order_are_likelier_than_by_word_counts(spark):
    rng = random.Random(4)
    names = ["ka", "lo", "mir", "ten", "ush", "ra", "bel", "on"]
    rows = []
    for k in range(300):
        at, words = 0, []
        for _ in range(80):
            at = (at + 1) % 8 if rng.random() < 0.9 else rng.randrange(8)
            words.append(names[at])
        rows.append((k, " ".join(words), "s"))
    out = [r for r in st.score(frame(spark, rows)).collect() if r["held_out"]]
    assert len(out) > 20 and all(r["score"] > 0.6 * r["base_score"] for r in out)


def test_empty_and_untrained(spark):
    assert st.score(empty(spark)).count() == 0
    key = next(k for k in range(100) if held(k))
    (r,) = st.score(frame(spark, [(key, "ab", "s")])).collect()
    assert (r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0.0) and r["score"] == pytest.approx(4 * math.log10(1 / 256))
