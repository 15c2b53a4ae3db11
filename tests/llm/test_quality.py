from __future__ import annotations

import re
from collections import Counter

import numpy as np

from tests.llm.cases import empty, frame, texts
from timeweave.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_statistics_match_brute_force(spark):
    docs = frame(spark, [*texts(), (900, "a b | c #\n\na b | c #\n x\n x\n" * 3, "s")])
    found = q.quality(docs, labels(spark, [(k, 1, 0) for k in range(50)])).collect()
    want = Counter((r["doc_id"], *expected(r["text"])) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found) == want
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_ratio_matches_brute_force_and_drops_odd_texts(spark):
    rows = texts()[:60]
    rows += [(600 + k, "$$$ ### &&& ||| *** " * (10 + k), "s") for k in range(5)]
    docs = frame(spark, rows)
    trusted = [k for k in range(0, 60, 2)]
    found = {r["doc_id"]: r for r in q.quality(docs, labels(spark, [(k, 1, 0) for k in trusted] + [(601, 0, 0), (None, 1, 0)])).collect()}
    rules = q.Rules()
    raw, good = np.zeros(rules.buckets), np.zeros(rules.buckets)
    grams = {k: q.gram_buckets(np.frombuffer(t.encode(), np.uint8), rules.buckets) for k, t, _ in rows}
    for k, at in grams.items():
        np.add.at(raw, at, 1)
        if k in trusted:
            np.add.at(good, at, 1)
    share = (raw + 1) / (raw.sum() + rules.buckets)
    weight = np.log((good + rules.buckets * share) / (good.sum() + rules.buckets)) - np.log(share)
    for k, at in grams.items():
        assert abs(found[k]["ratio"] - weight[at].mean()) < 1e-9
    assert all(found[k]["kept"] for k in range(60))
    assert not any(found[600 + k]["kept"] for k in range(5))


def test_filter_keeps_columns_and_repeated_rows(spark):
    docs = frame(spark)
    kept = q.filter_quality(docs, labels(spark, [(k, 1, 0) for k in range(50)]))
    assert kept.schema == docs.schema
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[8] == 4 and ids[300] == ids[301] == 0 and ids[None] == 1


def test_empty_tables_and_no_labels(spark):
    assert q.quality(empty(spark), labels(spark, [])).count() == 0
    found = q.quality(frame(spark), labels(spark, [])).collect()
    assert len(found) == len(texts()) and all(r["ratio"] == 0 for r in found)
