from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from tests.llm.cases import UPPER, empty, frame, texts
from timeweave.llm import decontam as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id string, text string")


def brute(rows, item_rows):
    windows = defaultdict(set)
    for item, text in item_rows:
        w = WORD.findall((text or "").translate(UPPER))
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[i : i + size])].add(item or "")
    out = []
    for k, text, _ in rows:
        w = WORD.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[i : i + size]))):
                    hit.update(range(i, i + size))
                    found |= own
        out.append((k, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def cases():
    rows = texts()
    words = [r[1].split() for r in rows[:10]]
    item_rows = [(str(i), " ".join(w[3:40]).upper()) for i, w in enumerate(words)]
    item_rows += [("short", " ".join(words[2][5:9])), ("one", "漢字"), ("none", "... !"), (None, " ".join(words[4][:20])), ("null", None), ("0", "again and again"), ("absent", "never seen words " * 5)]
    item_rows.append(("again", "and again " * 12))
    rows += [(700, "prefix " + ", ".join(words[1][3:16]) + " suffix", "s"), (701, " ".join(words[1][3:15]) + " gap " + words[1][15], "s")]
    return rows, item_rows


def test_hits_match_brute_force_in_one_block_and_in_many(spark):
    rows, item_rows = cases()
    for block_words in (1 << 20, 60):
        found = dc.contamination(frame(spark, rows), items(spark, item_rows), options=dc.Search(block_words=block_words)).collect()
        got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in found), key=str)
        assert got == brute(rows, item_rows)


def test_proximity_takes_inserted_words_and_keeps_texts_apart(spark):
    rows, item_rows = cases()
    found = {r["doc_id"]: r for r in dc.contamination(frame(spark, rows), items(spark, item_rows)).collect()}
    assert found[701]["n_hit"] == 0 and found[701]["near_items"] == ["1"]
    assert all(set(r["items"]) <= set(r["near_items"]) for r in found.values())
    half = texts()[1][1].split()[3:16]
    split = dc.contamination(frame(spark, [(1, " ".join(half[:5]), "s"), (2, " ".join(half[5:]), "s")]).coalesce(1), items(spark, [("x", " ".join(half))])).collect()
    assert all(r["n_hit"] == 0 and not r["near_items"] for r in split)


def test_contaminated_rows_go_and_columns_stay(spark):
    rows, item_rows = cases()
    docs = frame(spark, rows)
    kept = dc.drop_contaminated(docs, items(spark, item_rows))
    assert kept.schema == docs.schema
    clean = sorted(str(k) for k, _, _, _, bad in brute(rows, item_rows) if not bad)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == clean


def test_empty_tables(spark):
    assert dc.contamination(empty(spark), items(spark, [("a", "b c")])).count() == 0
    found = dc.contamination(frame(spark), items(spark, [])).collect()
    assert len(found) == len(texts()) and not any(r["n_hit"] or r["contaminated"] for r in found)
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
