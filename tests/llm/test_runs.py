"""Periodic runs against a search of every period."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tests.llm.cases import empty, frame, texts
from timeweave.llm import runs


def every_period(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) by comparing the words with themselves at every distance."""
    _, numbers = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True) if words else (None, np.zeros(0, np.int64))
    best: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // 2 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], numbers[:-q] == numbers[q:], [0]]).astype(int)))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s + q >= max(least, 2 * q):
                best.setdefault((s, e - s + q), q)
    return sorted((s, n, q) for (s, n), q in best.items())


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> str:
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def sequences(rng: random.Random) -> list[list[int]]:
    out = [[], [0], [0] * 11, [0] * 12, [0, 1] * 6, [0, 1] * 5 + [0], [0, 1, 2, 3, 4, 5] * 2, [0, 0, 0, 1] * 40]
    fibonacci = ([0], [0, 1])
    for _ in range(10):
        fibonacci = (fibonacci[1], fibonacci[1] + fibonacci[0])
    thue_morse = [bin(i).count("1") % 2 for i in range(512)]
    out += [fibonacci[1], thue_morse, thue_morse + thue_morse]
    for _ in range(120):
        letters = rng.choice((1, 2, 2, 3, 5, 60))
        words = [rng.randrange(letters) for _ in range(rng.randrange(6, 220))]
        for _ in range(rng.randrange(4)):  # repeats of any period, some of them inside each other
            at, period = rng.randrange(len(words)), rng.randrange(1, 50)
            for i in range(at + period, min(len(words), at + rng.randrange(10, 150))):
                words[i] = words[i - period]
        out.append(words)
    return out


def test_runs_are_those_of_every_period():
    rng = random.Random(3)
    cases = sequences(rng)
    for size in (1, 3, 20):  # texts that share a grammar do not disturb each other
        for at in range(0, len(cases), size):
            group = cases[at : at + size]
            first = np.cumsum([0, *map(len, group)])
            owner = np.repeat(np.arange(len(group)), np.diff(first))
            start, end, period = runs.runs_of(np.array([w for c in group for w in c], np.int64), owner)
            for k, words in enumerate(group):
                own = owner[start] == k
                got = list(zip((start[own] - first[k]).tolist(), (end - start)[own].tolist(), period[own].tolist(), strict=True))
                assert got == every_period(words), words


def test_short_steps_and_short_blocks_change_nothing(monkeypatch):
    words = np.array(([0, 1, 2] * 60 + [5] * 90 + list(range(7, 60)) * 3) * 3, np.int64)
    want = [c.tolist() for c in runs.runs_of(words, np.zeros(len(words), np.int64))]
    assert list(zip(want[0], (np.array(want[1]) - want[0]).tolist(), want[2], strict=True)) == every_period(words.tolist())
    monkeypatch.setattr(runs, "STEP", 50)
    monkeypatch.setattr(runs, "HASH_BYTES", 0)
    assert [c.tolist() for c in runs.runs_of(words, np.zeros(len(words), np.int64))] == want


def test_rules_have_one_expansion_and_trees_cover_each_text():
    rng = random.Random(5)
    words = np.array([rng.randrange(4) for _ in range(700)], np.int64)
    owner = np.repeat([0, 1, 2], [300, 1, 399])
    rule, start, middle, end = runs.repair(words, owner)
    expansion: dict[int, tuple] = {}
    for r, s, m, e in zip(rule.tolist(), start.tolist(), middle.tolist(), end.tolist(), strict=True):
        assert s < m < e and owner[s] == owner[e - 1]
        assert expansion.setdefault(r, (m - s, *words[s:e])) == (m - s, *words[s:e])
    assert len(rule) == 299 + 0 + 398  # a binary tree over each text
    assert len(expansion) < 0.8 * len(rule)


def test_long_repeats_are_linear_in_rules():
    words = np.zeros(1 << 16, np.int64)
    rule, *_ = runs.repair(words, words)
    assert len(np.unique(rule)) < 64
    start, end, period = runs.runs_of(np.arange(1 << 16) % 1000, words)
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [1 << 16], [1000])


def test_rows_of_all_kinds(spark):
    rows = texts()
    rows += [(600, "alpha beta\n" * 30 + "gamma " * 20 + "\t\x0b\x0c\r  end", "x"), (601, "a b " * 12, "x")]
    found = runs.runs(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    want = sorted((str(k), text or "") for k, text, _ in rows)
    got = []
    by_id = {}
    for k, text, _ in rows:
        by_id.setdefault(k, []).append(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    for r in found:
        words = next(w for w in by_id[r["doc_id"]] if len(w) == r["n_words"])
        listed = [(x["start"], x["length"], x["period"]) for x in r["runs"]]
        assert listed == every_period(words)
        assert r["collapsed"] == collapsed(words, listed)
        got.append(str(r["doc_id"]))
    assert sorted(got) == [k for k, _ in want]
    assert runs.runs(empty(spark)).count() == 0


def test_the_planted_tails_follow_the_rule(spark):
    from zlib import crc32

    from timeweave.llm.queries import with_planted_runs

    rows = [(k, " ".join(f"w{i}" for i in range(k % 70)), "s") for k in range(300)] + [(None, "a b c", "s"), (7000, None, "s")]
    got = {r["doc_id"]: r["text"] for r in with_planted_runs(frame(spark, rows)).collect()}
    planted = 0
    for k, text, _ in rows:
        words = (text or "").split()
        h = crc32(str(k).encode()) if k is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            planted += 1
        assert (got[k] or "").split() == words
    assert planted > 10
    with pytest.raises(Exception, match="period"):
        frame(spark).select("period").count()
