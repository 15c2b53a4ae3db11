"""Periodic runs of words by grammar compression.

A run is a stretch of words with smallest period q, at least ``max(least, 2 q)`` words long, that no neighbour extends with
period q.  A slice of whole texts is handled at once:

* Re-Pair replaces, in rounds, every pair of symbols that is more frequent than both pairs it overlaps (so the most frequent
  pair of all is replaced in every round, and pairs out of its reach along with it) until no pair occurs twice.  A pair seen
  once can never be part of a repeated one again, so what holds only such pairs leaves the working sequence.  The symbols left
  of each text are joined two by two into one tree.
* A run lies whole in the smallest node that holds it and crosses that node's boundary, and at six words or more it agrees
  with its own shift next to that boundary in a trigram on one side.  So for each nonterminal, once, the places of its
  expansion with the boundary's trigrams give the periods to try; each is extended both ways by doubling block hashes.
* These runs are translated to all derivation positions of their nonterminal, and only maximal intervals of one period are
  kept: a run cut by the end of a node lies in the whole run, which its own node yields.

Words are numbered exactly (by dictionary, not by hash); stretches are compared by 64-bit hashes of up to ``2^top`` words.
Memory is that of one slice of 2 MB, or of one longer text (about 130 bytes a word); a slice is a whole task step of its own,
so a lost executor costs its tasks only.  No shuffle: rows are independent, so a hot group of copies costs what its rows cost.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; null, empty and blank texts have no words and no runs; repeated rows are judged
each by itself; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.texts import mix, raw_bytes, slices

LEAST = 12
#: Queries of one step of ``crossing``.
STEP = 1 << 20
#: Bytes of block hashes that one slice may hold; longer blocks are then compared piece by piece.
HASH_BYTES = 256 << 20


def split_words(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(first, words): the words ``[^\\x20\\x09-\\x0D]+`` of all texts, text d from ``first[d]`` to ``first[d+1]``."""
    parts = pc.ascii_split_whitespace(column.fill_null("") if column.null_count else column)
    words, at = parts.flatten(), parts.offsets.to_numpy()
    full = pc.not_equal(pc.binary_length(words), 0)
    count = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return count[at - at[0]].astype(np.int64), words.filter(full)


def repair(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rule, start, middle, end) of every node of the derivation trees of all texts; equal rules have equal expansions."""
    n, top = len(symbols), int(symbols.max()) + 1 if len(symbols) else 0
    begins = np.ones(n, bool)  # word positions where a symbol of the present sequence begins
    nodes: list[tuple[np.ndarray, ...]] = []
    seq, start, end = symbols.astype(np.int64), np.arange(n), np.arange(1, n + 1)
    joined = np.append(owner[:-1] == owner[1:], False) if n else np.zeros(0, bool)
    while len(seq):
        at = np.flatnonzero(joined)
        if not len(at):
            break
        pairs, inverse, count = np.unique(seq[at] * top + seq[at + 1], return_inverse=True, return_counts=True)
        once = count < 2
        rank = np.zeros(len(pairs), np.int64)
        rank[np.lexsort((mix(pairs.astype(np.uint64)), count))] = np.arange(1, len(pairs) + 1)
        rank[once] = 0
        joined[at[once[inverse]]] = False
        weight = np.zeros(len(seq) + 1, np.int64)  # of the pair that begins at a place; the last one is nothing
        weight[at] = rank[inverse]
        best = np.flatnonzero((weight[:-1] > 0) & (weight[:-1] >= np.append(0, weight[:-2])) & (weight[:-1] >= weight[1:]))
        if not len(best):
            break
        # a pair of one symbol overlaps itself: every other one counts from the left
        lead = np.append(True, np.diff(best) > 1)
        best = best[(best - best[lead][np.cumsum(lead) - 1]) % 2 == 0]
        kind = np.full(len(seq), -1, np.int64)
        kind[at] = inverse
        _, rule = np.unique(kind[best], return_inverse=True)
        nodes.append((top + rule, start[best], start[best + 1], end[best + 1]))
        begins[start[best + 1]] = False
        seq[best], end[best], joined[best] = top + rule, end[best + 1], joined[best + 1]
        top += int(rule.max()) + 1
        keep = np.ones(len(seq), bool)
        keep[best + 1] = False
        seq, start, end, joined = seq[keep], start[keep], end[keep], joined[keep]
        live = joined | np.append(False, joined[:-1])
        seq, start, end, joined = seq[live], start[live], end[live], joined[live]
    # the rest of each text, two by two
    start = np.flatnonzero(begins)
    text = owner[start]
    while len(start):
        new_text = np.append(True, text[1:] != text[:-1])
        if new_text.all():
            break
        place = np.arange(len(start)) - np.flatnonzero(new_text)[np.cumsum(new_text) - 1]
        second = place % 2 == 1
        stop = np.append(np.where(new_text[1:], np.searchsorted(owner, text[:-1], side="right"), start[1:]), n)
        k = np.flatnonzero(second)
        nodes.append((top + np.arange(len(k)), start[k - 1], start[k], stop[k]))
        top += len(k)
        start, text = start[~second], text[~second]
    if not nodes:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(column) for column in zip(*nodes, strict=True))


class Extender:
    """How far two places of one sequence agree, by hashes of blocks of 1, 2, 4, ... words."""

    def __init__(self, symbols: np.ndarray, longest: int) -> None:
        n = len(symbols)
        top = max(0, min(int(longest).bit_length() - 1, max(8, HASH_BYTES // (8 * max(n, 1)))))
        self.blocks = [mix(symbols.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))]
        for k in range(top):
            half, width = self.blocks[-1], 1 << k
            if n < 2 * width:
                break
            self.blocks.append(mix(half[: n - 2 * width + 1] * np.uint64(0xD6E8FEB86659FD93) ^ mix(half[width : n - width + 1])))

    def reach(self, one: np.ndarray, two: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """Words that agree from ``one`` and ``two`` on (``back``: before them), at most ``limit``."""
        done = np.zeros(len(one), np.int64)
        for k in range(len(self.blocks) - 1, -1, -1):
            width, block = 1 << k, self.blocks[k]
            open_ = np.flatnonzero(done + width <= limit)
            while len(open_):
                shift = -done[open_] - width if back else done[open_]
                open_ = open_[block[one[open_] + shift] == block[two[open_] + shift]]
                done[open_] += width
                if k < len(self.blocks) - 1:
                    break
                open_ = open_[done[open_] + width <= limit[open_]]
        return done


def least_period(group: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Rows with the smallest period of each (group, start, end)."""
    order = np.lexsort((period, end, start, group))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(group[order]) != 0) | (np.diff(start[order]) != 0) | (np.diff(end[order]) != 0)
    return order[first]


def crossing(symbols: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(node, from, to, period) of the runs, maximal within their node, at the boundary of each node."""
    none = (np.zeros(0, np.int64),) * 4
    n = len(symbols)
    if n < least or not len(start):
        return none
    extender = Extender(symbols, int((end - start).max()))
    one = extender.blocks[0]
    trigram = mix(mix(one[:-2] * np.uint64(0xD6E8FEB86659FD93) ^ mix(one[1:-1])) * np.uint64(0xD6E8FEB86659FD93) ^ mix(one[2:]))
    _, number = np.unique(trigram, return_inverse=True)
    places = np.sort(number * n + np.arange(len(number)))  # by trigram, then position
    found = []
    for shift in (0, 3):
        at = middle - shift
        node = np.flatnonzero((at >= start) & (at + 3 <= end))
        low = np.searchsorted(places, number[at[node]] * n + start[node])
        size = np.searchsorted(places, number[at[node]] * n + end[node] - 2) - low
        node, low, size = node[size > 1], low[size > 1], size[size > 1]
        total = np.append(0, np.cumsum(size))
        for begin in range(0, int(total[-1]), STEP):
            flat = np.arange(begin, min(begin + STEP, int(total[-1])))
            k = np.searchsorted(total, flat, side="right") - 1
            other = places[low[k] + flat - total[k]] % n + shift
            k = node[k][other != middle[node[k]]]
            other = other[other != middle[node[np.searchsorted(total, flat, side="right") - 1]]]
            left, right = np.minimum(other, middle[k]), np.maximum(other, middle[k])
            period = right - left
            need = np.maximum(period, least - period)
            ahead = extender.reach(left, right, end[k] - right, back=False)
            behind = extender.reach(left, right, left - start[k], back=True)
            good = np.flatnonzero(ahead + behind >= need)
            rows = (k[good], (left - behind)[good], (right + ahead)[good], period[good])
            first = least_period(*rows)
            found.append(tuple(c[first] for c in rows))
    if not found:
        return none
    rows = tuple(np.concatenate(c) for c in zip(*found, strict=True))
    first = least_period(*rows)
    return tuple(c[first] for c in rows)


def maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The intervals of each period that lie in no other of the same period, each with its smallest period, in order."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    group = np.cumsum(np.append(0, np.diff(period) != 0)) if len(period) else period
    size = int(end.max()) + 1 if len(end) else 1
    reach = np.maximum.accumulate(end + group * size) if len(end) else end
    outside = np.ones(len(end), bool)
    outside[1:] = end[1:] + group[1:] * size > reach[:-1]
    start, end, period = start[outside], end[outside], period[outside]
    first = least_period(np.zeros(len(start), np.int64), start, end, period)
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs_of(symbols: np.ndarray, owner: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of all texts, as positions in ``symbols``, by start and period."""
    rule, start, middle, end = repair(symbols, owner)
    wide = end - start >= least
    rule, start, middle, end = rule[wide], start[wide], middle[wide], end[wide]
    order = np.argsort(rule, kind="stable")
    rule, start, middle, end = rule[order], start[order], middle[order], end[order]
    _, first, count = np.unique(rule, return_index=True, return_counts=True)
    node, low, high, period = crossing(symbols, start[first], middle[first], end[first], least)
    # to all derivation positions of the rule
    times = count[node]
    total = np.append(0, np.cumsum(times))
    kept = (np.zeros(0, np.int64),) * 3
    step_ends = np.unique(np.append(np.searchsorted(total, np.arange(STEP, int(total[-1]), STEP)), len(node)))
    begin = 0
    for stop in step_ends.tolist():
        k = np.repeat(np.arange(begin, stop), times[begin:stop])
        place = first[node[k]] + np.arange(len(k)) - (total[k] - total[begin])
        shift = start[place] - start[first[node[k]]]
        kept = maximal(*(np.concatenate(c) for c in zip(kept, (low[k] + shift, high[k] + shift, period[k]), strict=True)))
        begin = stop
    return kept


def runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_words, runs, collapsed) per row: ``runs`` has (start, length, period) by start and period; ``collapsed`` are the words
    that are in the first period of every run they belong to, or in none, joined by one space."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, bounds = raw_bytes(batch.column(1))
            for at, to in slices(bounds):
                first, words = split_words(batch.column(1).slice(at, to - at))
                symbols = words.dictionary_encode().indices.to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(to - at), np.diff(first))
                start, end, period = runs_of(symbols, owner, least)
                edge = np.zeros(len(symbols) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, end, -1)
                keep = np.cumsum(edge[:-1]) == 0
                left = np.append(0, np.cumsum(keep))[first]
                collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(keep))), " ")
                rows = pa.StructArray.from_arrays([pa.array(c) for c in (start - first[owner[start]], end - start, period)], fields=list(run_type))
                of_text = np.searchsorted(owner[start], np.arange(to - at + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), rows), collapsed],
                    names=["id", "n_words", "runs", "collapsed"],
                )

    id_type = source.schema["id"].dataType.simpleString()
    found = source.mapInArrow(find, f"id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)
