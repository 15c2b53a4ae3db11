"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores the training texts as index segments: a row holds the posting lists of all tokens of a few megabytes of
consecutive texts (sorted token hashes, list offsets, positions), so the index is complete, independent of any benchmark and
as evenly spread as the text itself; a token that makes up a third of all text is spread over all segments.

``search`` takes test items as blocks of queries against all segments.  It first sums the list lengths of the test tokens over
the whole index, reading only the two small columns of each segment.  In a segment, a window of an item is looked up from its
rarest token on: the positions, less the token's offset, are intersected with the offset-adjusted lists of the other tokens in
order of rarity until none is left; what remains are exact phrase matches.  Proximity matches need only the rarest tokens of a
window, each within ``slop`` words of its place.

Tokens are compared by 64-bit hashes of their bytes, thirteen in a row for a full window.

Defined results: words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null and empty texts have none and
are never contaminated; items without a word match nothing, items shorter than a window are one window; items of one id are
one item, a null id counts as the empty string; repeated documents are judged each by itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from timeweave.llm.store import written
from timeweave.llm.texts import ALNUM, LOWER, sliced_words

WINDOW = 13
#: Unused positions between texts of a segment, so that no window reaches from one text into the next.
GAP = 64


@dataclass(frozen=True)
class Search:
    """``block_words`` bounds the item words that one block of queries broadcasts (8 bytes each); ``near_terms`` and ``slop`` define
    proximity: that many of a window's rarest tokens, each within ``slop`` words of its place."""

    window: int = WINDOW
    block_words: int = 1 << 20
    near_terms: int = 6
    slop: int = 2


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(segment, ids, keys, first, terms, lists, positions): segments of the positional index, stored in the shared folder.
    ``keys`` are hashes of the texts, ``first`` the number of each text's first word in its segment; positions count words, and
    ``GAP`` more after each text."""
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    schema = f"segment long, ids array<{source.schema['id'].dataType.simpleString()}>, keys array<long>, first binary, terms binary, lists binary, positions binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, to, found in sliced_words(batch.column(2), ALNUM, LOWER):
                order = np.argsort(found.hashes, kind="stable")
                gapped = (np.arange(len(found.hashes)) + found.owner * GAP).astype(np.int32)
                terms, lists = np.unique(found.hashes[order], return_index=True)
                lists = np.append(lists, len(order))
                blobs = (found.first.astype(np.int64), terms, lists.astype(np.int64), gapped[order])
                ids, keys = (pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), batch.column(c).slice(at, to - at)) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([number]), ids, keys, *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], names=["segment", "ids", "keys", "first", "terms", "lists", "positions"])
                number += 1

    return written(source.mapInArrow(run, schema))


def item_tokens(items: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words) with the token hashes of every item that has a word."""
    source = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, found in sliced_words(batch.column(1), ALNUM, LOWER):
                lists = pa.ListArray.from_arrays(pa.array(found.first, pa.int32()), pa.array(found.hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists], names=["item", "words"])

    return source.mapInArrow(run, "item string, words array<long>").where("size(words) > 0")


def windows_of(tokens: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows as rows of ``width`` token hashes, their lengths, and (item, window) pairs."""
    rows, owner, lengths = [], [], []
    for item, words in enumerate(tokens):
        size = min(width, len(words))
        own = np.lib.stride_tricks.sliding_window_view(words, size)
        padded = np.zeros((len(own), width), np.uint64)
        padded[:, :size] = own
        rows.append(padded)
        owner.append(np.full(len(own), item))
        lengths.append(np.full(len(own), size))
    table = np.column_stack([np.concatenate(rows), np.concatenate(lengths).astype(np.uint64)])
    distinct, inverse = np.unique(table, axis=0, return_inverse=True)
    return distinct[:, :width], distinct[:, width].astype(np.int64), np.column_stack([np.concatenate(owner), inverse.ravel()])


def intersect(starts: np.ndarray, others: Iterator[tuple[np.ndarray, int]], slop: int = 0) -> np.ndarray:
    """Starts with a position of every other list at its offset, or within ``slop`` of it."""
    for positions, offset in others:
        if not len(starts):
            break
        at = np.searchsorted(positions, starts + (offset - slop))
        nearest = positions[np.minimum(at, len(positions) - 1)] - offset
        starts = starts[(at < len(positions)) & (nearest <= starts + slop)]
    return starts


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", options: Search = Search()) -> DataFrame:
    """(id, key, n_words, n_hit, items, near_items) for every document of the index, in no order."""
    tokens = written(item_tokens(items, item_id, item_text))
    total = tokens.agg(F.sum(F.size("words"))).first()[0] or 0
    n_blocks = max(1, -(-total // options.block_words))
    found = None
    for block in range(n_blocks):
        part = tokens.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).toArrow().to_pandas()
        hits = search_block(index, part, options)
        found = hits if found is None else found.unionByName(hits)
    if n_blocks > 1:
        found = found.groupBy("segment", "place").agg(
            F.first("id").alias("id"), F.first("key").alias("key"), F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("near_items")).alias("near_items"),
        )
    covered = span_words(F.col("spans")) if n_blocks > 1 else F.col("n_hit")
    return found.select("id", "key", "n_words", covered.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), F.array_sort(F.array_distinct("near_items")).alias("near_items"))


@pandas_udf(T.LongType())
def span_words(spans: pd.Series) -> pd.Series:
    """Words in the union of spans given as begin, end, begin, end, ..."""

    def covered(flat: np.ndarray) -> int:
        reach, total = 0, 0
        for begin, end in sorted(zip(flat[::2], flat[1::2], strict=True)):
            total += max(0, end - max(begin, reach))
            reach = max(reach, end)
        return total

    return spans.map(covered)


def search_block(index: DataFrame, part: pd.DataFrame, options: Search) -> DataFrame:
    """Matches of one block of items in all segments."""
    if options.window + options.slop >= GAP:
        raise ValueError(f"window and slop must stay below {GAP}")
    spark = index.sparkSession
    merged: dict[str, list[np.ndarray]] = {}
    for item, words in zip(part["item"], part["words"], strict=True):
        merged.setdefault(item, []).append(np.asarray(words, np.int64).view(np.uint64))
    names = sorted(merged)
    texts = [(k, words) for k, item in enumerate(names) for words in merged[item]]
    none = np.zeros((0, options.window), np.uint64)
    windows, lengths, pairs = windows_of([w for _, w in texts], options.window) if texts else (none, np.zeros(0, np.int64), np.zeros((0, 2), np.int64))
    if texts:
        pairs[:, 0] = np.array([k for k, _ in texts])[pairs[:, 0]]
    used = np.arange(options.window) < lengths[:, None]
    terms = np.unique(windows[used])
    sizes = list_sizes(index, terms)
    place = np.where(used, np.searchsorted(terms, windows), 0)
    rarity = np.where(used, sizes[place] if len(terms) else 0, np.iinfo(np.int64).max)
    rarity = np.where(rarity == 0, np.iinfo(np.int64).max, rarity)  # tokens that no text has come last
    order = np.argsort(rarity, axis=1, kind="stable")
    occurs = (used & (rarity < np.iinfo(np.int64).max)).sum(axis=1)
    by_window = np.argsort(pairs[:, 1], kind="stable")
    query = spark.sparkContext.broadcast((terms, place, used, order, lengths, occurs, pairs[by_window, 0], np.searchsorted(pairs[by_window, 1], np.arange(len(windows) + 1)), names))
    id_type = index.schema["ids"].dataType.elementType.simpleString()
    near_terms, slop = options.near_terms, options.slop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, place, used, order, lengths, occurs, owners, owned, names = query.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, keys = batch.column(1)[row].values, batch.column(2)[row].values
                first = np.frombuffer(batch.column(3)[row].as_py(), np.int64)
                own, lists = np.frombuffer(batch.column(4)[row].as_py(), np.uint64), np.frombuffer(batch.column(5)[row].as_py(), np.int64)
                positions = np.frombuffer(batch.column(6)[row].as_py(), np.int32)
                at = np.minimum(np.searchsorted(own, terms), max(len(own) - 1, 0))
                there = own[at] == terms if len(own) else np.zeros(len(terms), bool)
                held = there[place] & used if len(terms) else used

                def posting(window: int, k: int) -> tuple[np.ndarray, int]:
                    list_no = at[place[window, k]]
                    return positions[lists[list_no] : lists[list_no + 1]], k

                n_texts = len(ids)
                begin = first + np.arange(n_texts + 1) * GAP
                edge = np.zeros(int(begin[-1]) + 1, np.int64)
                spans: list[list[int]] = [[] for _ in range(n_texts)]
                exact: list[set[int]] = [set() for _ in range(n_texts)]
                near: list[set[int]] = [set() for _ in range(n_texts)]
                anchors = np.minimum(near_terms, lengths)
                first_held = np.take_along_axis(held, order, axis=1)[:, :near_terms]
                for window in np.flatnonzero((occurs >= anchors) & (first_held.sum(axis=1) >= anchors)):
                    size, ranked = int(lengths[window]), order[window][: lengths[window]].tolist()
                    lead, offset = posting(window, ranked[0])
                    starts = lead.astype(np.int64) - offset
                    close = intersect(starts, (posting(window, k) for k in ranked[1:near_terms]), slop)
                    if not len(close):
                        continue
                    items = owners[owned[window] : owned[window + 1]].tolist()
                    for d in np.unique(np.searchsorted(begin, close + offset, side="right") - 1).tolist():
                        near[d].update(items)
                    if held[window].sum() < size:
                        continue
                    starts = intersect(close, (posting(window, k) for k in ranked[1:]))
                    doc = np.searchsorted(begin, starts, side="right") - 1
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + size, -1)
                    for d, s in zip(doc.tolist(), (starts - begin[doc]).tolist(), strict=True):
                        exact[d].update(items)
                        spans[d] += (s, s + size)
                hit = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n_texts, batch.column(0)[row].as_py())), pa.array(np.arange(n_texts)), ids, keys,
                        pa.array(np.diff(first)), pa.array(hit[begin[1:]] - hit[begin[:-1]]), pa.array(spans, pa.list_(pa.int64())),
                        pa.array([[names[i] for i in x] for x in exact], pa.list_(pa.string())), pa.array([[names[i] for i in x] for x in near], pa.list_(pa.string())),
                    ],
                    names=["segment", "place", "id", "key", "n_words", "n_hit", "spans", "items", "near_items"],
                )

    return index.mapInArrow(run, f"segment long, place long, id {id_type}, key long, n_words long, n_hit long, spans array<long>, items array<string>, near_items array<string>")


def list_sizes(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Number of postings of each of the sorted ``terms`` in the whole index."""
    query = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(query.value), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                own, lists = np.frombuffer(batch.column(0)[row].as_py(), np.uint64), np.frombuffer(batch.column(1)[row].as_py(), np.int64)
                if len(own):
                    at = np.minimum(np.searchsorted(own, query.value), len(own) - 1)
                    total += np.where(own[at] == query.value, lists[at + 1] - lists[at], 0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    sums = index.select("terms", "lists").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    sizes = np.zeros(len(terms), np.int64)
    sizes[sums["term"]] = sums["n"]
    return sizes


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", options: Search = Search()) -> DataFrame:
    """(id, key, n_words, n_hit, items, near_items, contaminated) per row; contaminated from one hit word in twenty."""
    found = search(build_index(docs, id_col, text), items, item_id, item_text, options)
    return found.withColumnRenamed("id", id_col).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with its columns."""
    bad = contamination(docs, items, id_col, text, **options).where("contaminated").select(F.col(id_col).alias("bad_id"), F.col("key").alias("bad_key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text).alias("key"))
    return rows.join(bad, rows["id"].eqNullSafe(bad["bad_id"]) & (rows["key"] == bad["bad_key"]), "left_anti").select("doc.*")
