"""Language-model scores by a probabilistic suffix tree over the bytes of lower-cased words.

A text is the sequence of its words' bytes, each word closed by a space and the text by an end mark, so every sequence of words
has a probability.  The tree's states are contexts of up to ``depth`` preceding bytes.  A context of at least ``min_count``
occurrences, whatever the size of the corpus, is retained when its next-byte distribution diverges from that of the context one
byte shorter: ``count * KL`` must exceed the Bayesian penalty for its distinct next bytes.  Suffixes of retained contexts are
retained too, and contexts of up to ``SHORT`` bytes always.  Distributions are smoothed by interpolation with the shorter
context, weighted by the number of distinct next bytes, down to the uniform one.  A byte is scored in the state of the longest
retained suffix before it.

The tree is never in one place.  Texts are stored in chunks; up to ``unit`` chunks of one writer are a unit of work.  A unit's
distinct (context, next byte) keys, with their counts in training texts, go to buckets by the three nearest bytes of the context,
packed, so a bucket holds whole subtrees: there counts are summed, contexts tested and kept, and every key of the bucket gets its
log probability.  These go back to the units that asked, which score their texts by look-up.  Both ways travel distinct keys of
units only, a few per cent of all bytes; buckets grow in number with the corpus and units are bounded, so neither outgrows a task.
Only the states of up to two bytes are broadcast: at most 2^24 pairs of context and byte, in UTF-8 text far fewer.  So are the
counts of frequent words; the tokens of other words join the word counts, which no frequent word can make uneven.

Defined results: a null text counts as empty and is one end token; a null id is never held out; repeated rows are scored each by
itself and count each in training; very long texts are chunks of their own; without training texts all scores are uniform and base
scores 0; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.store import written
from timeweave.llm.texts import LOWER, SAME, SPACED, mix, raw_bytes, slices, words

SPACE, END = 0x20, 0x0A
#: Stands for the end token among word hashes.
END_WORD = np.uint64(0x656E64)
#: Contexts of so many bytes are always states.
SHORT = 2


@dataclass(frozen=True)
class Tree:
    """``penalty`` scales the divergence test; ``smoothing`` is the weight of the shorter context for each distinct next byte.  Words
    of ``word_share`` of all tokens or more are broadcast with their counts, others are counted by a join.  ``unit`` chunks are
    scored together; a bucket is to hold the keys of about ``bucket_bytes`` of stored symbols."""

    depth: int = 6
    min_count: int = 4
    penalty: float = 0.25
    smoothing: float = 4.0
    folds: int = 7
    held_fold: int = 2
    word_share: float = 1e-6
    chunk_bytes: int = 1 << 20
    unit: int = 64
    bucket_bytes: int = 2 << 20


def symbols(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The texts as bytes: lower-cased words each with a space, and an end mark after each text."""
    found = words(data, bounds, SPACED, LOWER)
    lengths = found.ends - found.starts
    letters = LOWER[data[SPACED[data]]]
    word = np.repeat(np.arange(len(lengths)), lengths)
    out = np.full(len(letters) + len(lengths) + len(bounds) - 1, SPACE, np.uint8)
    out[np.arange(len(letters)) + word + found.owner[word]] = letters
    letters_before = np.concatenate([[0], np.cumsum(lengths)])[found.first[1:]]
    out[letters_before + found.first[1:] + np.arange(len(bounds) - 1)] = END
    return out


def chunks(docs: DataFrame, id_col: str, text: str, tree: Tree) -> DataFrame:
    """(chunk, ids, held, symbols): texts in chunks, their symbols compressed, so that a batch of chunks stays small; stored."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % tree.folds == tree.held_fold, F.lit(False))
    source = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text).alias("text"))
    schema = f"chunk long, ids array<{source.schema['id'].dataType.simpleString()}>, held array<boolean>, symbols binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, bounds = raw_bytes(batch.column(2))
            for at, to in slices(bounds, tree.chunk_bytes):
                ids, flags = (pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), batch.column(c).slice(at, to - at)) for c in (0, 1))
                stream = symbols(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
                yield pa.RecordBatch.from_arrays([pa.array([number]), ids, flags, pa.array([zstandard.ZstdCompressor(level=1).compress(stream.tobytes())], pa.binary())], names=["chunk", "ids", "held", "symbols"])
                number += 1

    return written(source.mapInArrow(run, schema))


def unpacked(value: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(value.as_buffer()), np.uint8)


def text_bounds(stream: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(stream == END) + 1])


def word_hashes(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end token after each text's words, and the number of the first token of each text."""
    bounds = text_bounds(stream)
    found = words(stream, bounds, SPACED, SAME)
    n = len(bounds) - 1
    out = np.empty(len(found.hashes) + n, np.uint64)
    out[np.arange(len(found.hashes)) + found.owner] = found.hashes
    first = found.first + np.arange(n + 1)
    out[first[1:] - 1] = END_WORD
    return out, first


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(counts, begin) if len(begin) else counts


def training_counts(stored: DataFrame, keys_of: Callable[[np.ndarray], np.ndarray], room: int = 1 << 20) -> DataFrame:
    """(key, n) over the training texts; a task sums equal keys, of which it holds about ``room``, before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            out = merged(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
            parts.clear()
            return out

        def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])

        for batch in batches:
            for row in range(batch.num_rows):
                stream = unpacked(batch.column(1)[row])
                train = np.repeat(~np.asarray(batch.column(0)[row].values), np.diff(text_bounds(stream)))
                own = np.sort(keys_of(stream[train]))
                begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
                parts.append((own[begin], np.diff(np.append(begin, len(own)))))
                if sum(len(k) for k, _ in parts) > room:
                    parts.append(summed())
                    if len(parts[0][0]) > room // 2:
                        yield rows(*parts.pop())
        if parts:
            yield rows(*summed())

    return stored.select("held", "symbols").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def word_counts(stored: DataFrame) -> DataFrame:
    """(key, n) by word hash, the end token among them."""
    return training_counts(stored, lambda stream: word_hashes(stream)[0])


def mask(depth: int) -> int:
    """Bits of the ``depth`` bytes before a symbol: the nearest is the highest byte."""
    return ((1 << 64) - 1) ^ ((1 << (64 - 8 * depth)) - 1)


def context_keys(stream: np.ndarray, depth: int) -> np.ndarray:
    """For each byte its context, nearest byte first, with the byte itself in the lowest place.  Contexts end at a text's start."""
    n = len(stream)
    bounds = text_bounds(stream)
    since = np.arange(n, dtype=np.int32) - np.repeat(bounds[:-1].astype(np.int32), np.diff(bounds))
    # the bytes of a key, least first: the symbol, then contexts from the farthest byte up to the nearest
    keys = np.zeros((n, 8), np.uint8)
    keys[:, 0] = stream
    for k in range(1, depth + 1):
        keys[k:, 8 - k] = stream[: max(0, n - k)]
        keys[since < k, 8 - k] = END
    return keys.view("<u8").ravel()


@dataclass(frozen=True)
class Model:
    """Per depth: sorted contexts with the log10 weight of the shorter state, sorted (context, byte) keys with log10 probabilities."""

    contexts: tuple[np.ndarray, ...] = ()
    weights: tuple[np.ndarray, ...] = ()
    entries: tuple[np.ndarray, ...] = ()
    scores: tuple[np.ndarray, ...] = ()

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each distinct (context, byte) key."""
        out = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        for d in range(len(self.contexts) - 1, -1, -1):
            own = keys[open_]
            context = own & np.uint64(mask(d))
            entry = context | (own & np.uint64(255))
            at = np.minimum(np.searchsorted(self.entries[d], entry), max(0, len(self.entries[d]) - 1))
            hit = self.entries[d][at] == entry if len(self.entries[d]) else np.zeros(len(own), bool)
            out[open_[hit]] += self.scores[d][at[hit]]
            open_, context = open_[~hit], context[~hit]
            if len(self.contexts[d]) and len(open_):
                at = np.minimum(np.searchsorted(self.contexts[d], context), len(self.contexts[d]) - 1)
                known = self.contexts[d][at] == context
                out[open_[known]] += self.weights[d][at[known]]
        out[open_] -= 8 * np.log10(2.0)  # the uniform distribution below the root
        return out


def level(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (context, byte) keys of one depth with their counts, from those of deeper contexts."""
    return merged(keys & np.uint64(mask(depth) | 255), counts)


def shorter(entries: np.ndarray, depth: int) -> np.ndarray:
    """The keys with their contexts, of ``depth`` bytes, one byte shorter."""
    return entries & np.uint64(mask(depth - 1) | 255)


def groups(entries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, begin, size) of sorted (context, byte) keys."""
    context = entries & np.uint64(mask(depth))
    begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
    return context[begin], begin, np.diff(np.append(begin, len(context)))


def grown(model: Model, entries: np.ndarray, counts: np.ndarray, tree: Tree) -> Model:
    """The model with the states of one more depth, smoothed towards those it has."""
    d = len(model.contexts)
    contexts, begin, size = groups(entries, d)
    total = np.add.reduceat(counts, begin).astype(np.float64) if len(begin) else np.zeros(0)
    spared = tree.smoothing * size
    lower = 10.0 ** model.scores[d - 1][np.searchsorted(model.entries[d - 1], shorter(entries, d))] if d and len(entries) else np.full(len(entries), 1 / 256)
    probability = (counts + np.repeat(spared, size) * lower) / np.repeat(total + spared, size)
    return Model((*model.contexts, contexts), (*model.weights, np.log10(spared / (total + spared))), (*model.entries, entries), (*model.scores, np.log10(probability)))


def short_levels(stored: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The (context, byte) counts of all contexts of up to ``SHORT`` bytes, by depth."""
    table = training_counts(stored, lambda stream: context_keys(stream, SHORT)).toArrow()
    keys, counts = np.asarray(table["key"]).astype(np.int64).view(np.uint64), np.asarray(table["n"]).astype(np.int64)
    return [level(keys, counts, d) for d in range(SHORT + 1)]


def subtrees(short: list[tuple[np.ndarray, np.ndarray]], model: Model, keys: np.ndarray, counts: np.ndarray, tree: Tree) -> Model:
    """``model``, the short states, with the retained states of the subtrees that ``keys`` make up whole, counted in training texts."""
    trained = counts > 0
    levels = {d: level(keys[trained], counts[trained], d) for d in range(SHORT + 1, tree.depth + 1)}
    kept: dict[int, np.ndarray] = {}
    below = np.zeros(0, np.uint64)  # contexts of this depth that deeper ones need
    for d in range(tree.depth, SHORT, -1):
        entries, n = levels[d]
        contexts, begin, size = groups(entries, d)
        if not len(entries):
            kept[d] = contexts
            continue
        parents, parent_n = levels[d - 1] if d - 1 > SHORT else short[d - 1]
        at = np.searchsorted(parents, shorter(entries, d))
        parent_contexts, parent_begin, _ = groups(parents, d - 1)
        parent_total = np.add.reduceat(parent_n, parent_begin)[np.searchsorted(parent_contexts, entries & np.uint64(mask(d - 1)))]
        total = np.add.reduceat(n, begin)
        gain = np.add.reduceat(n * np.log(n / np.repeat(total, size) / (parent_n[at] / parent_total)), begin)
        passed = (total >= tree.min_count) & (gain > tree.penalty * size * np.log(total))
        kept[d] = np.union1d(contexts[passed], below)
        below = np.unique(kept[d] & np.uint64(mask(d - 1)))
    for d in range(SHORT + 1, tree.depth + 1):
        entries, n = levels[d]
        inside = np.isin(entries & np.uint64(mask(d)), kept[d])
        model = grown(model, entries[inside], n[inside], tree)
    return model


def packed(values: np.ndarray) -> bytes:
    """Eight-byte numbers, like bytes together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def opened(value: pa.BinaryScalar, kind: type) -> np.ndarray:
    return np.ascontiguousarray(unpacked(value).reshape(8, -1).T).view(kind).ravel()


def pressed(parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Merge all parts into one; the parts are let go before the merge takes room of its own."""
    whole = [np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])]
    parts.clear()
    parts.append(merged(whole.pop(0), whole.pop()))


def asked_keys(stored: DataFrame, tree: Tree, buckets: int, room: int = 1 << 21, fresh: int = 3 << 19) -> DataFrame:
    """(bucket, unit, keys, counts): the distinct deepest keys of each unit, sorted, with their counts in its training texts.  A task
    holds about ``room`` merged keys and ``fresh`` others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        unit = -1

        def rows() -> pa.RecordBatch:
            pressed(parts)
            keys, counts = parts.pop()
            bucket = (mix(keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            keys, counts, bucket = keys[order], counts[order], bucket[order]
            begin = np.flatnonzero(np.append(True, np.diff(bucket) != 0)) if len(bucket) else np.zeros(0, np.int64)
            spans = list(zip(begin.tolist(), [*begin[1:].tolist(), len(bucket)], strict=True)) if len(begin) else []
            blobs = [[packed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in spans], [packed(counts[a:b].astype(np.int64)) for a, b in spans]]
            return pa.RecordBatch.from_arrays([pa.array(bucket[begin]), pa.array(np.full(len(begin), unit)), *(pa.array(x, pa.binary()) for x in blobs)], names=["bucket", "unit", "keys", "counts"])

        for batch in batches:
            for row in range(batch.num_rows):
                own_unit = batch.column(0)[row].as_py() // tree.unit
                if parts and own_unit != unit:
                    yield rows()
                elif sum(len(k) for k, _ in parts[1:]) > fresh:
                    pressed(parts)
                    if len(parts[0][0]) > room:
                        yield rows()
                unit = own_unit
                stream = unpacked(batch.column(2)[row])
                train = np.repeat(~np.asarray(batch.column(1)[row].values), np.diff(text_bounds(stream))).astype(np.int8)  # summed as long
                parts.append(merged(context_keys(stream, tree.depth), train))
        if parts:
            yield rows()

    return stored.select("chunk", "held", "symbols").mapInArrow(run, "bucket int, unit long, keys binary, counts binary")


def answered(asked: DataFrame, short: list[tuple[np.ndarray, np.ndarray]], model: Model, tree: Tree) -> DataFrame:
    """(unit, keys, scores): the log10 probabilities of the keys that each unit asked for."""
    query = asked.sparkSession.sparkContext.broadcast((short, model))

    def run(table: pa.Table) -> pa.Table:
        short, model = query.value
        keys = [np.cumsum(opened(k, np.uint64), dtype=np.uint64) for k in table["keys"]]
        counts = [opened(n, np.int64) for n in table["counts"]]
        all_keys, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts), minlength=len(all_keys)).astype(np.int64)
        scores = subtrees(short, model, all_keys, total, tree).log10(all_keys)[place]
        ends = np.cumsum([0, *map(len, keys)])
        blobs = [packed(scores[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"unit": table["unit"], "keys": table["keys"], "scores": pa.array(blobs, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, "unit long, keys binary, scores binary")


def frequent_words(counted: DataFrame, n_train: int, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the words that make up ``word_share`` of all tokens or more: at most its inverse."""
    table = counted.where(F.col("n") >= max(1, int(np.ceil(tree.word_share * n_train)))).toArrow()
    keys, counts = np.asarray(table["key"]).astype(np.int64).view(np.uint64), np.asarray(table["n"]).astype(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tree: Tree = Tree()) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    stored = chunks(docs, id_col, text, tree)
    counted = written(word_counts(stored))
    n_train, n_words = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    short = short_levels(stored)
    model = Model()
    for entries, n in short if len(short[0][0]) else ():
        model = grown(model, entries, n, tree)
    size = stored.agg(F.coalesce(F.sum(F.octet_length("symbols")), F.lit(0))).first()[0]
    spark = docs.sparkSession
    buckets = max(4 * spark.sparkContext.defaultParallelism, -(-size // tree.bucket_bytes))
    answers = answered(asked_keys(stored, tree, buckets), short, model, tree)
    query = spark.sparkContext.broadcast(frequent_words(counted, n_train, tree))
    id_type = stored.schema["ids"].dataType.elementType.simpleString()
    schema = f"chunk long, place int, id {id_type}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>"
    depth, spread = tree.depth, float(np.log10(n_train + 1.0 * (n_words + 1)))

    def run(chunks: pa.Table, told: pa.Table) -> pa.Table:
        names, counts = query.value
        known_keys = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(opened(k, np.uint64), dtype=np.uint64) for k in told["keys"])])
        order = np.argsort(known_keys)
        known_keys = known_keys[order]
        # a key asked for twice has one score, so equal keys may stay
        known_scores = np.concatenate([np.zeros(0), *(opened(v, np.float64) for v in told["scores"])])[order]
        del told, order
        parts = []
        for chunk, ids, held, value in zip(chunks["chunk"], chunks["ids"], chunks["held"], chunks["symbols"], strict=True):
            stream = unpacked(value)
            bounds = text_bounds(stream)
            tokens, first = word_hashes(stream)
            at = np.minimum(np.searchsorted(names, tokens), max(0, len(names) - 1))
            known = names[at] == tokens if len(names) else np.zeros(len(tokens), bool)
            base = np.add.reduceat(np.where(known, np.log10(counts[at] + 1.0) if len(names) else 0.0, 0.0), first[:-1]) - np.diff(first) * spread
            unknown = np.concatenate([[0], np.cumsum(~known)])[first]
            rare = pa.ListArray.from_arrays(pa.array(unknown, pa.int32()), pa.array(tokens[~known].view(np.int64)))
            keys = context_keys(stream, depth)
            order = np.argsort(keys)
            ordered = keys[order]
            fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            each = np.empty(len(keys))
            each[order] = known_scores[np.searchsorted(known_keys, ordered[fresh])][np.cumsum(fresh) - 1]
            n = len(bounds) - 1
            columns = [
                pa.array(np.full(n, chunk.as_py())), pa.array(np.arange(n, dtype=np.int32)), ids.values, held.values, pa.array(np.diff(first).astype(np.int64)),
                pa.array(np.add.reduceat(known.astype(np.int64), first[:-1])), pa.array(base), pa.array(np.add.reduceat(each, bounds[:-1])), rare,
            ]
            parts.append(pa.table(columns, names=["chunk", "place", "id", "held_out", "n_tokens", "n_known", "base", "score", "rare"]))
        return pa.concat_tables(parts)

    by_unit = stored.withColumn("unit", F.expr(f"chunk DIV {tree.unit}"))
    scored = written(by_unit.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(run, schema))
    # a word that no training text has adds log10(1) and is not known, so an inner join tells all
    asked = scored.select("chunk", "place", F.explode("rare").alias("key")).join(counted, "key")
    more = asked.groupBy("chunk", "place").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more_base"), F.count(F.lit(1)).alias("more_known"))
    found = scored.drop("rare").join(more, ["chunk", "place"], "left")
    return found.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
    )
