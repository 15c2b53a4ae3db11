"""Token ids of whole texts as ORC files that are read stripe by stripe.

Rows are dealt by ranges of (id, hash of the text) and sorted, encoded in that order and written as ORC: a row holds at most
``chunk`` ids of one text as an integer list (run-length encoded), so a very long text is many small rows.  The document id has
a row index every ``stride`` rows and a Bloom filter, so a lookup by id or range of ids reads the stripes and row groups that can
hold it only.  A row carries its range number ``part``, the text's number in it ``doc``, the ids of the range before it ``at`` and
those of the text after it ``rest``; the place of a text among all ids is ``at`` plus the sum of the ranges before.

Encoding looks at each distinct word of a slice of 8 MB once, marks after Latin letters apart from them, and keeps a bounded
cache of such pieces in the worker.  That is exact for a vocabulary that is indifferent to white space and case, ends pre-tokens
where letters end and maps a-z to themselves (``word_bpe_49k.json``); ``by_word=False`` encodes whole texts of any other
vocabulary.  All ids come from the library.

A file is finished whole or not at all and a lost executor costs its tasks only.  Reading needs no order of rows: a text whose
chunks lie in two stripes is put together by the checksum shifts that ``rest`` allows, without moving ids.

Defined results: null and empty texts have the end id only; null ids come first; texts of one id follow each other by the
hash of the text, equal rows in any order (they stay in one range, which is streamed); an empty table gives files without
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeweave.llm.runs import split_words
from timeweave.llm.store import shared_dir
from timeweave.llm.texts import raw_bytes, slices


@dataclass(frozen=True)
class TokenFiles:
    """``vocabulary``: a file of the tokenizers library.  ``cache_words`` bounds each of the two generations of a worker's word cache; ``slice_bytes`` of text
    are encoded at once; ``range_bytes`` is the text that one range should hold; ``chunk`` the ids of a row."""

    vocabulary: str
    end_id: int = 2
    by_word: bool = True
    cache_words: int = 1 << 19
    slice_bytes: int = 8 << 20
    range_bytes: int = 32 << 20
    chunk: int = 2048
    stride: int = 1000
    stripe_bytes: int = 16 << 20
    broadcast_rows: int = 100_000


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII marks that follow letters as a pre-token of their own (an apostrophe may not), and Latin letters.
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
LATIN_START = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+"
LATIN = LATIN_START + "$"
LETTERS = re.compile("[a-z]+")


def take(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` one after the other."""
    total = np.append(0, np.cumsum(size))
    return values[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]


_encoders: dict[TokenFiles, "Encoder"] = {}


def encoder_of(options: TokenFiles) -> "Encoder":
    """The encoder of this Python worker, whose cache outlives a task."""
    if options not in _encoders:
        _encoders.clear()
        _encoders[options] = Encoder(options)
    return _encoders[options]


class Encoder:
    """Ids of Arrow texts, one flat array a call."""

    def __init__(self, options: TokenFiles) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.options, self.tokenizer = options, Tokenizer.from_file(options.vocabulary)
        self.model = Tokenizer(self.tokenizer.model)
        self.forget()

    def forget(self) -> None:
        """Start a new cache; words of the one before are taken over as they come up."""
        self.old = (self.known, self.ids, self.first) if hasattr(self, "known") else ({}, np.zeros(0, np.uint32), np.zeros(1, np.int64))
        self.known: dict[str, int] = {}
        self.ids, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def raw(self, texts: list[str], tokenizer=None) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.cumsum([0, *map(len, found)])

    def learn(self, pieces: list[str]) -> None:
        """Put pieces that the cache lacks into it: those of the generation before, letters a-z, which need neither normaliser nor
        pre-tokenizer, and the others."""
        old, old_ids, old_first = self.old
        kept, new = [w for w in pieces if w in old], [w for w in pieces if w not in old]
        plain, other = [w for w in new if LETTERS.fullmatch(w)], [w for w in new if not LETTERS.fullmatch(w)]
        at = np.fromiter(map(old.__getitem__, kept), np.int64, len(kept))
        size = old_first[at + 1] - old_first[at]
        groups = [(take(old_ids, old_first[at], size), np.append(0, np.cumsum(size))), self.raw(plain, self.model), self.raw(other)]
        self.known |= zip([*kept, *plain, *other], range(len(self.known), len(self.known) + len(pieces)), strict=True)
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in groups)])
        self.first = np.append(self.first, self.first[-1] + np.cumsum(np.concatenate([np.diff(first) for _, first in groups])))

    def lookup(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece begin in the cache, and how many they are."""
        if len(self.known) + len(pieces) > self.options.cache_words:
            self.forget()
        new = [w for w in pieces if w not in self.known]
        if new:
            self.learn(new)
        slot = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        return self.first[slot], self.first[slot + 1] - self.first[slot]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of text d are ``ids[first[d]:first[d+1]]``."""
        if not self.options.by_word:
            return self.raw(column.fill_null("").to_pylist())
        first, words = split_words(column)
        table = words.dictionary_encode()
        distinct = table.dictionary
        # letters followed by marks are two pre-tokens; a-z is its own lower case
        stem = pc.utf8_rtrim(distinct, characters=MARKS)
        in_two = pc.and_(pc.match_substring_regex(stem, LATIN), pc.less(pc.binary_length(stem), pc.binary_length(distinct)))
        head = pc.if_else(in_two, stem, distinct)
        head = pc.if_else(pc.match_substring_regex(head, "^[A-Za-z]+$"), pc.ascii_lower(head), head)
        tail = pc.if_else(in_two, pc.replace_substring_regex(distinct, LATIN_START, ""), "")
        pieces = pa.concat_arrays([head, tail]).dictionary_encode()
        begin, size = self.lookup(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        n, place = len(distinct), pieces.indices.to_numpy()
        place = np.stack([place[:n], place[n:]], axis=1).ravel()  # head and tail of each word in turn
        ids = take(self.ids, begin[place], size[place])
        of_word = size[place].reshape(n, 2).sum(axis=1)
        word, starts = table.indices.to_numpy(), np.cumsum(of_word) - of_word
        return take(ids, starts[word], of_word[word]), np.append(0, np.cumsum(of_word[word]))[first]


def encoded(docs: DataFrame, options: TokenFiles, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, part, doc, at, rest, n, ids) in ascending order of id, ``part`` after ``part``."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // options.range_bytes))
    ordered = rows.repartitionByRange(parts, F.col("id").asc_nulls_first(), "hash").sortWithinPartitions(F.col("id").asc_nulls_first(), "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, doc, at = encoder_of(options), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            _, bounds = raw_bytes(batch.column(1))
            for low, high in slices(bounds, options.slice_bytes):
                ids, first = encoder.encode(batch.column(1).slice(low, high - low))
                n_docs, size = high - low, np.diff(first) + 1
                with_end = np.insert(ids, first[1:], options.end_id)
                chunks = -(-size // options.chunk)
                owner = np.repeat(np.arange(n_docs), chunks)
                within = (np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * options.chunk
                n = np.minimum(size[owner] - within, options.chunk)
                begin = np.append(0, np.cumsum(n))
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(with_end.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, n_docs).take(pa.array(owner)), pa.array(np.full(len(owner), part, np.int32)), pa.array(doc + owner), pa.array(at + begin[:-1]),
                     pa.array(size[owner] - within - n), pa.array(n.astype(np.int32)), lists],
                    names=["id", "part", "doc", "at", "rest", "n", "ids"],
                )
                doc, at = doc + n_docs, at + int(begin[-1])

    id_type = rows.schema["id"].dataType.simpleString()
    return ordered.select("id", "text").mapInArrow(run, f"id {id_type}, part int, doc long, at long, rest long, n int, ids array<int>").withColumnRenamed("id", id_col)


def write_tokens(docs: DataFrame, path: str, options: TokenFiles, id_col: str = "doc_id", text: str = "text") -> None:
    """Write the ids of ``docs`` to ORC files in the folder ``path``."""
    settings = {"bloom.filter.columns": id_col, "bloom.filter.fpp": "0.01", "row.index.stride": options.stride, "stripe.size": options.stripe_bytes, "compress": "zstd"}
    writer = encoded(docs, options, id_col, text).write
    for name, value in settings.items():
        writer = writer.option(f"orc.{name}", value)
    writer.orc(path)


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The rows of the files; ``where`` on the id reaches the stripes' metadata."""
    rows = spark.read.orc(path)
    return rows if where is None else rows.where(where)


def shifted(crc: int, zeros: int) -> int:
    """A checksum's share in that of its bytes followed by ``zeros`` more, up to the constant of empty input: the register times
    x^(8 zeros) modulo the CRC-32 polynomial, lowest bit first."""

    def times(a: int, b: int) -> int:
        out = 0
        for bit in range(31, -1, -1):
            out ^= b if a >> bit & 1 else 0
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, factor, left = 1 << 31, 1 << 23, zeros  # one, and x^8
    while left:
        power = times(power, factor) if left & 1 else power
        factor, left = times(factor, factor), left >> 1
    return times(crc, power)


def documents(spark: SparkSession, path: str, options: TokenFiles, id_col: str = "doc_id", where: Column | None = None) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every text in the files, or of those ``where`` asks for; ``start`` counts all texts before."""
    sizes = read_tokens(spark, path).groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range of texts
    offsets = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    rows = read_tokens(spark, path, where).select(F.col(id_col).alias("id"), "part", "doc", "at", "rest", "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rest = batch.column(6), batch.column(4).to_numpy()
            bounds = ids.offsets.to_numpy().astype(np.int64)
            data = memoryview(ids.values.to_numpy().astype("<u4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            for k in np.flatnonzero(rest).tolist():
                crc[k] = shifted(crc[k], 4 * int(rest[k]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 1, 2, 3, 5)), pa.array(crc, pa.int64())], names=["id", "part", "doc", "at", "n", "crc"])

    id_type = rows.schema["id"].dataType.simpleString()
    pieces = rows.mapInArrow(run, f"id {id_type}, part int, doc long, at long, n int, crc long")
    texts = pieces.groupBy("part", "doc").agg(F.first("id").alias("id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    texts = texts.join(F.broadcast(offsets) if offsets.count() <= options.broadcast_rows else offsets, F.col("part") == F.col("p"))
    return texts.select(F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, options: TokenFiles, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and read each text's place, size and checksum back from the files."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/llm-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, options, id_col, text)
    return documents(spark, path, options, id_col)
