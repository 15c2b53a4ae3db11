"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio between trusted texts and the whole corpus.

Every text is a bag of its overlapping byte n-grams (4 bytes, case kept), hashed into a fixed number of buckets.  Two
multinomials are counted over the buckets, one from the trusted texts and one from all texts; a text's verdict is
``sum(log p_trusted - log p_raw) / n_grams >= threshold``.  Both counts come from every row, are summed per task before they
are shuffled, and the model is one vector of ``buckets`` doubles whatever the input size, so it can be broadcast.

Defined results: a null text counts as empty; a text without words has ratio 0 and fails the base rules; without any trusted
text all ratios are 0; repeated rows are judged alike, each by itself; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from timeweave.llm.texts import SAME, SPACED, Words, per_text_sum, raw_bytes, sliced_words, slices, window_hash

SYMBOLS = b"#*$%&|<>"
GRAM = 4
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "base_failed", "kept")


@dataclass(frozen=True)
class Rules:
    """Thresholds of the base rules and of the ratio; ``buckets`` is a power of two, ``max_trusted`` bounds the trusted sample."""

    min_words: int = 10
    max_repeat_percent: int = 20
    repeat_window: int = 5
    min_ratio: float = -0.15
    buckets: int = 1 << 16
    max_trusted: int = 100_000


def gram_buckets(data: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte; n-grams may run over the end of a text, callers cut them off."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(GRAM):
        key = (key << np.uint64(8)) | data[k : k + n]
    key *= np.uint64(0x9E3779B97F4A7C15)
    return (key >> np.uint64(64 - int(buckets).bit_length() + 1)).astype(np.int64)


def gram_ranges(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last n-gram of each text."""
    return bounds[:-1], np.maximum(bounds[:-1], bounds[1:] - GRAM + 1)


def trusted_keys(labels: DataFrame, id_col: str = "doc_id", most: int = 100_000) -> np.ndarray:
    """Sorted hashes of the ids labelled with quality 1: all of them, or the ``most`` least hashes (a uniform sample)."""
    keys = labels.where((F.col("quality") == 1) & F.col(id_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string")).alias("key"))
    return keys.distinct().orderBy("key").limit(most).toArrow().to_pandas()["key"].to_numpy(np.int64)


def gram_counts(docs: DataFrame, trusted: np.ndarray, id_col: str = "doc_id", text: str = "text", buckets: int = 1 << 16) -> DataFrame:
    """(bucket, n_raw, n_trusted) over all texts; ``trusted`` has the key hashes of the trusted rows, a null id is never one."""
    keys = docs.sparkSession.sparkContext.broadcast(np.sort(trusted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            data, bounds = raw_bytes(batch.column(0))
            chosen = np.isin(np.asarray(batch.column(1).fill_null(0)), keys.value) & np.asarray(batch.column(1).is_valid())
            for at, to in slices(bounds):
                part = gram_buckets(data[bounds[at] : bounds[to]], buckets)
                begin, end = gram_ranges(bounds[at : to + 1] - bounds[at])
                edge = np.zeros(len(part) + 1, np.int64)
                np.add.at(edge, np.minimum(begin, len(part)), 1)
                np.add.at(edge, np.minimum(end, len(part)), -1)
                own = np.cumsum(edge)[:-1] > 0
                raw += np.bincount(part[own], minlength=buckets)
                edge = np.zeros(len(part) + 1, np.int64)
                np.add.at(edge, np.minimum(begin, len(part))[chosen[at:to]], 1)
                np.add.at(edge, np.minimum(end, len(part))[chosen[at:to]], -1)
                good += np.bincount(part[np.cumsum(edge)[:-1] > 0], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "n_raw", "n_trusted"])

    key = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string")))
    rows = docs.select(F.col(text).alias("text"), key.alias("key")).mapInArrow(count, "bucket long, n_raw long, n_trusted long")
    return rows.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_trusted").alias("n_trusted"))


def ratios(data: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight of the n-grams of each text, 0 for a text without any."""
    part = gram_buckets(data, len(weights))
    begin, end = (np.minimum(x, len(part)) for x in gram_ranges(bounds))
    sums = np.concatenate([[0.0], np.cumsum(weights[part])])
    return np.where(end > begin, (sums[end] - sums[begin]) / np.maximum(end - begin, 1), 0.0)


def ratio_model(counts: DataFrame, buckets: int = 1 << 16) -> np.ndarray:
    """log p_trusted - log p_raw for each bucket; at most ``buckets`` rows reach the driver.  The raw multinomial has add-one
    smoothing, the trusted one a prior of ``buckets`` n-grams of the raw one, so that few trusted texts decide little."""
    table = counts.select("bucket", "n_raw", "n_trusted").toArrow().to_pandas()
    raw, good = np.zeros(buckets), np.zeros(buckets)
    raw[table["bucket"]], good[table["bucket"]] = table["n_raw"], table["n_trusted"]
    if not good.sum():
        return np.zeros(buckets)
    share = (raw + 1) / (raw.sum() + buckets)
    return np.log((good + buckets * share) / (good.sum() + buckets)) - np.log(share)


def repeated_words(found: Words, width: int) -> np.ndarray:
    """For each text the number of words inside a ``width``-word window that occurs twice or more in that text."""
    n = len(found.hashes)
    keys = window_hash(found.hashes, width)
    if not len(keys):
        return np.zeros(len(found.first) - 1, np.int64)
    owner = found.owner
    inside = owner[: len(keys)] == owner[width - 1 :]
    at = np.flatnonzero(inside)
    # one key for text and window: equal only for equal windows of one text
    keyed = keys[at] ^ (owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keyed, kind="stable")
    ordered = keyed[order]
    twin = np.zeros(len(ordered), bool)
    same = ordered[1:] == ordered[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    hit = at[order[twin]]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return per_text_sum((np.cumsum(edge)[:-1] > 0).astype(np.int64), found.first)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def score(docs: DataFrame, model: np.ndarray, text: str = "text", rules: Rules = Rules(), keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``row`` (a struct of the columns ``keep``, all by default), statistics, ratio and verdict."""
    weights = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(text).alias("text"))
    kinds = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "ratio": pa.float64(), "base_failed": pa.bool_(), "kept": pa.bool_()}
    schema = T.StructType([source.schema["row"]] + [T.StructField(k, from_arrow_type(v)) for k, v in kinds.items()])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True
        for batch in batches:
            for at, to, found in sliced_words(batch.column(1), SPACED, SAME):
                data, bounds = found.data, found.bounds
                n_words = found.counts.astype(np.int64)
                lead = ((data & 0xC0) != 0x80) & SPACED[data]
                repeat = repeated_words(found, rules.repeat_window)
                raw = data.tobytes()
                failed = (n_words < rules.min_words) | (100 * repeat > rules.max_repeat_percent * n_words)
                ratio = ratios(data, bounds, weights.value)
                columns = [
                    n_words,
                    per_text_sum(lead, bounds),
                    per_text_sum(symbol[data], bounds),
                    np.array([duplicate_lines(raw[bounds[d] : bounds[d + 1]]) for d in range(to - at)], np.int64),
                    repeat,
                    ratio,
                    failed,
                    ~failed & (ratio >= rules.min_ratio),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *(pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True))], names=["row", *kinds])

    return source.mapInArrow(judge, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> np.ndarray:
    """The ratio model of ``docs``, trusting the rows that ``labels`` gives quality 1."""
    return ratio_model(gram_counts(docs, trusted_keys(labels, id_col, rules.max_trusted), id_col, text, rules.buckets), rules.buckets)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Fit on ``docs`` and judge every row of it: the id, the statistics, the ratio and the verdict."""
    return score(docs, fit(docs, labels, id_col, text, rules), text, rules, [id_col]).select(f"row.`{id_col}`", *STATISTICS)


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns."""
    return score(docs, fit(docs, labels, id_col, text, rules), text, rules).where("kept").select("row.*")
