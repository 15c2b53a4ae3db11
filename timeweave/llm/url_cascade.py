"""URL filters: host and path rules, and an exact block list held in a Bloom filter cascade.

The cascade is built over the corpus's complete universe of keys.  Level 0 is a Bloom filter of the listed keys; level 1 holds
the unlisted keys that level 0 wrongly passes, level 2 the listed keys that level 1 wrongly passes, and so on until a level passes
nothing wrongly.  A key's membership is told by the first level that rejects it, so the answer is exact for every key of the
universe and rows need no join: a filter is a bit array that tasks look keys up in.

Size bound: a cascade takes about ``2 * log2(keys / listed) + 5`` bits per listed key.  Where that is over ``max_bytes``, keys
are split by hash into parts with a cascade each, and rows are looked up part by part, so no task holds more than ``max_bytes``.

Defined results: a null URL, or one without ``://``, has an empty host and path; the empty host is a key like any other; a null key
is never listed; repeated rows are judged each by itself; an empty list blocks nothing; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeweave.llm.store import written
from timeweave.llm.texts import mix

#: (verdict, host, path) of the fixed rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def bit_places(first: np.ndarray, second: np.ndarray, size: int, hashes: int, number: int) -> Iterator[np.ndarray]:
    """Bits of keys in level ``number``; levels hash anew, so keys that collide in one part in the next."""
    first = mix(first ^ (np.uint64(number) * np.uint64(0x9E3779B97F4A7C15)))
    for k in range(hashes):
        yield (first + np.uint64(k) * second) % np.uint64(size)


@dataclass(frozen=True)
class Level:
    bits: np.ndarray
    size: int
    hashes: int
    number: int

    def passes(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        found = np.ones(len(first), bool)
        for at in bit_places(first, second, self.size, self.hashes, self.number):
            found &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def member(levels: list[Level], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether keys, given by two hashes, are listed: odd levels reject listed keys, and the last passes its own kind."""
    out = np.full(len(first), len(levels) % 2 == 1)
    open_ = np.ones(len(first), bool)
    for number, level in enumerate(levels):
        rejected = open_ & ~level.passes(first, second)
        out[rejected] = number % 2 == 1
        open_ &= ~rejected
    return out


def key_hashes(key: Column, seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(seed), key), F.xxhash64(F.lit(seed + 1), key)


def as_unsigned(column: pa.Array) -> np.ndarray:
    return np.asarray(column).astype(np.int64).view(np.uint64)


def build_level(keys: DataFrame, n: int, share: float, number: int) -> Level:
    """A Bloom filter of ``n`` keys (first, second) that passes other keys with probability ``share``; tasks OR their bits, and the
    driver gets at most one row of 64 bits for each word of the filter."""
    size = max(64, math.ceil(n * -math.log(share) / math.log(2) ** 2))
    hashes = max(1, round(-math.log2(share)))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = as_unsigned(batch.column(0)), as_unsigned(batch.column(1))
            at = np.unique(np.concatenate([*bit_places(first, second, size, hashes, number)]))
            word, begin = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), begin) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])

    rows = keys.select("first", "second").mapInArrow(words, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow().to_pandas()
    bits = np.zeros(size // 64 + 1, np.uint64)
    bits[rows["word"].to_numpy()] = rows["value"].to_numpy(np.int64).view(np.uint64)
    return Level(bits.view(np.uint8), size, hashes, number)


def build_cascade(keys: DataFrame, n_listed: int, n_keys: int) -> list[Level]:
    """Levels over a stored universe (first, second, listed)."""
    levels: list[Level] = []
    share, n, left = min(0.5, max(n_listed, 1) * math.sqrt(0.5) / max(n_keys - n_listed, 1)), n_listed, keys
    while n:
        parity = len(levels) % 2 == 0
        levels.append(build_level(left.where(F.col("listed") == parity), n, share, len(levels)))
        query = keys.sparkSession.sparkContext.broadcast(levels[-1])

        def wrongly_passed(batches: Iterator[pa.RecordBatch], query=query, parity=parity) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = np.asarray(batch.column(2)) == parity
                passed = query.value.passes(as_unsigned(batch.column(0)), as_unsigned(batch.column(1)))
                yield batch.filter(pa.array(own | passed))

        left = written(left.mapInArrow(wrongly_passed, "first long, second long, listed boolean"))
        n, share = left.where(F.col("listed") != parity).count(), 0.5
    return levels


def listed_flags(rows: DataFrame, key: str, listed: DataFrame, listed_key: str, seed: int = 10, max_bytes: int = 64 << 20) -> DataFrame:
    """``rows`` with a column ``listed``: whether its key is one of ``listed``, exact for all keys of ``rows``.

    Two different keys of the universe that agree in both 64-bit hashes could not be told apart; the build refuses them."""
    first, second = key_hashes(F.col(key), seed)
    universe = rows.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct()
    names = listed.select(F.col(listed_key).alias("name")).where("name IS NOT NULL").distinct()
    marked = universe.join(names, universe["key"] == names["name"], "left").withColumn("listed", F.col("name").isNotNull())
    keys = written(marked.select(*(c.alias(n) for c, n in zip(key_hashes(F.col("key"), seed), ("first", "second"), strict=True)), "listed"))
    n_keys, n_listed = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("listed").cast("long")), F.lit(0))).first()
    if keys.select("first", "second").distinct().count() != n_keys:
        raise ValueError("two keys share both hashes; choose another seed")
    bits = n_listed * (2 * math.log2(max(2, n_keys / max(1, n_listed))) + 5)
    parts = max(1, math.ceil(bits / 8 / max_bytes))
    schema = T.StructType([*rows.schema.fields, T.StructField("listed", T.BooleanType())])
    source = rows.withColumns({"__first": first, "__second": second})
    found = None
    for part in range(parts):
        own = F.pmod(F.col("first").bitwiseXOR(F.col("second")), F.lit(parts)) == part
        mine = F.pmod(F.col("__first").bitwiseXOR(F.col("__second")), F.lit(parts)) == part
        of_part = keys.where(own)
        n, n_own = (n_keys, n_listed) if parts == 1 else of_part.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("listed").cast("long")), F.lit(0))).first()
        query = rows.sparkSession.sparkContext.broadcast(build_cascade(of_part, n_own, n))

        def look_up(batches: Iterator[pa.RecordBatch], query=query) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flags = member(query.value, as_unsigned(batch.column(batch.num_columns - 2)), as_unsigned(batch.column(batch.num_columns - 1)))
                columns = [batch.column(k) for k in range(batch.num_columns - 2)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(flags)], names=[*batch.schema.names[:-2], "listed"])

        hits = source.where(mine if parts > 1 else F.lit(True)).mapInArrow(look_up, schema)
        found = hits if found is None else found.unionByName(hits)
    return found.withColumn("listed", F.col("listed") & F.col(key).isNotNull())


def named_hosts(hosts: DataFrame, host: str, names: Sequence[str]) -> DataFrame:
    """The distinct hosts with one of ``names`` among their labels: a block list of site names spelled out as hosts."""
    return hosts.select(F.col(host).alias("name")).distinct().where(F.arrays_overlap(F.split("name", r"\."), F.array(*map(F.lit, names))))


def judge(pages: DataFrame, listed: Sequence[str], id_col: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, listed) per row: the longest fitting rule's verdict, else block for a listed host."""
    parsed = pages.select(F.col(id_col).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    found = listed_flags(parsed, "host", named_hosts(parsed, "host", listed), "name")
    fit = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(fit["verdict"], F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return found.select(F.col("id").alias(id_col), "host", "path", fit["rule"].alias("rule"), verdict.alias("verdict"), "listed")
