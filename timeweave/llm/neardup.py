"""Near-duplicate classes by order MinHash over occurrence-labelled five-word shingles.

A text's shingles are labelled with their occurrence number, so no labelled shingle repeats.  Each of ``sketches`` seeded
hashes samples the ``sample`` least labelled shingles and hashes them *in text order*: two texts agree in a sketch when they
share the sampled shingles and their order, which follows edit similarity rather than set overlap.  With four samples and
sixteen sketches, texts of similarity 0.8 meet in some sketch with probability 0.9998, texts of similarity 0.3 in 12 of 100.

Candidates are verified by banded alignment: a labelled shingle occurs once on either side, so the best alignment is the
longest increasing run of matched positions within the band that the threshold leaves.  With L aligned of n and m shingles,
the similarity is ``L / (n + m - L)``; texts of 0.8 or more are linked, and classes are connected components of links.

Groups of any size: texts of equal word sequences are one node from the start (one row per node after a map-side combine).
In a sketch bucket every node is compared with the bucket's leader first.  Then, in every bucket whose nodes are still in two
classes or more, all pairs of different classes are compared: as pairs in buckets of at most ``small`` nodes, and block by block
in larger ones.  A bucket's blocks are dealt by a seeded hash, those of its largest class apart, which need not meet each
other; a tile of two blocks counts the shared shingles of all its pairs by matrix products and aligns those that can reach the
threshold.  So every pair that agrees in a sketch is compared, or is in one class anyway.  The work of a bucket is its size times
its nodes outside its largest class; its tiles have bounded sizes and spread over all tasks, and a tile returns no more links
than it has nodes.  Only counts reach the driver.

Defined results: a text of fewer than five words is one shingle; a null text, or one without a word, is never a duplicate and
is a class of its own row; repeated rows are in one class; a null id orders after all others; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeweave.llm.components import components
from timeweave.llm.store import written
from timeweave.llm.texts import SAME, SPACED, mix, sliced_words, window_hash

WIDTH = 5
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def occurrence_labelled(keys: np.ndarray) -> np.ndarray:
    """Keys that also tell the how-manieth equal one each is, in text order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    at = np.arange(len(keys))
    number = np.empty(len(keys), np.uint64)
    number[order] = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    return mix(keys ^ (number * _GOLD))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Occurrence-labelled shingle keys of one text's word hashes."""
    return occurrence_labelled(window_hash(hashes, min(WIDTH, len(hashes))))


def order_min_hash(keys: np.ndarray, sketches: int, sample: int) -> np.ndarray:
    """One hash per sketch of the ``sample`` least keys under its seed, taken in text order."""
    seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) * _GOLD)
    out = np.empty(sketches, np.uint64)
    step = max(1, (1 << 20) // len(keys))
    for low in range(0, sketches, step):
        seed = seeds[low : low + step, None]
        drawn = (keys[None, :] ^ seed) * (seed | np.uint64(1))
        drawn ^= drawn >> np.uint64(32)
        drawn *= _GOLD
        if len(keys) > sample:
            at = np.sort(np.argpartition(drawn, sample, axis=1)[:, :sample], axis=1)
            picked = keys[at]
        else:
            picked = np.broadcast_to(keys, (len(seed), len(keys)))
        value = seed[:, 0].copy()
        for column in picked.T:
            value = mix(value ^ column) * np.uint64(0xD6E8FEB86659FD93)
        out[low : low + step] = value
    return out


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Similarity of two labelled shingle sequences by banded alignment; 0 where it can't reach ``least``."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = n + m - 2 * least / (1 + least) * (n + m)  # unaligned shingles that the threshold leaves
    near = np.abs(at_a - at_b) <= band
    at_a, at_b = at_a[near], at_b[near]
    if len(at_a) < least * (n + m - len(at_a)):
        return 0.0
    path = at_b[np.argsort(at_a)]
    if np.all(path[1:] > path[:-1]):
        length = len(path)
    else:
        tails: list[int] = []
        for x in path.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        length = len(tails)
    return length / (n + m - length)


def row_name(id_col: str, text: str) -> Column:
    """What orders the rows of a class: the id, null last, then a hash of the text."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text).alias("key"))


def sketch(docs: DataFrame, id_col: str, text: str, sketches: int, sample: int) -> DataFrame:
    """(row, node, sketches) per row: ``node`` is a digest of the word sequence, null for a text without words."""
    source = docs.select(row_name(id_col, text).alias("row"), F.col(text).alias("text"))
    schema = f"row {source.schema['row'].dataType.simpleString()}, node binary, sketches array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, found in sliced_words(batch.column(1), SPACED, SAME):
                nodes, drawn = [], []
                for d in range(to - at):
                    own = found.hashes[found.first[d] : found.first[d + 1]]
                    nodes.append(node_of(own) if len(own) else None)
                    drawn.append(order_min_hash(shingles(own), sketches, sample).view(np.int64) if len(own) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(nodes, pa.binary()), pa.array(drawn, pa.list_(pa.int64()))], names=["row", "node", "sketches"])

    return source.mapInArrow(run, schema)


def node_of(hashes: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes(), digest_size=16).digest()


def node_words(docs: DataFrame, id_col: str, text: str, wanted: DataFrame) -> DataFrame:
    """(node, words) of the nodes ``wanted`` (id, node): 32-bit word hashes of one text of each."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    ids = wanted.select(F.col("id").alias("wanted_id"), "node")
    source = source.join(ids, source["id"].eqNullSafe(ids["wanted_id"])).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, found in sliced_words(batch.column(1), SPACED, SAME):
                nodes, kept = [], []
                for d in range(to - at):
                    own = found.hashes[found.first[d] : found.first[d + 1]]
                    node = batch.column(0)[at + d].as_py()
                    if len(own) and node_of(own) == node:  # an id may stand for several texts
                        nodes.append(node)
                        kept.append((own >> np.uint64(32)).astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(kept, pa.binary())], names=["node", "words"])

    return source.mapInArrow(run, "node binary, words binary").dropDuplicates(["node"])


def verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts have similarity ``least`` or more."""
    a = texts.select(F.col("node").alias("a"), F.col("words").alias("a_words"))
    b = texts.select(F.col("node").alias("b"), F.col("words").alias("b_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_last, b_last, kept = [None, None], [None, None], []

            def keys(last: list, at: int, column: int) -> np.ndarray:
                name = batch.column(column)[at].as_py()
                if last[0] != name:
                    last[:] = [name, shingles(np.frombuffer(batch.column(column + 2)[at].as_py(), np.uint32).astype(np.uint64))]
                return last[1]

            for at in range(batch.num_rows):
                if aligned_similarity(keys(a_last, at, 0), keys(b_last, at, 1), least) >= least:
                    kept.append(at)
            yield batch.take(pa.array(kept, pa.int64())).select([0, 1])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "a_words", "b_words").mapInArrow(run, "a binary, b binary")


def star_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Each member of a bucket with the bucket's leader, the member of the least hash; ``turn`` picks other leaders."""
    order = F.struct(F.xxhash64("bucket", "node", F.lit(turn)).alias("h"), "node")
    leaders = members.groupBy("bucket").agg(F.min(order)["node"].alias("leader"))
    return ordered_pairs(members.join(leaders, "bucket").select(F.col("node").alias("a"), F.col("leader").alias("b")))


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def mixed(members: DataFrame, classes: DataFrame, least_size: int = 2) -> DataFrame:
    """``members`` (bucket, node, ...) with class and size, of buckets whose nodes are in two classes or more; a node without a link is its own class."""
    labelled = members.join(classes, "node", "left").select(*members.columns, F.coalesce("component", "node").alias("class"))
    spans = labelled.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("size"))
    return labelled.join(spans.where("low <> high").where(F.col("size") >= least_size).select("bucket", "size"), "bucket")


def cross_pairs(members: DataFrame) -> DataFrame:
    """All pairs of different classes in the buckets given, which are small."""
    other = members.select("bucket", F.col("node").alias("b"), F.col("class").alias("b_class"))
    return ordered_pairs(members.join(other, "bucket").where("class <> b_class").select(F.col("node").alias("a"), "b"))


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """How many keys each of ``a`` shares with each of ``b``; no key repeats within one of them."""
    common = np.intersect1d(np.concatenate(a), np.concatenate(b))

    def placed(side: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, owner = np.concatenate(side), np.repeat(np.arange(len(side)), [len(k) for k in side])
        at = np.searchsorted(common, keys)
        hit = common[np.minimum(at, len(common) - 1)] == keys
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], owner[hit][order]

    out = np.zeros((len(a), len(b)), np.int64)
    sides = [placed(a), placed(b)] if len(common) else []
    for low in range(0, len(common), width):
        has = [np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)]
        for matrix, (at, owner) in zip(has, sides, strict=True):
            part = slice(*np.searchsorted(at, [low, low + width]))
            matrix[owner[part], at[part] - low] = 1
        out += (has[0] @ has[1].T).astype(np.int64)
    return out


def tile_links(tile: pa.Table, least: float) -> pa.Table:
    """Links (a, b) that join all classes of a tile (low, high, own, node, class, words) which have a pair of similarity ``least``
    or more between the tile's two blocks."""
    names, own = tile.column("node").to_pylist(), np.asarray(tile.column("own"))
    rows, columns = (np.flatnonzero(own == tile.column(c)[0].as_py()) for c in ("low", "high"))
    links: list[tuple[bytes, bytes]] = []
    if len(rows) and len(columns):
        number: dict[bytes, int] = {}
        kind = np.array([number.setdefault(c, len(number)) for c in tile.column("class").to_pylist()])
        keys = [shingles(np.frombuffer(w, np.uint32).astype(np.uint64)) for w in tile.column("words").to_pylist()]
        sizes = np.array([len(k) for k in keys])
        shared = shared_counts([keys[k] for k in rows], [keys[k] for k in columns])
        # an alignment is no longer than the shingles shared
        may = (shared >= least * (sizes[rows][:, None] + sizes[columns] - shared) - 1e-9) & (kind[rows][:, None] != kind[columns])
        parent = list(range(len(number)))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        for i, j in zip(*(x.tolist() for x in np.nonzero(may)), strict=True):
            a, b = rows[i], columns[j]
            x, y = root(kind[a]), root(kind[b])
            if x != y and aligned_similarity(keys[a], keys[b], least) >= least:
                parent[x] = y
                links.append((min(names[a], names[b]), max(names[a], names[b])))
    return pa.table([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], names=["a", "b"])


def tiled_links(large: DataFrame, texts: DataFrame, least: float, tile: int, tile_bytes: int) -> DataFrame:
    """Links between the classes of each bucket of ``large`` (bucket, node, class), from all pairs of nodes of different classes."""
    members = large.select("bucket", "node", "class").join(texts, "node")
    kinds = members.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("words")).alias("bytes"))
    spans = kinds.groupBy("bucket").agg(F.max(F.struct("n", "class", "bytes")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))

    def blocks(n: Column, size: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(n / tile), F.ceil(size / tile_bytes)).cast("int")

    others = blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes"))
    spans = written(spans.select("bucket", F.col("main.class").alias("main"), others.alias("others"), blocks(F.col("main.n"), F.col("main.bytes")).alias("mains")))
    # blocks of other classes come first and meet all blocks; those of the largest class meet them only
    dealt, is_main = F.xxhash64("bucket", "node"), F.col("class") == F.col("main")
    own = F.when(is_main, F.col("others") + F.pmod(dealt, "mains")).otherwise(F.pmod(dealt, "others")).cast("int")
    meets = F.sequence(F.lit(0), F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)
    tiles = members.join(spans, "bucket").select("bucket", "node", "class", "words", own.alias("own"), F.explode(meets).alias("met"))
    tiles = tiles.select("bucket", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"), "own", "node", "class", "words")
    return tiles.groupBy("bucket", "low", "high").applyInArrow(lambda table: tile_links(table, least), "a binary, b binary")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = 0.8, sketches: int = 16, sample: int = 4, small: int = 16,
    tile: int = 256, tile_bytes: int = 4 << 20,
) -> DataFrame:
    """(row, first, class_rows, class_texts, wordless) per row: its name, the name of the first row of its class, and the
    numbers of rows and of different word sequences in the class.  ``small`` chooses between two exact ways; ``tile`` nodes or
    ``tile_bytes`` of word hashes are about a block."""
    rows = written(sketch(docs, id_col, text, sketches, sample))
    nodes = written(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"), F.first("sketches").alias("sketches")))
    each = nodes.select("node", F.posexplode("sketches")).select("node", "pos", F.xxhash64("pos", "col").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(each.join(shared.select("bucket"), "bucket").select("bucket", "pos", "node"))
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("row.id", "node")
    texts = written(node_words(docs, id_col, text, wanted))

    tried = written(star_pairs(members, 1))
    links = written(verify(tried, texts, similarity))
    classes = components(links)
    rest = written(mixed(members, classes))
    if not rest.isEmpty():
        more = cross_pairs(rest.where(F.col("size") <= small)).join(tried, ["a", "b"], "left_anti")
        within = tiled_links(rest.where(F.col("size") > small), texts, similarity, tile, tile_bytes)
        links = written(links.unionByName(verify(more, texts, similarity)).unionByName(within))
        classes = components(links)
    labelled = nodes.join(classes, "node", "left").select("node", "row", "n", F.coalesce("component", "node").alias("class"))
    totals = labelled.groupBy("class").agg(F.min("row").alias("first"), F.sum("n").alias("class_rows"), F.count(F.lit(1)).alias("class_texts"))
    by_node = labelled.select("node", "class").join(totals, "class").select(F.col("node").alias("its_node"), "first", "class_rows", "class_texts")
    found = rows.join(by_node, rows["node"] == by_node["its_node"], "left")
    return found.select(
        "row",
        F.when(F.col("node").isNull(), F.col("row")).otherwise(F.col("first")).alias("first"),
        F.coalesce("class_rows", F.lit(1)).cast("long").alias("class_rows"),
        F.coalesce("class_texts", F.lit(1)).cast("long").alias("class_texts"),
        F.col("node").isNull().alias("wordless"),
    )


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, class_id, class_rows, class_texts) per row; ``class_id`` is the least id of the class."""
    found = near_duplicates(docs, id_col, text, **options)
    return found.select(F.col("row.id").alias(id_col), F.col("first.id").alias("class_id"), "class_rows", "class_texts")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are the first of their class, with its columns; of repeated rows one stays, and texts without
    words all stay."""
    found = near_duplicates(docs, id_col, text, **options).where("row = first")
    stay = found.groupBy(F.col("row.id").alias("stay_id"), F.col("row.key").alias("stay_key")).agg(F.first("wordless").alias("wordless"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text).alias("key"))
    rows = rows.join(stay, rows["id"].eqNullSafe(stay["stay_id"]) & (rows["key"] == stay["stay_key"]))
    # the keys of the null-safe join, so that the window needs no further exchange
    zero = F.lit("" if isinstance(docs.schema[id_col].dataType, T.StringType) else 0).cast(docs.schema[id_col].dataType)
    turn = F.row_number().over(Window.partitionBy(F.coalesce("id", zero), F.isnull("id"), "key").orderBy(F.lit(0)))
    return rows.withColumn("turn", turn).where("wordless OR turn = 1").select("doc.*")
