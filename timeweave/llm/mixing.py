"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Targets: sources in code-point order, null last, take ``weights`` in turn and share ``share`` of all words; a target stops at
``most`` times its source's size and the excess is shared anew by weight.  The fixed point of that sharing is one water level,
``min(most * size, level * weight)``, found with running sums over the sources.

Quotas: a source is dealt by a seeded hash into ``blocks`` blocks in a seeded order.  With a target of k whole sizes and a rest,
every block is drawn k times and the blocks of the rest once more, the last of them in part.  Of that block, whole documents are
drawn in the order of a seeded digest of their ids, the last of them cut after the words that are left, so the words of all draws
are the target rounded down.  The cut is found from sums over leading digits of the digest, so only a 4,096th of one block of each
source is put in order.  Every draw of a block is a token.

Tree: the root holds all tokens.  A node hands its left child a uniform sample without replacement of its tokens, in proportion
to the shards below, so the child's quotas per source are multivariate hypergeometric; leaves are output shards with disjoint
permuted blocks.  Only tokens (sources x blocks x draws, whatever the number of rows) go through the tree; rows find their
block by a join on (source, block) that spreads a hot source over its blocks.  Inside a shard rows are ordered by a seeded hash.

``plan`` counts the words of the very draws that ``mixed`` makes.

Defined results: the size is the number of words, 0 for null; sources of size 0 have target 0; a null source is a source; rows of
one id are drawn alike, each counted, and where the cut falls on them each is cut to the same share of its words; extra columns
are carried along by ``mixed`` and ignored by ``plan``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.llm.store import written

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``broadcast_rows`` is the largest block table that is broadcast; a larger one is joined by shuffling."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    blocks: int = 256
    shards: int = 8
    seed: str = "mix"
    broadcast_rows: int = 100_000


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_name(source: Column) -> Column:
    """The source as text for hashing, with a name of its own for null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def block_of(id_col: str, options: Mix) -> Column:
    name = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n"))
    digest = F.md5(F.concat(F.lit(f"{options.seed}|block|"), name))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % options.blocks


def targets(sizes: DataFrame, options: Mix) -> DataFrame:
    """(source, source_size, target) of a table with one row (source, source_size) per source."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(in_order)
    weight = F.element_at(F.array(*map(F.lit, options.weights)), (number - 1) % len(options.weights) + 1)
    weighed = sizes.withColumn("weight", weight.cast("double")).withColumn("most", (options.most * F.col("source_size")).cast("double"))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    spread = weighed.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    spread = spread.withColumn("left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    spread = spread.withColumn("words", F.lit(options.share) * F.sum("source_size").over(whole))
    level = (F.col("words") - F.col("full")) / F.col("left")
    holds = level <= F.col("most") / F.col("weight")
    # the least source, by level, that stays below its stop sets the water level
    first = F.min(F.when(holds, F.struct((F.col("most") / F.col("weight")).alias("stop"), level.alias("level"))))
    spread = spread.withColumn("water", first.over(whole)["level"])
    target = F.coalesce(F.least(F.col("most"), F.col("water") * F.col("weight")), F.col("most"))
    return spread.select("source", "source_size", target.alias("target"))


def block_quotas(sized: DataFrame, options: Mix) -> DataFrame:
    """(source, block, source_size, target, words, passes, part): ``passes`` whole draws and ``part`` words of one more."""
    blocks = written(sized.groupBy("source", "block").agg(F.sum("size").alias("words")))
    per_source = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), options).withColumnRenamed("source", "its_source")
    order = F.md5(F.concat(F.lit(f"{options.seed}|order|"), source_name(F.col("source")), F.lit("|"), F.col("block").cast("string")))
    before = Window.partitionBy("source").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    joined = blocks.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).join(per_source, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    passes = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("int")
    rest = F.col("target") - F.col("passes") * F.col("source_size") - F.col("before")
    return joined.withColumn("passes", passes).withColumn("part", F.greatest(F.lit(0.0), F.least(rest, F.col("words").cast("double")))).drop("before")


def split(quotas: DataFrame, options: Mix) -> DataFrame:
    """(source, block, shards): the output shard of each draw of each block, by the splitting tree."""
    draws = F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)
    tokens = quotas.where(draws > 0).select("source", "block", F.explode(F.sequence(F.lit(1), draws)).alias("draw"))
    name = F.concat_ws("|", source_name(F.col("source")), F.col("block").cast("string"), F.col("draw").cast("string"))
    tokens = tokens.withColumn("low", F.lit(0)).withColumn("high", F.lit(options.shards))
    level, widest = 0, options.shards
    while widest > 1:
        node = Window.partitionBy("low", "high")
        rank = F.row_number().over(node.orderBy(F.md5(F.concat(F.lit(f"{options.seed}|tree|{level}|"), name))))
        middle = F.floor((F.col("low") + F.col("high") + 1) / 2).cast("int")
        quota = F.floor(F.count(F.lit(1)).over(node) * (middle - F.col("low")) / (F.col("high") - F.col("low")))
        left = rank <= quota
        tokens = tokens.withColumn("middle", middle).withColumn("left", left)
        tokens = tokens.withColumn("low", F.when(F.col("left"), F.col("low")).otherwise(F.col("middle"))).withColumn("high", F.when(F.col("left"), F.col("middle")).otherwise(F.col("high"))).drop("middle", "left")
        level, widest = level + 1, (widest + 1) // 2
    return tokens.groupBy("source", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("draw", "low"))), lambda x: x["low"]).alias("shards"))


def draw_order(id_col: str, options: Mix) -> Column:
    """Digest of an id by which the documents of a partly drawn block are drawn."""
    name = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n"))
    return F.md5(F.concat(F.lit(f"{options.seed}|part|"), name))


#: Leading hexadecimal digits by which the words of a partly drawn block are summed.
DIGITS = 3


def cuts(rows: DataFrame, quotas: DataFrame, options: Mix) -> DataFrame:
    """(source, block, cut, cut_left, cut_words) of the blocks that are drawn in part: documents with a digest below ``cut`` are drawn
    whole, those of the digest ``cut`` have ``cut_words`` words together, of which ``cut_left`` are drawn."""
    partial = quotas.where((F.col("part") > 0) & (F.col("part") < F.col("words"))).select(F.col("source").alias("s"), F.col("block").alias("b"), F.floor("part").alias("left"))
    inside = rows.select("source", "block", "size", "order").join(partial, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    sums = inside.groupBy("s", "b", "left", F.substring("order", 1, DIGITS).alias("digits")).agg(F.sum("size").alias("n"))
    prior = Window.partitionBy("s", "b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(prior.orderBy("digits")), F.lit(0)))
    falls = (F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("n"))
    at = sums.where(falls).select(F.col("s").alias("source_at"), F.col("b").alias("block_at"), "digits", (F.col("left") - F.col("before")).alias("rest"))
    near = inside.join(at, F.col("s").eqNullSafe(F.col("source_at")) & (F.col("b") == F.col("block_at")) & (F.substring("order", 1, DIGITS) == F.col("digits")))
    ids = near.groupBy("s", "b", "rest", "order").agg(F.sum("size").alias("n"))
    ids = ids.withColumn("before", F.coalesce(F.sum("n").over(prior.orderBy("order")), F.lit(0)))
    falls = (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n"))
    return ids.where(falls).select(F.col("s").alias("source"), F.col("b").alias("block"), F.col("order").alias("cut"), (F.col("rest") - F.col("before")).alias("cut_left"), F.col("n").alias("cut_words"))


def planned(docs: DataFrame, id_col: str, text: str, source: str, options: Mix) -> DataFrame:
    """``docs`` as ``doc`` structs with size, source_size, target, passes, shards, and ``extra``, the words of one more draw."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"),
        n_words(text).alias("size"), block_of(id_col, options).alias("block"), draw_order(id_col, options).alias("order"),
    )
    quotas = written(block_quotas(rows.select("source", "block", "size"), options))
    same = lambda s, b: F.col("source").eqNullSafe(F.col(s)) & (F.col("block") == F.col(b))
    shards = split(quotas, options).select(F.col("source").alias("s"), F.col("block").alias("b"), "shards")
    ends = cuts(rows, quotas, options).withColumnsRenamed({"source": "cs", "block": "cb"})
    table = quotas.join(shards, same("s", "b"), "left").drop("s", "b").join(ends, same("cs", "cb"), "left").drop("cs", "cb")
    table = written(table.withColumnsRenamed({"source": "s", "block": "b"}))
    table = F.broadcast(table) if table.count() <= options.broadcast_rows else table
    whole = (F.col("part") >= F.col("words")) | (F.col("order") < F.col("cut"))
    of_cut = F.when(F.col("order") == F.col("cut"), F.expr("size * cut_left DIV cut_words"))
    extra = F.when(F.col("part") > 0, F.when(whole, F.col("size")).otherwise(F.coalesce(of_cut, F.lit(0)))).otherwise(0)
    return rows.join(table, same("s", "b")).drop("s", "b").withColumn("extra", extra.cast("long"))


def plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", options: Mix = Mix()) -> DataFrame:
    """(id, size, source_size, target, taken, shards) per row: words that the mix takes, and the shard of each draw."""
    rows = planned(docs.select(id_col, text, source), id_col, text, source, options)
    taken = F.col("passes") * F.col("size") + F.col("extra")
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), drawn_shards().alias("shards"))


def drawn_shards() -> Column:
    """The shard of each draw of a row: as often as its block is drawn whole, and once more where words of it are left to draw."""
    return F.slice(F.coalesce("shards", F.array().cast("array<int>")), F.lit(1), F.col("passes") + F.when(F.col("extra") > 0, 1).otherwise(0))


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its n-th word, its white space as it is."""
    pieces = F.split(text, r"[\x20\x09-\x0D]", -1)
    places = F.filter(F.transform(pieces, lambda p, i: F.when(F.length(p) > 0, i)), lambda i: i.isNotNull())
    last = F.get(places, (n - 1).cast("int"))
    length = F.aggregate(F.slice(pieces, F.lit(1), last + 1), F.lit(0), lambda total, p: total + F.length(p)) + last
    return F.substring(text, F.lit(1), length)


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", options: Mix = Mix()) -> DataFrame:
    """The mix itself: (``doc``, shard, order) with a row per draw of a document.  Documents are whole but for the last one of a
    source, whose last draw ends after the words that are left.  ``order`` sorts a shard."""
    rows = planned(docs, id_col, text, source, options)
    drawn = rows.select("doc", "id", "size", "passes", "extra", F.posexplode(drawn_shards()).alias("draw", "shard"))
    is_cut = (F.col("draw") == F.col("passes")) & (F.col("extra") < F.col("size"))
    own = F.col("doc").getField(text)
    doc = F.when(is_cut, F.col("doc").withField(f"`{text}`", first_words(own, F.col("extra")))).otherwise(F.col("doc"))
    return drawn.select(doc.alias("doc"), "shard", F.xxhash64(F.lit(options.seed), "shard", "draw", "id").alias("order"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix with the columns of ``docs``, a row per draw."""
    return mixed(docs, **options).select("doc.*")


def write_mix(docs: DataFrame, path: str, **options) -> None:
    """Write the mix, one folder per shard, rows in seeded order within each file."""
    rows = mixed(docs, **options)
    rows.repartition("shard", F.pmod("order", F.lit(16))).sortWithinPartitions("shard", "order").select("doc.*", F.col("shard").alias("__shard")).write.partitionBy("__shard").parquet(path)
