"""Hard-negative mining by bounds along spanning trees of anchors.

Rows are numbered by (label, hash) and cut into blocks of candidates and batches of anchors, so a tile of one block and one batch
has a bounded size whatever the labels.  In a tile, groups of up to ``tree`` anchors are joined by a minimum spanning tree.  The
root scores every candidate; an anchor below knows the scores of its parent exactly or as an interval, and its own lie within
edge length times the candidate's norm of them.  Only candidates whose interval meets the anchor's window are scored again.

Pass one finds the positives of each anchor: the window reaches down to the k-th largest lower bound of its label.  Tiles are
those of blocks and batches with a common label.  Pass two finds the negatives of each (anchor, positive): the window is what
the shares allow of the positive's score, and within it from the k-th best score found so far or known by its lower bound.
Each tile gives the best k of each window, and these are merged over the blocks by shuffling them on the anchor.

Scores are inner products of whole numbers, exact while they fit 64 bits: as doubles where no sum can pass 2^53, else as longs.

Defined results: rows with a null label or vector, or a null or non-finite component, take no part; shorter vectors count as
padded with zeros; repeated rows are rows of their own (the other copy may be a positive); equal scores come by smaller id,
null last; a null id is no anchor; an anchor without positives or without negatives in its windows gives no rows; an empty table
gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.llm.numbering import numbered
from timeweave.llm.store import written


@dataclass(frozen=True)
class Mining:
    """``low`` and ``high`` are the shares, in hundredths of the positive's score, between which a negative lies.  ``block`` rows are the
    candidates of a tile, ``batch`` the rows whose anchors it holds, ``tree`` the anchors of one spanning tree, ``step`` the candidates
    bounded at once."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    block: int = 16_384
    batch: int = 65_536
    tree: int = 1_024
    step: int = 4_096


def whole_components(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component as long; null where the vector is null or a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(~odd, F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v).cast("long")))


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, parent): places in the order they join a minimum spanning tree that starts at place 0, and each one's parent."""
    n = len(vectors)
    parent, order, nearest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.inf)
    inside, at = np.zeros(n, bool), 0
    for k in range(n):
        order[k], inside[at] = at, True
        distance = ((vectors - vectors[at]) ** 2).sum(axis=1)
        closer = ~inside & (distance < nearest)
        nearest[closer], parent[closer] = distance[closer], at
        at = int(np.argmin(np.where(inside, np.inf, nearest)))
    return order, parent


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors of a list column as rows, padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    first = lists.offsets.to_numpy().astype(np.int64)
    size = np.diff(first)
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(first[0], first[-1]) - np.repeat(first[:-1], size)] = lists.values.to_numpy()[first[0] : first[-1]]
    return out


class Tile:
    """Candidates of one block, bounded and scored for anchors along their trees."""

    def __init__(self, anchors: pa.Table, rows: pa.Table) -> None:
        widths = [int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (anchors, rows)]
        self.a, self.x = (matrix(t["v"], max(*widths, 1)) for t in (anchors, rows))
        largest = float(np.abs(self.a).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * max(*widths, 1)
        if largest < 2**53:  # every partial sum is a whole number that a double holds
            self.a, self.x = self.a.astype(np.float64), self.x.astype(np.float64)
        near = np.asarray(self.x, np.float64)
        self.norm = np.sqrt((near * near).sum(axis=1)) * (1 + 1e-9)
        self.slack = 1 + 1e-9 * largest

    def walk(self, members: np.ndarray, rows: np.ndarray, wanted) -> None:
        """Visit ``members`` (places of anchors) along their spanning tree.  ``wanted(anchor, low, high)`` returns the places, among
        ``rows``, to score for the anchor and a function that takes their scores."""
        vectors = np.asarray(self.a[members], np.float64)
        order, parent = spanning_tree(vectors)
        children = np.bincount(parent[order[1:]], minlength=len(members))
        x, norm = self.x[rows], self.norm[rows]
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in order.tolist():
            if k == order[0]:
                low = high = (x @ self.a[members[k]]).astype(np.float64)
            else:
                low, high = bounds[int(parent[k])]
                spread = np.sqrt(((vectors[k] - vectors[parent[k]]) ** 2).sum()) * norm * (1 + 1e-9) + self.slack
                low, high = low - spread, high + spread
                children[parent[k]] -= 1
                if not children[parent[k]]:
                    del bounds[int(parent[k])]  # its last child
            places, take = wanted(int(members[k]), low, high)
            scores = x[places] @ self.a[members[k]]
            low[places] = high[places] = scores
            take(scores.astype(np.int64))
            if children[k]:
                bounds[k] = (low, high)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by smaller id."""
    if len(scores) > k:
        reach = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= reach)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


#: Stands for a null id, which comes last among equal scores.
LAST = np.iinfo(np.int64).max


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().fill_null(LAST).to_numpy()


def positives_of_tile(anchors: pa.Table, rows: pa.Table, options: Mining) -> pa.Table:
    """(anchor, id, score): the best candidates of each anchor's label in one block."""
    tile, k = Tile(anchors, rows), options.positives
    own, number, ids = anchors["number"].to_numpy(), rows["number"].to_numpy(), ids_of(rows["id"])
    labels, of_anchor = rows["label"].to_numpy(), anchors["label"].to_numpy()
    out: list[tuple[np.ndarray, ...]] = []
    for label in np.intersect1d(labels, of_anchor).tolist():
        members, places = np.flatnonzero(of_anchor == label), np.flatnonzero(labels == label)
        for begin in range(0, len(members), options.tree):
            group = members[begin : begin + options.tree]
            found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for at in range(0, len(places), options.step):
                part = places[at : at + options.step]

                def wanted(anchor, low, high, part=part, found=found):
                    others = number[part] != own[anchor]
                    held, held_ids = found.get(anchor, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    sure = np.append(held.astype(np.float64), low[others])
                    reach = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else -np.inf
                    some = np.flatnonzero(others & (high >= reach))

                    def take(scores):
                        all_scores, all_ids = np.append(held, scores), np.append(held_ids, ids[part[some]])
                        top = best(all_scores, all_ids, k)
                        found[anchor] = all_scores[top], all_ids[top]

                    return some, take

                tile.walk(group, part, wanted)
            out += [(np.full(len(s), own[a]), i, s) for a, (s, i) in found.items()]
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table({"anchor": columns[0], "id": pa.array(columns[1], mask=columns[1] == LAST), "score": columns[2]})


def negatives_of_tile(anchors: pa.Table, rows: pa.Table, options: Mining) -> pa.Table:
    """(anchor, place, id, score): the best candidates of other labels in each window of each anchor, in one block."""
    tile, k = Tile(anchors, rows), options.negatives
    own, ids, labels, of_anchor = anchors["number"].to_numpy(), ids_of(rows["id"]), rows["label"].to_numpy(), anchors["label"].to_numpy()
    scores_of = anchors["scores"].combine_chunks()
    first, flat = scores_of.offsets.to_numpy(), [int(s) for s in scores_of.values.to_numpy()]
    # whole scores s with low * p <= 100 s <= high * p
    windows = [[(-(-options.low * p // 100), options.high * p // 100) for p in flat[a:b]] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    out: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, anchors.num_rows, options.tree):
        group = np.arange(begin, min(begin + options.tree, anchors.num_rows))
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for at in range(0, rows.num_rows, options.step):
            part = np.arange(at, min(at + options.step, rows.num_rows))

            def wanted(anchor, low, high, part=part, found=found):
                other = labels[part] != of_anchor[anchor]
                meets = np.zeros(len(part), bool)
                for place, (least, most) in enumerate(windows[anchor]):
                    if least > most:
                        continue
                    held = found.get((anchor, place), (np.zeros(0, np.int64),))[0]
                    sure = np.append(held.astype(np.float64), low[other & (low >= least) & (high <= most)])
                    reach = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else least
                    meets |= other & (high >= reach) & (low <= most)
                some = np.flatnonzero(meets)

                def take(scores):
                    for place, (least, most) in enumerate(windows[anchor]):
                        inside = np.flatnonzero((scores >= least) & (scores <= most))
                        if not len(inside):
                            continue
                        held, held_ids = found.get((anchor, place), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                        all_scores, all_ids = np.append(held, scores[inside]), np.append(held_ids, ids[part[some[inside]]])
                        top = best(all_scores, all_ids, k)
                        found[anchor, place] = all_scores[top], all_ids[top]

                return some, take

            tile.walk(group, part, wanted)
        out += [(np.full(len(s), own[a]), np.full(len(s), p), i, s) for (a, p), (s, i) in found.items()]
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return pa.table({"anchor": columns[0], "place": columns[1], "id": pa.array(columns[2], mask=columns[2] == LAST), "score": columns[3]})


def ranked(found: DataFrame, k: int, *group: str) -> DataFrame:
    """The k best rows of each group with their ``rank``, from 1."""
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tiles(anchors: DataFrame, rows: DataFrame, work, schema: str) -> DataFrame:
    """``work(anchors, rows)`` of every tile; both sides carry their ``tiles`` as (batch, block)."""
    sides = []
    for df in (anchors, rows):
        columns = ["batch", "block", *[c for c in df.columns if c != "tiles"]]
        sides.append(df.withColumn("tile", F.explode("tiles")).select("tile.batch", "tile.block", *columns[2:]).toDF(*columns))  # new names on both sides
    return sides[0].groupBy("batch", "block").cogroup(sides[1].groupBy("batch", "block")).applyInArrow(work, schema)


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector: str = "embedding", label: Column | str = "label", options: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor, a row for which ``is_anchor`` holds."""
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole_components(F.col(vector)).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = numbered(rows.where(F.col("label").isNotNull() & F.col("v").isNotNull()), F.col("label"), F.xxhash64("id", "v"))
    rows = rows.withColumn("block", F.floor(F.col("number") / options.block)).withColumn("batch", F.floor(F.col("number") / options.batch))
    anchors = rows.where("is_anchor")

    # pass one: tiles of blocks and batches that share a label
    shared = rows.select("label", "block").distinct().join(anchors.select("label", "batch").distinct(), "label").select("batch", "block").distinct()
    shared = shared.withColumn("tile", F.struct("batch", "block"))
    of_block = shared.groupBy("block").agg(F.collect_list("tile").alias("tiles"))
    of_batch = shared.groupBy("batch").agg(F.collect_list("tile").alias("tiles"))
    found = tiles(
        anchors.join(of_batch, "batch").select("tiles", "number", "label", "v"), rows.join(of_block, "block").select("tiles", "number", "id", "label", "v"),
        lambda a, x: positives_of_tile(a, x, options), "anchor long, id long, score long",
    )
    positives = written(ranked(found, options.positives, "anchor"))

    # pass two: every block meets every batch
    windows = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p")).select(F.col("anchor").alias("number"), F.transform("p", lambda x: x["score"]).alias("scores"))
    n = rows.agg(F.max("number")).first()[0]
    last = -1 if n is None else n
    every = [F.sequence(F.lit(0), F.lit(max(last, 0) // size)) for size in (options.block, options.batch)]
    found = tiles(
        anchors.join(windows, "number").select(F.transform(every[0], lambda b: F.struct("batch", b.cast("long").alias("block"))).alias("tiles"), "number", "label", "v", "scores"),
        rows.select(F.transform(every[1], lambda b: F.struct(b.cast("long").alias("batch"), "block")).alias("tiles"), "id", "label", "v"),
        lambda a, x: negatives_of_tile(a, x, options), "anchor long, place long, id long, score long",
    )
    chosen = ranked(found, options.negatives, "anchor", "place").select("anchor", F.col("place") + 1, "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).toDF("anchor", "place", "rank", "negative_id", "negative_score")
    named = positives.select("anchor", F.col("rank").cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return chosen.join(named, ["anchor", "place"]).join(anchors.select(F.col("number").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
