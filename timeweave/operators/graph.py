"""Similar-event edges, expansion over them, and relation facts as tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.functions.text import content_key, fact_text
from timeweave.functions.vectors import MISSING_SCORE, SCORE_DIGITS, cosine
from timeweave.operators.rank import ROWS_PER_WHOLE_TILE, last_write_wins, tiled_pair_scores, tiled_rows, tiled_top_k, unit_matrix
from timeweave.operators.skew import slice_build_side, slice_counts, slice_probe_side, top_k
from timeweave.session import cut_lineage

KEY = ["user_id", "qa_idx"]
LINK_SCORE, LINK_LIMIT = 0.8, 20
EXPAND_SCORE = 0.7
#: Seeds of the questions that walk in one task; edges in one row of a hub's list; rows of a record batch that comes out.  Every batch
#: gets the lists of most events of its user, so batches are large.
SEEDS_PER_BATCH = 49_152
EDGES_PER_LIST = 8_192
#: Facts of a user that one task holds (about 250 bytes of vector each, twice that as it scores), and questions that meet them there.
FACTS_PER_USER = 524_288
QUESTIONS_PER_FACTS = 2_048
ROWS_PER_BATCH = 65_536

# Relation vocabulary.
PREDICATES = [
    "live_in", "located_in", "from", "born_in", "work_at", "study_at", "member_of", "has_role", "parent_of", "spouse_of",
    "sibling_of", "friend_of", "reports_to", "owns", "uses", "likes", "dislikes", "interested_in", "created_by", "part_of",
]
RELATION_KEY = ["relation_id", "source", "relationship", "destination", "event_id", "block_key", "block_id"]
SHORT_RELATION_KEY = ["relation_id", "source", "relationship", "destination"]


def link_similar(events: DataFrame, threshold: float = LINK_SCORE, limit: int = LINK_LIMIT) -> DataFrame:
    """Each event to its best earlier events of the same user.

    ``events(user_id, event_id, seq, embedding)``; exact, in bounded tiles.
    """
    left = events.select("user_id", F.col("event_id").alias("qa_idx"), "seq", "embedding")
    right = events.select("user_id", F.col("event_id").alias("block_id"), "seq", "embedding")
    best = tiled_top_k(left, right, limit, min_score=threshold, earlier_only=True)
    return best.select("user_id", F.col("qa_idx").alias("a_id"), F.col("block_id").alias("b_id"), "score")


def upsert_nodes(events: DataFrame, load_order: str) -> DataFrame:
    return last_write_wins(events, ["user_id", "event_id"], load_order)


def graph_tables(blocks: DataFrame, vectors: DataFrame, load_order: str, similarity: bool = True, threshold: float = LINK_SCORE,
                 limit: int = LINK_LIMIT) -> tuple[DataFrame, DataFrame | None]:
    """Blocks -> (event nodes, similar edges); rows without a user are skipped."""
    rows = blocks.filter(F.col("user_id").isNotNull() & (F.col("user_id") != ""))
    exploded = rows.select("user_id", "block_id", F.col(load_order).alias("seq"), F.posexplode("events").alias("event_no", "e")).select(
        "user_id", "block_id", "event_no", F.struct("seq", "event_no").alias("_load"), "seq", "e.*"
    )
    nodes = upsert_nodes(exploded, "_load").drop("_load")
    if not similarity:
        return nodes, None
    # an array position fits 31 bits, so the order is that of (seq, event_no) for any block of fewer than 2^32 in sequence
    order = F.shiftleft(F.col("seq").cast("bigint"), 31) + F.col("event_no")
    described = nodes.filter(F.trim(F.coalesce("description", F.lit(""))) != "").select("user_id", "event_id", order.alias("seq"))
    return nodes, link_similar(described.join(vectors.select("user_id", "event_id", "embedding"), ["user_id", "event_id"]), threshold, limit)


def seed_events(ranked: DataFrame, block_events: DataFrame) -> DataFrame:
    """Distinct events of the ranked blocks per question."""
    return ranked.select(*KEY, "block_id").join(block_events.select("user_id", "block_id", "event_id"), ["user_id", "block_id"]).select(*KEY, "event_id").distinct()


def best_edges(edges: DataFrame, min_score: float = EXPAND_SCORE) -> DataFrame:
    """Best score per unordered pair, lower id first."""
    pairs = edges.filter(F.col("score") >= min_score).select(
        "user_id", F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), "score"
    )
    return pairs.groupBy("user_id", "a_id", "b_id").agg(F.max("score").alias("score"))


def one_hop_edges(seeds: DataFrame, edges: DataFrame, min_score: float = EXPAND_SCORE, limit: int | None = None) -> DataFrame:
    """Edges that touch a seed, ranked per question (score desc, ids); the best ``limit`` if one is given."""
    best = best_edges(edges, min_score)
    touch = lambda side: seeds.join(best, (seeds.user_id == best.user_id) & (seeds.event_id == best[side])).select(
        seeds.user_id, "qa_idx", "a_id", "b_id", "score"
    )
    both = touch("a_id").union(touch("b_id")).distinct()
    return _ordered(both, KEY, [F.desc("score"), F.asc("a_id"), F.asc("b_id")], limit)


class _Batch:
    """Seeds and edge lists of one batch of questions of a user, events numbered in the order of their ids."""

    def __init__(self, seeds: pa.Table, edges: pa.Table):
        self.user = seeds["user_id"][0]
        to, self.score = edges["_to"].combine_chunks().flatten(), edges["_s"].combine_chunks().flatten().to_numpy()
        ids = pc.unique(pa.chunked_array([to, *edges["event_id"].chunks, *seeds["event_id"].chunks]))
        self.ids = ids.take(pc.sort_indices(ids))
        number = lambda values: pc.index_in(values, value_set=self.ids).to_numpy()
        to = number(to)
        origin = np.repeat(number(edges["event_id"]), pc.list_value_length(edges["_to"]).to_numpy())
        order = np.argsort(origin, kind="stable")
        self.to, self.score = to[order], self.score[order]
        self.first = np.searchsorted(origin[order], np.arange(len(self.ids) + 1))
        self._at, asks = number(seeds["event_id"]), seeds["qa_idx"].combine_chunks().dictionary_encode()
        ask, self.names = asks.indices.to_numpy(), asks.dictionary
        self._by_ask = np.argsort(ask, kind="stable")
        self._ends = np.searchsorted(ask[self._by_ask], np.arange(len(self.names) + 1))

    def walk(self, q: int, hops: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(events reached from the seeds of question ``q``, fewest hops and best weakest edge of every event)."""
        own = np.unique(self._at[self._by_ask[self._ends[q] : self._ends[q + 1]]])
        found, path = _walk(own, self.to, self.score, self.first, hops)
        return np.flatnonzero(found), found, path


def _read(batches: Iterator[pa.RecordBatch], kinds: dict[int, list[str]]) -> list[pa.Table]:
    """The rows of each kind (``_what``) with its columns."""
    read: dict[int, list[pa.Table]] = {k: [] for k in kinds}
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        for k, names in kinds.items():
            read[k].append(rows.filter(pc.equal(rows["_what"], k)).select(names))
    return [pa.concat_tables(read.pop(k)).combine_chunks() for k in kinds]


ASKED, LISTS, EVENTS, QUESTIONS = range(4)
_GRAPH = {ASKED: ["user_id", "qa_idx", "event_id"], LISTS: ["event_id", "_to", "_s"]}


def _walks(hops: int, limit: int | None, columns: Sequence[str]):
    """Walk from the seeds of one batch of questions over the edge lists of its events; rows of a question come out together."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, edges = _read(batches, _GRAPH)
        if not len(seeds) or not len(edges):
            return
        b = _Batch(seeds, edges)
        del seeds, edges
        out, held = [], 0
        for q in range(len(b.names)):
            event, found, path = b.walk(q, hops)
            event = event[np.lexsort((event, -path[event], found[event]))][:limit]
            out.append((np.full(len(event), q), event, found[event], path[event]))
            held += len(event)
            if held >= ROWS_PER_BATCH or q == len(b.names) - 1:
                n, e, h, s = (np.concatenate(c) for c in zip(*out, strict=True))
                rank = np.concatenate([np.arange(1, len(o[0]) + 1, dtype=np.int32) for o in out])
                named = {"user_id": pa.repeat(b.user, len(n)), "qa_idx": b.names.take(pa.array(n)), "event_id": b.ids.take(pa.array(e))}
                named |= {"min_hop": pa.array(h), "similarity_score": pa.array(s), "rank": pa.array(rank)}
                yield pa.RecordBatch.from_pydict({c: named[c] for c in columns})
                out, held = [], 0

    return walk


def _scored_walks(hops: int, min_score: float | None, columns: Sequence[str]):
    """As :func:`_walks`; reached events meet the vectors where they are found, and a question comes out as one row."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _GRAPH | {EVENTS: ["event_id", "_vec", *columns], QUESTIONS: ["qa_idx", "_vec"]}
        seeds, edges, events, asked = _read(batches, kinds)
        if not len(seeds) or not len(edges) or not len(events) or not len(asked):
            return
        b = _Batch(seeds, edges)
        del seeds, edges
        row = pc.fill_null(pc.index_in(b.ids, value_set=events["event_id"].combine_chunks()), -1).to_numpy()
        of = pc.fill_null(pc.index_in(b.names, value_set=asked["qa_idx"].combine_chunks()), -1).to_numpy()
        (qv, q_missing), (ev, e_missing) = unit_matrix(asked["_vec"]), unit_matrix(events["_vec"])
        if q_missing.all() or e_missing.all():
            qv, ev = np.zeros((len(qv), 1)), np.zeros((len(ev), 1))
        shown = {c: events[c].combine_chunks() for c in columns}
        del events, asked
        out, held = [], 0
        for q in range(len(b.names)):
            event, found, path = b.walk(q, hops)
            event = event[row[event] >= 0] if of[q] >= 0 else event[:0]
            own = row[event]
            score = np.where(q_missing[of[q]] | e_missing[own], MISSING_SCORE, np.round(ev[own] @ qv[of[q]], SCORE_DIGITS))
            place = np.lexsort((event, -score))
            place = place if min_score is None else place[score[place] >= min_score]
            if len(place):
                event, score = event[place], score[place]
                out.append((np.full(1, q), np.full(1, len(event)), event, found[event], path[event], score, np.arange(1, len(event) + 1, dtype=np.int32)))
                held += len(event)
            if out and (held >= ROWS_PER_BATCH or q == len(b.names) - 1):
                n, size, e, h, s, score, rank = (np.concatenate(c) for c in zip(*out, strict=True))
                named = {"event_id": b.ids.take(pa.array(e)), "min_hop": pa.array(h), "graph_similarity_score": pa.array(s), "query_similarity": pa.array(score), "rank": pa.array(rank)}
                named |= {c: shown[c].take(pa.array(row[e])) for c in columns}
                rows = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.StructArray.from_arrays(list(named.values()), list(named)))
                yield pa.RecordBatch.from_pydict({"user_id": pa.repeat(b.user, len(n)), "qa_idx": b.names.take(pa.array(n)), "events": rows})
                out, held = [], 0

    return walk


def _walk(seeds: np.ndarray, to: np.ndarray, score: np.ndarray, first: np.ndarray, hops: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewest hops to each event (0: not reached, or a seed) and best weakest edge of all walks of up to ``hops`` from ``seeds``."""
    found, path = np.zeros(len(first) - 1, np.int32), np.full(len(first) - 1, -np.inf)
    front, weakest = seeds, np.full(len(seeds), np.inf)
    for hop in range(1, hops + 1):
        n = first[front + 1] - first[front]
        edge = np.arange(n.sum()) + np.repeat(first[front] - (np.cumsum(n) - n), n)
        best = np.full(len(path), -np.inf)
        np.maximum.at(best, to[edge], np.fmin(np.repeat(weakest, n), score[edge]))
        hit = np.zeros(len(path), bool)
        hit[to[edge]] = True
        found[hit & (found == 0)] = hop
        path = np.maximum(path, best)
        front = np.flatnonzero(hit)
        weakest = best[front]
    found[seeds] = 0
    return found, path


def reachable(seeds: DataFrame, edges: DataFrame, hops: int = 1, min_score: float = EXPAND_SCORE, limit: int | None = None, ranked: bool = True,
              seeds_per_batch: int = SEEDS_PER_BATCH) -> DataFrame:
    """Non-seed events within ``hops``: fewest hops and best weakest-edge score, with ``rank`` if ``ranked`` (hops, score desc, id).

    Questions of a user go in batches.  A batch gets the edge lists of all events it can step from, each once, and walks inside its
    task, so neither the walks nor the reached events are shuffled.  Lists of hubs come in parts; beyond three steps the lineage is cut.
    """
    rows, _ = _batches(seeds, edges, hops, min_score, seeds_per_batch)
    columns = [*KEY, "event_id", "min_hop", "similarity_score", *(["rank"] if ranked else [])]
    kinds = {c: seeds.schema[c].dataType.simpleString() for c in KEY} | {
        "event_id": rows.schema["event_id"].dataType.simpleString(), "min_hop": "int", "similarity_score": "double", "rank": "int"
    }
    return rows.groupBy("user_id", "_batch").applyInArrow(_walks(hops, limit, columns), ", ".join(f"{c} {kinds[c]}" for c in columns))


def _batches(seeds: DataFrame, edges: DataFrame, hops: int, min_score: float, seeds_per_batch: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the batches of questions, seeds and the edge lists they step from, and how many batches large users have."""
    best = best_edges(edges, min_score)
    both_ways = best.select("user_id", F.col("a_id").alias("event_id"), F.col("b_id").alias("_to"), F.col("score").cast("double").alias("_s")).union(
        best.select("user_id", "b_id", "a_id", F.col("score").cast("double"))
    )
    hubs = F.broadcast(slice_counts(both_ways, ["user_id", "event_id"], EDGES_PER_LIST))
    parts = slice_build_side(both_ways, hubs, ["user_id", "event_id"], ["_to"], "_part")
    lists = parts.groupBy("user_id", "event_id", "_part").agg(F.collect_list(F.struct("_to", "_s")).alias("_l")).select(
        "user_id", "event_id", F.col("_l._to").alias("_to"), F.col("_l._s").alias("_s")
    )
    kind = both_ways.schema["event_id"].dataType
    known = seeds.select(*KEY, F.col("event_id").cast(kind).alias("event_id")).dropna()
    busy = F.broadcast(slice_counts(known, ["user_id"], seeds_per_batch, "n_batches"))
    asked = slice_build_side(known, busy, ["user_id"], ["qa_idx"], "_batch", "n_batches")
    # events that a batch steps from: its seeds, then what it reached in all steps but the last
    near = asked.select("user_id", "_batch", "event_id").distinct()
    front = near
    for hop in range(1, hops):
        front = front.join(lists, ["user_id", "event_id"]).select("user_id", "_batch", F.explode("_to").alias("event_id")).distinct()
        if hop > 2:
            front = cut_lineage(front)
        near = near.union(front)
    near = near if hops == 1 else near.distinct()
    steps = near.join(lists, ["user_id", "event_id"]).select("user_id", "_batch", "event_id", "_to", "_s")
    return asked.withColumn("_what", F.lit(ASKED)).unionByName(steps.withColumn("_what", F.lit(LISTS)), allowMissingColumns=True), busy


def scored_expansion(seeds: DataFrame, edges: DataFrame, questions: DataFrame, events: DataFrame, hops: int = 1, min_score: float = EXPAND_SCORE,
                     min_similarity: float | None = None, seeds_per_batch: int = SEEDS_PER_BATCH) -> DataFrame:
    """:func:`reachable`, :func:`score_events` and :func:`attach_events` in one: (user_id, qa_idx, events), one row a question.

    ``questions(user_id, qa_idx, embedding)``, ``events(user_id, event_id, embedding, ...)``, one row an id.  ``events`` of the result
    holds the reached events with ``min_hop``, ``graph_similarity_score``, ``query_similarity``, ``rank`` (similarity desc, id) and the
    other columns of ``events``, those of at least ``min_similarity`` if given; questions without any are absent, and so are events and
    questions without a row.  Vectors come to the batches that walk, so reached events are neither shuffled nor joined.
    """
    rows, busy = _batches(seeds, edges, hops, min_score, seeds_per_batch)
    shown = [c for c in events.columns if c not in ("user_id", "event_id", "embedding")]
    same = questions.schema["embedding"].dataType == events.schema["embedding"].dataType
    vec = (F.col("embedding") if same else F.col("embedding").cast("array<double>")).alias("_vec")
    kind = lambda c: rows.schema[c].dataType
    own = events.select("user_id", F.col("event_id").cast(kind("event_id")).alias("event_id"), vec, *shown)
    own = slice_probe_side(own, busy, ["user_id"], "_batch", "n_batches")
    asked = slice_build_side(questions.select("user_id", F.col("qa_idx").cast(kind("qa_idx")).alias("qa_idx"), vec), busy, ["user_id"], ["qa_idx"], "_batch", "n_batches")
    for more, what in ((own, EVENTS), (asked, QUESTIONS)):
        rows = rows.unionByName(more.withColumn("_what", F.lit(what)), allowMissingColumns=True)
    parts = {"event_id": kind("event_id").simpleString(), "min_hop": "int", "graph_similarity_score": "double", "query_similarity": "double", "rank": "int"}
    parts |= {c: events.schema[c].dataType.simpleString() for c in shown}
    out = f"user_id {kind('user_id').simpleString()}, qa_idx {kind('qa_idx').simpleString()}, events array<struct<{', '.join(f'`{c}`: {t}' for c, t in parts.items())}>>"
    return rows.groupBy("user_id", "_batch").applyInArrow(_scored_walks(hops, min_similarity, shown), out)


def context_counts(expansion: DataFrame, min_score: float = 0.8) -> DataFrame:
    """Kept and total counts per question, as :func:`context_events`, of a :func:`scored_expansion`."""
    return expansion.select(*KEY, F.size("events").cast("bigint").alias("total"), F.size(F.filter("events", lambda e: e["query_similarity"] >= min_score)).cast("bigint").alias("kept"))


def attach_events(expanded: DataFrame, nodes: DataFrame) -> DataFrame:
    return expanded.join(nodes, ["user_id", "event_id"])


def score_events(expanded: DataFrame, questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of question and event text vectors as ``query_similarity``; vectors meet the pairs in tiles, so score before
    attaching texts."""
    return tiled_pair_scores(expanded, questions, vectors, "event_id", "query_similarity")


# ---- relations -----------------------------------------------------------------------------------


def relations_of_events(events: DataFrame, relations: DataFrame, limit: int | None = None) -> DataFrame:
    """Relations of the given (question, event) rows; the first ``limit`` a question if one is given."""
    hit = events.select(*KEY, "event_id").distinct().join(relations, ["user_id", "event_id"])
    return hit if limit is None else top_k(hit, KEY, [F.asc("relation_id"), F.asc("event_id")], limit).drop("rank")


def relations_of_blocks(ranked: DataFrame, relations: DataFrame, limit: int | None = None) -> DataFrame:
    blocks = ranked.select(*KEY, F.col("block_id").cast("string").alias("block_id")).distinct()
    hit = blocks.join(relations, ["user_id", "block_id"])
    return hit if limit is None else top_k(hit, KEY, [F.asc("relation_id"), F.asc("block_id")], limit).drop("rank")


def distinct_relations(relations: DataFrame, scope: Sequence[str] = ("user_id",), key: Sequence[str] = tuple(RELATION_KEY)) -> DataFrame:
    """One row per relation key (missing parts count as empty text)."""
    filled = relations.select("*", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in key])
    return filled.dropDuplicates([*scope, *[f"_{c}" for c in key]]).drop(*[f"_{c}" for c in key])


def person_names(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relation endpoints whose entity type is person."""
    persons = entities.filter(F.lower(F.trim("entity_type")) == "person").select("user_id", F.col("name").alias("person"))
    ends = relations.select("user_id", F.explode(F.array(F.trim("source"), F.trim("destination"))).alias("person")).filter("person <> ''")
    return ends.distinct().join(persons, ["user_id", "person"], "left_semi")


def relations_of_persons(persons: DataFrame, relations: DataFrame) -> DataFrame:
    """(person, relation) for either endpoint; self-loops count once."""
    names = persons.select("user_id", "person")
    as_source = relations.join(names, (relations.user_id == names.user_id) & (F.trim(relations.source) == names.person)).drop(names.user_id)
    as_target = relations.join(
        names, (relations.user_id == names.user_id) & (F.trim(relations.destination) == names.person) & (F.trim(relations.destination) != F.trim(relations.source))
    ).drop(names.user_id)
    return as_source.unionByName(as_target)


def _fact_items(relations: DataFrame, vectors: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Full facts with their vectors; ``columns`` are those kept besides the user, all if not given."""
    facts = relations.withColumn("fact_text", fact_text(F.col("source"), F.col("relationship"), F.col("destination"))).filter("fact_text <> ''")
    kept = [c for c in facts.columns if c != "user_id"] if columns is None else list(columns)
    keyed = facts.select("user_id", *kept, content_key(F.col("fact_text")).alias("_key"))
    v = vectors.select("user_id", F.col("text_key").alias("_key"), "embedding")
    return keyed.join(v, ["user_id", "_key"], "left").drop("_key")


def score_facts(relations: DataFrame, questions: DataFrame, vectors: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Relation facts of each question's user with cosine to the question.

    ``vectors(user_id, text_key, embedding)`` is keyed by the content key of the
    fact text; relations without a full fact are dropped, a missing vector scores -1.
    ``columns`` of the relations come out, all if not given.  Facts of a user meet the questions in tiles; relations that
    already name a question (``qa_idx``) are joined to it.
    """
    items = _fact_items(relations, vectors, columns)
    if "qa_idx" not in relations.columns:
        return tiled_rows(questions, items, items.columns[1], min_score=None, name="query_similarity")
    q = questions.select(*KEY, F.col("embedding").alias("_q"))
    return items.join(q, KEY).withColumn("query_similarity", cosine(F.col("_q"), F.col("embedding"))).drop("_q", "embedding")


def best_facts(relations: DataFrame, questions: DataFrame, vectors: DataFrame, k: int | None, min_score: float | None = 0.5,
               columns: Sequence[str] | None = None, facts_per_person: int = ROWS_PER_WHOLE_TILE) -> DataFrame:
    """The ``k`` facts of each person (all if None) that are most similar to a question of the same user, with ``query_similarity``
    and ``rank``.

    Arguments as in :func:`score_facts`.  All facts of a person meet a question in one tile, which ranks them, so no pair is shuffled;
    persons of more than ``facts_per_person`` facts are tiled by fact and ranked after it.  ``relations`` hold one row per
    (user_id, person, relation_id).
    """
    wanted = None if columns is None else ["person", "relation_id", *[c for c in columns if c not in ("person", "relation_id")]]
    items = _fact_items(relations, vectors, wanted)
    many = items.groupBy("user_id", "person").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > facts_per_person).select("user_id", "person")
    few, rest = items.join(many, ["user_id", "person"], "left_anti"), items.join(many, ["user_id", "person"], "left_semi")
    whole = tiled_rows(questions, few, "relation_id", "person", k, min_score, "query_similarity")
    apart = tiled_rows(questions, rest, "relation_id", min_score=min_score, name="query_similarity")
    return whole.unionByName(_ordered(apart, [*KEY, "person"], [F.desc("query_similarity"), F.asc("relation_id")], k))


def best_fact_lists(relations: DataFrame, questions: DataFrame, vectors: DataFrame, k: int | None, min_score: float | None = 0.5,
                    columns: Sequence[str] | None = None, facts_per_user: int = FACTS_PER_USER) -> DataFrame:
    """:func:`best_facts` as one row a question of ``questions``: (user_id, qa_idx, facts), an array of any order, null or empty without any.

    All facts of a user meet a batch of questions in one task, so neither facts nor texts made of them are shuffled.  Users of more than
    ``facts_per_user`` facts take :func:`best_facts`, and their rows are collected by question.
    """
    wanted = None if columns is None else ["person", "relation_id", *[c for c in columns if c not in ("person", "relation_id")]]
    items = _fact_items(relations, vectors, wanted)
    large = F.broadcast(slice_counts(items, ["user_id"], facts_per_user))
    few = items.join(large, "user_id", "left_anti")
    whole = tiled_rows(questions, few, "relation_id", "person", k, min_score, "query_similarity", facts_per_user, QUESTIONS_PER_FACTS, lists=True)
    apart = best_facts(relations.join(large, "user_id", "left_semi"), questions, vectors, k, min_score, columns)
    parts = whole.schema["rows"].dataType.elementType.names
    collected = apart.groupBy(*KEY).agg(F.collect_list(F.struct(*parts)).alias("facts"))
    others = questions.select(*KEY).join(F.broadcast(few.select("user_id").distinct()), "user_id", "left_anti")
    return whole.withColumnRenamed("rows", "facts").unionByName(others.join(collected, KEY, "left"))


def _ordered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None) -> DataFrame:
    """Rank, cut at ``k`` only where the caller asks for it (inputs are limited upstream)."""
    if k is not None:
        return top_k(rows, keys, order, k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def person_profiles(scored: DataFrame, min_score: float | None = 0.5, k: int | None = None) -> DataFrame:
    """Facts per (question, person): threshold, best ``k``, ordered by score."""
    rows = scored if min_score is None else scored.filter(F.col("query_similarity") >= min_score)
    order = [F.desc("query_similarity"), F.asc("relation_id")]
    return _ordered(rows, [*KEY, "person"], order, k)


def context_events(expanded: DataFrame, min_score: float = 0.8, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Expanded events worth showing, and kept/total counts per question.

    The score is the similarity to the question, else the graph score.
    """
    score = F.coalesce("query_similarity", "graph_similarity_score")
    rows = expanded.withColumn("_score", score)
    kept = _ordered(rows.filter(F.col("_score") >= min_score), KEY, [F.desc("_score"), F.asc("event_id")], k)
    n_kept = kept.groupBy(*KEY).agg(F.count(F.lit(1)).alias("kept"))
    stats = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total")).join(n_kept, KEY, "left").fillna(0, ["kept"])
    return kept.drop("_score"), stats


def block_payload(ranked: DataFrame, block_events: DataFrame, edges: DataFrame, relations: DataFrame) -> DataFrame:
    """Counts and ids per ranked block: its events, similar edges from them and
    relations (inputs of the per-block text)."""
    b = ranked.select(*KEY, "block_id")
    ev = b.join(block_events, ["user_id", "block_id"])
    per_ev = ev.groupBy(*KEY, "block_id").agg(F.sort_array(F.collect_set("event_id")).alias("events"))
    out_edges = ev.join(edges, (ev.user_id == edges.user_id) & (ev.event_id == edges.a_id)).groupBy(ev.user_id, "qa_idx", "block_id").agg(
        F.sort_array(F.collect_set(F.struct("a_id", "b_id", "score"))).alias("similar_events")
    )
    rel = b.join(relations.withColumn("block_id", F.col("block_id").cast("bigint")), ["user_id", "block_id"]).groupBy(*KEY, "block_id").agg(
        F.sort_array(F.collect_set(F.struct("source", "relationship", "destination"))).alias("relations")
    )
    on = [*KEY, "block_id"]
    return b.join(per_ev, on, "left").join(out_edges, on, "left").join(rel, on, "left")


def resolve_conflicts(relations: DataFrame) -> DataFrame:
    """Same source and destination: the newest relationship replaces older ones.
    The same relationship with another destination always stays."""
    keys = ["user_id", "source", "destination"]
    others = [c for c in relations.columns if c not in keys]
    order = F.struct(F.coalesce(F.col("event_ts"), F.lit("1900-01-01").cast("timestamp")), F.col("relation_id"))
    return relations.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")


def valid_relations(relations: DataFrame, entities: DataFrame, question_or_plan: Column | None = None) -> DataFrame:
    """Allowed predicate, both endpoints known, not stated as question or plan."""
    names = entities.select("user_id", "name").distinct()
    rows = relations.filter(F.col("relationship").isin(*PREDICATES))
    if question_or_plan is not None:
        rows = rows.filter(~question_or_plan)
    for end in ("source", "destination"):
        rows = rows.join(names.withColumnRenamed("name", end), ["user_id", end], "left_semi")
    return rows
