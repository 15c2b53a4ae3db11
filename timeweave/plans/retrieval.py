"""End-to-end retrieval: from question text to ranked blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.functions.text import content_key
from timeweave.operators import anchors, pools, rank
from timeweave.plans.annotate import annotate
from timeweave.session import cut_lineage

KEY = ["user_id", "qa_idx"]


def retrieve(questions: DataFrame, blocks: DataFrame, k: int = 5, time_filter: bool = True, rule: str = "empty", axis_mode: str = "auto",
             decay: str | None = None, buffer: bool = False, bypass: tuple[str, ...] = ()) -> DataFrame:
    """Top-``k`` blocks per question -> ``(user_id, qa_idx, block_id, score, rank)``.

    Two passes over the blocks: dates for the pool decision (no vectors are read),
    then vectors in bounded tiles for scoring.  ``time_filter`` off ranks the whole
    pool; ``decay`` weighs scores by distance in time, for ``history`` questions
    (STATIC, PLANNING) or ``dated`` ones; ``buffer`` widens constraints by intent
    first; questions of the categories in ``bypass`` are never filtered.
    """
    q, b = _constrained(questions, blocks, time_filter, rule, axis_mode, decay, buffer, bypass)
    return rank.tiled_top_k(q, b, k, filtered=time_filter, decayed=decay is not None)


def _constrained(questions: DataFrame, blocks: DataFrame, time_filter: bool = True, rule: str = "empty", axis_mode: str = "auto",
                 decay: str | None = None, buffer: bool = False, bypass: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Questions and blocks with all that the tiles read besides vectors; reads no vector."""
    q = pools.bypass_categories(questions, bypass) if bypass else questions
    q = pools.buffered(q) if buffer else q
    if time_filter:
        q, blocks = _with_decision(q, blocks, rule, axis_mode)
    if decay:
        query_day = F.col("tc_start")
        applies = rank.decay_applies(decay == "dated", F.col("intent"), F.col("tc_type"), query_day)
        q = q.withColumn("decay_day", F.when(applies, F.unix_date(query_day))).withColumn(
            "late_penalty", F.col("intent").isin("AS_OF", "STATIC")
        )
        blocks = blocks.withColumn("b_day", F.unix_date(F.coalesce("session_end", "session_start")))
    return q, blocks


def directed(questions: DataFrame) -> DataFrame:
    """Annotated questions with the columns that retrieval reads.

    ``questions(user_id, qa_idx, question, base_day, ...)`` gains ``tc_type``,
    ``tc_start``, ``tc_end``, ``axis``, ``intent``, ``anchor_relation`` and
    ``rewritten_query``.
    """
    a = annotate(questions)
    day = lambda c: F.to_date(c)
    return a.select(
        *questions.columns, F.col("tc.type").alias("tc_type"), day("tc.start").alias("tc_start"), day("tc.end").alias("tc_end"),
        F.col("time_axis").alias("axis"), "intent", F.col("tc.anchor_relation").alias("anchor_relation"), "rewritten_query",
    )


def resolved(questions: DataFrame, blocks: DataFrame, event_vectors: DataFrame, rules: anchors.AnchorRules = anchors.AnchorRules()) -> DataFrame:
    """Questions whose ANCHOR constraint is replaced by the window of the anchor's blocks; the others pass unchanged."""
    asked = questions.filter("tc_type = 'ANCHOR'").select(*KEY, "embedding", "anchor_relation")
    return _replaced(questions, anchors.resolve(asked, blocks, event_vectors, rules))


def _replaced(questions: DataFrame, resolved: DataFrame) -> DataFrame:
    """``questions`` with the constraint of those that are among ``resolved``."""
    found = resolved.select(*KEY, *(F.col(c).alias(f"_{c}") for c in ("tc_type", "tc_start", "tc_end", "axis")))
    took = F.col("_tc_type").isNotNull()
    changed = ("tc_type", "tc_start", "tc_end", "axis")
    q = questions.join(found, KEY, "left").withColumns({c: F.when(took, F.col(f"_{c}")).otherwise(F.col(c)) for c in changed})
    return q.drop(*(f"_{c}" for c in changed))


def answer_context(questions: DataFrame, blocks: DataFrame, event_vectors: DataFrame, vectors: DataFrame, k: int = 5, **options) -> DataFrame:
    """From question text to ranked blocks in one plan: annotate, resolve anchors, filter, rank by the rewritten question.

    ``questions(user_id, qa_idx, question, base_day)``; ``vectors(user_id, text_key, embedding)`` holds the vectors of
    question texts by :func:`timeweave.functions.text.content_key`, one of which is the rewritten text.  Options as in
    :func:`retrieve`.
    """
    told = directed(questions).withColumn("text_key", content_key(F.col("rewritten_query")))
    # annotation is the dear part and ranking reads its result several times: it is computed once, and before any join, whose
    # conditions the optimizer would otherwise push through the annotation with a copy of the matchers at every mention
    named = cut_lineage(told.select(*KEY, "text_key", "tc_type", "tc_start", "tc_end", "axis", "intent", "anchor_relation"))
    own = vectors.select("user_id", "text_key", "embedding").dropDuplicates(["user_id", "text_key"])
    # vectors come to the questions that are scored, just before their tiles: none is in a cut or in a join by question
    anchored = named.filter("tc_type = 'ANCHOR'").select(*KEY, "text_key", "anchor_relation")
    asked = anchored.join(own.join(anchored.select("user_id", "text_key"), ["user_id", "text_key"], "left_semi"), ["user_id", "text_key"], "left")
    settled = cut_lineage(_replaced(named, anchors.resolve(asked, blocks, event_vectors)))
    q, b = _constrained(settled, blocks, **options)
    ready = q.join(own, ["user_id", "text_key"], "left")
    return rank.tiled_top_k(ready, b, k, filtered=options.get("time_filter", True), decayed=options.get("decay") is not None)


def _with_decision(questions: DataFrame, blocks: DataFrame, rule: str, axis_mode: str) -> tuple[DataFrame, DataFrame]:
    decision = pools.decide_pool(questions.drop("embedding"), blocks, rule, axis_mode).select(*KEY, "pool_mode")
    return pools.with_bounds(questions).join(decision, KEY), pools.with_axis_days(blocks)
