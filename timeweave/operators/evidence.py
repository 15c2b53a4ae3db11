"""Evidence references to blocks, and retrieval metrics against gold blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.functions.text import session_number

KEY = ["user_id", "qa_idx"]


#: Messages of a session that one join key covers.
MESSAGES_PER_BUCKET = 64


def message_targets(questions: DataFrame, blocks: DataFrame, trailing_session: bool = False, bucket: int = MESSAGES_PER_BUCKET) -> DataFrame:
    """Evidence ``D<session>:<message>`` -> blocks covering that message.

    ``trailing_session`` also maps session ids that end in the number
    (``c1_session7``).  Returns distinct ``(user_id, qa_idx, block_id)``.
    A block is joined under every ``bucket`` messages it covers, so references
    into a long session meet only the blocks near them.
    """
    ref = questions.select(*KEY, F.explode("evidence").alias("_ev")).select(
        *KEY,
        F.regexp_extract("_ev", r"^\D(\d+):", 1).try_cast("int").alias("session_no"),
        F.regexp_extract("_ev", r"^[^:]*:\s*(\d+)", 1).try_cast("int").alias("_msg"),
    )
    cover = blocks.select(
        "user_id", "block_id", session_number(F.col("coverage.session_id"), trailing_session).alias("session_no"),
        F.coalesce("coverage.start_idx", F.lit(0)).alias("_from"), F.coalesce("coverage.end_idx", F.lit(0)).alias("_to"),
    )
    at = lambda c: F.floor(F.col(c) / bucket)
    cover = cover.filter(F.col("_from") <= F.col("_to")).withColumn("_bucket", F.explode(F.sequence(at("_from"), at("_to"))))
    hit = ref.withColumn("_bucket", at("_msg")).join(cover, ["user_id", "session_no", "_bucket"]).filter(F.col("_msg").between(F.col("_from"), F.col("_to")))
    return hit.select(*KEY, "block_id").distinct()


def session_targets(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Evidence session ids -> every block of those sessions, distinct."""
    ref = questions.select(*KEY, F.explode("answer_session_ids").alias("session_id")).distinct()
    cover = blocks.select("user_id", "block_id", F.col("coverage.session_id").alias("session_id"))
    return ref.join(cover, ["user_id", "session_id"]).select(*KEY, "block_id").distinct()


def question_metrics(ranked: DataFrame, gold: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Per question: first_rr, complete_mrr, hit, recall (null without gold).

    first_rr = 1 / rank of the first gold block in the top ``k``; complete_mrr =
    gold count / rank of the last one when all are in the top ``k``, else 0.
    """
    n_gold = gold.groupBy(*KEY).agg(F.count_distinct("block_id").alias("n_gold"))
    found = (
        ranked.filter(F.col("rank") <= k).join(gold.select(*KEY, "block_id").distinct(), [*KEY, "block_id"], "left_semi")
        .groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_found"), F.min("rank").alias("_first"), F.max("rank").alias("_last"))
    )
    joined = queries.select(*KEY).join(n_gold, KEY, "left").join(found, KEY, "left")
    with_gold = F.col("n_gold").isNotNull()
    found_n = F.coalesce("n_found", F.lit(0))
    return joined.select(
        *KEY,
        F.when(with_gold, F.coalesce(1 / F.col("_first"), F.lit(0.0))).alias("first_rr"),
        F.when(with_gold, F.when(found_n == F.col("n_gold"), F.col("n_gold") / F.col("_last")).otherwise(0.0)).alias("complete_mrr"),
        F.when(with_gold, (found_n > 0).cast("int")).alias("hit"),
        F.when(with_gold, found_n / F.col("n_gold")).alias("recall"),
    )


def summarize_metrics(per_question: DataFrame, *by: str) -> DataFrame:
    """Means; the hit rate divides by all questions, the others by those with gold."""
    return per_question.groupBy(*by).agg(
        F.coalesce(F.avg("first_rr"), F.lit(0.0)).alias("first_relevant_mrr"),
        F.coalesce(F.avg("complete_mrr"), F.lit(0.0)).alias("complete_mrr"),
        (F.coalesce(F.sum("hit"), F.lit(0)) / F.count(F.lit(1))).alias("hit_at_k"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall_at_k"),
        F.count(F.lit(1)).alias("total_queries"),
        F.count("first_rr").alias("queries_with_targets"),
    )


#: Constraint types of the two reported subsets.
SUBSETS = {"point_range": ("POINT", "RANGE"), "any_temporal": ("POINT", "RANGE", "BEFORE", "AFTER", "ANCHOR")}


def subset_metrics(per_question: DataFrame, reference_run: DataFrame, subset: str) -> DataFrame:
    """Metrics on the questions whose constraint in ``reference_run`` is in the subset."""
    keys = reference_run.filter(F.col("tc_type").isin(*SUBSETS[subset])).select(*KEY)
    return summarize_metrics(per_question.join(keys, KEY, "left_semi"))


def compare_runs(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """Wins, losses and ties of run ``b`` over run ``a`` per question."""
    both = a.select(*KEY, F.col(metric).alias("_a")).join(b.select(*KEY, F.col(metric).alias("_b")), KEY)
    return both.agg(
        F.count_if(F.col("_b") > F.col("_a")).alias("wins"), F.count_if(F.col("_b") < F.col("_a")).alias("losses"),
        F.count_if(F.col("_b") == F.col("_a")).alias("ties"),
    )
