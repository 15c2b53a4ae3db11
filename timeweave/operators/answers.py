"""Answer scoring: token overlap, exact match, BLEU-1, judge verdicts.

Overlaps are counted on exploded tokens with map-side combine: a multiset
intersection is ``sum(least(count in prediction, count in gold))``.  No step
holds two whole texts side by side, so long texts stay linear.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.functions.stem import with_stems
from timeweave.functions.text import answer_tokens, bleu_tokens, normalize_answer, words

# Refusal phrases of unanswerable questions, verdict scores.
REFUSALS = ("no information available", "not mentioned")
VERDICT_SCORES = {"Correct": 100, "Incorrect": 0}


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(part == 0, F.lit(0.0)).otherwise(part / whole)


def token_overlap(df: DataFrame, keys: Sequence[str], pred_tokens: Column, gold_tokens: Column, stemmed: bool = False) -> DataFrame:
    """``keys`` (unique) -> n_pred, n_gold, n_same, precision, recall, f1.  With ``stemmed``, equal tokens are counted first and
    their counts summed by stem, so each distinct word is stemmed once."""
    side = lambda tokens, p, g: F.transform(
        tokens, lambda t: F.struct(t.alias("t"), F.lit(p).alias("p"), F.lit(g).alias("g"))
    )
    both = df.select(*keys, F.explode_outer(F.concat(side(pred_tokens, 1, 0), side(gold_tokens, 0, 1))).alias("x"))
    per_token = both.groupBy(*keys, F.col("x.t").alias("t")).agg(
        F.coalesce(F.sum("x.p"), F.lit(0)).alias("p"), F.coalesce(F.sum("x.g"), F.lit(0)).alias("g")
    )
    if stemmed:
        per_token = with_stems(per_token, "t", keys).groupBy(*keys, "stem").agg(F.sum("p").alias("p"), F.sum("g").alias("g"))
    total = per_token.groupBy(*keys).agg(
        F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"), F.sum(F.least("p", "g")).alias("n_same")
    )
    p, r = _ratio(F.col("n_same"), F.col("n_pred")), _ratio(F.col("n_same"), F.col("n_gold"))
    return total.withColumn("precision", p).withColumn("recall", r).withColumn(
        "f1", F.when(F.col("n_same") == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    )


def single_answer(df: DataFrame, keys: Sequence[str], pred: str = "pred", gold: str = "gold", stemmed: bool = True) -> DataFrame:
    """Token precision, recall and F1 of normalised (stemmed) answers."""
    tokens = df.select(*keys, answer_tokens(F.col(pred)).alias("_p"), answer_tokens(F.col(gold)).alias("_g"))
    return token_overlap(tokens, keys, F.col("_p"), F.col("_g"), stemmed)


def _items(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x))


def multi_answer(df: DataFrame, keys: Sequence[str], pred: str = "pred", gold: str = "gold", stemmed: bool = True) -> DataFrame:
    """Comma-separated answers: per gold item the first best-F1 predicted item,
    then the mean over gold items -> precision, recall, f1."""
    gold_side = df.select(*keys, F.posexplode(_items(F.col(gold))).alias("g_pos", "g_item"), F.col(pred).alias("_pred"))
    pairs = gold_side.select(*keys, "g_pos", "g_item", F.posexplode(_items(F.col("_pred"))).alias("p_pos", "p_item"))
    scored = single_answer(pairs, [*keys, "g_pos", "p_pos"], "p_item", "g_item", stemmed)
    best = scored.groupBy(*keys, "g_pos").agg(
        F.max_by(F.struct("precision", "recall", "f1"), F.struct(F.col("f1"), -F.col("p_pos"))).alias("b")
    )
    return best.groupBy(*keys).agg(
        F.avg("b.precision").alias("precision"), F.avg("b.recall").alias("recall"), F.avg("b.f1").alias("f1")
    )


def exact_single(pred: Column, gold: Column) -> Column:
    return normalize_answer(pred) == normalize_answer(gold)


def exact_multi(pred: Column, gold: Column) -> Column:
    """Set equality of normalised comma items; false when a side has none."""
    items = lambda c: F.transform(
        F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x) != ""), normalize_answer
    )
    p, g = items(pred), items(gold)
    same = F.sort_array(F.array_distinct(p)) == F.sort_array(F.array_distinct(g))
    return (F.size(p) > 0) & (F.size(g) > 0) & same


def score_by_category(df: DataFrame, keys: Sequence[str], stemmed: bool = True) -> DataFrame:
    """``df(keys, category, pred, gold)`` -> f1, precision, recall, accuracy.

    Category 1 splits on commas, 2 and 4 compare whole answers, 3 compares up to
    the first semicolon, 5 checks for a refusal, anything else scores 0.
    """
    gold = F.when(F.col("category") == 3, F.trim(F.substring_index("gold", ";", 1))).otherwise(F.col("gold"))
    base = df.select(*keys, "category", F.coalesce("pred", F.lit("")).alias("pred"), F.coalesce(gold, F.lit("")).alias("gold"))
    metrics = ["precision", "recall", "f1"]
    single = single_answer(base.filter(F.col("category").isin(2, 3, 4)), keys, stemmed=stemmed).select(*keys, *metrics)
    multi = multi_answer(base.filter("category = 1"), keys, stemmed=stemmed).select(*keys, *metrics)
    low = F.lower("pred")
    refused = (low.contains(REFUSALS[0]) | low.contains(REFUSALS[1])).cast("double")
    flat = F.when(F.col("category") == 5, refused).otherwise(0.0)
    accuracy = (
        F.when(F.col("category").isin(2, 3, 4), exact_single(F.col("pred"), F.col("gold")).cast("double"))
        .when(F.col("category") == 1, exact_multi(F.col("pred"), F.col("gold")).cast("double"))
        .otherwise(flat)
    )
    joined = base.join(single.unionByName(multi), list(keys), "left")
    return joined.select(*keys, "category", *[F.coalesce(m, flat).alias(m) for m in metrics], accuracy.alias("accuracy"))


def best_plain_f1(df: DataFrame, keys: Sequence[str], pred: str = "pred", golds: str = "golds") -> DataFrame:
    """Unstemmed F1 on alphanumeric tokens, best over the list of gold answers."""
    rows = df.select(*keys, F.col(pred).alias("_p"), F.posexplode_outer(golds).alias("_pos", "_gold"))
    scored = token_overlap(
        rows.withColumn("_pos", F.coalesce("_pos", F.lit(0))), [*keys, "_pos"], words(F.col("_p")), words(F.col("_gold"))
    )
    return scored.groupBy(*keys).agg(F.max("f1").alias("f1"))


def _clipped(pred: str, golds: list) -> tuple:
    """Tokens of ``pred`` matched by one gold text each at most as often as there, its length, and the closest gold length."""
    tokens = lambda text: text.split(" ") if text else []
    words, refs = tokens(pred), [tokens(g) for g in golds]
    limit = Counter()
    for ref in refs:
        limit |= Counter(ref)
    return (Counter(words) & limit).total(), len(words), min((abs(len(r) - len(words)), len(r)) for r in refs)[1]


def bleu1(df: DataFrame, keys: Sequence[str], pred: str = "pred", golds: str = "golds") -> DataFrame:
    """Clipped unigram precision times brevity penalty (closest reference length,
    shorter one on ties); no overlap -> 0.  Rows without a gold text drop out.

    ``keys`` are unique, so a row is scored where it is: no token is shuffled, and a task holds the counts of one row.
    """
    # no token holds a blank; some are white space to Python, so tokens are split at blanks only
    spaced = lambda text: F.array_join(bleu_tokens(text), " ")
    # made here: the type of a function is read by a session, and the module is imported without one
    clipped = F.udf(_clipped, "struct<same: bigint, c_len: bigint, r_len: bigint>", useArrow=True)
    rows = df.filter(F.size(golds) > 0).select(*keys, clipped(spaced(F.col(pred)), F.transform(golds, spaced)).alias("_c")).select(*keys, "_c.*")
    penalty = F.when(F.col("c_len") > F.col("r_len"), 1.0).otherwise(F.exp(1 - F.col("r_len") / F.col("c_len")))
    value = F.when((F.col("same") == 0) | (F.col("c_len") == 0), 0.0).otherwise(F.col("same") / F.col("c_len") * penalty)
    return rows.select(*keys, value.alias("bleu"))


def judge_verdict(response: Column) -> Column:
    """Judge output text -> struct(reasoning, verdict, score).

    Reads a fenced JSON block or the first bare one; an unknown label counts as
    Incorrect, text without JSON as Error.
    """
    fenced = F.regexp_extract(response, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(response, r"(?s)(\{.*?\})", 1)
    block = F.when(fenced != "", fenced).otherwise(bare)
    parsed = F.from_json(block, "evaluation_result string, reasoning string")
    readable = (block != "") & F.try_parse_json(block).isNotNull()
    label = F.trim(F.coalesce(parsed["evaluation_result"], F.lit("")))
    verdict = F.when(~F.coalesce(readable, F.lit(False)), "Error").when(label == "Correct", "Correct").otherwise("Incorrect")
    return F.struct(
        F.coalesce(parsed["reasoning"], F.lit("")).alias("reasoning"), verdict.alias("verdict"),
        F.when(verdict == "Correct", VERDICT_SCORES["Correct"]).otherwise(0).alias("score"),
    )


def first_generation(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Duplicate generations: keep the first per (user, question, mode, depth)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
