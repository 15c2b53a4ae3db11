"""Which blocks a question may see: axis verdicts, fallbacks, audits.

Fallback rules need counts per question ("did anything survive?").  They are
decided in a pass that reads ids and dates only -- no vectors -- and reduces the
pair stream map-side to one row per question.  The decision is a ``pool_mode``
column that the scoring pass applies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.operators import temporal as tp
from timeweave.operators.skew import ROWS_PER_SLICE, pool_join

QUESTION_KEY = ["user_id", "qa_idx"]
AXES = ("EVENT", "SESSION", "BOTH_INTERSECT", "BOTH_UNION")


def with_bounds(questions: DataFrame) -> DataFrame:
    """Express any constraint as four day bounds (null = unbounded)."""
    t, start, end = F.col("tc_type"), F.col("tc_start"), F.col("tc_end")
    day = F.unix_date
    return (
        questions.withColumn("q_start_max", F.when(t == "RANGE", F.when(start.isNotNull(), day(end))).when(t == "POINT", day(start)))
        .withColumn("q_end_min", F.when(t.isin("RANGE", "POINT"), day(start)))
        .withColumn("q_end_max", F.when(t.isin("BEFORE", "UNTIL"), day(F.coalesce(end, start))))
        .withColumn("q_start_min", F.when(t.isin("AFTER", "SINCE"), day(start)))
    )


def with_axis_days(blocks: DataFrame) -> DataFrame:
    """Repaired axis intervals as day numbers."""
    ev_lo, ev_hi = tp.repaired(F.col("event_start"), F.col("event_end"))
    ss_lo, ss_hi = tp.repaired(F.col("session_start"), F.col("session_end"))
    on_event = tp.on_axis(F.col("event_start"), F.col("event_end"))
    on_session = tp.on_axis(F.col("session_start"), F.col("session_end"))
    return (
        blocks.withColumn("ev_lo", F.when(on_event, F.unix_date(ev_lo)))
        .withColumn("ev_hi", F.when(on_event, F.unix_date(ev_hi)))
        .withColumn("ss_lo", F.when(on_session, F.unix_date(ss_lo)))
        .withColumn("ss_hi", F.when(on_session, F.unix_date(ss_hi)))
    )


def axis_verdicts(questions: DataFrame, blocks: DataFrame, rows_per_slice: int = ROWS_PER_SLICE, before_compat: bool = False,
                  extra: tuple[str, ...] = ()) -> DataFrame:
    """Stream of (question, block) with ``ok_event`` and ``ok_session``."""
    q = questions.select(*QUESTION_KEY, "tc_type", "tc_start", "tc_end", "axis", "intent")
    b = blocks.select("user_id", "block_id", "session_start", "session_end", "event_start", "event_end", *extra)
    constraint = (F.col("tc_type"), F.col("tc_start"), F.col("tc_end"), before_compat)
    return pool_join(q, b, rows_per_slice=rows_per_slice).withColumns(
        {
            "ok_event": tp.matches_axis(F.col("event_start"), F.col("event_end"), *constraint)
            & _dated_or_unfiltered(F.col("event_start"), F.col("event_end")),
            "ok_session": tp.matches_axis(F.col("session_start"), F.col("session_end"), *constraint)
            & _dated_or_unfiltered(F.col("session_start"), F.col("session_end")),
        }
    )


def _dated_or_unfiltered(start: Column, end: Column) -> Column:
    """Undated blocks pass only where the constraint filters nothing."""
    return tp.on_axis(start, end) | filters_nothing(F.col("tc_type"), F.col("tc_start"), F.col("tc_end"))


def filters_nothing(tc_type: Column, tc_start: Column, tc_end: Column) -> Column:
    """No constraint, an unknown one, or one without the date it needs."""
    return (
        ~tc_type.isin("RANGE", "POINT", "BEFORE", "UNTIL", "AFTER", "SINCE")
        | (tc_type.isin("RANGE", "POINT", "AFTER", "SINCE") & tc_start.isNull())
        | (tc_type.isin("BEFORE", "UNTIL") & F.coalesce(tc_end, tc_start).isNull())
    )


def pool_counts(verdicts: DataFrame) -> DataFrame:
    """One row per question: size of the pool under every axis rule."""
    e, s = F.col("ok_event"), F.col("ok_session")
    return verdicts.groupBy(*QUESTION_KEY).agg(
        F.count(F.lit(1)).alias("n_pool"),
        F.count_if(e).alias("n_event"),
        F.count_if(s).alias("n_session"),
        F.count_if(e & s).alias("n_intersect"),
        F.count_if(e | s).alias("n_union"),
    )


AXIS_DAYS = ["ev_lo", "ev_hi", "ss_lo", "ss_hi"]
SPEC = ["user_id", "tc_type", "tc_start", "tc_end"]
COUNTS = ["n_pool", "n_event", "n_session", "n_intersect", "n_union"]


#: A day after all others, for bounds that are open.
FOREVER = 2_147_483_647


def axis_counts(specs: DataFrame, days: DataFrame) -> DataFrame:
    """(constraint, n_event, n_session): blocks that satisfy it on each axis, by counting starts and ends apart.

    An interval misses a closed range by starting after it or by ending before it, never both, so the matches are those that start
    by its end less those that end before its start.  Starts and ends are counted per user and day; running sums over a user's
    days answer all bounds at once, and no constraint meets a block.  ``specs`` come from :func:`with_bounds`, and no RANGE of
    them ends before it starts; ``days`` come from :func:`with_axis_days`.
    """
    side = lambda name, day: F.struct(F.lit(name).alias("_side"), day.cast("int").alias("_day"))
    dated = days.select("user_id", F.explode(F.array(*[side(c, F.col(c)) for c in AXIS_DAYS])).alias("_s")).select("user_id", "_s.*", F.lit(1).alias("_n"))
    t, forever = F.col("tc_type"), F.lit(FOREVER)

    def terms(axis: str) -> list[Column]:
        lo, hi = f"{axis}_lo", f"{axis}_hi"
        by = F.when(t.isin("BEFORE", "UNTIL"), side(hi, F.col("q_end_max"))).otherwise(side(lo, F.coalesce("q_start_max", forever)))
        less = F.when(t.isin("AFTER", "SINCE"), side(lo, F.col("q_start_min") - 1)).otherwise(side(hi, F.col("q_end_min") - 1))
        return [F.struct(F.lit(axis).alias("_axis"), part["_side"].alias("_side"), part["_day"].alias("_day"), F.lit(sign).alias("_sign")) for part, sign in ((by, 1), (less, -1))]

    asked = specs.select(*SPEC, F.explode(F.array(*terms("ev"), *terms("ss"))).alias("_t")).select(*SPEC, "_t.*").filter(F.col("_day").isNotNull())
    steps = dated.filter(F.col("_day").isNotNull()).unionAll(asked.select("user_id", "_side", "_day", F.lit(0).alias("_n")))
    per_day = steps.groupBy("user_id", "_side", "_day").agg(F.sum("_n").alias("_n"))
    so_far = Window.partitionBy("user_id", "_side").orderBy("_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = per_day.select("user_id", "_side", "_day", F.sum("_n").over(so_far).alias("_upto"))
    met = asked.join(running, ["user_id", "_side", "_day"])
    on = lambda axis: F.sum(F.when(F.col("_axis") == axis, F.col("_sign") * F.col("_upto")).otherwise(0))
    return met.groupBy(*SPEC).agg(on("ev").alias("n_event"), on("ss").alias("n_session"))


def with_pool_counts(questions: DataFrame, blocks: DataFrame, rows_per_slice: int = ROWS_PER_SLICE, joint: Column | bool = True, ordered: bool = False) -> DataFrame:
    """``questions`` with the size of their pool under every axis rule.

    Counts depend on dates only and questions are reduced to distinct constraints.  The counts of one axis are running sums over
    days (:func:`axis_counts`).  The counts of both axes together are needed where ``joint`` holds (elsewhere they may be null): for those
    constraints, blocks are counted per user and distinct combination of their four dates and combinations met with constraints,
    so that work is bounded by the calendar and not by questions times blocks.  So are ranges that end before they start, which
    ``ordered`` says there are none of.  Constraints that filter nothing take the whole pool from one count per user.
    """
    b = with_axis_days(blocks.select("user_id", "session_start", "session_end", "event_start", "event_end"))
    total = b.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_pool"))
    constraint = (F.col("tc_type"), F.col("tc_start"), F.col("tc_end"))
    inverted = (F.col("tc_type") == "RANGE") & (F.col("tc_end") < F.col("tc_start")) & F.lit(not ordered)
    inverted = F.coalesce(inverted, F.lit(False))
    wanted = F.lit(joint) if isinstance(joint, bool) else F.coalesce(joint, F.lit(False))
    specs = questions.filter(~filters_nothing(*constraint)).groupBy(*SPEC).agg(F.max(wanted | inverted).alias("_joint"))
    counts = []
    if joint is not True:
        apart = axis_counts(with_bounds(specs.filter(~F.col("_joint"))), b).select(*SPEC, "n_event", "n_session", *(F.lit(None).cast("bigint").alias(c) for c in COUNTS[3:]))
        counts.append(apart)
    if joint is not False or not ordered:
        cells = b.groupBy("user_id", *AXIS_DAYS).agg(F.count(F.lit(1)).alias("_n"))
        meet = pool_join(with_bounds(specs.filter("_joint").select(*SPEC)), cells, spread_by=AXIS_DAYS, rows_per_slice=rows_per_slice, batch_by=SPEC[1:])
        e, s = on_bounds("ev_lo", "ev_hi"), on_bounds("ss_lo", "ss_hi")
        counted = lambda ok: F.sum(F.when(ok, F.col("_n")).otherwise(0))
        both = meet.groupBy(*SPEC).agg(counted(e).alias("n_event"), counted(s).alias("n_session"), counted(e & s).alias("n_intersect"), counted(e | s).alias("n_union"))
        counts.append(both)
    sizes = reduce(DataFrame.unionByName, counts)
    named = sizes.withColumnsRenamed({c: f"_{c}" for c in SPEC})
    same = [questions["user_id"] == named["_user_id"], *(questions[c].eqNullSafe(named[f"_{c}"]) for c in SPEC[1:])]
    q = questions.join(named, same, "left").drop(*(f"_{c}" for c in SPEC)).join(total, "user_id", "left").fillna(0, ["n_pool"])
    open_ = filters_nothing(*constraint)
    # a user without blocks has no row among the sizes
    filled = {c: F.when(open_, F.col("n_pool")).when(F.col("n_pool") == 0, 0).otherwise(F.col(c)) for c in COUNTS[1:]}
    return q.withColumns({c: v if c in COUNTS[3:] else F.coalesce(v, F.lit(0)) for c, v in filled.items()})


def on_bounds(lo: str, hi: str) -> Column:
    """Is a dated interval within the four bounds of :func:`with_bounds`?"""
    within = lambda bound, ok: F.col(bound).isNull() | ok
    return (
        F.col(lo).isNotNull() & F.col(hi).isNotNull()
        & within("q_start_max", F.col(lo) <= F.col("q_start_max")) & within("q_end_min", F.col(hi) >= F.col("q_end_min"))
        & within("q_end_max", F.col(hi) <= F.col("q_end_max")) & within("q_start_min", F.col(lo) >= F.col("q_start_min"))
    )


def decide_pool(questions: DataFrame, blocks: DataFrame, rule: str = "empty", axis_mode: str = "auto",
                rows_per_slice: int = ROWS_PER_SLICE, min_pool: int = 3, small_pool: int = 20, small_share: float = 0.1) -> DataFrame:
    """Attach ``pool_mode``, ``pool_size``, ``pool_label`` and ``fell_back``.

    ``rule``: ``empty`` (no survivor -> whole pool), ``min_pool`` (fewer than
    ``min_pool`` survivors -> whole pool), ``small_pool`` (fewer than ``small_pool``
    and than ``small_share`` of the pool -> union, then whole pool; automatic axis
    only) or ``event_first`` (session axis only when the event axis is empty).
    A constraint without a usable date filters nothing: its pool is the whole pool.
    ``n_intersect`` and ``n_union`` are null where no decision reads them: under ``event_first`` and a forced single axis.
    """
    axis = F.upper(F.coalesce(tp.forced_axis(F.col("axis"), axis_mode), F.lit("BOTH_UNION")))
    axis = F.when(axis.isin(*AXES, "NONE"), axis).otherwise("BOTH_UNION")
    # annotated axes take either or both: then one pass over date combinations answers all of them
    q = with_pool_counts(questions, blocks, rows_per_slice, joint=rule != "event_first" and axis_mode not in ("event", "session"))
    skip = ~tp.uses_time(F.col("intent"), F.col("tc_type")) | (F.col("tc_type") == "ANCHOR") | F.lit(axis_mode == "none")
    skip = skip | filters_nothing(F.col("tc_type"), F.col("tc_start"), F.col("tc_end"))

    if rule == "event_first":
        q = q.withColumn("_axis", F.when(F.col("n_event") > 0, "EVENT").otherwise("SESSION"))
    else:
        q = q.withColumn("_axis", axis)
    degraded = (F.col("_axis") == "BOTH_INTERSECT") & (F.coalesce("n_intersect", F.lit(-1)) == 0)
    q = q.withColumn("_mode", F.when(degraded, "BOTH_UNION").otherwise(F.col("_axis"))).withColumn("_n", _size_of("_mode"))
    q = q.withColumn("pool_label", F.when(skip, "FULL").when(degraded, "BOTH_INTERSECT_DEGRADED_UNION").otherwise(F.col("_mode")))

    if rule == "small_pool" and axis_mode == "auto":
        small = lambda n: (n < small_pool) & (n < F.lit(small_share) * F.greatest(F.lit(1), F.col("n_pool")))
        widen = small(F.col("_n")) & (F.col("_axis") != "BOTH_UNION") & (F.col("n_union") > F.col("_n"))
        q = q.withColumn("_mode", F.when(widen, "BOTH_UNION").otherwise(F.col("_mode"))).withColumn("_n", _size_of("_mode"))
        fall_back = small(F.col("_n")) | (F.col("_n") == 0)
    elif rule == "min_pool":
        fall_back = F.col("_n") < min_pool
    else:
        fall_back = F.col("_n") == 0
    return (
        q.withColumn("fell_back", ~skip & fall_back)
        .withColumn("pool_mode", F.when(skip | fall_back, "FULL").otherwise(F.col("_mode")))
        .withColumn("pool_size", F.when(F.col("pool_mode") == "FULL", F.col("n_pool")).otherwise(F.col("_n")))
        .drop("_axis", "_mode", "_n")
    )


def _size_of(mode_col: str) -> Column:
    return size_on(F.col(mode_col))


def size_on(mode: Column) -> Column:
    """The pool size of an axis rule, from the counts."""
    return (
        F.when(mode == "EVENT", F.col("n_event"))
        .when(mode == "SESSION", F.col("n_session"))
        .when(mode == "BOTH_INTERSECT", F.col("n_intersect"))
        .when(mode == "NONE", F.lit(0))
        .otherwise(F.col("n_union"))
    )


def in_pool(mode: Column, ok_event: Column, ok_session: Column) -> Column:
    """Does a pair belong to the decided pool?"""
    return F.when(mode == "FULL", F.lit(True)).otherwise(tp.dispatch(mode, ok_event, ok_session))


def surviving_pairs(decided: DataFrame, blocks: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Pairs that survive the time filter of questions that did not fall back.

    Questions whose pool is the whole pool are left out: their rows would repeat
    the pool itself; ``pool_mode = FULL`` says the same in one row.
    """
    active = decided.filter(F.col("pool_mode") != "FULL").withColumn("axis", F.col("pool_mode"))
    pairs = axis_verdicts(active, blocks, rows_per_slice)
    return pairs.filter(tp.dispatch(F.col("axis"), F.col("ok_event"), F.col("ok_session"))).select(*QUESTION_KEY, "block_id")


def buffered(questions: DataFrame) -> DataFrame:
    """Constraint widened by intent: WINDOW 365 days, AS_OF 180, others 1500."""
    t, s, e = tp.widened(F.col("tc_type"), F.col("tc_start"), F.col("tc_end"), tp.buffer_days(F.col("intent")))
    return questions.withColumns({"tc_type": t, "tc_start": s, "tc_end": e})


def bypass_categories(questions: DataFrame, categories: tuple[str, ...] = ("Memory Conflict",)) -> DataFrame:
    """Listed question categories are never filtered on time."""
    skip = F.coalesce(F.col("category"), F.lit("")).isin(*categories)
    return questions.withColumn("tc_type", F.when(skip, "NONE").otherwise(F.col("tc_type")))


def pool_audit(decided: DataFrame, blocks: DataFrame, gold: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Per question: pool sizes before and after filtering, gold kept and lost.

    Gold is the small side (a few blocks per question), so gold counters come
    from the gold pairs only and never touch the full pair stream.
    """
    flagged = gold_in_pool(decided, blocks, gold)
    counts = flagged.groupBy(*QUESTION_KEY).agg(
        F.count(F.lit(1)).alias("gold_total"), F.count_if("_kept").alias("gold_after_time")
    )
    return (
        decided.select(*QUESTION_KEY, "n_pool", "pool_size", "fell_back")
        .join(counts, QUESTION_KEY, "left")
        .fillna(0, ["gold_total", "gold_after_time"])
        .withColumn("gold_lost_time", F.col("gold_total") - F.col("gold_after_time"))
    )


def lost_gold(decided: DataFrame, blocks: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold rows that the decided pool leaves out."""
    return gold_in_pool(decided, blocks, gold).filter(~F.col("_kept")).select(*QUESTION_KEY, "block_id")


def gold_in_pool(decided: DataFrame, blocks: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold rows with ``_kept``: is the block there and in the decided pool?"""
    gold_pairs = gold.join(decided.select(*QUESTION_KEY, "tc_type", "tc_start", "tc_end", "intent", "pool_mode"), QUESTION_KEY)
    b = blocks.select("user_id", "block_id", "session_start", "session_end", "event_start", "event_end", F.lit(True).alias("_there"))
    constraint = (F.col("tc_type"), F.col("tc_start"), F.col("tc_end"))
    return gold_pairs.join(b, ["user_id", "block_id"], "left").withColumn(
        "_kept",
        F.col("_there").isNotNull()
        & in_pool(
            F.col("pool_mode"),
            tp.matches_axis(F.col("event_start"), F.col("event_end"), *constraint)
            & _dated_or_unfiltered(F.col("event_start"), F.col("event_end")),
            tp.matches_axis(F.col("session_start"), F.col("session_end"), *constraint)
            & _dated_or_unfiltered(F.col("session_start"), F.col("session_end")),
        ),
    )


def trace_from_rankings(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Audit rows derived from finished rankings; earlier stages count as lossless."""
    g = gold.groupBy(*QUESTION_KEY).agg(F.count(F.lit(1)).alias("gold_total"))
    hits = (
        ranked.filter(F.col("rank") <= k)
        .join(gold, [*QUESTION_KEY, "block_id"], "left_semi")
        .groupBy(*QUESTION_KEY)
        .agg(F.count(F.lit(1)).alias("gold_in_topk"))
    )
    return (
        g.join(hits, QUESTION_KEY, "left")
        .fillna(0, ["gold_in_topk"])
        .withColumn("gold_after_time", F.col("gold_total"))
        .withColumn("gold_lost_time", F.lit(0).cast("bigint"))
    )


def any_category(block_categories: Column, wanted: Column) -> Column:
    """Case-insensitive overlap; an empty request accepts every block."""
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    return (F.size(wanted) == 0) | F.arrays_overlap(low(block_categories), low(wanted))


def keyword_overlap(question_tokens: Column, block_tokens: Column, threshold: float = 0.3) -> Column:
    """Share of question tokens found in the block; tokenless blocks fail, an
    empty question accepts every block."""
    ratio = F.size(F.array_intersect(question_tokens, block_tokens)) / F.size(question_tokens)
    return F.when(F.size(question_tokens) == 0, True).when(F.size(block_tokens) == 0, False).otherwise(ratio >= threshold)


def base_time(blocks: DataFrame, default_base: Column) -> DataFrame:
    """Latest session date per user; the caller supplies the default."""
    latest = F.max(F.greatest("session_end", "session_start"))
    return blocks.groupBy("user_id").agg(F.coalesce(latest, default_base).alias("base_day"))
