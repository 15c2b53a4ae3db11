"""Time predicates on closed date intervals, as native Column expressions.

Blocks carry two axes: ``session_start/_end`` (when it was said) and
``event_start/_end`` (when it happened), all nullable dates.  Questions carry
``tc_type``, ``tc_start``, ``tc_end``, ``axis`` and ``intent``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date bound for an open end, buffer days by intent.
OPEN_END = "9999-12-31"
INTENT_BUFFER_DAYS = {"WINDOW": 365, "AS_OF": 180}
OTHER_BUFFER_DAYS = 1500
FILTERING_TYPES = ("RANGE", "POINT", "AFTER", "BEFORE")
HISTORY_INTENTS = ("PLANNING", "STATIC")


def repaired(start: Column, end: Column) -> tuple[Column, Column]:
    """Swap the ends of an inverted interval."""
    return F.least(start, end), F.greatest(start, end)


def on_axis(start: Column, end: Column) -> Column:
    """A block is on an axis only when both of its dates are known."""
    return start.isNotNull() & end.isNotNull()


def overlaps(b_start: Column, b_end: Column, q_start: Column, q_end: Column) -> Column:
    """Closed-interval overlap; a missing question end is unbounded."""
    bound = F.coalesce(q_end, F.lit(OPEN_END).cast("date"))
    return (b_start <= bound) & (b_end >= q_start)


def cutoff(tc_start: Column, tc_end: Column, before_compat: bool = False) -> Column:
    """Cut-off date of a BEFORE constraint.

    ``before_compat`` reads the start only, so a constraint that carries just an
    end date filters nothing.
    """
    return tc_start if before_compat else F.coalesce(tc_end, tc_start)


def matches_axis(
    b_start: Column, b_end: Column, tc_type: Column, tc_start: Column, tc_end: Column, before_compat: bool = False
) -> Column:
    """Does the block satisfy the constraint on one axis?  Never null.

    NONE, an unknown type or a missing start means "no filtering": true even for
    blocks without dates.
    """
    lo, hi = repaired(b_start, b_end)
    cut = cutoff(tc_start, tc_end, before_compat)
    verdict = (
        F.when(tc_type == "RANGE", F.when(tc_start.isNull(), True).otherwise(overlaps(lo, hi, tc_start, tc_end)))
        .when(tc_type == "POINT", F.when(tc_start.isNull(), True).otherwise(overlaps(lo, hi, tc_start, tc_start)))
        .when(tc_type.isin("BEFORE", "UNTIL"), F.when(cut.isNull(), True).otherwise(hi <= cut))
        .when(tc_type.isin("AFTER", "SINCE"), F.when(tc_start.isNull(), True).otherwise(lo >= tc_start))
        .otherwise(F.lit(True))
    )
    return F.coalesce(verdict, F.lit(False))


def dispatch(axis: Column, ok_event: Column, ok_session: Column) -> Column:
    """Combine the two axis verdicts.  NONE keeps nothing (callers skip the filter)."""
    return (
        F.when(F.upper(axis) == "NONE", F.lit(False))
        .when(F.upper(axis) == "EVENT", ok_event)
        .when(F.upper(axis) == "SESSION", ok_session)
        .when(F.upper(axis) == "BOTH_INTERSECT", ok_event & ok_session)
        .otherwise(ok_event | ok_session)
    )


def forced_axis(axis: Column, mode: str) -> Column:
    """Axis override: ``auto`` keeps the annotated axis, others force it."""
    forced = {"auto": axis, "session": F.lit("SESSION"), "event": F.lit("EVENT"), "none": F.lit("NONE")}
    return forced[mode]


def uses_time(intent: Column, tc_type: Column) -> Column:
    """PLANNING and STATIC questions never filter on time."""
    return ~F.coalesce(intent, F.lit("MISC")).isin(*HISTORY_INTENTS) & tc_type.isin(*FILTERING_TYPES, "ANCHOR")


def buffer_days(intent: Column) -> Column:
    expr = F.lit(OTHER_BUFFER_DAYS)
    for name, days in INTENT_BUFFER_DAYS.items():
        expr = F.when(intent == name, days).otherwise(expr)
    return expr.cast("int")


def widened(tc_type: Column, tc_start: Column, tc_end: Column, days: Column) -> tuple[Column, Column, Column]:
    """Constraint widened by ``days`` on its open sides -> (type, start, end).

    AFTER moves its start back, BEFORE its cut-off forward, RANGE and POINT
    become a RANGE padded on both sides.  Without a start nothing is filtered.
    """
    none = F.lit(None).cast("date")
    new_type = (
        F.when(tc_start.isNull() & (tc_type != "BEFORE"), F.lit("NONE"))
        .when(F.coalesce(tc_start, tc_end).isNull(), F.lit("NONE"))
        .when(tc_type.isin("RANGE", "POINT"), F.lit("RANGE"))
        .otherwise(tc_type)
    )
    new_start = F.when(tc_type == "BEFORE", none).otherwise(F.date_sub(tc_start, days))
    new_end = (
        F.when(tc_type == "AFTER", none)
        .when(tc_type == "BEFORE", F.date_add(F.coalesce(tc_end, tc_start), days))
        .otherwise(F.date_add(F.coalesce(tc_end, tc_start), days))
    )
    return new_type, new_start, new_end
