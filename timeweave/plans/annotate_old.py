"""Compatibility preset: the earlier pattern list with noise-word rewriting.

One flat pattern list, first hit wins; both bounds are always set and the type
follows from keywords in the matched text.  Date parts a text leaves open are
taken from the base day (never from the clock).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.functions import dates as dt
from timeweave.functions.dates import YEAR, let
from timeweave.plans.annotate import (
    EDGE_PUNCTUATION,
    FUZZY_DAYS_OLD,
    INTENT_PHRASES,
    fuzzy_buffer,
    inferred_axis,
    intent_of,
    promoted_intent,
    remove_clause,
    target_types,
)

# ---- Fixed values: patterns in order, anchor hint, noise words ----------------------------
MONTH = (
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|"
    r"Nov(?:ember)?|Dec(?:ember)?)"
)
FULL = rf"{MONTH}\s+\d{{1,2}},?\s+{YEAR}"
PATTERNS = [
    (rf"(?i)\bby\s+{FULL}\b", "ABSOLUTE"),
    (rf"(?i)\bby\s+{YEAR}\b", "ABSOLUTE"),
    (rf"(?i)\b(?:after|before|since)\s+{FULL}\b", "ABSOLUTE"),
    (rf"(?i)\b{FULL}\b", "ABSOLUTE"),
    (rf"\b{YEAR}-\d{{2}}-\d{{2}}\b", "ABSOLUTE"),
    (rf"(?i)\b{MONTH}\s+{YEAR}\b", "ABSOLUTE"),
    (rf"(?i)\b(?:after|before|since)\s+{YEAR}\b", "ABSOLUTE"),
    (r"(?i)\b(?:yesterday|today|tomorrow)\b", "RELATIVE_POINT"),
    (r"(?i)\b(?:last|this|next) (?:year|month|week)\b", "RELATIVE_RANGE"),
    (rf"(?i)\bq[1-4]\s*{YEAR}\b", "ABSOLUTE"),
    (rf"(?i)\b(?:early|mid|late)\s+{YEAR}\b", "ABSOLUTE"),
    (rf"(?i)\b(?:(?:around|about|approx\.?|roughly|circa|ca\.)\s+)?{YEAR}\b", "ABSOLUTE"),
]
ANCHOR_HINT = r"(?i)\b(?:when|while|during)\s+(?:(?:i|we|he|she|they)\b|(?:his|her|my|our|their|your)\b|(?:the|a|an)\s+\w+|\w+ing\b)"
EXPLICIT_DATE = rf"(?i)\b(?:{YEAR}-\d{{2}}-\d{{2}}|{FULL}|{YEAR})\b"
FUZZY_HINTS = ("around", "about", "approx", "roughly", "circa", "ca.")
FUZZY_WORDS = r"\b(?:around|about|approx\.?|roughly|circa|ca\.?)\b"
NOISE = (
    r"(?i)\b(?:around|about|approx\.?|roughly|circa|ca\.|in|on|at|last|this|next|year|month|week|yesterday|today|tomorrow|"
    r"q[1-4]|as of|after|before|by)\b"
)
INTENTS = {
    **INTENT_PHRASES,
    "AS_OF": [p for p in INTENT_PHRASES["AS_OF"] if p != "as at"],
    "WINDOW": [p for p in INTENT_PHRASES["WINDOW"] if p not in ("what did", "when did")],
}
# -------------------------------------------------------------------------------------------


def _absolute(t: Column, base: Column) -> Column:
    """Cleaned lower-case text -> struct(start, end)."""
    part = lambda p, n: F.regexp_extract(t, p, n)
    quarter, third, full = r"^q([1-4])\s*(\d{4})$", r"^(early|mid|late)\s+(\d{4})$", rf"(?i)({MONTH})\s+(\d{{1,2}}),?\s+({YEAR})"
    month_year, lone = rf"(?i)({MONTH})\s+({YEAR})", r"^(?:(?:as of|after|before|on|at|in)\b\s*)?(\d{4})$"
    span = lambda s, e: F.struct(s.alias("start"), e.alias("end"))
    first = F.when(part(third, 1) == "early", 1).when(part(third, 1) == "mid", 5).otherwise(9)
    third_start = dt.ymd(part(third, 2), first, F.lit(1))
    one = lambda day: let(day, lambda x: span(x, x))
    month_first = dt.ymd(part(month_year, 2), dt.month_number(part(month_year, 1)), F.lit(1))
    clamped = F.date_add(month_first, F.least(F.day(base), F.day(F.last_day(month_first))) - 1)
    same_day = F.add_months(base, (F.regexp_extract(t, rf"({YEAR})", 1).try_cast("int") - F.year(base)) * 12)
    quarter_range = dt.quarter_range(dt.ymd(part(quarter, 2), (part(quarter, 1).try_cast("int") - 1) * 3 + 1, F.lit(1)))
    return (
        F.when(t.rlike(quarter), span(*quarter_range))
        .when(t.rlike(third), span(third_start, F.last_day(F.add_months(third_start, 3))))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), one(t.try_cast("date")))
        .when(t.rlike(lone), span(*dt.year_range(part(lone, 1))))
        .when(t.rlike(full), one(dt.ymd(part(full, 3), dt.month_number(part(full, 1)), part(full, 2))))
        .when(t.rlike(month_year), one(clamped))
        .when(t.rlike(YEAR), one(same_day))
    )


def _relative(t: Column, base: Column) -> Column:
    step = F.when(t.contains("last "), -1).when(t.contains("next "), 1).otherwise(0)
    week, year = dt.week_range(F.date_add(base, step * 7)), dt.year_range(F.year(base) + step)
    month = F.add_months(F.trunc(base, "month").cast("date"), step)
    pick = lambda a, b, c: F.when(t.contains("week"), a).when(t.contains("month"), b).otherwise(c)
    return F.struct(pick(week[0], month, year[0]).alias("start"), pick(week[1], F.last_day(month), year[1]).alias("end"))


def annotate_old(questions: DataFrame, question_col: str = "question", base_col: str = "base_day") -> DataFrame:
    """Same output columns as :func:`timeweave.plans.annotate.annotate`."""
    text, base = F.regexp_replace(F.coalesce(F.col(question_col), F.lit("")), r"^\s+|\s+$", ""), F.col(base_col)
    df = questions.withColumn("_text", text)
    text = F.col("_text")
    hit = F.coalesce(
        *[F.when(text.rlike(p), F.struct(F.regexp_substr(text, F.lit(p)).alias("text"), F.lit(k).alias("kind"))) for p, k in PATTERNS]
    )
    blocked = text.rlike(ANCHOR_HINT) & ~text.rlike(EXPLICIT_DATE)
    df = df.withColumn("_hit", F.when(~blocked, hit)).withColumn("_intent", intent_of(text, INTENTS))
    settled = (text != "") & ~blocked & (F.col("_hit").isNotNull() | F.col("_intent").isin("STATIC", "PLANNING"))
    low, kind = F.lower("_hit.text"), F.col("_hit.kind")
    clean = F.trim(F.regexp_replace(F.trim(F.regexp_replace(low, FUZZY_WORDS, "")), r"\b(?:in|on|at)\b\s+", ""))
    near = F.date_add(base, F.when(low.contains("yesterday"), -1).when(low.contains("tomorrow"), 1).otherwise(0))
    span = F.when(kind == "ABSOLUTE", let(clean, lambda t: _absolute(t, base))).when(
        kind == "RELATIVE_POINT", F.struct(near.alias("start"), near.alias("end"))
    ).otherwise(_relative(low, base))
    df = df.withColumn("parse_source", F.when(settled, "FAST").otherwise("FALLBACK")).withColumn("_span", F.when(settled & F.col("_hit").isNotNull(), span))
    fuzzy = F.lit(False)
    for word in FUZZY_HINTS:
        fuzzy = fuzzy | low.contains(word)
    fuzzy = F.coalesce(fuzzy, F.lit(False))
    start, end = fuzzy_buffer(F.col("_span.start"), F.col("_span.end"), fuzzy, FUZZY_DAYS_OLD)
    tc_type = (
        F.when(start.isNull() | end.isNull(), "NONE").when(low.rlike("after|since"), "AFTER").when(low.rlike("before|until|by"), "BEFORE")
        .when(start != end, "RANGE").otherwise("POINT")
    )
    intent = F.when(~settled, "MISC").otherwise(promoted_intent(F.col("_intent"), text))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, NOISE, ""), rf"(?i)\b{FULL}\b", ""), rf"\b{YEAR}-\d{{2}}-\d{{2}}\b", "")
    bare = F.btrim(F.regexp_replace(bare, r"\s+", " "), F.lit(" ?.,"))
    bare = F.when(bare == "", text).otherwise(bare)
    contains = F.lower(bare).contains(low)
    rewritten = F.when(~settled, text).when(F.col("_hit").isNotNull() & (contains | (F.trim(bare) == text)), remove_clause(bare, F.col("_hit.text"))).otherwise(bare)
    none = F.lit(None).cast("string")
    tc = F.struct(
        start.alias("start"), end.alias("end"), tc_type.alias("type"), none.alias("anchor_event"), none.alias("anchor_relation"),
        fuzzy.alias("is_fuzzy"), F.col("_hit.text").alias("raw_text"),
    )
    out = df.withColumns({"intent": intent, "tc": tc, "rewritten_query": F.btrim(rewritten, F.lit(EDGE_PUNCTUATION))})
    use = ~F.col("intent").isin("PLANNING", "STATIC") & F.col("tc.type").isin("RANGE", "POINT", "AFTER", "BEFORE")
    out = out.withColumn("use_time", use).withColumn("target_types", target_types(F.col("intent")))
    axis = F.when(~F.col("use_time"), "NONE").otherwise(inferred_axis(F.col("_text"), F.col("tc.type")))
    return out.withColumn("time_axis", axis).drop("_text", "_hit", "_intent", "_span")
