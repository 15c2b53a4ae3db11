"""Annotation of a question table: time constraint, intent, axis, rewrite.

Everything is native expressions over the question column, so the job is a
single map stage.  The phrase pipeline is one higher-order ``transform`` over
the texts it must be tried on (the question, and for anchor clauses the clause
body with and without a trailing year), which keeps the expression tree at one
copy of the matchers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.functions import dates as dt
from timeweave.functions.dates import MONTHS, YEAR, group, let
from timeweave.functions.time_phrases import Matcher, Options, first_match, holds

# ---- Fixed values: anchor clauses, intents, axis cues ------------------------------------
ANCHOR = (
    r"(?i)\b(when|while|during|before|after|since)\s+"
    r"(?:(?:i|we|he|she|they|you)\b|(?:his|her|my|our|their|your)\b|(?:the|a|an)\s+\w+|\w+ing\b)"
)
CLAUSE_STOP = r"(?:[?.;:,!]|\s+and\s+(?:did|was|were|i|you|he|she|they|we)\s)"
ANCHOR_RELATIONS = {"when": "DURING", "while": "DURING", "during": "DURING", "before": "BEFORE", "after": "AFTER", "since": "AFTER"}
MONTH_DAY = rf"(?i)\b({MONTHS})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?\b"
DAY_MONTH = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?({MONTHS})\.?\b"
INTENT_PHRASES = {
    "STATIC": ["what is", "what's", "birth date", "birthday", "my name", "blood type", "mbti", "middle name"],
    "AS_OF": ["as of", "as at", "where did i live", "was i", "who was", "where was", " unemployed as of", " employed as of"],
    "WINDOW": [
        "what happened", "what did i do", "when did i", "what did", "when did", "did i go", "did i visit", "did i express",
        "did i work", "did i dislike", "did i like", "therapy session", "during the dialogue",
    ],
    "PLANNING": [
        "plan to", "going to", "intend to", "future goal", " explore next", " influence ", " prefer if",
        "could ", "would ", "might ", "should ", "what could", "what would", "what might", "what should",
        "who could", "who would", "who might", "who should", "how could", "how would", "how might", "how should",
        "which could", "which would", "which might", "what strategies could", "what strategies might",
    ],
}
TARGET_TYPES = {"WINDOW": "OCCURRENCE", "AS_OF": "STATE", "STATIC": "ATTRIBUTE", "PLANNING": "INTENTION"}
ALL_TYPES = ["OCCURRENCE", "STATE", "ATTRIBUTE", "INTENTION"]
MARITAL_WORDS = r"(?i)\b(married|single|divorced|engaged)\b"
SESSION_CUE = (
    r"(?i)\b(tell|told|telling|mention(?:ed|ing)?|said|say|saying|bring\s+up|brought\s+up|"
    r"discuss(?:ed|ing)?|talk(?:ed|ing)?|chat(?:ted|ting)?|share(?:d)?\s+with\s+you|let\s+(?:you|me)\s+know|"
    r"ask(?:ed)?\s+(?:you|me))\b"
    r"|\b(?:in|during|from)\s+(?:our|the|that|last|previous|earlier|prior|recent)\s+"
    r"(?:conversation|chat|session|dialogue|talk|exchange)s?\b"
    r"|\bwe\s+(?:spoke|talked|discussed|chatted)\b"
    r"|\blast\s+time\s+(?:we|you|i)\b"
)
EVENT_CUE = (
    r"(?i)\b(happen(?:ed)?|occur(?:red)?|took\s+place|went|visit(?:ed)?|meet|met|start(?:ed)?|finish(?:ed)?|end(?:ed)?|"
    r"begin|began|graduat(?:ed|ing|e)|mov(?:ed|ing|e)|marr(?:ied|y|ying)|divorc(?:ed|ing|e)|work(?:ed)?|liv(?:ed|ing|e)|"
    r"travel(?:ed|ing|led|ling)?|buy|bought|sell|sold|join(?:ed)?|leave|left|retire(?:d)?|born|die(?:d)?)\b"
)
AXIS_SYNONYMS = {
    "EVENT": "EVENT", "SESSION": "SESSION", "BOTH_UNION": "BOTH_UNION", "BOTH_INTERSECT": "BOTH_INTERSECT", "NONE": "NONE",
    "BOTH": "BOTH_UNION", "UNION": "BOTH_UNION", "ANY": "BOTH_UNION",
    "INTERSECT": "BOTH_INTERSECT", "INTERSECTION": "BOTH_INTERSECT", "BOTH_AND": "BOTH_INTERSECT",
    "CHAT": "SESSION", "CONVERSATION": "SESSION", "DIALOGUE": "SESSION",
    "REAL": "EVENT", "LIFE": "EVENT", "WORLD": "EVENT",
}
FUZZY_DAYS = ((300, 90), (25, 20), (-1, 7))
FUZZY_DAYS_OLD = ((300, 60), (25, 10), (-1, 3))
EDGE_PUNCTUATION = " ?.,;:"
# -----------------------------------------------------------------------------------------


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def intent_of(text: Column, phrases_by_intent: dict[str, list[str]] = INTENT_PHRASES) -> Column:
    """First intent, in list order, one of whose phrases occurs."""

    def first(low: Column) -> Column:
        expr = F.lit("MISC")
        for name, phrases in reversed(list(phrases_by_intent.items())):
            hit = low.contains(phrases[0])
            for phrase in phrases[1:]:
                hit = hit | low.contains(phrase)
            expr = F.when(hit, F.lit(name)).otherwise(expr)
        return expr

    return let(F.lower(text), first)


def promoted_intent(intent: Column, text: Column) -> Column:
    """MISC becomes AS_OF for "was I ... married/single/divorced/engaged"."""
    strong = text.rlike(r"(?i)\bwas i\b") & text.rlike(MARITAL_WORDS)
    return F.when((intent == "MISC") & strong, F.lit("AS_OF")).otherwise(intent)


def target_types(intent: Column) -> Column:
    expr = F.array(*[F.lit(t) for t in ALL_TYPES])
    for name, kind in TARGET_TYPES.items():
        expr = F.when(intent == name, F.array(F.lit(kind))).otherwise(expr)
    return expr


def inferred_axis(text: Column, kind: Column) -> Column:
    happened = text.rlike(EVENT_CUE)
    return (
        F.when(F.coalesce(kind, F.lit("NONE")).isin("", "NONE"), "NONE")
        .when(text.rlike(SESSION_CUE), F.when(happened, "BOTH_UNION").otherwise("SESSION")).when(happened, "EVENT").otherwise("BOTH_UNION")
    )


def normal_axis(value: Column, fallback: Column) -> Column:
    names = F.create_map(*[x for k, v in AXIS_SYNONYMS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(names, F.upper(F.trim(value))), fallback)


def fuzzy_buffer(start: Column, end: Column, fuzzy: Column, steps=FUZZY_DAYS) -> tuple[Column, Column]:
    """Widen both ends of a fuzzy, fully bounded constraint by its span."""
    span = F.datediff(end, start)
    days = F.lit(0)
    for over, pad in reversed(steps):
        days = F.when(span > over, pad).otherwise(days) if over >= 0 else F.lit(pad)
    days = F.when(fuzzy & start.isNotNull() & end.isNotNull(), days).otherwise(0)
    return F.date_sub(start, days), F.date_add(end, days)


def rewrite_by_span(text: Column, pos: Column, length: Column) -> Column:
    """Cut the matched text (1-based ``pos``), tidy the seam; empty -> original."""
    cut = F.concat(F.substring(text, F.lit(1), pos - 1), F.lit(" "), F.substring(text, pos + length, F.length(text)))
    tidy = F.regexp_replace(F.regexp_replace(cut, r"\s+", " "), r"(?i)\s(?:of|in|on|at|during)\s(?=[?.!,]|$)", "")
    return let(F.btrim(tidy, F.lit(EDGE_PUNCTUATION)), lambda t: F.when(t == "", text).otherwise(t))


def clause_from_keyword(text: Column) -> Column:
    """From the first when/before/after/while/during to the end of the line."""
    clause = F.regexp_substr(text, F.lit(r"(?i)\b(?:when|before|after|while|during)\b.*"))
    return F.nullif(F.btrim(F.trim(clause), F.lit(EDGE_PUNCTUATION)), F.lit(""))


def remove_clause(text: Column, clause: Column) -> Column:
    """Delete a literal clause, ignoring case; empty result -> original."""
    quoted = F.concat(F.lit(r"(?i)\Q"), clause, F.lit(r"\E"))
    out = F.btrim(F.trim(F.regexp_replace(F.regexp_replace(text, quoted, F.lit("")), r"\s+", " ")), F.lit(EDGE_PUNCTUATION))
    return F.when(clause.isNull() | (clause == "") | (out == ""), text).otherwise(out)


def with_time_match(
    df: DataFrame, text_col: str, base_col: str, out: str, opts: Options = Options(), matchers: Sequence[Matcher] | None = None
) -> DataFrame:
    """Add ``out``: the winning match on ``text_col``, anchors included, or null.

    Fields: start, end, kind, boundary, is_fuzzy, match_text, pos, anchor_event,
    anchor_relation.
    """
    text, base = F.col(text_col), F.col(base_col)
    at = F.regexp_instr(text, F.lit(ANCHOR))
    head = F.regexp_substr(text, F.lit(ANCHOR))
    tail = F.substring(text, at + F.length(head), F.length(text))
    clause = F.rtrim(
        F.concat(head, F.regexp_extract(tail, rf"(?is)^(.*?)(?:{CLAUSE_STOP}|\z)", 1)), F.lit(EDGE_PUNCTUATION + "\t\n\r")
    )
    keyword = F.lower(group(text, ANCHOR, 1))
    names = F.create_map(*[x for k, v in ANCHOR_RELATIONS.items() for x in (F.lit(k), F.lit(v))])
    staged = df.withColumn(
        "_a",
        F.when(
            holds(F.lower(text), ANCHOR_RELATIONS) & text.rlike(ANCHOR),
            F.struct(at.cast("int").alias("pos"), clause.alias("clause"), keyword.alias("kw"), F.try_element_at(names, keyword).alias("rel")),
        ),
    )
    body = F.regexp_replace(F.col("_a.clause"), r"^\w+\s*", "")
    after_clause = F.substring(text, F.col("_a.pos") + F.length("_a.clause"), F.length(text))
    year = group(after_clause, rf"^,\s*({YEAR})", 1)
    staged = staged.withColumn("_body", body).withColumn("_longer", F.when(year.isNotNull(), F.concat(body, F.lit(", "), year)))
    # one copy of the matcher tree, tried on each text
    staged = staged.withColumn(
        "_m", F.transform(F.array(text, F.col("_body"), F.col("_longer")), lambda t: first_match(t, base, opts, matchers))
    )
    plain, in_body, in_longer = (F.get("_m", F.lit(i)) for i in range(3))
    month_day = dt.ymd(F.year(base), dt.month_number(group(F.col("_body"), MONTH_DAY, 1)), group(F.col("_body"), MONTH_DAY, 2))
    day_month = dt.ymd(F.year(base), dt.month_number(group(F.col("_body"), DAY_MONTH, 2)), group(F.col("_body"), DAY_MONTH, 1))
    yearless = F.coalesce(month_day, day_month)
    bare = F.when(
        yearless.isNotNull(), F.struct(yearless.alias("start"), yearless.alias("end"), F.lit("ABSOLUTE").alias("kind"), F.lit("POINT").alias("boundary"))
    )
    pick = lambda m: F.when(
        m.isNotNull(), F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"), m["boundary"].alias("boundary"))
    )
    staged = staged.withColumn("_inner", F.coalesce(pick(in_body), pick(in_longer), bare)).withColumn("_plain", plain)

    inner, rel, none = F.col("_inner"), F.col("_a.rel"), F.lit(None).cast("date")
    start = (
        F.when(rel == "AFTER", F.date_add(F.coalesce(inner["end"], inner["start"]), 1)).when(rel == "BEFORE", none).otherwise(inner["start"])
    )
    end = (
        F.when(rel == "BEFORE", F.date_sub(F.coalesce(inner["start"], inner["end"]), 1)).when(rel == "AFTER", none).otherwise(inner["end"])
    )
    boundary = F.when(rel.isin("AFTER", "BEFORE"), rel).otherwise(inner["boundary"])

    def anchored(s, e, kind, bound) -> Column:
        return F.struct(
            s.alias("start"), e.alias("end"), kind.alias("kind"), bound.alias("boundary"), F.lit(False).alias("is_fuzzy"),
            F.col("_a.clause").alias("match_text"), F.col("_a.pos").alias("pos"), F.col("_body").alias("anchor_event"), rel.alias("anchor_relation"),
        )

    p, no_text = F.col("_plain"), F.lit(None).cast("string")
    direct = F.struct(
        p["start"].alias("start"), p["end"].alias("end"), p["kind"].alias("kind"), p["boundary"].alias("boundary"),
        p["is_fuzzy"].alias("is_fuzzy"), p["match_text"].alias("match_text"), p["pos"].alias("pos"),
        no_text.alias("anchor_event"), no_text.alias("anchor_relation"),
    )
    return staged.withColumn(
        out,
        F.when(F.col("_a").isNotNull() & inner.isNotNull(), anchored(start, end, inner["kind"], boundary))
        .when(p.isNotNull(), direct)
        .when(F.col("_a").isNotNull(), anchored(none, none, F.lit("NONE"), F.lit("ANCHOR"))),
    ).drop("_a", "_body", "_longer", "_m", "_inner", "_plain")


def annotate(
    questions: DataFrame,
    question_col: str = "question",
    base_col: str = "base_day",
    opts: Options = Options(),
    matchers: Sequence[Matcher] | None = None,
    supplied: bool = False,
    dedupe: bool = False,
) -> DataFrame:
    """Add ``tc``, ``intent``, ``target_types``, ``time_axis``, ``use_time``,
    ``rewritten_query`` and ``parse_source`` to every question.

    ``base_col`` is the reference day; a null base is the caller's business (no
    wall clock).  ``supplied`` reads the optional outputs of an external parser
    (``s_intent``, ``s_time_text``, ``s_time_kind``, ``s_axis``, ``s_rewritten``)
    for questions that the phrases do not settle.  ``dedupe`` annotates each
    distinct (day, trimmed lower-case question) once and joins back.
    """
    if dedupe:
        keyed = questions.withColumn("_key", F.lower(_stripped(F.col(question_col))))
        once = keyed.groupBy(F.col(base_col).alias("_day"), "_key").agg(F.min(question_col).alias("_q"))
        done = annotate(once, "_q", "_day", opts, matchers)
        added = [c for c in done.columns if c not in once.columns]
        same = keyed[base_col].eqNullSafe(done["_day"]) & (keyed["_key"] == done["_key"])
        return keyed.join(done, same, "left").select(*[keyed[c] for c in questions.columns], *[done[c] for c in added])

    df = questions.withColumn("_text", _stripped(F.col(question_col)))
    df = with_time_match(df, "_text", base_col, "_tm", opts, matchers)
    df = df.withColumn("_intent", intent_of(F.col("_text")))
    settled = (F.col("_text") != "") & (F.col("_tm").isNotNull() | F.col("_intent").isin("STATIC", "PLANNING"))
    df = df.withColumn("parse_source", F.when(settled, "FAST").otherwise("FALLBACK"))
    hint = F.lit(None).cast("string")
    if supplied:
        df = _with_supplied(df, base_col, opts, matchers)
        hint = F.when(F.col("parse_source") == "SUPPLIED", F.col("s_axis"))
    tm, text, source = F.col("_tm"), F.col("_text"), F.col("parse_source")

    intent = F.when(source == "FALLBACK", "MISC").otherwise(promoted_intent(F.col("_intent"), text))
    start, end = fuzzy_buffer(tm["start"], tm["end"], tm["is_fuzzy"])
    tc_type = F.coalesce(tm["boundary"], F.lit("NONE"))
    kind = F.coalesce(tm["kind"], F.lit("NONE"))
    axis = F.when(tc_type == "NONE", "NONE").otherwise(normal_axis(hint, inferred_axis(text, kind)))
    rewritten = F.when(tm.isNotNull(), rewrite_by_span(text, tm["pos"], F.length(tm["match_text"]))).otherwise(text)
    if supplied:
        own = F.col("s_rewritten")
        given = F.when(own.isNotNull() & (F.trim(own) != text), own).otherwise(
            F.when(F.col("_whole"), rewritten).otherwise(remove_clause(text, F.col("s_time_text")))
        )
        rewritten = F.when(source == "SUPPLIED", F.coalesce(given, text)).otherwise(rewritten)
    tc = F.struct(
        start.alias("start"), end.alias("end"), tc_type.alias("type"), tm["anchor_event"].alias("anchor_event"),
        tm["anchor_relation"].alias("anchor_relation"), F.coalesce(tm["is_fuzzy"], F.lit(False)).alias("is_fuzzy"),
        tm["match_text"].alias("raw_text"),
    )
    out = df.withColumns({"intent": intent, "tc": tc, "time_axis": axis, "rewritten_query": rewritten})
    use = ~F.col("intent").isin("PLANNING", "STATIC") & F.col("tc.type").isin("RANGE", "POINT", "AFTER", "BEFORE", "ANCHOR")
    out = out.withColumn("target_types", target_types(F.col("intent"))).withColumn("use_time", use)
    return out.drop("_text", "_tm", "_intent", "_whole", "_st")


def _with_supplied(df: DataFrame, base_col: str, opts: Options, matchers) -> DataFrame:
    """Let an external parser's columns settle what the phrases left open."""
    df = with_time_match(df, "s_time_text", base_col, "_st", opts, matchers)
    take = (F.col("parse_source") == "FALLBACK") & F.coalesce("s_intent", "s_time_text", "s_rewritten").isNotNull()
    # the phrase was found inside the supplied text: its span does not apply to the question
    inside = F.col("_st").isNotNull()
    return (
        df.withColumn("_whole", ~(take & inside))
        .withColumn("_intent", F.when(take, F.upper(F.coalesce("s_intent", F.lit("MISC")))).otherwise(F.col("_intent")))
        .withColumn("_tm", F.when(take, F.col("_st")).otherwise(F.col("_tm")))
        .withColumn("parse_source", F.when(take, "SUPPLIED").otherwise(F.col("parse_source")))
    )


# ---- standalone relative expressions ------------------------------------------------------

# Expressions resolved on their own.
SAME_DAY = ("today", "this morning", "this afternoon", "this evening", "tonight")
WEEKDAY_NAMES = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def resolve_expression(observed: Column, expression: Column) -> Column:
    """(observation text, expression) -> struct(start_date, end_date, day_of_week,
    resolved, unresolved).  ``last week`` is the trailing seven days."""
    day = F.substring(observed, 1, 10).try_cast("date")
    e = F.lower(F.trim(expression))
    month = F.add_months(F.trunc(day, "month").cast("date"), -1)
    year = dt.year_range(F.year(day) - 1)
    starts = [
        (e == "yesterday", F.date_sub(day, 1), F.date_sub(day, 1)),
        (e.isin(*SAME_DAY), day, day),
    ]
    for number, name in enumerate(WEEKDAY_NAMES):
        back = F.pmod(F.weekday(day) - number, F.lit(7))
        back = F.when(back == 0, 7).otherwise(back)
        starts.append((e.contains(f"last {name}"), F.date_sub(day, back), F.date_sub(day, back)))
    starts += [
        (e == "last week", F.date_sub(day, 7), day),
        (e == "last month", month, F.last_day(month)),
        (e == "last year", *year),
    ]
    start = end = day
    known = F.lit(False)
    for cond, s, t in reversed(starts):
        start, end, known = F.when(cond, s).otherwise(start), F.when(cond, t).otherwise(end), cond | known
    span = F.when(start == end, start.cast("string")).otherwise(F.concat_ws(" to ", start.cast("string"), end.cast("string")))
    return F.struct(
        start.alias("start_date"), end.alias("end_date"), F.date_format(day, "EEEE").alias("day_of_week"),
        F.concat(expression, F.lit(" ("), span, F.lit(")")).alias("resolved"), (~known).alias("unresolved"),
    )
