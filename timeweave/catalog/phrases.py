"""Time phrases built from order dates and read back by the annotator.

Each case is (question text in Spark SQL, expected start, end and type in check
SQL).  The check never parses text: it derives the expected dates by arithmetic
from the order date, so it is independent of the patterns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.catalog.registry import query, table
from timeweave.functions.time_phrases import Options
from timeweave.plans.annotate import (
    annotate,
    clause_from_keyword,
    fuzzy_buffer,
    intent_of,
    normal_axis,
    promoted_intent,
    remove_clause,
    resolve_expression,
)

BASE = "2001-12-31"


def _orders(spark, d, own_base: bool):
    o = table(spark, d, "orders", spread=True).select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    base = F.col("day") if own_base else F.lit(BASE).cast("date")
    return o.withColumn("base_day", base).withColumn("n", (F.col("o_orderkey") % 7 + 2).cast("int"))


def _case(cases, pick, dialect_null="NULL"):
    arms = " ".join(f"WHEN {i} THEN {pick(c)}" for i, c in enumerate(cases))
    return f"CASE o_orderkey % {len(cases)} {arms} END"


def _sql(cases, own_base):
    base = "day" if own_base else f"DATE '{BASE}'"
    src = (
        f"SELECT *, {base} AS base_day, CAST(o_orderkey % 7 + 2 AS INTEGER) AS n FROM "
        "(SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders)"
    )
    return (
        f"SELECT o_orderkey, CAST({_case(cases, lambda c: c[1])} AS DATE) AS tc_start, CAST({_case(cases, lambda c: c[2])} AS DATE) AS tc_end, "
        f"{_case(cases, lambda c: c[3])} AS tc_type FROM ({src})"
    )


def phrase_query(name, cases, own_base=False, opts=Options()):
    """Register one family of phrases over all orders."""

    def run(spark, d):
        q = _orders(spark, d, own_base).withColumn("question", F.expr(_case(cases, lambda c: c[0])))
        out = annotate(q, opts=opts)
        return out.select("o_orderkey", F.col("tc.start").alias("tc_start"), F.col("tc.end").alias("tc_end"), F.col("tc.type").alias("tc_type"))

    query(name, _sql(cases, own_base))(run)


def ask(phrase: str) -> str:
    return f"concat('What did customer ', o_custkey, ' order ', {phrase}, '?')"


MDY = "date_format(day, 'MMMM d, yyyy')"
DMY = "date_format(day, 'd MMM yyyy')"
ISO = "date_format(day, 'yyyy-MM-dd')"
YEAR = "date_format(day, 'yyyy')"
M1 = "CAST(date_trunc('month', day) AS DATE)"
EOM = "last_day(day)"
Y1, Y2 = "make_date(year(day), 1, 1)", "make_date(year(day), 12, 31)"


def months(day, n):
    return f"CAST({day} + to_months(CAST({n} AS INTEGER)) AS DATE)"


def week(day):
    return f"CAST(date_trunc('week', {day}) AS DATE)"


phrase_query(
    "t01_t02_anchor_clauses",
    [
        (f"concat('What happened after I moved on ', {MDY}, ' to town?')", "day + 1", "NULL", "'AFTER'"),
        (f"concat('Was it before my trip on ', {DMY}, '?')", "NULL", "day - 1", "'BEFORE'"),
        (f"concat('What did we do during the week of ', {ISO}, '?')", "day", "day", "'POINT'"),
        ("concat('Was I married when I lived in town ', o_custkey, '?')", "NULL", "NULL", "'ANCHOR'"),
        ("concat('Who called while we met in ', date_format(day, 'MMMM yyyy'), ', and did it help?')", M1, EOM, "'RANGE'"),
        (
            "concat('What changed since she left on ', date_format(day, 'MMMM d'), '?')",
            f"TRY_CAST('{BASE[:4]}' || strftime(day, '-%m-%d') AS DATE) + 1",
            "NULL",
            "CASE WHEN strftime(day, '%m-%d') = '02-29' THEN 'ANCHOR' ELSE 'AFTER' END",
        ),
        ("concat('What did I say after the party, was it on ', date_format(day, 'yyyy/MM/dd'), '?')", "day", "day", "'POINT'"),
    ],
)
phrase_query(
    "t03_t10_bounded_dates",
    [
        (ask(f"concat('from ', {ISO}, ' through ', date_format(date_add(day, 40), 'MMMM yyyy'))"), "day", "last_day(day + 40)", "'RANGE'"),
        (ask(f"concat('between ', {YEAR}, ' and ', year(day) + 1)"), Y1, "make_date(year(day) + 1, 12, 31)", "'RANGE'"),
        (ask(f"concat('as of ', {MDY})"), "day", "day", "'POINT'"),
        (ask("concat('as at ', date_format(day, 'MMMM yyyy'))"), M1, EOM, "'RANGE'"),
        (ask("concat('by ', date_format(day, 'yyyy.MM.dd'))"), "NULL", "day", "'BEFORE'"),
        (ask("concat('up until ', date_format(day, 'yyyy-MM'))"), "NULL", EOM, "'BEFORE'"),
        (ask(f"concat('till ', {DMY})"), "NULL", "day", "'BEFORE'"),
        (ask(f"concat('following ', {YEAR})"), "make_date(year(day) + 1, 1, 1)", "NULL", "'AFTER'"),
        (ask(f"concat('after ', {MDY})"), "day + 1", "NULL", "'AFTER'"),
        (ask("concat('prior to ', date_format(day, 'MMM yyyy'))"), "NULL", f"{M1} - 1", "'BEFORE'"),
        (ask(f"concat('before ', {ISO})"), "NULL", "day - 1", "'BEFORE'"),
        (ask(f"concat('starting from ', {ISO})"), "day", "NULL", "'AFTER'"),
        (ask(f"concat('since ', {YEAR})"), Y1, "NULL", "'AFTER'"),
    ],
)
phrase_query(
    "t11_t15_written_days",
    [
        (ask(f"concat('on ', {MDY})"), "day", "day", "'POINT'"),
        (ask("concat('on ', date_format(day, 'MMM'), '. ', day(day), 'th ', year(day))"), "day", "day", "'POINT'"),
        (ask("concat('on the ', day(day), 'rd of ', date_format(day, 'MMMM,yyyy'))"), "day", "day", "'POINT'"),
        (ask(f"concat('on ', {ISO})"), "day", "day", "'POINT'"),
        (ask("concat('on ', date_format(day, 'yyyy/M/d'))"), "day", "day", "'POINT'"),
        (ask("concat('on ', date_format(day, 'M/d/yyyy'))"), "day", "day", "'POINT'"),
        (
            ask("concat('on ', date_format(day, 'd-M-yyyy'))"),
            "CASE WHEN day(day) > 12 THEN day ELSE make_date(year(day), day(day), month(day)) END",
            "CASE WHEN day(day) > 12 THEN day ELSE make_date(year(day), day(day), month(day)) END",
            "'POINT'",
        ),
        (ask(f"concat('on ', {YEAR}, '-02-30 or ', {YEAR}, '/13/01 ')"), "NULL", "NULL", "'NONE'"),
    ],
)
phrase_query(
    "t16_t22_periods",
    [
        (
            ask("concat('in Q', quarter(day), ' ', year(day))"),
            "CAST(date_trunc('quarter', day) AS DATE)",
            "last_day(CAST(date_trunc('quarter', day) + INTERVAL 2 MONTH AS DATE))",
            "'RANGE'",
        ),
        (ask(f"concat('in the first half of ', {YEAR})"), Y1, "make_date(year(day), 6, 30)", "'RANGE'"),
        (ask(f"concat('in H2 ', {YEAR})"), "make_date(year(day), 7, 1)", Y2, "'RANGE'"),
        (ask(f"concat('in early ', {YEAR})"), Y1, "make_date(year(day), 4, 30)", "'RANGE'"),
        (ask(f"concat('mid ', {YEAR})"), "make_date(year(day), 5, 1)", "make_date(year(day), 8, 31)", "'RANGE'"),
        (ask(f"concat('late ', {YEAR})"), "make_date(year(day), 9, 1)", Y2, "'RANGE'"),
        (ask(f"concat('at the start of ', {YEAR})"), Y1, "make_date(year(day), 2, 28)", "'RANGE'"),
        (ask(f"concat('at the end of ', {YEAR})"), "make_date(year(day), 11, 1)", Y2, "'RANGE'"),
        (ask(f"concat('in autumn ', {YEAR})"), "make_date(year(day), 9, 1)", "make_date(year(day), 11, 30)", "'RANGE'"),
        (ask(f"concat('in winter ', {YEAR})"), "make_date(year(day), 12, 1)", "last_day(make_date(year(day) + 1, 2, 1))", "'RANGE'"),
        (
            ask("concat('in the ', year(day) div 10, '0s')"),
            "make_date(year(day) // 10 * 10, 1, 1)",
            "make_date(year(day) // 10 * 10 + 9, 12, 31)",
            "'RANGE'",
        ),
        (ask("concat('in ', date_format(day, 'MMMM yyyy'))"), M1, EOM, "'RANGE'"),
    ],
)
phrase_query(
    "t23_t24_t33_month_and_year",
    [
        (ask("concat('in ', date_format(day, 'MMMM'))"), "make_date(2001, month(day), 1)", "last_day(make_date(2001, month(day), 1))", "'RANGE'"),
        (ask("concat('by invoice ', date_format(day, 'yyyy-MM'), ' sent')"), M1, EOM, "'RANGE'"),
        (ask(f"concat('in ', {YEAR})"), Y1, Y2, "'RANGE'"),
        (ask(f"concat('back in ', {YEAR})"), Y1, Y2, "'RANGE'"),
        (ask(f"concat('model ', {YEAR})"), "NULL", "NULL", "'NONE'"),
    ],
)
QUARTER_BACK = "CAST(date_trunc('quarter', day) - to_months(CAST(3 * {n} AS INTEGER)) AS DATE)"
phrase_query(
    "t25_t26_quarters_and_ago",
    [
        (ask("'last quarter'"), QUARTER_BACK.format(n=1), "CAST(date_trunc('quarter', day) AS DATE) - 1", "'RANGE'"),
        (
            ask("'next quarter'"),
            QUARTER_BACK.format(n=-1),
            "CAST(date_trunc('quarter', day) + INTERVAL 6 MONTH AS DATE) - 1",
            "'RANGE'",
        ),
        (ask("concat(n, ' days ago')"), "day - n", "day - n", "'POINT'"),
        (ask("concat(n, ' weeks ago')"), week("day - 7 * n"), f"{week('day - 7 * n')} + 6", "'RANGE'"),
        (ask("concat(n, ' months ago')"), months(M1, "-n"), f"last_day({months(M1, '-n')})", "'RANGE'"),
        (ask("'a year ago'"), "make_date(year(day) - 1, 1, 1)", "make_date(year(day) - 1, 12, 31)", "'RANGE'"),
        (ask("concat(n, ' quarters ago')"), QUARTER_BACK.format(n="n"), f"CAST({QUARTER_BACK.format(n='n')} + INTERVAL 3 MONTH AS DATE) - 1", "'RANGE'"),
        (ask("'twelve months ago'"), months(M1, "-12"), f"last_day({months(M1, '-12')})", "'RANGE'"),
    ],
    own_base=True,
)
phrase_query(
    "t26_relaxed_months",
    [
        (ask("concat(n, ' months ago')"), months(M1, "-(n + 3)"), f"last_day({months(M1, '-(n - 1)')})", "'RANGE'"),
        (ask("concat('in the last ', n, ' months')"), months(M1, "-(n + 3)"), "day", "'RANGE'"),
    ],
    own_base=True,
    opts=Options(relaxed_months=True),
)
phrase_query(
    "t27_last_n_units",
    [
        (ask("concat('in the last ', n, ' days')"), "day - (n - 1)", "day", "'RANGE'"),
        (ask("'in the past few days'"), "day - 2 - 7", "day + 7", "'RANGE'"),
        (ask("concat('in the previous ', n, ' weeks')"), "day - 7 * n", "day", "'RANGE'"),
        (ask("concat('in the last ', n, ' months')"), months(M1, "-n + 1"), "day", "'RANGE'"),
        (ask("'over the past three years'"), "make_date(year(day) - 2, 1, 1)", "day", "'RANGE'"),
        (ask("concat('over the last ', n, ' quarters')"), "day - 90 * n", "day", "'RANGE'"),
    ],
    own_base=True,
)
SATURDAY = "(day + CAST((5 - (isodow(day) - 1) + 7) % 7 AS INTEGER))"
phrase_query(
    "t28_t29_relative_spans",
    [
        (ask("'last week'"), week("day - 7"), f"{week('day - 7')} + 6", "'RANGE'"),
        (ask("'next week'"), week("day + 7"), f"{week('day + 7')} + 6", "'RANGE'"),
        (ask("'this month'"), M1, EOM, "'RANGE'"),
        (ask("'previous month'"), months(M1, -1), f"{M1} - 1", "'RANGE'"),
        (ask("'next year'"), "make_date(year(day) + 1, 1, 1)", "make_date(year(day) + 1, 12, 31)", "'RANGE'"),
        (ask("'this weekend'"), f"CAST({SATURDAY} AS DATE)", f"CAST({SATURDAY} AS DATE) + 1", "'RANGE'"),
        (ask("'past weekend'"), f"CAST({SATURDAY} AS DATE) - 7", f"CAST({SATURDAY} AS DATE) - 6", "'RANGE'"),
        (
            ask("concat('last ', date_format(date_add(day, n), 'EEEE'))"),
            "day + CAST(n % 7 AS INTEGER) - 7", "day + CAST(n % 7 AS INTEGER) - 7", "'POINT'",
        ),
        (
            ask("concat('next ', date_format(date_add(day, n), 'EEE'))"),
            "day + CAST(CASE WHEN n % 7 = 0 THEN 7 ELSE n % 7 END AS INTEGER)", "day + CAST(CASE WHEN n % 7 = 0 THEN 7 ELSE n % 7 END AS INTEGER)", "'POINT'",
        ),
        (ask("concat('this ', date_format(date_add(day, n), 'EEEE'))"), "day + CAST(n % 7 AS INTEGER)", "day + CAST(n % 7 AS INTEGER)", "'POINT'"),
    ],
    own_base=True,
)
phrase_query(
    "t30_t32_near_days",
    [
        (ask("'this morning'"), "day", "day", "'POINT'"),
        (ask("'tonight'"), "day", "day", "'POINT'"),
        (ask("'yesterday'"), "day - 1", "day - 1", "'POINT'"),
        (ask("'today'"), "day", "day", "'POINT'"),
        (ask("'tomorrow'"), "day + 1", "day + 1", "'POINT'"),
        (ask("'recently'"), "day - 200", "day + 20", "'RANGE'"),
        (ask("'lately'"), "day - 200", "day + 20", "'RANGE'"),
    ],
    own_base=True,
)
phrase_query(
    "t35_fuzzy_phrases",
    [
        (ask(f"concat('around ', {YEAR})"), f"{Y1} - 90", f"{Y2} + 90", "'RANGE'"),
        (ask(f"concat('circa ', {YEAR})"), f"{Y1} - 90", f"{Y2} + 90", "'RANGE'"),
        (ask("concat('in ', date_format(day, 'MMMM'))"), "make_date(year(day), month(day), 1) - 20", f"{EOM} + 20", "'RANGE'"),
        (ask("'yesterday'"), "day - 8", "day + 6", "'POINT'"),
        (ask(f"concat('on ', {ISO})"), "day", "day", "'POINT'"),
    ],
    own_base=True,
    opts=Options(fuzzy_relative=True),
)

# ---- the annotation as a whole -----------------------------------------------------------

KINDS = [  # question, intent, axis, rewritten, use_time, source
    ("concat('What did customer ', o_custkey, ' order in July 1997?')", "'WINDOW'", "'BOTH_UNION'", "concat('What did customer ', o_custkey, ' order')", "TRUE", "'FAST'"),
    ("concat('When did I tell you about order ', o_orderkey, ' in 1997?')", "'WINDOW'", "'SESSION'", "concat('When did I tell you about order ', o_orderkey)", "TRUE", "'FAST'"),
    ("concat('What happened to order ', o_orderkey, ' last month?')", "'WINDOW'", "'EVENT'", "concat('What happened to order ', o_orderkey)", "TRUE", "'FAST'"),
    ("concat('I mentioned that I visited shop ', o_custkey, ' yesterday.')", "'MISC'", "'BOTH_UNION'", "concat('I mentioned that I visited shop ', o_custkey)", "TRUE", "'FAST'"),
    ("concat('What is my customer number ', o_custkey, '?')", "'STATIC'", "'NONE'", "concat('What is my customer number ', o_custkey, '?')", "FALSE", "'FAST'"),
    ("concat('Which parts could customer ', o_custkey, ' order next week?')", "'PLANNING'", "'BOTH_UNION'", "concat('Which parts could customer ', o_custkey, ' order')", "FALSE", "'FAST'"),
    ("concat('Was I married to ', o_custkey, ' as of 2 May 1998?')", "'AS_OF'", "'EVENT'", "concat('Was I married to ', o_custkey)", "TRUE", "'FAST'"),
    ("concat('What happened after I graduated with ', o_custkey, '?')", "'WINDOW'", "'NONE'", "'What happened'", "TRUE", "'FAST'"),
    ("concat('Tell me more on ', o_custkey, '.')", "'MISC'", "'NONE'", "concat('Tell me more on ', o_custkey, '.')", "FALSE", "'FALLBACK'"),
]


def _kinds(spark, d):
    return _orders(spark, d, False).withColumn("question", F.expr(_case(KINDS, lambda c: c[0])))


@query(
    "t37_t44_directives",
    "SELECT o_orderkey, " + ", ".join(
        f"{_case(KINDS, lambda c, i=i: c[i])} AS {name}"
        for i, name in ((1, "intent"), (2, "time_axis"), (3, "rewritten_query"), (4, "use_time"), (5, "parse_source"))
    ) + f""", {_case(KINDS, lambda c: {"'WINDOW'": "'OCCURRENCE'", "'AS_OF'": "'STATE'", "'STATIC'": "'ATTRIBUTE'", "'PLANNING'": "'INTENTION'"}.get(c[1], "'OCCURRENCE,STATE,ATTRIBUTE,INTENTION'"))} AS target_types
    FROM orders""",
)
def t37(spark, d):
    return annotate(_kinds(spark, d)).select(
        "o_orderkey", "intent", "time_axis", "rewritten_query", "use_time", "parse_source",
        F.array_join("target_types", ",").alias("target_types"),
    )


@query(
    "t45_annotate_once",
    """WITH q AS (SELECT 'What did nation ' || c_nationkey || ' buy in ' || (1995 + c_custkey % 5) || '?' AS question, c_custkey, 1995 + c_custkey % 5 AS y FROM customer)
       SELECT c_custkey, make_date(CAST(y AS INTEGER), 1, 1) AS tc_start, make_date(CAST(y AS INTEGER), 12, 31) AS tc_end, 'WINDOW' AS intent FROM q""",
)
def t45(spark, d):
    text = F.concat(F.lit("What did nation "), "c_nationkey", F.lit(" buy in "), F.col("c_custkey") % 5 + 1995, F.lit("?"))
    shout = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.upper(text), F.lit("  "))).otherwise(text)
    q = table(spark, d, "customer").select("c_custkey", shout.alias("question"), F.lit(BASE).cast("date").alias("base_day"))
    out = annotate(q, dedupe=True)
    return out.select("c_custkey", F.col("tc.start").alias("tc_start"), F.col("tc.end").alias("tc_end"), "intent")


@query(
    "t36_fuzzy_buffer",
    """WITH iv AS (SELECT o_orderkey, day, day + CAST(o_orderkey % 400 AS INTEGER) AS e, o_orderkey % 2 = 0 AS f FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)),
       p AS (SELECT *, CASE WHEN NOT f THEN 0 WHEN e - day > 300 THEN 90 WHEN e - day > 25 THEN 20 ELSE 7 END AS pad FROM iv)
       SELECT o_orderkey, day - CAST(pad AS INTEGER) AS b_start, e + CAST(pad AS INTEGER) AS b_end FROM p""",
)
def t36(spark, d):
    o = _orders(spark, d, True).withColumn("e", F.date_add("day", (F.col("o_orderkey") % 400).cast("int")))
    start, end = fuzzy_buffer(F.col("day"), F.col("e"), F.col("o_orderkey") % 2 == 0)
    return o.select("o_orderkey", start.alias("b_start"), end.alias("b_end"))


@query(
    "t38_intent_promotion",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'AS_OF' ELSE 'MISC' END AS promoted,
       CASE WHEN o_orderkey % 3 = 2 THEN 'MISC' ELSE 'AS_OF' END AS detected FROM orders""",
)
def t38(spark, d):
    tail = F.element_at(F.array(F.lit(" divorced from "), F.lit(" friends with "), F.lit(" hear about ")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    head = F.when(F.col("o_orderkey") % 3 == 2, "Did you").otherwise("Was I")
    text = F.concat(head, tail, F.col("o_custkey"))
    return table(spark, d, "orders").select(
        "o_orderkey", promoted_intent(F.lit("MISC"), text).alias("promoted"), intent_of(text).alias("detected")
    )


@query(
    "t41_axis_synonyms",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'SESSION' WHEN 'view' THEN 'BOTH_UNION' WHEN 'purchase' THEN 'BOTH_INTERSECT'
       WHEN 'error' THEN 'EVENT' ELSE 'BOTH_UNION' END AS axis FROM events""",
)
def t41(spark, d):
    t = F.col("event_type")
    word = F.when(t == "click", " chat ").when(t == "view", "Any").when(t == "purchase", "intersection").when(t == "error", "world")
    return table(spark, d, "events").select("event_id", normal_axis(word, F.lit("BOTH_UNION")).alias("axis"))


@query(
    "t48_clause_helpers",
    """SELECT o_orderkey, 'after visit ' || o_custkey || ' ended' AS clause, 'What did I buy' AS without_clause FROM orders""",
)
def t48(spark, d):
    text = F.concat(F.lit("What did I buy AFTER visit "), "o_custkey", F.lit(" ended?"))
    o = table(spark, d, "orders").withColumn("q", text).withColumn("clause", F.lower(clause_from_keyword(F.col("q"))))
    return o.select("o_orderkey", "clause", remove_clause(F.col("q"), F.col("clause")).alias("without_clause"))


@query(
    "t48_supplied_parse",
    """SELECT o_orderkey, 'WINDOW' AS intent, day AS tc_start, 'AFTER' AS tc_type, 'EVENT' AS time_axis, 'Who phoned customer ' || o_custkey AS rewritten_query
       FROM (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) + 1 AS day FROM orders)""",
)
def t48_supplied(spark, d):
    q = _orders(spark, d, False).select(
        "o_orderkey", "base_day",
        F.concat(F.lit("Who phoned customer "), "o_custkey", F.lit(" past that order?")).alias("question"),
        F.lit("window").alias("s_intent"),
        F.concat(F.lit("after "), F.date_format("day", "d MMMM yyyy")).alias("s_time_text"),
        F.lit("ABSOLUTE").alias("s_time_kind"), F.lit("life").alias("s_axis"),
        F.concat(F.lit("Who phoned customer "), "o_custkey").alias("s_rewritten"),
    )
    return annotate(q, supplied=True).select(
        "o_orderkey", "intent", F.col("tc.start").alias("tc_start"), F.col("tc.type").alias("tc_type"), "time_axis", "rewritten_query"
    )


@query(
    "t47_resolve_expressions",
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders),
       e AS (SELECT *, CASE o_orderkey % 8 WHEN 0 THEN day - 1 WHEN 1 THEN day WHEN 2 THEN day - CAST(((isodow(day) - 1 - 3 + 6) % 7) + 1 AS INTEGER)
           WHEN 3 THEN day - 7 WHEN 4 THEN CAST(date_trunc('month', day) - INTERVAL 1 MONTH AS DATE) WHEN 5 THEN make_date(year(day) - 1, 1, 1) ELSE day END AS s,
         CASE o_orderkey % 8 WHEN 0 THEN day - 1 WHEN 2 THEN day - CAST(((isodow(day) - 1 - 3 + 6) % 7) + 1 AS INTEGER)
           WHEN 4 THEN CAST(date_trunc('month', day) AS DATE) - 1 WHEN 5 THEN make_date(year(day) - 1, 12, 31) ELSE day END AS t FROM o)
       SELECT o_orderkey, s AS start_date, t AS end_date, dayname(day) AS day_of_week, o_orderkey % 8 = 7 AS unresolved FROM e""",
)
def t47(spark, d):
    words = ["yesterday", "Today", "last Thursday", "last week", "last month", "last year", "this morning", "someday"]
    e = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    r = resolve_expression(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), e)
    return table(spark, d, "orders").select("o_orderkey", r.alias("r")).select(
        "o_orderkey", "r.start_date", "r.end_date", "r.day_of_week", "r.unresolved"
    )
