"""Golden questions for the annotator and the standalone expression resolver."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from timeweave.functions.time_phrases import PHRASE_MATCHERS, Options
from timeweave.plans.annotate import annotate, resolve_expression

BASE = dt.date(2024, 3, 15)
D = dt.date
GOLDEN = [
    # question, start, end, type
    ("What happened after I graduated?", None, None, "ANCHOR"),
    ("What did I do in July 2023?", D(2023, 7, 1), D(2023, 7, 31), "RANGE"),
    ("What happened after January 6, 2026?", D(2026, 1, 7), None, "AFTER"),
    ("Was I ill before my trip on March 5, 2022?", None, D(2022, 3, 4), "BEFORE"),
    ("What changed since she left on February 30?", None, None, "ANCHOR"),
    ("What did we do while the party was on, yesterday", D(2024, 3, 14), D(2024, 3, 14), "POINT"),
    ("from 2020 to 2021-05 what happened", D(2020, 1, 1), D(2021, 5, 31), "RANGE"),
    ("between May 3, 2020 and 4 June 2021", D(2020, 5, 3), D(2021, 6, 4), "RANGE"),
    ("as of 2023/02/31 what", None, None, "NONE"),
    ("by 13/10/2023", None, D(2023, 10, 13), "BEFORE"),
    ("on 10/11/2023", D(2023, 10, 11), D(2023, 10, 11), "POINT"),
    ("on 31/31/2023", None, None, "NONE"),
    ("in June", D(2024, 6, 1), D(2024, 6, 30), "RANGE"),
    ("in the 1990s", D(1990, 1, 1), D(1999, 12, 31), "RANGE"),
    ("winter 2023", D(2023, 12, 1), D(2024, 2, 29), "RANGE"),
    ("start of 2024", D(2024, 1, 1), D(2024, 2, 28), "RANGE"),
    ("the latter half of 2022", D(2022, 7, 1), D(2022, 12, 31), "RANGE"),
    ("around 2023", D(2022, 10, 3), D(2024, 3, 30), "RANGE"),
    ("two weeks ago", D(2024, 2, 26), D(2024, 3, 3), "RANGE"),
    ("five quarters ago", D(2022, 10, 1), D(2022, 12, 31), "RANGE"),
    ("last Friday", D(2024, 3, 8), D(2024, 3, 8), "POINT"),
    ("next Friday", D(2024, 3, 22), D(2024, 3, 22), "POINT"),
    ("this weekend", D(2024, 3, 16), D(2024, 3, 17), "RANGE"),
    ("lately", D(2023, 8, 28), D(2024, 4, 4), "RANGE"),
    ("room 2024", None, None, "NONE"),
    ("999999999 weeks ago", None, None, "NONE"),
    ("12345 days ago", D(1990, 5, 28), D(1990, 5, 28), "POINT"),
    ("99999999999 days ago", None, None, "NONE"),
    ("20000 months ago", D(357, 7, 1), D(357, 7, 31), "RANGE"),
    ("", None, None, "NONE"),
]


def rows(df):
    return {r["question"]: r for r in df.collect()}


def test_golden_constraints(spark):
    df = spark.createDataFrame([(q, BASE) for q, *_ in GOLDEN], "question string, base_day date")
    got = rows(annotate(df))
    for question, start, end, kind in GOLDEN:
        tc = got[question]["tc"]
        assert (tc["start"], tc["end"], tc["type"]) == (start, end, kind), question


def test_rewrite_and_anchor_fields(spark):
    df = spark.createDataFrame([("What did Ann do on her latest project in July 2023?", BASE), ("Was I married when I lived in Paris?", BASE)], "question string, base_day date")
    got = rows(annotate(df))
    # the span covers the month and year only; the left-over "in" goes because nothing follows
    assert got["What did Ann do on her latest project in July 2023?"]["rewritten_query"] == "What did Ann do on her latest project"
    anchor = got["Was I married when I lived in Paris?"]
    assert anchor["tc"]["anchor_event"] == "I lived in Paris" and anchor["tc"]["anchor_relation"] == "DURING"
    assert anchor["rewritten_query"] == "Was I married" and anchor["use_time"]


def test_null_question_and_options(spark):
    df = spark.createDataFrame([(None, BASE), ("3 months ago", BASE)], "question string, base_day date")
    out = annotate(df, opts=Options(relaxed_months=True)).orderBy(F.col("question").asc_nulls_first()).collect()
    assert out[0]["parse_source"] == "FALLBACK" and out[0]["tc"]["type"] == "NONE"
    assert (out[1]["tc"]["start"], out[1]["tc"]["end"]) == (D(2023, 9, 1), D(2024, 1, 31))


def test_custom_matcher_list(spark):
    only = [PHRASE_MATCHERS["near_day"]]
    df = spark.createDataFrame([("yesterday in 2023", BASE), ("in 2023", BASE)], "question string, base_day date")
    got = rows(annotate(df, matchers=only))
    assert got["yesterday in 2023"]["tc"]["type"] == "POINT" and got["in 2023"]["tc"]["type"] == "NONE"


@pytest.mark.parametrize(
    "observed, expression, start, end",
    [
        ("2026-03-04", "yesterday", "2026-03-03", "2026-03-03"),
        ("2026-03-04", "last Thursday", "2026-02-26", "2026-02-26"),
        ("2024-03-01", "last month", "2024-02-01", "2024-02-29"),
        ("2025-03-01", "last month", "2025-02-01", "2025-02-28"),
        ("2026-03-04", "this morning", "2026-03-04", "2026-03-04"),
        ("2026-03-04", "last week", "2026-02-25", "2026-03-04"),
        ("2026-03-04T10:00:00Z", "someday", "2026-03-04", "2026-03-04"),
    ],
)
def test_expression_goldens(spark, observed, expression, start, end):
    df = spark.createDataFrame([(observed, expression)], "o string, e string")
    r = df.select(resolve_expression(F.col("o"), F.col("e")).alias("r")).first()["r"]
    assert (str(r["start_date"]), str(r["end_date"])) == (start, end)
    assert r["unresolved"] == (expression == "someday")


def test_written_times_do_not_depend_on_the_session_zone(spark):
    from timeweave.functions.dates import bracket_range, iso_day, iso_if_possible

    df = spark.createDataFrame([("[2024-03-01T00:30:00+0200, 2024-03-02T10:00:00]",), ("[Sep 04, 2025, 09:27:31]",), ("nothing",)], "line string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            span = bracket_range(F.col("line"))
            got = [tuple(r) for r in df.select(*[F.date_format(span[c], "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")]).collect()]
            assert got == [("2024-02-29 22:30:00", "2024-03-02 10:00:00"), ("2025-09-04 09:27:31",) * 2, (None, None)], zone
            row = df.limit(1).select(
                iso_if_possible(F.lit("1:56 pm on 8 May, 2023")).alias("a"), iso_day(F.lit("2023-05-08T23:30:00-05:00")).cast("string").alias("b")
            ).first()
            assert (row["a"], row["b"]) == ("2023-05-08T13:56:00", "2023-05-08")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
