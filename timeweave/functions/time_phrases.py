"""Matchers for time phrases in questions, as native Column expressions.

A matcher takes the text and the base day and yields a nullable struct
``(start, end, kind, boundary, is_fuzzy, match_text, pos)``.  The list order is
the priority: the first non-null wins.  Callers may pass their own list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from timeweave.functions import dates as dt
from timeweave.functions.dates import DATE_EXPR, MONTHS, WEEKDAYS, YEAR, let

# ---- Fixed values: phrase patterns ------------------------------------------------------
NUMBER = "a|an|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve"
FUZZY_WORDS = r"(?i)\b(around|about|approx\.?|roughly|circa|ca\.?)\b"
FROM_TO = rf"(?i)\bfrom\s+({DATE_EXPR})\s+(?:to|through|thru|till|until)\s+({DATE_EXPR})\b"
BETWEEN = rf"(?i)\bbetween\s+({DATE_EXPR})\s+and\s+({DATE_EXPR})\b"
AS_OF = rf"(?i)\b(?:as\s+of|as\s+at)\s+({DATE_EXPR})\b"
BY_DATE = rf"(?i)\b(?:by|up\s+until|up\s+to)\s+({DATE_EXPR})\b"
UNTIL_DATE = rf"(?i)\b(?:until|till)\s+({DATE_EXPR})\b"
AFTER_DATE = rf"(?i)\b(?:after|following)\s+({DATE_EXPR})\b"
BEFORE_DATE = rf"(?i)\b(?:before|prior\s+to)\s+({DATE_EXPR})\b"
SINCE_DATE = rf"(?i)\b(?:since|starting\s+(?:from|in))\s+({DATE_EXPR})\b"
MONTH_DAY_YEAR = rf"(?i)\b({dt.MONTH_DAY_YEAR})\b"
DAY_MONTH_YEAR = rf"(?i)\b({dt.DAY_MONTH_YEAR})\b"
ISO_DAY = rf"\b({dt.ISO_DAY})\b"
SLASH_DAY = rf"\b({dt.SLASH_DAY})\b"
NUMERIC_DAY = rf"\b({dt.NUMERIC_DAY})\b"
QUARTER = rf"(?i)\bQ([1-4])\s*({YEAR})\b"
HALF_YEAR = rf"(?i)\b(?:(first|1st|second|2nd|latter|last)\s+half\s+(?:of\s+)?({YEAR})|H([12])\s*({YEAR}))\b"
YEAR_THIRD = rf"(?i)\b(early|mid|late)\s+({YEAR})\b"
YEAR_EDGE = rf"(?i)\b(start|beginning|end)\s+of\s+({YEAR})\b"
SEASON = rf"(?i)\b(spring|summer|fall|autumn|winter)\s+({YEAR})\b"
DECADE = r"(?i)\b(?:the\s+)?(19|20)(\d)0s\b"
MONTH_OF_YEAR = rf"(?i)\b({MONTHS})\s+({YEAR})\b"
BARE_MONTH = rf"(?i)\b(?:in|during)\s+({MONTHS})\b(?!\s*,?\s*{YEAR})"
YEAR_MONTH = rf"\b({dt.YEAR_MONTH})"
RELATIVE_QUARTER = r"(?i)\b(last|this|next|previous|past)\s+quarter\b"
N_AGO = rf"(?i)\b({NUMBER}|\d+)\s+(day|week|month|year|quarter)s?\s+ago\b"
LAST_N = rf"(?i)\b(?:the\s+)?(?:last|past|previous)\s+({NUMBER}|few|\d+)\s+(day|week|month|year|quarter)s?\b"
RELATIVE_SPAN = r"(?i)\b(last|this|next|past|previous)\s+(week|month|year|weekend)\b"
RELATIVE_WEEKDAY = rf"(?i)\b(last|this|next)\s+({WEEKDAYS})\b"
DAYPART = r"(?i)\b(this\s+morning|this\s+afternoon|this\s+evening|tonight)\b"
NEAR_DAY = r"(?i)\b(yesterday|today|tomorrow)\b"
RECENTLY = r"(?i)\b(recently|lately|a\s+while\s+back)\b"
YEAR_IN_CONTEXT = rf"(?i)\b(?:in|during|around|about|circa|ca\.?|back\s+in|the\s+year)\s+({YEAR})\b"
RECENT_DAYS = 180
QUARTER_DAYS = 90
SEASON_MONTHS = {"spring": (3, 5), "summer": (6, 8), "fall": (9, 11), "autumn": (9, 11), "winter": (12, 2)}
# -----------------------------------------------------------------------------------------

PAST_WORDS = ("last", "past", "previous")


@dataclass(frozen=True)
class Options:
    """``fuzzy_relative``: relative phrases count as fuzzy.  ``relaxed_months``:
    "N months ago" reaches from N+3 to N-1 months back (bool or Column)."""

    fuzzy_relative: bool = False
    relaxed_months: bool | Column = False

    def relaxed(self) -> Column:
        return self.relaxed_months if isinstance(self.relaxed_months, Column) else F.lit(self.relaxed_months)


Matcher = Callable[[Column, Column, Options], Column]


def _found(text: Column, pattern: str, body: Callable[[Column], Column]) -> Column:
    """``body`` of the words the pattern finds.  A text without them is searched once; groups of a pattern that does not
    look past its end are the same in the found words, which are far shorter."""
    return F.when(text.rlike(pattern), let(F.regexp_extract(text, pattern, 0), body))


def _match(text, pattern, start, end, kind, boundary, opts: Options, fuzzy=None, hit=None) -> Column:
    """The match struct when the pattern hits and at least one date is valid; ``hit``: the words :func:`_found` gave."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    if opts.fuzzy_relative and not (isinstance(kind, str) and kind == "ABSOLUTE"):
        fuzzy = F.lit(True)

    def valid(words: Column) -> Column:
        value = F.struct(
            start.alias("start"), end.alias("end"), lit(kind).alias("kind"), lit(boundary).alias("boundary"),
            (words.rlike(FUZZY_WORDS) if fuzzy is None else fuzzy).alias("is_fuzzy"),
            words.alias("match_text"), F.regexp_instr(text, F.lit(pattern)).cast("int").alias("pos"),
        )
        return let(value, lambda m: F.when(m["start"].isNotNull() | m["end"].isNotNull(), m))

    return _found(text, pattern, valid) if hit is None else valid(hit)


def written_dates(text, base, opts):
    """Phrases made of written dates, in priority order.

    Each pattern only captures; the captured texts of all hits are then resolved
    by one shared date parser and the first valid one wins.
    """

    def capture(pattern: str, rule: str, second: int = 1) -> Column:
        return F.when(
            text.rlike(pattern),
            F.struct(
                F.regexp_extract(text, pattern, 1).alias("a"), F.regexp_extract(text, pattern, second).alias("b"), F.lit(rule).alias("rule"),
                F.regexp_substr(text, F.lit(pattern)).alias("hit"), F.regexp_instr(text, F.lit(pattern)).cast("int").alias("pos"),
            ),
        )

    hits = F.array(
        capture(FROM_TO, "RANGE", 2), capture(BETWEEN, "RANGE", 2), capture(AS_OF, "AS_OF"),
        capture(BY_DATE, "UNTIL"), capture(UNTIL_DATE, "UNTIL"), capture(AFTER_DATE, "AFTER"),
        capture(BEFORE_DATE, "BEFORE"), capture(SINCE_DATE, "SINCE"),
        *[capture(p, "POINT") for p in (MONTH_DAY_YEAR, DAY_MONTH_YEAR, ISO_DAY, SLASH_DAY, NUMERIC_DAY)],
    )

    def resolve(h: Column) -> Column:
        def bounds(span: Column) -> Column:
            s, e, rule, none = span["a"]["start"], span["b"]["end"], h["rule"], F.lit(None).cast("date")
            start = (
                F.when(rule == "AFTER", F.date_add(span["a"]["end"], 1)).when(rule.isin("UNTIL", "BEFORE"), none).otherwise(s)
            )
            end = F.when(rule == "UNTIL", e).when(rule == "BEFORE", F.date_sub(s, 1)).when(rule.isin("AFTER", "SINCE"), none).otherwise(e)
            boundary = (
                F.when(rule == "UNTIL", "BEFORE").when(rule == "SINCE", "AFTER")
                .when(rule == "AS_OF", F.when(s == e, "POINT").otherwise("RANGE")).otherwise(rule)
            )
            value = F.struct(
                start.alias("start"), end.alias("end"), F.lit("ABSOLUTE").alias("kind"), boundary.alias("boundary"),
                h["hit"].rlike(FUZZY_WORDS).alias("is_fuzzy"), h["hit"].alias("match_text"), h["pos"].alias("pos"),
            )
            return F.when(span["a"].isNotNull() & span["b"].isNotNull(), value)

        # one parser copy for both captured texts
        spans = F.transform(F.array(h["a"], h["b"]), dt.date_span)
        return let(let(spans, lambda x: F.struct(F.get(x, F.lit(0)).alias("a"), F.get(x, F.lit(1)).alias("b"))), bounds)

    found = F.filter(F.transform(F.filter(hits, lambda h: h.isNotNull()), resolve), lambda m: m.isNotNull())
    return F.get(found, F.lit(0))


def quarter(text, base, opts):
    month = (F.regexp_extract(text, QUARTER, 1).cast("int") - 1) * 3 + 1
    start, end = dt.quarter_range(dt.ymd(F.regexp_extract(text, QUARTER, 2), month, F.lit(1)))
    return _match(text, QUARTER, start, end, "ABSOLUTE", "RANGE", opts)


def _months_of(year: Column, first: Column, last: Column) -> tuple[Column, Column]:
    return dt.ymd(year, first, F.lit(1)), F.last_day(dt.ymd(year, last, F.lit(1)))


def half_year(text, base, opts):
    year = F.concat(F.regexp_extract(text, HALF_YEAR, 2), F.regexp_extract(text, HALF_YEAR, 4))
    first = F.lower(F.concat(F.regexp_extract(text, HALF_YEAR, 1), F.regexp_extract(text, HALF_YEAR, 3))).isin("first", "1st", "1")
    start, end = _months_of(year, F.when(first, 1).otherwise(7), F.when(first, 6).otherwise(12))
    return _match(text, HALF_YEAR, start, end, "ABSOLUTE", "RANGE", opts)


def year_third(text, base, opts):
    part, year = F.lower(F.regexp_extract(text, YEAR_THIRD, 1)), F.regexp_extract(text, YEAR_THIRD, 2)
    first = F.when(part == "early", 1).when(part == "mid", 5).otherwise(9)
    start, end = _months_of(year, first, first + 3)
    return _match(text, YEAR_THIRD, start, end, "ABSOLUTE", "RANGE", opts)


def year_edge(text, base, opts):
    """Start: Jan 1 - Feb 28, also in leap years.  End: Nov 1 - Dec 31."""
    at_end, year = F.lower(F.regexp_extract(text, YEAR_EDGE, 1)) == "end", F.regexp_extract(text, YEAR_EDGE, 2)
    start = F.when(at_end, dt.ymd(year, F.lit(11), F.lit(1))).otherwise(dt.ymd(year, F.lit(1), F.lit(1)))
    end = F.when(at_end, dt.ymd(year, F.lit(12), F.lit(31))).otherwise(dt.ymd(year, F.lit(2), F.lit(28)))
    return _match(text, YEAR_EDGE, start, end, "ABSOLUTE", "RANGE", opts)


def season(text, base, opts):
    name, year = F.lower(F.regexp_extract(text, SEASON, 1)), F.regexp_extract(text, SEASON, 2)
    first = F.create_map(*[x for k, v in SEASON_MONTHS.items() for x in (F.lit(k), F.lit(v[0]))])
    start = dt.ymd(year, F.try_element_at(first, name), F.lit(1))
    return _match(text, SEASON, start, F.last_day(F.add_months(start, 2)), "ABSOLUTE", "RANGE", opts)


def decade(text, base, opts):
    stem = F.concat(F.regexp_extract(text, DECADE, 1), F.regexp_extract(text, DECADE, 2))
    start, end = dt.ymd(F.concat(stem, F.lit("0")), F.lit(1), F.lit(1)), dt.ymd(F.concat(stem, F.lit("9")), F.lit(12), F.lit(31))
    return _match(text, DECADE, start, end, "ABSOLUTE", "RANGE", opts)


def month_of_year(text, base, opts):
    month = dt.month_number(F.regexp_extract(text, MONTH_OF_YEAR, 1))
    start = dt.ymd(F.regexp_extract(text, MONTH_OF_YEAR, 2), month, F.lit(1))
    return _match(text, MONTH_OF_YEAR, start, F.last_day(start), "ABSOLUTE", "RANGE", opts)


def bare_month(text, base, opts):
    start = dt.ymd(F.year(base), dt.month_number(F.regexp_extract(text, BARE_MONTH, 1)), F.lit(1))
    return _match(text, BARE_MONTH, start, F.last_day(start), "ABSOLUTE", "RANGE", opts, fuzzy=F.lit(opts.fuzzy_relative))


def year_month(text, base, opts):
    start = F.concat(F.regexp_replace(F.regexp_extract(text, YEAR_MONTH, 1), "/", "-"), F.lit("-01")).try_cast("date")
    return _match(text, YEAR_MONTH, start, F.last_day(start), "ABSOLUTE", "RANGE", opts)


def _step(word: Column) -> Column:
    return F.when(word.isin(*PAST_WORDS), -1).when(word == "next", 1).otherwise(0)


def relative_quarter(text, base, opts):
    moved = F.add_months(F.trunc(base, "month").cast("date"), _step(F.lower(F.regexp_extract(text, RELATIVE_QUARTER, 1))) * 3)
    start, end = dt.quarter_range(moved)
    return _match(text, RELATIVE_QUARTER, start, end, "RELATIVE_RANGE", "RANGE", opts)


#: Days from year 1 to year 9999.
CALENDAR_DAYS = 3_652_059


def _with_count(text: Column, pattern: str, body: Callable[[Column, Column], Column]) -> Column:
    """Bind the number and the unit of a "N units" phrase.  Numbers of more days than the calendar has name no day."""
    n, unit = let(F.regexp_extract(text, pattern, 1), dt.number_word), F.lower(F.regexp_extract(text, pattern, 2))
    n = let(n, lambda x: F.when(x <= CALENDAR_DAYS, x))
    return let(F.struct(n.alias("n"), unit.alias("unit")), lambda c: body(c["n"], c["unit"]))


def _by_unit(unit: Column, day, week, month, quarter_, year) -> Column:
    return (
        F.when(unit == "day", day).when(unit == "week", week).when(unit == "month", month)
        .when(unit == "quarter", quarter_).when(unit == "year", year)
    )


def n_ago(text, base, opts):
    def body(n, unit):
        first, relaxed = F.trunc(base, "month").cast("date"), opts.relaxed()
        week = dt.week_range(F.date_sub(base, n * 7))
        month_first = F.add_months(first, F.when(relaxed, -(n + 3)).otherwise(-n))
        month_last = F.last_day(F.add_months(first, F.when(relaxed, -F.greatest(n - 1, F.lit(0))).otherwise(-n)))
        quarter_, year = dt.quarter_range(F.add_months(first, n * -3)), dt.year_range(F.year(base) - n)
        day = F.date_sub(base, n)
        return F.struct(
            dt.in_calendar(_by_unit(unit, day, week[0], month_first, quarter_[0], year[0])).alias("s"),
            dt.in_calendar(_by_unit(unit, day, week[1], month_last, quarter_[1], year[1])).alias("e"),
            F.when(unit == "day", "POINT").otherwise("RANGE").alias("b"),
        )

    def match(hit):
        kind = lambda x: F.concat(F.lit("RELATIVE_"), x["b"])
        return let(_with_count(hit, N_AGO, body), lambda x: _match(text, N_AGO, x["s"], x["e"], kind(x), x["b"], opts, hit=hit))

    return _found(text, N_AGO, match)


def last_n(text, base, opts):
    def body(n, unit):
        first = F.trunc(base, "month").cast("date")
        month = F.add_months(first, F.when(opts.relaxed(), -(n + 3)).otherwise(-n + 1))
        year = dt.ymd(F.year(base) - n + 1, F.lit(1), F.lit(1))
        return F.struct(
            dt.in_calendar(_by_unit(unit, F.date_sub(base, n - 1), F.date_sub(base, n * 7), month, F.date_sub(base, n * QUARTER_DAYS), year)).alias("s"),
            (unit == "day").alias("days"),
        )

    def match(hit):
        few = F.lower(F.regexp_extract(hit, LAST_N, 1)) == "few"
        found = lambda x: _match(text, LAST_N, x["s"], base, "RELATIVE_RANGE", "RANGE", opts, few & x["days"], hit)
        return let(_with_count(hit, LAST_N, body), lambda x: F.when(x["s"].isNotNull(), found(x)))

    return _found(text, LAST_N, match)


def relative_span(text, base, opts):
    def body(c):
        step, unit = c["step"], c["unit"]
        saturday = F.date_add(base, F.pmod(F.lit(5) - F.weekday(base), F.lit(7)) + F.when(step == -1, -7).otherwise(0))
        week = dt.week_range(F.date_add(base, step * 7))
        month = F.add_months(F.trunc(base, "month").cast("date"), step)
        year = dt.year_range(F.year(base) + step)
        pick = lambda a, b, m, y: F.when(unit == "weekend", a).when(unit == "week", b).when(unit == "month", m).otherwise(y)
        return F.struct(
            pick(saturday, week[0], month, year[0]).alias("s"),
            pick(F.date_add(saturday, 1), week[1], F.last_day(month), year[1]).alias("e"),
        )

    def match(hit):
        word = lambda n: F.lower(F.regexp_extract(hit, RELATIVE_SPAN, n))
        parts = F.struct(let(word(1), _step).alias("step"), word(2).alias("unit"))
        return let(let(parts, body), lambda x: _match(text, RELATIVE_SPAN, x["s"], x["e"], "RELATIVE_RANGE", "RANGE", opts, hit=hit))

    return _found(text, RELATIVE_SPAN, match)


def relative_weekday(text, base, opts):
    def body(c):
        word, ahead = c["word"], c["ahead"]
        return F.date_add(base, F.when((word == "next") & (ahead == 0), 7).when(word == "last", ahead - 7).otherwise(ahead))

    def match(hit):
        ahead = F.pmod(dt.weekday_number(F.regexp_extract(hit, RELATIVE_WEEKDAY, 2)) - F.weekday(base), F.lit(7))
        parts = F.struct(F.lower(F.regexp_extract(hit, RELATIVE_WEEKDAY, 1)).alias("word"), ahead.alias("ahead"))
        return let(let(parts, body), lambda day: _match(text, RELATIVE_WEEKDAY, day, day, "RELATIVE_POINT", "POINT", opts, hit=hit))

    return _found(text, RELATIVE_WEEKDAY, match)


def daypart(text, base, opts):
    return _match(text, DAYPART, base, base, "RELATIVE_POINT", "POINT", opts)


def near_day(text, base, opts):
    def match(hit):
        day = let(F.lower(hit), lambda word: F.date_add(base, F.when(word == "yesterday", -1).when(word == "tomorrow", 1).otherwise(0)))
        return let(day, lambda d: _match(text, NEAR_DAY, d, d, "RELATIVE_POINT", "POINT", opts, hit=hit))

    return _found(text, NEAR_DAY, match)


def recently(text, base, opts):
    start = F.date_sub(base, RECENT_DAYS)
    return _match(text, RECENTLY, start, base, "RELATIVE_RANGE", "RANGE", opts, fuzzy=F.lit(True))


def year_in_context(text, base, opts):
    start, end = dt.year_range(F.regexp_extract(text, YEAR_IN_CONTEXT, 1))
    return _match(text, YEAR_IN_CONTEXT, start, end, "ABSOLUTE", "RANGE", opts)


#: Priority order, without the anchor clause.
PHRASE_MATCHERS: dict[str, Matcher] = {
    "written_dates": written_dates,
    "quarter": quarter,
    "half_year": half_year,
    "year_third": year_third,
    "year_edge": year_edge,
    "season": season,
    "decade": decade,
    "month_of_year": month_of_year,
    "bare_month": bare_month,
    "year_month": year_month,
    "relative_quarter": relative_quarter,
    "n_ago": n_ago,
    "last_n": last_n,
    "relative_span": relative_span,
    "relative_weekday": relative_weekday,
    "daypart": daypart,
    "near_day": near_day,
    "recently": recently,
    "year_in_context": year_in_context,
}


#: Digits that every year begins with.
CENTURIES = ("19", "20")
#: Lower-case words of which a text must hold one for the matcher to hit: looking for a word costs far less than a pattern
#: and spares a text without it the matcher's.
NEEDS: dict[Matcher, tuple[str, ...]] = {
    **dict.fromkeys(
        (written_dates, quarter, half_year, year_third, year_edge, season, decade, month_of_year, year_month, year_in_context), CENTURIES
    ),
    relative_quarter: ("quarter",),
    n_ago: ("ago",),
    last_n: PAST_WORDS,
    relative_span: ("week", "month", "year"),
    relative_weekday: ("last", "this", "next"),
    daypart: ("this", "tonight"),
    near_day: ("yesterday", "today", "tomorrow"),
    recently: ("recently", "lately", "while"),
}


def holds(low: Column, words: Sequence[str]) -> Column:
    """Whether a lower-case text has one of the words."""
    return reduce(or_, [low.contains(w) for w in words])


def first_match(text: Column, base: Column, opts: Options, matchers: Sequence[Matcher] | None = None) -> Column:
    """First matcher that yields a value, in list order; matchers in a row that need the same words share the search for them."""
    chosen = list(matchers) if matchers is not None else list(PHRASE_MATCHERS.values())

    def tries(low: Column) -> list[Column]:
        found = []
        for need, group in groupby(chosen, NEEDS.get):
            match = F.coalesce(*[m(text, base, opts) for m in group])
            if need is CENTURIES:
                match = F.when(text.rlike(YEAR), match)
            found.append(match if need is None else F.when(holds(low, need), match))
        return found

    return F.when(text.isNotNull(), let(F.lower(text), lambda low: F.coalesce(*tries(low))))
