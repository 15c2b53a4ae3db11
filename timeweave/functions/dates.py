"""Date expressions: calendar arithmetic and parsing of written dates.

Every parser returns null for text it does not read; nothing raises under ANSI
mode.  Character classes are ASCII.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: building blocks of written dates -------------------------------------
MONTHS = (
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|"
    r"Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
WEEKDAYS = r"(?:Mon(?:day)?|Tue(?:sday)?|Wed(?:nesday)?|Thu(?:rsday)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?)"
YEAR = r"(?:19|20)\d{2}"
ISO_DAY = r"(?:19|20)\d{2}-\d{2}-\d{2}"
SLASH_DAY = r"(?:19|20)\d{2}[/.]\d{1,2}[/.]\d{1,2}"
NUMERIC_DAY = r"\d{1,2}[/.\-]\d{1,2}[/.\-](?:19|20)\d{2}"
MONTH_DAY_YEAR = rf"{MONTHS}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,\s*|\s+){YEAR}"
DAY_MONTH_YEAR = rf"\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?{MONTHS}\.?(?:,\s*|\s+){YEAR}"
MONTH_YEAR = rf"{MONTHS}\.?\s+{YEAR}"
YEAR_MONTH = r"(?:19|20)\d{2}[-/](?:0[1-9]|1[0-2])(?![-/.\d])"
DATE_EXPR = (
    rf"(?:{ISO_DAY}|{SLASH_DAY}|{NUMERIC_DAY}|{MONTH_DAY_YEAR}|{DAY_MONTH_YEAR}|{MONTH_YEAR}|{YEAR_MONTH}|{YEAR})"
)
MONTH_NUMBERS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
WEEKDAY_NUMBERS = {"mon": 0, "tue": 1, "wed": 2, "thu": 3, "fri": 4, "sat": 5, "sun": 6}
NUMBER_WORDS = {
    "a": 1, "an": 1, "two": 2, "few": 3, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8,
    "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
}
# -----------------------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``.  Keeps large expression trees linear where
    a sub-expression is used several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ymd(year: Column, month: Column, day: Column) -> Column:
    """Date from parts; null when a part is missing or they name no calendar day."""
    dash = F.lit("-")
    return F.concat(F.lpad(year.cast("string"), 4, "0"), dash, month.cast("string"), dash, day.cast("string")).try_cast("date")


def month_number(name: Column) -> Column:
    """``jan``..``december`` -> 1..12."""
    return _named(MONTH_NUMBERS, F.substring(name, 1, 3))


def weekday_number(name: Column) -> Column:
    """Monday -> 0 .. Sunday -> 6."""
    return _named(WEEKDAY_NUMBERS, F.substring(name, 1, 3))


def _named(values: dict[str, int], name: Column) -> Column:
    """Value of a name in any case; null for other words."""
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, F.lower(name))


def number_word(token: Column) -> Column:
    """``a``/``an`` 1, ``few`` 3, ``two``..``twelve``, or any whole number in digits; else null."""
    return F.coalesce(_named(NUMBER_WORDS, token), token.try_cast("int"))


def in_calendar(day: Column) -> Column:
    """``day`` if it lies in years 1 to 9999, else null."""
    return let(day, lambda d: F.when(d.between(F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date")), d))


def shift_months(day: Column, n: Column | int) -> Column:
    """Move by months; the day is clamped to the month's length."""
    return F.add_months(day, n)


def month_range(day: Column) -> tuple[Column, Column]:
    return F.trunc(day, "month").cast("date"), F.last_day(day)


def week_range(day: Column) -> tuple[Column, Column]:
    """Monday to Sunday."""
    monday = F.trunc(day, "week").cast("date")
    return monday, F.date_add(monday, 6)


def quarter_range(day: Column) -> tuple[Column, Column]:
    first = F.trunc(day, "quarter").cast("date")
    return first, F.last_day(F.add_months(first, 2))


def year_range(year: Column) -> tuple[Column, Column]:
    return ymd(year, F.lit(1), F.lit(1)), ymd(year, F.lit(12), F.lit(31))


def group(text: Column, pattern: str, n: int) -> Column:
    """Capture group, null instead of an empty string when absent."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


# Whole-text date forms with their capture groups.
WHOLE_ISO = r"^((?:19|20)\d{2})-(\d{2})-(\d{2})$"
WHOLE_SLASH = r"^((?:19|20)\d{2})[/.](\d{1,2})[/.](\d{1,2})$"
WHOLE_MDY = rf"^(?i)({MONTHS})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,\s*|\s+)({YEAR})$"
WHOLE_DMY = rf"^(?i)(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?({MONTHS})\.?(?:,\s*|\s+)({YEAR})$"
WHOLE_NUMERIC = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-]((?:19|20)\d{2})$"
WHOLE_MONTH_YEAR = rf"^(?i)({MONTHS})\.?\s+({YEAR})$"
WHOLE_YEAR_MONTH = r"^((?:19|20)\d{2})[-/](\d{1,2})$"
WHOLE_YEAR = rf"^{YEAR}$"


def date_span(text: Column) -> Column:
    """Bare date expression -> ``struct(start, end)`` or null.

    Days give a point, ``June 2036`` and ``2023-10`` the month, a year the year.
    Numeric days are month first unless a part above 12 says otherwise.
    """

    def parse(t: Column) -> Column:
        part = lambda p, n: F.regexp_extract(t, p, n)
        numeric = let(
            F.transform(F.split(t, r"[/.\-]"), lambda x: x.try_cast("int")),
            lambda p: F.when((p[0] > 12) & (p[1] <= 12), ymd(p[2], p[1], p[0])).otherwise(ymd(p[2], p[0], p[1])),
        )
        day = (
            F.when(t.rlike(WHOLE_ISO), t.try_cast("date"))
            .when(t.rlike(WHOLE_SLASH), ymd(part(WHOLE_SLASH, 1), part(WHOLE_SLASH, 2), part(WHOLE_SLASH, 3)))
            .when(t.rlike(WHOLE_MDY), ymd(part(WHOLE_MDY, 3), month_number(part(WHOLE_MDY, 1)), part(WHOLE_MDY, 2)))
            .when(t.rlike(WHOLE_DMY), ymd(part(WHOLE_DMY, 3), month_number(part(WHOLE_DMY, 2)), part(WHOLE_DMY, 1)))
            .when(t.rlike(WHOLE_NUMERIC), numeric)
        )
        month = F.when(
            t.rlike(WHOLE_MONTH_YEAR), ymd(part(WHOLE_MONTH_YEAR, 2), month_number(part(WHOLE_MONTH_YEAR, 1)), F.lit(1))
        ).when(t.rlike(WHOLE_YEAR_MONTH), ymd(part(WHOLE_YEAR_MONTH, 1), part(WHOLE_YEAR_MONTH, 2), F.lit(1)))
        year = F.when(t.rlike(WHOLE_YEAR), ymd(t, F.lit(1), F.lit(1)))
        pair = lambda end: lambda s: F.when(s.isNotNull(), F.struct(s.alias("start"), end(s).alias("end")))
        return F.coalesce(
            let(day, pair(lambda s: s)),
            let(month, pair(F.last_day)),
            let(year, pair(lambda s: F.last_day(F.add_months(s, 11)))),
        )

    return let(F.btrim(text, F.lit(" ,.;:")), parse)


# ---- timestamps written by data sets ----------------------------------------------------


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _at(day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Timestamp from a date and clock parts; null when missing or out of range."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    colon = F.lit(":")
    return F.concat(day.cast("string"), F.lit(" "), two(hour), colon, two(minute), colon, two(second)).try_cast("timestamp")


# Month names as data sets write them (full or three letters), output forms.
FULL_OR_SHORT = (
    "January|February|March|April|May|June|July|August|September|October|November|December|"
    "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
)
SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
SECOND_FORM, DAY_FORM = "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"


# Whole-text forms of written times.
CHAT_TIME = rf"(?i)^(\d{{1,2}}):(\d{{1,2}}) (AM|PM) on (\d{{1,2}}) ({FULL_OR_SHORT}), (\d{{4}})$"
CHAT_DAY = rf"(?i)^(\d{{1,2}}) ({FULL_OR_SHORT}), (\d{{4}})$"
SLASHED_TIME = r"^(\d{4})/(\d{1,2})/(\d{1,2}) (\d{1,2}):(\d{1,2})$"
SLASHED_DAY = r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
SHORT_TIME = rf"(?i)^({SHORT}) (\d{{1,2}}), (\d{{4}}), (\d{{1,2}}):(\d{{1,2}}):(\d{{1,2}})$"
SHORT_DAY = rf"(?i)^({SHORT}) (\d{{1,2}}), (\d{{4}})$"


def chat_time_iso(text: Column) -> Column:
    """``1:56 pm on 8 May, 2023`` or ``8 May, 2023`` -> ISO text, else null."""

    def parse(s: Column) -> Column:
        part = lambda p, n: F.regexp_extract(s, p, n)
        hour = part(CHAT_TIME, 1).try_cast("int")
        hour24 = F.when(hour.between(1, 12), hour % 12 + F.when(F.upper(part(CHAT_TIME, 3)) == "PM", 12).otherwise(0))
        stamp = _at(ymd(part(CHAT_TIME, 6), month_number(part(CHAT_TIME, 5)), part(CHAT_TIME, 4)), hour24, part(CHAT_TIME, 2), F.lit(0))
        day = ymd(part(CHAT_DAY, 3), month_number(part(CHAT_DAY, 2)), part(CHAT_DAY, 1))
        return F.when(s.rlike(CHAT_TIME), F.date_format(stamp, SECOND_FORM)).when(s.rlike(CHAT_DAY), F.date_format(day, DAY_FORM))

    return let(F.regexp_replace(_strip(text), r"\s+", " "), parse)


def _slashed(text: Column) -> Column:
    """``2023/05/30 (Tue) 22:40`` or ``2023/05/30`` -> ISO text."""

    def parse(s: Column) -> Column:
        part = lambda p, n: F.regexp_extract(s, p, n)
        day = lambda p: ymd(part(p, 1), part(p, 2), part(p, 3))
        stamp = _at(day(SLASHED_TIME), part(SLASHED_TIME, 4), part(SLASHED_TIME, 5), F.lit(0))
        return F.when(s.rlike(SLASHED_TIME), F.date_format(stamp, SECOND_FORM)).when(s.rlike(SLASHED_DAY), F.date_format(day(SLASHED_DAY), DAY_FORM))

    return let(F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*\([^)]*\)\s*", " "), r"\s+", " ")), parse)


def _short_day(s: Column) -> Column:
    part = lambda n: F.regexp_extract(s, SHORT_DAY, n)
    return F.when(s.rlike(SHORT_DAY), ymd(part(3), month_number(part(1)), part(2)))


def _short_time(s: Column) -> Column:
    part = lambda n: F.regexp_extract(s, SHORT_TIME, n)
    return F.when(s.rlike(SHORT_TIME), _at(ymd(part(3), month_number(part(1)), part(2)), part(4), part(5), part(6)))


def iso_if_possible(text: Column) -> Column:
    """ISO text kept, known formats converted, anything else unchanged."""

    def convert(s: Column) -> Column:
        inside = bracket_range(F.concat(F.lit("["), s, F.lit(", "), s, F.lit("] x")))["start"]
        return F.when((s == "") | (F.lower(s) == "unknown"), F.lit("Unknown")).otherwise(
            F.coalesce(
                F.when(s.rlike(r"^.{4}-.{2}-.{2}"), s), chat_time_iso(s), _slashed(s), F.date_format(_short_time(s), SECOND_FORM),
                F.date_format(_short_day(s), DAY_FORM), F.date_format(inside, SECOND_FORM), s,
            )
        )

    return let(_strip(F.coalesce(text, F.lit(""))), convert)


# Date spellings looked for inside brackets, in order of preference.
BRACKET_STAMPS = [
    r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:?\d{2})?)",
    r"(\d{4}-\d{2}-\d{2})",
    r"([A-Za-z]{3} \d{2}, \d{4}, \d{2}:\d{2}:\d{2})",
    r"([A-Za-z]{3} \d{2}, \d{4})",
]


def _one_stamp(s: Column) -> Column:
    """ISO or ``Sep 04, 2025[, 09:27:31]`` -> timestamp that reads as written; a
    zone offset is turned into UTC first, whatever the session zone is."""

    def iso(x: Column) -> Column:
        at = x.try_cast("timestamp")
        return F.when(x.rlike(r"T.*(?:Z|[+-]\d{2}:\d{2})$"), F.to_utc_timestamp(at, F.current_timezone())).otherwise(at)

    written = let(F.regexp_replace(s, r"(T.*[+-]\d{2})(\d{2})$", "$1:$2"), iso)
    return F.coalesce(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), written), _short_time(s), _short_day(s).cast("timestamp"))


def bracket_range(line: Column) -> Column:
    """``[start, end] text`` -> ``struct(start, end)`` timestamps; one side fills the other."""
    body = F.regexp_replace(_strip(line), r"^\s*[-*]\s+", "")

    def ends(t: Column) -> Column:
        first, second = F.get(t, F.lit(0)), F.get(t, F.lit(1))
        return F.struct(
            F.coalesce(first, second).alias("start"), F.when(F.size(t) > 1, F.coalesce(second, first)).otherwise(first).alias("end")
        )

    def stamps(inner: Column) -> Column:
        tries = [let(F.regexp_extract_all(inner, F.lit(p), 1), lambda a: F.when(F.size(a) > 0, a)) for p in BRACKET_STAMPS]
        return let(F.transform(F.slice(F.coalesce(*tries), 1, 2), _one_stamp), ends)

    return let(F.regexp_extract(body, r"^\s*\[\s*([^\]]+)\s*\]", 1), stamps)


def granularity(iso: Column) -> Column:
    s = F.trim(F.coalesce(iso, F.lit("")))
    return F.when((s == "") | (s == "Unknown"), "unknown").when(s.contains("T"), "second").otherwise("day")


def iso_day(text: Column) -> Column:
    """ISO text -> its own local date, no zone shift; unreadable -> null."""
    shaped = F.when(text.contains("T"), text.try_cast("timestamp").isNotNull()).otherwise(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"))
    return F.when(shaped, F.substring_index(text, "T", 1).try_cast("date"))


def question_time(text: Column) -> Column:
    """First ``2023/05/30 ... 22:40`` in the text -> timestamp, else null."""
    p = r"(\d{4})/(\d{2})/(\d{2}).*?(\d{2}):(\d{2})"
    part = lambda n: group(text, p, n)
    return _at(ymd(part(1), part(2), part(3)), part(4), part(5), F.lit(0))


def explicit_day(description: Column) -> Column:
    """First ISO date, else first ``Mon DD, YYYY``, as ISO text; else null."""

    def find(s: Column) -> Column:
        named = F.regexp_substr(s, F.lit(r"\b[A-Za-z]{3} \d{2}, \d{4}\b"))
        return F.coalesce(
            F.regexp_substr(s, F.lit(r"\b\d{4}-\d{2}-\d{2}\b")),
            let(named, lambda n: F.coalesce(F.date_format(_short_day(n), DAY_FORM), F.substring_index(n, "T", 1))),
        )

    return let(F.coalesce(description, F.lit("")), find)
