"""Event descriptions: types, times, lines, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from timeweave.functions import dates as dt
from timeweave.functions.dates import group, let

# ---- Fixed values: phrase markers of event types, in order of precedence ------------------
TYPE_MARKERS = [
    ("INTENTION", [
        "plans to ", "plan to ", "will ", "aims to ", "aim to ", "wants to ", "want to ", "hopes to ", "hope to ",
        "intends to ", "intend to ", "going to ", "preparing to ",
    ]),
    ("ATTRIBUTE", [
        "name is ", "name: ", "mbti is ", "mbti: ", "nationality is ", "nationality: ", "gender is ", "gender: ",
        "birth date is ", "birthday is ", "blood type is ", "blood type: ", "ethnicity is ", "ethnicity: ",
    ]),
    ("OCCURRENCE", [
        "was born ", "got married", "became ", "started ", "stopped ", "finished ", "moved to ", "graduated ", "died ",
        "divorced ", "quit ", "joined ", "bought ", "sold ", "visited ", "met ", "left ", "arrived ", "got ", "received ",
        "won ", "lost ", "broke up", "retired ",
    ]),
    ("STATE", [
        "is married", "is single", "is divorced", "works as ", "works at ", "lives in ", "lives at ", "likes ", "dislikes ",
        "prefers ", "doesn't like ", "does not like ", "has a ", "has been ", "is a ", "is an ", " years old", " year old",
    ]),
]
DEFAULT_TYPE = "OCCURRENCE"
EVENT_TYPES = ["OCCURRENCE", "STATE", "ATTRIBUTE", "INTENTION"]
TYPE_ALIASES = {"EVENT": "OCCURRENCE", "WINDOW": "OCCURRENCE", "AS_OF": "STATE", "PLAN": "INTENTION", "PLANNING": "INTENTION"}
LONG_SUMMARY = 120
# -------------------------------------------------------------------------------------------

SECOND = "yyyy-MM-dd'T'HH:mm:ss"


def _clean(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def infer_event_type(description: Column) -> Column:
    """First marker list, in order of precedence, with a phrase in the text."""
    low = F.lower(_clean(description))
    expr = F.lit(DEFAULT_TYPE)
    for name, markers in reversed(TYPE_MARKERS):
        hit = reduce(lambda a, b: a | b, [low.contains(m) for m in markers])
        expr = F.when(hit, F.lit(name)).otherwise(expr)
    return expr


def coerce_type(value: Column) -> Column:
    """Known event type after alias mapping, else an empty text."""
    up = F.upper(_clean(value))
    expr = F.when(up.isin(*EVENT_TYPES), up).otherwise("")
    for alias, name in TYPE_ALIASES.items():
        expr = F.when(up == alias, F.lit(name)).otherwise(expr)
    return expr


def final_type(value: Column, description: Column) -> Column:
    """Supplied type when it is one of the four, else the inferred one."""
    up = F.upper(_clean(value))
    return F.when(up.isin(*EVENT_TYPES), up).otherwise(infer_event_type(description))


LINE = r"(?s)^\s*\[\s*([^,\]]+)\s*,\s*([^\]]+)\s*\]\s*(.*)$"


def line_to_event(line: Column) -> Column:
    """``[start, end] text`` -> struct; a bare text keeps unknown times."""
    s = _clean(line)
    part = lambda n: F.nullif(_clean(F.regexp_extract(s, LINE, n)), F.lit(""))
    start = F.coalesce(part(1), F.lit("Unknown"))
    parsed = F.struct(
        start.alias("start_time"), F.coalesce(part(2), start).alias("end_time"), F.coalesce(part(3), F.lit("event")).alias("description")
    )
    bare = F.struct(F.lit("Unknown").alias("start_time"), F.lit("Unknown").alias("end_time"), s.alias("description"))
    return F.when(s.rlike(LINE), parsed).otherwise(bare)


def event_to_line(start: Column, end: Column, description: Column) -> Column:
    first = F.coalesce(F.nullif(start, F.lit("")), F.lit("Unknown"))
    last = F.coalesce(F.nullif(end, F.lit("")), first)
    return F.concat(F.lit("["), first, F.lit(", "), last, F.lit("] "), F.coalesce(F.nullif(_clean(description), F.lit("")), F.lit("event")))


def persona_name(info: Column) -> Column:
    """``Name: X;`` -> X."""
    return F.nullif(_clean(group(info, r"(?i)\bName\s*:\s*([^;\n\r]+)", 1)), F.lit(""))


def with_person(description: Column, name: Column) -> Column:
    """Replace a leading ``User's`` / ``User`` by the person's name."""
    d = _clean(description)
    return (
        F.when(name.isNull() | (name == ""), d)
        .when(d.startswith("User's "), F.concat(name, F.lit("'s "), F.substring(d, 8, 1 << 30)))
        .when(d.startswith("User "), F.concat(name, F.lit(" "), F.substring(d, 6, 1 << 30)))
        .when(d == "User", name).otherwise(d)
    )


def clock_time(raw: Column, day_end: bool) -> Column:
    """Written time -> ISO second text; a bare end date becomes 23:59:59."""

    def convert(s: Column) -> Column:
        at = dt.bracket_range(F.concat(F.lit("["), s, F.lit("] x")))["start"]
        late = F.concat(F.substring(F.date_format(at, SECOND), 1, 10), F.lit("T23:59:59"))
        return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), late).otherwise(F.date_format(at, SECOND)) if day_end else F.date_format(at, SECOND)

    return let(F.regexp_replace(_clean(raw), "^[\"'`]+|[\"'`]+$", ""), convert)


def session_window(start: Column, end: Column) -> Column:
    """Default times of events without their own -> struct(start, end)."""
    first = F.coalesce(clock_time(start, False), F.lit("Unknown"))
    return let(first, lambda f: F.struct(f.alias("start"), F.coalesce(clock_time(end, True), f).alias("end")))


EVENT_ARRAY = "array<struct<start_time:string,end_time:string,description:string,type:string>>"


def normalize_events(events: Column, session_start: Column, session_end: Column, fallback: Column) -> Column:
    """Supplied events -> ISO times, non-empty descriptions, known types.

    Input elements: ``struct(description, type, start_time, end_time, is_text)``;
    ``is_text`` marks an event given as plain text (empty ones are dropped).
    Without any event one is made of the fallback text.
    """

    def build(window: Column) -> Column:
        def one(ev: Column) -> Column:
            desc = F.nullif(_clean(ev["description"]), F.lit(""))
            text = F.coalesce(ev["is_text"], F.lit(False))
            start = F.when(~text, clock_time(ev["start_time"], False))
            end = F.when(~text, clock_time(F.coalesce(ev["end_time"], ev["start_time"]), True))
            return F.struct(
                F.coalesce(start, window["start"]).alias("start_time"), F.coalesce(end, window["end"]).alias("end_time"),
                F.coalesce(desc, fallback, F.lit("event")).alias("description"), F.when(text, "").otherwise(coerce_type(ev["type"])).alias("type"),
            )

        given = F.filter(
            F.coalesce(events, F.array().cast("array<struct<description:string,type:string,start_time:string,end_time:string,is_text:boolean>>")),
            lambda ev: ~F.coalesce(ev["is_text"], F.lit(False)) | (_clean(ev["description"]) != ""),
        )
        made = F.array(
            F.struct(window["start"].alias("start_time"), window["end"].alias("end_time"), _clean(fallback).alias("description"), F.lit("").alias("type"))
        )
        none = F.array().cast(EVENT_ARRAY)
        return F.when(F.size(given) > 0, F.transform(given, one)).when(fallback.isNotNull(), made).otherwise(none)

    return let(session_window(session_start, session_end), build)


def dedupe_events(events: Column, drop_texts: Column) -> Column:
    """Drop empty and listed texts and exact duplicates; drop long comma lists
    when a shorter description exists."""
    kept = F.array_distinct(
        F.filter(events, lambda e: (_clean(e["description"]) != "") & ~F.array_contains(F.transform(drop_texts, _clean), _clean(e["description"])))
    )
    return let(kept, lambda uniq: _drop_summaries(uniq, lambda e: e["description"]))


def _drop_summaries(uniq: Column, text_of) -> Column:
    shorter = F.exists(uniq, lambda e: F.length(text_of(e)) < LONG_SUMMARY)
    filtered = F.filter(uniq, lambda e: ~((F.length(_clean(text_of(e))) > LONG_SUMMARY) & text_of(e).contains(",") & shorter))
    return F.when((F.size(uniq) <= 1) | (F.size(filtered) == 0), uniq).otherwise(filtered)


LINE_STAMPS = (
    r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:?\d{2})?|\d{4}-\d{2}-\d{2}|"
    r"[A-Za-z]{3} \d{2}, \d{4}, \d{2}:\d{2}:\d{2}|[A-Za-z]{3} \d{2}, \d{4})"
)


def normalize_lines(lines: Column, session_start: Column, session_end: Column, fallback: Column) -> Column:
    """Line form of :func:`normalize_events`: ``[start, end] text`` lines."""
    bracket = r"(?s)^\s*\[\s*([^\]]+)\s*\]\s*(.*)$"

    def build(window: Column) -> Column:
        def one(line: Column) -> Column:
            stamps = F.regexp_extract_all(F.regexp_extract(line, bracket, 1), F.lit(LINE_STAMPS), 1)
            rest = F.coalesce(F.nullif(_clean(F.regexp_extract(line, bracket, 2)), F.lit("")), fallback, F.lit("event"))

            def own(s: Column) -> Column:
                start = F.coalesce(clock_time(F.get(s, F.lit(0)), False), window["start"])
                end = F.coalesce(clock_time(F.coalesce(F.get(s, F.lit(1)), F.get(s, F.lit(0))), True), window["end"])
                return F.concat(F.lit("["), start, F.lit(", "), end, F.lit("] "), rest)

            plain = F.concat(F.lit("["), window["start"], F.lit(", "), window["end"], F.lit("] "), line)
            return F.when(line.rlike(bracket), let(stamps, own)).otherwise(plain)

        cleaned = F.filter(F.transform(lines, lambda x: F.regexp_replace(_clean(x), r"^[-*]\s+", "")), lambda x: x != "")
        made = F.array(F.concat(F.lit("["), window["start"], F.lit(", "), window["end"], F.lit("] "), fallback))
        return F.when(F.size(cleaned) > 0, F.transform(cleaned, one)).when(fallback.isNotNull(), made).otherwise(F.array().cast("array<string>"))

    return let(session_window(session_start, session_end), build)


def dedupe_lines(lines: Column, drop_texts: Column) -> Column:
    """Exact duplicates, listed texts and long comma lists are dropped."""
    body = lambda x: _clean(F.regexp_replace(_clean(x), r"(?s)^\s*\[[^\]]*\]\s*", ""))
    uniq = F.array_distinct(F.filter(F.transform(lines, _clean), lambda x: x != ""))

    def prune(u: Column) -> Column:
        shorter = F.exists(u, lambda e: F.length(body(e)) < LONG_SUMMARY)
        kept = F.filter(
            u,
            lambda e: ~F.array_contains(F.transform(drop_texts, _clean), body(e))
            & ~((F.length(body(e)) > LONG_SUMMARY) & body(e).contains(",") & shorter),
        )
        return F.when((F.size(u) <= 1) | (F.size(kept) == 0), u).otherwise(kept)

    return let(uniq, prune)


def events_text(descriptions: Column) -> Column:
    shown = F.filter(F.transform(F.coalesce(descriptions, F.array().cast("array<string>")), _clean), lambda x: x != "")
    return F.array_join(shown, " | ")


def time_metadata(description: Column, start: Column, end: Column, observed: Column) -> Column:
    """Explicit date in the text, else the event's own dates, else observation only."""
    raw = F.array(F.when(~F.coalesce(start, F.lit("")).isin("", "Unknown"), start), F.when(F.coalesce(end, F.lit("")) != "", end))
    own = F.transform(raw, lambda x: F.when(x.isNotNull(), F.substring_index(dt.iso_if_possible(x), "T", 1)))

    def build(x: Column) -> Column:
        usable = x["own"][0].isNotNull() & (x["own"][0] != "Unknown")
        first = F.coalesce(x["explicit"], F.when(usable, x["own"][0]))
        last = F.coalesce(x["explicit"], F.when(usable, F.coalesce(x["own"][1], x["own"][0])))
        return F.struct(
            observed.alias("observedTime"), first.alias("startTime"), last.alias("endTime"), F.when(first.isNotNull(), "day").alias("granularity")
        )

    return let(F.struct(dt.explicit_day(description).alias("explicit"), own.alias("own")), build)


def clean_labels(labels: Column, k: int) -> Column:
    """Supplied ``array<struct(label, confidence)>`` -> allowed labels, first
    occurrence kept, confidence clamped to [0, 1], first ``k``; none -> misc 0.5."""
    from timeweave.functions.text import topic_label

    mapped = F.transform(
        labels,
        lambda x: F.struct(
            topic_label(F.coalesce(F.nullif(x["label"], F.lit("")), F.lit("misc"))).alias("label"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x["confidence"].cast("double"), F.lit(0.5)))).alias("confidence"),
        ),
    )

    def first_only(m: Column) -> Column:
        names = F.transform(m, lambda x: x["label"])
        kept = F.filter(m, lambda x, i: F.array_position(names, x["label"]) == i + 1)
        default = F.array(F.struct(F.lit("misc").alias("label"), F.lit(0.5).alias("confidence")))
        return F.when(F.size(kept) > 0, F.slice(kept, 1, k)).otherwise(default)

    return let(F.coalesce(mapped, F.array().cast("array<struct<label:string,confidence:double>>")), first_only)
