"""Messages -> blocks: unpivot, segmentation, sealing, event clean-up.

Segmentation is a sequential rule with a closed form.  It is computed as a
two-level scan: windows run over chunks of at most ``CHUNK`` messages, and a
small table of chunk summaries carries the state between chunks.  A single
session may therefore be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.functions import dates as dt
from timeweave.functions import events as ev
from timeweave.functions.text import token_count

CHUNK = 65_536
SESSION = ["user_id", "session_order"]
MESSAGE = "array<struct<speaker:string,role:string,text:string,content:string,time:string,timestamp:string,dia_id:string>>"


# ---- unpivot ---------------------------------------------------------------------------------


def messages_from_session_keys(conversations: DataFrame, session_prefix: bool = False, limit_sessions: int | None = None) -> DataFrame:
    """Conversations with dynamic ``session_N`` keys -> one row per message.

    ``conversations(user_id, conversation)`` where ``conversation`` is JSON text.
    ``session_prefix`` writes session ids as ``c<conversation>_session<N>``.
    """
    keyed = conversations.withColumn("_map", F.from_json("conversation", "map<string,string>"))
    get = lambda k: F.try_element_at("_map", k)
    rows = keyed.select("*", F.explode("_map").alias("_key", "_value")).filter(F.col("_key").rlike(r"^session_\d+$"))
    n = F.regexp_extract("_key", r"(\d+)$", 1).cast("int")
    start = F.coalesce(get(F.concat("_key", F.lit("_start_time"))), get(F.concat("_key", F.lit("_date_time"))), F.lit("Unknown"))
    start = F.when(start.contains("json"), "Unknown").otherwise(start)
    end = F.coalesce(get(F.concat("_key", F.lit("_end_time"))), F.col("session_start_time"))
    rows = rows.withColumn("session_no", n).withColumn("session_start_time", start)
    rows = rows.withColumn("session_end_time", F.when(end.contains("json"), F.col("session_start_time")).otherwise(end))
    if limit_sessions is not None and limit_sessions > 0:
        order = Window.partitionBy("user_id").orderBy("session_no")
        rows = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit_sessions)
    ordinal = F.col("conversation_no").cast("string") if "conversation_no" in conversations.columns else F.lit("1")
    sid = F.concat(F.lit("c"), ordinal, F.lit("_session"), "session_no") if session_prefix else F.col("_key")
    name = ev.persona_name(get(F.lit("persona_info")))
    exploded = rows.select(
        "user_id", sid.alias("session_id"), "session_no", F.col("session_no").alias("session_order"), "session_start_time", "session_end_time",
        F.trim(F.coalesce(get(F.lit("persona_info")), F.lit(""))).alias("persona_info"), name.alias("persona_name"),
        F.posexplode(F.from_json("_value", MESSAGE)).alias("_pos", "m"),
    )
    return _message_rows(exploded, F.col("m.speaker"), F.col("m.text"))


def messages_from_arrays(samples: DataFrame, limit_sessions: int | None = None) -> DataFrame:
    """Index-aligned haystack arrays -> one row per message, with fallbacks."""
    rows = samples.select(
        F.col("question_id").alias("user_id"), "question_date", "haystack_session_ids", "haystack_dates",
        F.posexplode("haystack_sessions").alias("_i", "_msgs"),
    ).filter(F.col("_msgs").isNotNull())
    if limit_sessions is not None and limit_sessions > 0:
        rows = rows.filter(F.col("_i") < limit_sessions)
    own = lambda arr: F.nullif(F.trim(F.get(arr, F.col("_i"))), F.lit(""))
    time = F.coalesce(own("haystack_dates"), F.nullif("question_date", F.lit("")), F.lit("Unknown"))
    exploded = rows.select(
        "user_id", F.coalesce(own("haystack_session_ids"), F.concat(F.lit("session_"), F.col("_i") + 1)).alias("session_id"),
        (F.col("_i") + 1).alias("session_no"), (F.col("_i") + 1).alias("session_order"), time.alias("session_start_time"),
        time.alias("session_end_time"), F.lit("").alias("persona_info"), F.lit(None).cast("string").alias("persona_name"),
        F.posexplode("_msgs").alias("_pos", "m"),
    )
    return _message_rows(exploded, F.col("m.role"), F.coalesce("m.content", "m.text"))


def _message_rows(exploded: DataFrame, role: Column, text: Column) -> DataFrame:
    return exploded.filter(F.col("m").isNotNull()).select(
        "user_id", "session_id", "session_no", "session_order", (F.col("_pos") + 1).alias("msg_idx"), role.alias("role"),
        F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "").alias("text"),
        F.coalesce(F.nullif("m.time", F.lit("")), F.nullif("m.timestamp", F.lit("")), "session_start_time").alias("msg_time"),
        "session_start_time", "session_end_time", "persona_info", "persona_name",
    )


# ---- segmentation ----------------------------------------------------------------------------


def is_split(decision: Column) -> Column:
    """A decision text continues the block only when it contains "yes"."""
    return ~F.lower(F.coalesce(decision, F.lit(""))).contains("yes")


def segment(messages: DataFrame, split: Column, chunk: int = CHUNK) -> DataFrame:
    """Add ``block_no`` (1-based per user) and ``opens``.

    A message opens a block when it starts a session, or when it asks for a split
    and the open block already holds two messages.  Equivalently: in a run of
    consecutive messages that start a session or ask for a split, the 1st, 3rd,
    5th ... open a block.

    Within a chunk everything but the leading run is settled locally.  One summary
    row per chunk gives the run length and the block count carried into the next
    one, so the messages are read twice and shuffled once by (session, chunk).
    """
    part = [*SESSION, "_chunk"]
    rows = messages.withColumn("_split", split).withColumn("_chunk", F.floor((F.col("msg_idx") - 1) / chunk).cast("int"))
    ordered = Window.partitionBy(*part).orderBy("msg_idx")
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_row", F.row_number().over(ordered))
    rows = rows.withColumn("_flag", F.col("_split") | ((F.col("_chunk") == 0) & (F.col("_row") == 1)))
    rows = rows.withColumn("_calm", F.max(F.when(~F.col("_flag"), F.col("_row"))).over(running))

    odd = lambda n: n % 2 == 1
    local = F.col("_flag") & F.col("_calm").isNotNull() & odd(F.col("_row") - F.col("_calm"))
    summary = rows.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_size"), F.max("_calm").alias("_last"), F.count_if(F.col("_calm").isNull()).alias("_lead"), F.count_if(local).alias("_own")
    )
    in_session = Window.partitionBy(*SESSION).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    in_user = Window.partitionBy("user_id").orderBy("session_order", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("_skip", F.coalesce(F.sum("_size").over(in_session), F.lit(0)))
    calm_before = F.coalesce(F.max(F.col("_skip") + F.col("_last")).over(in_session), F.lit(0))
    summary = summary.withColumn("_carry", F.col("_skip") - calm_before)
    half = lambda n: F.floor((n + 1) / 2)  # noqa: E731  odd numbers in 1..n
    opened = F.col("_own") + half(F.col("_carry") + F.col("_lead")) - half(F.col("_carry"))
    done = F.coalesce(F.sum("_opened").over(in_user), F.lit(0))
    summary = summary.withColumn("_opened", opened).withColumn("_done", done).select(*part, "_carry", "_done")

    rows = rows.join(summary, part)
    run = F.when(F.col("_calm").isNull(), F.col("_carry") + F.col("_row")).otherwise(F.col("_row") - F.col("_calm"))
    rows = rows.withColumn("opens", F.col("_flag") & odd(run))
    block_no = F.sum(F.col("opens").cast("int")).over(running) + F.col("_done")
    return rows.withColumn("block_no", block_no.cast("bigint")).drop("_split", "_chunk", "_row", "_flag", "_calm", "_carry", "_done")


def split_context(messages: DataFrame, n: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Add ``context``: the previous ``n`` (1 or 2) messages of the session as
    ``role: text`` lines, the text a split decision is made on.

    The last ``n`` messages of a chunk are repeated as context rows of the next
    chunk, so windows stay within chunks.
    """
    if n not in (1, 2):
        raise ValueError("beyond two messages the context depends on earlier decisions")
    part = [*SESSION, "_chunk"]
    at = F.col("msg_idx") - 1
    here = F.floor(at / chunk).cast("int")
    copies = F.when(at % chunk >= chunk - n, F.array(here, here + 1)).otherwise(F.array(here))
    rows = messages.withColumn("_chunk", F.explode(copies)).withColumn("_own", F.col("_chunk") == here)
    line = F.concat_ws(": ", "role", "text")
    w = Window.partitionBy(*part).orderBy("msg_idx")
    earlier = F.array_compact(F.array(*[F.lag(line, i).over(w) for i in range(n, 0, -1)]))
    return rows.withColumn("context", F.array_join(earlier, "\n")).filter("_own").drop("_chunk", "_own")


def seal(segmented: DataFrame) -> DataFrame:
    """One row per block: coverage, session times, content text, message count."""
    key = ["user_id", "block_no"]
    line = F.concat(F.coalesce("msg_time", F.lit("")), F.lit(" "), F.coalesce("role", F.lit("None")), F.lit(": "), F.coalesce("text", F.lit("")))
    first = lambda c: F.min_by(c, "msg_idx")
    blocks = segmented.groupBy(*key).agg(
        first("session_id").alias("session_id"), F.min("msg_idx").alias("start_idx"), F.max("msg_idx").alias("end_idx"),
        first("session_start_time").alias("session_start_time"), first("session_end_time").alias("session_end_time"),
        first("persona_info").alias("persona_info"), first("persona_name").alias("persona_name"),
        F.min_by(F.when(F.col("text") != "", F.col("text")), F.when(F.col("text") != "", F.col("msg_idx"))).alias("first_text"),
        F.count(F.lit(1)).alias("messages"),
        F.transform(F.sort_array(F.collect_list(F.struct("msg_idx", line.alias("line")))), lambda m: m["line"]).alias("_lines"),
    )
    header = F.concat(F.lit("Session window: "), F.coalesce("session_start_time", F.lit("Unknown")), F.lit(" -> "), F.coalesce("session_end_time", "session_start_time", F.lit("Unknown")))
    persona = F.when(F.col("persona_info") != "", F.concat(F.lit("Persona info: "), "persona_info"))
    content = F.array_join(F.concat(F.array_compact(F.array(header, persona)), F.col("_lines")), "\n")
    return blocks.withColumn("content_text", content).drop("_lines")


def sealed_parts(segmented: DataFrame, messages: int = 4_096) -> DataFrame:
    """The content of :func:`seal` in ordered parts -> (user_id, block_no, part, start_idx, end_idx, messages, content_part).

    A part holds at most ``messages`` messages, so a block of any length is many small rows; the parts of a block in order, joined
    by line feeds, are its content text.  The first one begins with the header.
    """
    key = ["user_id", "block_no"]
    line = F.concat(F.coalesce("msg_time", F.lit("")), F.lit(" "), F.coalesce("role", F.lit("None")), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = segmented.withColumn("_chunk", F.floor(F.col("msg_idx") / messages)).withColumn("_line", line)
    first = lambda c: F.min_by(c, "msg_idx").alias(c)
    parts = rows.groupBy(*key, "_chunk").agg(
        F.min("msg_idx").alias("start_idx"), F.max("msg_idx").alias("end_idx"), F.count(F.lit(1)).alias("messages"), *(first(c) for c in ("session_start_time", "session_end_time", "persona_info")),
        F.transform(F.sort_array(F.collect_list(F.struct("msg_idx", "_line"))), lambda m: m["_line"]).alias("_lines"),
    )
    heads = parts.groupBy(*key).agg(F.min("_chunk").alias("_head"))
    header = F.concat(F.lit("Session window: "), F.coalesce("session_start_time", F.lit("Unknown")), F.lit(" -> "), F.coalesce("session_end_time", "session_start_time", F.lit("Unknown")))
    persona = F.when(F.col("persona_info") != "", F.concat(F.lit("Persona info: "), "persona_info"))
    part = (F.col("_chunk") - F.col("_head")).cast("int")
    opening = F.when(part == 0, F.array_compact(F.array(header, persona))).otherwise(F.array().cast("array<string>"))
    joined = parts.join(heads, key)
    return joined.select(*key, part.alias("part"), "start_idx", "end_idx", "messages", F.array_join(F.concat(opening, "_lines"), "\n").alias("content_part"))


# ---- supplied extraction output --------------------------------------------------------------

EXTRACTION = "topic string, keywords string, mentions array<string>, explicit_mentions array<string>"


def unpack_extraction(raw: Column) -> Column:
    """Extraction JSON -> struct(topic, keywords, mentions); bad JSON -> empty."""
    parsed = F.from_json(raw, EXTRACTION)
    trimmed = lambda arr: F.filter(F.transform(arr, lambda x: F.trim(x)), lambda x: x != "")
    listed = F.from_json(parsed["keywords"], "array<string>")
    keywords = F.when(parsed["keywords"].startswith("["), F.array_join(trimmed(listed), ", ")).otherwise(F.trim(parsed["keywords"]))
    mentions = F.coalesce(parsed["mentions"], parsed["explicit_mentions"], F.array().cast("array<string>"))
    return F.struct(
        F.coalesce(F.trim(parsed["topic"]), F.lit("")).alias("topic"), F.coalesce(keywords, F.lit("")).alias("keywords"), trimmed(mentions).alias("mentions")
    )


def events_from_mentions(mentions: Column, session_start: Column, session_end: Column) -> Column:
    """Mentions without labels: inferred type and the session window."""
    start = F.coalesce(session_start, F.lit("Unknown"))
    return F.transform(
        mentions,
        lambda m: F.struct(
            m.alias("description"), ev.infer_event_type(m).alias("type"), start.alias("start_time"),
            F.coalesce(session_end, start).alias("end_time"), F.lit(False).alias("is_text"),
        ),
    )


def fallback_text(topic_kw: Column, first_text: Column, most: int = 120) -> Column:
    """Topic and keywords, else the first ``most`` characters of a message, else "conversation"."""
    blank = F.lit("")
    return F.coalesce(F.nullif(topic_kw, blank), F.nullif(F.substring(first_text, 1, most), blank), F.lit("conversation"))


def finish(raw_blocks: DataFrame, extraction: str = "extraction", supplied_events: str | None = None) -> DataFrame:
    """Sealed blocks plus extraction JSON -> blocks in the declared schema.

    ``supplied_events`` names a column of labelled events
    (``array<struct(description, type, start_time, end_time, is_text)>``); without
    it events come from the mentions.
    """
    start, end = F.col("session_start_time"), F.col("session_end_time")
    b = raw_blocks.withColumn("_x", unpack_extraction(F.col(extraction)))
    b = b.withColumn("topic_kw_text", F.trim(F.concat_ws(" ", "_x.topic", "_x.keywords")))
    b = b.withColumn("_fallback", fallback_text(F.col("topic_kw_text"), F.col("first_text")))
    given = F.col(supplied_events) if supplied_events else events_from_mentions(F.col("_x.mentions"), start, end)
    b = b.withColumn("_events", ev.normalize_events(given, start, end, F.col("_fallback")))
    b = b.withColumn("_events", ev.dedupe_events(F.col("_events"), F.array("topic_kw_text", "_fallback")))
    b = b.withColumn("_times", F.transform(F.array(start, F.coalesce(end, start)), dt.iso_if_possible))
    b = b.withColumns({"_ss": F.col("_times")[0], "_se": F.col("_times")[1]})
    observed = F.when(F.col("_se") != "Unknown", F.col("_se")).otherwise(F.col("_ss"))
    name = F.col("persona_name")
    out = F.transform(
        F.col("_events"),
        lambda e, i: dt.let(
            ev.with_person(e["description"], name),
            lambda d: F.struct(
                F.concat_ws("_", F.col("user_id"), F.col("block_no"), F.concat(F.lit("e"), i)).alias("event_id"), d.alias("description"),
                ev.final_type(e["type"], d).alias("event_temporal_type"),
                ev.time_metadata(d, e["start_time"], e["end_time"], F.col("_observed")).alias("time_metadata"),
            ),
        ),
    )
    b = b.withColumn("_observed", observed).withColumn("events", out)
    enriched = F.concat_ws(" ", "content_text", "_x.topic", "_x.keywords", ev.events_text(F.transform("_events", lambda e: e["description"])))
    tokens = token_count(F.col("content_text"))
    lo, hi = envelope(F.col("events"), F.col("_ss"), F.col("_se"))
    return b.select(
        "user_id", F.col("block_no").alias("block_id"), F.struct("session_id", "start_idx", "end_idx").alias("coverage"),
        F.struct(
            F.col("_ss").alias("sessionstart_time"), F.col("_se").alias("sessionend_time"), lo.alias("block_event_start_time"),
            hi.alias("block_event_end_time"),
        ).alias("temporal_index"),
        F.struct("content_text", "topic_kw_text", F.array().cast("array<string>").alias("categories")).alias("features"),
        F.size("events").alias("events_count"), "events", "messages", tokens.alias("content_tokens"),
        token_count(enriched).alias("enriched_tokens"), (token_count(enriched) / F.greatest(tokens, F.lit(1))).alias("enrichment_ratio"),
    )


def envelope(events: Column, session_start: Column, session_end: Column) -> tuple[Column, Column]:
    """Earliest event start and latest event end; the session date where none."""
    day = lambda c: F.substring(c, 1, 10).try_cast("date")
    first = F.array_min(F.transform(events, lambda e: day(e["time_metadata"]["startTime"])))
    last = F.array_max(F.transform(events, lambda e: day(e["time_metadata"]["endTime"])))
    fall = lambda s: F.when(s != "Unknown", F.substring_index(s, "T", 1)).otherwise("Unknown")
    return F.coalesce(first.cast("string"), fall(session_start)), F.coalesce(last.cast("string"), fall(session_end))


def explode_events(blocks: DataFrame) -> DataFrame:
    """Blocks -> one row per event with its position."""
    return blocks.select("user_id", "block_id", F.posexplode("events").alias("event_no", "e")).select("user_id", "block_id", "event_no", "e.*")
