"""Block building: unpivot, segmentation, sealing, events, dates, labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from timeweave.catalog.registry import query, table
from timeweave.functions import dates as dt
from timeweave.functions import events as ev
from timeweave.functions import text as tx
from timeweave.operators import blocks as bl
from timeweave.operators import evidence

CLEAN = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def conversation_json(spark, d):
    """Conversations as documents with dynamic session keys, three turns a session."""
    c = table(spark, d, "conversations")
    sess = c.withColumn("s", F.floor(F.col("turn") / 3) + 1)
    msg = F.struct(F.col("turn"), F.struct(F.col("role").alias("speaker"), "text").alias("m"))
    per = sess.groupBy("conv_id", "s").agg(F.to_json(F.transform(F.sort_array(F.collect_list(msg)), lambda x: x["m"])).alias("body"))
    key = F.concat(F.lit("session_"), "s")
    when = F.concat(F.lit("1:0"), F.col("s") % 10, F.lit(" pm on "), F.col("s") + 7, F.lit(" May, 2023"))
    entries = F.concat(
        F.lit('"'), key, F.lit('":'), "body", F.lit(',"'), key, F.lit('_date_time":"'), when, F.lit('"')
    )
    whole = per.groupBy("conv_id").agg(F.concat_ws(",", F.collect_list(entries)).alias("b"))
    persona = F.concat(F.lit('"persona_info":"Name: Person '), "conv_id", F.lit('; age 30","speaker_a":"A",'))
    return whole.select(F.col("conv_id").cast("string").alias("user_id"), F.concat(F.lit("{"), persona, "b", F.lit("}")).alias("conversation"))


def messages(spark, d):
    return bl.messages_from_session_keys(conversation_json(spark, d))


MSG = f"""msg AS (SELECT CAST(conv_id AS VARCHAR) AS user_id, 'session_' || (turn // 3 + 1) AS session_id, CAST(turn // 3 + 1 AS INTEGER) AS session_no, CAST(turn % 3 + 1 AS INTEGER) AS msg_idx,
   role, {CLEAN.format(x='text')} AS text, '1:0' || ((turn // 3 + 1) % 10) || ' pm on ' || (turn // 3 + 8) || ' May, 2023' AS t FROM conversations)"""


@query("l1_session_key_unpivot", f"WITH {MSG} SELECT user_id, session_id, session_no, msg_idx, role, text, t AS msg_time FROM msg")
def l1(spark, d):
    return messages(spark, d).select("user_id", "session_id", "session_no", "msg_idx", "role", "text", "msg_time")


def samples(spark, d):
    """Haystack samples: every fifth conversation shares a question."""
    c = table(spark, d, "conversations")
    sessions = c.groupBy("conv_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("turn", "role", "text"))),
            lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"), F.lit(None).cast("string").alias("text"),
                               F.lit(None).cast("string").alias("time"), F.lit(None).cast("string").alias("timestamp")),
        ).alias("msgs")
    )
    sid = F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.concat(F.lit("s"), "conv_id"))
    return sessions.groupBy((F.col("conv_id") % 5).alias("g")).agg(
        F.sort_array(F.collect_list(F.struct("conv_id", sid.alias("sid"), "msgs"))).alias("a")
    ).select(
        F.concat(F.lit("q"), "g").alias("question_id"), F.lit("2023/05/30 (Tue) 22:40").alias("question_date"),
        F.transform("a", lambda x: x["sid"]).alias("haystack_session_ids"), F.array(F.lit("2023/05/01 (Mon) 10:00")).alias("haystack_dates"),
        F.transform("a", lambda x: x["msgs"]).alias("haystack_sessions"),
    )


@query(
    "l2_haystack_unpivot",
    f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id) AS i FROM (SELECT DISTINCT conv_id FROM conversations))
        SELECT 'q' || (c.conv_id % 5) AS user_id, CASE WHEN c.conv_id % 3 = 0 THEN 'session_' || i ELSE 's' || c.conv_id END AS session_id,
          CAST(row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) AS INTEGER) AS msg_idx, role, {CLEAN.format(x='text')} AS text,
          CASE WHEN i = 1 THEN '2023/05/01 (Mon) 10:00' ELSE '2023/05/30 (Tue) 22:40' END AS msg_time FROM conversations c JOIN o USING (conv_id)""",
)
def l2(spark, d):
    return bl.messages_from_arrays(samples(spark, d)).select("user_id", "session_id", "msg_idx", "role", "text", "msg_time")


# ---- segmentation over event logs: sessions by 12 hours of silence ---------------------------


def event_messages(spark, d):
    e = table(spark, d, "events")
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(by_user) > 12 * 3600 * 1_000_000
    s = e.withColumn("session_order", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(by_user))
    idx = F.row_number().over(Window.partitionBy("user_id", "session_order").orderBy("ts", "event_id"))
    return s.withColumn("msg_idx", idx).select(
        F.col("user_id").cast("string").alias("user_id"), "session_order", F.concat(F.lit("session_"), "session_order").alias("session_id"), "msg_idx",
        F.col("event_type").alias("role"), F.col("props").alias("text"), F.col("ts").cast("string").alias("msg_time"), "event_id",
        F.lit("2024/01/01 (Mon) 08:00").alias("session_start_time"), F.lit("Jan 02, 2024").alias("session_end_time"),
        F.lit("").alias("persona_info"), F.lit(None).cast("string").alias("persona_name"),
    )


SEG = """ev0 AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 43200000000, TRUE) AS g FROM events),
  ev1 AS (SELECT *, sum(CAST(g AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS so FROM ev0),
  ev2 AS (SELECT *, row_number() OVER (PARTITION BY user_id, so ORDER BY ts, event_id) AS idx FROM ev1),
  ev3 AS (SELECT *, idx = 1 OR event_id % 3 = 0 AS f FROM ev2),
  ev4 AS (SELECT *, idx - coalesce(max(CASE WHEN NOT f THEN idx END) OVER (PARTITION BY user_id, so ORDER BY idx), 0) AS run FROM ev3),
  seg AS (SELECT *, f AND run % 2 = 1 AS opens, sum(CAST(f AND run % 2 = 1 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY so, idx) AS block_no FROM ev4)"""


@query(
    "l3_segmentation",
    f"WITH {SEG} SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, opens, CAST(block_no AS BIGINT) AS block_no FROM seg",
)
def l3(spark, d):
    m = event_messages(spark, d)
    return bl.segment(m, F.col("event_id") % 3 == 0).select("user_id", "event_id", "opens", "block_no")


@query(
    "l3_segmentation_small_chunks",
    f"WITH {SEG} SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, opens, CAST(block_no AS BIGINT) AS block_no FROM seg",
)
def l3_chunks(spark, d):
    return bl.segment(event_messages(spark, d), F.col("event_id") % 3 == 0, chunk=4).select("user_id", "event_id", "opens", "block_no")


@query(
    "l4_split_context",
    f"""WITH {SEG} SELECT event_id, concat_ws(chr(10), lag(event_type || ': ' || props, 2) OVER w, lag(event_type || ': ' || props, 1) OVER w) AS context
        FROM seg WINDOW w AS (PARTITION BY user_id, so ORDER BY idx)""",
)
def l4(spark, d):
    return bl.split_context(event_messages(spark, d), 2, chunk=16).select("event_id", "context")


@query(
    "l5_l6_sealed_blocks",
    f"""WITH {SEG} SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(block_no AS BIGINT) AS block_no, CAST(min(idx) AS INTEGER) AS start_idx, CAST(max(idx) AS INTEGER) AS end_idx, count(*) AS messages,
        md5('Session window: 2024/01/01 (Mon) 08:00 -> Jan 02, 2024' || chr(10) || string_agg(regexp_replace(CAST(ts AS VARCHAR), '\\.?0+$', '') || ' ' || event_type || ': ' || props, chr(10) ORDER BY idx)) AS content_key
        FROM seg GROUP BY user_id, block_no""",
)
def l5(spark, d):
    m = event_messages(spark, d).withColumn("msg_time", F.regexp_replace("msg_time", r"\.?0+$", ""))
    s = bl.seal(bl.segment(m, F.col("event_id") % 3 == 0))
    return s.select("user_id", "block_no", "start_idx", "end_idx", "messages", F.md5("content_text").alias("content_key"))


@query(
    "l5_l6_sealed_parts",
    f"""WITH {SEG}, c AS (SELECT *, idx // 3 AS chunk, min(idx // 3) OVER (PARTITION BY user_id, block_no) AS head FROM seg)
        SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(block_no AS BIGINT) AS block_no, CAST(chunk - head AS INTEGER) AS part, CAST(min(idx) AS INTEGER) AS start_idx, CAST(max(idx) AS INTEGER) AS end_idx, count(*) AS messages,
        md5(CASE WHEN chunk = head THEN 'Session window: 2024/01/01 (Mon) 08:00 -> Jan 02, 2024' || chr(10) ELSE '' END || string_agg(regexp_replace(CAST(ts AS VARCHAR), '\\.?0+$', '') || ' ' || event_type || ': ' || props, chr(10) ORDER BY idx)) AS content_key
        FROM c GROUP BY user_id, block_no, chunk, head""",
)
def l5_parts(spark, d):
    m = event_messages(spark, d).withColumn("msg_time", F.regexp_replace("msg_time", r"\.?0+$", ""))
    s = bl.sealed_parts(bl.segment(m, F.col("event_id") % 3 == 0), messages=3)
    return s.select("user_id", "block_no", "part", "start_idx", "end_idx", "messages", F.md5("content_part").alias("content_key"))


@query(
    "l16_split_decision",
    "SELECT event_id, event_type NOT IN ('click', 'view') AS splits FROM events",
)
def l16(spark, d):
    word = F.when(F.col("event_type") == "click", "YES.").when(F.col("event_type") == "view", '{"answer": "Yes"}').otherwise("Partially Shifted")
    return table(spark, d, "events").select("event_id", bl.is_split(word).alias("splits"))


# ---- the finished block ----------------------------------------------------------------------


def finished(spark, d):
    raw = bl.seal(bl.segment(messages(spark, d), F.col("msg_idx") == 3))
    js = F.to_json(
        F.struct(
            F.lit("Travel").alias("topic"), F.array(F.lit(" rail "), F.concat(F.lit("trip "), "user_id")).alias("keywords"),
            F.array(
                F.concat(F.lit("User bought ticket "), "block_no"), F.lit("User's name is Ann"), F.concat(F.lit("User visited Rome on 2023-06-1"), F.col("block_no") % 10),
                F.lit("User's name is Ann"), F.lit("Travel rail, trip"), F.lit("  "),
            ).alias("mentions"),
        )
    )
    broken = F.when(F.col("block_no") % 4 == 3, F.lit("{oops")).otherwise(js)
    return bl.finish(raw.withColumn("extraction", broken))


FIN = f"""{MSG}, seg AS (SELECT *, sum(CASE WHEN msg_idx IN (1, 3) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY session_no, msg_idx) AS block_no FROM msg),
  b AS (SELECT user_id, CAST(block_no AS BIGINT) AS block_id, min(session_no) AS s, arg_min(text, msg_idx) FILTER (text <> '') AS first_text FROM seg GROUP BY ALL),
  day AS (SELECT *, '2023-05-' || lpad(CAST(s + 7 AS VARCHAR), 2, '0') AS dd, block_id % 4 = 3 AS bad FROM b)"""


@query(
    "l8_l15_finished_events",
    f"""WITH {FIN}, e AS (SELECT *, unnest([0, 1, 2, 3]) AS i FROM day WHERE NOT bad)
       SELECT user_id || '_' || block_id || '_e' || i AS event_id, CASE i WHEN 0 THEN 'Person ' || user_id || ' bought ticket ' || block_id WHEN 1 THEN 'Person ' || user_id || '''s name is Ann'
            WHEN 2 THEN 'Person ' || user_id || ' visited Rome on 2023-06-1' || (block_id % 10) ELSE 'Travel rail, trip' END AS description,
         CASE i WHEN 0 THEN 'OCCURRENCE' WHEN 1 THEN 'ATTRIBUTE' WHEN 2 THEN 'OCCURRENCE' ELSE 'OCCURRENCE' END AS event_temporal_type,
         CASE i WHEN 2 THEN '2023-06-1' || (block_id % 10) END AS start_time, dd || 'T13:0' || (s % 10) || ':00' AS observed FROM e
       UNION ALL SELECT user_id || '_' || block_id || '_e0', substr(first_text, 1, 120), 'OCCURRENCE', NULL, dd || 'T13:0' || (s % 10) || ':00' FROM day WHERE FALSE""",
)
def l8(spark, d):
    e = bl.explode_events(finished(spark, d))
    return e.select(
        "event_id", "description", "event_temporal_type", F.col("time_metadata.startTime").alias("start_time"), F.col("time_metadata.observedTime").alias("observed")
    )


@query(
    "g12_l14_block_envelope",
    f"""WITH {FIN} SELECT user_id, block_id, CASE WHEN bad THEN dd ELSE '2023-06-1' || (block_id % 10) END AS event_start, CASE WHEN bad THEN dd ELSE '2023-06-1' || (block_id % 10) END AS event_end,
         CAST(CASE WHEN bad THEN 0 ELSE 4 END AS INTEGER) AS events_count, CASE WHEN bad THEN FALSE ELSE TRUE END AS enriched FROM day""",
)
def g12(spark, d):
    return finished(spark, d).select(
        "user_id", "block_id", F.col("temporal_index.block_event_start_time").alias("event_start"), F.col("temporal_index.block_event_end_time").alias("event_end"),
        "events_count", (F.col("enrichment_ratio") > 1).alias("enriched"),
    )


@query(
    "l9_dedupe_events",
    """SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n, CASE WHEN event_id % 2 = 0 THEN 'short ' || event_type ELSE repeat('x,', 70) END AS first FROM events""",
)
def l9(spark, d):
    one = lambda t, k: F.struct(F.lit("2024-01-01T00:00:00").alias("start_time"), F.lit("2024-01-01T00:00:00").alias("end_time"), t.alias("description"), F.lit(k).alias("type"))
    short, long = F.concat(F.lit("short "), "event_type"), F.repeat(F.lit("x,"), 70)
    arr = F.when(F.col("event_id") % 2 == 0, F.array(one(short, ""), one(long, ""), one(short, ""), one(F.lit("drop me"), ""), one(short, "STATE"))).otherwise(
        F.array(one(long, ""), one(F.lit("drop me"), ""), one(long, ""))
    )
    out = ev.dedupe_events(arr, F.array(F.lit(" drop me ")))
    return table(spark, d, "events").select("event_id", F.size(out).alias("n"), out[0]["description"].alias("first"))


@query(
    "l10_event_lines",
    """SELECT event_id, '[2024-03-01T00:00:00, 2024-03-02T23:59:59] ' || event_type || '|[2024-01-01T08:00:00, 2024-01-02T23:59:59] plain text|[2024-01-01T08:00:00, 2024-01-02T23:59:59] event' AS lines FROM events""",
)
def l10(spark, d):
    raw = F.array(
        F.concat(F.lit("- [2024-03-01, Mar 02, 2024] "), "event_type"), F.lit("  * plain text "), F.lit("[Unknown, Unknown] event"), F.lit("plain text"), F.lit(" "),
    )
    raw = F.transform(raw, lambda x: F.regexp_replace(x, r"Mar 02, 2024", "2024-03-02"))
    norm = ev.normalize_lines(raw, F.lit("2024-01-01T08:00:00"), F.lit("2024-01-02"), F.lit("event"))
    return table(spark, d, "events").select("event_id", F.array_join(ev.dedupe_lines(norm, F.array(F.lit("nothing"))), "|").alias("lines"))


@query(
    "l19_clean_labels",
    """SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS n, CASE WHEN event_id % 3 = 0 THEN 'misc' ELSE 'travel' END AS label, CAST(CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS confidence FROM events""",
)
def l19(spark, d):
    lab = lambda a, c: F.struct(F.lit(a).alias("label"), F.lit(c).cast("double").alias("confidence"))
    arr = F.when(F.col("event_id") % 3 != 0, F.array(lab("Travel!", 1.7), lab("travel", 0.2), lab("My Food", -1.0), lab("sports", 0.4)))
    out = ev.clean_labels(arr, 2)
    return table(spark, d, "events").select("event_id", F.size(out).alias("n"), out[0]["label"].alias("label"), out[0]["confidence"].alias("confidence"))


@query(
    "l20_topic_map",
    "SELECT event_type AS key, CASE WHEN count(*) % 2 = 0 THEN 'food' ELSE 'music' END AS topic, CASE WHEN count(*) % 2 = 0 THEN CAST(NULL AS DOUBLE) ELSE 0.75 END AS confidence FROM events GROUP BY event_type",
)
def l20(spark, d):
    from timeweave.sources.scans import topic_map

    per = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("n") % 2 == 0, F.lit('"Street Food"')).otherwise(F.lit('{"topic": "Music", "confidence": "0.75"}'))
    js = per.agg(F.concat(F.lit("{"), F.concat_ws(",", F.collect_list(F.concat(F.lit('"'), "event_type", F.lit('": '), value))), F.lit("}")).alias("value"))
    return topic_map(js)


# ---- evidence to blocks ------------------------------------------------------------------------


@query(
    "j5_evidence_targets",
    f"""WITH {FIN} SELECT DISTINCT m.user_id, CAST(m.msg_idx AS INTEGER) AS qa_idx, b.block_id FROM msg m JOIN (SELECT user_id, session_no, block_no AS block_id, min(msg_idx) AS a, max(msg_idx) AS z FROM seg GROUP BY ALL) b
        ON b.user_id = m.user_id AND b.session_no = m.session_no AND m.msg_idx BETWEEN b.a AND b.z""".replace("block_no AS block_id", "CAST(block_no AS BIGINT) AS block_id"),
)
def j5(spark, d):
    m = messages(spark, d)
    q = m.groupBy("user_id", F.col("msg_idx").alias("qa_idx")).agg(
        F.collect_list(F.concat(F.lit("D"), "session_no", F.lit(":"), "msg_idx")).alias("evidence")
    )
    return evidence.message_targets(q, finished(spark, d))


@query(
    "j6_session_targets",
    f"""WITH {FIN} SELECT DISTINCT user_id, CAST(1 AS INTEGER) AS qa_idx, CAST(block_no AS BIGINT) AS block_id FROM seg WHERE session_no <= 2""",
)
def j6(spark, d):
    q = finished(spark, d).select("user_id").distinct().select("user_id", F.lit(1).alias("qa_idx"), F.array(F.lit("session_1"), F.lit("session_2"), F.lit("session_1")).alias("answer_session_ids"))
    return evidence.session_targets(q, finished(spark, d))


# ---- scalar functions over whole tables ----------------------------------------------------------


@query("x1_word_sets", """SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN
   ('the','a','an','of','to','in','on','for','and','or','is','are','was','were')))) AS INTEGER) AS n_words FROM documents""")
def x1(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tx.word_set(F.col("text"))).alias("n_words"))


@query("x2_word_sets_long_list", """SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN
   ('the','a','an','of','to','in','on','for','and','or','is','are','was','were','be','been','being','with','by','at','from','that','this','it','as','but','if','about','into','than','then','so','such','not','no','do','does','did')))) AS INTEGER) AS n_words FROM documents""")
def x2(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tx.word_set(F.col("text"), tx.STOP_WORDS_LONG)).alias("n_words"))


@query("x3_word_lists", "SELECT doc_id, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS k FROM documents")
def x3(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(tx.words(F.col("text")), " ")).alias("k"))


TYPE_OF = """CASE o_orderkey % 8 WHEN 0 THEN 'INTENTION' WHEN 1 THEN 'ATTRIBUTE' WHEN 2 THEN 'OCCURRENCE' WHEN 3 THEN 'STATE' WHEN 4 THEN 'OCCURRENCE' WHEN 5 THEN 'INTENTION' WHEN 6 THEN 'STATE' ELSE 'OCCURRENCE' END"""


@query(
    "x6_x7_event_types",
    f"""SELECT o_orderkey, {TYPE_OF} AS inferred, CASE o_orderkey % 4 WHEN 0 THEN 'OCCURRENCE' WHEN 1 THEN 'STATE' WHEN 2 THEN 'INTENTION' ELSE '' END AS coerced,
        CASE WHEN o_orderkey % 4 = 1 THEN {TYPE_OF} WHEN o_orderkey % 4 = 3 THEN {TYPE_OF} ELSE {TYPE_OF} END AS final FROM orders""",
)
def x6(spark, d):
    k = F.col("o_orderkey")
    phrases = ["Customer plans to buy and got married", "Her Name is Ann, she works at Acme", "She moved to Rome and lives in a flat", "He lives in Rome", "Nothing special here",
               "They will be 30 years old", "He is a baker", "She bought bread"]
    desc = F.concat(F.element_at(F.array(*[F.lit(p) for p in phrases]), (k % 8 + 1).cast("int")), F.lit(" #"), k)
    raw = F.element_at(F.array(F.lit("event"), F.lit("as_of"), F.lit(" Planning "), F.lit("other")), (k % 4 + 1).cast("int"))
    return table(spark, d, "orders").select(
        "o_orderkey", ev.infer_event_type(desc).alias("inferred"), ev.coerce_type(raw).alias("coerced"), ev.final_type(raw, desc).alias("final")
    )


@query(
    "x8_x13_written_times",
    """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, o_orderkey % 12 + 1 AS h, o_orderkey % 60 AS mi FROM orders)
       SELECT k, CASE k % 7 WHEN 0 THEN strftime(day, '%Y-%m-%d') || 'T' || lpad(CAST(h % 12 + 12 AS VARCHAR), 2, '0') || ':' || lpad(CAST(mi AS VARCHAR), 2, '0') || ':00'
           WHEN 1 THEN strftime(day, '%Y-%m-%d') WHEN 2 THEN strftime(day, '%Y-%m-%d') || 'T' || lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(mi AS VARCHAR), 2, '0') || ':00'
           WHEN 3 THEN strftime(day, '%Y-%m-%d') || 'T' || lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(mi AS VARCHAR), 2, '0') || ':09'
           WHEN 4 THEN strftime(day, '%Y-%m-%d') WHEN 5 THEN 'Unknown' ELSE 'sometime in ' || year(day) END AS iso,
         CASE k % 7 WHEN 0 THEN 'second' WHEN 1 THEN 'day' WHEN 2 THEN 'second' WHEN 3 THEN 'second' WHEN 4 THEN 'day' WHEN 5 THEN 'unknown' ELSE 'day' END AS granularity,
         CASE WHEN k % 7 IN (5, 6) THEN NULL ELSE day END AS iso_day FROM o""",
)
def x8(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    h, mi = (k % 12 + 1).cast("string"), F.lpad((k % 60).cast("string"), 2, "0")
    forms = [
        F.concat(h, F.lit(":"), mi, F.lit(" pm on "), F.date_format(day, "d MMMM, yyyy")), F.date_format(day, "d MMM, yyyy"),
        F.concat(F.date_format(day, "yyyy/MM/dd"), F.lit(" (Tue) "), F.lpad(h, 2, "0"), F.lit(":"), mi),
        F.concat(F.date_format(day, "MMM dd, yyyy, "), F.lpad(h, 2, "0"), F.lit(":"), mi, F.lit(":09")), F.date_format(day, "MMM dd, yyyy"), F.lit(" unknown"),
        F.concat(F.lit("sometime in "), F.year(day)),
    ]
    text = F.element_at(F.array(*forms), (k % 7 + 1).cast("int"))
    iso = table(spark, d, "orders", spread=True).select("o_orderkey", dt.iso_if_possible(text).alias("iso"))
    return iso.select(F.col("o_orderkey").alias("k"), "iso", dt.granularity(F.col("iso")).alias("granularity"), dt.iso_day(F.col("iso")).alias("iso_day"))


@query(
    "x10_x16_event_lines",
    """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders)
       SELECT k, CASE k % 3 WHEN 0 THEN CAST(day AS TIMESTAMP) - INTERVAL 2 HOUR WHEN 1 THEN CAST(day AS TIMESTAMP) ELSE NULL END AS s,
         CASE k % 3 WHEN 0 THEN CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR WHEN 1 THEN CAST(day AS TIMESTAMP) ELSE NULL END AS e,
         CASE k % 3 WHEN 0 THEN strftime(day, '%Y-%m-%d') || 'T00:00:00+0200' WHEN 1 THEN strftime(day, '%b %d') ELSE 'Unknown' END AS start_time,
         CASE k % 3 WHEN 2 THEN 'no brackets ' || k ELSE 'order ' || k END AS description FROM o""",
)
def x10(spark, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    line = (
        F.when(k % 3 == 0, F.concat(F.lit("* ["), day, F.lit("T00:00:00+0200, "), day, F.lit("T12:00:00Z] order "), k))
        .when(k % 3 == 1, F.concat(F.lit("["), F.date_format("o_orderdate", "MMM dd, yyyy"), F.lit("] order "), k))
        .otherwise(F.concat(F.lit("no brackets "), k))
    )
    bare = F.regexp_replace(line, r"^\* ", "")
    span, parts = dt.bracket_range(line), ev.line_to_event(bare)
    # the line form splits at the first comma, so a "Mon DD, YYYY" date keeps "Mon DD" as its start
    return table(spark, d, "orders").select(
        k.alias("k"), span["start"].cast("timestamp_ntz").alias("s"), span["end"].cast("timestamp_ntz").alias("e"), parts["start_time"].alias("start_time"), parts["description"].alias("description")
    )


@query(
    "x14_calendar_ranges",
    """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders)
       SELECT k, CAST(date_trunc('week', day) AS DATE) AS week_start, CAST(date_trunc('week', day) AS DATE) + 6 AS week_end, CAST(date_trunc('quarter', day) AS DATE) AS quarter_start,
         CAST(date_trunc('quarter', day) + INTERVAL 3 MONTH AS DATE) - 1 AS quarter_end, CAST(day - to_months(CAST(k % 30 AS INTEGER)) AS DATE) AS shifted, last_day(day) AS month_end FROM o""",
)
def x14(spark, d):
    day = F.col("o_orderdate").cast("date")
    w, q = dt.week_range(day), dt.quarter_range(day)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), w[0].alias("week_start"), w[1].alias("week_end"), q[0].alias("quarter_start"), q[1].alias("quarter_end"),
        dt.shift_months(day, -(F.col("o_orderkey") % 30).cast("int")).alias("shifted"), F.last_day(day).alias("month_end"),
    )


@query(
    "x5_x24_labels_and_keys",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'user_preferences' WHEN 1 THEN 'food' WHEN 2 THEN 'misc' ELSE 'personal_details' END AS topic,
         CASE p_partkey % 4 WHEN 0 THEN 'run_' || p_partkey ELSE 'default' END AS run_id, substr(md5(p_name), 1, 12) AS content_key,
         CASE p_partkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'baseline' WHEN 2 THEN 'enhanced' ELSE 'unknown' END AS source,
         CASE p_partkey % 4 WHEN 2 THEN NULL ELSE CAST(p_partkey AS INTEGER) END AS session_no FROM part""",
)
def x5(spark, d):
    k = F.col("p_partkey")
    pick = lambda *xs: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (k % 4 + 1).cast("int"))
    topic = tx.topic_label(pick(" User Preferences!", "loud music and food", "weather", "Personal__Details"))
    run = tx.clean_key(pick(F.concat(F.lit("run / "), k), "", "  ", ""))
    source = tx.prediction_source(pick("/a/retrieval_full.jsonl", "x_Baseline_1.csv", "my_enhanced.v2", "/tmp/other.json"))
    session = tx.session_number(pick(F.concat(F.lit("session_"), k), k.cast("string"), "intro", F.concat(F.lit("c1_session"), k)), trailing=True)
    return table(spark, d, "part").select(
        "p_partkey", topic.alias("topic"), F.regexp_replace(run, "__+", "_").alias("run_id"), tx.content_key(F.col("p_name")).alias("content_key"), source.alias("source"), session.alias("session_no")
    )


@query(
    "x18_x20_names_and_facts",
    """SELECT s_suppkey, 'Ann ' || s_suppkey || '''s dog' AS owner, 'Ann ' || s_suppkey || ' left' AS actor, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ' located_in x' ELSE '' END AS fact,
         CASE WHEN s_suppkey % 2 = 0 THEN 'event_time=2024-01-01 to 2024-01-02, time_source=text' ELSE 'observed_time=2024-02-01' END AS meta FROM supplier""",
)
def x18(spark, d):
    k = F.col("s_suppkey")
    name = ev.persona_name(F.concat(F.lit("Age: 30\nname : Ann "), k, F.lit("; city: Rome")))
    even = k % 2 == 0
    null = F.lit(None).cast("string")
    return table(spark, d, "supplier").select(
        "s_suppkey", ev.with_person(F.lit(" User's dog"), name).alias("owner"), ev.with_person(F.lit("User left "), name).alias("actor"),
        tx.fact_text(F.col("s_name"), F.when(even, F.lit("located_in")), F.lit("x")).alias("fact"),
        tx.time_meta(F.when(even, F.lit("2024-01-01")), F.when(even, F.lit("2024-01-02")), F.lit("2024-02-01"), null, F.when(even, F.lit("text"))).alias("meta"),
    )


@query(
    "x13_question_times",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + to_minutes(CAST(o_orderkey % 60 AS INTEGER)) END AS asked FROM orders""",
)
def x13(spark, d):
    k = F.col("o_orderkey")
    clock = F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    text = F.when(k % 4 == 3, F.concat(F.lit("2023/13/01 (Tue) "), clock)).otherwise(F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" (Tue) "), clock))
    return table(spark, d, "orders").select(k.alias("k"), dt.question_time(text).cast("timestamp_ntz").alias("asked"))


@query(
    "x15_x17_numbers_and_explicit_days",
    """SELECT o_orderkey AS k, CAST(CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 12 WHEN 3 THEN o_custkey ELSE NULL END AS INTEGER) AS n,
         CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE NULL END AS day FROM orders""",
)
def x15(spark, d):
    k = F.col("o_orderkey")
    token = F.element_at(F.array(F.lit("An"), F.lit("few"), F.lit("TWELVE"), F.col("o_custkey").cast("string"), F.lit("many")), (k % 5 + 1).cast("int"))
    text = F.element_at(
        F.array(
            F.concat(F.lit("met on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", again Jan 02, 2001")),
            F.concat(F.lit("met on "), F.date_format("o_orderdate", "MMM dd, yyyy"), F.lit(".")), F.lit("met in 1999"),
        ),
        (k % 3 + 1).cast("int"),
    )
    return table(spark, d, "orders").select(k.alias("k"), dt.number_word(token).alias("n"), dt.explicit_day(text).alias("day"))


@query(
    "j10_event_block_map",
    f"WITH {FIN} SELECT user_id || '_' || block_id || '_e' || i AS event_id, user_id, block_id FROM (SELECT *, unnest([0, 1, 2, 3]) AS i FROM day WHERE NOT bad)",
)
def j10(spark, d):
    b = finished(spark, d)
    lookup = bl.explode_events(b).select("event_id", "user_id", "block_id")
    wanted = bl.explode_events(b).select("event_id")
    return wanted.join(lookup, "event_id").select("event_id", "user_id", "block_id")
