"""Streaming operators run to completion over driver tables."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from timeweave.catalog.fixtures import BLK, blocks, with_sql
from timeweave.catalog.graph import EDGES
from timeweave.catalog.registry import query, table
from timeweave.session import shared_folder
from timeweave.streaming import jobs
from timeweave.streaming.segmentation import late_messages, segment_stream, started, user_blocks


def _scratch(spark):
    """A new folder under the one that ``spark.checkpoint.dir`` names."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


FILES = 4


def _arrivals(spark, base, parts):
    """A stream that gets the tables ``parts`` one after the other, a micro-batch each."""
    schema = parts[0].schema
    for part in parts:
        part.select(*schema.names).repartition(FILES).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{base}/in")


def _events_stream(spark, d):
    raw = jobs.ingest_files(spark, d, table(spark, d, "events").schema, "parquet", glob="events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(stream, spark, mode="append"):
    """Run a stream over all available files and return what it wrote."""
    base = _scratch(spark)
    jobs.append_blocks(stream, f"{base}/out", f"{base}/ckpt").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("st1_file_ingest", "SELECT event_id, event_type, value FROM events")
def st1(spark, d):
    return _drain(_events_stream(spark, d).select("event_id", "event_type", "value"), spark)


HELD = "(CAST(conv_id AS BIGINT) * 31 + turn) % 11 = 0"


@query(
    "st2_st3_segment_stream",
    f"""WITH m AS (SELECT CAST(conv_id AS VARCHAR) AS user_id, CAST(turn // 3 + 1 AS INTEGER) AS so, CAST(turn % 3 + 1 AS INTEGER) AS idx, length(text) % 3 = 0 AS split, {HELD} AS held FROM conversations),
       r AS (SELECT *, row_number() OVER (PARTITION BY user_id, so ORDER BY idx) AS rn FROM m WHERE NOT held),
       f AS (SELECT *, split OR rn = 1 AS flag FROM r),
       c AS (SELECT *, flag AND (rn - coalesce(max(CASE WHEN NOT flag THEN rn END) OVER (PARTITION BY user_id, so ORDER BY rn ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS opens FROM f),
       b AS (SELECT *, CAST(sum(CAST(opens AS INTEGER)) OVER (PARTITION BY user_id, so ORDER BY rn) AS BIGINT) AS block_no FROM c),
       g AS (SELECT user_id, so, block_no, min(idx) AS start_idx, max(idx) AS end_idx, CAST(count(*) AS INTEGER) AS messages FROM b GROUP BY ALL)
       SELECT user_id, 'session_' || so AS session_id, block_no, CAST(sum(1) OVER (PARTITION BY user_id ORDER BY so, block_no) AS BIGINT) AS user_block_no, start_idx, end_idx, messages,
         CASE WHEN block_no = max(block_no) OVER (PARTITION BY user_id, so) THEN 'idle' ELSE 'split' END AS sealed_by FROM g
       UNION ALL SELECT user_id, 'session_' || so, NULL, NULL, idx, idx, 1, 'late' FROM m WHERE held""",
)
def st2(spark, d):
    """Messages up to the fifth turn, the others, a closing message that moves the watermark on, then those held back: they are late."""
    c = table(spark, d, "conversations")
    order = (F.floor(F.col("turn") / 3) + 1).cast("int")
    m = c.select(
        F.col("conv_id").cast("string").alias("user_id"), order.alias("session_order"), F.concat(F.lit("session_"), order).alias("session_id"),
        (F.col("turn") % 3 + 1).cast("int").alias("msg_idx"), "role", "text", (F.length("text") % 3 == 0).alias("split"),
        F.timestamp_seconds(F.col("turn") * 60 + 1_700_000_000).alias("msg_ts"), F.expr(HELD).alias("held"), "turn",
    )
    end = spark.range(1).selectExpr("'' AS user_id", "1 AS session_order", "'end' AS session_id", "1 AS msg_idx", "'' AS role", "'' AS text", "false AS split", "timestamp'2100-01-01' AS msg_ts")
    parts = [m.filter("NOT held AND turn < 5"), m.filter("NOT held AND turn >= 5"), end, m.filter("held")]
    base = _scratch(spark)
    for part in parts:  # each run goes on from the state that the one before left
        stream = _arrivals(spark, base, [part.select(*end.columns)])
        out = segment_stream(stream, idle="10 minutes", late="0 seconds")
        writer = jobs.append_blocks(out, f"{base}/out", f"{base}/ckpt").trigger(availableNow=True)
        started(spark, writer).awaitTermination()
    found = spark.read.schema(out.schema).parquet(f"{base}/out").filter("user_id <> ''")
    columns = ["user_id", "session_id", "block_no", "user_block_no", "start_idx", "end_idx", "messages", "sealed_by"]
    late = late_messages(found).withColumn("user_block_no", F.lit(None).cast("bigint"))
    return user_blocks(found).select(*columns).unionByName(late.select(*columns))


@query(
    "st5_usage_counters",
    """WITH w AS (SELECT event_type AS stage, date_trunc('hour', ts) AS window_start, event_id FROM events)
       SELECT stage, window_start, count(*) AS calls, CAST(sum(event_id % 100) AS BIGINT) AS prompt, CAST(sum(event_id % 10) AS BIGINT) AS completion FROM w
       WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL""",
)
def st5(spark, d):
    i = F.col("event_id")
    usage = _events_stream(spark, d).select("ts", F.col("event_type").alias("stage"), (i % 100).alias("prompt_tokens"), (i % 10).alias("completion_tokens"))
    out = _drain(jobs.usage_counters(usage), spark)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "st6_gap_sessions",
    """WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 12 HOUR, TRUE) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       s AS (SELECT *, sum(CAST(n AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
       SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS messages FROM s GROUP BY user_id, s""",
)
def st6(spark, d):
    """Rows arrive up to 23 hours after their time, so each arrival reaches back into sessions of the ones before."""
    ev = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("event_id") % 24 * 3600).alias("at"))
    span = ev.agg(F.min("at").alias("low"), F.max("at").alias("high"))
    placed = ev.withColumn("one", F.lit(1)).join(F.broadcast(span.withColumn("one", F.lit(1))), "one")
    placed = placed.withColumn("part", F.floor((F.col("at") - F.col("low")) * 5 / (F.col("high") - F.col("low") + 1)))
    end = spark.range(1).select(F.lit(None).cast(ev.schema["user_id"].dataType).alias("user_id"), F.lit("2100-01-01").cast("timestamp").alias("ts"))
    base = _scratch(spark)
    stream = _arrivals(spark, base, [*(placed.filter(F.col("part") == k).select("user_id", "ts") for k in range(5)), end])
    out = jobs.gap_sessions(stream, late="1 day")
    jobs.append_blocks(out, f"{base}/out", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(out.schema).parquet(f"{base}/out").filter("user_id IS NOT NULL")
    return found.select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "messages")


@query("st4_link_new_events", with_sql(BLK, EDGES) + "SELECT user_id, a_id, b_id, score FROM edges")
def st4(spark, d):
    """Events arrive in four batches by id; the third fails once when its events are stored and its edges are not, and runs again."""
    ev = blocks(spark, d).select("user_id", F.col("block_id").alias("event_id"), F.col("block_id").alias("seq"), F.col("embedding").cast("array<double>").alias("embedding"))
    last = ev.agg(F.max("event_id").alias("last")).withColumn("one", F.lit(1))
    placed = ev.withColumn("one", F.lit(1)).join(F.broadcast(last), "one").withColumn("part", F.floor(F.col("event_id") * 4 / (F.col("last") + 1)))
    base = _scratch(spark)
    stream = _arrivals(spark, base, [placed.filter(F.col("part") == k).select(*ev.columns) for k in range(4)])
    store = jobs.LinkStore(spark, f"{base}/store", threshold=0.3)
    failed = []

    def handle(batch, batch_id):
        if batch_id == 2 and not failed:
            failed.append(batch_id)
            batch.limit(1).write.mode("overwrite").parquet(f"{base}/store/events/batch=2")
            raise RuntimeError("a batch that fails half way")
        store.handle(batch, batch_id)

    for _ in range(2):
        running = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
        try:
            running.awaitTermination()
            break
        except StreamingQueryException:
            if not failed:
                raise
    return store.edges().select("user_id", "a_id", "b_id", "score")
