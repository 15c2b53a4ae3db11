"""Streaming surface: file ingest, appends, usage counters, gap sessions, linking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from timeweave.operators.graph import LINK_LIMIT, LINK_SCORE
from timeweave.operators.rank import tiled_top_k


def ingest_files(spark: SparkSession, path: str, schema: str, fmt: str = "json", glob: str | None = None, max_files: int = 1000) -> DataFrame:
    """New files of a folder, once each (the checkpoint remembers them)."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(fmt).load(path)


def append_blocks(blocks: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Finished blocks appended as parquet; start it with ``.start()``."""
    return blocks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def usage_counters(usage: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls and tokens by stage and time window, late rows dropped."""
    return (
        usage.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "stage")
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"))
        .select("stage", F.col("w.start").alias("window_start"), "calls", "prompt", "completion")
    )


def gap_sessions(messages: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Sessions of message logs without session ids: a silence longer than ``gap`` ends one.

    On a stream, rows may come in any order within ``late``: a row that falls between two open sessions merges them.  A session is
    emitted once the watermark has passed its end.  Works on batch tables too."""
    return (
        messages.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("messages"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .select("user_id", "first_ts", "last_ts", "messages")
    )


def link_batch(new: DataFrame, stored: DataFrame, threshold: float = LINK_SCORE, limit: int = LINK_LIMIT) -> DataFrame:
    """Edges of new events to stored ones and to earlier new ones.

    ``new`` and ``stored``: ``(user_id, event_id, seq, embedding)`` with ``seq``
    growing in load order.
    """
    ask = new.select("user_id", F.col("event_id").alias("qa_idx"), "seq", "embedding")
    pool = stored.select("user_id", "event_id", "seq", "embedding").unionByName(new.select("user_id", "event_id", "seq", "embedding"))
    best = tiled_top_k(ask, pool.withColumnRenamed("event_id", "block_id"), limit, min_score=threshold, earlier_only=True)
    return best.select("user_id", F.col("qa_idx").alias("a_id"), F.col("block_id").alias("b_id"), "score")


EVENT_SCHEMA = "user_id string, event_id long, seq long, embedding array<double>, batch long"
EDGE_SCHEMA = "user_id string, a_id long, b_id long, score double, batch long"


class LinkStore:
    """Events and edges of a linking stream as Parquet, one folder per micro-batch.

    A batch reads only what earlier batches stored and overwrites its own two folders, so a batch that runs again, whole or after
    it stored the half of its work, leaves the same rows.  Use :meth:`handle` as the ``foreachBatch`` handler.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float = LINK_SCORE, limit: int = LINK_LIMIT) -> None:
        self.spark, self.path, self.threshold, self.limit = spark, path.rstrip("/"), threshold, limit
        for name, schema in (("events", EVENT_SCHEMA), ("edges", EDGE_SCHEMA)):
            # a folder without rows, so that the first batch has something to read
            spark.createDataFrame([], schema).drop("batch").write.mode("overwrite").parquet(f"{self.path}/{name}/batch=-1")

    def events(self) -> DataFrame:
        """Stored events with the batch that brought them."""
        return self.spark.read.schema(EVENT_SCHEMA).parquet(f"{self.path}/events")

    def edges(self) -> DataFrame:
        return self.spark.read.schema(EDGE_SCHEMA).parquet(f"{self.path}/edges")

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        """Link the events of a micro-batch to stored and earlier ones, then store them.  An event that an earlier batch stored, or
        that the batch holds twice, counts once."""
        older = self.events().filter(F.col("batch") < batch_id).drop("batch")
        columns = [F.col("user_id").cast("string"), F.col("event_id").cast("long"), F.col("seq").cast("long"), F.col("embedding").cast("array<double>")]
        new = batch.select(*columns).dropDuplicates(["user_id", "event_id"]).join(older.select("user_id", "event_id"), ["user_id", "event_id"], "left_anti")
        mine = f"{self.path}/events/batch={batch_id}"
        new.write.mode("overwrite").parquet(mine)  # once: linking reads the stored rows
        stored = self.spark.read.schema(new.schema).parquet(mine)
        known = older.join(stored.select("user_id").distinct(), "user_id", "left_semi")
        link_batch(stored, known, self.threshold, self.limit).write.mode("overwrite").parquet(f"{self.path}/edges/batch={batch_id}")


def link_stream(events: DataFrame, store: LinkStore, checkpoint: str) -> DataStreamWriter:
    """Edges of a stream of ``(user_id, event_id, seq, embedding)`` while it arrives; start it with ``.start()``."""
    return events.writeStream.foreachBatch(store.handle).option("checkpointLocation", checkpoint)
