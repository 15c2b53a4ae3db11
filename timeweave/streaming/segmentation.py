"""Segmentation of arriving messages as a stateful stream, one state per session."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

OUT_SCHEMA = (
    "user_id string, session_id string, session_order int, block_no bigint, start_idx int, end_idx int, messages int, content_text string, sealed_by string"
)
STATE_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("block_no", "start_idx", "end_idx", "messages", "session_order")])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LINE_SCHEMA = T.StructType([T.StructField("line", T.StringType())])
LATE = "late"


def openings(split: np.ndarray, held: int) -> list[int]:
    """Places of messages that open a block, when the open block holds ``held`` messages: the first of a session, and one that asks
    for a split once the block has two."""
    asks = np.flatnonzero(split)
    out = [0] if held == 0 else []
    ready = 2 if held == 0 else max(0, 2 - held)
    while True:
        at = np.searchsorted(asks, ready)
        if at == len(asks):
            return out
        out.append(int(asks[at]))
        ready = out[-1] + 2


class BlockSegmenter(StatefulProcessor):
    """State: header of the open block plus its lines as a list state, so an update
    appends lines instead of rewriting the block.  A block is emitted when it is
    sealed: by a split, or after ``idle_ms`` without messages.  A message behind the
    watermark is emitted as a row of its own, ``sealed_by`` late, and changes no state."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE_SCHEMA)
        self.lines = handle.getListState("lines", LINE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        batch, now = pd.concat(frames).sort_values(["msg_idx"], kind="stable"), timerValues.getCurrentWatermarkInMs()
        lines = batch["role"].fillna("") + ": " + batch["text"].fillna("")
        behind = (batch["ts_ms"] < now).to_numpy()
        if behind.any():
            late = batch[behind]
            yield self._rows(key, late["session_order"], None, late["msg_idx"], late["msg_idx"], 1, lines[behind], LATE)
        if behind.all():
            return
        batch, lines = batch[~behind], lines[~behind].tolist()
        idx = batch["msg_idx"].to_numpy()
        number, start, end, held, order = self.open.get() if self.open.exists() else (0, 0, 0, 0, int(batch["session_order"].iloc[0]))
        opens = openings(batch["split"].fillna(False).to_numpy(bool), held)
        cuts = [*([0] if held else []), *opens, len(idx)]  # parts of the batch: the rest of the open block, then new ones
        blocks = []
        stored = [r[0] for r in self.lines.get()] if held and opens and self.lines.exists() else []
        for k in range(len(cuts) - 1):
            a, b = cuts[k], cuts[k + 1]
            if k or not held:
                number, start, held, stored = number + 1, int(idx[a]), 0, []
            if b > a:
                end = int(idx[b - 1])
            held += b - a
            blocks.append((number, start, end, held, stored + lines[a:b]))
        sealed, last = blocks[:-1], blocks[-1]
        self.open.update((*(int(x) for x in last[:4]), int(order)))
        if sealed:
            self.lines.clear()
        self.lines.appendList([(line,) for line in lines[cuts[-2] :]])
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(batch["ts_ms"].max()), now) + self.idle_ms)
        if sealed:
            numbers, starts, ends, counts, texts = zip(*sealed, strict=True)
            yield self._rows(key, order, numbers, starts, ends, counts, ["\n".join(t) for t in texts], "split")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        block = self.open.get() if self.open.exists() else None
        if block and block[3] > 0:
            number, start, end, held, order = block
            text = "\n".join(r[0] for r in self.lines.get())
            self.lines.clear()
            self.open.update((number, start, end, 0, order))
            yield self._rows(key, order, [number], [start], [end], [held], [text], "idle")

    @staticmethod
    def _rows(key, order, numbers, starts, ends, counts, texts, reason) -> pd.DataFrame:
        columns = {"start_idx": starts, "end_idx": ends, "messages": counts, "content_text": texts}
        out = pd.DataFrame({c: v.to_numpy() if isinstance(v, pd.Series) else v for c, v in columns.items()})
        order = order.to_numpy() if isinstance(order, pd.Series) else order
        out = out.assign(user_id=key[0], session_id=key[1], session_order=order, block_no=pd.array([None] * len(out) if numbers is None else numbers, "Int64"), sealed_by=reason)
        return out[["user_id", "session_id", "session_order", "block_no", "start_idx", "end_idx", "messages", "content_text", "sealed_by"]]

    def close(self) -> None:
        pass


def segment_stream(messages: DataFrame, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Streaming blocks, numbered within their session by a running count.

    ``messages(user_id, session_order, session_id, msg_idx, role, text, split, msg_ts)``.  State is kept per session, so one user's
    log is as parallel as its sessions.  Messages later than the watermark come out as rows ``sealed_by`` late, see :func:`late_messages`;
    rows without a time, user or session are refused, see :func:`refused`.

    Several state variables per key need the RocksDB state store: start the query with :func:`started`.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    timed = messages.filter(~refused()).withWatermark("msg_ts", late).withColumn("ts_ms", F.unix_millis("msg_ts"))
    # without the time column itself, so that late rows reach the state machine and are counted there
    keyed = timed.select("user_id", "session_id", "session_order", "msg_idx", "role", "text", "split", "ts_ms")
    return keyed.groupBy("user_id", "session_id").transformWithStateInPandas(
        statefulProcessor=BlockSegmenter(idle_ms), outputStructType=OUT_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


def refused():
    """Messages that no state can take."""
    return F.col("msg_ts").isNull() | F.col("user_id").isNull() | F.col("session_id").isNull() | F.col("msg_idx").isNull()


def late_messages(out: DataFrame) -> DataFrame:
    """Messages of a segmented stream that came behind the watermark."""
    return out.filter(F.col("sealed_by") == LATE)


def late_counts(out: DataFrame) -> DataFrame:
    """(user_id, late) of a segmented stream."""
    return late_messages(out).groupBy("user_id").agg(F.count(F.lit(1)).alias("late"))


def user_blocks(out: DataFrame) -> DataFrame:
    """The blocks of a segmented stream with ``user_block_no``, running over the sessions of a user: sessions are counted, not rows ordered."""
    blocks = out.filter(F.col("sealed_by") != LATE)
    before = Window.partitionBy("user_id").orderBy("session_order", "session_id").rowsBetween(Window.unboundedPreceding, -1)
    sessions = blocks.groupBy("user_id", "session_order", "session_id").agg(F.max("block_no").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return blocks.join(sessions.drop("_n"), ["user_id", "session_order", "session_id"]).withColumn("user_block_no", F.col("_before") + F.col("block_no")).drop("_before")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store for queries started inside; the session's own setting is put back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def started(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Start a stream that keeps several state variables."""
    with rocksdb_state(spark):
        return writer.start()
