"""Readers.  Every reader applies a declared schema; drift between old and new
key names is absorbed by coalescing projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.functions.text import topic_label
from timeweave.schema import BLOCK_FILE, CONVERSATION, HAYSTACK, TRACE, VECTOR_FILE

HEX_ID = r"^[0-9a-f]{8}$"


def read_json_records(spark: SparkSession, path: str, schema: str, array_files: bool = False, glob: str | None = None) -> DataFrame:
    """JSON arrays (``array_files``) or JSON lines; malformed lines are skipped.

    Adds ``source_id``, the file name without its extension.
    """
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED")
    if array_files:
        reader = reader.option("multiLine", True)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return reader.json(path).select("*", stem.alias("source_id"))


def read_first_items(spark: SparkSession, path: str, schema: str, array_files: bool = False, glob: str | None = None) -> DataFrame:
    """The first item of every file of JSON arrays or JSON lines, with ``source_id``.

    The order within a file is that of its blocks and of the reader's rows in each; a task ships one row per file it reads."""
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED")
    if array_files:
        reader = reader.option("multiLine", True)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    items = reader.json(path)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    placed = items.select(
        F.struct(*[F.col(f"`{c}`") for c in items.columns], stem.alias("source_id")).alias("item"), F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"),
    )
    return placed.groupBy("file").agg(F.min_by("item", "at").alias("item")).select("item.*")


def read_conversations(spark: SparkSession, path: str, array_files: bool = True, glob: str = "*.json") -> DataFrame:
    """Raw conversations with dynamic session keys; the body stays JSON text."""
    return read_json_records(spark, path, CONVERSATION, array_files, glob)


def read_haystack(spark: SparkSession, path: str, array_files: bool = True, glob: str = "*.json") -> DataFrame:
    return read_json_records(spark, path, HAYSTACK, array_files, glob)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks from JSON lines; rows without a user are dropped."""
    return with_canonical_keys(spark.read.schema(BLOCK_FILE).json(path)).filter(F.col("user_id").isNotNull())


def with_canonical_keys(raw: DataFrame) -> DataFrame:
    """User id as text; block id from the new name, the old one, or 0."""
    block_id = F.coalesce("block_id", "box_id", F.lit(0)).cast("bigint") if "box_id" in raw.columns else F.coalesce("block_id", F.lit(0)).cast("bigint")
    out = raw.withColumn("user_id", F.col("user_id").cast("string")).withColumn("block_id", block_id)
    return out.drop("box_id")


def event_bounds(block_start: Column, box_start: Column, block_end: Column, box_end: Column) -> tuple[Column, Column]:
    """Block event times: new key, old key, the other end, else Unknown."""
    filled = lambda c: F.nullif(c, F.lit(""))
    unknown = F.lit("Unknown")
    return (
        F.coalesce(*[filled(c) for c in (block_start, box_start, block_end, box_end)], unknown),
        F.coalesce(*[filled(c) for c in (block_end, box_end, block_start, box_start)], unknown),
    )


def merge_runs(runs: list[DataFrame], id_pattern: str | None = HEX_ID) -> DataFrame:
    """Union of runs; each user keeps only the blocks of the last listed run that
    has them.  The winner per user is a small aggregate joined back."""
    tagged = [r.withColumn("run_no", F.lit(i)) for i, r in enumerate(runs)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t, allowMissingColumns=True)
    if id_pattern is not None:
        union = union.filter(F.col("user_id").rlike(id_pattern))
    last = union.groupBy("user_id").agg(F.max("run_no").alias("run_no"))
    return union.join(last, ["user_id", "run_no"], "left_semi").drop("run_no")


def explode_questions(conversations: DataFrame, keep_category_5: bool = False) -> DataFrame:
    """One row per question with its position; category 5 is left out by default."""
    rows = conversations.select("user_id", F.posexplode("qa").alias("qa_idx", "q")).select("user_id", "qa_idx", "q.*")
    return rows if keep_category_5 else drop_category_5(rows)


def drop_category_5(questions: DataFrame) -> DataFrame:
    return questions.filter("category is null or category <> 5")


def question_files(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per-question files: 8-hex names, users that have blocks."""
    named = records.filter(F.col("source_id").rlike(HEX_ID)).withColumn("user_id", F.col("source_id"))
    return named.join(blocks.select("user_id").distinct(), "user_id", "left_semi")


def first_conversations(df: DataFrame, ordinal: str, n: int | None) -> DataFrame:
    """First ``n`` by position; none, zero or negative keeps all."""
    return df if n is None or n <= 0 else df.filter(F.col(ordinal) < n)


def remap_users(df: DataFrame, token: str) -> DataFrame:
    """Numeric users of one file -> the file token, suffixed when there are several."""
    many = df.select("source_id", "user_id").distinct().groupBy("source_id").agg(F.count(F.lit(1)).alias("_users"))
    name = F.when(F.col("_users") == 1, F.col(token)).otherwise(F.concat_ws("_", F.col(token), F.col("user_id")))
    return df.join(many, "source_id").withColumn("user_id", name).drop("_users")


def latest_traces(traces: DataFrame, order: str) -> DataFrame:
    """(user, box) -> ids of the trace read last that contains the box."""
    rows = traces.filter(F.col("user_id").isNotNull()).select("user_id", F.explode("box_ids").alias("block_id"), "box_ids", F.col(order).alias("_o"))
    return rows.groupBy("user_id", "block_id").agg(F.max_by("box_ids", "_o").alias("box_ids"))


def first_traces(traces: DataFrame, order: str) -> DataFrame:
    """(user, metric, box) -> entries of the first trace that contains the box."""
    rows = traces.select("user_id", "metric", F.explode("box_ids").alias("block_id"), "entries", F.col(order).alias("_o"))
    return rows.groupBy("user_id", "metric", "block_id").agg(F.min_by("entries", "_o").alias("entries"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE).json(path).withColumn("line_no", F.monotonically_increasing_id())


def ground_truth(documents: DataFrame) -> DataFrame:
    """JSON object keyed by question -> (qa_idx, block_id); a ``ground_truth``
    wrapper is accepted.  ``documents(value)`` holds one object per row."""
    inner = F.coalesce(F.get_json_object("value", "$.ground_truth"), F.col("value"))
    entries = F.from_json(inner, "map<string,struct<block_ids:array<bigint>>>")
    return documents.select(F.explode(entries).alias("qa_idx", "e")).select("qa_idx", F.explode("e.block_ids").alias("block_id"))


def topic_map(documents: DataFrame) -> DataFrame:
    """JSON object of labels (text or ``{topic, confidence}``) -> (key, topic, confidence)."""
    rows = documents.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "v")).filter(F.trim("key") != "")
    parsed = F.from_json("v", "topic string, confidence string")
    structured = F.col("v").startswith("{")
    label = F.when(structured, F.coalesce(F.nullif(parsed["topic"], F.lit("")), F.lit("misc"))).otherwise(F.col("v"))
    return rows.select(
        F.trim("key").alias("key"), topic_label(label).alias("topic"), F.when(structured, parsed["confidence"].try_cast("double")).alias("confidence")
    )


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Long vector table from per-user ``key -> field -> vector`` objects."""
    stores = spark.read.schema(VECTOR_FILE).option("multiLine", True).json(path)
    fields = stores.select("user_id", F.explode("data").alias("owner_key", "fields"))
    return fields.select("user_id", "owner_key", F.explode("fields").alias("field", "embedding"))


def event_vectors(vectors: DataFrame, prefix: str = "graph_event_") -> DataFrame:
    """Vectors stored under the prefix -> (user_id, event_id, embedding)."""
    rows = vectors.filter(F.col("owner_key").startswith(prefix) & (F.col("field") == "event") & (F.size("embedding") > 0))
    named = rows.select("user_id", F.substring("owner_key", len(prefix) + 1, 1 << 30).alias("event_id"), "embedding")
    return named.filter("event_id <> ''")


def unprocessed(files: DataFrame, processed: DataFrame, key: str = "path") -> DataFrame:
    """Files that no earlier run has recorded."""
    return files.join(processed.select(key).distinct(), key, "left_anti")
