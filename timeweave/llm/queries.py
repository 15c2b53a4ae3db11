"""The operators as registered queries on the driver tables, with check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm import check_sql, decontam, html_main, licenses, mixing, negatives, neardup, runs, secret_scan, sharding, suffix_tree, token_orc, url_cascade
from timeweave.llm import quality as quality_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_digest(values: Column) -> Column:
    return F.sha2(F.array_join(values, ","), 256)


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), joined_digest(F.col("items")).alias("items_sha256"), "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"),
    )


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, sf_dir, "documents"))


@query
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan(table(spark, sf_dir, "documents"))
    return found.withColumn("target", F.round("target", 4)).withColumn("shards", F.array_join(F.col("shards").cast("array<string>"), ","))


@query
def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return placed.select("doc.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_table(spark))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("novel"))


@query
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


@query
def op7_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


#: Site names of the block list.
BLOCKED_SITES = ("adult-x", "casino-win", "free-bets", "spam-farm")


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge(table(spark, sf_dir, "pages"), BLOCKED_SITES).drop("listed")


@query
def op11_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = token_orc.TokenFiles(token_orc.public_vocabulary("word_bpe_49k.json"))
    return token_orc.round_trip(table(spark, sf_dir, "documents"), options)


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0, label=label)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents with the contract's periodic tails: where crc32(id) ends in 0, word i from a on becomes word a + (i - a) % p."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0))))
    rows = rows.withColumn("a", F.when(F.size("w") > 0, F.col("g") % F.size("w")))
    rows = rows.withColumn("p", F.lit(1) + F.floor((F.size("w") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    source = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(source, " ")).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.runs(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    found = found.withColumn("top", F.when(F.size("runs") > 0, longest))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.n")).alias("length"), F.col("top.period").alias("period"),
        F.floor(1000 * -F.col("top.n") / F.col("top.period")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


CHECK_SQL |= {
    "op1_license_scan": check_sql.license_sql(),
    "op2_decontaminate": check_sql.contamination_sql(),
    "op8_mix_sources": check_sql.mix_sql(),
    "op10_url_filter": check_sql.url_sql(BLOCKED_SITES),
    "op12_hard_negatives": check_sql.negatives_sql(),
    "op13_periodic_runs": check_sql.runs_sql(),
}
