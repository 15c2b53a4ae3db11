"""Run summaries: quality, generation, build, token usage and latency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SCORES = ["f1", "precision", "recall", "accuracy", "bleu"]


def evaluation_summary(scored: DataFrame) -> DataFrame:
    """Overall and per-category means in one pass; ``category`` is null overall."""
    present = [c for c in [*SCORES, "judge_score"] if c in scored.columns]
    means = [F.avg(c).alias(f"avg_{c}") for c in present]
    if "judge_score" in present:
        means += [F.count_if(F.col("judge_score") == 100).alias("judge_correct_count")]
    return scored.rollup("category").agg(
        F.grouping("category").cast("int").alias("is_overall"), F.count(F.lit(1)).alias("count"), *means
    )


def generation_summary(rows: DataFrame, content_tokens: DataFrame, digits: int = 4, token_digits: int = 2) -> DataFrame:
    """Means at four grains (config; config and category; user; user and mode),
    rounded to ``digits`` (token averages to ``token_digits``).

    ``content_tokens(user_id, content_tokens_total)`` gives the denominator of the
    context ratio on the two user grains.
    """
    config = ["ranking_strategy", "metric", "trace_metric", "text_mode", "topn"]
    labelled = rows.withColumn("category", F.coalesce(F.col("category").cast("string"), F.lit("uncategorized"))).withColumn(
        "trace_metric", F.coalesce("trace_metric", F.lit(""))
    )
    cols = [F.col(c) for c in [*config, "category", "user_id"]]
    names = [*config, "category", "user_id"]
    sets = [config, [*config, "category"], ["ranking_strategy", "user_id"], ["ranking_strategy", "user_id", "text_mode"]]
    grouped = labelled.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg("f1"), digits).alias("avg_f1"),
        F.round(F.avg("bleu"), digits).alias("avg_bleu"),
        F.avg("context_tokens").alias("_ctx"),
        F.round(F.avg("generation_latency"), digits).alias("avg_generation_latency"),
    )
    bit = lambda name: F.col("_gid").bitwiseAND(1 << (len(names) - 1 - names.index(name))) != 0
    grain = (
        F.when(bit("user_id") & bit("category"), "config").when(bit("user_id"), "config_category")
        .when(bit("text_mode"), "user").otherwise("user_mode")
    )
    joined = grouped.withColumn("grain", grain).join(content_tokens, "user_id", "left")
    on_user = F.col("grain").startswith("user")
    ratio = F.round(F.col("_ctx") / F.greatest(F.coalesce("content_tokens_total", F.lit(1)), F.lit(1)), digits)
    return joined.select(
        "grain", *names, "count",
        F.when(~on_user, F.col("avg_f1")).alias("avg_f1"), F.when(~on_user, F.col("avg_bleu")).alias("avg_bleu"),
        F.round("_ctx", token_digits).alias("avg_context_tokens"),
        F.when(~on_user, F.col("avg_generation_latency")).alias("avg_generation_latency"),
        F.when(on_user, ratio).alias("avg_context_ratio_over_content"),
    )


def build_summary(blocks: DataFrame, usage: DataFrame) -> DataFrame:
    """One row: blocks, messages, token ratios and model usage per block / message.

    ``blocks(messages, content_tokens, enriched_tokens)``,
    ``usage(calls, prompt, completion, total)`` holding the build stage row.
    """
    b = blocks.agg(
        F.count(F.lit(1)).alias("boxes"),
        F.coalesce(F.sum("messages"), F.lit(0)).alias("total_messages"),
        F.round(F.coalesce(F.avg("messages"), F.lit(0.0)), 3).alias("avg_messages_per_box"),
        F.round(F.coalesce(F.avg(F.col("enriched_tokens") / F.greatest("content_tokens", F.lit(1))), F.lit(0.0)), 3).alias(
            "avg_token_ratio_enriched_over_content"
        ),
        F.coalesce(F.sum("content_tokens"), F.lit(0)).alias("total_content_tokens"),
        F.coalesce(F.sum("enriched_tokens"), F.lit(0)).alias("total_enriched_tokens"),
    )
    u = usage.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"llm_{c}") for c in ("calls", "prompt", "completion", "total")])
    # both sides are one-row aggregates
    joined = b.withColumn("_one", F.lit(1)).join(u.withColumn("_one", F.lit(1)), "_one").drop("_one")
    boxes, msgs = F.greatest("boxes", F.lit(1)), F.greatest("total_messages", F.lit(1))
    per = [F.round(F.col(f"llm_{c}") / d, 3).alias(f"avg_{c}_per_{n}") for c in ("calls", "prompt", "completion", "total") for n, d in (("box", boxes), ("message", msgs))]
    return joined.select("*", *per)


def usage_by_stage(usage: DataFrame) -> DataFrame:
    """Calls and token sums by stage; rows without a stage are not counted."""
    total = F.coalesce("total_tokens", F.col("prompt_tokens") + F.coalesce("completion_tokens", F.lit(0)))
    return usage.filter(F.col("stage").isNotNull()).groupBy("stage").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion"), F.sum(total).alias("total"),
    )


def exact_quantile(df: DataFrame, value: str, q: float, by: Sequence[str] = (), method: str = "linear", name: str | None = None) -> DataFrame:
    """Exact quantile per group, distributed; nulls are not counted.  See :func:`quantiles`."""
    return quantiles(df, value, {name or f"p{int(q * 100)}": (q, method)}, by)


def quantiles(df: DataFrame, value: str, wanted: dict[str, tuple[float, str]], by: Sequence[str] = (), buckets: int = 4096, levels: int = 2) -> DataFrame:
    """Exact quantiles per group, one column per name of ``wanted`` (quantile, method).

    ``linear`` interpolates between neighbours, ``nearest`` takes the sorted value
    at ``clamp(round_half_even(q n) - 1)``, ``floor`` the one at ``int(q n)``.

    Equal values are counted first.  A group's values are then cut into ``buckets`` ranges, first of equal width in
    ``sign(v) ln(1 + |v|)``, so that a few huge values do not press the others into one; running sums over the ranges tell which
    range holds each position.  Each of these is cut again between its own least and greatest value, ``levels`` times in all, and
    only values of the last ranges are put in order: at most a ``buckets ** (levels - 1)``-th of a first range's width each.
    """
    keys = [f"_g{i}" for i in range(max(1, len(by)))]
    groups = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)] if by else [F.lit(0).alias(keys[0])]
    counted = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    span = counted.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"))
    same = lambda left, right: [left[k].eqNullSafe(right[f"_x{k}"]) for k in keys]
    hidden = lambda table: table.withColumnsRenamed({k: f"_x{k}" for k in keys})
    shown = lambda table: table.drop(*(f"_x{k}" for k in keys))
    before = lambda *part: Window.partitionBy(*part[:-1]).orderBy(part[-1]).rowsBetween(Window.unboundedPreceding, -1)
    asks = []
    for name, (q, method) in wanted.items():
        n = F.col("_n")
        if method == "linear":
            at = (n - 1) * F.lit(q)
            low = F.floor(at)
        elif method == "nearest":
            at = low = F.greatest(F.lit(0), F.least(n - 1, F.bround(F.lit(q) * n, 0).cast("bigint") - 1))
        else:
            at = low = F.least(F.floor(F.lit(q) * n), n - 1)
        for step in (0, 1):
            asks.append(F.struct(F.lit(f"{name}/{step}").alias("_name"), F.least(low + step, n - 1).cast("bigint").alias("_pos"), (at - low).cast("double").alias("_frac")))
    # ranges of values with the positions they hold, counted from the range's first value
    chosen = span.select(*keys, "_lo", "_hi", F.array(*asks).alias("_asks"))

    def inside(chosen: DataFrame) -> DataFrame:
        ranges = hidden(chosen)
        return shown(counted.join(ranges, [*same(counted, ranges), counted["_v"] >= ranges["_lo"], counted["_v"] <= ranges["_hi"]]))

    def met(counts: DataFrame, order: str) -> DataFrame:
        """Rows of ``counts`` with each position that falls on them, and what comes before them in their range."""
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before(*keys, "_lo", order)), F.lit(0)))
        here = F.filter("_asks", lambda a: (a["_pos"] >= F.col("_before")) & (a["_pos"] < F.col("_before") + F.col("_c")))
        return counts.withColumn("_ask", F.explode(here)).drop("_asks")

    for level in range(levels):
        scale = (lambda c: F.signum(c) * F.log1p(F.abs(c))) if level == 0 else (lambda c: c)
        v, lo, hi = (scale(F.col(c).cast("double")) for c in ("_v", "_lo", "_hi"))
        part = F.when(hi > lo, F.floor((v - lo) / (hi - lo) * (buckets - 1))).otherwise(0).cast("int")
        ranges = inside(chosen).withColumn("_range", part).groupBy(*keys, "_lo", "_range").agg(F.sum("_c").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.first("_asks").alias("_asks"))
        moved = F.struct(F.col("_ask._name").alias("_name"), (F.col("_ask._pos") - F.col("_before")).alias("_pos"), F.col("_ask._frac").alias("_frac"))
        chosen = met(ranges, "_range").groupBy(*keys, F.col("_least").alias("_lo"), F.col("_most").alias("_hi")).agg(F.collect_list(moved).alias("_asks"))
    hits = met(inside(chosen), "_v").select(*keys, "_v", "_ask._name", "_ask._frac")
    value_at = lambda name: F.max(F.when(F.col("_name") == name, F.col("_v")))
    share = lambda name: F.max(F.when(F.col("_name") == name, F.col("_frac")))
    out = [(value_at(f"{n}/0") + F.when(share(f"{n}/0") > 0, share(f"{n}/0") * (value_at(f"{n}/1") - value_at(f"{n}/0"))).otherwise(0)).alias(n) for n in wanted]
    picked = hits.groupBy(*keys).agg(*out)
    return picked.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=False)), *wanted)


def value_stats(df: DataFrame, value: str, by: Sequence[str] = (), method: str = "linear") -> DataFrame:
    """n, mean, min, max, median and p95 of a latency or size column."""
    base = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    picked = quantiles(df, value, {"median": (0.5, "linear"), "p95": (0.95, method)}, by)
    if not by:
        return base.withColumn("_one", F.lit(1)).join(picked.withColumn("_one", F.lit(1)), "_one").drop("_one")
    other = picked.withColumnsRenamed({c: f"_x{c}" for c in by})
    return base.join(other, [base[c].eqNullSafe(other[f"_x{c}"]) for c in by]).drop(*(f"_x{c}" for c in by))


def distribution(df: DataFrame, columns: Sequence[str], default: str = "NONE") -> DataFrame:
    """Counts by value for several label columns in one pass -> (field, value, n)."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit(default)).alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("_c")).groupBy("_c.field", "_c.value").agg(F.count(F.lit(1)).alias("n"))


def distinct_first(df: DataFrame, key: Sequence[Column], order: str) -> DataFrame:
    """First occurrence per coalesced key, map-side combined."""
    named = [F.coalesce(c.cast("string"), F.lit("")).alias(f"_k{i}") for i, c in enumerate(key)]
    keys = [f"_k{i}" for i in range(len(key))]
    first = df.select(*named, F.struct(*df.columns).alias("_row")).groupBy(*keys).agg(F.min_by("_row", F.col(f"_row.{order}")).alias("_row"))
    return first.select("_row.*")


def content_tokens_by_user(blocks: DataFrame, tokens: Column) -> DataFrame:
    return blocks.groupBy("user_id").agg(F.sum(tokens).alias("content_tokens_total"))
