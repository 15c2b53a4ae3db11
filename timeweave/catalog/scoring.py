"""Evidence metrics, answer metrics and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.catalog.fixtures import BLK, QRY, blocks, gold, questions, with_sql
from timeweave.catalog.pools import TOP5
from timeweave.catalog.registry import query, table
from timeweave.catalog.stem_sql import stems
from timeweave.functions.text import token_count
from timeweave.operators import answers, evidence, rank, stats

KEY = ["user_id", "qa_idx"]

PER_Q = """ng AS (SELECT user_id, qa_idx, count(DISTINCT block_id) AS n_gold FROM gold GROUP BY ALL),
  fd AS (SELECT r.user_id, r.qa_idx, count(*) AS n_found, min(r.rank) AS f, max(r.rank) AS l FROM ranked r JOIN gold g USING (user_id, qa_idx, block_id) WHERE r.rank <= 5 GROUP BY ALL),
  perq AS (SELECT q.user_id, q.qa_idx, q.tc_type, CASE WHEN n_gold IS NOT NULL THEN coalesce(1.0 / f, 0.0) END AS first_rr,
     CASE WHEN n_gold IS NOT NULL THEN CASE WHEN coalesce(n_found, 0) = n_gold THEN n_gold / l ELSE 0.0 END END AS complete_mrr,
     CASE WHEN n_gold IS NOT NULL THEN CASE WHEN coalesce(n_found, 0) > 0 THEN 1 ELSE 0 END END AS hit,
     coalesce(n_found, 0) / n_gold AS recall FROM qry q LEFT JOIN ng USING (user_id, qa_idx) LEFT JOIN fd USING (user_id, qa_idx))"""
# the gold blocks other than the question's own vector; some questions have none, which shows both denominators
NEAR_GOLD = """gold AS (SELECT q.user_id, q.qa_idx, b.block_id FROM qry q JOIN blk b ON q.user_id = b.user_id
  AND abs(q.qa_idx - b.block_id) <= 20 AND q.qa_idx <> b.block_id)"""


def near_gold(spark, d):
    return gold(spark, d).filter("qa_idx <> block_id")


def _per_question(spark, d):
    q = questions(spark, d)
    ranked = rank.tiled_top_k(q, blocks(spark, d), 5)
    return evidence.question_metrics(ranked, near_gold(spark, d), q)



@query(
    "m9_m11_question_metrics",
    with_sql(BLK, QRY, NEAR_GOLD, TOP5, PER_Q)
    + "SELECT user_id, qa_idx, round(first_rr, 6) AS first_rr, round(complete_mrr, 6) AS complete_mrr, CAST(hit AS INTEGER) AS hit, round(recall, 6) AS recall FROM perq",
)
def m9(spark, d):
    return _per_question(spark, d).select(
        *KEY, F.round("first_rr", 6).alias("first_rr"), F.round("complete_mrr", 6).alias("complete_mrr"), "hit", F.round("recall", 6).alias("recall")
    )


SUMMARY = """round(coalesce(avg(first_rr), 0), 6) AS first_relevant_mrr, round(coalesce(avg(complete_mrr), 0), 6) AS complete_mrr,
  round(coalesce(sum(hit), 0) / count(*), 6) AS hit_at_k, round(coalesce(avg(recall), 0), 6) AS recall_at_k, count(*) AS total_queries, count(first_rr) AS queries_with_targets"""


def _rounded(df):
    names = ["first_relevant_mrr", "complete_mrr", "hit_at_k", "recall_at_k"]
    return df.select(*[c for c in df.columns if c not in names], *[F.round(c, 6).alias(c) for c in names])


@query("m11_run_summary", with_sql(BLK, QRY, NEAR_GOLD, TOP5, PER_Q) + f"SELECT user_id, {SUMMARY} FROM perq GROUP BY user_id")
def m11(spark, d):
    return _rounded(evidence.summarize_metrics(_per_question(spark, d), "user_id"))


@query(
    "m12_temporal_subsets",
    with_sql(BLK, QRY, NEAR_GOLD, TOP5, PER_Q)
    + f"""SELECT 'point_range' AS subset, {SUMMARY} FROM perq WHERE tc_type IN ('POINT','RANGE')
          UNION ALL SELECT 'any_temporal' AS subset, {SUMMARY} FROM perq WHERE tc_type <> 'NONE'""",
)
def m12(spark, d):
    per_q, run = _per_question(spark, d), questions(spark, d)
    parts = [evidence.subset_metrics(per_q, run, s).withColumn("subset", F.lit(s)) for s in ("point_range", "any_temporal")]
    return _rounded(parts[0].unionByName(parts[1]))


@query(
    "m14_compare_runs",
    with_sql(BLK, QRY, NEAR_GOLD, TOP5, PER_Q)
    + """, late AS (SELECT q.user_id, q.qa_idx, q.block_id, CAST(row_number() OVER (PARTITION BY q.user_id, q.qa_idx ORDER BY q.score DESC, q.block_id) AS INTEGER) AS rank
             FROM scored q JOIN blk b USING (user_id, block_id) WHERE b.block_id <= q.qa_idx),
         lf AS (SELECT r.user_id, r.qa_idx, count(*) AS n FROM late r JOIN gold g USING (user_id, qa_idx, block_id) WHERE r.rank <= 5 GROUP BY ALL)
       SELECT count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses, count(*) FILTER (a = b) AS ties FROM
         (SELECT round(coalesce(fd.n_found, 0) / n_gold, 9) AS b, round(coalesce(lf.n, 0) / n_gold, 9) AS a FROM qry q LEFT JOIN ng USING (user_id, qa_idx)
          LEFT JOIN fd USING (user_id, qa_idx) LEFT JOIN lf USING (user_id, qa_idx))""",
)
def m14(spark, d):
    """A run that sees earlier blocks only against the run over all blocks."""
    q, b = questions(spark, d), blocks(spark, d)
    earlier = rank.tiled_top_k(q.withColumn("seq", F.col("qa_idx") + 1), b.withColumn("seq", F.col("block_id")), 5, earlier_only=True)
    runs = [evidence.question_metrics(r, near_gold(spark, d), q).select(*KEY, F.round("recall", 9).alias("m")) for r in (earlier, rank.tiled_top_k(q, b, 5))]
    return evidence.compare_runs(runs[1], runs[0], "m")


# ---- answers: each benchmark item answered by the next one --------------------------------

PRED = """pred AS (SELECT b.item_id, CAST(1 + b.item_id % 5 AS INTEGER) AS category,
    CASE WHEN b.item_id % 8 = 0 THEN b.text WHEN b.item_id % 9 = 1 THEN 'Sorry, no information available.' ELSE p.text END AS pred,
    CASE WHEN b.item_id % 5 = 2 THEN b.text || '; or so' ELSE b.text END AS gold
  FROM benchmark b JOIN benchmark p ON p.item_id = (b.item_id + 1) % (SELECT count(*) FROM benchmark))"""
#: SQL twin of answer normalisation on ASCII letters and punctuation.
TOK = (
    "list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), "
    "lambda t: t NOT IN ('', 'a', 'an', 'the', 'and'))"
)


def predictions(spark, d):
    b = table(spark, d, "benchmark")
    n = b.agg(F.count(F.lit(1)).alias("n"))
    nxt = b.select(F.col("item_id").alias("_next"), F.col("text").alias("_p"))
    size = n.withColumn("_one", F.lit(1))
    j = b.withColumn("_one", F.lit(1)).join(size, "_one").withColumn("_next", (F.col("item_id") + 1) % F.col("n")).join(nxt, "_next")
    i = F.col("item_id")
    return j.select(
        "item_id", (i % 5 + 1).cast("int").alias("category"),
        F.when(i % 8 == 0, F.col("text")).when(i % 9 == 1, "Sorry, no information available.").otherwise(F.col("_p")).alias("pred"),
        F.when(i % 5 == 2, F.concat("text", F.lit("; or so"))).otherwise(F.col("text")).alias("gold"),
    )


def _f1(p, r):
    return f"CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE 2 * {p} * {r} / ({p} + {r}) END"


def _overlap_sql(source: str, keys: str, pred: str, gold: str) -> str:
    """CTEs tok_* and ov(keys, n_pred, n_gold, n_same) over token lists."""
    return f"""tk AS (SELECT {keys}, t, sum(p) AS p, sum(g) AS g FROM (
        SELECT {keys}, unnest({pred}) AS t, 1 AS p, 0 AS g FROM {source} UNION ALL SELECT {keys}, unnest({gold}) AS t, 0 AS p, 1 AS g FROM {source}) GROUP BY ALL),
      ov AS (SELECT {keys}, sum(p) AS n_pred, sum(g) AS n_gold, sum(least(p, g)) AS n_same FROM tk GROUP BY ALL),
      sc AS (SELECT {keys}, CASE WHEN n_same = 0 THEN 0.0 ELSE n_same / n_pred END AS p, CASE WHEN n_same = 0 THEN 0.0 ELSE n_same / n_gold END AS r FROM ov)"""


def _stemmed_sql(source: str, keys: str, pred: str, gold: str) -> str:
    """As :func:`_overlap_sql`, tokens compared by stem."""
    plain = _overlap_sql(source, keys, pred, gold)
    first, rest = plain.split("ov AS (", 1)
    first = first.replace("tk AS (", "raw AS (", 1)
    return f"{first}{stems('raw')}, tk AS (SELECT {keys}, stem, sum(p) AS p, sum(g) AS g FROM raw JOIN stems USING (t) GROUP BY ALL), ov AS ({rest}"


@query(
    "m1_stemmed_f1",
    f"WITH {PRED}, {_stemmed_sql('pred', 'item_id', TOK.format(x='pred'), TOK.format(x='gold'))} "
    f"SELECT item_id, round(coalesce({_f1('p', 'r')}, 0), 6) AS f1 FROM pred LEFT JOIN sc USING (item_id)",
)
def m1(spark, d):
    return answers.single_answer(predictions(spark, d), ["item_id"]).select("item_id", F.round("f1", 6).alias("f1"))


@query(
    "m2_plain_precision_recall",
    f"WITH {PRED}, {_overlap_sql('pred', 'item_id', TOK.format(x='pred'), TOK.format(x='gold'))} "
    f"SELECT item_id, round(p, 6) AS precision, round(r, 6) AS recall, round({_f1('p', 'r')}, 6) AS f1 FROM sc",
)
def m2(spark, d):
    out = answers.single_answer(predictions(spark, d), ["item_id"], stemmed=False)
    return out.select("item_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


ITEMS = f"""it AS (SELECT item_id, g.pos AS gp, g.item AS gi, p.pos AS pp, p.item AS pi FROM
    (SELECT item_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS item FROM (SELECT item_id, list_transform(string_split(gold, ','), lambda x: trim(x)) AS l FROM pred)) g
    JOIN (SELECT item_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS item FROM (SELECT item_id, list_transform(string_split(pred, ','), lambda x: trim(x)) AS l FROM pred)) p USING (item_id))"""


@query(
    "m3_m4_multi_answer",
    f"WITH {PRED}, {ITEMS}, {_overlap_sql('it', 'item_id, gp, pp', TOK.format(x='pi'), TOK.format(x='gi'))}, "
    f"al AS (SELECT it.item_id, it.gp, it.pp, coalesce(p, 0) AS p, coalesce(r, 0) AS r, coalesce({_f1('p', 'r')}, 0) AS f FROM it LEFT JOIN sc USING (item_id, gp, pp)), "
    "bs AS (SELECT *, row_number() OVER (PARTITION BY item_id, gp ORDER BY round(f, 12) DESC, pp) AS rn FROM al) "
    "SELECT item_id, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1 FROM bs WHERE rn = 1 GROUP BY item_id",
)
def m3(spark, d):
    out = answers.multi_answer(predictions(spark, d), ["item_id"], stemmed=False)
    return out.select("item_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "m5_exact_match",
    f"""WITH {PRED} SELECT item_id, array_to_string({TOK.format(x='pred')}, ' ') = array_to_string({TOK.format(x='gold')}, ' ') AS single,
        list_sort(list_distinct(list_transform(list_filter(string_split(pred, ','), lambda x: trim(x) <> ''), lambda y: array_to_string({TOK.format(x='y')}, ' ')))) =
        list_sort(list_distinct(list_transform(list_filter(string_split(gold, ','), lambda x: trim(x) <> ''), lambda y: array_to_string({TOK.format(x='y')}, ' ')))) AS multi FROM pred""",
)
def m5(spark, d):
    p = predictions(spark, d)
    return p.select(
        "item_id", answers.exact_single(F.col("pred"), F.col("gold")).alias("single"), answers.exact_multi(F.col("pred"), F.col("gold")).alias("multi")
    )


#: One row for each pair of answers that is compared: whole answers, or the items of category 1.
ASKED = """asked AS (SELECT item_id, category, pred, CASE WHEN category = 3 THEN trim(split_part(gold, ';', 1)) ELSE gold END AS gold FROM pred),
    cut AS (SELECT item_id, CASE WHEN category = 1 THEN string_split(pred, ',') ELSE [pred] END AS ps, CASE WHEN category = 1 THEN string_split(gold, ',') ELSE [gold] END AS gs FROM asked WHERE category < 5),
    it AS (SELECT * FROM (SELECT item_id, unnest(range(1, len(gs) + 1)) AS gp, unnest(list_transform(gs, lambda x: trim(x))) AS gi FROM cut)
      JOIN (SELECT item_id, unnest(range(1, len(ps) + 1)) AS pp, unnest(list_transform(ps, lambda x: trim(x))) AS pi FROM cut) USING (item_id))"""
LISTED = "list_sort(list_distinct(list_transform(list_filter(string_split({c}, ','), lambda x: trim(x) <> ''), lambda y: array_to_string({t}, ' '))))"
TOLD = "list_has_any([contains(lower(pred), 'no information available'), contains(lower(pred), 'not mentioned')], [TRUE])"


@query(
    "m6_score_by_category",
    f"WITH {PRED}, {ASKED}, {_stemmed_sql('it', 'item_id, gp, pp', TOK.format(x='pi'), TOK.format(x='gi'))}, "
    f"al AS (SELECT it.item_id, it.gp, it.pp, coalesce(p, 0) AS p, coalesce(r, 0) AS r, coalesce({_f1('p', 'r')}, 0) AS f FROM it LEFT JOIN sc USING (item_id, gp, pp)), "
    "bs AS (SELECT *, row_number() OVER (PARTITION BY item_id, gp ORDER BY round(f, 12) DESC, pp) AS rn FROM al), "
    "ms AS (SELECT item_id, avg(p) AS p, avg(r) AS r, avg(f) AS f FROM bs WHERE rn = 1 GROUP BY item_id) "
    f"SELECT item_id, category, round(CASE WHEN category = 5 THEN CAST({TOLD} AS DOUBLE) ELSE f END, 6) AS f1, round(CASE WHEN category = 5 THEN CAST({TOLD} AS DOUBLE) ELSE p END, 6) AS precision, "
    f"round(CASE WHEN category = 5 THEN CAST({TOLD} AS DOUBLE) ELSE r END, 6) AS recall, CAST(CASE WHEN category = 5 THEN {TOLD} "
    f"WHEN category = 1 THEN len({LISTED.format(c='pred', t=TOK.format(x='y'))}) > 0 AND {LISTED.format(c='pred', t=TOK.format(x='y'))} = {LISTED.format(c='gold', t=TOK.format(x='y'))} "
    f"ELSE array_to_string({TOK.format(x='pred')}, ' ') = array_to_string({TOK.format(x='gold')}, ' ') END AS DOUBLE) AS accuracy FROM asked LEFT JOIN ms USING (item_id)",
)
def m6(spark, d):
    out = answers.score_by_category(predictions(spark, d), ["item_id"])
    return out.select("item_id", "category", *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall", "accuracy")])


TURNS = """turns AS (SELECT a.conv_id, a.turn, a.text AS gold1, coalesce(c.text, '') AS gold2, b.text AS pred FROM conversations a
  JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 LEFT JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn + 2)"""


def _turns(spark, d):
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    nxt2 = c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("g2"))
    j = c.join(nxt, ["conv_id", "turn"]).join(nxt2, ["conv_id", "turn"], "left")
    return j.select("conv_id", "turn", "pred", F.array(F.col("text"), F.coalesce("g2", F.lit(""))).alias("golds"))


WORDS = "regexp_extract_all(lower({x}), '[a-z0-9]+')"
BTOK = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')"


@query(
    "m7_best_plain_f1",
    f"WITH {TURNS}, al AS (SELECT conv_id, turn, 1 AS gp, pred, gold1 AS gold FROM turns UNION ALL SELECT conv_id, turn, 2, pred, gold2 FROM turns), "
    f"{_overlap_sql('al', 'conv_id, turn, gp', WORDS.format(x='pred'), WORDS.format(x='gold'))} "
    f"SELECT conv_id, turn, round(coalesce(max({_f1('p', 'r')}), 0), 6) AS f1 FROM (SELECT DISTINCT conv_id, turn, gp FROM al) LEFT JOIN sc USING (conv_id, turn, gp) GROUP BY conv_id, turn",
)
def m7(spark, d):
    return answers.best_plain_f1(_turns(spark, d), ["conv_id", "turn"]).select("conv_id", "turn", F.round("f1", 6).alias("f1"))


@query(
    "m8_bleu1",
    f"""WITH {TURNS}, h AS (SELECT conv_id, turn, {BTOK.format(x='pred')} AS t, len({BTOK.format(x='gold1')}) AS r1, len({BTOK.format(x='gold2')}) AS r2 FROM turns),
      hc AS (SELECT conv_id, turn, t, count(*) AS c FROM (SELECT conv_id, turn, unnest(t) AS t FROM h) GROUP BY ALL),
      rc AS (SELECT conv_id, turn, t, max(c) AS lim FROM (SELECT conv_id, turn, g, t, count(*) AS c FROM (
          SELECT conv_id, turn, 1 AS g, unnest({BTOK.format(x='gold1')}) AS t FROM turns UNION ALL SELECT conv_id, turn, 2, unnest({BTOK.format(x='gold2')}) FROM turns) GROUP BY ALL) GROUP BY ALL),
      cl AS (SELECT conv_id, turn, sum(least(c, lim)) AS same FROM hc JOIN rc USING (conv_id, turn, t) GROUP BY ALL),
      ln AS (SELECT conv_id, turn, len(t) AS c, CASE WHEN abs(r1 - len(t)) < abs(r2 - len(t)) OR (abs(r1 - len(t)) = abs(r2 - len(t)) AND r1 <= r2) THEN r1 ELSE r2 END AS r FROM h)
      SELECT conv_id, turn, round(CASE WHEN same IS NULL OR c = 0 THEN 0.0 ELSE same / c * CASE WHEN c > r THEN 1.0 ELSE exp(1 - r / c) END END, 6) AS bleu
      FROM ln LEFT JOIN cl USING (conv_id, turn)""",
)
def m8(spark, d):
    return answers.bleu1(_turns(spark, d), ["conv_id", "turn"]).select("conv_id", "turn", F.round("bleu", 6).alias("bleu"))


@query(
    "m13_token_counts",
    f"SELECT doc_id, CAST(len({BTOK.format(x='text')}) AS INTEGER) AS tokens FROM documents",
)
def m13(spark, d):
    return table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))


@query(
    "m20_judge_verdict",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Correct' WHEN 1 THEN 'Incorrect' WHEN 2 THEN 'Incorrect' WHEN 3 THEN 'Error' ELSE 'Error' END AS verdict,
       CAST(CASE WHEN event_id % 5 = 0 THEN 100 ELSE 0 END AS INTEGER) AS score, CASE WHEN event_id % 5 IN (0, 1) THEN event_type ELSE '' END AS reasoning FROM events""",
)
def m20(spark, d):
    forms = F.array(
        F.concat(F.lit('Sure.\n```json\n{"reasoning": "'), "event_type", F.lit('", "evaluation_result": "Correct"}\n```')),
        F.concat(F.lit('{"reasoning": "'), "event_type", F.lit('", "evaluation_result": "Incorrect"} bye')),
        F.lit('{"evaluation_result": "Perhaps"}'), F.lit("no json at all"), F.lit("{broken: json"),
    )
    text = F.element_at(forms, (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", answers.judge_verdict(text).alias("v")).select("event_id", "v.verdict", "v.score", "v.reasoning")


@query(
    "m21_duplicate_generations",
    "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL",
)
def m21(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return answers.first_generation(ev, ["user_id", "event_type"], "event_id")


# ---- summaries -----------------------------------------------------------------------------


@query(
    "g1_evaluation_summary",
    f"WITH {PRED}, {_overlap_sql('pred', 'item_id', TOK.format(x='pred'), TOK.format(x='gold'))} "
    f"SELECT category, CAST(grouping(category) AS INTEGER) AS is_overall, count(*) AS count, round(avg({_f1('p', 'r')}), 6) AS avg_f1, "
    "round(avg(p), 6) AS avg_precision, round(avg(r), 6) AS avg_recall FROM pred JOIN sc USING (item_id) GROUP BY ROLLUP (category)",
)
def g1(spark, d):
    p = predictions(spark, d)
    scored = answers.single_answer(p, ["item_id"], stemmed=False).join(p.select("item_id", "category"), "item_id")
    s = stats.evaluation_summary(scored)
    return s.select("category", "is_overall", "count", *[F.round(c, 6).alias(c) for c in ("avg_f1", "avg_precision", "avg_recall")])


GEN = """gen AS (SELECT 'enhanced' AS ranking_strategy, 'content_event_topic_kw' AS metric, '' AS trace_metric, CASE WHEN event_id % 2 = 0 THEN 'content' ELSE 'event' END AS text_mode,
   CAST(1 + event_id % 3 * 2 AS INTEGER) AS topn, CASE WHEN event_id % 7 = 0 THEN 'uncategorized' ELSE CAST(event_id % 5 AS VARCHAR) END AS category,
   CAST(user_id AS VARCHAR) AS user_id, value / 100 AS f1, value / 200 AS bleu, CAST(floor(value * 10) AS BIGINT) AS context_tokens, value AS generation_latency FROM events),
  tot AS (SELECT CAST(user_id AS VARCHAR) AS user_id, sum(CAST(floor(value * 100) AS BIGINT)) AS total FROM events GROUP BY 1)"""


def _generations(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(
        F.lit("enhanced").alias("ranking_strategy"), F.lit("content_event_topic_kw").alias("metric"), F.lit(None).cast("string").alias("trace_metric"),
        F.when(i % 2 == 0, "content").otherwise("event").alias("text_mode"), (i % 3 * 2 + 1).cast("int").alias("topn"),
        F.when(i % 7 != 0, (i % 5).cast("string")).alias("category"), F.col("user_id").cast("string").alias("user_id"),
        (F.col("value") / 100).alias("f1"), (F.col("value") / 200).alias("bleu"), F.floor(F.col("value") * 10).alias("context_tokens"),
        F.col("value").alias("generation_latency"), F.floor(F.col("value") * 100).alias("content_tokens"),
    )


@query(
    "g2_generation_summary",
    f"""WITH {GEN}, g AS (SELECT ranking_strategy, metric, trace_metric, text_mode, topn, category, user_id, grouping(user_id) AS gu, grouping(category) AS gc, grouping(text_mode) AS gm,
         count(*) AS count, round(avg(f1), 6) AS f1, round(avg(bleu), 6) AS bleu, avg(context_tokens) AS ctx, round(avg(generation_latency), 6) AS lat
         FROM gen GROUP BY GROUPING SETS ((ranking_strategy, metric, trace_metric, text_mode, topn), (ranking_strategy, metric, trace_metric, text_mode, topn, category),
           (ranking_strategy, user_id), (ranking_strategy, user_id, text_mode)))
       SELECT CASE WHEN gu = 1 AND gc = 1 THEN 'config' WHEN gu = 1 THEN 'config_category' WHEN gm = 1 THEN 'user' ELSE 'user_mode' END AS grain,
         ranking_strategy, metric, trace_metric, text_mode, topn, category, g.user_id, count, CASE WHEN gu = 1 THEN f1 END AS avg_f1, CASE WHEN gu = 1 THEN bleu END AS avg_bleu,
         round(ctx, 6) AS avg_context_tokens, CASE WHEN gu = 1 THEN lat END AS avg_generation_latency, CASE WHEN gu = 0 THEN round(ctx / greatest(total, 1), 6) END AS avg_context_ratio_over_content
       FROM g LEFT JOIN tot ON g.user_id = tot.user_id""",
)
def g2(spark, d):
    rows = _generations(spark, d)
    totals = stats.content_tokens_by_user(rows, F.col("content_tokens"))
    return stats.generation_summary(rows, totals, digits=6, token_digits=6)


@query(
    "g3_build_summary",
    """WITH b AS (SELECT conv_id, count(*) AS messages, sum(len(text)) AS ct, sum(len(text)) + 10 * count(*) AS et FROM conversations GROUP BY conv_id),
       a AS (SELECT count(*) AS boxes, CAST(sum(messages) AS BIGINT) AS m, avg(messages) AS am, avg(et / greatest(ct, 1)) AS r, CAST(sum(ct) AS BIGINT) AS ct, CAST(sum(et) AS BIGINT) AS et FROM b),
       u AS (SELECT count(*) AS calls, CAST(sum(event_id % 100) AS BIGINT) AS prompt, CAST(sum(event_id % 10) AS BIGINT) AS completion, CAST(sum(event_id % 100 + event_id % 10) AS BIGINT) AS total FROM events)
       SELECT boxes, m AS total_messages, round(am, 3) AS avg_messages_per_box, round(r, 3) AS avg_token_ratio_enriched_over_content, ct AS total_content_tokens, et AS total_enriched_tokens,
         calls AS llm_calls, prompt AS llm_prompt, completion AS llm_completion, total AS llm_total,
         round(calls / boxes, 3) AS avg_calls_per_box, round(calls / m, 3) AS avg_calls_per_message, round(prompt / boxes, 3) AS avg_prompt_per_box, round(prompt / m, 3) AS avg_prompt_per_message,
         round(completion / boxes, 3) AS avg_completion_per_box, round(completion / m, 3) AS avg_completion_per_message, round(total / boxes, 3) AS avg_total_per_box, round(total / m, 3) AS avg_total_per_message
       FROM a, u""",
)
def g3(spark, d):
    b = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(F.length("text")).alias("content_tokens"), (F.sum(F.length("text")) + 10 * F.count(F.lit(1))).alias("enriched_tokens")
    )
    u = stats.usage_by_stage(_usage(spark, d).withColumn("stage", F.lit("build")))
    return stats.build_summary(b, u)


def _usage(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("stage"), (i % 100).alias("prompt_tokens"), (i % 10).alias("completion_tokens"),
        F.lit(None).cast("bigint").alias("total_tokens"), "ts",
    )


@query(
    "g4_usage_by_stage",
    """SELECT event_type AS stage, count(*) AS calls, CAST(sum(event_id % 100) AS BIGINT) AS prompt, CAST(sum(event_id % 10) AS BIGINT) AS completion,
       CAST(sum(event_id % 100 + event_id % 10) AS BIGINT) AS total FROM events WHERE event_type <> 'error' GROUP BY 1""",
)
def g4(spark, d):
    return stats.usage_by_stage(_usage(spark, d))


def _stats_sql(p95: str, by: str = "event_type") -> str:
    return f"""WITH n AS (SELECT {by}, value, row_number() OVER (PARTITION BY {by} ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM events)
      SELECT {by}, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS median, round({p95}, 6) AS p95 FROM n GROUP BY {by}"""


def _latency(spark, d, method):
    s = stats.value_stats(table(spark, d, "events"), "value", ["event_type"], method)
    return s.select("event_type", "n", F.round("mean", 6).alias("mean"), "min", "max", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


@query("g5_latency_nearest_rank", _stats_sql("max(value) FILTER (i = greatest(0, least(n - 1, CAST(round_even(0.95 * n, 0) AS BIGINT) - 1)))"))
def g5(spark, d):
    return _latency(spark, d, "nearest")


@query("g6_latency_interpolated", _stats_sql("quantile_cont(value, 0.95)"))
def g6(spark, d):
    return _latency(spark, d, "linear")


@query("g7_latency_floor_rank", _stats_sql("max(value) FILTER (i = CAST(floor(0.95 * n) AS BIGINT))"))
def g7(spark, d):
    return _latency(spark, d, "floor")


@query(
    "g8_distributions",
    with_sql(QRY)
    + "SELECT 'tc_type' AS field, tc_type AS value, count(*) AS n FROM qry GROUP BY 2 UNION ALL SELECT 'axis', axis, count(*) FROM qry GROUP BY 2 UNION ALL SELECT 'intent', intent, count(*) FROM qry GROUP BY 2",
)
def g8(spark, d):
    return stats.distribution(questions(spark, d), ["tc_type", "axis", "intent"])


@query(
    "g9_pool_sizes",
    with_sql(BLK)
    + """, s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
         SELECT count(*) AS n, round(avg(n), 6) AS mean, min(n) AS min, max(n) AS max, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95 FROM s""",
)
def g9(spark, d):
    sizes = blocks(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))
    s = stats.value_stats(sizes, "size")
    return s.select("n", F.round("mean", 6).alias("mean"), "min", "max", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


@query(
    "g10_generation_stats",
    f"""WITH {GEN} SELECT text_mode, count(*) AS n, round(avg(context_tokens), 6) AS mean, max(context_tokens) AS max, round(quantile_cont(context_tokens, 0.5), 6) AS median,
        round(quantile_cont(context_tokens, 0.95), 6) AS p95 FROM gen GROUP BY text_mode""",
)
def g10(spark, d):
    s = stats.value_stats(_generations(spark, d), "context_tokens", ["text_mode"])
    return s.select("text_mode", "n", F.round("mean", 6).alias("mean"), "max", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


@query(
    "g11_base_time",
    with_sql(BLK) + "SELECT user_id, max(greatest(session_end, session_start)) AS base_day FROM blk GROUP BY user_id",
)
def g11(spark, d):
    from timeweave.operators.pools import base_time

    return base_time(blocks(spark, d), F.lit("2024-01-01").cast("date"))


@query(
    "g13_distinct_first",
    "SELECT coalesce(event_type, '') AS event_type, user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2",
)
def g13(spark, d):
    ev = table(spark, d, "events").select("event_type", "user_id", "event_id")
    return stats.distinct_first(ev, [F.col("event_type"), F.col("user_id")], "event_id")


@query(
    "g14_tokens_by_user",
    f"SELECT CAST(conv_id AS VARCHAR) AS user_id, CAST(sum(len({BTOK.format(x='text')})) AS BIGINT) AS content_tokens_total FROM conversations GROUP BY 1",
)
def g14(spark, d):
    c = table(spark, d, "conversations").withColumn("user_id", F.col("conv_id").cast("string"))
    return stats.content_tokens_by_user(c, token_count(F.col("text")))


@query("x4_answer_normalisation", f"SELECT item_id, array_to_string({TOK.format(x='text')}, ' ') AS normal FROM benchmark")
def x4(spark, d):
    from timeweave.functions.text import normalize_answer

    return table(spark, d, "benchmark").select("item_id", normalize_answer(F.col("text")).alias("normal"))


@query("j8_subset_semi_join", with_sql(QRY) + "SELECT user_id, qa_idx, intent FROM qry WHERE tc_type IN ('POINT','RANGE')")
def j8(spark, d):
    q = questions(spark, d)
    keys = q.filter(F.col("tc_type").isin("POINT", "RANGE")).select(*KEY)
    return q.select(*KEY, "intent").join(keys, KEY, "left_semi")
