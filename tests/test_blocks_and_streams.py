"""Segmentation against a sequential model, in batch and as a stream; answers."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from timeweave.functions.stem import stem
from timeweave.operators import answers, blocks, graph
from timeweave.sources import scans, sinks
from timeweave.streaming import jobs, segmentation


def model_blocks(messages):
    """Sequential rule: (user -> list of message lists)."""
    out = {}
    for user, order, idx, split in sorted(messages):
        done = out.setdefault(user, [])
        if not done or done[-1][-1][0] != order or (split and len(done[-1]) >= 2):
            done.append([])
        done[-1].append((order, idx))
    return out


def random_messages(seed, users=6):
    rng = random.Random(seed)
    return [
        (f"u{u}", s, i, rng.random() < 0.5)
        for u in range(users) for s in range(1, rng.randint(2, 5)) for i in range(1, rng.randint(2, 40))
    ]


def message_df(spark, rows):
    df = spark.createDataFrame(rows, "user_id string, session_order int, msg_idx int, split boolean")
    return df.select(
        "*", F.concat(F.lit("session_"), "session_order").alias("session_id"), F.lit("user").alias("role"), F.concat(F.lit("m"), "msg_idx").alias("text"),
        F.lit("t").alias("msg_time"), F.lit("a").alias("session_start_time"), F.lit("b").alias("session_end_time"), F.lit("").alias("persona_info"),
        F.lit(None).cast("string").alias("persona_name"),
    )


def test_segmentation_matches_sequential_model(spark):
    for seed, chunk in ((1, 3), (2, 5), (3, 65536)):
        rows = random_messages(seed)
        got = {}
        for r in blocks.segment(message_df(spark, rows), F.col("split"), chunk).orderBy("user_id", "session_order", "msg_idx").collect():
            got.setdefault(r.user_id, {}).setdefault(r.block_no, []).append((r.session_order, r.msg_idx))
        assert {u: [b[k] for k in sorted(b)] for u, b in got.items()} == model_blocks(rows)


COLS = ["user_id", "session_order", "session_id", "msg_idx", "role", "text", "split", "msg_ts"]


def run_segments(spark, base, idle, late):
    stream = spark.readStream.schema(", ".join(f"{c} {t}" for c, t in zip(COLS, ("string", "int", "string", "int", "string", "string", "boolean", "timestamp"), strict=True))).parquet(f"{base}/in")
    out = segmentation.segment_stream(stream, idle=idle, late=late)
    segmentation.started(spark, jobs.append_blocks(out, f"{base}/out", f"{base}/ckpt").trigger(availableNow=True)).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out").filter("user_id <> 'zz'")


def test_stream_gives_the_batch_blocks(spark):
    rows = random_messages(11)
    base = tempfile.mkdtemp(prefix="spark-test-", dir="/tmp")
    stamped = message_df(spark, rows).withColumn("msg_ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("session_order") * 100 + F.col("msg_idx"))).select(*COLS)
    provider = spark.conf.get(segmentation.PROVIDER, None)
    # sessions arrive in two parts, the later messages second
    for part in (F.col("msg_idx") <= 9, F.col("msg_idx") > 9):
        stamped.filter(part).coalesce(1).write.mode("append").parquet(f"{base}/in")
        run_segments(spark, base, "10 minutes", "1 hour")
    far = "array(named_struct('user_id', 'zz', 'session_order', 9, 'session_id', 'session_9', 'msg_idx', 1, 'role', 'user', 'text', 'x', 'split', false, 'msg_ts', timestamp'2100-01-01'))"
    spark.range(1).selectExpr(f"inline({far})").write.mode("append").parquet(f"{base}/in")  # moves the watermark, so idle blocks are sealed
    found = run_segments(spark, base, "10 minutes", "1 hour")
    # a message of a session that is long over is late, one without a time is refused
    stamped.filter("user_id = 'u1' AND msg_idx = 1").withColumn("text", F.lit("again")).write.mode("append").parquet(f"{base}/in")
    stamped.limit(3).withColumn("msg_ts", F.lit(None).cast("timestamp")).write.mode("append").parquet(f"{base}/in")
    found = run_segments(spark, base, "10 minutes", "1 hour")
    got = {}
    for r in segmentation.user_blocks(found).collect():
        got.setdefault(r.user_id, {})[r.user_block_no] = (r.session_order, r.start_idx, r.end_idx, r.messages)
        assert r.content_text.split("\n") == [f"user: m{i}" for i in range(r.start_idx, r.end_idx + 1)]
    want = {u: [(b[0][0], b[0][1], b[-1][1], len(b)) for b in bs] for u, bs in model_blocks(rows).items()}
    assert {u: [b[k] for k in sorted(b)] for u, b in got.items()} == want
    sessions = len({s for u, s, i, _ in rows if u == "u1"})
    assert [(r.user_id, r.late) for r in segmentation.late_counts(found).collect()] == [("u1", sessions)]
    assert {r.content_text for r in segmentation.late_messages(found).collect()} == {"user: again"}
    assert spark.conf.get(segmentation.PROVIDER, None) == provider


def test_openings_follow_the_sequential_rule():
    rng = random.Random(4)
    for _ in range(300):
        split, held = [rng.random() < 0.6 for _ in range(rng.randrange(1, 30))], rng.randrange(4)
        want, size = [], held
        for i, asks in enumerate(split):
            if size == 0 or (asks and size >= 2):
                want.append(i)
                size = 0
            size += 1
        assert segmentation.openings(np.array(split), held) == want


def test_sessions_of_a_stream_merge_out_of_order(spark):
    base = tempfile.mkdtemp(prefix="spark-test-", dir="/tmp")
    hours = {"a": [0, 30, 11, 20, 45, 100], "b": [5, 40, 23, 14, 32, 101]}  # b: 14 and 23 join 5, 32 joins 40 to them
    for k in range(6):
        part = spark.createDataFrame([(u, h[k]) for u, h in hours.items()], "user_id string, h int")
        part.selectExpr("user_id", "timestamp_seconds(1700000000 + h * 3600) AS ts").coalesce(1).write.mode("append").parquet(f"{base}/in")
    spark.sql("SELECT CAST(NULL AS STRING) AS user_id, timestamp'2100-01-01' AS ts").write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema("user_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out = jobs.gap_sessions(stream, gap="10 hours", late="4 days")
    jobs.append_blocks(out, f"{base}/out", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    found = {(r.user_id, r.messages) for r in spark.read.parquet(f"{base}/out").filter("user_id IS NOT NULL").collect()}
    assert found == {("a", 1), ("a", 3), ("b", 5), ("b", 1)} and spark.read.parquet(f"{base}/out").count() >= 6


def test_stems_in_sql_and_by_join_follow_the_stemmer(spark):
    import duckdb

    from timeweave.catalog.stem_sql import stems
    from timeweave.functions.stem import with_stems

    rng = random.Random(2)
    heads = ("rel", "hop", "fil", "conflat", "troubl", "siz", "tann", "fizz", "happ", "sk", "vile", "analog", "conform", "radic", "differ", "vietnam", "predic", "oper", "feud", "decis", "hope", "callous", "form", "sensit", "tripl", "good", "electric", "reviv", "allow", "infer", "gyroscop", "adjust", "defens", "irrit", "replac", "depend", "adopt", "commun", "activ", "homolog", "bowdler", "prob", "rate", "ceas", "contr", "roll", "sy", "tr", "cry", "2022", "a", "é", "wax", "snow")
    tails = ("", "s", "es", "ies", "sses", "ss", "ed", "eed", "ing", "y", "ational", "tional", "enci", "izer", "abli", "alli", "ousli", "ization", "ation", "alism", "iveness", "fulness", "aliti", "iviti", "biliti", "icate", "ative", "alize", "ical", "ful", "ness", "al", "ance", "er", "able", "ement", "ment", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "e", "ll", "lled", "tting", "izing", "ated")
    words = sorted({h + t for h in heads for t in tails} | {"".join(rng.choice("aeioubcdlsty") for _ in range(rng.randrange(1, 9))) + rng.choice(tails) for _ in range(3000)})
    words = [w for w in words if "yy" not in w]
    con = duckdb.connect()
    con.execute("CREATE TABLE v (t VARCHAR)")
    con.executemany("INSERT INTO v VALUES (?)", [(w,) for w in words])
    got = dict(con.execute(f"WITH {stems('v')} SELECT t, stem FROM stems").fetchall())
    assert {w: got[w] for w in words} == {w: stem(w) for w in words}
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words[:400] + ["running"] * 200 + [None])], "i int, w string")
    assert all(r.stem == (stem(r.w) if r.w is not None else None) for r in with_stems(rows, "w", ["i"]).collect())


def test_stemmer_and_category_scores(spark):
    for word, root in (("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("probate", "probat"), ("sky", "sky"), ("agreed", "agre"), ("controlling", "control")):
        assert stem(word) == root
    rows = [
        (1, 1, "cats, dogs", "dog, cat"), (2, 2, "The running man", "a man runs"), (3, 3, "paris", "Paris; or London"),
        (4, 5, "Not mentioned anywhere", "x"), (5, 9, "a", "a"), (6, 2, "", "gold"),
    ]
    df = spark.createDataFrame(rows, "id int, category int, pred string, gold string")
    got = {r.id: r for r in answers.score_by_category(df, ["id"]).collect()}
    assert got[1].f1 == 1.0 and got[1].accuracy == 0.0
    assert got[2].f1 == 1.0 and got[2].accuracy == 0.0
    assert got[3].f1 == 1.0 and got[3].accuracy == 1.0
    assert got[4].f1 == 1.0 and got[5].f1 == 0.0 and got[6].f1 == 0.0


def test_link_batch_equals_one_shot_linking(spark):
    rng = random.Random(5)
    rows = [("u", i, i, [float(rng.randint(-3, 3)) for _ in range(3)]) for i in range(60)]
    ev = spark.createDataFrame(rows, "user_id string, event_id long, seq long, embedding array<double>")
    whole = {(r.a_id, r.b_id) for r in graph.link_similar(ev, 0.7, 4).collect()}
    parts = set()
    for lo, hi in ((0, 20), (20, 45), (45, 60)):
        new, old = ev.filter((F.col("seq") >= lo) & (F.col("seq") < hi)), ev.filter(F.col("seq") < lo)
        parts |= {(r.a_id, r.b_id) for r in jobs.link_batch(new, old, 0.7, 4).collect()}
    assert parts == whole


def test_linking_stream_survives_replays(spark):
    rng = random.Random(8)
    rows = [("u" if i % 3 else "hot", i, i, [float(rng.randint(-3, 3)) for _ in range(3)]) for i in range(90)]
    schema = "user_id string, event_id long, seq long, embedding array<double>"
    want = {(r.user_id, r.a_id, r.b_id) for r in graph.link_similar(spark.createDataFrame(rows, schema), 0.7, 4).collect()}
    base = tempfile.mkdtemp(prefix="spark-test-", dir="/tmp")
    for lo, hi in ((0, 30), (30, 31), (31, 90)):  # one event comes a second time in the last part
        spark.createDataFrame(rows[lo:hi] + (rows[3:4] if hi == 90 else []), schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    store = jobs.LinkStore(spark, f"{base}/store", 0.7, 4)
    seen = []

    def fails_after_its_work(batch, batch_id):
        store.handle(batch, batch_id)
        seen.append(batch_id)
        if seen == [0, 1]:
            raise RuntimeError("lost after both tables were written")

    for run in range(2):
        query = stream.writeStream.foreachBatch(fails_after_its_work).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
        if run == 0:
            with pytest.raises(StreamingQueryException):
                query.awaitTermination()
        else:
            query.awaitTermination()
    assert seen == [0, 1, 1, 2]
    edges = store.edges().collect()
    assert len(edges) == len(want) and {(r.user_id, r.a_id, r.b_id) for r in edges} == want
    assert store.events().count() == 90 and {r.batch for r in edges} <= {0, 1, 2}
    again = jobs.LinkStore(spark, f"{base}/store", 0.7, 4)  # a store that is opened anew keeps its rows
    assert again.events().count() == 90


def test_file_round_trips(spark):
    base = tempfile.mkdtemp(prefix="spark-test-", dir="/tmp")
    with open(f"{base}/one.json", "w") as f:
        f.write('[{"sample_id": "c1", "conversation": {"session_1": [{"speaker": "A", "text": " hi "}, {"speaker": "B", "text": "yo"}], '
                '"session_1_date_time": "1:56 pm on 8 May, 2023", "session_10": [{"speaker": "A", "text": "late"}]}, "qa": [{"question": "q", "category": 5}]}]')
    conv = scans.read_conversations(spark, base).withColumn("user_id", F.col("sample_id"))
    m = blocks.messages_from_session_keys(conv).orderBy("session_no", "msg_idx").collect()
    assert [(r.session_no, r.msg_idx, r.text, r.msg_time) for r in m] == [
        (1, 1, "hi", "1:56 pm on 8 May, 2023"), (1, 2, "yo", "1:56 pm on 8 May, 2023"), (10, 1, "late", "Unknown")
    ]
    assert scans.explode_questions(conv).count() == 0 and scans.explode_questions(conv, True).count() == 1
    with open(f"{base}/b.jsonl", "w") as f:
        f.write('{"user_id": 7, "box_id": 3}\nnot json\n{"block_id": 1}\n')
    got = scans.read_blocks(spark, f"{base}/b.jsonl").collect()
    assert [(r.user_id, r.block_id) for r in got] == [("7", 3)]
    ranked = spark.createDataFrame([("u", 1, 9, 2), ("u", 1, 4, 1)], "user_id string, qa_idx int, block_id long, rank int")
    sinks.write_ranking_csv(ranked, f"{base}/csv")
    assert spark.read.option("header", True).csv(f"{base}/csv").first()["ranking"] == "[4,9]"
    sinks.append_jsonl(ranked, f"{base}/log")
    sinks.append_jsonl(ranked, f"{base}/log")
    assert spark.read.json(f"{base}/log").count() == 4
    sinks.write_blocks(ranked, f"{base}/blocks", buckets=4)
    assert spark.read.parquet(f"{base}/blocks").count() == 2


def test_first_item_of_each_file(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k:08x}.json").write_text("[" + ",\n".join(f'{{"q": {k * 100 + i}}}' for i in range(3 + k)) + "]")
        (tmp_path / f"lines{k}.jsonl").write_text("\n".join(["not json", *(f'{{"q": {k * 100 + i}}}' for i in range(2000))]))
    arrays = scans.read_first_items(spark, str(tmp_path), "q int", array_files=True, glob="*.json").collect()
    assert {(r.source_id, r.q) for r in arrays} == {(f"{k:08x}", k * 100) for k in range(5)}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # several splits a file
    try:
        lines = scans.read_first_items(spark, str(tmp_path), "q int", glob="*.jsonl").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert {(r.source_id, r.q) for r in lines} == {(f"lines{k}", k * 100) for k in range(5)}


def test_evidence_in_one_long_session(spark):
    from timeweave.operators.evidence import message_targets

    rng = random.Random(1)
    spans, at = [], 1
    while at < 5000:
        n = rng.choice((1, 2, 3, 200))
        spans.append((at, at + n - 1))
        at += n
    cover = spark.createDataFrame([("u", i, (f"session_{1}", a, b)) for i, (a, b) in enumerate(spans)] + [("u", 9999, ("session_1", 9, 4))], "user_id string, block_id long, coverage struct<session_id:string,start_idx:int,end_idx:int>")
    asked = [rng.randrange(1, 6000) for _ in range(800)]
    q = spark.createDataFrame([("u", k, [f"D1:{m}", "D2:3", "x"]) for k, m in enumerate(asked)], "user_id string, qa_idx int, evidence array<string>")
    want = {(k, i) for k, m in enumerate(asked) for i, (a, b) in enumerate(spans) if a <= m <= b}
    for bucket in (1, 64, 100_000):
        found = message_targets(q, cover, bucket=bucket)
        assert {(r.qa_idx, r.block_id) for r in found.collect()} == want


def test_long_blocks_as_parts(spark):
    rows = [("u", 1, i, False) for i in range(1, 20_001)] + random_messages(21)
    segmented = blocks.segment(message_df(spark, rows), F.col("split"))
    whole = {(r.user_id, r.block_no): (r.content_text, r.messages, r.start_idx, r.end_idx) for r in blocks.seal(segmented).collect()}
    for size in (7, 4096):
        parts = {}
        for r in blocks.sealed_parts(segmented, size).collect():
            assert r.messages <= size
            parts.setdefault((r.user_id, r.block_no), []).append((r.part, r.content_part, r.messages, r.start_idx, r.end_idx))
        assert parts.keys() == whole.keys()
        for key, own in parts.items():
            own.sort()
            assert [p[0] for p in own] == list(range(len(own)))
            assert ("\n".join(p[1] for p in own), sum(p[2] for p in own), own[0][3], own[-1][4]) == whole[key]


def test_reach_over_longer_paths(spark):
    edges = spark.createDataFrame([("u", i, i + 1, 0.9 - i / 100) for i in range(6)], "user_id string, a_id long, b_id long, score double")
    seeds = spark.createDataFrame([("u", 1, 0)], "user_id string, qa_idx int, event_id long")
    got = [(r.event_id, r.min_hop, round(r.similarity_score, 2)) for r in graph.reachable(seeds, edges, 5).orderBy("rank").collect()]
    assert got == [(1, 1, 0.9), (2, 2, 0.89), (3, 3, 0.88), (4, 4, 0.87), (5, 5, 0.86)]
