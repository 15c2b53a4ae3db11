"""Token files: an exact round trip against the library itself, checksums, places and what a lookup reads."""

from __future__ import annotations

import random
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.orc
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import empty, frame, texts
from timeweave.llm import token_orc

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


def options(**values) -> token_orc.TokenFiles:
    return token_orc.TokenFiles(token_orc.public_vocabulary("word_bpe_49k.json"), **values)


@cache
def tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def library_ids(text: str | None, by: token_orc.TokenFiles) -> list[int]:
    return [*tokenizer(by.vocabulary).encode(text or "", add_special_tokens=False).ids, by.end_id]


ODD = [
    "", " ", None, "It's  we'll\tI'D no-break em", "á ́b é", "<|endoftext|> x<|endoftext|>y <|startoftext|>", "ΑΣ ΑΣ. ΣΑΣ́ Σ", "漢字かな交じり文 と 한국어 한",
    "İstanbul ǅ ﬁ ß ẞ", "123 4567 1,000.00 ½ ² x²", "don't. (Foo), foo... FOO!? bar-baz, x_y é.à, ſt. ŉ' ǆ: q\u0338 <\u0338 end=\u0338 a=\u0338 Straße; ª. µ, 5. a5. 'll. 's, ''", "\x00\x01 \x1c\x85 ​﻿", "🙂👩‍👩‍👧 !!??--", "line\r\nline\n\n\x0b\x0c end ",
]


def test_words_are_encoded_as_the_library_does_whole_texts():
    by = options(cache_words=40)
    rng = random.Random(1)
    cases = [*ODD, *(" ".join(rng.choice([w for t in ODD if t for w in t.split(" ")]) for _ in range(30)) for _ in range(40))]
    encoder = token_orc.Encoder(by)
    for _ in range(3):  # through both generations of the cache
        for at in range(0, len(cases), 7):
            ids, first = encoder.encode(pa.array(cases[at : at + 7], pa.string()))
            for k, text in enumerate(cases[at : at + 7]):
                assert ids[first[k] : first[k + 1]].tolist() == library_ids(text, by)[:-1], text
    whole = token_orc.Encoder(options(by_word=False))
    ids, first = whole.encode(pa.array(ODD, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [library_ids(t, by)[:-1] for t in ODD]


def test_checksum_shares_add_up():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000, dtype=np.uint8).tobytes()
    for cut in (0, 1, 4, 17, 2048, 4999, 5000):
        assert token_orc.shifted(zlib.crc32(data[:cut]), len(data) - cut) ^ zlib.crc32(data[cut:]) == zlib.crc32(data)


@pytest.mark.parametrize("chunk", [7, 2048])
def test_round_trip(spark, tmp_path, chunk):
    by = options(chunk=chunk, range_bytes=1 << 18)
    rows = [r for r in texts() if r[0] != 400] + [(400, " ".join(f"long{i} text" for i in range(1500)), "s")] + [(700 + k, t, "odd") for k, t in enumerate(ODD)]
    path = str(tmp_path / "tokens")
    token_orc.write_tokens(frame(spark, rows), path, by)
    stored = token_orc.read_tokens(spark, path).collect()
    assert max(r["n"] for r in stored) <= chunk and all(len(r["ids"]) == r["n"] for r in stored)
    per_text: dict[tuple, list[int]] = {}
    for r in sorted(stored, key=lambda r: (r["part"], r["at"])):
        per_text.setdefault((r["part"], r["doc"]), []).extend(r["ids"])
    order = sorted(per_text)
    assert sorted(map(tuple, per_text.values())) == sorted(tuple(library_ids(t, by)) for _, t, _ in rows)
    found = token_orc.documents(spark, path, by).collect()
    assert len(found) == len(rows)
    at = 0
    for r, key in zip(sorted(found, key=lambda r: r["start"]), order, strict=True):
        ids = per_text[key]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    ids_in_order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert ids_in_order == sorted(ids_in_order, key=lambda k: (k is not None, k or 0))
    again = token_orc.round_trip(frame(spark, rows).repartition(3), by).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_lookups_read_the_row_groups_that_can_hold_an_id(spark, tmp_path):
    by = options(stride=1000)
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    path = str(tmp_path / "tokens")
    token_orc.write_tokens(docs, path, by)

    def rows_read(where) -> tuple[int, int]:
        rows = token_orc.read_tokens(spark, path, where)
        n = len(rows.collect())
        assert "PushedFilters: [IsNotNull(doc_id)" in rows._jdf.queryExecution().toString()
        plan = rows._jdf.queryExecution().executedPlan()
        while plan.children().size():
            plan = plan.children().head()
        return n, plan.metrics().apply("numOutputRows").value()

    one, read = rows_read(F.col("doc_id") == 20_002)
    assert one == 1 and read <= 1000 * 8
    none, read_none = rows_read(F.col("doc_id") == 20_003)  # within the range of a row group: the Bloom filters know
    assert none == 0 and read_none < 1000 * 2
    some, read_some = rows_read(F.col("doc_id").between(100, 198))
    assert some == 50 and read_some <= 2000
    part = next(p for p in sorted((tmp_path / "tokens").glob("*.orc")) if pyarrow.orc.ORCFile(str(p)).nrows)
    file = pyarrow.orc.ORCFile(str(part))
    assert file.row_index_stride == 1000 and str(file.compression).lower() == "zstd"
    asked = token_orc.documents(spark, path, by, where=F.col("doc_id") == 20_002).collect()
    assert [r.asDict() for r in asked] == [r.asDict() for r in token_orc.documents(spark, path, by).where("doc_id = 20002").collect()]


def test_empty_tables(spark):
    assert token_orc.round_trip(empty(spark), options()).count() == 0
