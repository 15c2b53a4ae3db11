"""Rows that every operator must take, and texts with known groups."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Columns that clash with names inside the operators come after the usual ones.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
        *(T.StructField(c, T.StringType()) for c in ("key", "row", "id", "n_words", "kept", "shard", "bucket", "node", "size", "doc", "block", "words")),
    ]
)


def sentence(rng: random.Random, n: int) -> list[str]:
    return [rng.choice("abcdefgh") + rng.choice(("alpha", "beta", "gamma", "delta", "omega")) + str(rng.randrange(400)) for _ in range(n)]


def texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): ordinary texts, exact and near copies, ties, repeated rows, nulls, empty and very long texts."""
    rng = random.Random(7)
    rows: list[tuple[int | None, str | None, str | None]] = []
    for k in range(60):
        rows.append((k, " ".join(sentence(rng, rng.randrange(12, 160))), f"src{k % 5}"))
    for k in range(6):  # near copies: one word replaced
        words = rows[k * 3][1].split()
        words[len(words) // 2] = "changed"
        rows.append((100 + k, " ".join(words), "src0"))
    rows += [(200 + k, rows[7][1], "src1") for k in range(30)]  # exact copies
    rows += [rows[8]] * 3  # repeated rows
    rows += [(300, None, "src2"), (301, "", None), (302, " \n\t ", "src3"), (None, "a null id has " + " ".join(sentence(rng, 30)), "src4"), (304, "één ñ 漢字 𝄞 Ünïcode", None)]
    rows.append((400, "\n".join(" ".join(sentence(rng, 12)) for _ in range(4000)), "src1"))  # very long
    rows.append((401, "x" * 300_000, "src2"))  # a very long word
    rows.append((402, "again and again and " * 200, "src3"))
    rows += [(500 + k, "same text for all " * 6, "hot") for k in range(40)]
    return rows


def frame(spark: SparkSession, rows=None) -> DataFrame:
    data = [(*r, *(f"{c}{i}" for c in "abcdefghijkl")) for i, r in enumerate(texts() if rows is None else rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(5)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
