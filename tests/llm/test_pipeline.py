from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tests.llm.cases import texts
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_neardup import brute_classes

SF = "/root/testdata/sf0.001"


def folder(spark, tmp_path, rows):
    docs = spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    item = " ".join(rows[5][1].split()[:30])
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), [("0", item)]


def test_stages_keep_clean_rows_and_drop_the_rest(spark, tmp_path):
    rows = texts()
    sf_dir, items = folder(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = Counter(r["doc_id"] for r in docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert set(range(60)) <= set(kept["quality rules"])
    classes = brute_classes([r for r in rows if r[0] in kept["quality rules"]])
    assert set(kept["near duplicates"]) == {k for k, c in classes.items() if k == c} and max(kept["near duplicates"].values()) == 1
    bad = {k for k, _, _, _, b in brute_hits(rows, items) if b}
    assert 5 in bad and set(kept["decontamination"]) == set(kept["near duplicates"]) - bad
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and max(kept["mixing"].values()) <= 2
    assert kept["sharding"] == kept["mixing"]


def test_run_applies_all_stages(spark):
    found = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} == set(found.columns)
    assert found.count() > 100
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "mixing", "sharding"]
