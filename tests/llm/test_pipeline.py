import os

import pytest

import corpus_pipeline
from quillstone.llm import decontaminate, minhash_dedup

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before.count()
        kept[name] = docs
    assert 0 < kept["decontamination"].count() < n
    assert minhash_dedup.dedup(kept["near_dedup"]).where("not kept").count() == 0
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontaminate.decontaminate(kept["decontamination"].where("length(text) > 0"), bench).where("n_hit > 0.5 * n_words").count() == 0
    assert kept["packing"].select("doc_id").distinct().count() == kept["decontamination"].select("doc_id").distinct().count()
    assert kept["packing"].groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_stages_take_nulls_and_empty_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, "Some plain words, as they come in any text that people write.", "en", "a", 61), (2, None, None, None, None), (None, "Other plain words, as they come in any text that people write.", "en", "b", 62), (None, None, None, None, None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, DATA).count() <= max(len(data), 0)
