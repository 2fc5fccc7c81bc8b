from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from quillstone.llm import common, quality, queries, tokens, toxicity


def test_toxicity_writes_no_table_by_spark(spark):
    # each file that Spark writes makes an executor's JVM start processes, which count as large as itself until they run their program
    rows = [(d, None if d % 50 == 7 else " ".join(f"w{(d * 7 + i * i) % 90}" for i in range(d % 30)) + (" vile slur" * (d % 4) if d % 5 == 1 else "")) for d in range(600)]
    labels = spark.createDataFrame([(d, int(d % 5 == 1 and d % 4 > 0)) for d in range(600)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = len(common._made)
    many = toxicity.scores(docs.repartition(40), labels, "toxic", queries.TRAIN)
    got = sorted(many.collect())
    folders = [Path(x.removeprefix("file://")) for x in common._made[made:]]
    assert folders and not [f for x in folders for f in x.rglob("*") if f.name == "_SUCCESS" or f.suffix == ".crc"]
    assert many.rdd.getNumPartitions() == 1
    one = sorted(toxicity.scores(docs.coalesce(1), labels, "toxic", queries.TRAIN).collect())
    assert len(got) == 600 and any(x.passages for x in got) and {x.predicted for x in got} == {0, 1}
    assert all((a.doc_id, a.n_tokens, a.predicted, len(a.passages)) == (b.doc_id, b.n_tokens, b.predicted, len(b.passages)) and abs(a.score - b.score) < 1e-9 for a, b in zip(got, one, strict=True))


def test_kept_tables_have_the_rows_of_cut_ones(spark, odd, empty):
    more = odd.selectExpr("*", "encode(text, 'UTF-8') AS b", "array(doc_id, null) AS ids", "doc_id > 3 AS c", "cast(doc_id AS int) AS i", "array(score) AS s", "cast(doc_id AS decimal(20, 2)) AS d", "timestamp_seconds(doc_id) AS t").repartition(25)
    a, b = common.kept(more), common.cut(more)
    assert a.schema == b.schema and sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == odd.count()
    none = common.kept(empty)
    assert none.schema == empty.schema and none.count() == 0 and none.rdd.getNumPartitions() == 0
    twice = common.kept(odd.select("doc_id"), lambda batches: (x for batch in batches for x in (batch, batch.slice(0, 0), batch)))
    assert twice.count() == 2 * odd.count()


def test_groups_of_a_written_table_hold_every_row_and_a_later_attempt_replaces_it(tmp_path, monkeypatch):
    monkeypatch.setattr(common, "GROUP", 100)
    batches = [pa.RecordBatch.from_pydict({"x": pa.array(range(i * 30, i * 30 + i % 31), pa.int64())}) for i in range(31)]
    for attempt in ("1", "2"):
        assert common.write_table(str(tmp_path), "t.parquet", iter(batches), attempt) == sum(b.num_rows for b in batches)
    assert [f.name for f in tmp_path.iterdir()] == ["t.parquet"]
    assert pq.read_table(tmp_path / "t.parquet") == pa.Table.from_batches(batches).combine_chunks()
    assert pq.ParquetFile(tmp_path / "t.parquet").num_row_groups > 1
    assert common.write_table(str(tmp_path), "none.parquet", iter(batches[:1]), "1") == 0 and not (tmp_path / "none.parquet").exists()


def test_a_worker_gives_back_its_tokenizer_and_quality_writes_no_table_by_spark(spark, tokenizer):
    tokens.encoder(tokenizer)
    common.give_back(tokenizer=False)
    assert tokens.encoder.cache_info().currsize == 1
    common.give_back()
    assert tokens.encoder.cache_info().currsize == 0
    made = len(common._made)
    docs = spark.createDataFrame([(d, "plain words " * (d % 9)) for d in range(200)], "doc_id bigint, text string").repartition(8)
    quality.train(docs, spark.createDataFrame([(d, d % 2) for d in range(200)], "doc_id bigint, quality int"), "quality")
    folders = [Path(x.removeprefix("file://")) for x in common._made[made:]]
    assert folders and not [f for x in folders for f in x.rglob("*") if f.name == "_SUCCESS" or f.suffix == ".crc"]


def test_quality_has_no_stage_of_two_python_steps(spark, monkeypatch):
    """In such a stage each task takes two workers, and all of them come to hold the tokenizers of later tasks."""
    given = []
    kept = common.kept
    monkeypatch.setattr(common, "kept", lambda df, *more: given.append(df) or kept(df, *more))
    docs = spark.createDataFrame([(d, "plain words " * (d % 9)) for d in range(200)], "doc_id bigint, text string").repartition(8)
    quality.train(docs, spark.createDataFrame([(d, d % 2) for d in range(200)], "doc_id bigint, quality int"), "quality")
    assert given and not [df for df in given if "InArrow" in df._jdf.queryExecution().toString()]
