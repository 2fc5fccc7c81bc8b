from datetime import date

import pytest
from pyspark.sql import functions as F

from quillstone.operators import evaluate
from quillstone.sources import results
from shown import rows


@pytest.fixture
def store(spark, tmp_path):
    return results.Results(spark, str(tmp_path / "r"))


def test_digests_follow_contents_only(spark, store):
    base = [(1, "a", 1.0), (2, None, 2.0), (2, None, 2.0)]
    schema = "k int, s string, x double"
    key = lambda data, schema=schema, **settings: store.key(settings, t=spark.createDataFrame(data, schema))
    first = key(base)
    assert key(base[::-1]) == first and store.key({}, t=spark.createDataFrame(base, schema).repartition(3).select("x", "s", "k")) == first
    others = [key(base[:2]), key([*base, base[0]]), key([(1, "a", 1.0), (2, "", 2.0), (2, None, 2.0)]), key([(1, "a", 1.5), *base[1:]]), key(base, "k bigint, s string, x double"), key(base, h=5), key([], schema), store.key({}, u=spark.createDataFrame(base, schema))]
    assert first not in others and len(set(others)) == len(others)
    assert key([(None, "1", 2.0)]) != key([(1, None, 2.0)])


def test_results_are_made_once_and_published_whole(spark, store, tmp_path):
    made = []

    def build(value):
        made.append(value)
        return spark.createDataFrame([(value,)], "x int")

    assert rows(store.get("k", lambda: build(1))) == rows(store.get("k", lambda: build(2))) == [(1,)] and made == [1]
    store.publish("k", build(3))  # a writer that comes late
    assert rows(store.get("k", lambda: build(4))) == [(1,)] and not list((tmp_path / "r" / "_staging").iterdir())

    def fails():
        return build(5).withColumn("y", F.raise_error(F.lit("no")))

    with pytest.raises(Exception, match="no"):
        store.get("other", fails).collect()
    assert not store.has("other")


def test_an_interrupted_batch_goes_on_with_equal_results(spark, store, tmp_path):
    values = spark.createDataFrame([(f, date(2026, 1, d), c, float((d * 7 + i * 3 + ord(f)) % 11)) for f in "ABCDE" for d in range(1, 7) for i, c in enumerate("uvwxyz") if (f, d) != ("E", 2)], "factor_id string, trade_date date, ts_code string, value double")
    labels = spark.createDataFrame([(date(2026, 1, d), c, float((d * 5 + i * 2) % 7)) for d in range(1, 6) for i, c in enumerate("uvwxyz")], "trade_date date, ts_code string, label double")
    want = rows(evaluate.information_coefficients(values.join(labels, ["trade_date", "ts_code"]), "value", "label", ["factor_id", "trade_date"]))
    one = results.Batches(store, labels, {"v": 1})
    assert one.done() is None and one.advance(values.where("trade_date < '2026-01-04'"), 2, most=1) == 1
    assert sorted({x.factor_id for x in one.done().collect()}) == ["A", "B"]
    resumed = results.Batches(results.Results(spark, store.root), labels, {"v": 1})
    left = {(x.factor_id, x.trade_date.day) for x in resumed.pending(values).collect()}
    assert len(left) == 29 - 6 and ("A", 4) in left and ("A", 3) not in left and ("C", 1) in left
    assert resumed.advance(values, 2) == 3 and resumed.advance(values, 2) == 0 and resumed.pending(values).count() == 0
    assert rows(resumed.done().where("n > 0").select("factor_id", "trade_date", "n", "ic", "rank_ic", "rank_ic_avg")) == want
    assert rows(resumed.done().where("n = 0").select("factor_id", F.dayofmonth("trade_date"))) == [(f, 6) for f in "ABCDE"]  # sessions without labels are done too
    changed = results.Batches(store, labels.withColumn("label", F.col("label") + 1), {"v": 1})
    assert changed.done() is None and changed.run != one.run and results.Batches(store, labels, {"v": 2}).done() is None
    assert one.advance(values.limit(0)) == 0
