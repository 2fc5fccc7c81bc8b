import os

import pytest
from pyspark.sql import functions as F

from quillstone.operators import evaluate
from quillstone.sources import arrays

SCHEMA = "ts_code string, day_index int, f1 float, f2 double"


@pytest.mark.parametrize("rows_a_range", [3, 1 << 16])
def test_samples_equal_those_of_windows(spark, tmp_path, monkeypatch, rows_a_range):
    monkeypatch.setattr(arrays, "RANGE", rows_a_range)
    data = [(c, d, float(d), None if d % 3 == 0 else d / 2) for c in "ABCDE" for d in range(40) if (c, d) not in {("B", 2), ("C", 39), ("D", 20)}] + [("E", 11, 5.0, 5.0), (None, 1, 1.0, 1.0), ("A", None, 1.0, 1.0)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    folder = f"file://{tmp_path}/a"
    assert arrays.write(df, folder, ["f1", "f2"], 3) == len(data) - 2
    for length in (1, 3, 7):
        got = sorted((x.ts_code, x.day_index, x.x, x.missing) for x in arrays.samples(spark, folder, length).collect() if (x.ts_code, x.day_index) != ("E", 11))
        q = evaluate.sequences(df.where("ts_code is not null and day_index is not null"), ["f1", "f2"], length).where("not (ts_code = 'E' and day_index = 11)")
        both = lambda kind: F.flatten(F.zip_with(f"f1_{kind}", f"f2_{kind}", lambda a, b: F.array(a, b)))
        want = sorted((x.ts_code, x.day_index, x.x, x.m) for x in q.select("ts_code", "day_index", both("values").alias("x"), both("missing").alias("m")).collect())
        assert got == want and got
    size = sum(os.path.getsize(tmp_path / "a" / f) for f in os.listdir(tmp_path / "a") if ".f32" in f or ".u8" in f or ".u64" in f)
    assert size == (len(data) - 2) * (2 * 4 + 2 + 16)  # each row once, whatever the length


def test_gaps_and_short_codes_give_no_sample(spark, tmp_path):
    data = [("A", d, 1.0, 1.0) for d in range(5)] + [("B", d, 1.0, 1.0) for d in (0, 1, 3, 4)]
    arrays.write(spark.createDataFrame(data, SCHEMA), str(tmp_path / "b"), ["f1", "f2"], 1)
    assert sorted((x.ts_code, x.day_index) for x in arrays.samples(spark, str(tmp_path / "b"), 3).collect()) == [("A", 2), ("A", 3), ("A", 4)]
    assert arrays.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), ["f1"], 2) == 0
    assert arrays.samples(spark, str(tmp_path / "none"), 3).count() == 0
