from datetime import datetime, timedelta

import numpy as np

from quillstone.streaming import bars


def _run(spark, df_of, data, schema, tmp_path, mode="append"):
    """Feed batches of rows one after the other and collect what comes out."""
    source = tmp_path / "in"
    source.mkdir()
    for i, batch in enumerate(data):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(source / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(source))
    q = df_of(stream).writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("out").collect()


T0 = datetime(2026, 1, 5, 9, 30)
TICK = "ts_code string, ts timestamp, tick_id bigint, price double, quantity double"


def tick(minutes, k, p, q=1.0):
    return ("a", T0 + timedelta(minutes=minutes), k, p, q)


def test_minute_bars_close_with_the_watermark_and_drop_late_ticks(spark, tmp_path):
    data = [[tick(0.1, 1, 10.0), tick(0.9, 2, 12.0), tick(0.5, 3, 9.0)], [tick(10, 4, 11.0)], [tick(11, 7, 11.0)], [tick(0.2, 5, 99.0)], [tick(20, 6, 11.0)], [tick(30, 8, 11.0)]]
    got = {r.datetime: r for r in _run(spark, bars.minute_bars, data, TICK, tmp_path)}
    first = got[T0]
    assert (first.open, first.high, first.low, first.close, first.ticks) == (10.0, 12.0, 9.0, 12.0, 3)


def test_distinct_ticks(spark, tmp_path):
    got = _run(spark, bars.distinct_ticks, [[tick(0, 1, 1.0), tick(0, 1, 1.0)], [tick(0.5, 1, 1.0), tick(0.6, 2, 1.0)]], TICK, tmp_path)
    assert sorted(r.tick_id for r in got) == [1, 2]


def test_running_z_equals_the_batch_result_whatever_the_batches(spark, tmp_path):
    v = np.random.default_rng(0).normal(size=30)
    rows = [("a", i, float(x)) for i, x in enumerate(v)]
    got = _run(spark, bars.running_z, [rows[:7], rows[7:8], rows[5:20], rows[20:]], "ts_code string, day_index bigint, value double", tmp_path)
    z = {r.day_index: r.z for r in got}
    assert len(got) == 30 and z[9] is None
    for i in range(10, 30):
        ring = v[max(0, i - 20) : i]
        assert abs(z[i] - (v[i] - ring.mean()) / ring.std(ddof=1)) < 1e-9
