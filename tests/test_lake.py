import gzip
import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillstone.functions import scalar
from quillstone.operators import joins, panel, quality
from quillstone.sources import readers
from quillstone.sources.store import FactorStore, StoreError, ingest_snapshot, write_partitioned
from shown import rows

HEADER = "时间,代码,名称,开盘价,收盘价,最高价,最低价,成交量,成交额,涨幅,振幅"


def test_minute_csv_with_mark_two_time_formats_and_quarantine(spark, tmp_path):
    text = f"﻿{HEADER}\r\n2026-01-05 09:30:00,sh600000,x,10,10,10,10,1,1000,0,0\r\n2026/01/06 09:30,sh600000,x,11,12,12,11,4,4700,0,0\r\n2026/01/06 12:30,sh600000,x,11,12,12,11,4,4700,0,0\r\nbad,sh600000,x,1,1,1,1,1,1,0,0\r\n2026/01/06 09:31,sh600000,x,11,12,11.5,11,4,1,0,0\r\n2026/01/06 09:31,xx,x,1,1,1,1,1,1,0,0\r\n2026/01/06 09:32,sz000001,x,-,1,1,1,1,1,0,0\r\n"
    (tmp_path / "a.csv").write_bytes(text.encode())
    good, bad = readers.minute_csv(spark, str(tmp_path / "a.csv"))
    assert rows(good, "ts_code", "trade_date", "minute_index", "close", "volume_share") == [("600000.SH", date(2026, 1, 5), 0, 10.0, 100), ("600000.SH", date(2026, 1, 6), 0, 12.0, 400)]
    assert sorted(r[0] for r in bad.select("reason").collect()) == ["inconsistent_ohlc", "invalid_code", "invalid_price", "invalid_timestamp", "outside_session"]


def test_adjustment_and_stock_lists(spark, tmp_path):
    (tmp_path / "adj.csv").write_text("股票代码,交易日期,复权因子\nsh600000,20260105,1.0\nsh600000,2026-01-06,0.5\nsh600000,20260107,x\nsh600000,20260108,0\n")
    got = rows(readers.adjustment_csv(spark, str(tmp_path / "adj.csv")), "trade_date", "factor", "status")
    assert sorted(x[2] for x in got) == ["invalid_nonpositive", "invalid_parse", "valid", "valid"]
    (tmp_path / "s.csv").write_text("TS代码,股票代码,股票名称,交易所代码,上市日期\n600000.SH,600000,n,SSE,19991110\n")
    assert readers.raw_csv(spark, str(tmp_path / "s.csv"), readers.STOCK_COLUMNS).first()["ts_code"] == "600000.SH"


def test_vendor_snapshot_and_idempotent_ingest(spark, tmp_path):
    bar = {"symbol": "sh600000", "open": "10", "high": "10.5", "low": "9.9", "close": "10.1", "turnover": "1020.1", "volume": 101, "turnover_rate": 0.1, "ts_millis": 1768354260000, "ts_millis_open": 1768354200000}
    with gzip.open(tmp_path / "bars.jsonl.gz", "wt") as f:
        f.write(json.dumps(bar) + "\n")
    r = readers.vendor_snapshot(spark, str(tmp_path / "bars.jsonl.gz")).first()
    assert (r.minute_index, r.volume_lot, r.close, r.datetime) == (0, 1.01, 10.1, datetime(2026, 1, 14, 9, 30))
    root = str(tmp_path / "manifest")
    assert ingest_snapshot(spark, root, "day1", "aa") and not ingest_snapshot(spark, root, "day1", "aa")
    with pytest.raises(StoreError):
        ingest_snapshot(spark, root, "day1", "bb")


def test_absent_lake_is_an_empty_table_and_inventory_hashes(spark, tmp_path):
    assert readers.lake(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "f.txt").write_text("hello")
    r = readers.inventory(spark, str(tmp_path), "*.txt").first()
    assert r["sha256"] == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824" and r["size"] == 5


def test_partitioned_write_replaces_only_its_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "d int, c string, v double")
    write_partitioned(df, str(tmp_path / "t"), ["d"], ["c"], "overwrite")
    write_partitioned(df.where("d = 2").withColumn("v", F.lit(5.0)), str(tmp_path / "t"), ["d"], ["c"], "overwrite")
    assert rows(spark.read.parquet(str(tmp_path / "t")), "d", "v") == [(1, 1.0), (2, 5.0)]


def test_factor_store_contract(spark, tmp_path):
    store = FactorStore(spark, str(tmp_path / "store"))
    day = lambda d, v, c="a": spark.createDataFrame([(date(2026, 1, d), c, v)], "trade_date date, ts_code string, factor_value double")
    store.register("f", {"v": 1})
    store.register("f", {"v": 1})
    with pytest.raises(StoreError):
        store.register("f", {"v": 2})
    with pytest.raises(StoreError):
        store.write_day("f", date(2026, 1, 2), day(2, 1.0))
    with pytest.raises(StoreError):
        store.activate("f")
    store.import_history("f", day(1, 1.0))
    with pytest.raises(StoreError):
        store.import_history("f", day(1, 2.0))
    store.activate("f")
    store.write_day("f", date(2026, 1, 2), day(2, 1.0))
    store.write_day("f", date(2026, 1, 2), day(2, 3.0))
    assert rows(store.read(["f"]), "trade_date", "factor_value") == [(date(2026, 1, 1), 1.0), (date(2026, 1, 2), 3.0)]
    assert store.registry().first()["watermark"] == date(2026, 1, 2)
    with pytest.raises(StoreError):
        store.write_day("f", date(2026, 1, 3), day(3, float("nan")))
    days = spark.createDataFrame([(date(2026, 1, d),) for d in (1, 2, 3)], "trade_date date")
    assert rows(store.pending("f", days)) == [(date(2026, 1, 3),)]


def test_scalars(spark):
    df = spark.createDataFrame([("sh600000",), ("000001.SZ",), ("bj1",), (None,)], "s string")
    assert [r[0] for r in df.select(scalar.symbol(F.col("s"))).collect()] == ["600000.SH", "000001.SZ", None, None]
    t = spark.createDataFrame([(f"2026-01-05 {x}:00",) for x in ("09:30", "11:30", "12:00", "13:00", "13:01", "15:00", "15:01")], "t string")
    assert [r[0] for r in t.select(scalar.minute_index(scalar.timestamp(F.col("t")))).collect()] == [0, 120, None, None, 121, 240, None]
    assert [r[0] for r in spark.createDataFrame([("600000.SH",), ("900901.SH",), ("300001.SZ",), ("430001.BJ",), ("510300.SH",)], "c string").select(scalar.is_a_share(F.col("c"))).collect()] == [True, False, True, False, False]


def test_daily_bars_from_two_ticks(spark):
    t = spark.createDataFrame([("a", date(2026, 1, 6), 2, 12.0, 1.0, 12.0), ("a", date(2026, 1, 6), 1, 11.0, 3.0, 33.0)], "ts_code string, trade_date date, k int, p double, q double, x double")
    r = panel.daily_bars(t, "p", "q", "x", ["k"]).first()
    assert (r.open, r.close, r.high, r.low, r.vwap, r.bar_count) == (11.0, 12.0, 12.0, 11.0, 11.25, 2)


def test_point_in_time_joins(spark):
    d = lambda n: date(2026, 1, n)
    snaps = spark.createDataFrame([("I", d(1), "a"), ("I", d(1), "b"), ("I", d(5), "b")], "index_code string, as_of_date date, ts_code string")
    data = spark.createDataFrame([(d(n), c) for n in (1, 4, 5) for c in "ab"], "trade_date date, ts_code string")
    got = rows(joins.members_as_of(data, snaps, "index_code"), "trade_date", "ts_code")
    assert got == [(d(1), "a"), (d(1), "b"), (d(4), "a"), (d(4), "b"), (d(5), "b")]  # a left on the 5th
    facts = spark.createDataFrame([("a", d(2), 1.0), ("a", d(4), 2.0)], "ts_code string, as_of_date date, v double")
    assert rows(joins.last_known(data, facts, "v").where("ts_code = 'a'"), "trade_date", "v") == [(d(1), None), (d(4), 2.0), (d(5), 2.0)]
    iv = spark.createDataFrame([("I", "a", d(1), d(3)), ("I", "b", d(2), None)], "index_code string, ts_code string, effective_from date, effective_to date")
    ends = spark.createDataFrame([(d(3),), (d(4),)], "as_of_date date")
    assert rows(joins.intervals_to_snapshots(iv, ends, "index_code"), "as_of_date", "ts_code") == [(d(3), "a"), (d(3), "b"), (d(4), "b")]
    one = spark.createDataFrame([(1, "x")], "k int, v string")
    two = spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert rows(joins.precedence_union(one, two, ["k"])) == [(1, "x"), (2, "z")]
    assert rows(joins.differences(one, two, ["k"], ["v"])) == [(1, True, True, "v"), (2, False, True, "v")]


def test_checks(spark):
    df = spark.createDataFrame([(1, 2.0), (1, -1.0), (2, None)], "k int, v double")
    rep = quality.report({"pk": ("error", quality.duplicates(df, ["k"])), "pos": ("warning", quality.failing(df, F.col("v") > 0))})
    assert rows(rep, "check_name", "violations", "passed") == [("pk", 1, False), ("pos", 2, False)]
    with pytest.raises(ValueError, match="pk"):
        quality.raise_on_errors(rep)


def test_overlapping_intervals_give_each_date_once_without_holding_the_dates(spark):
    day = lambda k: None if k is None else date(2024, 1, 1) + timedelta(k)
    r = random.Random(3)
    spans = [(r.choice("XY"), r.choice(["a", "b", "c", None]), r.choice([None, *range(12)]), r.choice([None, *range(20), *range(20)])) for _ in range(60)]
    dates = spark.createDataFrame([(day(k),) for k in [*range(0, 25, 2), 4, 6]], "as_of_date date")
    for some in (spans, spans[:9], spans[9:14], []):
        iv = spark.createDataFrame([(g, c, day(a), day(b)) for g, c, a, b in some], "index_code string, ts_code string, effective_from date, effective_to date")
        for inclusive in (True, False):
            got = [tuple(x) for x in joins.intervals_to_snapshots(iv, dates, "index_code", inclusive=inclusive).collect()]
            want = {(g, day(k), c) for g, c, a, b in some for k in range(0, 25, 2) if a is not None and a <= k and (b is None or k < b + inclusive)}
            assert len(got) == len(want) and set(got) == want
    assert "HashAggregate(keys=[index_code" not in joins.intervals_to_snapshots(iv, dates, "index_code")._jdf.queryExecution().executedPlan().toString()
