import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from quillstone.streaming import replay

SCHEMA = "ts_code string, trade_date date, day_index bigint, as_of timestamp, smart double, tail double, curve array<double>"
DAY0 = datetime(2026, 1, 1)


def days(n=30):
    r = np.random.default_rng(2)
    out = {}
    for code in "AB":
        for d in range(1, n + 1):
            if (code, d) not in {("A", 6), ("B", 12)}:  # suspended
                out[code, d] = (float(r.normal()), None if d == 9 else float(r.normal()), r.normal(size=4).tolist())
    return out


def row(code, d, values, hours=20.0):
    """Downloaded so many hours after the day began."""
    return (code, (DAY0 + timedelta(d)).date(), d, DAY0 + timedelta(d, hours=hours), *values)


def plain(all_, code, d):
    smart, tail, curve = all_[code, d]
    w = [all_[code, k][0] for k in range(d - 9, d) if (code, k) in all_]
    t = [all_[code, k][1] for k in range(d - 20, d) if (code, k) in all_ and all_[code, k][1] is not None]
    c = [all_[code, k][2] for k in range(d - 20, d) if (code, k) in all_]
    return (np.mean([*w, smart]) if len(w) >= 5 else None, (tail - np.mean(t)) / np.std(t, ddof=1) if len(t) >= 10 and tail is not None else None, np.sqrt(np.mean((np.array(curve) - np.mean(c, axis=0)) ** 2)) if len(c) >= 10 else None)


def run(spark, tmp_path, batches, first=None):
    (tmp_path / "in").mkdir()
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i:03d}"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", replay.PROVIDER)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = replay.replay(stream, first).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        return {(x.ts_code, x.day_index): tuple(x)[2:] for x in spark.table("replayed").collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def same(got, want):
    return all((a is None) == (b is None) and (a is None or a == pytest.approx(b)) for a, b in zip(got, want, strict=True))


def test_replayed_days_equal_the_batch_whatever_their_order(spark, tmp_path):
    all_ = days()
    rows = [row(c, d, v) for (c, d), v in all_.items()]
    wrong = (9.0, 9.0, [9.0] * 4)
    r = random.Random(1)
    batches = []
    for k in range(0, 30, 6):  # six days arrive in one batch and in any order; some come before their cut-off, twice, or after they were taken
        some = [x for x in rows if k < x[2] <= k + 6]
        r.shuffle(some)
        early = [row("A", d, wrong, hours=17.9) for d in range(k + 1, k + 7)]
        late = [(*row("B", d, wrong)[:3], DAY0 + timedelta(k + 6, hours=21), *wrong) for d in range(max(1, k - 3), k + 1) if ("B", d) in all_]
        batches.append([*early, *some, *some[:2], *late])
    batches.append([row("Z", 40, wrong)])  # the watermark goes on
    batches.append([row("Z", 41, wrong)])
    got = run(spark, tmp_path, batches)
    assert {k for k in got if k[0] != "Z"} == set(all_)
    assert all(same(got[k], plain(all_, *k)) for k in all_)
    assert got["A", 25][1] is not None and got["A", 25][2] is not None


def test_a_first_state_from_a_batch_goes_on(spark, tmp_path):
    all_ = days()
    first = spark.createDataFrame([(c, d, *v) for (c, d), v in all_.items() if d <= 22], "ts_code string, day_index bigint, smart double, tail double, curve array<double>")
    rows = [row(c, d, v) for (c, d), v in all_.items() if d > 20]
    got = run(spark, tmp_path, [rows[: len(rows) // 2], rows[len(rows) // 2 :], [row("Z", 40, (1.0, 1.0, [1.0]))], [row("Z", 41, (1.0, 1.0, [1.0]))]], first)
    assert {k for k in got if k[0] != "Z"} == {k for k in all_ if k[1] > 22}
    assert all(same(v, plain(all_, *k)) for k, v in got.items() if k[0] != "Z")
