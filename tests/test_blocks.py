import math
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import blocks
from quillstone.plans.compiler import FormulaError, evaluate
from shown import close, rows


@pytest.fixture(scope="module")
def panel(spark):
    """Two securities over 1,400 sessions, with gaps."""
    r = random.Random(5)
    data = []
    for code in ("A", "B"):
        c = 10.0
        for d in range(1, 1401):
            c *= math.exp(r.gauss(0, 0.02))
            hole = r.random() < 0.02 or (code == "B" and d < 30)
            data.append((d, f"day{d:04d}", code, *([None] * 5 if hole else [c * 0.99, c * 1.02, c * 0.97, c, float(r.randint(1, 99))])))
    p = spark.createDataFrame(data, "day_index int, trade_date string, ts_code string, O double, H double, L double, C double, V double").cache()
    return p.selectExpr("*", "(O + C) / 2 AS VWAP", "C / O - 1 AS RET", "100.0D AS IDX")


FORMULAS = {"far": "count(C, 1024)", "low": "tmin(fill(L, 1000000), 1024)", "steps": "mean(rank(delta(C, 20)), 40)", "ema": "ema(fill(delta(C, 3), 0), 20, 1)", "grow": "grow(C / delay(C))", "late": "delay(ema(ema(C, 7, 2), 13, 2), 5)"}


def test_results_dont_depend_on_the_blocks(panel):
    whole = rows(evaluate(panel, FORMULAS))
    assert sum(r[3] is not None for r in whole) > 0 and len(whole) == 2800
    for block in (37, 500, 5000):
        got = rows(evaluate(panel, FORMULAS, block=block))
        assert [r[:2] for r in got] == [r[:2] for r in whole]
        for a, b in zip(got, whole, strict=True):
            assert close(a[2:], b[2:], 1e-9, 1e-7)  # windows are rounded to eight decimals


def test_there_are_more_groups_than_securities(panel):
    b = blocks.blocked(panel, 100, 30)
    assert b.select("ts_code", "_block").distinct().count() >= 2 * 14
    assert rows(blocks.own(b)) == rows(panel)
    extra = rows(b.where("not _own").select("ts_code", "_block", "day_index"))
    assert all(0 < k * 100 - d <= 30 for _, k, d in extra) and len(extra) == 2 * 30 * 14


def loop(kind, values, rate):
    out, state = [], 1.0 if kind == "grow" else None
    for x in values:
        if x is None or x != x:
            out.append(None)
            continue
        state = (state * x if x > 0 else state) if kind == "grow" else x if state is None else (1 - rate) * state + rate * x
        out.append(state)
    return out


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_scans_equal_a_loop(spark, size):
    r = random.Random(size)
    series = {"a": [r.choice([None, float("nan"), r.uniform(-1, 2)]) for _ in range(300)], "late": [None] * 130 + [3.0, None, 5.0] + [None] * 40, "none": [None] * 5, "once": [None, 4.0]}
    df = spark.createDataFrame([(k, i, x) for k, v in series.items() for i, x in enumerate(v) if (k, i) != ("a", 17)], "ts_code string, day_index int, x double").repartition(3)
    folds = {"e": ("ema", "x", 2 / 7), "all": ("ema", "x", 1.0), "g": ("grow", "x", 0.0)}
    got = {(x.ts_code, x.day_index): (x.e, x["all"], x.g) for x in blocks.scan(df, folds, size).collect()}
    for k, v in series.items():
        at = [i for i in range(len(v)) if (k, i) in got]
        assert len(at) == len(v) - (k == "a")
        for j, (kind, _, rate) in enumerate(folds.values()):
            assert close([got[k, i][j] for i in at], loop(kind, [v[i] for i in at], rate), 1e-12)
    assert blocks.scan(df.limit(0), folds, size).count() == 0


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_scans_of_whole_securities_equal_those_by_block_and_deal_rows_once(spark, size):
    r = random.Random(size)
    series = {"a": [r.choice([None, float("nan"), r.uniform(-1, 2)]) for _ in range(300)], "late": [None] * 130 + [3.0, None, 5.0] + [None] * 40, "none": [None] * 5, "once": [None, 4.0]}
    df = spark.createDataFrame([(k, i, x) for k, v in series.items() for i, x in enumerate(v) if (k, i) != ("a", 17)], "ts_code string, day_index int, x double").repartition(3)
    folds = {"e": ("ema", "x", 2 / 7), "all": ("ema", "x", 1.0), "g": ("grow", "x", 0.0)}
    whole = blocks.scan(df, folds, size, whole_codes=True)
    plan = whole._jdf.queryExecution().executedPlan().toString()  # before it runs, as it then shows two plans
    seen = lambda out: sorted((x.ts_code, x.day_index, x.e, x["all"], x.g) for x in out.collect())
    assert str(seen(whole)) == str(seen(blocks.scan(df, folds, size)))
    assert set(whole.columns) == {*df.columns, *folds} and blocks.scan(df.limit(0), folds, size, whole_codes=True).count() == 0
    assert plan.count("hashpartitioning") == 1 and "Join" not in plan


def test_formulas_with_recursions_compute_the_panel_once(panel):
    plan = evaluate(panel, {"a": "ema(C, 7, 2) - delay(C)", "b": "ema(mean(V, 3), 4, 1)"})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_burn_in_keeps_what_recursions_need(panel):
    part = blocks.burn_in(panel, 1300, 1390, sessions=400)
    assert part.agg(F.min("day_index"), F.max("day_index")).first()[:] == (900, 1390)
    got = rows(evaluate(part, {"e": "ema(C, 7, 2)"}, ("day_index", "ts_code", "_target")).where("_target"))
    want = rows(evaluate(panel, {"e": "ema(C, 7, 2)"}, ("day_index", "ts_code")).where("day_index between 1300 and 1390"))
    assert [(a[0], a[1], a[3]) for a in got] == want
    with pytest.raises(ValueError, match="need 254 prior sessions, found 99"):
        blocks.burn_in(panel, 100, 200)
    with pytest.raises(ValueError, match="found 0"):
        blocks.burn_in(panel.limit(0), 100, 200)


def test_a_benchmark_is_carried_on_but_not_over_holes(spark):
    prices = {"A": {1: 10, 2: 11, 3: 12, 4: 13, 6: 9, 7: 8}, "B": {1: 5, 2: 5, 3: 4, 5: 6, 6: 7, 7: 7, 8: 0}}
    p = spark.createDataFrame([(d, k, c * 0.9, float(c)) for k, v in prices.items() for d, c in v.items()], "day_index int, ts_code string, open double, close double")
    index = spark.createDataFrame([(2, 99.0, 100.0), (7, 200.0, 210.0), (9, None, None), (11, 1.0, -1.0), (12, None, None)], "day_index int, index_open double, index_close double")
    want, close = {}, None
    known = {2: (99.0, 100.0), 7: (200.0, 210.0), 11: (1.0, -1.0)}
    for d in range(1, 13):
        both = [(prices[k][d - 1], prices[k][d]) for k in prices if prices[k].get(d - 1, 0) > 0 and prices[k].get(d, 0) > 0]
        if d in known:
            want[d], close = known[d], known[d][1]
        elif close is None or close <= 0 or not both:
            want[d], close = (None, None), None
        else:
            before, close = close, close * math.exp(sum(math.log(b / a) for a, b in both) / len(both))
            want[d] = (before * math.exp(sum(math.log(0.9 * b / a) for a, b in both) / len(both)), close)
    got = {x.day_index: (x.index_open, x.index_close) for x in blocks.fill_benchmark(index, p).collect()}
    assert set(got) == set(range(1, 10)) | {11, 12}  # neither table has the tenth session
    assert all(got[d] == pytest.approx(want[d]) for d in got) and want[3] != (None, None) and want[8] == (None, None)


def test_weights_and_filled_values(panel, spark):
    got = {x.day_index: x for x in evaluate(panel.where("ts_code = 'A'"), {"w": "wav(C, 1, 2, 5)", "f": "fill(C, 7)"}, ("day_index", "C")).collect()}
    for d in range(3, 1400, 97):
        c = [got[i].C for i in (d - 2, d - 1, d)]
        assert got[d].w == (pytest.approx((c[0] + 2 * c[1] + 5 * c[2]) / 8) if None not in c else None)
        assert got[d].f == (7 if c[2] is None else c[2])
    for bad in ("wav(C)", "wav(C, V)", "wav(C, 1, -1)"):
        with pytest.raises(FormulaError):
            evaluate(panel, {"x": bad})
