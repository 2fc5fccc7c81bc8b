import math
from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillstone.operators import blocks
from quillstone.plans.compiler import Compiler, FormulaError, evaluate
from quillstone.plans.formulas import REGISTRY, artifact_id

BASE = "trade_date date, ts_code string, day_index int, O double, H double, L double, C double, V double, VWAP double, RET double, IDX double"


def panel(spark, series):
    """{code: closes}, other columns made of them."""
    out = []
    for code, xs in series.items():
        for i, x in enumerate(xs):
            out.append((date(2026, 1, 1) + timedelta(i), code, i + 1, x, x, x, x, x, x, x, None if x is None else float(i)))
    return spark.createDataFrame(out, BASE)


def values(spark, series, formula, decimals=8):
    got = evaluate(panel(spark, series), {"f": formula}, keep=("day_index", "ts_code"), decimals=decimals)
    out = {}
    for r in sorted(got.collect(), key=lambda r: (r.ts_code, r.day_index)):
        out.setdefault(r.ts_code, []).append(r.f)
    return out


def test_rank_divides_by_the_count_of_values(spark):
    got = values(spark, {"a": [1.0], "b": [2.0], "c": [None]}, "rank(C)")
    assert got == {"a": [0.5], "b": [1.0], "c": [None]}


def test_delay_stays_within_a_security(spark):
    assert values(spark, {"a": [10.0, 11.0], "b": [20.0, 21.0]}, "delay(C)") == {"a": [None, 10.0], "b": [None, 20.0]}


def test_a_gap_stays_missing(spark):
    got = values(spark, {"a": [float(i) for i in range(8)], "b": [0.0, 1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0]}, "delta(C, 5)")
    assert got["a"] == [None] * 5 + [5.0] * 3
    assert got["b"] == [None] * 5 + [5.0, 5.0, None]


def test_windows_need_all_their_values(spark):
    assert values(spark, {"a": [1.0, None, 3.0, 4.0, 5.0]}, "sum(C, 2)")["a"] == [None, None, None, 7.0, 9.0]


def test_order_statistics(spark):
    s = {"a": [1.0, 3.0, 2.0, 3.0]}
    assert values(spark, s, "tsrank(C, 3)")["a"] == [None, None, 2.0, 2.0]
    assert values(spark, s, "argmax(C, 4)")["a"][-1] == 2.0  # the earliest of equals
    assert values(spark, s, "argmin(C, 4)")["a"][-1] == 1.0
    assert values(spark, s, "decay(C, 2)")["a"] == [None, round(7 / 3, 8), round(7 / 3, 8), round(8 / 3, 8)]
    assert values(spark, s, "prod(C, 2)")["a"] == [None, 3.0, 6.0, 6.0]


def test_correlation_of_a_constant_is_null_and_division_by_zero_too(spark):
    s = {"a": [1.0, 2.0, 4.0]}
    assert values(spark, s, "corr(C - C, C, 3)")["a"] == [None] * 3
    assert values(spark, s, "cov(C - C, C, 3)")["a"] == [None, None, 0.0]
    assert values(spark, s, "corr(C, -C, 3)")["a"][-1] == -1.0
    assert values(spark, s, "C / (C - C)")["a"] == [None] * 3
    assert values(spark, s, "log(-C)")["a"] == [None] * 3


def test_recursive_average_carries_its_state_over_nulls(spark):
    assert values(spark, {"a": [4.0, None, 8.0]}, "ema(C, 4, 2)")["a"] == [4.0, None, 6.0]
    assert values(spark, {"a": [0.5, -1.0, None, 2.0]}, "grow(C)")["a"] == [0.5, 0.5, None, 1.0]


def test_null_predicate_takes_the_other_branch(spark):
    assert values(spark, {"a": [1.0, 2.0]}, "iif(C > delay(C), 1, -1)")["a"] == [-1.0, 1.0]


def test_slope_and_beta(spark):
    s = {"a": [float(2 * i + 1) for i in range(6)]}
    assert values(spark, s, "slope(C, 4)")["a"][-1] == 2.0
    assert values(spark, s, "beta(C, IDX, 6)")["a"][-1] == 2.0


def test_equal_calls_share_a_column():
    c = Compiler()
    c.add("x", "rank(corr(C, V, 5)) + mean(C, 3)")
    c.add("y", "rank(corr(C, V, 5)) - mean(C, 3)")
    assert sum(len(s.windows) for s in c.stages) == 3


@pytest.mark.parametrize("text", ["open('x')", "C.real", "sum(C)", "unknown(C, 2)", "mean(C, 0)", "mean(C, 1.5)", "[C]", "lambda: 1", "C +", "True"])
def test_the_language_is_closed(text):
    with pytest.raises(FormulaError):
        Compiler().add("x", text)


def test_registry_compiles_in_both_dialects():
    assert len(REGISTRY) == 190
    assert artifact_id("wq001") == "wq_alpha001_qfq_v1" and artifact_id("gtja191", "raw") == "gtja_alpha191_raw_v1"
    for dialect in ("spark", "duckdb"):
        c = Compiler(dialect)
        for k, text in REGISTRY.items():
            c.add(k, text)
        assert set(c.results) == set(REGISTRY)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), max_size=20), st.floats(0.01, 0.99))
def test_recursive_averages_match_their_closed_form(spark, xs, rate):
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate(xs)], "ts_code string, day_index int, x double")
    got = [r.e for r in blocks.scan(df, {"e": ("ema", "x", rate)}, 5).orderBy("day_index").collect()]
    known = [x for x in xs if x is not None]
    assert [g is None for g in got] == [x is None for x in xs]
    if known:
        want = known[0] * (1 - rate) ** (len(known) - 1) + sum(rate * (1 - rate) ** (len(known) - 1 - i) * x for i, x in enumerate(known) if i)
        last = [g for g in got if g is not None][-1]
        assert math.isclose(last, want, rel_tol=1e-6, abs_tol=1e-6)


def test_small_values_are_neither_rounded_away_nor_taken_for_constant(spark):
    small = [1e-9 * x for x in (1.0, 3.0, 2.0, 5.0, 4.0)]
    assert values(spark, {"A": small}, "mean(C, 2)", None)["A"][1:] == pytest.approx([2e-9, 2.5e-9, 3.5e-9, 4.5e-9], rel=1e-12)
    assert values(spark, {"A": small}, "mean(C, 2)", 8)["A"][1] == 0
    line = values(spark, {"A": small}, "corr(C, IDX, 5)", None)["A"]
    assert line[-1] == pytest.approx(0.8) and line[:-1] == [None] * 4
    assert values(spark, {"A": [7.1] * 5}, "corr(C, IDX, 5)", None)["A"][-1] is None
    assert values(spark, {"A": [1e10 + x for x in (1.0, 3.0, 2.0, 5.0, 4.0)]}, "corr(C, IDX, 5)", None)["A"][-1] is None  # varies by less than a billionth of its size


def test_cross_sections_are_dealt_evenly_and_rows_change_places_seldom(spark):
    from pyspark.sql import functions as F

    from quillstone.plans import compiler, queries_formulas

    p = spark.range(8 * 50).selectExpr("cast(id % 8 + 1 AS int) AS day_index", "concat('d', id % 8) AS trade_date", "concat('S', id div 8) AS ts_code", "cast(id AS double) AS C")
    dealt = evaluate(p, {"r": "rank(C)"}, ("trade_date",)).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count_distinct("trade_date").alias("n"), F.min("r").alias("least"), F.max("r").alias("most")).collect()
    assert [x.n for x in dealt] == [2] * 4 and all((x.least, x.most) == (0.02, 1.0) for x in dealt)
    for name, most in (("wide_formulas_wq", 4), ("wide_formulas_gtja", 2)):
        c = compiler.Compiler(decimals=8)
        for k, text in queries_formulas.WIDE[name].items():
            c.add(k, text)
        columns = sum(len(x.windows) + len(x.folds) for x in c.stages)
        visits = compiler._visits(c, "PARTITION BY trade_date")
        at = [False, *(x.across for x in visits if x.windows or x.folds)]
        assert sum(a != b for a, b in zip(at, at[1:], strict=False)) <= most
        assert sum(len(x.windows) + len(x.folds) for x in visits) == columns
