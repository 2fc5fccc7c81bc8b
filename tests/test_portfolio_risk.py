import numpy as np
import pandas as pd
import pytest

from quillstone.operators import evaluate as ev
from quillstone.operators import portfolio as pf
from quillstone.operators import risk
from shown import rows


def test_capped_simplex_and_turnover():
    w = pf.capped_simplex(np.array([8.0, 1.0, 1.0]), 0.5)
    assert np.allclose(w, [0.5, 0.25, 0.25])
    assert np.allclose(pf.capped_simplex(np.zeros(4), 0.3), 0.25)
    with pytest.raises(ValueError):
        pf.capped_simplex(np.ones(2), 0.4)
    assert np.allclose(pf.limit_turnover(np.array([1.0, 0.0]), np.array([0.0, 1.0]), 0.25), [0.75, 0.25])


def test_greedy_trade_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        old, alpha = rng.dirichlet(np.ones(3)), rng.normal(size=3)
        cap, cost = 0.8, 0.1
        old = pf.capped_simplex(old, cap)
        new = pf.greedy_trade(old, alpha, cost, cost, cap)
        value = lambda w: w @ alpha - cost * np.abs(w - old).sum()  # noqa: B023, E731
        grid = [np.array([a, b, 1 - a - b]) for a in np.linspace(0, cap, 41) for b in np.linspace(0, cap, 41) if -1e-9 <= 1 - a - b <= cap + 1e-9]
        assert abs(new.sum() - 1) < 1e-9 and new.max() <= cap + 1e-9 and value(new) >= max(map(value, grid)) - 1e-9


def test_blend_golden_values(spark):
    t = pd.DataFrame([("x", "A", 0.54), ("x", "B", 0.44), ("y", "B", 0.2), ("y", "C", 0.78)], columns=["source", "ts_code", "target_weight"]).assign(trade_date=pd.Timestamp("2026-01-01").date())
    got = rows(pf.blend(spark.createDataFrame(t), {"x": 0.8, "y": 0.2}), "ts_code", "target_weight")
    assert [(c, round(w, 6)) for c, w in got] == [("A", 0.432), ("B", 0.392), ("C", 0.156)]
    with pytest.raises(ValueError):
        pf.blend(spark.createDataFrame(t), {"x": 0.8})


def _days(spec):
    return pd.DataFrame(spec, columns=["trade_date", "ts_code", "target_weight", "price", "ratio", "tradable"])


def test_ledger_buys_lots_sells_first_and_follows_adjustment():
    costs = pf.Costs(cash=10_000, lot=100, buy=0.0, sell=0.0)
    out = pf.ledger(_days([(1, "a", 1.0, 10.0, 1.0, True), (1, "b", 0.0, 5.0, 1.0, True), (2, "a", 0.0, 12.0, 1.0, True), (2, "b", 1.0, 5.0, 1.0, True)]), costs)
    assert out["value"].tolist() == [10_000, 12_000] and out["cash"].tolist() == [0, 0] and out["traded"].tolist() == [10_000, 24_000]
    split = pf.ledger(_days([(1, "a", 1.0, 10.0, 1.0, True), (2, "a", 1.0, 5.0, 2.0, True)]), costs)
    assert split["value"].tolist() == [10_000, 10_000]
    frozen = pf.ledger(_days([(1, "a", 1.0, 10.0, 1.0, True), (2, "a", 0.0, 9.0, 1.0, False), (3, "a", 0.0, None, None, True)]), costs)
    assert frozen["holdings"].tolist() == [1, 1, 1] and frozen["value"].tolist() == [10_000, 9_000, 9_000]


def test_replacement_policy_and_shared_limit():
    scores = {1: (3, 2, 1, 0), 2: (0, 1, 3, 2), 3: (0, 1, 3, 2)}
    days = pd.DataFrame([(d, c, x) for d, xs in scores.items() for c, x in zip("abcd", xs, strict=True)], columns=["trade_date", "ts_code", "score"])
    out = pf.replace(days, pf.Replacement(size=2, entry=2, exit=2, limit=1))
    held = {d: sorted(t.loc[t["action"] != "leave", "ts_code"]) for d, t in out.groupby("trade_date")}
    assert held == {1: ["a", "b"], 2: ["b", "c"], 3: ["c", "d"]}
    both = pf.dual_sleeve(days.assign(sleeve=["x", "x", "y", "y"] * 3), {"x": pf.Replacement(1, 1, 1, 1), "y": pf.Replacement(1, 1, 1, 1)}, 1)
    changes = both[both["action"] == "leave"].groupby("trade_date").size()
    assert (changes <= 1).all()


def test_long_portfolio_keeps_frozen_weights():
    t = pd.DataFrame([(1, "a", 2.0, 0.1, True), (1, "b", 1.0, 0.0, True), (2, "a", 0.0, 0.0, False), (2, "b", 5.0, 0.0, True)], columns=["trade_date", "ts_code", "factor", "ret", "tradable"])
    out = pf.long_portfolio(t, 0.5, 0.0)
    assert out["net_return"].round(6).tolist() == [0.1, 0.0] and out["holdings"].tolist() == [1, 2]


def test_ranks_and_nearest_quantiles(spark):
    df = spark.createDataFrame([(1, c, float(v)) for c, v in zip("abcd", (1, 2, 2, 9), strict=True)], "d int, ts_code string, x double")
    assert [r[0] for r in df.withColumn("r", ev.average_rank("x", ["d"])).orderBy("ts_code").select("r").collect()] == [1.0, 2.5, 2.5, 4.0]
    assert [r[0] for r in ev.winsorise(df, ["x"], ["d"], 0.0, 0.67).orderBy("ts_code").select("x").collect()] == [1.0, 2.0, 2.0, 2.0]


def test_sequences_need_consecutive_sessions(spark):
    data = [("A", i, float(i), None if i == 2 else 1.0) for i in range(5)] + [("B", i, float(i), 1.0) for i in (0, 1, 3, 4)]
    got = ev.sequences(spark.createDataFrame(data, "ts_code string, day_index int, f double, g double"), ["f", "g"], 3).orderBy("day_index").collect()
    assert [r.ts_code for r in got] == ["A"] * 3 and got[0].g_missing == [0, 0, 1] and got[0].f_values == [0.0, 1.0, 2.0]


def test_covariance_identity_and_causality():
    rng = np.random.default_rng(19)
    x = rng.normal(size=(180, 3))
    cov = risk.ewma_covariance(x, 60, 0.1)
    assert np.allclose(cov, cov.T) and np.linalg.eigvalsh(cov).min() >= -1e-12
    w, b, s = rng.dirichlet(np.ones(5)), rng.normal(size=(5, 3)), np.full(5, 0.04)
    f = risk.forecast(w, b, cov, s)
    assert np.isclose(f["total"], w @ (b @ cov @ b.T + np.diag(s)) @ w)
    t = pd.DataFrame({"trade_date": range(100), "y": 1.2 * x[:100, 0] + 0.01 * x[:100, 1], "m": x[:100, 0]})
    a = risk.rolling_attribution(t, "y", ["m"], 60, 30)
    changed = t.copy()
    changed.loc[90:, "y"] = 99.0
    c = risk.rolling_attribution(changed, "y", ["m"], 60, 30)
    assert np.allclose(a["beta_m"][:31], c["beta_m"][:31]) and a["beta_m"].between(1.1, 1.3).all()


def test_factor_returns_recover_known_betas(spark):
    rng = np.random.default_rng(1)
    t = pd.DataFrame({"trade_date": np.repeat([1, 2], 50), "x": rng.normal(size=100), "w": 1.0})
    t["y"] = 0.5 + 2 * t["x"]
    t.loc[0, "y"] = np.nan
    got = risk.factor_returns(spark.createDataFrame(t), "y", ["x"], "w").collect()
    assert all(abs(r.value - (2 if r.factor == "x" else 0.5)) < 1e-9 and r.r2 > 0.999 for r in got) and {r.n for r in got} == {49, 50}
