from datetime import date, timedelta

import numpy as np
import pandas as pd

from quillstone.operators import research as rs
from shown import rows


def test_windows_end_before_the_lag():
    days = [(i, date(2026, 1, 1) + timedelta(i)) for i in range(120)]
    got = rs.rolling_windows(days, train=40, lag=6)
    assert [x.test[0] for x in got] == [59, 90] and all(x.train[1] == x.test[0] - 6 and x.train[1] - x.train[0] == 39 for x in got)
    assert rs.rolling_windows([], 10, 1) == []
    folds = rs.purged_folds(0, 299, 3, 63, 6)
    assert [x.test for x in folds] == [(111, 173), (174, 236), (237, 299)] and all(x.train[1] == x.test[0] - 7 for x in folds)


def test_linear_fits_from_products(spark):
    rng = np.random.default_rng(0)
    t = pd.DataFrame(rng.normal(size=(200, 2)), columns=["a", "b"])
    t["y"] = 3 * t["a"] - t["b"] + 0.5
    t.loc[0, "a"] = np.nan
    g, m, n = rs.gram(spark.createDataFrame(t), ["a", "b"], "y")
    assert n == 199 and np.allclose(rs.ridge(g, m, 0.0), [3, -1, 0.5])
    assert np.allclose(rs.elastic_net(g, m, n, 0.0, 0.0), [3, -1, 0.5], atol=1e-6) and rs.elastic_net(g, m, n, 100.0, 0.0)[0] == 0
    assert rows(rs.predict(spark.createDataFrame([(1.0, 1.0), (None, 1.0)], "a double, b double"), ["a", "b"], np.array([3.0, -1.0, 0.5])), "prediction") == [(2.5,), (None,)]


def test_feature_filter(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=100)
    t = pd.DataFrame({"a": a, "b": a * 2 + 1e-6 * rng.normal(size=100), "c": rng.normal(size=100), "flat": 1.0})
    df = spark.createDataFrame(t)
    assert rs.filter_features(df, ["a", "b", "c", "flat"], {"b": 0.9, "a": 0.5, "c": 0.1, "flat": 2.0}) == ["b", "c"]


def test_targets_stay_within_their_limits():
    rng = np.random.default_rng(0)
    t = pd.DataFrame([(d, c, x) for d in range(10) for c, x in zip("abcde", rng.normal(size=5), strict=True)], columns=["trade_date", "ts_code", "score"])
    w = rs.softmax_targets(t, 0.5, 0.4, 0.1).pivot(index="trade_date", columns="ts_code", values="target_weight").fillna(0.0)
    assert np.allclose(w.sum(axis=1), 1) and w.to_numpy().max() <= 0.4 + 1e-9 and (w.diff().abs().sum(axis=1) <= 0.2 + 1e-9).all()
    h = rs.hysteresis(t, 0.2, 0.6)
    assert np.allclose(h.groupby("trade_date")["target_weight"].sum(), 1)


def test_bootstrap_covers_the_mean():
    low, high = rs.block_bootstrap(np.random.default_rng(0).normal(0.1, 1, 1000))
    assert low < 0.13 and high > 0.05 and low < high
    assert rs.block_bootstrap(np.random.default_rng(0).normal(size=1000)) == rs.block_bootstrap(np.random.default_rng(0).normal(size=1000))
