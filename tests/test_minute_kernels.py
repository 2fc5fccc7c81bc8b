import math
import statistics

import numpy as np
from pyspark.sql import functions as F

from quillstone.operators import minute
from quillstone.operators import session_kernels as k
from shown import rows


def test_distribution_functions():
    assert abs(k.t_cdf(np.array([0.0, 1.0, -2.0, 12.706]), 1)[3] - 0.975) < 1e-4
    assert np.allclose(k.t_cdf(np.array([0.0, 1.96]), 1e6), [0.5, 0.9750021], atol=1e-5)
    assert np.allclose(k.normal_cdf(np.array([0.0, 1.959964])), [0.5, 0.975], atol=1e-6)
    assert abs(k.incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-12


def test_regression_statistics():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 2))
    y = 1 + 2 * x[:, 0] + rng.normal(size=50)
    t, f = k.ols(y, x)
    a = np.column_stack([np.ones(50), x])
    beta, rest = np.linalg.lstsq(a, y, rcond=None)[:2]
    se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * rest[0] / 47)
    assert np.allclose(t, beta / se) and f > 50
    assert all(math.isnan(v) for v in k.ols(y, np.zeros((50, 1)))[0])


def test_support_area_grows_by_distance():
    assert k.support_area(np.array([1.0, 2, 3, 4]), np.array([1.0, 2, 5, 3])) == (3.0, 4.0) or k.support_area(np.array([1.0, 2, 3, 4]), np.array([1.0, 2, 5, 3]))[0] == 3.0
    assert k.support_area(np.array([1.0, 2, 3, 4]), np.array([1.0, 2, 4, 3])) == (3.0, 4.0)  # equally far: the larger first
    assert k.support_area(np.array([10.0, 11, 15]), np.array([5.0, 1, 4.9]), 0.6) == (10.0, 15.0)  # 11 joins before 15, which has more
    assert k.support_area(np.array([10.0, 11, 15]), np.array([5.0, 1, 4.9]), 0.5) == (10.0, 11.0)


def _session(n=241):
    rng = np.random.default_rng(8)
    c = 10 * np.exp(np.cumsum(rng.normal(0, 0.002, n)))
    o = np.concatenate([[10.0], c[:-1]])
    v = rng.integers(1, 1000, n).astype(float)
    return o, np.maximum(o, c) + 0.01, np.minimum(o, c) - 0.01, c, v, c * v


def test_features_look_at_continuous_trading_only():
    o, h, low, c, v, a = _session()
    whole, cut = k.dos(o, h, low, c, v, a), k.dos(*(x[:238] for x in (o, h, low, c, v, a)))
    apart = {"resilience_cov", "dawn_fog_vol_persist", "canopy_t", "canopy_f"}
    assert all(whole[x] == cut[x] or math.isnan(cut[x]) for x in cut if x not in apart) and all(whole[x] != cut[x] for x in apart)
    assert k.dos(*(x[:240] for x in (o, h, low, c, v, a)))["canopy_t"] == whole["canopy_t"]  # rows up to 239


def test_features_equal_loops_over_a_whole_session():
    o, h, low, c, v, a = (x.tolist() for x in _session())
    got, n = k.dos(*map(np.array, (o, h, low, c, v, a))), 238
    ret = [None, *(c[t] / c[t - 1] - 1 for t in range(1, n))]
    assert abs(got["prop_uniform_dis"] - sum(a[t] * (ret[t] - 0.1) / 0.2 for t in range(1, n)) / sum(a[:n])) < 1e-12
    assert abs(got["prop_normal_dis"] - sum(a[t] * 0.5 * (1 + math.erf(ret[t] * 19.6 / math.sqrt(2))) for t in range(1, n)) / sum(a[:n])) < 1e-12
    small = [t for t in range(n) if abs(c[t] - o[t]) <= 0.5 * abs(h[t] - low[t])]
    assert abs(got["consist_volume"] - sum(v[t] for t in small) / sum(v[:n])) < 1e-12
    assert abs(got["positive_consist_volume"] - sum(v[t] for t in small if t and c[t] > c[t - 1]) / sum(v[:n])) < 1e-12
    assert abs(got["illiq_shortcut"] - sum((2 * (h[t] - low[t]) - abs(o[t] - c[t])) / (c[t] * v[t]) for t in range(n))) < 1e-12
    dv = [v[t] - v[t - 1] for t in range(1, n)]
    limit = statistics.mean(dv) + statistics.stdev(dv)
    jumps = [t for t in range(1, n) if v[t] - v[t - 1] > limit]
    assert abs(got["flash_returns"] - statistics.mean(ret[t] for t in jumps)) < 1e-12
    assert abs(got["flash_volatility"] - statistics.mean(statistics.stdev(ret[t : t + 5]) for t in jumps if t + 4 < n)) < 1e-12
    inner = {t: statistics.stdev(ret[t - 4 : t + 1]) for t in range(5, n)}
    fuzz = {t: statistics.stdev(inner[i] for i in range(t - 4, t + 1)) for t in range(9, n)}
    fog = [t for t in fuzz if fuzz[t] > statistics.mean(fuzz.values())]
    ratio = lambda x: statistics.mean(x[t] for t in fog) / statistics.mean(x[:n])
    assert abs(got["ratio_fuzziness_amount"] - ratio(a)) < 1e-9 and abs(got["fuzz_diff"] - (ratio(v) - ratio(a))) < 1e-9
    peaks = [t for t in range(n) if v[t] > statistics.mean(v[:n]) + statistics.stdev(v[:n])]
    assert got["volume_peak_count"] == sum(y - x > 1 or x == 120 for x, y in zip(peaks, peaks[1:], strict=False))
    near = {t: sum(v[max(0, t - 4) : t + 5]) for t in range(n - 4)}
    top = max(near, key=near.get)
    rise, fall = min(range(top), key=near.get), min(range(top + 1, n - 4), key=near.get)
    assert abs(got["vol_tide_ratio"] - (c[rise] / c[fall] - 1) / (fall - rise)) < 1e-12


def test_flat_and_short_sessions_have_no_infinite_values():
    for n in (1, 2, 6, 30):
        flat = [np.full(n, 10.0)] * 4 + [np.zeros(n)] * 2
        for f in (k.dos, k.flow):
            assert all(math.isnan(v) or math.isfinite(v) for v in f(*flat).values())


def test_known_values():
    o, c = np.array([10.0, 10, 11, 11]), np.array([10.0, 11, 11, 12])
    h, low, v = np.maximum(o, c), np.minimum(o, c), np.array([1.0, 1, 1, 1])
    d, f = k.dos(o, h, low, c, v, c * v), k.flow(o, h, low, c, v, c * v)
    assert d["consist_volume"] == 0.5 and math.isnan(d["positive_consist_volume"])
    assert abs(d["single_vol_prop_entropy"] + sum(x / 4 * math.log(x / 4) for x in c / c.sum())) < 1e-12
    # the first bar stays out and an unchanged price counts as one upwards
    assert f["signed_amount_imbalance"] == 1.0 and f["traded_volume_above_close_share"] == 0.0
    c = np.array([10.0, 11, 10, 10])
    assert abs(k.flow(c, c, c, c, v, c * v)["signed_amount_imbalance"] - 11 / 31) < 1e-12


def test_complete_sessions_only(spark):
    data = [("a", 1, i, 1.0, 1.0) for i in range(4)] + [("b", 1, i, 1.0, -1.0 if i == 2 else 1.0) for i in range(4)] + [("c", 1, i, 1.0, 1.0) for i in range(3)]
    df = spark.createDataFrame(data, "ts_code string, trade_date int, minute_index int, open double, close double")
    assert rows(minute.complete(df, 4).select("ts_code").distinct()) == [("a",)]


def test_smart_bars_stop_at_the_crossing_one(spark):
    data = [("a", 1, 1, i, v, v * p, r) for i, (v, p, r) in enumerate([(10.0, 10.0, 0.1), (10.0, 20.0, 0.9), (10.0, 30.0, 0.5), (70.0, 40.0, 0.0)])]
    df = spark.createDataFrame(data, "ts_code string, trade_date int, day_index int, minute_index int, volume double, amount double, r double")
    got = minute.smart_ratio(df, {"s": (F.col("r"), 0.15)}).first()["s"]
    assert abs(got - 25.0 / 34.0) < 1e-12


def test_exclusions_give_the_reason_and_complete_keeps_the_rest(spark):
    good = [(i, 1.0, 1.0) for i in range(4)]
    data = {"whole": good, "beyond": [*good, (4, 1.0, 1.0), (9, 1.0, 1.0)], "short": good[:3], "long": [*good, (2, 1.0, 1.0)], "twice": [*good[:3], (2, 1.0, 1.0)], "zero": [*good[:3], (3, 0.0, 1.0)], "inf": [*good[:3], (3, 1.0, float("inf"))], "null": [*good[:3], (3, None, 1.0)], "out": [(7, 1.0, 1.0)], "bad_out": [*good, (4, -1.0, 1.0)]}
    df = spark.createDataFrame([(k, 1, *x) for k, v in data.items() for x in v] + [(None, 1, 0, 1.0, 1.0), ("whole", 1, None, 1.0, 1.0)], "ts_code string, trade_date int, minute_index int, open double, close double")
    assert rows(minute.exclusions(df, 4), "ts_code", "reason", "bars") == sorted([("beyond", "minute_index_out_of_range", 2), ("short", "bar_count_invalid", 3), ("long", "bar_count_invalid", 5), ("twice", "invalid_price", 1), ("zero", "invalid_price", 1), ("inf", "invalid_price", 1), ("null", "invalid_price", 1), ("out", "minute_index_out_of_range", 1), ("bad_out", "minute_index_out_of_range", 1)])
    kept = rows(minute.complete(df, 4).groupBy("ts_code").count())
    assert kept == [("bad_out", 4), ("beyond", 4), ("whole", 4)]
    assert minute.exclusions(df.limit(0)).count() == 0
