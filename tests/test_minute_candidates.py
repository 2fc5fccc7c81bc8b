"""The candidate columns of full sessions against numpy."""

import datetime

import numpy as np
import pytest
from quillstone.operators import minute

EDGES = (0, *minute.STARTS, minute.SESSION)


@pytest.fixture(scope="module")
def days(spark):
    rng = np.random.default_rng(3)
    out, rows = [], []
    for day in range(12):
        close = np.round(10 + np.cumsum(rng.normal(0, 0.02, 241)), 2)  # repeated prices make ties
        volume = rng.integers(1, 9, 241).astype(float) * 100
        out.append((close, volume))
        rows += [("A", datetime.date(2026, 1, 1 + day), day + 1, t, float(np.append(close[0], close)[t]), float(close[t]), float(volume[t]), float(close[t] * volume[t])) for t in range(241)]
    return out, spark.createDataFrame(rows, "ts_code string, trade_date date, day_index int, minute_index int, open double, close double, volume double, amount double")


def test_candidates_of_a_full_session(days):
    raw, bars = days
    got = {x.day_index: x for x in minute.candidates(bars).collect()}
    shares = []
    for day, (close, volume) in enumerate(raw, 1):
        x, amount = got[day], close * volume
        r = np.append(0, np.diff(np.log(close)))
        rv = np.array([np.sqrt((r[max(0, t - 4) : t + 1] ** 2).sum()) for t in range(241)])
        order = np.argsort(close, kind="stable")
        near = lambda a, b: a == pytest.approx(b, rel=1e-6, abs=1e-9)
        assert near(x.high_price_vol_ratio, rv[order[-49:]].mean() / rv.mean()) and near(x.low_price_vol_ratio, rv[order[:49]].mean() / rv.mean())
        assert near(x.return_damount_corr, np.corrcoef(r[1:], np.diff(amount))[0, 1]) and near(x.price_dvolume_corr, np.corrcoef(close[1:], np.diff(volume))[0, 1])
        parts = [slice(a, b) for a, b in zip(EDGES, EDGES[1:], strict=False)]
        back = [np.log(close[p][-1] / close[p][0]) for p in parts]
        assert near(x.mf_segment_return_dispersion, np.std(back)) and near(x.mf_tail30_minus_open30_return, back[7] - back[0])
        sums = [amount[p].sum() for p in parts]
        assert near(x.mf_tail30_amount_to_segment_median, np.log(sums[7] / sorted(sums)[3])) and near(x.mf_open30_amount_share, sums[0] / amount.sum())
        corr = [np.corrcoef(r[max(p.start, 1) : p.stop], amount[max(p.start, 1) : p.stop])[0, 1] for p in parts]
        assert near(x.cpv_segment_std, np.std(corr)) and near(x.mf_tail30_minus_open30_ra_corr, np.arctanh(corr[7]) - np.arctanh(corr[0]))
        share = amount / amount.sum()
        if day <= 10:
            assert x.mf_minute_amount_seasonality_return_corr_w20 is None
        else:
            assert near(x.mf_minute_amount_seasonality_return_corr_w20, np.corrcoef(r, share / (np.mean(shares, axis=0) + 1e-12))[0, 1])
        shares.append(share)


def test_chips_count_empty_bins_too(days):
    raw, bars = days
    for x, (close, volume) in zip(minute.chip_features(bars).orderBy("day_index").collect(), raw, strict=True):
        p = np.bincount(np.clip(np.floor(np.log(close / close[0]) * 100), -11, 10).astype(int) + 11, weights=close * volume, minlength=22) / (close * volume).sum()
        assert x.mf_chip_return_bin_std == pytest.approx(p.std()) and x.mf_chip_return_q80 == pytest.approx((np.argmax(np.cumsum(p) >= 0.8) - 11) * 0.01)


def test_means_and_z_look_only_at_earlier_sessions(spark):
    daily = spark.createDataFrame([("A", None, d, float(d)) for d in range(1, 25)], "ts_code string, trade_date date, day_index int, x double")
    got = {x.day_index: x for x in minute.prior_means(daily.withColumn("z", minute.prior_z("x")), {"x": "m"}).collect()}
    assert got[10].m is None and got[10].z is None and got[11].m == 5.5 and got[24].m == 13.5
    assert got[24].z == pytest.approx((24 - 13.5) / np.std(np.arange(4, 24), ddof=1))


def test_gaps_and_signed_amounts(days):
    raw, bars = days
    gaps, signed = ({x.day_index: x for x in f(bars).collect()} for f in (minute.gap_features, minute.signed_amounts))
    jumps = [np.log(b[0][0] / a[0][-1]) for a, b in zip(raw, raw[1:], strict=False)]
    for day, (close, volume) in enumerate(raw, 1):
        before, amount = np.append(close[0], close[:-1]), close * volume
        sign = np.where(close >= before, 1, -1)
        sign[121] = 1 if close[121] >= before[121] else -1  # these bars open at the close before them
        assert signed[day].mf_signed_amount_imbalance == pytest.approx((sign * amount)[1:].sum() / amount[1:].sum())
        assert signed[day].mf_tail30_signed_amount_imbalance == pytest.approx((sign * amount)[-30:].sum() / amount[-30:].sum())
        if day < 6:
            assert gaps[day].mf_overnight_gap_sum_w5 is None
        else:
            assert gaps[day].mf_overnight_gap_sum_w5 == pytest.approx(sum(jumps[day - 6 : day - 1]))
        if day > 1:
            assert gaps[day].mf_gap_open30_reversal == pytest.approx(-(1 if jumps[day - 2] >= 0 else -1) * np.log(close[30] / close[0]))
        assert gaps[day].mf_lunch_gap == pytest.approx(0)


def test_resilience_takes_segments_below_a_fifth_of_the_prior_ones(spark):
    rows = [("A", datetime.date(2026, 1, d), d, k, float(d if d < 12 else -1 - k), 0.5 + k) for d in range(1, 13) for k in range(3)]
    got = {x.day_index: x.mf_market_down_resilience for x in minute.down_resilience(spark.createDataFrame(rows, "ts_code string, trade_date date, day_index int, segment int, others double, residual double")).collect()}
    assert got[12] == 1.5 and all(got[d] is None for d in range(1, 12))


SCHEMA = "ts_code string, trade_date date, day_index int, minute_index int, open double, close double, volume double, amount double"


def _market(spark, codes=5, days=24, idle=()):
    """Full sessions of several securities: arrays by (code, day), and the bars. In `idle` (code, day, segment) nothing is traded."""
    rng = np.random.default_rng(11)
    raw, rows = {}, []
    for c in range(codes):
        for d in range(1, days + 1):
            close = 10 * np.exp(np.cumsum(rng.normal(0, 0.001, 241)))
            open_ = np.append(close[0] * 0.999, close[:-1]) * np.exp(rng.normal(0, 0.0002, 241))
            volume = rng.integers(1, 9, 241).astype(float) * 100
            volume[0] = 5000
            volume[1 + rng.integers(0, 240, 3)] *= 12
            for _, _, k in (x for x in idle if x[:2] == (c, d)):
                volume[1 + 5 * k : 6 + 5 * k] = 0
            amount = close * volume
            raw[c, d] = (open_, close, volume, amount)
            rows += [(f"S{c}", datetime.date(2026, 1, 1) + datetime.timedelta(d), d, t, *(float(x[t]) for x in raw[c, d])) for t in range(241)]
    return raw, spark.createDataFrame(rows, SCHEMA)


def _segment_returns(open_, close, amount):
    """By the bars' places: from the close before the five minutes, after lunch from the open; none without trade."""
    out = []
    for k in range(48):
        a = 1 + 5 * k
        base = open_[121] if a == 121 else close[a - 1]
        out.append(np.log(close[a + 4] / base) if (amount[a : a + 5] > 0).any() else np.nan)
    return np.array(out)


def test_residuals_ranks_and_flows_of_full_sessions(spark):
    """Plain loops over 24 full sessions of 5 securities, one of which has a segment without trade and isn't a member on two sessions."""
    idle = [(4, 22, 7), (4, 15, 30)]
    raw, bars = _market(spark, idle=idle)
    away = {(3, 23), (3, 10)}
    bars = bars.withColumn("member", ~((minute.F.col("ts_code") == "S3") & minute.F.col("day_index").isin([d for _, d in away])))
    residuals = minute.market_residuals(minute.segments(bars, 48)).cache()
    got = {(x.ts_code, x.day_index): x for x in minute.residual_features(residuals).join(minute.rank_features(residuals), minute.DAY).join(minute.abnormal_flows(residuals), minute.DAY).collect()}
    ret = {k: _segment_returns(x[0], x[1], x[3]) for k, x in raw.items()}
    near = lambda a, b: a is None and (b is None or np.isnan(b)) or a == pytest.approx(b, rel=1e-7, abs=1e-10)

    def others(c, d, k):
        inside = [ret[m, d][k] for m in range(5) if (m, d) not in away and not np.isnan(ret[m, d][k])]
        return (sum(inside) - ret[c, d][k]) / (len(inside) - 1), len(inside)

    for d in (12, 22, 23, 24):
        e, rank = {}, {}
        needed = max(-(-4 * sum((m, d) not in away for m in range(5)) // 5), 3)
        for c in range(5):
            pairs = [(ret[c, p][k], others(c, p, k)[0]) for p in range(max(1, d - 20), d) for k in range(48) if not np.isnan(ret[c, p][k])]
            own, rest = np.array(pairs).T
            beta = ((own - own.mean()) * (rest - rest.mean())).sum() / ((rest - rest.mean()) ** 2).sum()
            e[c] = np.array([ret[c, d][k] - beta * others(c, d, k)[0] if others(c, d, k)[1] >= needed else np.nan for k in range(48)])
        for k in range(48):
            inside = [m for m in range(5) if (m, d) not in away and not np.isnan(e[m][k])]
            for m in inside:
                rank[m, k] = sum(e[x][k] < e[m][k] for x in inside) / (len(inside) - 1) if len(inside) >= needed else np.nan
        for c in range(5):
            x, q = got[f"S{c}", d], [rank.get((c, k), np.nan) for k in range(48)]
            whole = not np.isnan(e[c]).any()
            assert near(x.mf_market_residual_return, e[c].sum()) and near(x.mf_market_residual_rv, np.sqrt((e[c] ** 2).sum())) and near(x.mf_tail30_market_residual_return, e[c][42:].sum())
            pairs = [(q[k], q[k + 1]) for k in range(47) if k != 23]
            top = np.mean([a >= 0.7 and b >= 0.7 for a, b in pairs]) if not np.isnan(pairs).any() else None
            assert near(x.mf_cs_rank_top30_persistence, top) and near(x.mf_cs_rank_tail30_minus_open30, np.mean(q[42:]) - np.mean(q[:6]))
            assert (c, d) not in away or top is None
            # flows
            share = {p: np.array([raw[c, p][3][1 + 5 * k : 6 + 5 * k].sum() for k in range(48)]) / raw[c, p][3].sum() for p in range(max(1, d - 20), d + 1)}
            base = np.mean([share[p] for p in range(max(1, d - 20), d)], axis=0)
            amount = share[d] * raw[c, d][3].sum()
            excess, hot = np.maximum(amount - amount.sum() * base, 0), share[d] >= 2 * base
            assert hot.any()
            assert near(x.mf_abnormal_signed_amount_imbalance, (np.sign(ret[c, d]) * excess)[hot].sum() / excess[hot].sum() if whole else None)
            k, sums, broken = 0, [], False
            while k < 46:
                broken |= np.isnan(ret[c, d][k])
                if hot[k] and not np.isnan(e[c][k + 1 : k + 3]).any():
                    sums.append(np.sign(ret[c, d][k]) * e[c][k + 1 : k + 3].sum())
                    k += 2
                k += 1
            assert near(x.mf_abnormal_flow_followthrough_10m, np.mean(sums) if sums and not broken else None)
    assert got["S4", 22].mf_market_residual_return is None and got["S0", 22].mf_market_residual_return is not None


def test_costs_and_outstanding_volume_of_full_sessions(spark):
    raw, bars = _market(spark, codes=1, days=2, idle=[(0, 2, k) for k in range(6, 12)])
    costs, up = ({x.day_index: x for x in f(bars).collect()} for f in (minute.traded_costs, minute.volume_up_returns))
    for d in (1, 2):
        open_, close, v, a = raw[0, d]
        p, traded = close, v > 0
        vw = a.sum() / v.sum()
        assert costs[d].mf_traded_volume_above_close_share == pytest.approx(v[traded & (p > close[240])].sum() / v.sum())
        assert costs[d].mf_traded_cost_dispersion == pytest.approx(np.sqrt((v * (p - vw) ** 2).sum() / v.sum()) / vw)
        order = np.argsort(p)
        q = p[order][np.searchsorted(np.cumsum(v[order]), 0.85 * v.sum())]
        assert costs[d].mf_cost_q85_to_close == pytest.approx((q - close[240]) / vw)
        assert costs[d].mf_pm_am_vwap_log_ratio == pytest.approx(np.log(a[121:].sum() / v[121:].sum() / (a[:121].sum() / v[:121].sum())))
        move = np.log(close / np.append(np.nan, close[:-1]))
        move[121] = np.log(close[121] / open_[121])
        parts = [np.nansum((np.sign(move) * a)[1 + 30 * k : 31 + 30 * k]) > 0 for k in range(8)]
        assert costs[d].mf_signed_amount_positive_segment_share == (pytest.approx(np.mean(parts)) if d == 1 else None)  # the second quarter hour of the second session has no trade
        r = np.append(np.nan, np.diff(np.log(close)))
        high = [t for t in range(1, 241) if v[t] > v.mean() + v.std()]
        assert v[0] > v.mean() + v.std()  # the opening bar stands out and doesn't count
        assert up[d].mf_volume_up_return_std == pytest.approx(-np.std(r[high]), abs=1e-12)


def test_one_outstanding_bar_besides_the_opening_has_no_deviation(spark):
    rows = [("A", datetime.date(2026, 1, 1), 1, t, 10.0, 10.0 + t % 3, 900.0 if t in (0, 120) else 1.0, 1.0) for t in range(241)]
    assert minute.volume_up_returns(spark.createDataFrame(rows, SCHEMA)).first().mf_volume_up_return_std == 0


def test_pooled_smart_money_and_spectra_of_full_sessions(spark):
    from quillstone.operators import session_curves

    raw, bars = _market(spark, codes=2, days=24)
    bars = bars.where("not (ts_code = 'S1' and day_index in (5, 6, 7))")
    raw = {k: v for k, v in raw.items() if k not in {(1, 5), (1, 6), (1, 7)}}
    want = {}
    for (c, d), x in raw.items():
        days = [p for p in range(d - 1, 0, -1) if (c, p) in raw][:9]
        pool = [raw[c, p] for p in days] + [x]
        o, cl, v, a = (np.concatenate([y[i] for y in pool]) for i in range(4))
        key = np.abs(np.log(cl / o)) / np.where(v > 0, v, 1) ** 0.25
        order = [i for i in np.argsort(-key, kind="stable") if v[i] > 0]
        n = int(np.searchsorted(np.cumsum(v[order]), 0.2 * v.sum())) + 1
        want[f"S{c}", d] = a[order[:n]].sum() / v[order[:n]].sum() / (a.sum() / v.sum()) if len(days) >= 5 else None
    for block in (3, 60, 1000):
        got = {(x.ts_code, x.day_index): x[3] for x in session_curves.pooled_smart_ratio(bars, block=block).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-9) if want[k] is not None else got[k] is None for k in want)
    got = {(x.ts_code, x.day_index): (x[3], x[4]) for x in session_curves.periodicity(bars).collect()}
    for (c, d), x in raw.items():
        earlier = [raw[c, p][3] / raw[c, p][3].sum() for p in range(d - 1, 0, -1) if (c, p) in raw][:20]
        if len(earlier) < 10:
            assert got[f"S{c}", d] == (None, None)
            continue
        z = x[3] / x[3].sum() - np.mean(earlier, axis=0)
        z = z - z.mean()
        power = np.array([abs(sum(z[t] * np.exp(2j * np.pi * k * t / 241) for t in range(241))) ** 2 for k in range(1, 31)])
        assert got[f"S{c}", d] == pytest.approx((power.max() / power.sum(), power[4:20].sum() / power.sum()))
    none = bars.limit(0)
    assert session_curves.pooled_smart_ratio(none).count() == 0 and session_curves.periodicity(none).count() == 0
    assert session_curves.periodicity(bars.withColumn("amount", minute.F.lit(0.0))).where("mf_amount_periodicity_peak_share_w20 is not null").count() == 0


def test_pooled_curves_come_in_order_and_no_more_than_a_pool_are_held():
    import pyarrow as pa

    from quillstone.operators import session_curves

    def days():
        for d in range(1, 200):
            alive.append(d)
            yield pa.RecordBatch.from_pydict({"ts_code": ["S"], "trade_date": [d], "day_index": [d], "key": [[3.0, 2.0]], "volume": [[1.0, 9.0]], "amount": [[2.0, 9.0 + d]], "_own": [d > 40]})

    alive: list[int] = []
    got = session_curves._pooled(0.2, 10, 5, 40, "q")(days())
    assert next(got).to_pydict()["trade_date"] == [41] and alive[-1] == 41  # results come while a block is still read
    assert [x["trade_date"][0].as_py() for x in got] == list(range(42, 200))
