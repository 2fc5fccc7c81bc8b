"""Features of a session that need its bars as arrays: regressions, spectra, distributions, support areas.

Bars of a stock-day are gathered in order into one row (a session has a fixed, small number of bars) and numpy works on
whole rows; everything that sums or ranks over bars is in the minute module, on the JVM's side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume", "amount")
DOS = (
    "illiq_shortcut", "positive_consist_volume", "consist_volume", "vol_prop_entropy", "single_vol_prop_entropy", "flash_volatility", "flash_returns", "vol_tide_ratio", "corr_ret_amount", "corr_ret_lag_amount", "corr_lag_ret_amount",
    "resilience_cov", "peak_climbing_cov", "prop_t_dis", "prop_normal_dis", "prop_naive_act", "prop_uniform_dis", "volume_peak_count", "ratio_fuzziness_amount", "ratio_fuzziness_volume", "ratio_fuzziness_amt_corr",
    "p_dis_vol", "b_dis_vol", "vsa_ratio", "fuzz_diff", "dawn_fog_vol_persist", "canopy_t", "canopy_f", "up_centroid", "down_centroid",
)
#: Bars from the opening to 14:57, which most of these features look at, and the last row of the regression on volume changes (fixed values); the bar after which the lunch break comes.
CONTINUOUS, REGRESSED, NOON = 238, 239, 120
FLOW = ("signed_amount_imbalance", "tail30_signed_amount_imbalance", "signed_amount_positive_segment_share", "traded_volume_above_close_share", "traded_cost_dispersion", "cost_q85_to_close", "pm_am_vwap_log_ratio", "amount_periodicity_peak_share", "amount_periodicity_band_power")


def sessions(bars: DataFrame) -> DataFrame:
    """One row per stock-day with an array for each field, in order of the bars."""
    key = ["ts_code", "trade_date", "day_index"]
    packed = bars.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("minute_index", *FIELDS))).alias("bars"))
    return packed.select(*key, *(F.col(f"bars.{c}").alias(c) for c in FIELDS))


def corr(a: np.ndarray, b: np.ndarray) -> float:
    ok = np.isfinite(a) & np.isfinite(b)
    a, b = a[ok], b[ok]
    if len(a) < 2 or a.std() < 1e-12 or b.std() < 1e-12:
        return math.nan
    return float(np.mean((a - a.mean()) * (b - b.mean())) / (a.std() * b.std()))


def incomplete_beta(a: float, b: float, x: np.ndarray | float) -> np.ndarray:
    """The regularised incomplete beta function of each x, by its continued fraction, for all of them at once."""
    x = np.asarray(x, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        swap = x > (a + 1) / (a + b + 2)
        p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
        front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(z) + q * np.log1p(-z)) / p
        kept = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
        c, d = np.ones_like(z), 1 / kept(1 - (p + q) * z / (p + 1))
        total = d.copy()
        for m in range(1, 300):
            for n in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / kept(1 + n * d)
                c = kept(1 + n / c)
                total = total * c * d
            if not (np.abs(c * d - 1) >= 1e-14).any():
                break
        part = front * total
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(swap, 1 - part, part)))


def t_cdf(x: np.ndarray, df: float) -> np.ndarray:
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + np.square(x)))
    return np.where(x > 0, 1 - tail, tail)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])


def ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """t-statistics of an intercept and the columns of x, and the F-statistic; nan where the fit is degenerate."""
    n, k = len(y), x.shape[1] + 1
    nothing = np.full(k, math.nan), math.nan
    if n <= k:
        return nothing
    a = np.column_stack([np.ones(n), x])
    gram = a.T @ a
    if np.linalg.matrix_rank(gram) < k:
        return nothing
    inverse = np.linalg.inv(gram)
    beta = inverse @ (a.T @ y)
    rest = float(((y - a @ beta) ** 2).sum())
    whole = float(((y - y.mean()) ** 2).sum())
    if rest <= 1e-24:
        return nothing
    var = rest / (n - k)
    return beta / np.sqrt(np.maximum(np.diag(inverse) * var, 1e-300)), ((whole - rest) / (k - 1)) / var


def rolling_std(x: np.ndarray, n: int) -> np.ndarray:
    """Sample deviation of the last n values; nan until there are n."""
    out = np.full(len(x), math.nan)
    if len(x) >= n:
        w = np.lib.stride_tricks.sliding_window_view(x, n)
        out[n - 1 :] = w.std(axis=1, ddof=1)
    return out


def _share(part: np.ndarray, whole: np.ndarray) -> float:
    total = whole.sum()
    return float(part.sum() / total) if total > 0 else math.nan


def _mean(x: np.ndarray) -> float:
    x = x[np.isfinite(x)]
    return float(x.mean()) if len(x) else math.nan


def support_area(close: np.ndarray, volume: np.ndarray, share: float = 0.5) -> tuple[float, float]:
    """Lowest and highest close of the area around the price of largest volume (the lowest of equal ones).

    Prices join by their distance from it, of equally far ones that of larger volume first, until they hold the
    share of all volume. nan without volume.
    """
    price, at = np.unique(close, return_inverse=True)
    v = np.bincount(at, weights=volume)
    if not v.sum() > 0:
        return math.nan, math.nan
    order = np.lexsort((price, -v, np.abs(price - price[v.argmax()])))
    reached = np.cumsum(v[order] / v.sum()) >= share
    area = price[order[: int(reached.argmax()) + 1]] if reached.any() else price
    return float(area.min()), float(area.max())


def tide(close: np.ndarray, volume: np.ndarray) -> float:
    """Slope of the price from the trough before the tide of volume to the one after it; volumes add up over nine bars around each."""
    n = len(volume)
    if n < 5:
        return math.nan
    total = np.concatenate([[0.0], np.cumsum(volume)])
    t = np.arange(n - 4)
    near = total[t + 5] - total[np.maximum(t - 4, 0)]
    top = len(near) - 1 - int(near[::-1].argmax())  # the last of equal ones
    if top in (0, len(near) - 1):
        return math.nan
    rise, fall = int(near[:top].argmin()), top + 1 + int(near[top + 1 :].argmin())
    return float((close[rise] / close[fall] - 1) / (fall - rise))


def resilience(o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray, outstanding: bool) -> float:
    """Covariance of the return over the volatility of the last five bars' prices with that volatility; of outstanding ones only, if asked."""
    if len(c) < 5:
        return math.nan
    w = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, 5) for x in (o, h, low, c)], axis=1)
    adj = (w.std(axis=1, ddof=1) / w.mean(axis=1)) ** 2
    ret = c[4:] / c[3:-1] - 1
    ok = adj > 0
    if outstanding:
        ok &= adj > adj.mean() + adj.std(ddof=1) if len(adj) > 1 else False
    if not ok.any():
        return math.nan
    x, y = ret[ok] / adj[ok], adj[ok]
    return float(np.mean((x - x.mean()) * (y - y.mean())))


def dos(o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray, v: np.ndarray, a: np.ndarray) -> dict[str, float]:
    """Features of one session; nan where a denominator is zero or there are too few bars.

    All look at the bars of continuous trading, but for the resilience and the regression, which take the whole session.
    """
    out = {"resilience_cov": resilience(o, h, low, c, False)}
    dv, n = np.diff(v, prepend=math.nan), min(len(c), REGRESSED + 1)
    out["dawn_fog_vol_persist"] = out["canopy_t"] = out["canopy_f"] = math.nan
    with np.errstate(all="ignore"):
        if n > 14:
            t, f = ols(c[6:n] / c[5 : n - 1] - 1, np.column_stack([dv[6 - k : n - k] for k in range(6)]))
            out["dawn_fog_vol_persist"], out["canopy_t"], out["canopy_f"] = float(t[2:].std(ddof=1)), float(abs(t[0])), float(f)
        return out | _continuous(*(x[:CONTINUOUS] for x in (o, h, low, c, v, a)))


def _continuous(o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray, v: np.ndarray, a: np.ndarray) -> dict[str, float]:
    n, minute = len(c), np.arange(len(c))
    ret, dv, dc = np.concatenate([[math.nan], c[1:] / c[:-1] - 1]), np.diff(v, prepend=math.nan), np.diff(c, prepend=math.nan)
    r1, money = np.abs(np.log1p(ret)), c * v
    small = np.abs(c - o) <= 0.5 * np.abs(h - low)
    rising = small & (dc > 0)
    out = {"illiq_shortcut": float(np.sum((2 * (h - low) - np.abs(o - c))[money > 0] / money[money > 0]))}
    out["consist_volume"] = _share(v[small], v) if small.any() else math.nan
    out["positive_consist_volume"] = _share(v[rising], v) if rising.any() else math.nan
    for name, p in (("vol_prop_entropy", a / a.sum() if a.sum() > 0 else np.zeros(n)), ("single_vol_prop_entropy", (v / v.sum() if v.sum() > 0 else np.zeros(n)) * (c / c.sum()))):
        out[name] = float(-(p[p > 0] * np.log(p[p > 0])).sum()) if p.any() else math.nan
    jump = dv > np.nanmean(dv) + np.nanstd(dv, ddof=1) if n > 2 else np.zeros(n, bool)
    ahead = np.full(n, math.nan)
    if n > 5:
        ahead[1 : n - 4] = np.lib.stride_tricks.sliding_window_view(ret[1:], 5).std(axis=1, ddof=1)
    out["flash_volatility"], out["flash_returns"] = _mean(ahead[jump]), _mean(ret[jump])
    out["vol_tide_ratio"] = tide(c, v)
    out["corr_ret_amount"], out["corr_ret_lag_amount"], out["corr_lag_ret_amount"] = corr(r1, a), corr(r1[1:], a[:-1]), corr(r1[:-1], a[1:])
    out["peak_climbing_cov"] = resilience(o, h, low, c, True)
    # shares of the whole window's amount; the first bar has no return and adds to the denominator only
    s, sd = (float(x[1:].std(ddof=1)) if n > 2 else 0.0 for x in (ret, dc))
    weights = {"prop_t_dis": t_cdf(ret[1:] / s, 240) if s > 0 else None, "prop_normal_dis": normal_cdf(ret[1:] * 1.96 / 0.1), "prop_naive_act": t_cdf(dc[1:] / sd, 240) if sd > 0 else None, "prop_uniform_dis": (ret[1:] - 0.1) / 0.2}
    for name, w in weights.items():
        out[name] = _share(a[1:] * w, a) if w is not None else math.nan
    high = np.flatnonzero(v > v.mean() + v.std(ddof=1)) if n > 1 else np.empty(0, int)
    out["volume_peak_count"] = float(((np.diff(high) > 1) | (high[:-1] == NOON)).sum()) if len(high) else math.nan
    fuzz = np.full(n, math.nan)
    if n > 9:
        fuzz[9:] = rolling_std(rolling_std(ret[1:], 5)[4:], 5)[4:]
    fog = fuzz > _mean(fuzz)
    of = lambda x: float(x[fog].mean() / x.mean()) if fog.any() and x.mean() > 0 else math.nan
    out["ratio_fuzziness_amount"], out["ratio_fuzziness_volume"], out["fuzz_diff"] = of(a), of(v), of(v) - of(a)
    out["ratio_fuzziness_amt_corr"] = corr(fuzz, a)
    lowest, highest = support_area(c, v)
    out["p_dis_vol"], out["b_dis_vol"], out["vsa_ratio"] = lowest - float(h.max()), highest - float(low.min()), lowest - float(c.max())
    for name, side in (("up_centroid", ret > 0), ("down_centroid", ret < 0)):
        weight = np.abs(ret[side])
        out[name] = float((minute[side] * weight).sum() / weight.sum()) if weight.sum() > 0 else math.nan
    return out


def flow(o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray, v: np.ndarray, a: np.ndarray, tail: int = 30) -> dict[str, float]:
    """Signed flow, traded cost and the spectrum of amounts of one session."""
    n, out = len(c), {}
    traded = (a > 0) & (v > 0)
    base = np.concatenate([[o[0]], c[:-1]])
    if n > NOON + 1:
        base[NOON + 1] = o[NOON + 1]  # what happened over lunch isn't of this bar
    flows = traded & (np.arange(n) > 0)  # neither does the first bar count
    sign = np.where(c >= base, 1.0, -1.0) * flows
    out["signed_amount_imbalance"], out["tail30_signed_amount_imbalance"] = _share(sign * a, a * flows), _share((sign * a)[-tail:], (a * flows)[-tail:])
    parts = np.array_split(np.arange(1, n), 8)
    whole = [p for p in parts if len(p) and traded[p].any()]
    out["signed_amount_positive_segment_share"] = float(np.mean([(sign[p] * a[p]).sum() > 0 for p in whole])) if len(whole) == 8 else math.nan
    price, volume = a[traded] / v[traded], v[traded]
    out["traded_volume_above_close_share"] = _share(volume[price > c[-1]], volume) if len(volume) else math.nan
    out["traded_cost_dispersion"] = out["cost_q85_to_close"] = out["pm_am_vwap_log_ratio"] = math.nan
    if len(volume):
        vwap = float((price * volume).sum() / volume.sum())
        order = np.argsort(price, kind="stable")
        q85 = price[order][int(np.searchsorted(np.cumsum(volume[order]), 0.85 * volume.sum() - 1e-9))]
        out["traded_cost_dispersion"] = float(np.sqrt((volume * (price - vwap) ** 2).sum() / volume.sum()) / vwap)
        out["cost_q85_to_close"] = float((q85 - c[-1]) / vwap)
        morning = traded & (2 * np.arange(n) < n)  # the bar at noon is its last
        afternoon = traded & ~morning
        if morning.any() and afternoon.any():
            out["pm_am_vwap_log_ratio"] = float(np.log((a[afternoon].sum() / v[afternoon].sum()) / (a[morning].sum() / v[morning].sum())))
    share = a / a.sum() if a.sum() > 0 else np.zeros(n)
    power = np.abs(np.fft.rfft(share - share.mean()))[1:31] ** 2
    out["amount_periodicity_peak_share"] = float(power.max() / power.sum()) if power.sum() > 1e-24 else math.nan
    out["amount_periodicity_band_power"] = float(power[4:20].sum() / power.sum()) if power.sum() > 1e-24 else math.nan
    return out


def features(bars: DataFrame) -> DataFrame:
    """All kernels per stock-day, null where undefined."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = []
            for x in t.itertuples(index=False):
                arrays = [np.asarray(getattr(x, f), float) for f in FIELDS]
                rows.append([x.ts_code, x.trade_date, x.day_index, *(dos(*arrays)[k] for k in DOS), *(flow(*arrays)[k] for k in FLOW)])
            out = pd.DataFrame(rows, columns=["ts_code", "trade_date", "day_index", *DOS, *FLOW])
            yield out.replace([np.inf, -np.inf], np.nan)

    schema = ", ".join(["ts_code string, trade_date date, day_index int", *(f"{k} double" for k in (*DOS, *FLOW))])
    return sessions(bars).mapInPandas(run, schema)


def cross_sectional(df: DataFrame) -> DataFrame:
    """The features that need a session's other securities: canopy alpha signed by F, the centroid residual over 20 days, and the adjusted difference of volume and amount in the fog.

    Negative differences are divided by their deviation over the last eleven observed days and then scaled, so that the
    session's negative ones add up to what they did before. Windows over days go by observed rows.
    """
    day = Window.partitionBy("trade_date")
    df = df.withColumn("noon_canopy_alpha", F.when(F.col("canopy_f") > F.avg("canopy_f").over(day), F.col("canopy_t")).otherwise(-F.col("canopy_t")))
    both = F.col("up_centroid").isNotNull() & F.col("down_centroid").isNotNull()
    x, y = F.when(both, F.col("up_centroid")), F.when(both, F.col("down_centroid"))
    var = F.var_pop(x).over(day)
    slope = F.when(var > 1e-12, F.covar_pop(x, y).over(day) / var)
    df = df.withColumn("_e", y - F.avg(y).over(day) - slope * (x - F.avg(x).over(day)))
    rows = Window.partitionBy("ts_code").orderBy("day_index").rowsBetween(-19, 0)
    df = df.withColumn("fall_center_dev", F.avg("_e").over(rows)).drop("_e")
    d = F.col("fuzz_diff")
    std = F.stddev_samp(d).over(Window.partitionBy("ts_code").orderBy("day_index").rowsBetween(-10, 0))
    df = df.withColumn("_adj", F.when(d >= 0, d).when(std > 0, d / std))
    scale = F.try_divide(F.sum(F.when(d < 0, d)).over(day), F.sum(F.when(F.col("_adj") < 0, F.col("_adj"))).over(day))
    return df.withColumn("adj_fuzziness_diff", F.when(F.col("_adj") < 0, F.col("_adj") * scale).otherwise(F.col("_adj"))).drop("_adj")
