"""Factor risk: cross-sectional regressions, covariances that look back only, specific variance, attribution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def factor_returns(df: DataFrame, y: str, factors: list[str], weight: str, date: str = "trade_date") -> DataFrame:
    """Weighted least squares of y on an intercept and the factors in each cross-section: date, factor, value, r2, condition, n.

    Rows that lack any of them, or a positive weight, take no part; a cross-section needs two rows more than factors.
    """
    names = ["intercept", *factors]

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t[np.isfinite(t[[y, weight, *factors]].astype(float)).all(axis=1) & (t[weight] > 0)]
        if len(t) < len(names) + 1:
            return pd.DataFrame({date: pd.Series([], dtype=object), "factor": pd.Series([], dtype=object), "value": [], "r2": [], "condition": [], "n": pd.Series([], dtype="int64")})
        x = np.column_stack([np.ones(len(t)), t[factors].to_numpy(float)])
        v, w = t[y].to_numpy(float), t[weight].to_numpy(float)
        root = np.sqrt(w)[:, None]
        beta, _, _, s = np.linalg.lstsq(x * root, v * root[:, 0], rcond=None)
        rest = v - x @ beta
        mean = np.average(v, weights=w)
        whole = float((w * (v - mean) ** 2).sum())
        r2 = 1 - float((w * rest**2).sum()) / whole if whole > 0 else 0.0
        return pd.DataFrame({date: t[date].iloc[0], "factor": names, "value": beta, "r2": r2, "condition": float(s[0] / s[-1]) if s[-1] > 0 else np.inf, "n": len(t)})

    return df.select(date, y, weight, *factors).groupBy(date).applyInPandas(run, f"{date} {df.schema[date].dataType.simpleString()}, factor string, value double, r2 double, condition double, n bigint")


def neutralise(df: DataFrame, column: str, styles: list[str], date: str = "trade_date", group: str | None = None) -> DataFrame:
    """Residual of the column on an intercept (one per group, if given) and the styles in each cross-section."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        out = pd.Series(np.nan, index=t.index)
        ok = np.isfinite(t[[column, *styles]].astype(float)).all(axis=1)
        u = t[ok]
        parts = [pd.get_dummies(u[group]).to_numpy(float)] if group else [np.ones((len(u), 1))]
        x = np.column_stack([*parts, u[styles].to_numpy(float)])
        if len(u) > x.shape[1]:
            out[ok] = u[column].to_numpy(float) - x @ np.linalg.lstsq(x, u[column].to_numpy(float), rcond=None)[0]
        return t.assign(neutral=out)

    return df.groupBy(date).applyInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "neutral double"]))


def ewma_covariance(wide: np.ndarray, half_life: float, shrink: float = 0.0) -> np.ndarray:
    """Covariance of rows (oldest first) with weights that halve every half_life, shrunk to its diagonal, with no negative eigenvalue."""
    n = len(wide)
    w = 0.5 ** (np.arange(n - 1, -1, -1) / half_life)
    w /= w.sum()
    c = wide - w @ wide
    cov = (c * w[:, None]).T @ c
    cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov))
    value, vector = np.linalg.eigh((cov + cov.T) / 2)
    return (vector * np.maximum(value, 0)) @ vector.T


def covariance_as_of(returns: DataFrame, as_of: object, factors: list[str], half_life: float, shrink: float = 0.0, date: str = "trade_date") -> pd.DataFrame:
    """The covariance of factor returns strictly before a date; one row per session reaches the driver."""
    rows = returns.where(F.col(date) < F.lit(as_of)).groupBy(date).pivot("factor", factors).agg(F.first("value")).orderBy(date).toPandas()
    x = rows[factors].dropna().to_numpy(float)
    return pd.DataFrame(ewma_covariance(x, half_life, shrink), index=factors, columns=factors)


def specific_variance(residuals: DataFrame, half_life: float, shrink: float = 0.2, residual: str = "residual") -> DataFrame:
    """EWMA of squared residuals per security, drawn towards the median, within the 10 % and 90 % quantiles of all."""
    last = residuals.agg(F.max("day_index").alias("_last"))
    t = residuals.where(F.col(residual).isNotNull()).join(F.broadcast(last)).withColumn("_w", F.pow(F.lit(0.5), (F.col("_last") - F.col("day_index")) / F.lit(half_life)))
    v = t.groupBy("ts_code").agg((F.sum(F.col("_w") * F.col(residual) * F.col(residual)) / F.sum("_w")).alias("raw"))
    q = v.agg(F.expr("percentile(raw, array(0.1, 0.5, 0.9))").alias("q"))
    drawn = (1 - shrink) * F.col("raw") + shrink * F.col("q")[1]
    return v.join(F.broadcast(q)).select("ts_code", "raw", F.least(F.greatest(drawn, F.col("q")[0]), F.col("q")[2]).alias("variance"))


def forecast(weights: np.ndarray, exposures: np.ndarray, covariance: np.ndarray, specific: np.ndarray) -> dict[str, float]:
    """Variance of a portfolio: from factors, from single names, and in total."""
    f = exposures.T @ weights
    factor, own = float(f @ covariance @ f), float((weights**2 * specific).sum())
    return {"factor": factor, "specific": own, "total": factor + own, "volatility": float(np.sqrt(factor + own))}


def rolling_attribution(series: pd.DataFrame, y: str, factors: list[str], window: int, half_life: float) -> pd.DataFrame:
    """Exponentially weighted regression of y on the factors over the `window` sessions strictly before each: betas and contributions."""
    rows = []
    x, v = series[factors].to_numpy(float), series[y].to_numpy(float)
    for t in range(window, len(series)):
        w = np.sqrt(0.5 ** (np.arange(window - 1, -1, -1) / half_life))[:, None]
        a = np.column_stack([np.ones(window), x[t - window : t]])
        beta = np.linalg.lstsq(a * w, v[t - window : t] * w[:, 0], rcond=None)[0]
        part = beta[1:] * x[t]
        rows.append([series["trade_date"].iloc[t], *beta[1:], *part, v[t] - part.sum()])
    return pd.DataFrame(rows, columns=["trade_date", *(f"beta_{f}" for f in factors), *(f"part_{f}" for f in factors), "specific"])


def rolling_beta(y: str, x: str, before: int, least: int) -> Column:
    """Beta of y on x over the last `before` sessions including this one, null with fewer than `least` pairs."""
    w = Window.partitionBy("ts_code").orderBy("day_index").rangeBetween(-(before - 1), 0)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    u, v = F.when(both, F.col(x)), F.when(both, F.col(y))
    var = F.var_pop(u).over(w)
    return F.when((F.count(u).over(w) >= least) & (var > 1e-18), F.covar_pop(u, v).over(w) / var)


def styles(panel: DataFrame) -> DataFrame:
    """beta60, residual volatility, momentum, liquidity and turnover from prices to date (windows 60 and 20, at least 40 and 15)."""
    def w(n: int) -> Window:
        return Window.partitionBy("ts_code").orderBy("day_index").rangeBetween(-(n - 1), 0)

    enough = lambda c, n, least, value: F.when(F.count(c).over(w(n)) >= least, value)
    p = panel.withColumn("beta60", rolling_beta("RET", "MKT", 60, 40)).withColumn("_e", F.col("RET") - F.col("beta60") * F.col("MKT")).withColumn("_l", F.when(F.col("RET") > -1, F.log1p("RET"))).withColumn("_a", F.when(F.col("V") > 0, F.ln(F.col("V"))))
    return p.withColumn("residual_vol", enough("_e", 60, 40, F.stddev_samp("_e").over(w(60)))).withColumn("momentum", enough("_l", 60, 40, F.sum("_l").over(w(60)))).withColumn("liquidity", enough("_a", 20, 15, F.avg("_a").over(w(20)))).withColumn("turnover", enough("V", 20, 15, F.avg("V").over(w(20)))).drop("_e", "_l", "_a")


def active_contribution(portfolio: DataFrame, benchmark: DataFrame, returns: DataFrame, group: str) -> DataFrame:
    """Per session and group: active weight and contribution; a name that one side lacks has weight 0 there."""
    both = portfolio.select("trade_date", "ts_code", F.col("weight").alias("_p")).join(benchmark.select("trade_date", "ts_code", F.col("weight").alias("_b")), ["trade_date", "ts_code"], "full")
    active = F.coalesce("_p", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))
    return both.join(returns, ["trade_date", "ts_code"], "left").groupBy("trade_date", group).agg(F.sum(active).alias("active_weight"), F.sum(active * F.coalesce("ret", F.lit(0.0))).alias("contribution"))
