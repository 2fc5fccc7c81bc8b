"""Research loops around models: windows, folds, linear fits from summed products, feature filters, fusion, bootstrap."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators import evaluate as ev
from quillstone.operators import portfolio


@dataclass(frozen=True)
class Split:
    """Sessions to train on and to predict, by their numbers, both ends included."""

    train: tuple[int, int]
    test: tuple[int, int]


def rolling_windows(sessions: list[tuple[int, object]], train: int, lag: int, period: str = "month") -> list[Split]:
    """For each calendar month, quarter or year with enough history: the `train` sessions that end `lag` sessions before it.

    sessions are (number, date) in order. The lag keeps labels that reach into the period out of training.
    """
    months = {"month": 1, "quarter": 3, "year": 12}[period]
    key = lambda d: (d.year, (d.month - 1) // months)
    periods: dict[tuple[int, int], list[int]] = {}
    for n, d in sessions:
        periods.setdefault(key(d), []).append(n)
    first = sessions[0][0] if sessions else 0
    out = []
    for days in periods.values():
        end = days[0] - lag
        if end - train + 1 >= first:
            out.append(Split((end - train + 1, end), (days[0], days[-1])))
    return out


def purged_folds(first: int, last: int, folds: int, size: int, gap: int) -> list[Split]:
    """The last `folds` blocks of `size` sessions as tests, each trained on what ends `gap` sessions before it."""
    out = []
    for k in range(folds, 0, -1):
        a = last - k * size + 1
        if a - gap - 1 >= first:
            out.append(Split((first, a - gap - 1), (a, a + size - 1)))
    return out


def gram(df: DataFrame, features: list[str], label: str, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, X'y and rows of complete cases, as sums that every partition adds up first; X has an intercept last."""
    w = F.lit(1.0) if weight is None else weight
    x = [*(F.col(c) for c in features), F.lit(1.0)]
    ok = df.where(" and ".join(f"{c} is not null and not isnan({c})" for c in (*features, label)))
    k = len(x)
    row = ok.agg(*(F.sum(w * x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(w * x[i] * F.col(label)).alias(f"m{i}") for i in range(k)), F.count("*").alias("n")).first()
    g, m = np.zeros((k, k)), np.array([row[f"m{i}"] or 0.0 for i in range(k)])
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g, m, row["n"]


def ridge(g: np.ndarray, m: np.ndarray, penalty: float) -> np.ndarray:
    """Coefficients and intercept; the intercept isn't penalised."""
    return np.linalg.solve(g + penalty * np.diag([*([1.0] * (len(m) - 1)), 0.0]), m)


def elastic_net(g: np.ndarray, m: np.ndarray, n: int, l1: float, l2: float, rounds: int = 500) -> np.ndarray:
    """Coordinate descent on the summed products: 1/2n residuals + l1 |b| + l2/2 b²; the intercept isn't penalised."""
    b, k = np.zeros(len(m)), len(m) - 1
    for _ in range(rounds):
        before = b.copy()
        for j in range(k + 1):
            r = (m[j] - g[j] @ b + g[j, j] * b[j]) / n
            b[j] = r / (g[j, j] / n) if j == k else math.copysign(max(abs(r) - l1, 0.0), r) / (g[j, j] / n + l2)
        if np.abs(b - before).max() < 1e-12:
            break
    return b


def predict(df: DataFrame, features: list[str], coefficients: np.ndarray, name: str = "prediction") -> DataFrame:
    """A linear model as a column expression, null where a feature is."""
    total = F.lit(float(coefficients[-1]))
    for c, b in zip(features, coefficients, strict=False):
        total = total + F.col(c) * F.lit(float(b))
    return df.withColumn(name, total)


def filter_features(df: DataFrame, features: list[str], score: dict[str, float], coverage: float = 0.5, correlation: float = 0.9) -> list[str]:
    """Features that are present and vary, best score first, leaving out those that correlate too closely with one kept."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    row = df.agg(F.count("*").alias("n"), *(F.count(c).alias(f"n_{c}") for c in features), *(F.stddev_pop(c).alias(f"s_{c}") for c in features), *(ev.safe_corr(a, b).alias(f"c_{a}_{b}") for a, b in pairs)).first()
    near = lambda a, b: abs((row[f"c_{a}_{b}"] if (a, b) in pairs else row[f"c_{b}_{a}"]) or 0.0)
    kept: list[str] = []
    for c in sorted(features, key=lambda c: (-abs(score.get(c, 0.0)), c)):
        if row[f"n_{c}"] >= coverage * row["n"] and (row[f"s_{c}"] or 0.0) > 1e-12 and all(near(c, k) < correlation for k in kept):
            kept.append(c)
    return kept


def fuse(predictions: DataFrame, models: list[str], by: list[str]) -> DataFrame:
    """Mean of the models' z-scores in each cross-section (population deviation), over the models that have one."""
    z = predictions
    for m in models:
        z = z.withColumn(f"_z_{m}", ev.z_score(m, by, sample=False))
    n = sum((F.col(f"_z_{m}").isNotNull().cast("int") for m in models), F.lit(0))
    total = sum((F.coalesce(f"_z_{m}", F.lit(0.0)) for m in models), F.lit(0.0))
    return z.withColumn("fused", F.when(n > 0, total / n)).drop(*(f"_z_{m}" for m in models))


def decay_weights(df: DataFrame, order: str, half_life: float, name: str = "weight") -> DataFrame:
    """df with weights that halve every half_life sessions back from the last, which one aggregate finds and a join of one row tells all."""
    last = df.agg(F.max(order).alias("_last"))
    return df.join(F.broadcast(last)).withColumn(name, F.pow(F.lit(0.5), (F.col("_last") - F.col(order)) / F.lit(half_life))).drop("_last")


def relevance(label: str, by: list[str], levels: int = 31) -> Column:
    """Grades 0 .. levels - 1 of equal counts for ranking losses, null labels have none."""
    w = Window.partitionBy(*by, F.col(label).isNull()).orderBy(label, "ts_code")
    return F.when(F.col(label).isNotNull(), F.ntile(levels).over(w) - 1)


def block_bootstrap(x: np.ndarray, block: int = 20, reps: int = 2000, seed: int = 7) -> tuple[float, float]:
    """95 % interval of the mean of a series from means of resampled blocks; a few thousand points on the driver."""
    x = np.asarray(x, float)[np.isfinite(x)]
    if len(x) < block:
        return math.nan, math.nan
    starts = np.random.default_rng(seed).integers(0, len(x) - block + 1, (reps, -(-len(x) // block)))
    means = x[(starts[:, :, None] + np.arange(block)).reshape(reps, -1)[:, : len(x)]].mean(axis=1)
    low, high = np.quantile(means, [0.025, 0.975])
    return float(low), float(high)


def softmax_targets(days: pd.DataFrame, temperature: float, cap: float, turnover: float) -> pd.DataFrame:
    """Capped softmax weights of each session's scores, approached within a turnover limit; names without score are sold."""
    rows, w = [], {}
    for date, t in days.groupby("trade_date", sort=True):
        t = t[t["score"].notna()].sort_values("ts_code")
        codes = sorted(set(t["ts_code"]) | set(w))
        score = dict(zip(t["ts_code"], t["score"], strict=True))
        if score:
            top = max(score.values())
            goal = portfolio.capped_simplex(np.array([math.exp((score[c] - top) / temperature) if c in score else 0.0 for c in codes]), max(cap, 1 / len(score)))
        else:
            goal = np.array([w.get(c, 0.0) for c in codes])
        old = np.array([w.get(c, 0.0) for c in codes])
        new = goal if not w else portfolio.limit_turnover(old, goal, turnover)
        w = {c: float(x) for c, x in zip(codes, new, strict=True) if x > 1e-12}
        rows += [(date, c, x) for c, x in w.items()]
    return pd.DataFrame(rows, columns=["trade_date", "ts_code", "target_weight"])


def hysteresis(days: pd.DataFrame, enter: float, leave: float) -> pd.DataFrame:
    """Members per session: in once within the first `enter` share of ranks, out once beyond the first `leave` share; equal weights."""
    rows, held = [], set()
    for date, t in days.groupby("trade_date", sort=True):
        t = t[t["score"].notna()].sort_values(["score", "ts_code"], ascending=[False, True])
        place = {c: (i + 1) / len(t) for i, c in enumerate(t["ts_code"])}
        held = {c for c, p in place.items() if p <= enter or (c in held and p <= leave)}
        rows += [(date, c, 1 / len(held)) for c in sorted(held)]
    return pd.DataFrame(rows, columns=["trade_date", "ts_code", "target_weight"])


def orders(weights: DataFrame, capital: float, lot: int = 100) -> DataFrame:
    """Whole lots for target weights at given prices, with exact decimals for export."""
    shares = F.floor(F.col("target_weight") * F.lit(capital) / F.col("price") / F.lit(lot)).cast("bigint") * lot
    return weights.where("price > 0").select("trade_date", "ts_code", F.col("target_weight").cast("decimal(12,8)").alias("target_weight"), shares.alias("shares"), (F.rint(shares * F.col("price") * 100) / 100).cast("decimal(18,2)").alias("notional"))
