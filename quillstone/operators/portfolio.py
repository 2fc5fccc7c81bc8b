"""Portfolio construction and execution.

Targets and weights per session are windows and joins. What depends on the day before (ledgers, policies) is a fold
over one strategy's sessions: a small table by nature, one group for each strategy, so strategies run in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def staggered(scores: DataFrame, score: str, share: float, days: int) -> DataFrame:
    """Equal-weight top share of each session, held for `days` sessions in as many equal sleeves: target weights per session.

    A session's target is the mean over the sleeves of its last `days` sessions; each pick is written to the sessions
    that hold it, so there is one shuffle and no state.
    """
    w = Window.partitionBy("day_index").orderBy(F.col(score).desc(), "ts_code")
    t = scores.where(F.col(score).isNotNull()).withColumn("_k", F.row_number().over(w)).withColumn("_n", F.ceil(F.count("*").over(Window.partitionBy("day_index")) * share))
    picks = t.where(F.col("_k") <= F.col("_n")).select("ts_code", F.explode(F.sequence("day_index", F.col("day_index") + days - 1)).alias("day_index"), (1.0 / (F.col("_n") * days)).alias("w"))
    return picks.groupBy("day_index", "ts_code").agg(F.sum("w").alias("target_weight"))


def blend(targets: DataFrame, allocations: dict[str, float], source: str = "source") -> DataFrame:
    """Weights of several sources netted by their allocations, which must add up to one."""
    if abs(sum(allocations.values()) - 1) > 1e-9 or min(allocations.values()) < 0:
        raise ValueError("allocations must be non-negative and add up to 1")
    a = F.lit(None).cast("double")
    for name, part in allocations.items():
        a = F.when(F.col(source) == name, F.lit(part)).otherwise(a)
    return targets.withColumn("_w", F.col("target_weight") * a).where("_w is not null").groupBy("trade_date", "ts_code").agg(F.sum("_w").alias("target_weight"))


def allocation_weights(df: DataFrame, score: str, kind: str, by: list[str]) -> DataFrame:
    """weight: equal, by rank, or by z-scores clipped to 0..3, adding up to one in each cross-section."""
    w = Window.partitionBy(*by)
    if kind == "equal":
        raw: Column = F.lit(1.0)
    elif kind == "rank":
        raw = F.row_number().over(w.orderBy(F.col(score).asc(), F.col("ts_code").desc())).cast("double")
    elif kind == "z":
        sd = F.stddev_pop(score).over(w)
        raw = F.least(F.greatest(F.when(sd > 1e-12, (F.col(score) - F.avg(score).over(w)) / sd), F.lit(0.0)), F.lit(3.0))
    else:
        raise ValueError(f"no allocation {kind!r}")
    return df.withColumn("_raw", raw).withColumn("weight", F.try_divide("_raw", F.sum("_raw").over(w))).drop("_raw")


def capped_simplex(x: np.ndarray, cap: float, total: float = 1.0) -> np.ndarray:
    """Weights in proportion to x (non-negative) with none above cap, adding up to total; what is cut goes to the others."""
    x = np.maximum(np.nan_to_num(np.asarray(x, float)), 0)
    if cap * len(x) < total - 1e-12:
        raise ValueError("the cap leaves no room for the total")
    if x.sum() <= 0:
        x = np.ones(len(x))
    fixed = np.zeros(len(x), bool)
    out = np.zeros(len(x))
    while True:
        rest = total - cap * fixed.sum()
        free = ~fixed
        base = np.where(x[free] > 0, x[free], 0) if x[free].sum() > 0 else np.ones(free.sum())
        out[fixed], out[free] = cap, rest * base / base.sum() if free.any() else 0
        over = free & (out > cap + 1e-15)
        if not over.any():
            return out
        fixed |= over


def limit_turnover(old: np.ndarray, desired: np.ndarray, limit: float) -> np.ndarray:
    """Move towards the desired weights as far as one-way turnover allows."""
    distance = np.abs(desired - old).sum()
    return desired if distance <= 2 * limit else old + (2 * limit / distance) * (desired - old)


def greedy_trade(old: np.ndarray, alpha: np.ndarray, buy: float, sell: float, cap: float) -> np.ndarray:
    """The exact one-period optimum of alpha minus trading costs with weights in 0..cap: moves from the worst to the best while that pays."""
    w = old.astype(float).copy()
    best, worst = np.argsort(-alpha, kind="stable"), np.argsort(alpha, kind="stable")
    i = j = 0
    while i < len(best) and j < len(worst):
        b, s = best[i], worst[j]
        if w[b] >= cap - 1e-15:
            i += 1
        elif w[s] <= 1e-15:
            j += 1
        elif alpha[b] - alpha[s] <= buy + sell + 1e-15:
            break
        else:
            move = min(cap - w[b], w[s])
            w[b] += move
            w[s] -= move
    return w


@dataclass(frozen=True)
class Costs:
    """Cash, board lots and fees of an account."""

    cash: float = 1_000_000.0
    lot: int = 100
    buy: float = 0.0002
    sell: float = 0.0002
    band: float = 0.0


def ledger(days: pd.DataFrame, costs: Costs) -> pd.DataFrame:
    """Run target weights (trade_date, ts_code, target_weight, price, ratio, tradable) through an account; one row per session.

    Shares change with the adjustment ratio so that value follows adjusted prices. Sales come first; buys are scaled
    to the cash; amounts are whole lots; untradable positions stay; a change of weight within the band is skipped.
    """
    cash, shares, last, ratio_of = costs.cash, {}, {}, {}
    rows = []
    for date, t in days.groupby("trade_date", sort=True):
        t = t.sort_values("ts_code")
        price = {c: p for c, p in zip(t["ts_code"], t["price"], strict=True) if pd.notna(p) and p > 0}
        ratio = {c: x for c, x in zip(t["ts_code"], t["ratio"], strict=True) if pd.notna(x) and x > 0}
        for c in list(shares):
            if c in ratio and c in ratio_of:
                shares[c] *= ratio[c] / ratio_of[c]
        ratio_of |= ratio
        last |= price
        value = cash + sum(n * last[c] for c, n in shares.items())
        open_ = {c for c, ok in zip(t["ts_code"], t["tradable"], strict=True) if ok and c in price}
        want = {c: float(w) if pd.notna(w) else 0.0 for c, w in zip(t["ts_code"], t["target_weight"], strict=True)}
        traded = fees = 0.0
        buys = []
        for c in sorted(open_ | (set(shares) & set(price))):
            if c not in open_:
                continue
            have = shares.get(c, 0.0) * price[c]
            goal = want.get(c, 0.0) * value
            if not abs(goal - have) > costs.band * value:
                continue
            if goal < have:
                n = shares[c] if goal <= 0 else math.floor((have - goal) / price[c] / costs.lot) * costs.lot
                if n > 0:
                    cash += n * price[c] * (1 - costs.sell)
                    fees += n * price[c] * costs.sell
                    traded += n * price[c]
                    shares[c] -= n
                    if shares[c] <= 1e-9:
                        del shares[c]
            else:
                buys.append((c, goal - have))
        need = sum(x for _, x in buys) * (1 + costs.buy)
        scale = min(1.0, cash / need) if need > 0 else 0.0
        for c, x in buys:
            n = math.floor(x * scale / price[c] / costs.lot) * costs.lot
            if n > 0 and n * price[c] * (1 + costs.buy) <= cash + 1e-9:
                cash -= n * price[c] * (1 + costs.buy)
                fees += n * price[c] * costs.buy
                traded += n * price[c]
                shares[c] = shares.get(c, 0.0) + n
        value = cash + sum(n * last.get(c, 0.0) for c, n in shares.items())
        rows.append((date, value, cash, traded, fees, len(shares)))
    return pd.DataFrame(rows, columns=["trade_date", "value", "cash", "traded", "fees", "holdings"])


@dataclass(frozen=True)
class Replacement:
    """A policy that replaces a limited number of holdings per session."""

    size: int = 10
    entry: int = 10
    exit: int = 20
    limit: int = 2


def replace(days: pd.DataFrame, policy: Replacement) -> pd.DataFrame:
    """Members per session from scores (trade_date, ts_code, score): ts_code, rank, action (enter, stay, leave).

    A member leaves when its rank is beyond `exit` or it has no score, at most `limit` a session, the worst first;
    the best ranked within `entry` fill the places. The first session fills up at once. Nothing else changes.
    """
    held: list[str] = []
    rows = []
    for n, (date, t) in enumerate(days.groupby("trade_date", sort=True)):
        t = t[t["score"].notna()].sort_values(["score", "ts_code"], ascending=[False, True])
        rank = {c: k + 1 for k, c in enumerate(t["ts_code"])}
        out = sorted((c for c in held if rank.get(c, math.inf) > policy.exit), key=lambda c: (-rank.get(c, math.inf), c))[: policy.limit]
        stay = [c for c in held if c not in out]
        room = min(policy.size - len(stay), policy.size if n == 0 else policy.limit)
        new = [c for c in t["ts_code"] if c not in stay and c not in out and rank[c] <= policy.entry][: max(0, room)]
        for action, cs in (("leave", out), ("stay", stay), ("enter", new)):
            rows += [(date, c, rank.get(c), action) for c in cs]
        held = stay + new
    return pd.DataFrame(rows, columns=["trade_date", "ts_code", "rank", "action"])


def dual_sleeve(days: pd.DataFrame, policies: dict[str, Replacement], shared_limit: int) -> pd.DataFrame:
    """Two or more sleeves of their own members under one limit of replacements; the weakest members of all go first.

    Input has a column sleeve; output rows as of replace(), with the sleeve.
    """
    held: dict[str, list[str]] = {k: [] for k in policies}
    rows = []
    for n, (date, t) in enumerate(days.groupby("trade_date", sort=True)):
        ranks, out = {}, []
        for k, p in policies.items():
            own = t[(t["sleeve"] == k) & t["score"].notna()].sort_values(["score", "ts_code"], ascending=[False, True])
            ranks[k] = {c: i + 1 for i, c in enumerate(own["ts_code"])}
            out += [(-(ranks[k].get(c, math.inf) / p.exit), k, c) for c in held[k] if ranks[k].get(c, math.inf) > p.exit]
        gone = {(k, c) for _, k, c in sorted(out)[:shared_limit]}
        budget = sum(p.size for p in policies.values()) if n == 0 else shared_limit
        for k, p in policies.items():
            stay = [c for c in held[k] if (k, c) not in gone]
            new = [c for c, i in ranks[k].items() if c not in stay and (k, c) not in gone and i <= p.entry][: max(0, min(p.size - len(stay), budget))]
            budget -= len(new)
            rows += [(date, k, c, ranks[k].get(c), a) for a, cs in (("leave", [c for c in held[k] if (k, c) in gone]), ("stay", stay), ("enter", new)) for c in cs]
            held[k] = stay + new
    return pd.DataFrame(rows, columns=["trade_date", "sleeve", "ts_code", "rank", "action"])


def long_portfolio(days: pd.DataFrame, share: float, cost: float) -> pd.DataFrame:
    """Top share of a factor, equal weights; untradable positions keep their drifted weight, and turnover costs.

    Input: trade_date, ts_code, factor, ret (to the next session), tradable. One row per session.
    """
    w: dict[str, float] = {}
    rows = []
    for date, t in days.groupby("trade_date", sort=True):
        ret = dict(zip(t["ts_code"], t["ret"].fillna(0.0), strict=True))
        ok = set(t.loc[t["tradable"].astype(bool), "ts_code"])
        f = t[t["factor"].notna()].sort_values(["factor", "ts_code"], ascending=[False, True])
        top = [c for c in f["ts_code"].head(math.ceil(share * len(f))) if c in ok]
        frozen = {c: x for c, x in w.items() if c not in ok}
        free = 1 - sum(frozen.values())
        new = frozen | {c: free / len(top) for c in top}
        turnover = sum(abs(new.get(c, 0) - w.get(c, 0)) for c in new.keys() | w.keys())
        gain = sum(x * ret.get(c, 0.0) for c, x in new.items())
        rows.append((date, gain - turnover * cost, turnover, len(new)))
        w = {c: x * (1 + ret.get(c, 0.0)) / (1 + gain) for c, x in new.items()}
    return pd.DataFrame(rows, columns=["trade_date", "net_return", "turnover", "holdings"])


def fold(df: DataFrame, strategy: str, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a fold over the sessions of each strategy; strategies are independent tasks."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        out = f(t.drop(columns=[strategy]))
        out.insert(0, strategy, t[strategy].iloc[0])
        return out

    return df.groupBy(strategy).applyInPandas(run, f"{strategy} {df.schema[strategy].dataType.simpleString()}, {schema}")


def performance(returns: DataFrame, ret: str, by: list[str], periods: int = 252) -> DataFrame:
    """Total and annual return, volatility, Sharpe ratio and largest drawdown of a return series per key."""
    w = Window.partitionBy(*by).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    t = returns.where(F.col(ret).isNotNull()).withColumn("_v", F.exp(F.sum(F.log1p(ret)).over(w)))
    t = t.withColumn("_peak", F.greatest(F.max("_v").over(w), F.lit(1.0)))
    n, sd = F.count("*"), F.stddev_samp(ret)
    total = F.max_by("_v", "trade_date")
    return t.groupBy(*by).agg(n.alias("n"), (total - 1).alias("total"), (F.pow(total, F.lit(float(periods)) / n) - 1).alias("annual"), (sd * F.lit(periods**0.5)).alias("volatility"), (F.when(sd > 1e-12, F.avg(ret) / sd) * F.lit(periods**0.5)).alias("sharpe"), F.min(F.col("_v") / F.col("_peak") - 1).alias("max_drawdown"))
