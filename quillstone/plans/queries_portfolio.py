"""Queries of portfolio construction, execution, risk and attribution. Folds have no SQL; tests hold them to golden values."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators import evaluate as ev
from quillstone.operators import panel, portfolio, risk
from quillstone.plans import adapters
from quillstone.plans.adapters import BARS_SQL
from quillstone.plans.queries_eval import PANEL_SQL, labelled
from quillstone.plans.queries_lake import r, s

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two strategies' scores with quotes, per session."""
    p = labelled(spark, sf_dir).select("trade_date", "ts_code", "day_index", "close", "tradable", "ret_1", "momentum", "spread")
    return p.unpivot(["trade_date", "ts_code", "day_index", "close", "tradable", "ret_1"], ["momentum", "spread"], "strategy", "score")


STAGGERED_SQL = PANEL_SQL + """,
pk AS (SELECT day_index, ts_code, row_number() OVER (PARTITION BY day_index ORDER BY spread DESC, ts_code) AS k, ceil(count(*) OVER (PARTITION BY day_index) * 0.4) AS n FROM lab WHERE spread IS NOT NULL),
held AS (SELECT ts_code, unnest(range(day_index, day_index + 5)) AS day_index, 1.0 / (n * 5) AS w FROM pk WHERE k <= n),
staggered AS (SELECT day_index, ts_code, sum(w) AS target_weight FROM held GROUP BY day_index, ts_code)"""


@query(f"WITH {STAGGERED_SQL} SELECT day_index, ts_code, {s('target_weight', 8)} FROM staggered")
def portfolio_staggered_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.staggered(labelled(spark, sf_dir), "spread", 0.4, 5).selectExpr("day_index", "ts_code", r("target_weight", 8))


@query(f"""WITH {PANEL_SQL}, k AS (SELECT trade_date, ts_code, row_number() OVER (PARTITION BY trade_date ORDER BY momentum DESC, ts_code) AS a, row_number() OVER (PARTITION BY trade_date ORDER BY spread DESC, ts_code) AS b, momentum, spread FROM lab),
    u AS (SELECT trade_date, ts_code, 0.8 * 0.5 AS w FROM k WHERE a <= 2 AND momentum IS NOT NULL UNION ALL SELECT trade_date, ts_code, 0.2 * 0.5 FROM k WHERE b <= 2 AND spread IS NOT NULL)
    SELECT trade_date, ts_code, {s('sum(w)', 8, 'target_weight')} FROM u GROUP BY trade_date, ts_code""")
def portfolio_blend_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("strategy", "trade_date").orderBy(F.col("score").desc_nulls_last(), "ts_code")
    t = _scores(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 2 and score is not null").select("trade_date", "ts_code", F.col("strategy").alias("source"), F.lit(0.5).alias("target_weight"))
    return portfolio.blend(t, {"momentum": 0.8, "spread": 0.2}).selectExpr("trade_date", "ts_code", r("target_weight", 8))


@query(f"""WITH {PANEL_SQL}, z AS (SELECT trade_date, ts_code, row_number() OVER (PARTITION BY trade_date ORDER BY spread, ts_code DESC) AS rk, stddev_pop(spread) OVER w AS sd, (spread - avg(spread) OVER w) AS c FROM lab WHERE spread IS NOT NULL WINDOW w AS (PARTITION BY trade_date)),
    y AS (SELECT *, least(greatest(CASE WHEN sd > 1e-12 THEN c / sd END, 0), 3) AS zc FROM z)
    SELECT trade_date, ts_code, {s('rk / sum(rk) OVER (PARTITION BY trade_date)', 8, 'w_rank')}, {s('CASE WHEN sd > 1e-12 THEN zc / nullif(sum(zc) OVER (PARTITION BY trade_date), 0) ELSE 0 END', 8, 'w_z')} FROM y WHERE sd > 1e-12""")
def portfolio_allocation_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = labelled(spark, sf_dir).where("spread is not null").withColumn("sd", F.stddev_pop("spread").over(Window.partitionBy("trade_date")))
    p = portfolio.allocation_weights(p, "spread", "rank", ["trade_date"]).withColumn("w_rank", F.col("weight"))
    p = portfolio.allocation_weights(p, "spread", "z", ["trade_date"]).withColumn("w_z", F.col("weight"))
    return p.where("sd > 1e-12").selectExpr("trade_date", "ts_code", r("w_rank", 8), r("w_z", 8))


@query(None)
def portfolio_weight_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top two of each score in equal weights, through an account with lots, cash and fees."""
    w = Window.partitionBy("strategy", "trade_date").orderBy(F.col("score").desc_nulls_last(), "ts_code")
    t = _scores(spark, sf_dir).withColumn("target_weight", F.when((F.row_number().over(w) <= 2) & F.col("score").isNotNull(), 0.45).otherwise(0.0))
    t = t.select("strategy", "trade_date", "ts_code", "target_weight", F.col("close").alias("price"), F.lit(1.0).alias("ratio"), "tradable")
    return portfolio.fold(t, "strategy", lambda d: portfolio.ledger(d, portfolio.Costs(cash=1e8, lot=100, band=0.01)), "trade_date date, value double, cash double, traded double, fees double, holdings bigint")


@query(None)
def portfolio_limited_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _scores(spark, sf_dir).select("strategy", "trade_date", "ts_code", "score")
    return portfolio.fold(t, "strategy", lambda d: portfolio.replace(d, portfolio.Replacement(size=2, entry=2, exit=3, limit=1)), "trade_date date, ts_code string, rank bigint, action string")


@query(None)
def portfolio_dual_sleeve(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _scores(spark, sf_dir).where("strategy = 'momentum'").select("strategy", "trade_date", "ts_code", "score", F.when(F.col("ts_code") < "S3", "big").otherwise("small").alias("sleeve"))
    rules = {"big": portfolio.Replacement(2, 2, 2, 1), "small": portfolio.Replacement(1, 1, 1, 1)}
    return portfolio.fold(t, "strategy", lambda d: portfolio.dual_sleeve(d, rules, 1), "trade_date date, sleeve string, ts_code string, rank bigint, action string")


@query(None)
def portfolio_long_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top two fifths with frozen untradable weights and trading costs, then its performance per strategy."""
    t = _scores(spark, sf_dir).select("strategy", "trade_date", "ts_code", F.col("score").alias("factor"), F.least("ret_1", F.lit(0.5)).alias("ret"), "tradable")
    days = portfolio.fold(t, "strategy", lambda d: portfolio.long_portfolio(d, 0.4, 0.0002), "trade_date date, net_return double, turnover double, holdings bigint")
    return portfolio.performance(days.where("net_return > -1"), "net_return", ["strategy"])


@query(f"""WITH {PANEL_SQL}, d AS (SELECT trade_date, least(greatest(avg(ret_1), -0.5), 0.5) AS x FROM lab GROUP BY trade_date HAVING avg(ret_1) IS NOT NULL),
    v AS (SELECT trade_date, x, exp(sum(ln(1 + x)) OVER (ORDER BY trade_date)) AS v FROM d), k AS (SELECT *, greatest(max(v) OVER (ORDER BY trade_date), 1) AS peak FROM v)
    SELECT 'all' AS strategy, count(*) AS n, {s('stddev_samp(x) * sqrt(252.0)', 6, 'volatility')}, {s('avg(x) / stddev_samp(x) * sqrt(252.0)', 5, 'sharpe')}, {s('min(v / peak - 1)', 6, 'max_drawdown')} FROM k""")
def portfolio_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled(spark, sf_dir).groupBy("trade_date").agg(F.avg("ret_1").alias("x")).where("x is not null").withColumn("x", F.least(F.greatest("x", F.lit(-0.5)), F.lit(0.5))).withColumn("strategy", F.lit("all"))
    return portfolio.performance(d, "x", ["strategy"]).selectExpr("strategy", "n", r("volatility"), r("sharpe", 5), r("max_drawdown"))


@query(f"""WITH {PANEL_SQL}, t AS (SELECT trade_date, ts_code, excess_1 AS y, spread AS x FROM lab WHERE excess_1 IS NOT NULL AND spread IS NOT NULL),
    g AS (SELECT trade_date, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS v FROM t GROUP BY trade_date)
    SELECT trade_date, n, {s('CASE WHEN v > 1e-12 THEN c / v END', 5, 'slope')}, {s('my - CASE WHEN v > 1e-12 THEN c / v END * mx', 5, 'intercept')} FROM g WHERE n >= 3 AND v > 1e-6""")
def risk_factor_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-sectional weighted regression (here with equal weights, so that SQL can check it)."""
    p = labelled(spark, sf_dir).select("trade_date", F.col("excess_1").alias("y"), F.col("spread").alias("x"), F.lit(1.0).alias("w"))
    varied = p.where("x is not null and y is not null").groupBy("trade_date").agg(F.var_pop("x").alias("v")).where("v > 1e-6")
    f = risk.factor_returns(p.join(varied, "trade_date", "left_semi"), "y", ["x"], "w")
    wide = f.groupBy("trade_date", "n").pivot("factor", ["x", "intercept"]).agg(F.first("value"))
    return wide.select("trade_date", "n", F.col("x").alias("slope"), "intercept").selectExpr("trade_date", "n", r("slope", 5), r("intercept", 5))


@query(f"""WITH {PANEL_SQL}, t AS (SELECT trade_date, ts_code, momentum AS y, spread AS x FROM lab WHERE momentum IS NOT NULL AND spread IS NOT NULL),
    g AS (SELECT trade_date, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / nullif(var_pop(x), 0) AS b FROM t GROUP BY trade_date HAVING var_pop(x) > 1e-6 AND count(*) > 2)
    SELECT t.trade_date, ts_code, {s('y - my - b * (x - mx)', 5, 'neutral')} FROM t JOIN g ON g.trade_date = t.trade_date""")
def risk_neutralise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = labelled(spark, sf_dir).select("trade_date", "ts_code", "momentum", "spread").where("momentum is not null and spread is not null")
    ok = p.groupBy("trade_date").agg(F.var_pop("spread").alias("v"), F.count("*").alias("n")).where("v > 1e-6 and n > 2")
    return risk.neutralise(p.join(ok, "trade_date", "left_semi"), "momentum", ["spread"]).selectExpr("trade_date", "ts_code", r("neutral", 5))


@query(f"""WITH {PANEL_SQL}, l AS (SELECT max(day_index) AS m FROM lab), v AS (SELECT ts_code, sum(pow(0.5, (m - day_index) / 120.0) * excess_1 * excess_1) / sum(pow(0.5, (m - day_index) / 120.0)) AS raw FROM lab, l WHERE excess_1 IS NOT NULL GROUP BY ts_code),
    q AS (SELECT quantile_cont(raw, 0.1) AS lo, quantile_cont(raw, 0.5) AS mid, quantile_cont(raw, 0.9) AS hi FROM v)
    SELECT ts_code, {s('raw', 4)}, {s('least(greatest(0.8 * raw + 0.2 * mid, lo), hi)', 4, 'variance')} FROM v, q""")
def risk_specific_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.specific_variance(labelled(spark, sf_dir).withColumn("residual", F.col("excess_1")), 120.0).selectExpr("ts_code", r("raw", 4), r("variance", 4))


@query(None)
def risk_covariance_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EWMA covariance of factor returns strictly before a date."""
    p = labelled(spark, sf_dir).select("trade_date", F.col("excess_1").alias("y"), "spread", "turnover", F.lit(1.0).alias("w"))
    cov = risk.covariance_as_of(risk.factor_returns(p, "y", ["spread", "turnover"], "w"), pd.Timestamp("2000-01-01").date(), ["intercept", "spread", "turnover"], 90.0, 0.1)
    return spark.createDataFrame(cov.rename_axis("factor").reset_index())


@query(None)
def risk_rolling_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first security's return against the market's, by regressions over the 60 sessions before."""
    p = adapters.dense(spark, sf_dir).join(_market(spark, sf_dir), "trade_date").where("RET is not null and MKT is not null")
    t = p.select("ts_code", "trade_date", "RET", "MKT")
    return portfolio.fold(t, "ts_code", lambda d: risk.rolling_attribution(d.sort_values("trade_date"), "RET", ["MKT"], 60, 30.0), "trade_date date, beta_MKT double, part_MKT double, specific double")


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.dense(spark, sf_dir)
    return p.groupBy("trade_date").agg((F.rint(F.avg("RET") * 1e8) / 1e8).alias("MKT"))


@query(f"""WITH {BARS_SQL}, m AS (SELECT trade_date, round_even(avg(RET) * 1e8, 0) / 1e8 AS MKT FROM panel GROUP BY trade_date), p AS (SELECT panel.*, MKT, CASE WHEN RET IS NOT NULL AND MKT IS NOT NULL THEN RET END AS ry, CASE WHEN RET IS NOT NULL AND MKT IS NOT NULL THEN MKT END AS rx FROM panel JOIN m ON m.trade_date = panel.trade_date),
    b AS (SELECT *, CASE WHEN count(rx) OVER w >= 40 AND var_pop(rx) OVER w > 1e-18 THEN covar_pop(rx, ry) OVER w / var_pop(rx) OVER w END AS beta60, CASE WHEN V > 0 THEN ln(V) END AS la, CASE WHEN RET > -1 THEN ln(1 + RET) END AS lr
        FROM p WINDOW w AS (PARTITION BY ts_code ORDER BY day_index RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)),
    e AS (SELECT *, RET - beta60 * MKT AS e FROM b)
    SELECT trade_date, ts_code, {s('beta60', 5)}, {s('CASE WHEN count(e) OVER w >= 40 THEN stddev_samp(e) OVER w END', 4, 'residual_vol')}, {s('CASE WHEN count(lr) OVER w >= 40 THEN sum(lr) OVER w END', 5, 'momentum')},
        {s('CASE WHEN count(la) OVER x >= 15 THEN avg(la) OVER x END', 5, 'liquidity')}, {s('CASE WHEN count(V) OVER x >= 15 THEN avg(V) OVER x END', 4, 'turnover')}
    FROM e WINDOW w AS (PARTITION BY ts_code ORDER BY day_index RANGE BETWEEN 59 PRECEDING AND CURRENT ROW), x AS (PARTITION BY ts_code ORDER BY day_index RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def risk_style_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.dense(spark, sf_dir).join(F.broadcast(_market(spark, sf_dir)), "trade_date")
    return risk.styles(p).selectExpr("trade_date", "ts_code", r("beta60", 5), r("residual_vol", 4), r("momentum", 5), r("liquidity", 5), r("turnover", 4))


@query(f"""WITH {PANEL_SQL}, p AS (SELECT trade_date, ts_code, 0.5 AS weight FROM lab WHERE spread IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY spread DESC, ts_code) <= 2),
    b AS (SELECT trade_date, ts_code, volume / sum(volume) OVER (PARTITION BY trade_date) AS weight FROM lab WHERE volume IS NOT NULL),
    j AS (SELECT coalesce(p.trade_date, b.trade_date) AS trade_date, coalesce(p.ts_code, b.ts_code) AS ts_code, coalesce(p.weight, 0) - coalesce(b.weight, 0) AS a FROM p FULL JOIN b ON p.trade_date = b.trade_date AND p.ts_code = b.ts_code)
    SELECT j.trade_date, CASE WHEN j.ts_code < 'S2' THEN 'low' ELSE 'high' END AS industry, {s('sum(a)', 6, 'active_weight')}, {s('sum(a * coalesce(ret_1, 0))', 6, 'contribution')} FROM j JOIN lab ON lab.trade_date = j.trade_date AND lab.ts_code = j.ts_code GROUP BY 1, 2""")
def risk_active_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = labelled(spark, sf_dir)
    top = p.where("spread is not null").withColumn("k", F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("spread"), "ts_code"))).where("k <= 2").select("trade_date", "ts_code", F.lit(0.5).alias("weight"))
    bench = p.where("volume is not null").withColumn("weight", F.col("volume") / F.sum("volume").over(Window.partitionBy("trade_date")))
    ret = p.select("trade_date", "ts_code", F.col("ret_1").alias("ret"), F.when(F.col("ts_code") < "S2", "low").otherwise("high").alias("industry"))
    return risk.active_contribution(top, bench, ret, "industry").selectExpr("trade_date", "industry", r("active_weight"), r("contribution"))


@query(None)
def portfolio_greedy_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily targets by the exact one-period optimum of alpha less costs, from equal weights on."""
    import numpy as np

    def run(d: pd.DataFrame) -> pd.DataFrame:
        codes = sorted(d["ts_code"].unique())
        w, rows = np.full(len(codes), 1 / len(codes)), []
        for date, t in d.groupby("trade_date", sort=True):
            alpha = t.set_index("ts_code")["score"].reindex(codes).fillna(0.0).to_numpy()
            w = portfolio.greedy_trade(w, alpha, 0.05, 0.05, 0.5)
            rows += [(date, c, float(x)) for c, x in zip(codes, w, strict=True)]
        return pd.DataFrame(rows, columns=["trade_date", "ts_code", "target_weight"])

    return portfolio.fold(_scores(spark, sf_dir).select("strategy", "trade_date", "ts_code", "score"), "strategy", run, "trade_date date, ts_code string, target_weight double")


@query(f"""WITH {PANEL_SQL}, o AS (SELECT day_index, trade_date, ts_code, row_number() OVER (PARTITION BY trade_date ORDER BY spread, ts_code) AS k FROM lab WHERE spread IS NOT NULL),
    p AS (SELECT a.trade_date, a.k AS x, b.k AS y FROM o AS a JOIN o AS b ON a.ts_code = b.ts_code AND b.day_index = a.day_index - 1)
    SELECT trade_date, count(*) AS n, {s('CASE WHEN stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END', 6, 'rank_corr')} FROM p GROUP BY trade_date""")
def eval_adjacent_rank_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = labelled(spark, sf_dir).where("spread is not null").withColumn("x", ev.ordinal_rank("spread", ["trade_date"]))
    before = p.select((F.col("day_index") + 1).alias("day_index"), "ts_code", F.col("x").alias("y"))
    return p.join(before, ["day_index", "ts_code"]).groupBy("trade_date").agg(F.count("*").alias("n"), ev.safe_corr("x", "y").alias("rank_corr")).selectExpr("trade_date", "n", r("rank_corr"))
