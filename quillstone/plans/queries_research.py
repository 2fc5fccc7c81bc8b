"""Queries of research loops: smoothing, fusion, linear fits, relevance grades, orders, targets that depend on the day before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import boosting, portfolio, research
from quillstone.plans import adapters
from quillstone.plans.adapters import BARS_SQL
from quillstone.plans.compiler import evaluate, shown, to_sql
from quillstone.plans.queries_eval import PANEL_SQL, labelled
from quillstone.plans.queries_lake import r, s
from quillstone.plans.queries_portfolio import _scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SMOOTH = {"smooth": "rank(ema(rank(C - O), 5, 2))", "churn": "abs(rank(C - O) - delay(rank(C - O)))"}
_smooth_shown = ", ".join(f"{shown(k, 'duckdb')} AS {k}" for k in SMOOTH)
_smooth_ctes, _, _smooth_last = to_sql("panel", SMOOTH, decimals=adapters.DECIMALS).rpartition("SELECT trade_date")


@query(f"WITH {BARS_SQL.strip()}, {_smooth_ctes.strip()}, result AS (SELECT trade_date{_smooth_last}) SELECT trade_date, ts_code, {_smooth_shown} FROM result")
def research_score_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal EWMA of ranks, ranked again; and how far ranks move from day to day."""
    return evaluate(adapters.dense(spark, sf_dir), SMOOTH, decimals=adapters.DECIMALS).selectExpr("trade_date", "ts_code", *(f"{shown(k)} AS {k}" for k in SMOOTH))


@query(f"""WITH {PANEL_SQL}, z AS (SELECT trade_date, ts_code, CASE WHEN stddev_pop(momentum) OVER w > 1e-12 THEN (momentum - avg(momentum) OVER w) / stddev_pop(momentum) OVER w END AS a,
        CASE WHEN stddev_pop(spread) OVER w > 1e-12 THEN (spread - avg(spread) OVER w) / stddev_pop(spread) OVER w END AS b FROM lab WINDOW w AS (PARTITION BY trade_date))
    SELECT trade_date, ts_code, {s('(coalesce(a, 0) + coalesce(b, 0)) / nullif(CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT), 0)', 6, 'fused')} FROM z""")
def research_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.fuse(labelled(spark, sf_dir), ["momentum", "spread"], ["trade_date"]).selectExpr("trade_date", "ts_code", r("fused"))


@query(f"""WITH {PANEL_SQL}, t AS (SELECT least(momentum, 5) AS x, least(spread, 5) AS z, excess_1 AS y FROM lab WHERE momentum IS NOT NULL AND spread IS NOT NULL AND excess_1 IS NOT NULL),
    g AS (SELECT count(*) AS n, sum(x * x) + 1 AS a, sum(x * z) AS b, sum(x) AS c, sum(z * z) + 1 AS d, sum(z) AS e, sum(x * y) AS p, sum(z * y) AS q, sum(y) AS u FROM t),
    h AS (SELECT *, a - c * c / n AS aa, b - c * e / n AS bb, d - e * e / n AS dd, p - c * u / n AS pp, q - e * u / n AS qq FROM g)
    SELECT n, {s('(dd * pp - bb * qq) / (aa * dd - bb * bb)', 5, 'b_momentum')}, {s('(aa * qq - bb * pp) / (aa * dd - bb * bb)', 5, 'b_spread')} FROM h""")
def research_ridge_from_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge coefficients from products that partitions sum up; the fit itself is a few numbers."""
    t = labelled(spark, sf_dir).where("momentum is not null and spread is not null and excess_1 is not null").select(F.least("momentum", F.lit(5.0)).alias("x"), F.least("spread", F.lit(5.0)).alias("z"), F.col("excess_1").alias("y"))
    g, m, n = research.gram(t, ["x", "z"], "y")
    b = research.ridge(g, m, 1.0)
    return spark.createDataFrame([(n, float(b[0]), float(b[1]))], "n bigint, b_momentum double, b_spread double").selectExpr("n", r("b_momentum", 5), r("b_spread", 5))


@query(f"""WITH {PANEL_SQL} SELECT trade_date, ts_code, CASE WHEN excess_1 IS NOT NULL THEN ntile(3) OVER (PARTITION BY trade_date, excess_1 IS NULL ORDER BY excess_1, ts_code) - 1 END AS grade,
    {s('pow(0.5, (max(day_index) OVER () - day_index) / 250.0)', 8, 'weight')} FROM lab""")
def research_relevance_and_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = labelled(spark, sf_dir)
    p = research.decay_weights(p, "day_index", 250.0)
    return p.withColumn("grade", research.relevance("excess_1", ["trade_date"], 3).cast("bigint")).selectExpr("trade_date", "ts_code", "grade", r("weight", 8))


@query(f"""WITH {BARS_SQL}, w AS (SELECT trade_date, ts_code, close AS price, 1.0 / count(*) OVER (PARTITION BY trade_date) AS w FROM bars)
    SELECT trade_date, ts_code, CAST(w AS DECIMAL(12, 8)) AS target_weight, CAST(floor(w * 1e8 / price / 100) AS BIGINT) * 100 AS shares, CAST(round_even(CAST(floor(w * 1e8 / price / 100) AS BIGINT) * 100 * price * 100, 0) / 100 AS DECIMAL(18, 2)) AS notional FROM w""")
def research_order_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    b = adapters.bars(spark, sf_dir).select("trade_date", "ts_code", F.col("close").alias("price"))
    return research.orders(b.withColumn("target_weight", 1.0 / F.count("*").over(Window.partitionBy("trade_date"))), 1e8)


@query(None)
def research_softmax_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _scores(spark, sf_dir).select("strategy", "trade_date", "ts_code", F.when(F.col("score").isNotNull(), F.least("score", F.lit(10.0))).alias("score"))
    return portfolio.fold(t, "strategy", lambda d: research.softmax_targets(d, 1.0, 0.5, 0.1), "trade_date date, ts_code string, target_weight double")


@query(None)
def research_hysteresis_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _scores(spark, sf_dir).select("strategy", "trade_date", "ts_code", "score")
    return portfolio.fold(t, "strategy", lambda d: research.hysteresis(d, 0.2, 0.6), "trade_date date, ts_code string, target_weight double")


#: Few and small trees over every session, as the check runs on a small machine.
BOOSTED = boosting.Settings("ranking", trees=4, depth=3, rate=0.1, bins=31, truncation=3, grades=5, half_life=250.0, keep=2)


@query(None)
def research_boosted_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year's sessions predicted by trees that learnt to rank on the 500 sessions before; all years' trees grow in the same passes."""
    p = labelled(spark, sf_dir)
    days = [(x["day_index"], x["trade_date"]) for x in p.select("day_index", "trade_date").distinct().orderBy("day_index").collect()]
    out = boosting.rolling_predictions(p, ["momentum", "spread", "turnover"], "excess_5", research.rolling_windows(days, 500, 8, "year"), BOOSTED)
    return out.select("window", "day_index", "ts_code", F.round("prediction", 6).alias("prediction"))
