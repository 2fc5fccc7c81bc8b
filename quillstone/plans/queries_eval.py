"""Queries of labels, factor evaluation, standardisation, reshaping and sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators import evaluate as ev
from quillstone.operators import panel
from quillstone.plans import adapters
from quillstone.plans.adapters import BARS_SQL
from quillstone.plans.queries_lake import r, s
from quillstone.session import checkpointed, shared_folder
from quillstone.sources import arrays, results

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Factor and label of the evaluation queries: a five-session move against the return from the next open on.
FACTORS = ["momentum", "spread", "turnover"]
HORIZONS = [1, 5]


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel with three factors and open-to-open labels in excess of the cross-section's mean."""
    p = panel.densify(adapters.bars(spark, sf_dir)).select("trade_date", "ts_code", "day_index", "open", "high", "low", "close", "volume", (F.coalesce("traded_bars", F.lit(0)) > 0).alias("tradable"))
    w = Window.partitionBy("ts_code").orderBy("day_index")
    p = p.withColumn("momentum", F.rint((F.try_divide("close", F.lag("close", 5).over(w)) - 1) * 1e8) / 1e8)
    p = p.withColumn("spread", F.rint(F.try_divide(F.col("high") - F.col("low"), "close") * 1e8) / 1e8).withColumn("turnover", F.col("volume"))
    p = ev.forward_returns(p, HORIZONS, "open", "open", 1)
    day = Window.partitionBy("trade_date")
    for h in HORIZONS:
        p = p.withColumn(f"excess_{h}", F.rint((F.col(f"ret_{h}") - F.avg(f"ret_{h}").over(day)) * 1e8) / 1e8)
    return p


PANEL_SQL = BARS_SQL + """,
lab0 AS (
    SELECT trade_date, ts_code, day_index, open, close, high, low, volume, coalesce(traded_bars, 0) > 0 AS tradable,
        round_even((close / nullif(lag(close, 5) OVER w, 0) - 1) * 1e8, 0) / 1e8 AS momentum, round_even((high - low) / nullif(close, 0) * 1e8, 0) / 1e8 AS spread, volume AS turnover,
        CASE WHEN lead(coalesce(traded_bars, 0) > 0, 2) OVER w THEN lead(open, 2) OVER w END / nullif(CASE WHEN lead(coalesce(traded_bars, 0) > 0, 1) OVER w THEN lead(open, 1) OVER w END, 0) - 1 AS ret_1,
        CASE WHEN lead(coalesce(traded_bars, 0) > 0, 6) OVER w THEN lead(open, 6) OVER w END / nullif(CASE WHEN lead(coalesce(traded_bars, 0) > 0, 1) OVER w THEN lead(open, 1) OVER w END, 0) - 1 AS ret_5
    FROM dense WINDOW w AS (PARTITION BY ts_code ORDER BY day_index)),
lab AS (
    SELECT *, round_even((ret_1 - avg(ret_1) OVER (PARTITION BY trade_date)) * 1e8, 0) / 1e8 AS excess_1, round_even((ret_5 - avg(ret_5) OVER (PARTITION BY trade_date)) * 1e8, 0) / 1e8 AS excess_5 FROM lab0)"""

CORR = "CASE WHEN stddev_pop({a}) > 1e-12 AND stddev_pop({b}) > 1e-12 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"

IC_SQL = PANEL_SQL + """,
long AS (
    SELECT trade_date, day_index, ts_code, 'momentum' AS factor_id, momentum AS f, excess_1 AS l FROM lab UNION ALL SELECT trade_date, day_index, ts_code, 'spread', spread, excess_1 FROM lab
    UNION ALL SELECT trade_date, day_index, ts_code, 'turnover', turnover, excess_1 FROM lab),
pairs AS (
    SELECT *, row_number() OVER (PARTITION BY factor_id, trade_date ORDER BY f, ts_code) AS of, row_number() OVER (PARTITION BY factor_id, trade_date ORDER BY l, ts_code) AS ol,
        rank() OVER (PARTITION BY factor_id, trade_date ORDER BY f) + (count(*) OVER (PARTITION BY factor_id, trade_date, f) - 1) / 2.0 AS af,
        rank() OVER (PARTITION BY factor_id, trade_date ORDER BY l) + (count(*) OVER (PARTITION BY factor_id, trade_date, l) - 1) / 2.0 AS al
    FROM long WHERE f IS NOT NULL AND l IS NOT NULL),
ics AS (
    SELECT factor_id, trade_date, day_index, count(*) AS n, """ + CORR.format(a="f", b="l") + " AS ic, " + CORR.format(a="of", b="ol") + " AS rank_ic, " + CORR.format(a="af", b="al") + """ AS rank_ic_avg
    FROM pairs GROUP BY factor_id, trade_date, day_index)"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = labelled(spark, sf_dir).select("trade_date", "day_index", "ts_code", F.col("excess_1").alias("label"), *FACTORS)
    return ev.unpivot(p, ["trade_date", "day_index", "ts_code", "label"], FACTORS)


def _ics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All factors in one job: the factor's id is one more key."""
    return ev.information_coefficients(_long(spark, sf_dir), "factor_value", "label", ["factor_id", "trade_date", "day_index"])


@query(f"WITH {PANEL_SQL} SELECT trade_date, ts_code, tradable, {s('momentum')}, {s('ret_1')}, {s('ret_5')}, {s('excess_1')}, {s('excess_5')} FROM lab")
def eval_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).selectExpr("trade_date", "ts_code", "tradable", r("momentum"), r("ret_1"), r("ret_5"), r("excess_1"), r("excess_5"))


@query(f"""WITH {BARS_SQL}, t AS (SELECT *, close IS NOT NULL AS ok FROM dense),
    x AS (SELECT trade_date, ts_code, lead(close, 1) OVER w / close - 1 AS c2c_1, lead(vwap, 2) OVER w / lead(vwap, 1) OVER w - 1 AS vwap_1, lead(twap, 6) OVER w / lead(twap, 1) OVER w - 1 AS twap_5 FROM t WINDOW w AS (PARTITION BY ts_code ORDER BY day_index))
    SELECT trade_date, ts_code, {s('c2c_1')}, {s('vwap_1')}, {s('twap_5')} FROM x""")
def eval_label_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close to close from T; vwap and twap from T + 1."""
    p = panel.densify(adapters.bars(spark, sf_dir)).withColumn("tradable", F.col("close").isNotNull())
    keep = p.columns
    p = ev.forward_returns(p, [1], "close", "close", 0).select(*keep, F.col("ret_1").alias("c2c_1"))
    p = ev.forward_returns(p, [1], "vwap", "vwap", 1).select(*keep, "c2c_1", F.col("ret_1").alias("vwap_1"))
    p = ev.forward_returns(p, [5], "twap", "twap", 1).withColumn("twap_5", F.col("ret_5"))
    return p.selectExpr("trade_date", "ts_code", r("c2c_1"), r("vwap_1"), r("twap_5"))


@query(f"WITH {IC_SQL} SELECT factor_id, trade_date, n, {s('ic')}, {s('rank_ic')}, {s('rank_ic_avg')} FROM ics")
def eval_information_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ics(spark, sf_dir).selectExpr("factor_id", "trade_date", "n", r("ic"), r("rank_ic"), r("rank_ic_avg"))


@query(f"WITH {IC_SQL} SELECT factor_id, trade_date, n, {s('ic')}, {s('rank_ic')}, {s('rank_ic_avg')} FROM ics")
def eval_batches_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coefficients by batches of one factor: one batch over a part of the sessions, as if it had stopped there, then what lacks."""
    store = results.Results(spark, shared_folder(spark, "results"))
    p = checkpointed(labelled(spark, sf_dir).select("trade_date", "day_index", "ts_code", "momentum", "spread", "turnover", F.col("excess_1").alias("label")))
    values = p.unpivot(["trade_date", "ts_code"], ["momentum", "spread", "turnover"], "factor_id", "value")
    batches = results.Batches(store, p.select("trade_date", "ts_code", "label"), {"ranks": "ordinal"})
    first = p.agg(F.min("trade_date")).first()[0]
    batches.advance(values.where(F.year("trade_date") == first.year), 1, most=2)
    batches.advance(values, 1)
    return batches.done().where("n > 0").selectExpr("factor_id", "trade_date", "n", r("ic"), r("rank_ic"), r("rank_ic_avg"))


@query(f"WITH {PANEL_SQL} SELECT trade_date, ts_code, tradable, {s('excess_1')}, {s('excess_5')} FROM lab")
def eval_cached_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels under the digest of the trades and the horizons, made once and read back by a second call that doesn't make them."""
    store = results.Results(spark, shared_folder(spark, "results"))
    key = store.key({"labels": "open to open", "horizons": HORIZONS}, trades=adapters.trades(spark, sf_dir))
    store.get(key, lambda: labelled(spark, sf_dir).select("trade_date", "ts_code", "tradable", "excess_1", "excess_5"))

    def again() -> DataFrame:
        raise AssertionError("the labels are there")

    return store.get(key, again).selectExpr("trade_date", "ts_code", "tradable", r("excess_1"), r("excess_5"))


@query(f"""WITH {IC_SQL}, m AS (SELECT factor_id, year(trade_date) AS year, count(rank_ic) AS n, avg(rank_ic) AS mean, stddev_samp(rank_ic) AS sd, avg(CASE WHEN rank_ic IS NOT NULL THEN CAST(rank_ic > 0 AS INT) END) AS positive FROM ics GROUP BY 1, 2)
    SELECT factor_id, year, n, {s('mean')}, {s('sd')}, {s('CASE WHEN sd > 1e-12 THEN mean / sd * sqrt(252.0) END', 5, 'icir')}, {s('positive')} FROM m""")
def eval_icir_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.summarise(_ics(spark, sf_dir).withColumn("year", F.year("trade_date").cast("bigint")), ["factor_id", "year"]).selectExpr("factor_id", "year", "n", r("mean"), r("sd"), r("icir", 5), r("positive"))


@query(f"""WITH {IC_SQL}, g AS (SELECT factor_id, year(trade_date) AS y, month(trade_date) AS m, n, rank_ic FROM ics)
    SELECT factor_id, y, m, grouping(y) AS gy, grouping(m) AS gm, sum(n)::BIGINT AS pairs, {s('avg(rank_ic)', 6, 'mean_ic')} FROM g GROUP BY GROUPING SETS ((factor_id, y, m), (factor_id, y), (factor_id))""")
def eval_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of months, years and all time in one aggregation; rows of totals are told by grouping(), not by nulls."""
    g = _ics(spark, sf_dir).select("factor_id", F.year("trade_date").cast("bigint").alias("y"), F.month("trade_date").cast("bigint").alias("m"), "n", "rank_ic")
    out = g.groupingSets([["factor_id", "y", "m"], ["factor_id", "y"], ["factor_id"]], "factor_id", "y", "m").agg(F.grouping("y").cast("bigint").alias("gy"), F.grouping("m").cast("bigint").alias("gm"), F.sum("n").alias("pairs"), F.avg("rank_ic").alias("mean_ic"))
    return out.selectExpr("factor_id", "y", "m", "gy", "gm", "pairs", r("mean_ic"))


@query(f"""WITH {IC_SQL}, g AS (SELECT *, ntile(3) OVER (PARTITION BY factor_id, trade_date ORDER BY f, ts_code) AS grp FROM pairs)
    SELECT factor_id, trade_date, grp::BIGINT AS grp, {s('avg(l)', 6, 'mean_label')}, count(*) AS n FROM g GROUP BY factor_id, trade_date, grp""")
def eval_quantile_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ev.grouped_returns(_long(spark, sf_dir), "factor_value", "label", ["factor_id", "trade_date"], 3)
    return g.selectExpr("factor_id", "trade_date", "cast(grp as bigint) as grp", r("mean_label"), "n")


@query(f"""WITH {IC_SQL}, w AS (SELECT factor_id, rank_ic AS x, pow(0.5, (row_number() OVER (PARTITION BY factor_id ORDER BY day_index DESC) - 1) / 60.0) AS w FROM ics WHERE rank_ic IS NOT NULL),
    -- the age counts sessions with a coefficient
    m AS (SELECT factor_id, sum(w * x) / sum(w) AS mean, sum(w * x * x) / sum(w) AS second FROM w GROUP BY factor_id)
    SELECT factor_id, {s('mean')}, {s('mean / sqrt(second - mean * mean)', 5, 'icir')} FROM m""")
def eval_weighted_icir(spark: SparkSession, sf_dir: str) -> DataFrame:
    ics = _ics(spark, sf_dir).where("rank_ic is not null")
    return ev.weighted_icir(ics, ["factor_id"], 60.0).selectExpr("factor_id", r("mean"), r("icir", 5))


@query(f"""WITH {PANEL_SQL}, d AS (SELECT *, abs(momentum - lag(momentum) OVER (PARTITION BY ts_code ORDER BY day_index)) AS dm FROM lab),
    q AS (SELECT count(*) AS rows, count(momentum) AS present, quantile_cont(momentum, 0.01) AS p01, quantile_cont(momentum, 0.99) AS p99, avg(dm) AS mean_abs_change FROM d)
    SELECT any_value(q.rows) AS rows, any_value(q.present) AS present, {s('any_value(p01)', 6, 'p01')}, {s('any_value(p99)', 6, 'p99')}, {s('any_value(mean_abs_change)', 6, 'mean_abs_change')},
        {s('avg(CASE WHEN momentum IS NOT NULL THEN least(greatest(momentum, p01), p99) END)', 6, 'clipped_mean')}, {s('any_value(q.present) / any_value(q.rows)', 6, 'coverage')} FROM d, q""")
def eval_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.diagnostics(labelled(spark, sf_dir), "momentum").selectExpr("rows", "present", r("p01"), r("p99"), r("mean_abs_change"), r("clipped_mean"), r("coverage"))


@query(f"""WITH {PANEL_SQL}, o AS (SELECT trade_date, list_sort(list(momentum) FILTER (WHERE momentum IS NOT NULL)) AS v FROM lab GROUP BY trade_date),
    b AS (SELECT trade_date, v[CAST(floor((len(v) - 1) * 0.1 + 0.5) AS INT) + 1] AS lo, v[CAST(floor((len(v) - 1) * 0.9 + 0.5) AS INT) + 1] AS hi FROM o),
    c AS (SELECT l.trade_date, ts_code, CASE WHEN momentum IS NOT NULL THEN least(greatest(momentum, lo), hi) END AS clipped FROM lab AS l JOIN b ON b.trade_date = l.trade_date),
    z AS (SELECT *, avg(clipped) OVER w AS m, stddev_samp(clipped) OVER w AS sd, stddev_pop(clipped) OVER w AS sp FROM c WINDOW w AS (PARTITION BY trade_date))
    SELECT trade_date, ts_code, {s('clipped')}, {s('CASE WHEN sd > 1e-12 THEN (clipped - m) / sd END', 6, 'z_sample')}, {s('CASE WHEN sp > 1e-12 THEN (clipped - m) / sp END', 6, 'z_population')} FROM z""")
def eval_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip to order statistics, then z-scores with either deviation."""
    p = ev.winsorise(labelled(spark, sf_dir).select("trade_date", "ts_code", "momentum"), ["momentum"], ["trade_date"], 0.1, 0.9)
    p = p.withColumn("clipped", F.col("momentum")).withColumn("z_sample", ev.z_score("clipped", ["trade_date"])).withColumn("z_population", ev.z_score("clipped", ["trade_date"], sample=False))
    return p.selectExpr("trade_date", "ts_code", r("clipped"), r("z_sample"), r("z_population"))


@query(f"WITH {PANEL_SQL} SELECT trade_date, ts_code, {s('momentum')}, {s('spread')}, {s('turnover')} FROM lab WHERE momentum IS NOT NULL OR spread IS NOT NULL OR turnover IS NOT NULL")
def eval_wide_feature_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long factors to one column each."""
    wide = ev.pivot(_long(spark, sf_dir), ["trade_date", "ts_code"], FACTORS)
    return wide.selectExpr("trade_date", "ts_code", *(r(c) for c in FACTORS))


@query(f"""WITH {PANEL_SQL}, top AS (SELECT day_index, ts_code FROM lab WHERE spread IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY spread DESC, ts_code) <= 2)
    SELECT a.day_index, count(*) AS k, count(b.ts_code) AS stayed FROM top AS a LEFT JOIN top AS b ON b.ts_code = a.ts_code AND b.day_index = a.day_index - 1 GROUP BY a.day_index""")
def eval_top_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.top_overlap(labelled(spark, sf_dir), "spread", 2)


@query(f"""WITH {PANEL_SQL}, w AS (SELECT trade_date, ts_code, volume / sum(volume) OVER (PARTITION BY trade_date) AS w FROM lab WHERE volume IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY w DESC) AS k FROM w),
    g AS (SELECT trade_date, sum(w * w) AS hhi, max(w) AS largest, sum(w) FILTER (WHERE k <= 2) AS top_weight, count(*) AS n FROM k GROUP BY trade_date)
    SELECT trade_date, {s('hhi')}, {s('1 / hhi', 5, 'effective_n')}, {s('largest')}, {s('top_weight')}, n FROM g""")
def eval_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = labelled(spark, sf_dir).where("volume is not null").withColumn("w", F.col("volume") / F.sum("volume").over(Window.partitionBy("trade_date")))
    return ev.concentration(p, "w", ["trade_date"], 2).selectExpr("trade_date", r("hhi"), r("effective_n", 5), r("largest"), r("top_weight"), "n")


@query(f"""WITH {BARS_SQL}, t AS (SELECT bars.trade_date, bars.ts_code, day_index, close, CASE WHEN day(bars.trade_date) <> 3 THEN volume END AS volume FROM bars JOIN cal ON cal.trade_date = bars.trade_date),
    q AS (SELECT trade_date, ts_code, day_index, day_index - min(day_index) OVER w AS span, count(*) OVER w AS n, sum(coalesce(volume, 0)) OVER w AS volume_sum, sum(CAST(volume IS NULL AS INT)) OVER w AS volume_missing, first_value(close) OVER w AS oldest
        FROM t WINDOW w AS (PARTITION BY ts_code ORDER BY day_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT trade_date, ts_code, day_index, volume_sum, volume_missing::BIGINT AS volume_missing, oldest FROM q WHERE n = 5 AND span = 4""")
def eval_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five consecutive sessions per sample; a gap gives no sample, a null feature a flag."""
    b = adapters.bars(spark, sf_dir)
    b = b.join(F.broadcast(panel.calendar(b)), "trade_date").withColumn("volume", F.when(F.dayofmonth("trade_date") != 3, F.col("volume")))
    q = ev.sequences(b.select("trade_date", "ts_code", "day_index", "close", "volume"), ["close", "volume"], 5)
    total = F.aggregate("volume_values", F.lit(0.0), lambda a, x: a + x)
    missing = F.aggregate("volume_missing", F.lit(0), lambda a, x: a + x).cast("bigint")
    return q.select("trade_date", "ts_code", "day_index", total.alias("volume_sum"), missing.alias("volume_missing"), F.col("close_values")[0].alias("oldest"))


@query(f"""WITH {PANEL_SQL}, d AS (SELECT trade_date, day_index, avg(ret_1) AS r FROM lab GROUP BY trade_date, day_index), e AS (SELECT *, exp(sum(ln(1 + r)) OVER (ORDER BY day_index)) AS v FROM d WHERE r IS NOT NULL),
    m AS (SELECT year(trade_date) AS year, count(*) AS n, exp(sum(ln(1 + r))) - 1 AS total, avg(r) AS mean, stddev_samp(r) AS sd FROM d WHERE r IS NOT NULL GROUP BY 1)
    SELECT year, n, {s('mean / sd * sqrt(252.0)', 4, 'sharpe')}, {s('mean')} FROM m""")
def eval_period_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio and mean of the equal-weight label per year."""
    d = labelled(spark, sf_dir).groupBy("trade_date").agg(F.avg("ret_1").alias("r")).where("r is not null")
    m = d.groupBy(F.year("trade_date").cast("bigint").alias("year")).agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"))
    return m.withColumn("sharpe", F.when(F.col("sd") > 1e-12, F.col("mean") / F.col("sd")) * F.lit(252**0.5)).selectExpr("year", "n", r("sharpe", 4), r("mean"))


@query(f"""WITH {BARS_SQL}, t AS (SELECT bars.trade_date, bars.ts_code, day_index, close, CASE WHEN day(bars.trade_date) <> 3 THEN volume END AS volume FROM bars JOIN cal ON cal.trade_date = bars.trade_date),
    q AS (SELECT ts_code, day_index, day_index - min(day_index) OVER w AS span, count(*) OVER w AS n, sum(coalesce(volume, 0)) OVER w AS volume_sum, sum(CAST(volume IS NULL AS INT)) OVER w AS volume_missing, first_value(close) OVER w AS oldest
        FROM t WINDOW w AS (PARTITION BY ts_code ORDER BY day_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT ts_code, day_index, volume_sum, volume_missing::BIGINT AS volume_missing, {s('CAST(CAST(oldest AS FLOAT) AS DOUBLE)', 2, 'oldest')} FROM q WHERE n = 5 AND span = 4""")
def store_sequence_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of eval_sequences from arrays that hold each row once, in single precision."""
    b = adapters.bars(spark, sf_dir)
    b = b.join(panel.calendar(b), "trade_date").withColumn("volume", F.when(F.dayofmonth("trade_date") != 3, F.col("volume")))
    folder = shared_folder(spark, "arrays")
    arrays.write(b, folder, ["close", "volume"], 4)
    q = arrays.samples(spark, folder, 5)
    total = F.aggregate(F.filter("x", lambda v, i: i % 2 == 1), F.lit(0.0), lambda a, v: a + v)
    missing = F.aggregate(F.filter("missing", lambda v, i: i % 2 == 1), F.lit(0), lambda a, v: a + v).cast("bigint")
    return q.select("ts_code", "day_index", total.alias("volume_sum"), missing.alias("volume_missing"), F.col("x")[0].cast("double").alias("oldest")).selectExpr("ts_code", "day_index", "volume_sum", "volume_missing", r("oldest", 2))
