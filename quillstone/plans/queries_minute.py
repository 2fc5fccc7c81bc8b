"""Queries of minute-to-daily features over the events as bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import minute, panel, session_curves
from quillstone.plans import adapters
from quillstone.plans.adapters import MINUTE_SQL
from quillstone.plans.queries_eval import CORR
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


def _shown(df: DataFrame, digits: int = 6) -> DataFrame:
    keys = ["ts_code", "trade_date"]
    return df.selectExpr(*keys, *(r(c, digits) if t == "double" else c for c, t in df.dtypes if c not in (*keys, "day_index")))


RET_SQL = MINUTE_SQL + """,
mr AS (
    SELECT *, ln(close / coalesce(lag(close) OVER w, open)) AS r, close - lag(close) OVER w AS d, volume - lag(volume) OVER w AS dv, max(close) OVER w AS peak,
        count(*) OVER (PARTITION BY ts_code, trade_date) AS bars FROM minute WINDOW w AS (PARTITION BY ts_code, trade_date ORDER BY minute_index))"""


@query(f"""WITH {RET_SQL}, b AS (
        SELECT *, CASE WHEN minute_index > 0 THEN r END AS rr, CASE WHEN minute_index > 0 THEN amount END AS later, amount / sum(amount) OVER (PARTITION BY ts_code, trade_date) AS share, row_number() OVER (PARTITION BY ts_code, trade_date ORDER BY amount DESC, minute_index) AS top FROM mr),
    g AS (
        SELECT ts_code, trade_date, max(close) FILTER (WHERE minute_index = 0) AS c0, max(close) FILTER (WHERE minute_index = bars - 1) AS cl, max(close) FILTER (WHERE minute_index = CAST(floor(bars * 0.5) AS INT)) AS cm,
            max(close) FILTER (WHERE minute_index = greatest(bars - 31, 0)) AS ck, sum(amount) / sum(volume) AS vwap, sum(amount) FILTER (WHERE minute_index >= bars - 30) AS ta, sum(volume) FILTER (WHERE minute_index >= bars - 30) AS tv, sum(amount) AS a,
            sum(volume) AS v, sum(rr * rr) AS sq, sum(pow(least(rr, 0), 2)) AS down, avg(rr) AS m, sum(abs(d)) AS path, min(close / peak - 1) AS dd, sum(share * share) AS hhi, -sum(share * ln(share)) / ln(max(bars)) AS ent, sum(share) FILTER (WHERE top <= 10) AS t10, sum(abs(rr)) AS ar, {CORR.format(a='rr', b='later')} AS ra FROM b GROUP BY ts_code, trade_date),
    k AS (SELECT b.ts_code, b.trade_date, avg(pow(rr - m, 2)) AS m2, avg(pow(rr - m, 3)) AS m3, avg(pow(rr - m, 4)) AS m4 FROM b JOIN g ON g.ts_code = b.ts_code AND g.trade_date = b.trade_date GROUP BY b.ts_code, b.trade_date)
    SELECT g.ts_code, g.trade_date, {s('cl / vwap - 1', 6, 'mf_close_to_vwap')}, {s('ln(cl / ck)', 6, 'mf_tail30_return')}, {s('ta / a', 6, 'mf_tail30_amount_share')}, {s('ta / tv / vwap - 1', 6, 'mf_tail30_vwap_to_day_vwap')},
        {s('ln(cl / cm) - ln(cm / c0)', 6, 'mf_pm_minus_am_return')}, {s('sqrt(sq)', 6, 'mf_realized_volatility')}, {s('down / nullif(sq, 0)', 6, 'mf_downside_semivariance_ratio')}, {s('CASE WHEN m2 > 1e-18 THEN m3 / pow(m2, 1.5) END', 6, 'mf_realized_skewness')}, {s('CASE WHEN m2 > 1e-18 THEN m4 / (m2 * m2) END', 6, 'mf_realized_kurtosis')},
        {s('abs(cl - c0) / nullif(path, 0)', 6, 'mf_trend_efficiency')}, {s('dd', 6, 'mf_max_intraday_drawdown')}, {s('hhi', 6, 'mf_amount_hhi')}, {s('ent', 6, 'mf_amount_entropy')}, {s('t10', 6, 'mf_top10bar_amount_share')}, {s('ar / sqrt(v)', 6, 'mf_price_impact_b050')}, {s('ra', 6, 'mf_return_amount_corr')}
    FROM g JOIN k ON k.ts_code = g.ts_code AND k.trade_date = g.trade_date""")
def minute_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(minute.core(adapters.minute_bars(spark, sf_dir)))


def _key(beta: float | None) -> Column:
    weight = F.pow("volume", F.lit(beta)) if beta is not None else F.ln(1 + F.col("volume"))
    return F.rint(F.abs("r") / weight * 1e10) / 1e10


SMART = {"s_b010": (0.10, 0.20), "s_b025": (0.25, 0.20), "s_b050": (0.50, 0.20), "s_logv": (None, 0.20), "s_b025_p15": (0.25, 0.15)}


def _smart_sql() -> str:
    weight = lambda b: "ln(1 + volume)" if b is None else f"pow(volume, {b})"
    cums = ", ".join(f"sum(volume) OVER (PARTITION BY ts_code, trade_date ORDER BY round_even(abs(r) / {weight(b)} * 1e10, 0) / 1e10 DESC, minute_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c_{n}" for n, (b, _) in SMART.items())
    shares = ", ".join(f"(sum(amount) FILTER (WHERE c_{n} - volume < {p} * total) / sum(volume) FILTER (WHERE c_{n} - volume < {p} * total)) / (sum(amount) / sum(volume)) AS {n}" for n, (_, p) in SMART.items())
    w = "OVER (PARTITION BY ts_code ORDER BY day_index RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)"
    q = ", ".join(s(f"CASE WHEN count(*) {w} >= 6 THEN {n} / avg({n}) {w} END", 6, n.replace("s_", "mf_smart_q_")) for n in SMART)
    return f"WITH {RET_SQL}, c AS (SELECT *, sum(volume) OVER (PARTITION BY ts_code, trade_date) AS total, {cums} FROM mr WHERE volume > 0), g AS (SELECT ts_code, trade_date, day_index, {shares} FROM c GROUP BY ts_code, trade_date, day_index) SELECT ts_code, trade_date, {q} FROM g"


@query(_smart_sql())
def minute_smart_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smart-money ratio against its mean over ten sessions, of which at least five earlier ones are observed."""
    from pyspark.sql import Window

    b = minute.with_returns(adapters.minute_bars(spark, sf_dir))
    g = minute.smart_ratio(b, {n: (_key(beta), share) for n, (beta, share) in SMART.items()})
    w = Window.partitionBy("ts_code").orderBy("day_index").rangeBetween(-9, 0)
    return _shown(g.select("ts_code", "trade_date", *(F.when(F.count("*").over(w) >= 6, F.col(n) / F.avg(n).over(w)).alias(n.replace("s_", "mf_smart_q_")) for n in SMART)))


@query(f"""WITH {MINUTE_SQL}, sh AS (SELECT *, amount / sum(amount) OVER (PARTITION BY ts_code, trade_date) AS share FROM minute),
    pb AS (SELECT *, CASE WHEN count(share) OVER w >= 10 THEN avg(share) OVER w END AS m FROM sh WINDOW w AS (PARTITION BY ts_code, minute_index ORDER BY day_index RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    rm AS (SELECT ts_code, trade_date, CASE WHEN count(m) > 0 THEN sqrt(avg(pow(share - m, 2))) END AS rmse FROM pb GROUP BY ts_code, trade_date),
    bk AS (SELECT ts_code, trade_date, day_index, CAST(floor(minute_index / 5) AS INT) AS bucket, sum(share) AS s FROM sh GROUP BY 1, 2, 3, 4),
    be AS (SELECT *, CASE WHEN count(s) OVER w >= 10 THEN avg(s) OVER w END AS m FROM bk WINDOW w AS (PARTITION BY ts_code, bucket ORDER BY day_index RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    ex AS (SELECT ts_code, trade_date, max(s - m) AS excess FROM be GROUP BY ts_code, trade_date)
    SELECT rm.ts_code, rm.trade_date, {s('rmse', 6, 'mf_amount_curve_rmse_w20')}, {s('excess', 6, 'mf_five_minute_amount_excess_w20')} FROM rm JOIN ex ON ex.ts_code = rm.ts_code AND ex.trade_date = rm.trade_date""")
def minute_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(minute.curve_features(adapters.minute_bars(spark, sf_dir)))


@query(f"""WITH {RET_SQL}, t AS (SELECT ts_code, trade_date, day_index, sum(amount) FILTER (WHERE minute_index >= bars - 30) / sum(amount) AS x FROM mr GROUP BY ts_code, trade_date, day_index)
    SELECT ts_code, trade_date, {s('CASE WHEN count(x) OVER w >= 10 AND stddev_samp(x) OVER w > 1e-12 THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w END', 6, 'mf_tail30_amount_z20')}, {s('CASE WHEN count(x) OVER w >= 10 THEN avg(x) OVER w END', 6, 'mean_w20')}
    FROM t WINDOW w AS (PARTITION BY ts_code ORDER BY day_index RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def minute_ring_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = minute.core(adapters.minute_bars(spark, sf_dir))
    return _shown(t.select("ts_code", "trade_date", panel.ring_z("mf_tail30_amount_share", 20, 10).alias("mf_tail30_amount_z20"), panel.ring_mean("mf_tail30_amount_share", 20, 10).alias("mean_w20")))


def _quadrant_sql() -> str:
    cols, parts = [], [s(CORR.format(a="close", b="volume_"), 6, "price_volume"), s(CORR.format(a="dp_x", b="dp_y"), 6, "dprice_volume")]
    for kind, price in (("now", "d"), ("lead", "nd")):
        for name, p, v in (("mm", "<", "<"), ("mp", "<", ">="), ("pm", ">=", "<"), ("pp", ">=", ">=")):
            inside = f"{price} {p} 0 AND dv {v} 0"
            cols += [f"CASE WHEN {inside} THEN {price} END AS {kind}{name}x", f"CASE WHEN {inside} THEN dv END AS {kind}{name}y"]
            parts.append(s(f"CASE WHEN count({kind}{name}x) >= 3 THEN " + CORR.format(a=f"{kind}{name}x", b=f"{kind}{name}y") + " END", 6, f"{kind}_{name}"))
    return f"WITH {RET_SQL}, n AS (SELECT *, lead(d) OVER (PARTITION BY ts_code, trade_date ORDER BY minute_index) AS nd, volume AS volume_, d AS dp_x, CASE WHEN d IS NOT NULL THEN volume END AS dp_y FROM mr), q AS (SELECT ts_code, trade_date, close, volume_, dp_x, dp_y, {', '.join(cols)} FROM n) SELECT ts_code, trade_date, {', '.join(parts)} FROM q GROUP BY ts_code, trade_date"


@query(_quadrant_sql())
def minute_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(minute.quadrant_correlations(adapters.minute_bars(spark, sf_dir)))


#: Daily columns that are given as their means over earlier sessions.
MEANS = {c: f"mf_{c}_w20" for c in ("high_price_vol_ratio", "low_price_vol_ratio", "return_volume_corr", "return_amount_corr", "price_dvolume_corr", "return_damount_corr", "amihud_intraday", "cpv_segment_std", "cpv_segment_last30")}


def _mean_sql(c: str, name: str) -> str:
    return s(f"CASE WHEN count({c}) OVER h >= 10 THEN avg({c}) OVER h END", 6, name)


def _z_sql(c: str, name: str) -> str:
    return s(f"CASE WHEN count({c}) OVER h >= 10 AND stddev_samp({c}) OVER h > 1e-12 THEN ({c} - avg({c}) OVER h) / stddev_samp({c}) OVER h END", 6, name)


HISTORY_SQL = "WINDOW h AS (PARTITION BY ts_code ORDER BY day_index ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


def _candidates_sql() -> str:
    pearson = lambda a, b: f"CASE WHEN count({a}) FILTER (WHERE {b} IS NOT NULL) >= 3 THEN {CORR.format(a=f'CASE WHEN {b} IS NOT NULL THEN {a} END', b=f'CASE WHEN {a} IS NOT NULL THEN {b} END')} END"
    ratio = lambda a, b: f"ln(({a} + 1e-12) / ({b} + 1e-12))"
    at = lambda k, x: f"max({x}) FILTER (WHERE segment = {k})"
    segment = " + ".join(f"CAST(minute_index * 241 >= {k} * bars AS INT)" for k in minute.STARTS)
    given = ("amount_share_skewness", "amount_share_kurtosis", "minute_amount_seasonality_return_corr_w20", "segment_return_dispersion", "segment_return_lag1_autocorr", "open30_amount_share", "open30_tail30_amount_ratio", "am_pm_amount_ratio", "tail30_amount_to_segment_median",
             "tail30_open30_rv_ratio", "pm_am_rv_ratio", "tail30_open30_amihud_ratio", "tail30_day_amihud_ratio", "tail30_minus_open30_return", "tail30_minus_open30_ra_corr")
    return f"""WITH {RET_SQL}, x AS (
        SELECT *, CASE WHEN minute_index > 0 THEN r END AS r1, CASE WHEN minute_index > 0 THEN volume END AS v1, CASE WHEN minute_index > 0 THEN amount END AS a1, CASE WHEN minute_index > 0 THEN close END AS c1, amount - lag(amount) OVER w AS da,
            amount / sum(amount) OVER dd AS share, sqrt(sum(r * r) OVER (PARTITION BY ts_code, trade_date ORDER BY minute_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS rv5, CASE WHEN amount > 0 AND minute_index > 0 THEN abs(r) / amount END AS illiquid,
            row_number() OVER (PARTITION BY ts_code, trade_date ORDER BY close DESC, minute_index DESC) AS hi, row_number() OVER (PARTITION BY ts_code, trade_date ORDER BY close, minute_index) AS lo, {segment} AS segment
        FROM mr WINDOW w AS (PARTITION BY ts_code, trade_date ORDER BY minute_index), dd AS (PARTITION BY ts_code, trade_date)),
    sn AS (SELECT *, share / (CASE WHEN count(share) OVER p >= 10 THEN avg(share) OVER p END + 1e-12) AS sx FROM x WINDOW p AS (PARTITION BY ts_code, minute_index ORDER BY day_index ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    wh AS (SELECT ts_code, trade_date, day_index, avg(rv5) FILTER (WHERE hi <= ceil(bars * 0.2)) / nullif(avg(rv5), 0) AS high_price_vol_ratio, avg(rv5) FILTER (WHERE lo <= ceil(bars * 0.2)) / nullif(avg(rv5), 0) AS low_price_vol_ratio,
            {pearson('r1', 'v1')} AS return_volume_corr, {pearson('r1', 'a1')} AS return_amount_corr, {pearson('c1', 'dv')} AS price_dvolume_corr, {pearson('r1', 'da')} AS return_damount_corr, avg(illiquid) AS amihud_intraday,
            avg(pow(share - 1 / bars, 2)) AS m2, avg(pow(share - 1 / bars, 3)) AS m3, avg(pow(share - 1 / bars, 4)) AS m4, {pearson('r', 'sx')} AS minute_amount_seasonality_return_corr_w20 FROM sn GROUP BY 1, 2, 3),
    sg AS (SELECT ts_code, trade_date, segment, ln(arg_max(close, minute_index) / arg_min(close, minute_index)) AS sr, sum(amount) AS sa, sum(share) AS ss, coalesce(sum(r1 * r1), 0) AS sq, avg(illiquid) AS am, {pearson('r1', 'a1')} AS sc FROM x GROUP BY 1, 2, 3),
    nx AS (SELECT *, lead(sr) OVER (PARTITION BY ts_code, trade_date ORDER BY segment) AS sr2 FROM sg),
    pt AS (SELECT ts_code, trade_date, stddev_pop(sc) AS cpv_segment_std, {at(7, 'sc')} AS cpv_segment_last30, stddev_pop(sr) AS segment_return_dispersion, {pearson('sr', 'sr2')} AS segment_return_lag1_autocorr, {at(0, 'ss')} AS open30_amount_share,
            {ratio(at(0, 'sa'), at(7, 'sa'))} AS open30_tail30_amount_ratio, {ratio('sum(sa) FILTER (WHERE segment < 4)', 'sum(sa) FILTER (WHERE segment >= 4)')} AS am_pm_amount_ratio, {ratio(at(7, 'sa'), 'list_sort(list(sa))[4]')} AS tail30_amount_to_segment_median,
            {ratio(f"sqrt({at(7, 'sq')})", f"sqrt({at(0, 'sq')})")} AS tail30_open30_rv_ratio, {ratio('sqrt(sum(sq) FILTER (WHERE segment >= 4))', 'sqrt(sum(sq) FILTER (WHERE segment < 4))')} AS pm_am_rv_ratio, {ratio(at(7, 'am'), at(0, 'am'))} AS tail30_open30_amihud_ratio,
            {at(7, 'am')} AS am7, {at(7, 'sr')} - {at(0, 'sr')} AS tail30_minus_open30_return, atanh({at(7, 'sc')}) - atanh({at(0, 'sc')}) AS tail30_minus_open30_ra_corr FROM nx GROUP BY 1, 2),
    al AS (SELECT wh.*, pt.* EXCLUDE (ts_code, trade_date), CASE WHEN m2 > 1e-12 THEN m3 / pow(m2, 1.5) END AS amount_share_skewness, CASE WHEN m2 > 1e-12 THEN m4 / (m2 * m2) END AS amount_share_kurtosis, {ratio('am7', 'amihud_intraday')} AS tail30_day_amihud_ratio
        FROM wh JOIN pt ON pt.ts_code = wh.ts_code AND pt.trade_date = wh.trade_date)
    SELECT ts_code, trade_date, {', '.join(s(c, 6, 'mf_' + c) for c in given)}, {', '.join(_mean_sql(c, n) for c, n in MEANS.items())}, {_z_sql('open30_amount_share', 'mf_open30_amount_z20')}, {_z_sql('tail30_open30_rv_ratio', 'mf_tail30_rv_z20')} FROM al {HISTORY_SQL}"""


@query(_candidates_sql())
def minute_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = minute.candidates(adapters.minute_bars(spark, sf_dir))
    daily = daily.withColumn("mf_open30_amount_z20", minute.prior_z("mf_open30_amount_share")).withColumn("mf_tail30_rv_z20", minute.prior_z("mf_tail30_open30_rv_ratio"))
    return _shown(minute.prior_means(daily, MEANS))


#: Daily correlations within quadrants (signs of price and volume change) and the published names of their means (fixed: these name the opposite quadrant).
QUADRANTS = {
    "price_volume": "mf_cpv_price_volume_level_w20",
    "now_mm": "mf_cpv_dprice_dvolume_pp_w20", "now_mp": "mf_cpv_dprice_dvolume_pm_w20", "now_pm": "mf_cpv_dprice_dvolume_mp_w20", "now_pp": "mf_cpv_dprice_dvolume_mm_w20",
    "lead_mm": "mf_cpv_dvolume_lead_dprice_pp_w20", "lead_pm": "mf_cpv_dvolume_lead_dprice_pm_w20", "lead_mp": "mf_cpv_dvolume_lead_dprice_mp_w20", "lead_pp": "mf_cpv_dvolume_lead_dprice_mm_w20",
}


def _quadrant_means_sql() -> str:
    cols, parts = [], [f"{CORR.format(a='close', b='volume')} AS price_volume"]
    for kind, price in (("now", "d"), ("lead", "nd")):
        for name, p, v in (("mm", "<", "<"), ("mp", "<", ">="), ("pm", ">=", "<"), ("pp", ">=", ">=")):
            inside, n = f"{price} {p} 0 AND dv {v} 0", f"{kind}_{name}"
            cols += [f"CASE WHEN {inside} THEN {price} END AS x_{n}", f"CASE WHEN {inside} THEN dv END AS y_{n}"]
            parts.append(f"CASE WHEN count(x_{n}) >= 3 THEN {CORR.format(a=f'x_{n}', b=f'y_{n}')} END AS {n}")
    return f"""WITH {RET_SQL}, n AS (SELECT *, lead(d) OVER (PARTITION BY ts_code, trade_date ORDER BY minute_index) AS nd FROM mr), q AS (SELECT ts_code, trade_date, day_index, close, volume, {', '.join(cols)} FROM n),
    g AS (SELECT ts_code, trade_date, day_index, {', '.join(parts)} FROM q GROUP BY 1, 2, 3) SELECT ts_code, trade_date, {', '.join(_mean_sql(c, n) for c, n in QUADRANTS.items())} FROM g {HISTORY_SQL}"""


@query(_quadrant_means_sql())
def minute_quadrant_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = minute.quadrant_correlations(adapters.minute_bars(spark, sf_dir))
    return _shown(minute.prior_means(daily.select(*minute.DAY, *QUADRANTS), QUADRANTS))


@query(f"""WITH {MINUTE_SQL}, o AS (SELECT *, first_value(open) OVER (PARTITION BY ts_code, trade_date ORDER BY minute_index) AS o FROM minute),
    h AS (SELECT ts_code, trade_date, CAST(least(greatest(floor(ln(close / o) * 100), -11), 10) AS INT) AS bin, sum(amount) AS a FROM o GROUP BY 1, 2, 3), p AS (SELECT *, a / sum(a) OVER (PARTITION BY ts_code, trade_date) AS p FROM h),
    q AS (SELECT *, sum(p) OVER (PARTITION BY ts_code, trade_date ORDER BY bin) AS cum, row_number() OVER (PARTITION BY ts_code, trade_date ORDER BY p DESC, bin) AS k FROM p),
    al AS (SELECT d.ts_code, d.trade_date, g.i AS bin, coalesce(p.p, 0) AS p FROM (SELECT DISTINCT ts_code, trade_date FROM p) AS d CROSS JOIN range(-11, 11) AS g(i) LEFT JOIN p ON p.ts_code = d.ts_code AND p.trade_date = d.trade_date AND p.bin = g.i),
    mo AS (SELECT ts_code, trade_date, avg(pow(p - 1 / 22, 2)) AS m2, avg(pow(p - 1 / 22, 3)) AS m3, avg(pow(p - 1 / 22, 4)) AS m4 FROM al GROUP BY ts_code, trade_date),
    g AS (SELECT ts_code, trade_date, sum(p) FILTER (WHERE k <= 3) AS t3, min(bin) FILTER (WHERE cum >= 0.8 - 1e-12) * 0.01 AS q80 FROM q GROUP BY ts_code, trade_date)
    SELECT g.ts_code, g.trade_date, {s('sqrt(m2)', 6, 'mf_chip_return_bin_std')}, {s('CASE WHEN m2 > 1e-12 THEN m3 / pow(m2, 1.5) END', 6, 'mf_chip_return_bin_skewness')}, {s('CASE WHEN m2 > 1e-12 THEN m4 / (m2 * m2) END', 6, 'mf_chip_return_bin_kurtosis')}, {s('t3', 6, 'mf_chip_top3_return_bin_share')}, {s('q80', 6, 'mf_chip_return_q80')}
    FROM g JOIN mo ON mo.ts_code = g.ts_code AND mo.trade_date = g.trade_date""")
def minute_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(minute.chip_features(adapters.minute_bars(spark, sf_dir)))


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of which some have no trade, and a universe that one security leaves on every third session."""
    idle = (F.col("ts_code") == "error") & (F.col("volume") % 5 == 0)
    b = adapters.minute_bars(spark, sf_dir).withColumn("amount", F.when(idle, 0.0).otherwise(F.col("amount"))).withColumn("volume", F.when(idle, 0.0).otherwise(F.col("volume")))
    return b.withColumn("member", (F.col("ts_code") != "view") | (F.col("day_index") % 3 != 0))


# every 48th part of a session: its return against the other members' mean, and the residual by a regression over the sessions before
RESIDUAL_SQL = RET_SQL + """,
mu AS (
    SELECT * REPLACE (CASE WHEN idle THEN 0 ELSE amount END AS amount, CASE WHEN idle THEN 0 ELSE volume END AS volume), ts_code <> 'view' OR day_index % 3 <> 0 AS member
    FROM (SELECT *, ts_code = 'error' AND volume % 5 = 0 AS idle FROM mr)),
sg AS (
    SELECT ts_code, trade_date, day_index, CAST(floor(minute_index * 48 / bars) AS INT) AS segment, bool_or(member) AS member, coalesce(sum(amount) FILTER (WHERE minute_index > 0), 0) AS seg_amount, sum(amount) AS all_amount,
        CASE WHEN max(amount) FILTER (WHERE minute_index > 0) > 0 THEN sum(CASE WHEN minute_index = 121 THEN ln(close / open) WHEN minute_index > 0 THEN r END) END AS seg_return
    FROM mu GROUP BY 1, 2, 3, 4),
al AS (SELECT trade_date, greatest(CAST(ceil(count(DISTINCT ts_code) FILTER (WHERE member) * 4 / 5) AS INT), 3) AS needed FROM sg GROUP BY trade_date),
sn AS (SELECT trade_date, segment, sum(seg_return) FILTER (WHERE member) AS s, count(seg_return) FILTER (WHERE member) AS n FROM sg GROUP BY 1, 2),
m AS (SELECT sg.*, n, needed, CASE WHEN n > 1 THEN (s - seg_return) / (n - 1) END AS others FROM sg JOIN sn USING (trade_date, segment) JOIN al USING (trade_date)),
dd AS (SELECT ts_code, trade_date, day_index, sum(others) AS sx, sum(seg_return) FILTER (WHERE others IS NOT NULL) AS sy, sum(others * others) AS sxx, sum(others * seg_return) AS sxy, count(others) AS n FROM m GROUP BY 1, 2, 3),
be AS (SELECT *, sum(n) OVER w AS wn, sum(sx) OVER w AS wx, sum(sy) OVER w AS wy, sum(sxx) OVER w AS wxx, sum(sxy) OVER w AS wxy FROM dd WINDOW w AS (PARTITION BY ts_code ORDER BY day_index RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING)),
bb AS (SELECT ts_code, trade_date, CASE WHEN wn >= 10 AND wxx - wx * wx / wn > 1e-12 THEN (wxy - wx * wy / wn) / (wxx - wx * wx / wn) END AS beta FROM be),
e AS MATERIALIZED (SELECT m.*, beta, CASE WHEN n >= needed THEN seg_return - beta * others END AS res FROM m JOIN bb USING (ts_code, trade_date))"""


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minute.market_residuals(minute.segments(_universe(spark, sf_dir), minute.SEGMENTS))


@query(f"""WITH {RESIDUAL_SQL},
    ol AS (SELECT *, list_sort(list_filter(list(others) OVER (PARTITION BY ts_code, segment ORDER BY day_index RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL)) AS old FROM e),
    dn AS (SELECT *, CASE WHEN len(old) >= 10 AND others < 0 AND others < old[1 + CAST(floor((len(old) - 1) * 0.2) AS INT)] THEN res END AS down FROM ol),
    a AS (SELECT ts_code, trade_date, day_index, max(beta) AS beta, CASE WHEN count(res) = 48 THEN sum(res) END AS whole, CASE WHEN count(res) FILTER (WHERE segment >= 42) = 6 THEN sum(res) FILTER (WHERE segment >= 42) END AS tail,
        CASE WHEN count(res) = 48 THEN sqrt(sum(res * res)) END AS rv, CASE WHEN count(down) >= 3 THEN avg(down) END AS resilience FROM dn GROUP BY 1, 2, 3)
    SELECT ts_code, trade_date, {s('beta', 6, 'beta')}, {s('whole', 6, 'mf_market_residual_return')}, {s('tail', 6, 'mf_tail30_market_residual_return')}, {s('rv', 6, 'mf_market_residual_rv')}, {s('resilience', 6, 'mf_market_down_resilience')},
        {s('CASE WHEN count(rv) OVER w >= 10 AND stddev_samp(rv) OVER w > 1e-12 THEN (rv - avg(rv) OVER w) / stddev_samp(rv) OVER w END', 6, 'mf_market_residual_rv_z20')} FROM a WINDOW w AS (PARTITION BY ts_code ORDER BY day_index RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def minute_market_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    residuals = _residuals(spark, sf_dir)
    daily = minute.residual_features(residuals).join(minute.down_resilience(residuals), minute.DAY)
    return _shown(daily.withColumn("mf_market_residual_rv_z20", panel.ring_z("mf_market_residual_rv", 20, 10)))


@query(f"""WITH RECURSIVE {RESIDUAL_SQL},
    sh AS (SELECT *, CASE WHEN sum(all_amount) OVER d > 0 THEN seg_amount / sum(all_amount) OVER d END AS share, sum(seg_amount) OVER d AS total FROM e WINDOW d AS (PARTITION BY ts_code, trade_date)),
    ba AS (SELECT *, CASE WHEN count(share) OVER w >= 10 THEN avg(share) OVER w END AS base, max(res) OVER (d RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) + max(res) OVER (d RANGE BETWEEN 2 FOLLOWING AND 2 FOLLOWING) AS nxt
        FROM sh WINDOW w AS (PARTITION BY ts_code, segment ORDER BY day_index RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING), d AS (PARTITION BY ts_code, trade_date ORDER BY segment)),
    k AS MATERIALIZED (SELECT *, seg_return IS NOT NULL AND base IS NOT NULL AND share IS NOT NULL AS known, coalesce(share >= 2 * base AND seg_return <> 0, false) AS hot, greatest(seg_amount - total * base, 0) AS excess FROM ba),
    ai AS (SELECT ts_code, trade_date, CASE WHEN count(*) FILTER (WHERE known) = 48 AND sum(excess) FILTER (WHERE hot) > 0 THEN sum(sign(seg_return) * excess) FILTER (WHERE hot) / sum(excess) FILTER (WHERE hot) END AS x, count(*) AS parts FROM k GROUP BY 1, 2),
    fo AS (
        SELECT ts_code, trade_date, 0 AS place, CAST(0 AS DOUBLE) AS t, 0 AS n, true AS ok FROM ai
        UNION ALL
        SELECT ts_code, trade_date, CASE WHEN known AND hot AND nxt IS NOT NULL THEN place + 3 ELSE place + 1 END, t + CASE WHEN known AND hot AND nxt IS NOT NULL THEN sign(seg_return) * nxt ELSE 0 END, fo.n + CASE WHEN known AND hot AND nxt IS NOT NULL THEN 1 ELSE 0 END, ok AND known
        FROM fo JOIN (SELECT ts_code, trade_date, segment, known, hot, nxt, seg_return FROM k) AS k USING (ts_code, trade_date) WHERE segment = place AND place < 46)
    SELECT ts_code, trade_date, {s('max(x)', 6, 'mf_abnormal_signed_amount_imbalance')}, {s('max(CASE WHEN place >= 46 AND ok AND fo.n > 0 AND parts = 48 THEN t / fo.n END)', 6, 'mf_abnormal_flow_followthrough_10m')}
    FROM ai JOIN fo USING (ts_code, trade_date) GROUP BY ts_code, trade_date""")
def minute_abnormal_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(minute.abnormal_flows(_residuals(spark, sf_dir)))


@query(f"""WITH {RESIDUAL_SQL},
    p AS (SELECT *, CASE WHEN volume > 0 AND amount > 0 THEN amount / volume END AS p, CASE WHEN volume > 0 AND amount > 0 THEN volume END AS w, sum(volume) OVER d AS v, last_value(close) OVER (d ORDER BY minute_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c,
        CASE WHEN minute_index = 121 THEN ln(close / open) WHEN minute_index > 0 THEN r END AS move FROM mu WINDOW d AS (PARTITION BY ts_code, trade_date)),
    q AS (SELECT *, sum(w * p) OVER d / nullif(v, 0) AS vw, sum(w) OVER (d ORDER BY p NULLS LAST, minute_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, CASE WHEN p IS NOT NULL AND move IS NOT NULL THEN CASE WHEN move >= 0 THEN amount ELSE -amount END END AS signed FROM p WINDOW d AS (PARTITION BY ts_code, trade_date)),
    parts AS (SELECT ts_code, trade_date, floor(minute_index * 8 / bars) AS part, sum(signed) AS x FROM q GROUP BY 1, 2, 3),
    pos AS (SELECT ts_code, trade_date, CASE WHEN count(x) = 8 THEN count(*) FILTER (WHERE x > 0) / 8 END AS positive FROM parts GROUP BY 1, 2),
    g AS (SELECT ts_code, trade_date, coalesce(sum(w) FILTER (WHERE p > c), 0) / nullif(max(v), 0) AS above, sqrt(sum(w * (p - vw) * (p - vw)) / nullif(max(v), 0)) / max(vw) AS dispersion, (min(p) FILTER (WHERE cum >= 0.85 * v) - max(c)) / max(vw) AS q85,
        ln((sum(amount) FILTER (WHERE p IS NOT NULL AND minute_index * 2 >= bars) / sum(w) FILTER (WHERE minute_index * 2 >= bars)) / (sum(amount) FILTER (WHERE p IS NOT NULL AND minute_index * 2 < bars) / sum(w) FILTER (WHERE minute_index * 2 < bars))) AS pm_am FROM q GROUP BY 1, 2)
    SELECT ts_code, trade_date, {s('positive', 6, 'mf_signed_amount_positive_segment_share')}, {s('above', 6, 'mf_traded_volume_above_close_share')}, {s('dispersion', 6, 'mf_traded_cost_dispersion')}, {s('q85', 6, 'mf_cost_q85_to_close')}, {s('pm_am', 6, 'mf_pm_am_vwap_log_ratio')} FROM g JOIN pos USING (ts_code, trade_date)""")
def minute_traded_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(minute.traded_costs(_universe(spark, sf_dir)))


@query(f"""WITH {RET_SQL}, t AS (SELECT *, CASE WHEN minute_index = 121 THEN ln(close / open) WHEN minute_index > 0 THEN r END AS move FROM mr),
    u AS (SELECT *, CASE WHEN move >= 0 THEN amount ELSE -amount END AS signed FROM t WHERE move IS NOT NULL AND amount > 0 AND volume > 0),
    g AS (SELECT ts_code, trade_date, day_index, sum(signed) / sum(amount) AS x, sum(signed) FILTER (WHERE minute_index >= bars - 30) / sum(amount) FILTER (WHERE minute_index >= bars - 30) AS y FROM u GROUP BY 1, 2, 3)
    SELECT ts_code, trade_date, {s('x', 6, 'mf_signed_amount_imbalance')}, {s('y', 6, 'mf_tail30_signed_amount_imbalance')}, {s('CASE WHEN count(x) OVER w >= 10 AND stddev_samp(x) OVER w > 1e-12 THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w END', 6, 'mf_signed_amount_imbalance_z20')}
    FROM g WINDOW w AS (PARTITION BY ts_code ORDER BY day_index RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def minute_signed_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = minute.signed_amounts(adapters.minute_bars(spark, sf_dir))
    return _shown(daily.withColumn("mf_signed_amount_imbalance_z20", panel.ring_z("mf_signed_amount_imbalance", 20, 10)))


@query(f"""WITH {MINUTE_SQL}, dy AS (SELECT ts_code, trade_date, day_index, arg_min(open, minute_index) AS o, arg_max(close, minute_index) AS c, max(close) FILTER (WHERE minute_index = 30) AS co, max(close) FILTER (WHERE minute_index = 40) AS cn, max(open) FILTER (WHERE minute_index = 41) AS op FROM minute GROUP BY 1, 2, 3),
    g AS (SELECT *, ln(o / max(c) OVER (PARTITION BY ts_code ORDER BY day_index RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)) AS gap FROM dy),
    l AS (SELECT *, list_filter(list(gap) OVER (PARTITION BY ts_code ORDER BY day_index RANGE BETWEEN 20 PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL) AS last FROM g)
    SELECT ts_code, trade_date, {s('CASE WHEN gap IS NOT NULL AND len(last) >= 5 THEN list_sum(last[-5:]) END', 6, 'mf_overnight_gap_sum_w5')}, {s('CASE WHEN gap >= 0 THEN -1 WHEN gap < 0 THEN 1 END * ln(co / o)', 6, 'mf_gap_open30_reversal')}, {s('ln(op / cn)', 6, 'mf_lunch_gap')} FROM l""")
def minute_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of these bars are short, so the break is taken to come after bar 40."""
    return _shown(minute.gap_features(adapters.minute_bars(spark, sf_dir), noon=40))


@query(f"""WITH {RESIDUAL_SQL}, i AS (SELECT *, round_even(res, 10) AS x, count(*) OVER (PARTITION BY trade_date, segment) AS k FROM e WHERE member AND res IS NOT NULL),
    q AS (SELECT *, CASE WHEN k >= needed THEN (rank() OVER (PARTITION BY trade_date, segment ORDER BY x) + (count(*) OVER (PARTITION BY trade_date, segment, x) - 1) / 2.0 - 1) / (k - 1) END AS q FROM i),
    w AS (SELECT ts_code, trade_date, segment, q.q, CASE WHEN segment <> 24 THEN max(q.q) OVER (PARTITION BY ts_code, trade_date ORDER BY segment RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) END AS was FROM e LEFT JOIN q USING (ts_code, trade_date, segment))
    SELECT ts_code, trade_date, {s('CASE WHEN count(*) FILTER (WHERE q IS NOT NULL AND was IS NOT NULL) = 46 THEN count(*) FILTER (WHERE q >= 0.7 AND was >= 0.7) / 46 END', 6, 'mf_cs_rank_top30_persistence')},
        {s('CASE WHEN count(q) FILTER (WHERE segment >= 42) = 6 AND count(q) FILTER (WHERE segment < 6) = 6 THEN avg(q) FILTER (WHERE segment >= 42) - avg(q) FILTER (WHERE segment < 6) END', 6, 'mf_cs_rank_tail30_minus_open30')} FROM w GROUP BY ts_code, trade_date""")
def minute_rank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals are rounded before they are ranked, so that ties don't hang on the order of summation."""
    return _shown(minute.rank_features(_residuals(spark, sf_dir).withColumn("residual", F.bround("residual", 10))))


@query(f"""WITH {MINUTE_SQL}, b AS (SELECT ts_code, trade_date, CASE WHEN minute_index = 9 AND volume % 4 = 0 THEN 8 ELSE minute_index END AS i, CASE WHEN volume = 7 THEN -close ELSE close END > 0 AND open > 0 AS ok FROM minute WHERE minute_index < 66),
    d AS (SELECT ts_code, trade_date, count(*) FILTER (WHERE i > 63) AS out, count(*) FILTER (WHERE i <= 63) AS ins, count(*) FILTER (WHERE i <= 63 AND NOT ok) AS bad, count(*) FILTER (WHERE i <= 63) - count(DISTINCT i) FILTER (WHERE i <= 63) AS lacks FROM b GROUP BY 1, 2)
    SELECT ts_code, trade_date, 'minute_index_out_of_range' AS reason, out AS bars FROM d WHERE out > 0 UNION ALL SELECT ts_code, trade_date, 'bar_count_invalid', ins FROM d WHERE ins > 0 AND ins <> 64 UNION ALL SELECT ts_code, trade_date, 'invalid_price', bad + lacks FROM d WHERE ins = 64 AND bad + lacks > 0""")
def minute_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of 64 bars stand for whole ones; some bars come twice, some prices are negative."""
    b = adapters.minute_bars(spark, sf_dir).where("minute_index < 66")
    b = b.withColumn("minute_index", F.when((F.col("minute_index") == 9) & (F.col("volume") % 4 == 0), 8).otherwise(F.col("minute_index"))).withColumn("close", F.when(F.col("volume") == 7, -F.col("close")).otherwise(F.col("close")))
    return minute.exclusions(b, 64)


def _ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with a high and a low around open and close, which the events don't have."""
    return adapters.minute_bars(spark, sf_dir).withColumn("high", F.greatest("open", "close") + F.col("volume") % 7 / 10).withColumn("low", F.least("open", "close") * (1 - F.col("volume") % 5 / 50))


@query(f"""WITH {MINUTE_SQL}, hl AS (SELECT *, greatest(open, close) + volume % 7 / 10 AS high, least(open, close) * (1 - volume % 5 / 50) AS low FROM minute WHERE minute_index < 238),
    e AS (SELECT *, volume - lag(volume) OVER w AS dv, close / lag(close) OVER w - 1 AS ret FROM hl WINDOW w AS (PARTITION BY ts_code, trade_date ORDER BY minute_index)),
    v AS (SELECT *, volume > avg(volume) OVER w + stddev_samp(volume) OVER w AS outstanding, dv > avg(dv) OVER w + stddev_samp(dv) OVER w AS jump FROM e WINDOW w AS (PARTITION BY ts_code, trade_date)),
    q AS (SELECT *, max(CASE WHEN outstanding THEN minute_index END) OVER (PARTITION BY ts_code, trade_date ORDER BY minute_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM v)
    SELECT ts_code, trade_date, CASE WHEN count(*) FILTER (WHERE outstanding) > 0 THEN count(*) FILTER (WHERE outstanding AND (minute_index - was > 1 OR was = 120)) END AS mf_dos_volume_peak_count, {s('avg(CASE WHEN jump THEN ret END)', 6, 'mf_dos_flash_returns')},
        {s('sum(CASE WHEN abs(close - open) <= 0.5 * abs(high - low) THEN volume END) / sum(volume)', 6, 'mf_dos_consist_volume')} FROM q GROUP BY ts_code, trade_date""")
def minute_volume_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(minute.volume_events(_ranged(spark, sf_dir)))


@query(f"""WITH {RET_SQL}, v AS (SELECT *, minute_index > 0 AND volume > avg(volume) OVER w + stddev_pop(volume) OVER w AS outstanding FROM mr WINDOW w AS (PARTITION BY ts_code, trade_date))
    SELECT ts_code, trade_date, {s('-stddev_pop(CASE WHEN outstanding THEN r END)', 6, 'mf_volume_up_return_std')}, {s('-stddev_pop(CASE WHEN outstanding AND r > 0 THEN r END)', 6, 'mf_volume_up_positive_return_std')} FROM v GROUP BY ts_code, trade_date""")
def minute_volume_up_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(minute.volume_up_returns(adapters.minute_bars(spark, sf_dir)))


@query(f"""WITH {MINUTE_SQL}, c AS (SELECT * FROM minute WHERE minute_index < 238),
    z AS (SELECT *, CASE WHEN stddev_samp(amount) OVER w > 0 THEN (amount - avg(amount) OVER w) / stddev_samp(amount) OVER w END AS adj FROM c WINDOW w AS (PARTITION BY ts_code, minute_index ORDER BY day_index ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    l AS (SELECT *, abs(ln(close / lag(close) OVER w)) AS step, lag(adj) OVER w AS adj_late FROM z WINDOW w AS (PARTITION BY ts_code ORDER BY day_index, minute_index)),
    m AS (SELECT *, lag(CASE WHEN minute_index > 0 THEN step END) OVER (PARTITION BY ts_code ORDER BY day_index, minute_index) AS step_late FROM l),
    p AS (SELECT ts_code, trade_date, CASE WHEN step IS NOT NULL AND adj_late IS NOT NULL THEN step END AS x1, CASE WHEN step IS NOT NULL THEN adj_late END AS y1, CASE WHEN adj IS NOT NULL THEN step_late END AS x2, CASE WHEN step_late IS NOT NULL THEN adj END AS y2 FROM m)
    SELECT ts_code, trade_date, {s(CORR.format(a='x1', b='y1'), 6, 'mf_dos_corr_ret_lag_adj_amount')}, {s(CORR.format(a='x2', b='y2'), 6, 'mf_dos_corr_lag_ret_adj_amount')} FROM p GROUP BY ts_code, trade_date""")
def minute_adjusted_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(minute.adjusted_amount_correlations(adapters.minute_bars(spark, sf_dir)))


@query(f"""WITH {MINUTE_SQL}, c AS (SELECT *, volume / nullif(avg(volume) OVER (PARTITION BY ts_code, trade_date ORDER BY minute_index ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0) AS prop FROM minute WHERE minute_index < 238),
    k AS (SELECT ts_code, trade_date, rank() OVER (PARTITION BY trade_date, minute_index ORDER BY prop) / count(*) OVER (PARTITION BY trade_date, minute_index) AS q FROM c WHERE prop IS NOT NULL),
    g AS (SELECT ts_code, trade_date, avg(q) AS m, stddev_samp(q) AS sd FROM k GROUP BY ts_code, trade_date),
    h AS (SELECT k.ts_code, k.trade_date, max(m) AS m, max(sd) AS sd, avg(pow(q - m, 2)) AS m2, avg(pow(q - m, 4)) AS m4 FROM k JOIN g ON g.ts_code = k.ts_code AND g.trade_date = k.trade_date GROUP BY k.ts_code, k.trade_date)
    SELECT ts_code, trade_date, {s('CASE WHEN sd > 1e-12 THEN m / sd + CASE WHEN m2 > 1e-18 THEN m4 / (m2 * m2) END - 3 END', 6, 'mf_dos_patv')} FROM h""")
def minute_relative_volume_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(minute.relative_volume_ranks(adapters.minute_bars(spark, sf_dir)))


@query(f"""WITH {RESIDUAL_SQL},
    obs AS (SELECT ts_code, trade_date, day_index, row_number() OVER (PARTITION BY ts_code ORDER BY day_index) AS k FROM (SELECT DISTINCT ts_code, trade_date, day_index FROM mu)),
    pool AS (SELECT o.ts_code, o.trade_date, CASE WHEN b.k = o.k THEN 99 ELSE o.k - b.k END AS late, b.trade_date AS from_date, o.k - b.k AS back FROM obs AS o JOIN obs AS b ON b.ts_code = o.ts_code AND b.k BETWEEN o.k - 9 AND o.k AND b.day_index >= o.day_index - 40),
    x AS (SELECT p.ts_code, p.trade_date, volume, amount, sum(volume) OVER d AS whole, sum(amount) OVER d AS money, sum(volume) OVER (d ORDER BY abs(ln(close / open)) / pow(volume, 0.25) DESC, late, minute_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
        FROM pool AS p JOIN mu ON mu.ts_code = p.ts_code AND mu.trade_date = p.from_date WHERE volume > 0 WINDOW d AS (PARTITION BY p.ts_code, p.trade_date)),
    ok AS (SELECT ts_code, trade_date FROM pool GROUP BY 1, 2 HAVING count(*) >= 6),
    q AS (SELECT ts_code, trade_date, sum(amount) / sum(volume) / (max(money) / max(whole)) AS q FROM x WHERE cum - volume < 0.2 * whole GROUP BY 1, 2)
    SELECT obs.ts_code, obs.trade_date, {s('CASE WHEN ok.ts_code IS NOT NULL THEN q END', 6, 'mf_smart_q_pooled_b025_w10_p20')} FROM obs LEFT JOIN ok USING (ts_code, trade_date) LEFT JOIN q USING (ts_code, trade_date)""")
def minute_smart_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(session_curves.pooled_smart_ratio(_universe(spark, sf_dir)))


@query(f"""WITH {RESIDUAL_SQL},
    sh AS (SELECT *, CASE WHEN sum(amount) OVER d > 0 THEN amount / sum(amount) OVER d END AS share, count(*) OVER d AS n FROM mu WHERE minute_index < 40 WINDOW d AS (PARTITION BY ts_code, trade_date)),
    z AS (SELECT *, CASE WHEN count(share) OVER w >= 10 THEN share - avg(share) OVER w END AS z FROM sh WINDOW w AS (PARTITION BY ts_code, minute_index ORDER BY day_index ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, z - avg(z) OVER (PARTITION BY ts_code, trade_date) AS x FROM z),
    f AS (SELECT ts_code, trade_date, k, power(sum(x * cos(2 * pi() * k * minute_index / n)), 2) + power(sum(x * sin(2 * pi() * k * minute_index / n)), 2) AS p, count(x) = max(n) AS whole FROM c, range(1, 31) AS r(k) GROUP BY 1, 2, 3),
    t AS (SELECT ts_code, trade_date, CASE WHEN bool_and(whole) AND sum(p) > 1e-12 THEN sum(p) END AS total, max(p) AS peak, sum(p) FILTER (WHERE k BETWEEN 5 AND 20) AS band FROM f GROUP BY 1, 2)
    SELECT ts_code, trade_date, {s('peak / total', 6, 'mf_amount_periodicity_peak_share_w20')}, {s('band / total', 6, 'mf_amount_periodicity_band_power_w20')} FROM t""")
def minute_periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 bars stand for the session, so that sessions are of one length."""
    return _shown(session_curves.periodicity(_universe(spark, sf_dir).where("minute_index < 40")))


@query(None)
def minute_session_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regressions, spectra, distributions and support areas of each session; tests hold the kernels to known values."""
    from quillstone.operators import session_kernels

    return session_kernels.cross_sectional(session_kernels.features(_ranged(spark, sf_dir)))
