"""Minute-to-daily features: one row per security and session from its bars.

All are grouped aggregations over bars with window columns computed once per stock-day, so a session's features cost
one shuffle by (ts_code, trade_date). Baselines of earlier sessions are range windows over session numbers, strictly
before the signal's session, in which suspended sessions are holes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.evaluate import safe_corr

DAY = ["ts_code", "trade_date", "day_index"]


def _prices(bars: DataFrame) -> Column:
    """Whether a bar's prices (those of open, high, low, close that there are) are positive and finite."""
    ok = F.lit(True)
    for c in ("open", "high", "low", "close"):
        if c in bars.columns:
            ok = ok & F.coalesce((F.col(c) > 0) & ~F.isnan(c) & (F.col(c) < float("inf")), F.lit(False))
    return ok


def complete(bars: DataFrame, count: int = 241) -> DataFrame:
    """Bars of stock-days that exclusions() has no reason against, other than bars beyond the session, which go: `count` bars numbered from 0, each once, all with positive finite prices."""
    w = Window.partitionBy("ts_code", "trade_date")
    b = bars.where(F.col("ts_code").isNotNull() & F.col("minute_index").between(0, count - 1))
    b = b.withColumns({"_n": F.count("*").over(w), "_places": F.size(F.collect_set("minute_index").over(w)), "_ok": F.min(_prices(bars).cast("int")).over(w)})
    return b.where((F.col("_n") == count) & (F.col("_places") == count) & (F.col("_ok") == 1)).drop("_n", "_places", "_ok")


def exclusions(bars: DataFrame, count: int = 241) -> DataFrame:
    """Why stock-days take no part: ts_code, trade_date, reason, bars (that the reason is about).

    minute_index_out_of_range: bars beyond the session, which are left out while the others may still make a whole one.
    bar_count_invalid: more or fewer than `count` bars in the session. invalid_price: as many as that, but one has a price
    that isn't positive and finite, or comes twice so that another lacks. Bars without code or number aren't looked at.
    One aggregation by stock-day.
    """
    inside = F.col("minute_index").between(0, count - 1)
    b = bars.where(F.col("ts_code").isNotNull() & F.col("minute_index").isNotNull())
    day = b.groupBy("ts_code", "trade_date").agg(F.count_if(~inside).alias("_out"), F.count_if(inside).alias("_in"), F.count_if(inside & ~_prices(bars)).alias("_bad"), F.size(F.collect_set(F.when(inside, F.col("minute_index")))).alias("_places"))
    lacks = F.col("_in") - F.col("_places")
    reason = F.when((F.col("_in") > 0) & (F.col("_in") != count), F.struct(F.lit("bar_count_invalid").alias("reason"), F.col("_in").alias("bars"))).when((F.col("_in") == count) & (F.col("_bad") + lacks > 0), F.struct(F.lit("invalid_price").alias("reason"), (F.col("_bad") + lacks).alias("bars")))
    out = F.when(F.col("_out") > 0, F.struct(F.lit("minute_index_out_of_range").alias("reason"), F.col("_out").alias("bars")))
    return day.select("ts_code", "trade_date", F.explode(F.array_compact(F.array(out, reason))).alias("_r")).select("ts_code", "trade_date", "_r.reason", "_r.bars")


def with_returns(bars: DataFrame) -> DataFrame:
    """r: log return of the bar (of the first, against its open); with the session's running and total sums."""
    day = Window.partitionBy("ts_code", "trade_date")
    w = day.orderBy("minute_index")
    before = F.lag("close").over(w)
    r = F.ln(F.col("close") / F.coalesce(before, F.col("open")))
    return bars.withColumn("r", r).withColumn("d", F.col("close") - before).withColumn("dv", F.col("volume") - F.lag("volume").over(w)).withColumn("peak", F.max("close").over(w)).withColumn("bars", F.count("*").over(day))


def smart_ratio(bars: DataFrame, keys: dict[str, tuple[Column, float]]) -> DataFrame:
    """Per stock-day and name: price of the smart bars against the session's, both weighted by volume.

    Bars with volume go in descending order of the key (ties by minute); those until their volume reaches the given
    share of the session's are smart, the crossing one included. {name: (key, share)}.
    """
    day = Window.partitionBy("ts_code", "trade_date")
    out = bars.where("volume > 0").withColumn("_total", F.sum("volume").over(day))
    parts = []
    for name, (key, share) in keys.items():
        w = day.orderBy(key.desc(), "minute_index").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"_c_{name}", F.sum("volume").over(w))
        smart = F.col(f"_c_{name}") - F.col("volume") < F.lit(share) * F.col("_total")
        price = F.try_divide(F.sum(F.when(smart, F.col("amount"))), F.sum(F.when(smart, F.col("volume"))))
        parts.append(F.try_divide(price, F.try_divide(F.sum("amount"), F.sum("volume"))).alias(name))
    return out.groupBy(*DAY).agg(*parts)


def moments(column: str, n: str) -> tuple[Column, Column]:
    """Population skewness and kurtosis (3 for a normal law), null for constants."""
    m = F.avg(column)
    m2 = F.avg(F.col(column) * F.col(column)) - m * m
    m3 = F.avg(F.pow(column, F.lit(3))) - 3 * m * F.avg(F.col(column) * F.col(column)) + 2 * m * m * m
    m4 = F.avg(F.pow(column, F.lit(4))) - 4 * m * F.avg(F.pow(column, F.lit(3))) + 6 * m * m * F.avg(F.col(column) * F.col(column)) - 3 * m * m * m * m
    ok = m2 > 1e-18
    return F.when(ok, m3 / F.pow(m2, F.lit(1.5))).alias(f"{n}_skewness"), F.when(ok, m4 / (m2 * m2)).alias(f"{n}_kurtosis")


def core(bars: DataFrame, tail: int = 30, half: float = 0.5) -> DataFrame:
    """Shape of a session: volatility, drawdown, concentration, tail and half-day behaviour, price impact.

    `tail` bars at the end form the tail; the morning ends at the bar half-way. Works on sessions of any number of
    bars; production data are filtered by complete() first.
    """
    b = with_returns(bars)
    day = Window.partitionBy("ts_code", "trade_date")
    b = b.withColumn("_amount", F.sum("amount").over(day)).withColumn("share", F.try_divide("amount", "_amount"))
    b = b.withColumn("_top", F.row_number().over(day.orderBy(F.desc("amount"), "minute_index")))
    i, n = F.col("minute_index"), F.col("bars")
    in_tail, r = i >= n - tail, F.when(i > 0, F.col("r"))
    b = b.withColumn("rr", r)
    close_at = lambda k: F.max(F.when(i == k, F.col("close")))
    first, last, mid, cut = close_at(F.lit(0)), close_at(n - 1), close_at(F.floor(n * half).cast("int")), close_at(F.greatest(n - tail - 1, F.lit(0)))
    vwap = F.try_divide(F.sum("amount"), F.sum("volume"))
    tail_vwap = F.try_divide(F.sum(F.when(in_tail, F.col("amount"))), F.sum(F.when(in_tail, F.col("volume"))))
    square = F.sum(F.col("rr") * F.col("rr"))
    skew, kurt = moments("rr", "mf_realized")
    return b.groupBy(*DAY).agg(
        (F.try_divide(last, vwap) - 1).alias("mf_close_to_vwap"), F.ln(F.try_divide(last, cut)).alias("mf_tail30_return"),
        F.try_divide(F.sum(F.when(in_tail, F.col("amount")).otherwise(0.0)), F.sum("amount")).alias("mf_tail30_amount_share"), (F.try_divide(tail_vwap, vwap) - 1).alias("mf_tail30_vwap_to_day_vwap"),
        (F.ln(F.try_divide(last, mid)) - F.ln(F.try_divide(mid, first))).alias("mf_pm_minus_am_return"), F.sqrt(square).alias("mf_realized_volatility"),
        F.try_divide(F.sum(F.pow(F.least("rr", F.lit(0.0)), F.lit(2))), square).alias("mf_downside_semivariance_ratio"), skew, kurt,
        F.try_divide(F.abs(last - first), F.sum(F.abs("d"))).alias("mf_trend_efficiency"), F.min(F.col("close") / F.col("peak") - 1).alias("mf_max_intraday_drawdown"),
        F.sum(F.col("share") * F.col("share")).alias("mf_amount_hhi"), (-F.sum(F.when(F.col("share") > 0, F.col("share") * F.ln("share"))) / F.ln(F.max("bars"))).alias("mf_amount_entropy"),
        F.sum(F.when(F.col("_top") <= 10, F.col("share"))).alias("mf_top10bar_amount_share"), F.try_divide(F.sum(F.abs("rr")), F.sqrt(F.sum("volume"))).alias("mf_price_impact_b050"),
        safe_corr("rr", "amount").alias("mf_return_amount_corr"),
    )


def curve_features(bars: DataFrame, before: int = 20, least: int = 10, width: int = 5) -> DataFrame:
    """How the session's amounts over the day depart from the mean of earlier sessions: RMSE over bars, largest excess of a bucket."""
    day = Window.partitionBy("ts_code", "trade_date")
    share = bars.withColumn("share", F.try_divide(F.col("amount"), F.sum("amount").over(day)))

    def base(keys: list[str]) -> Window:
        return Window.partitionBy(*keys).orderBy("day_index").rangeBetween(-before, -1)

    w = base(["ts_code", "minute_index"])
    per_bar = share.withColumn("_m", F.when(F.count("share").over(w) >= least, F.avg("share").over(w)))
    rmse = per_bar.groupBy(*DAY).agg(F.when(F.count("_m") > 0, F.sqrt(F.avg(F.pow(F.col("share") - F.col("_m"), F.lit(2))))).alias("mf_amount_curve_rmse_w20"))
    bucket = share.groupBy(*DAY, F.floor(F.col("minute_index") / width).alias("bucket")).agg(F.sum("share").alias("s"))
    w = base(["ts_code", "bucket"])
    bucket = bucket.withColumn("_m", F.when(F.count("s").over(w) >= least, F.avg("s").over(w)))
    excess = bucket.groupBy(*DAY).agg(F.max(F.col("s") - F.col("_m")).alias("mf_five_minute_amount_excess_w20"))
    return rmse.join(excess, DAY)


def quadrant_correlations(bars: DataFrame) -> DataFrame:
    """Correlations of price and volume changes within the four quadrants of their signs, at once and with volume leading."""
    b = with_returns(bars)
    w = Window.partitionBy("ts_code", "trade_date").orderBy("minute_index")
    b = b.withColumn("nd", F.lead("d").over(w))
    parts = [safe_corr("close", "volume").alias("price_volume"), safe_corr("d", "volume").alias("dprice_volume")]
    for kind, price in (("now", "d"), ("lead", "nd")):
        for name, p, v in (("mm", False, False), ("mp", False, True), ("pm", True, False), ("pp", True, True)):
            inside = ((F.col(price) >= 0) == F.lit(p)) & ((F.col("dv") >= 0) == F.lit(v))
            b = b.withColumn(f"_{kind}{name}x", F.when(inside, F.col(price))).withColumn(f"_{kind}{name}y", F.when(inside, F.col("dv")))
            parts.append(pearson(f"_{kind}{name}x", f"_{kind}{name}y").alias(f"{kind}_{name}"))
    return b.groupBy(*DAY).agg(*parts)


#: Bars from the opening to 14:57, and the bar after which the lunch break comes (fixed values).
CONTINUOUS, NOON = 238, 120


def traded_returns(bars: DataFrame) -> DataFrame:
    """with_returns(), and as `move` the return while trade goes on: none for the first bar, that against its own open for the first after lunch."""
    i = F.col("minute_index")
    return with_returns(bars).withColumn("move", F.when(i == NOON + 1, F.ln(F.col("close") / F.col("open"))).when(i > 0, F.col("r")))


def segments(bars: DataFrame, count: int = 8) -> DataFrame:
    """Return while trade goes on (none where nothing was traded), amount and its share of the session's, in equal parts of the session.

    What lies over lunch or before the first close doesn't count; the session's amount has the first bar's too. Bars may
    have a boolean `member`: whether the security belongs to the universe on that session.
    """
    b = traded_returns(bars).withColumn("segment", F.floor(F.col("minute_index") * count / F.col("bars")).cast("int"))
    b = b.withColumn("_day", F.sum("amount").over(Window.partitionBy("ts_code", "trade_date")))
    inside = F.col("minute_index") > 0
    amount = F.coalesce(F.sum(F.when(inside, F.col("amount"))), F.lit(0.0))
    return b.groupBy(*DAY, "segment").agg(
        F.when(F.count_if(inside & (F.col("amount") > 0)) > 0, F.sum("move")).alias("seg_return"), amount.alias("seg_amount"), F.when(F.max("_day") > 0, amount / F.max("_day")).alias("seg_share"),
        *([F.bool_or("member").alias("member")] if "member" in bars.columns else []),
    )


def signed_amounts(bars: DataFrame, tail: int = 30) -> DataFrame:
    """Share of amounts on bars that don't fall less that on bars that fall, of the session and its tail; the first bar and bars without trade stay out."""
    b = traded_returns(bars).where("move is not null and amount > 0 and volume > 0")
    signed, late = F.when(F.col("move") >= 0, F.col("amount")).otherwise(-F.col("amount")), F.col("minute_index") >= F.col("bars") - tail
    return b.groupBy(*DAY).agg(
        F.try_divide(F.sum(signed), F.sum("amount")).alias("mf_signed_amount_imbalance"),
        F.try_divide(F.sum(F.when(late, signed)), F.sum(F.when(late, F.col("amount")))).alias("mf_tail30_signed_amount_imbalance"),
    )


def gap_features(bars: DataFrame, opening: int = 30, noon: int = NOON, before: int = 20, days: int = 5) -> DataFrame:
    """Gaps from the close of the calendar session before: the last `days` of them added up (of the `before` sessions and this one), how the opening goes against the gap, and the gap over lunch.

    A gap of zero counts as one upwards. A session that the security didn't trade leaves no gap to the next.
    """
    at = lambda k, c: F.max(F.when(F.col("minute_index") == k, F.col(c)))
    daily = bars.groupBy(*DAY).agg(F.min_by("open", "minute_index").alias("o"), F.max_by("close", "minute_index").alias("c"), at(opening, "close").alias("co"), at(noon, "close").alias("cn"), at(noon + 1, "open").alias("on"))
    w = Window.partitionBy("ts_code").orderBy("day_index")
    daily = daily.withColumn("gap", F.ln(F.col("o") / F.max("c").over(w.rangeBetween(-1, -1))))
    daily = daily.withColumn("_last", F.collect_list("gap").over(w.rangeBetween(-before, 0)))
    total = F.aggregate(F.slice("_last", -days, days), F.lit(0.0), lambda x, y: x + y)
    return daily.select(
        *DAY, F.when(F.col("gap").isNotNull() & (F.size("_last") >= days), total).alias("mf_overnight_gap_sum_w5"),
        (F.when(F.col("gap") >= 0, -1.0).when(F.col("gap") < 0, 1.0) * F.ln(F.col("co") / F.col("o"))).alias("mf_gap_open30_reversal"), F.ln(F.col("on") / F.col("cn")).alias("mf_lunch_gap"),
    )


#: Bars of a session, the minutes at which its second to eighth segment start, and its 1 % return bins (fixed values).
SESSION, STARTS, BINS = 241, (30, 60, 90, 121, 151, 181, 211), (-11, 10)


def pearson(a: str, b: str) -> Column:
    """Correlation of at least three pairs."""
    return F.when(F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)) >= 3, safe_corr(a, b))


def candidates(bars: DataFrame) -> DataFrame:
    """A session's price-volume correlations, volatility at its price extremes, shares, and contrasts of its eight segments.

    Sessions of another number of bars have their segments in proportion. A fifth of the bars, rounded up, are the
    highest and the lowest (ties: the later and the earlier bar first). Seasonality is the correlation of returns with
    amount shares over their means of 20 prior sessions, ten at least. One shuffle by stock-day serves all but that.
    """
    day = Window.partitionBy("ts_code", "trade_date")
    w = day.orderBy("minute_index")
    b, later = with_returns(bars), F.col("minute_index") > 0
    for name, column in (("r1", "r"), ("v1", "volume"), ("a1", "amount"), ("c1", "close")):
        b = b.withColumn(name, F.when(later, F.col(column)))
    b = b.withColumn("da", F.col("amount") - F.lag("amount").over(w)).withColumn("share", F.try_divide(F.col("amount"), F.sum("amount").over(day)))
    b = b.withColumn("rv5", F.sqrt(F.sum(F.col("r") * F.col("r")).over(w.rowsBetween(-4, 0)))).withColumn("illiquid", F.when(F.col("amount") > 0, F.abs("r1") / F.col("amount")))
    b = b.withColumn("_high", F.row_number().over(day.orderBy(F.desc("close"), F.desc("minute_index")))).withColumn("_low", F.row_number().over(day.orderBy("close", "minute_index")))
    b = b.withColumn("segment", sum((F.col("minute_index") * SESSION >= k * F.col("bars")).cast("int") for k in STARTS))
    prior = Window.partitionBy("ts_code", "minute_index").orderBy("day_index").rowsBetween(-20, -1)
    season = b.withColumn("_m", F.when(F.count("share").over(prior) >= 10, F.avg("share").over(prior))).withColumn("_x", F.col("share") / (F.col("_m") + 1e-12))
    fifth, c = F.ceil(F.col("bars") * 0.2), F.col("share") - 1 / F.col("bars")
    m2 = F.avg(c * c)
    part = lambda inside: F.try_divide(F.avg(F.when(inside, F.col("rv5"))), F.avg("rv5"))
    whole = b.groupBy(*DAY).agg(
        part(F.col("_high") <= fifth).alias("high_price_vol_ratio"), part(F.col("_low") <= fifth).alias("low_price_vol_ratio"), pearson("r1", "v1").alias("return_volume_corr"), pearson("r1", "a1").alias("return_amount_corr"),
        pearson("c1", "dv").alias("price_dvolume_corr"), pearson("r1", "da").alias("return_damount_corr"), F.avg("illiquid").alias("amihud_intraday"),
        F.when(m2 > 1e-12, F.avg(c * c * c) / F.pow(m2, F.lit(1.5))).alias("mf_amount_share_skewness"), F.when(m2 > 1e-12, F.avg(c * c * c * c) / (m2 * m2)).alias("mf_amount_share_kurtosis"),
    )
    seg = b.groupBy(*DAY, "segment").agg(
        F.ln(F.max_by("close", "minute_index") / F.min_by("close", "minute_index")).alias("sr"), F.sum("amount").alias("sa"), F.sum("share").alias("ss"), F.coalesce(F.sum(F.col("r1") * F.col("r1")), F.lit(0.0)).alias("sq"), F.avg("illiquid").alias("am"),
        pearson("r1", "a1").alias("sc"),
    )
    seg = seg.withColumn("_next", F.lead("sr").over(Window.partitionBy(*DAY).orderBy("segment")))
    at = lambda k, x: F.max(F.when(F.col("segment") == k, F.col(x)))
    half = lambda x, inside: F.sum(F.when(inside, F.col(x)))
    log_ratio = lambda x, y: F.ln((x + 1e-12) / (y + 1e-12))
    morning, tail = F.col("segment") < 4, len(STARTS)
    parts = seg.groupBy(*DAY).agg(
        F.stddev_pop("sc").alias("cpv_segment_std"), at(tail, "sc").alias("cpv_segment_last30"), F.stddev_pop("sr").alias("mf_segment_return_dispersion"), pearson("sr", "_next").alias("mf_segment_return_lag1_autocorr"),
        at(0, "ss").alias("mf_open30_amount_share"), log_ratio(at(0, "sa"), at(tail, "sa")).alias("mf_open30_tail30_amount_ratio"), log_ratio(half("sa", morning), half("sa", ~morning)).alias("mf_am_pm_amount_ratio"),
        log_ratio(at(tail, "sa"), F.get(F.sort_array(F.collect_list("sa")), F.lit(3))).alias("mf_tail30_amount_to_segment_median"),
        log_ratio(F.sqrt(at(tail, "sq")), F.sqrt(at(0, "sq"))).alias("mf_tail30_open30_rv_ratio"), log_ratio(F.sqrt(half("sq", ~morning)), F.sqrt(half("sq", morning))).alias("mf_pm_am_rv_ratio"),
        log_ratio(at(tail, "am"), at(0, "am")).alias("mf_tail30_open30_amihud_ratio"), at(tail, "am").alias("_am"), (at(tail, "sr") - at(0, "sr")).alias("mf_tail30_minus_open30_return"),
        (F.atanh(at(tail, "sc")) - F.atanh(at(0, "sc"))).alias("mf_tail30_minus_open30_ra_corr"),
    )
    # what has no base yet has no seasonality, so these rows need not be joined before they are added up
    seasonal = season.groupBy(*DAY).agg(pearson("r", "_x").alias("mf_minute_amount_seasonality_return_corr_w20"))
    out = whole.join(parts, DAY).join(seasonal, DAY).withColumn("mf_tail30_day_amihud_ratio", log_ratio(F.col("_am"), F.col("amihud_intraday"))).drop("_am")
    return out


def prior_means(daily: DataFrame, names: dict[str, str], before: int = 20, least: int = 10) -> DataFrame:
    """Means over the security's own earlier sessions, strictly before this one and `least` at least. {column: name of its mean}; the columns themselves go."""
    w = Window.partitionBy("ts_code").orderBy("day_index").rowsBetween(-before, -1)
    return daily.select(*(c for c in daily.columns if c not in names), *(F.when(F.count(c).over(w) >= least, F.avg(c).over(w)).alias(n) for c, n in names.items()))


def prior_z(column: str, before: int = 20, least: int = 10) -> Column:
    """The value against mean and sample deviation of the security's earlier sessions."""
    w = Window.partitionBy("ts_code").orderBy("day_index").rowsBetween(-before, -1)
    sd = F.stddev_samp(column).over(w)
    return F.when((F.count(column).over(w) >= least) & (sd > 1e-12), (F.col(column) - F.avg(column).over(w)) / sd)


def chip_features(bars: DataFrame, quantile: float = 0.8) -> DataFrame:
    """The amount's shares of 22 return bins of 1 %, empty ones included: deviation, skewness and kurtosis of the shares, the top three, and the return at which `quantile` of the amount is reached from below."""
    low, high = BINS
    n = high - low + 1
    w = Window.partitionBy("ts_code", "trade_date").orderBy("minute_index")
    b = bars.withColumn("_o", F.first("open").over(w))
    b = b.withColumn("bin", F.least(F.greatest(F.floor(F.ln(F.col("close") / F.col("_o")) * 100), F.lit(low)), F.lit(high)).cast("int"))
    h = b.groupBy(*DAY, "bin").agg(F.sum("amount").alias("a"))
    day = Window.partitionBy(*DAY)
    h = h.withColumn("p", F.try_divide("a", F.sum("a").over(day))).withColumn("cum", F.sum("p").over(day.orderBy("bin"))).withColumn("k", F.row_number().over(day.orderBy(F.desc("p"), "bin")))
    c, empty = F.col("p") - 1 / n, n - F.count("*")
    m = {k: (F.sum(F.pow(c, F.lit(k))) + empty * (-1 / n) ** k) / n for k in (2, 3, 4)}
    return h.groupBy(*DAY).agg(
        F.sqrt(m[2]).alias("mf_chip_return_bin_std"), F.when(m[2] > 1e-12, m[3] / F.pow(m[2], F.lit(1.5))).alias("mf_chip_return_bin_skewness"), F.when(m[2] > 1e-12, m[4] / (m[2] * m[2])).alias("mf_chip_return_bin_kurtosis"),
        F.sum(F.when(F.col("k") <= 3, F.col("p"))).alias("mf_chip_top3_return_bin_share"), (F.min(F.when(F.col("cum") >= quantile - 1e-12, F.col("bin"))) * 0.01).alias("mf_chip_return_q80"),
    )


#: Five-minute segments of a session, and those of its first half (fixed values).
SEGMENTS, MORNING = 48, 24


def market_residuals(seg: DataFrame, before: int = 20, least: int = 10, coverage: float = 0.8, fewest: int = 3) -> DataFrame:
    """Residual of each segment's return against the mean of the other members of the universe, with a beta of the prior sessions.

    Each security's market leaves itself out: (sum - own) / (n - 1), over members that have the segment; without a
    column `member` all are. Beta takes all such pairs of the calendar sessions before, `least` at least. A residual
    needs `needed` members with the segment: the share `coverage` of the session's, and `fewest`. Sums for the
    regression are added per session first, so the range window runs over sessions, not bars.
    """
    seg = seg if "member" in seg.columns else seg.withColumn("member", F.lit(True))
    own = F.when(F.col("member"), F.col("seg_return"))
    members = seg.groupBy("trade_date").agg(F.count_distinct(F.when(F.col("member"), F.col("ts_code"))).alias("_all"))
    needed = F.greatest(F.ceil(F.round(coverage * F.col("_all"), 9)), F.lit(fewest)).alias("needed")
    m = seg.groupBy("trade_date", "segment").agg(F.sum(own).alias("_s"), F.count(own).alias("_n")).join(members.select("trade_date", needed), "trade_date")
    s = seg.join(m, ["trade_date", "segment"]).withColumn("others", F.when(F.col("_n") > 1, (F.col("_s") - F.col("seg_return")) / (F.col("_n") - 1)))
    x, y = F.col("others"), F.when(F.col("others").isNotNull(), F.col("seg_return"))
    day = s.groupBy(*DAY).agg(F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.count(x).alias("n"))
    w = Window.partitionBy("ts_code").orderBy("day_index").rangeBetween(-before, -1)
    t = lambda c: F.sum(c).over(w)
    var = t("sxx") - t("sx") * t("sx") / t("n")
    day = day.withColumn("beta", F.when((t("n") >= least) & (var > 1e-12), (t("sxy") - t("sx") * t("sy") / t("n")) / var))
    return s.join(day.select(*DAY, "beta"), DAY).withColumn("residual", F.when(F.col("_n") >= F.col("needed"), y - F.col("beta") * x))


def residual_features(residuals: DataFrame, tail: int = 6) -> DataFrame:
    """Sums of residuals over the session and its last half hour, where all segments have one, and their volatility."""
    e, late = F.col("residual"), F.col("segment") >= SEGMENTS - tail
    return residuals.groupBy(*DAY).agg(
        F.max("beta").alias("beta"), F.when(F.count(e) == SEGMENTS, F.sum(e)).alias("mf_market_residual_return"), F.when(F.count_if(late & e.isNotNull()) == tail, F.sum(F.when(late, e))).alias("mf_tail30_market_residual_return"),
        F.when(F.count(e) == SEGMENTS, F.sqrt(F.sum(e * e))).alias("mf_market_residual_rv"),
    )


def down_resilience(residuals: DataFrame, before: int = 20, least: int = 10, share: float = 0.2) -> DataFrame:
    """Mean residual over segments, three at least, in which all others together fell, and by more than in a fifth of the prior sessions' same segment."""
    w = Window.partitionBy("ts_code", "segment").orderBy("day_index").rangeBetween(-before, -1)
    s = residuals.withColumn("_old", F.sort_array(F.collect_list("others").over(w)))
    limit = F.get("_old", F.floor((F.size("_old") - 1) * share).cast("int"))
    e = F.when((F.size("_old") >= least) & (F.col("others") < 0) & (F.col("others") < limit), F.col("residual"))
    return s.groupBy(*DAY).agg(F.when(F.count(e) >= 3, F.avg(e)).alias("mf_market_down_resilience"))


def rank_features(residuals: DataFrame, tail: int = 6, top: float = 0.7) -> DataFrame:
    """Each segment's residual ranked among the universe's members that have one (0 to 1, ties in the middle), where enough do: how often one stays on top from segment to segment but over lunch, and the last half hour's mean rank less the first's."""
    place = Window.partitionBy("trade_date", "segment", "_in")
    ties = Window.partitionBy("trade_date", "segment", "_in", "residual")
    s = residuals.withColumn("_in", F.col("member") & F.col("residual").isNotNull())
    n = F.count("*").over(place)
    s = s.withColumn("q", F.when(F.col("_in") & (n >= F.col("needed")), F.try_divide(F.rank().over(place.orderBy("residual")) + (F.count("*").over(ties) - 1) / 2 - 1, n - 1)))
    before = Window.partitionBy(*DAY).orderBy("segment").rangeBetween(-1, -1)
    s = s.withColumn("was", F.when(F.col("segment") != MORNING, F.max("q").over(before)))
    pair, first, last = F.col("q").isNotNull() & F.col("was").isNotNull(), F.col("segment") < tail, F.col("segment") >= SEGMENTS - tail
    mean = lambda inside: F.when(F.count_if(inside & F.col("q").isNotNull()) == tail, F.avg(F.when(inside, F.col("q"))))
    return s.groupBy(*DAY).agg(
        F.when(F.count_if(pair) == SEGMENTS - 2, F.count_if(pair & (F.col("q") >= top) & (F.col("was") >= top)) / (SEGMENTS - 2)).alias("mf_cs_rank_top30_persistence"), (mean(last) - mean(first)).alias("mf_cs_rank_tail30_minus_open30"),
    )


def abnormal_flows(residuals: DataFrame, before: int = 20, least: int = 10, times: float = 2.0, after: int = 2) -> DataFrame:
    """Segments whose amount stands out against their own history: which way their excess goes, and how the residuals after them go on.

    A segment is abnormal where its share of the session's amount is at least `times` its mean over the calendar sessions
    before (`least` at least) and its return isn't 0. The imbalance weighs the signs by the excess over the mean's share
    of the segments' amount. What follows is the sum of the residuals of the next `after` segments, joined by position
    and signed; a segment within them starts nothing of its own, which a fold over a session's segments in order sees
    to. Both need a session whose segments all have a return and a mean; the fold, those that it comes to.
    """
    own = Window.partitionBy("ts_code", "segment").orderBy("day_index").rangeBetween(-before, -1)
    place = Window.partitionBy(*DAY).orderBy("segment")
    x, base = F.col("seg_return"), F.col("_base")
    s = residuals.withColumn("_base", F.when(F.count("seg_share").over(own) >= least, F.avg("seg_share").over(own)))
    s = s.withColumns({"_known": x.isNotNull() & base.isNotNull() & F.col("seg_share").isNotNull(), "_total": F.sum("seg_amount").over(Window.partitionBy(*DAY))})
    s = s.withColumns({
        "_hot": F.col("_known") & (F.col("seg_share") >= times * base) & (x != 0), "_excess": F.greatest(F.col("seg_amount") - F.col("_total") * base, F.lit(0.0)),
        "_next": sum(F.max("residual").over(place.rangeBetween(k, k)) for k in range(1, after + 1)),
    })
    each = F.sort_array(F.collect_list(F.struct("segment", "_known", F.when(F.col("_hot"), F.signum(x) * F.col("_next")).alias("go"))))
    start = F.struct(F.lit(0).alias("to"), F.lit(0.0).alias("t"), F.lit(0).alias("n"), F.lit(True).alias("ok"))

    def step(a: Column, e: Column) -> Column:
        here = (e["segment"] >= a["to"]) & (e["segment"] < SEGMENTS - after)
        goes = here & e["_known"] & e["go"].isNotNull()
        return F.struct(
            F.when(goes, e["segment"] + after + 1).otherwise(a["to"]).alias("to"), F.when(goes, a["t"] + e["go"]).otherwise(a["t"]).alias("t"), F.when(goes, a["n"] + 1).otherwise(a["n"]).alias("n"),
            (a["ok"] & (~here | e["_known"])).alias("ok"),
        )

    hot = F.when(F.col("_hot"), F.col("_excess"))
    s = s.groupBy(*DAY).agg(
        F.when((F.count_if("_known") == SEGMENTS) & (F.sum(hot) > 0), F.sum(F.signum(x) * hot) / F.sum(hot)).alias("mf_abnormal_signed_amount_imbalance"),
        F.when(F.count("*") == SEGMENTS, F.aggregate(each, start, step)).alias("_f"),
    )
    return s.select(*DAY, "mf_abnormal_signed_amount_imbalance", F.when(F.col("_f.ok") & (F.col("_f.n") > 0), F.col("_f.t") / F.col("_f.n")).alias("mf_abnormal_flow_followthrough_10m"))


def traded_costs(bars: DataFrame, share: float = 0.85) -> DataFrame:
    """What the session's volume was traded at: the part above the close, the dispersion, the price under which `share` of it lies, the afternoon's price against the morning's, and the part of eight segments with more bought than sold.

    The bar at noon is the morning's last. Bars without amount or volume stay out, but their volume counts in the whole;
    in the eight segments so does the first bar, and each of them needs some trade.
    """
    day = Window.partitionBy("ts_code", "trade_date")
    b = traded_returns(bars).withColumn("_p", F.when((F.col("volume") > 0) & (F.col("amount") > 0), F.col("amount") / F.col("volume")))
    b = b.withColumns({"_v": F.sum(F.greatest("volume", F.lit(0.0))).over(day), "_c": F.max_by("close", "minute_index").over(day), "_w": F.when(F.col("_p").isNotNull(), F.col("volume"))})
    b = b.withColumns({"_vw": F.try_divide(F.sum(F.col("_w") * F.col("_p")).over(day), F.col("_v")), "_cum": F.sum("_w").over(day.orderBy(F.col("_p").asc_nulls_last(), "minute_index"))})
    b = b.withColumn("_part", F.floor(F.col("minute_index") * 8 / F.col("bars")).cast("int"))
    p, v, w, vw, c = (F.col(k) for k in ("_p", "_v", "_w", "_vw", "_c"))
    late, signed = F.col("minute_index") * 2 >= F.col("bars"), F.when(p.isNotNull() & F.col("move").isNotNull(), F.when(F.col("move") >= 0, 1.0).otherwise(-1.0) * F.col("amount"))
    price = lambda inside: F.try_divide(F.sum(F.when(inside & p.isNotNull(), F.col("amount"))), F.sum(F.when(inside, w)))
    part = b.groupBy(*DAY, "_part").agg(F.sum(signed).alias("_s"))
    part = part.groupBy(*DAY).agg(F.when(F.count("_s") == 8, F.count_if(F.col("_s") > 0) / 8).alias("mf_signed_amount_positive_segment_share"))
    whole = b.groupBy(*DAY).agg(
        F.try_divide(F.coalesce(F.sum(F.when(p > c, w)), F.lit(0.0)), F.max(v)).alias("mf_traded_volume_above_close_share"), (F.sqrt(F.sum(w * (p - vw) * (p - vw)) / F.max(v)) / F.max(vw)).alias("mf_traded_cost_dispersion"),
        ((F.min(F.when(F.col("_cum") >= share * v, p)) - F.max(c)) / F.max(vw)).alias("mf_cost_q85_to_close"), F.ln(F.try_divide(price(late), price(~late))).alias("mf_pm_am_vwap_log_ratio"),
    )
    return whole.join(part, DAY)


def volume_events(bars: DataFrame) -> DataFrame:
    """Bars of outstanding volume in continuous trading: their number of peaks, returns where volume jumps, volume of bars whose body is small.

    A peak counts where the one before it is more than a minute away, also over lunch; the first doesn't count.
    """
    day = Window.partitionBy("ts_code", "trade_date")
    w = day.orderBy("minute_index")
    b = bars.where(F.col("minute_index") < CONTINUOUS).withColumn("dv", F.col("volume") - F.lag("volume").over(w)).withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    b = b.withColumn("_high", F.col("volume") > F.avg("volume").over(day) + F.stddev_samp("volume").over(day)).withColumn("_jump", F.col("dv") > F.avg("dv").over(day) + F.stddev_samp("dv").over(day))
    b = b.withColumn("_was", F.last(F.when(F.col("_high"), F.col("minute_index")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    again = F.col("_high") & ((F.col("minute_index") - F.col("_was") > 1) | (F.col("_was") == NOON))
    small = F.abs(F.col("close") - F.col("open")) <= 0.5 * F.abs(F.col("high") - F.col("low"))
    return b.groupBy(*DAY).agg(
        F.when(F.count_if("_high") > 0, F.count_if(again)).alias("mf_dos_volume_peak_count"), F.avg(F.when(F.col("_jump"), F.col("ret"))).alias("mf_dos_flash_returns"),
        F.try_divide(F.sum(F.when(small, F.col("volume"))), F.sum("volume")).alias("mf_dos_consist_volume"),
    )


def volume_up_returns(bars: DataFrame) -> DataFrame:
    """Minus the deviation of returns on bars whose volume stands out from the whole session's, of all but the first bar and of the positive ones."""
    day = Window.partitionBy("ts_code", "trade_date")
    b = with_returns(bars).withColumn("_high", (F.col("minute_index") > 0) & (F.col("volume") > F.avg("volume").over(day) + F.stddev_pop("volume").over(day)))
    return b.groupBy(*DAY).agg((-F.stddev_pop(F.when(F.col("_high"), F.col("r")))).alias("mf_volume_up_return_std"), (-F.stddev_pop(F.when(F.col("_high") & (F.col("r") > 0), F.col("r")))).alias("mf_volume_up_positive_return_std"))


def adjusted_amount_correlations(bars: DataFrame, before: int = 20) -> DataFrame:
    """Correlation of absolute log returns with amounts standardised by the same minute of earlier days, one of the two a bar late.

    Earlier days are the security's own observed ones, up to `before` of them and two at least. The first bar's
    neighbour is the last bar of the day before.
    """
    b = bars.where(F.col("minute_index") < CONTINUOUS)
    same = Window.partitionBy("ts_code", "minute_index").orderBy("day_index").rowsBetween(-before, -1)
    b = b.withColumn("_s", F.stddev_samp("amount").over(same)).withColumn("adj", F.when(F.col("_s") > 0, (F.col("amount") - F.avg("amount").over(same)) / F.col("_s")))
    line = Window.partitionBy("ts_code").orderBy("day_index", "minute_index")
    b = b.withColumn("step", F.abs(F.ln(F.col("close") / F.lag("close").over(line)))).withColumn("adj_late", F.lag("adj").over(line))
    b = b.withColumn("step_late", F.lag(F.when(F.col("minute_index") > 0, F.col("step"))).over(line))
    return b.groupBy(*DAY).agg(safe_corr("step", "adj_late").alias("mf_dos_corr_ret_lag_adj_amount"), safe_corr("step_late", "adj").alias("mf_dos_corr_lag_ret_adj_amount"))


def relative_volume_ranks(bars: DataFrame, width: int = 10) -> DataFrame:
    """Mean over deviation, plus excess kurtosis, of a session's ranks among all securities of the bar's volume over its mean of ten bars.

    Ranks are the smallest of ties over the number of securities at that minute.
    """
    w = Window.partitionBy("ts_code", "trade_date").orderBy("minute_index").rowsBetween(1 - width, 0)
    minute = Window.partitionBy("trade_date", "minute_index")
    b = bars.where(F.col("minute_index") < CONTINUOUS).withColumn("prop", F.try_divide(F.col("volume"), F.avg("volume").over(w))).where("prop is not null")
    b = b.withColumn("q", F.rank().over(minute.orderBy("prop")) / F.count("*").over(minute))
    _, kurt = moments("q", "q")
    return b.groupBy(*DAY).agg(F.stddev_samp("q").alias("_s"), F.avg("q").alias("_m"), kurt).select(*DAY, F.when(F.col("_s") > 1e-12, F.col("_m") / F.col("_s") + F.col("q_kurtosis") - 3).alias("mf_dos_patv"))
