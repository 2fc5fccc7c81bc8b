"""Daily panels: bars from trades, a calendar-dense panel, returns, and the market series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_bars(trades: DataFrame, price: str, quantity: str, amount: str, order: list[str], code: str = "ts_code", date: str = "trade_date") -> DataFrame:
    """Open, high, low, close, volume, amount, vwap, twap and counts per security and session.

    The first and last price go by `order`, a key without ties. One partial aggregation, one shuffle.
    """
    key = F.struct(*order)
    return trades.groupBy(date, code).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"),
        F.sum(quantity).alias("volume"), F.sum(amount).alias("amount"), F.avg(price).alias("twap"),
        F.count("*").alias("bar_count"), F.count_if(F.col(quantity) > 0).alias("traded_bars"),
    ).withColumn("vwap", F.try_divide("amount", "volume"))


def calendar(bars: DataFrame, date: str = "trade_date") -> DataFrame:
    """Sessions with a running number, day_index, from 1.

    A market's calendar has some hundred sessions a year whatever the data's size, so numbering it in one task is
    bounded by time spanned, not by rows: the distinct dates arrive pre-aggregated.
    """
    return bars.select(date).distinct().withColumn("day_index", F.row_number().over(Window.orderBy(date)))


def densify(bars: DataFrame, code: str = "ts_code", date: str = "trade_date") -> DataFrame:
    """Every security on every session; sessions without a bar have nulls, so windows never close over a gap.

    Each security generates its own session numbers, and the calendar (bounded, broadcast) gives their dates.
    """
    days = calendar(bars, date)
    last = days.agg(F.max("day_index").alias("n"))
    codes = bars.select(code).distinct().join(F.broadcast(last)).select(code, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("day_index"))
    return codes.join(F.broadcast(days), "day_index").join(bars, [date, code], "left")


def returns(panel: DataFrame, close: str = "close", code: str = "ts_code") -> DataFrame:
    w = Window.partitionBy(code).orderBy("day_index")
    return panel.withColumn("ret", F.try_divide(F.col(close), F.lag(close).over(w)) - 1)


def equal_weight_index(panel: DataFrame, column: str = "close", date: str = "trade_date") -> DataFrame:
    """The mean over securities per session."""
    return panel.groupBy(date).agg(F.avg(column).alias("index_close"))


#: Columns of a panel and their names in formulas.
NAMES = {"open": "O", "high": "H", "low": "L", "close": "C", "volume": "V", "vwap": "VWAP", "ret": "RET", "index_close": "IDX"}


def formula_panel(bars: DataFrame, decimals: int | None = None) -> DataFrame:
    """The dense panel under the names that formulas use, rounded to decimals where asked for."""
    p = returns(densify(bars))
    p = p.join(equal_weight_index(bars), "trade_date", "left")
    return p.select("trade_date", "ts_code", "day_index", *((F.col(k) if decimals is None else F.rint(F.col(k) * 10.0**decimals) / 10.0**decimals).alias(v) for k, v in NAMES.items()))


def fin(c: Column | str) -> Column:
    """The value where it is finite, else null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def ring_mean(column: str, before: int, least: int, code: str = "ts_code") -> Column:
    """Mean over the `before` calendar sessions strictly before this one, null with fewer than `least` observations."""
    w = Window.partitionBy(code).orderBy("day_index").rangeBetween(-before, -1)
    return F.when(F.count(column).over(w) >= least, F.avg(column).over(w))


def ring_z(column: str, before: int, least: int, code: str = "ts_code") -> Column:
    """The value against mean and sample deviation of the prior sessions; null where these hardly vary."""
    w = Window.partitionBy(code).orderBy("day_index").rangeBetween(-before, -1)
    sd = F.stddev_samp(column).over(w)
    return F.when((F.count(column).over(w) >= least) & (sd > 1e-12), (F.col(column) - F.avg(column).over(w)) / sd)
