"""Checks of a lake: each gives one row of check, severity, violations; and status of its tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Surplus rows of keys that occur more than once, in total."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))


def failing(df: DataFrame, ok: Column) -> DataFrame:
    """Rows for which a condition doesn't hold; a null one counts as failing."""
    return df.agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("violations"))


def report(checks: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """One row per check: {name: (severity, DataFrame of one row with violations)}."""
    parts = [df.select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), F.col("violations").cast("bigint")) for name, (severity, df) in checks.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("violations") == 0)


def raise_on_errors(checks: DataFrame) -> None:
    """Fail if any check of severity error has violations."""
    if failed := [x["check_name"] for x in checks.where("severity = 'error' and not passed").collect()]:
        raise ValueError(f"checks failed: {', '.join(sorted(failed))}")


def status(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows, first and last date of each table: {name: (DataFrame, date column)}."""
    parts = [df.agg(F.count("*").alias("n"), F.min(date).cast("string").alias("first"), F.max(date).cast("string").alias("last")).select(F.lit(name).alias("dataset"), "n", "first", "last") for name, (df, date) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


#: Columns that a day's bar must share with its minutes' sums (fixed values).
SUMMED = ("open", "high", "low", "close", "volume_lot", "volume_share", "amount_cny", "bar_count")


def lake_checks(minute: DataFrame, daily: DataFrame, adjustment: DataFrame, bars: int = 241) -> DataFrame:
    """Nine checks of a lake, a row each: keys, prices and units of minutes and days, days against their minutes, validity and coverage of ratios.

    minute: ts_code, trade_date, datetime, minute_index, open, high, low, close, volume_lot, volume_share, amount_cny.
    daily: the same without time, with bar_count and observation_status ("missing" days aren't checked). adjustment:
    ts_code, trade_date, snapshot_date, validation_status, of which the last snapshot counts for coverage. As in SQL's
    WHERE, a comparison with null is no violation, but a differing null is one in days against minutes. The row checks
    of a table take one scan together.
    """
    seen = daily.where(~F.col("observation_status").eqNullSafe("missing") & F.col("observation_status").isNotNull())

    def counted(df: DataFrame, bad: dict[str, Column]) -> DataFrame:
        one = df.agg(*(F.count_if(c).alias(k) for k, c in bad.items()))
        return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("violations")) for k in bad))).alias("x")).select("x.*")

    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    wrong = (h < F.greatest("open", "close")) | (low > F.least("open", "close"))
    rows = counted(minute, {
        "minute_ohlc": (o <= 0) | (h <= 0) | (low <= 0) | (c <= 0) | wrong, "minute_session": ~F.col("minute_index").between(0, bars - 1),
        "minute_volume_unit": (F.col("volume_share") != F.col("volume_lot") * 100) | (F.col("volume_lot") < 0) | (F.col("amount_cny") < 0),
    })
    rows = rows.unionByName(counted(seen, {"daily_ohlc": (o <= 0) | wrong})).unionByName(counted(adjustment, {"adjustment_validity": F.col("validation_status") != "valid"}))
    again = minute.groupBy("ts_code", "trade_date").agg(
        F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "datetime").alias("close"),
        *(F.sum(x).alias(x) for x in ("volume_lot", "volume_share", "amount_cny")), F.count("*").alias("bar_count"),
    )
    met = seen.join(again.select("ts_code", "trade_date", *(F.col(x).alias(f"_{x}") for x in SUMMED)), ["ts_code", "trade_date"], "left")
    differs = F.lit(False)
    for x in SUMMED:
        differs = differs | ~F.col(x).eqNullSafe(F.col(f"_{x}"))
    last = adjustment.groupBy("ts_code", "trade_date").agg(F.max_by("validation_status", "snapshot_date").alias("_status"))
    bare = seen.join(last, ["ts_code", "trade_date"], "left")
    rows = rows.unionByName(counted(met, {"daily_minute_reaggregation": differs})).unionByName(counted(bare, {"adjustment_coverage": F.col("_status").isNull() | (F.col("_status") != "valid")}))
    for name, df, keys in (("minute_primary_key", minute, ["ts_code", "datetime"]), ("daily_primary_key", daily, ["ts_code", "trade_date"])):
        rows = rows.unionByName(duplicates(df, keys).select(F.lit(name).alias("name"), "violations"))
    severity = F.when(F.col("name") == "adjustment_coverage", "warning").otherwise("error")
    return rows.select(F.col("name").alias("check_name"), severity.alias("severity"), F.col("violations").cast("bigint").alias("violations"), (F.col("violations") == 0).alias("passed"))
