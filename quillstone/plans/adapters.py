"""Adapters that make market-like input of the star-schema tables, in Spark and, for the checks, in SQL.

P1, a daily panel: security = supplier modulo 5, session = ship date, price = extended price / quantity.
P1 wide: security = supplier (10, 100, 1000 at the three scales), session = month of the ship date.
P2, intraday bars: security = event type, session = day, bar = order of the event in its day, price = value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators import panel
from quillstone.plans.compiler import rounded
from quillstone.session import ship

#: Decimals that the checks round their panel and the formulas' windows to.
DECIMALS = 8
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(*ORDER, "l_quantity", "l_extendedprice", "l_shipdate")
    return t.select(
        *ORDER, F.concat(F.lit("S"), F.col("l_suppkey") % 5).alias("ts_code"), F.to_date("l_shipdate").alias("trade_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.daily_bars(trades(spark, sf_dir), "price", "quantity", "amount", ORDER)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.formula_panel(bars(spark, sf_dir), DECIMALS)


def wide_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(*ORDER, "l_quantity", "l_extendedprice", "l_shipdate")
    t = t.select(
        *ORDER, "l_shipdate", F.concat(F.lit("S"), F.col("l_suppkey")).alias("ts_code"), F.trunc(F.to_date("l_shipdate"), "month").alias("trade_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"),
    )
    return panel.daily_bars(t, "price", "quantity", "amount", ["l_shipdate", *ORDER])


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide panel, not rounded."""
    return panel.formula_panel(wide_bars(spark, sf_dir))


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts_code, trade_date, day_index, minute_index, open, close, volume, amount of the events."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id", "value")
    e = e.select(F.col("event_type").alias("ts_code"), F.to_date("ts").alias("trade_date"), "ts", "event_id", (1 + F.col("value")).alias("close"), (1 + F.col("user_id") % 50).cast("double").alias("volume"))
    w = Window.partitionBy("ts_code", "trade_date").orderBy("ts", "event_id")
    e = e.withColumn("minute_index", F.row_number().over(w) - 1).withColumn("open", F.coalesce(F.lag("close").over(w), "close"))
    e = e.withColumn("amount", F.col("close") * F.col("volume"))
    return e.join(F.broadcast(panel.calendar(e)), "trade_date").select("ts_code", "trade_date", "day_index", "minute_index", "open", "close", "volume", "amount")


BARS_SQL = """
trades AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'S' || CAST(l_suppkey % 5 AS VARCHAR) AS ts_code, CAST(l_shipdate AS DATE) AS trade_date,
        l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_extendedprice AS amount,
        row_number() OVER (PARTITION BY l_suppkey % 5, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k
    FROM lineitem),
bars AS (
    SELECT trade_date, ts_code, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close,
        sum(quantity) AS volume, sum(amount) AS amount, avg(price) AS twap, count(*) AS bar_count, count(*) FILTER (WHERE quantity > 0) AS traded_bars,
        sum(amount) / nullif(sum(quantity), 0) AS vwap
    FROM trades GROUP BY trade_date, ts_code),
cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS day_index FROM (SELECT DISTINCT trade_date FROM bars)),
dense AS (
    SELECT cal.trade_date, c.ts_code, cal.day_index, open, high, low, close, volume, amount, twap, bar_count, traded_bars, vwap
    FROM cal CROSS JOIN (SELECT DISTINCT ts_code FROM bars) AS c LEFT JOIN bars ON bars.trade_date = cal.trade_date AND bars.ts_code = c.ts_code),
ret AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY ts_code ORDER BY day_index), 0) - 1 AS ret FROM dense),
idx AS (SELECT trade_date, avg(close) AS index_close FROM bars GROUP BY trade_date),
panel AS (
    SELECT ret.trade_date, ts_code, day_index, """ + ", ".join(f"{rounded(k, 8, 'duckdb')} AS {v}" for k, v in panel.NAMES.items()) + """
    FROM ret LEFT JOIN idx ON ret.trade_date = idx.trade_date)"""

WIDE_SQL = BARS_SQL.replace("l_suppkey % 5", "l_suppkey").replace("CAST(l_shipdate AS DATE) AS trade_date", "CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date").replace("l_suppkey, l_shipdate ORDER BY", "l_suppkey, date_trunc('month', l_shipdate) ORDER BY l_shipdate,")
for _name, _column in panel.NAMES.items():
    WIDE_SQL = WIDE_SQL.replace(f"{rounded(_name, DECIMALS, 'duckdb')} AS {_column}", f"{_name} AS {_column}")

MINUTE_SQL = """
ev AS (
    SELECT event_type AS ts_code, CAST(ts AS DATE) AS trade_date, ts, event_id, 1 + value AS close, CAST(1 + user_id % 50 AS DOUBLE) AS volume FROM events),
ev2 AS (
    SELECT *, row_number() OVER w - 1 AS minute_index, coalesce(lag(close) OVER w, close) AS open FROM ev WINDOW w AS (PARTITION BY ts_code, trade_date ORDER BY ts, event_id)),
mcal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS day_index FROM (SELECT DISTINCT trade_date FROM ev)),
minute AS (
    SELECT ts_code, ev2.trade_date, day_index, minute_index, open, close, volume, close * volume AS amount FROM ev2 JOIN mcal ON ev2.trade_date = mcal.trade_date)"""
