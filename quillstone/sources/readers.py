"""Readers with explicit schemas: minute CSV, vendor snapshots, reference lists, hive-partitioned lakes, file inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import scalar

#: Headers of minute files and the names they get (fixed values).
MINUTE_COLUMNS = {"时间": "raw_time", "代码": "raw_code", "名称": "name", "开盘价": "open", "收盘价": "close", "最高价": "high", "最低价": "low", "成交量": "volume_lot", "成交额": "amount", "涨幅": "change", "振幅": "amplitude"}
ADJUSTMENT_COLUMNS = {"股票代码": "raw_code", "交易日期": "raw_date", "复权因子": "raw_factor"}
STOCK_COLUMNS = {"TS代码": "ts_code", "股票代码": "code", "股票名称": "name", "交易所代码": "exchange", "上市日期": "listed"}
SNAPSHOT_SCHEMA = "symbol string, open string, high string, low string, close string, turnover string, volume bigint, turnover_rate double, ts_millis bigint, ts_millis_open bigint"
MINUTE_SCHEMA = "ts_code string, trade_date date, datetime timestamp, minute_index smallint, open double, high double, low double, close double, volume_lot bigint, volume_share bigint, amount double, source_file string"


def raw_csv(spark: SparkSession, path: str | list[str], columns: dict[str, str]) -> DataFrame:
    """All columns as strings under new names, with the source file; a byte order mark and either line end are fine.

    Columns that a file lacks are null; files with other columns are read by their own header.
    """
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("enforceSchema", False).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    seen = {c.lstrip("﻿").strip("\r\n "): c for c in df.columns}
    text = lambda c: F.regexp_replace(F.col(f"`{c}`").cast("string"), "\r$", "")
    return df.select(*(text(seen[k]).alias(v) if k in seen else F.lit(None).cast("string").alias(v) for k, v in columns.items()), F.col("_metadata.file_path").alias("source_file"))


def minute_csv(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid bars, quarantined rows with their first reason)."""
    raw = raw_csv(spark, path, MINUTE_COLUMNS)
    t = raw.withColumn("ts_code", scalar.symbol(F.col("raw_code"))).withColumn("datetime", scalar.timestamp(F.col("raw_time")))
    for c in ("open", "high", "low", "close", "amount"):
        number = F.col(c).try_cast("double")
        t = t.withColumn(f"raw_{c}", F.col(c)).withColumn(c, number)
    t = t.withColumn("volume_lot", F.col("volume_lot").try_cast("bigint")).withColumn("minute_index", scalar.minute_index(F.col("datetime")))
    reason = scalar.first_reason(
        ("invalid_code", F.col("ts_code").isNull()), ("invalid_timestamp", F.col("datetime").isNull()), ("outside_session", F.col("minute_index").isNull()),
        ("invalid_price", F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()), ("nonpositive_price", F.least("open", "high", "low", "close") <= 0),
        ("inconsistent_ohlc", ~scalar.ohlc_ok("open", "high", "low", "close")), ("invalid_volume", F.col("volume_lot").isNull() | (F.col("volume_lot") < 0)), ("invalid_amount", F.col("amount").isNull() | (F.col("amount") < 0)),
    )
    t = t.withColumn("reason", reason).withColumn("trade_date", F.to_date("datetime")).withColumn("volume_share", F.col("volume_lot") * 100)
    names = [x.split()[0] for x in MINUTE_SCHEMA.split(", ")]
    return t.where("reason is null").select(*names), t.where("reason is not null").select("reason", "raw_code", "raw_time", *(f"raw_{c}" for c in ("open", "high", "low", "close", "amount")), "source_file")


def vendor_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Bars of a JSON-lines snapshot (gzip is fine): prices are strings there, times are UTC milliseconds of the bar's end."""
    j = spark.read.schema(SNAPSHOT_SCHEMA).json(path)
    start = F.timestamp_millis(F.coalesce("ts_millis_open", "ts_millis"))
    local = F.from_utc_timestamp(start, "Asia/Shanghai")
    j = j.select(scalar.symbol(F.col("symbol")).alias("ts_code"), local.alias("datetime"), *(F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close")), F.col("turnover").try_cast("double").alias("amount"), "volume")
    return j.withColumn("trade_date", F.to_date("datetime")).withColumn("minute_index", scalar.minute_index(F.col("datetime"))).withColumn("volume_share", F.col("volume")).withColumn("volume_lot", F.col("volume") / 100)


def json_document(spark: SparkSession, path: str, schema: str, explode: str | None = None) -> DataFrame:
    """A JSON document of several lines; the array of that name becomes rows."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select(F.explode(explode).alias("item")).select("item.*") if explode else df


def adjustment_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """ts_code, trade_date, factor, status."""
    raw = raw_csv(spark, path, ADJUSTMENT_COLUMNS)
    date = F.coalesce(F.try_to_timestamp("raw_date", F.lit("yyyyMMdd")), F.try_to_timestamp(F.replace("raw_date", F.lit("/"), F.lit("-")), F.lit("yyyy-MM-dd"))).cast("date")
    factor = F.col("raw_factor").try_cast("double")
    return raw.select(scalar.symbol(F.col("raw_code")).alias("ts_code"), date.alias("trade_date"), factor.alias("factor"), scalar.adjustment_status(F.col("raw_factor"), factor).alias("status"))


def lake(spark: SparkSession, root: str, schema: str | T.StructType) -> DataFrame:
    """A hive-partitioned Parquet lake; an absent one is an empty table of that schema, so views can always be made."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, modified, sha256 of files, read by the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Catalog views by name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
