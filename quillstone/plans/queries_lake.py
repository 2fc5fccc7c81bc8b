"""Queries of row normalisation, bars, point-in-time joins, set operations and checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import scalar
from quillstone.operators import joins, panel, quality
from quillstone.plans import adapters
from quillstone.plans.adapters import BARS_SQL
from quillstone.plans.compiler import rounded
from quillstone.session import shared_folder
from quillstone.sources import versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def r(c: str, d: int = 6) -> str:
    return f"({rounded(c, d)} + 0.0D) AS {c}"  # no negative zero


def s(c: str, d: int = 6, name: str | None = None) -> str:
    return f"({rounded(c, d, 'duckdb')} + CAST(0 AS DOUBLE)) AS {name or c}"


RAW_SQL = """raw AS (
    SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'SZ' || lpad(CAST(user_id AS VARCHAR), 6, '0') WHEN event_id % 7 = 1 THEN 'sh60' || lpad(CAST(user_id AS VARCHAR), 4, '0')
            WHEN event_id % 7 = 2 THEN '60' || lpad(CAST(user_id AS VARCHAR), 4, '0') || '.SH' ELSE 'bj' || CAST(user_id AS VARCHAR) END AS code,
        CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%Y/%m/%d %H:%M') WHEN event_id % 5 = 1 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp,
        CASE WHEN event_id % 11 = 0 THEN 'x' ELSE CAST(value AS VARCHAR) END AS price, CAST(user_id % 9 AS VARCHAR) AS lots
    FROM events)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events")
    user, k = F.col("user_id").cast("string"), F.col("event_id")
    code = F.when(k % 7 == 0, F.concat(F.lit("SZ"), F.lpad(user, 6, "0"))).when(k % 7 == 1, F.concat(F.lit("sh60"), F.lpad(user, 4, "0"))).when(k % 7 == 2, F.concat(F.lit("60"), F.lpad(user, 4, "0"), F.lit(".SH"))).otherwise(F.concat(F.lit("bj"), user))
    at = F.when(k % 5 == 0, F.date_format("ts", "yyyy/MM/dd HH:mm")).when(k % 5 == 1, F.lit("n/a")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", code.alias("code"), at.alias("stamp"), F.when(k % 11 == 0, F.lit("x")).otherwise(F.col("value").cast("string")).alias("price"), (F.col("user_id") % 9).cast("string").alias("lots"))


@query(f"""WITH {RAW_SQL}, t AS (
    SELECT event_id, CASE WHEN regexp_matches(upper(code), '^[0-9]{{6}}\\.(SH|SZ)$') THEN upper(code) WHEN regexp_matches(upper(code), '^(SH|SZ)[0-9]{{6}}$') THEN substr(code, 3, 6) || '.' || upper(substr(code, 1, 2)) END AS ts_code,
        coalesce(try_strptime(replace(stamp, '/', '-'), '%Y-%m-%d %H:%M:%S'), try_strptime(replace(stamp, '/', '-'), '%Y-%m-%d %H:%M')) AS ts, TRY_CAST(price AS DOUBLE) AS price, TRY_CAST(lots AS BIGINT) * 100 AS shares FROM raw),
    m AS (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM t),
    u AS (SELECT *, CASE WHEN m BETWEEN 570 AND 690 THEN m - 570 WHEN m BETWEEN 781 AND 900 THEN m - 660 END AS minute_index FROM m)
    SELECT event_id, ts_code, CAST(minute_index AS INT) AS minute_index, price, shares,
        CASE WHEN ts_code IS NULL THEN 'invalid_code' WHEN ts IS NULL THEN 'invalid_timestamp' WHEN minute_index IS NULL THEN 'outside_session' WHEN price IS NULL THEN 'invalid_price' WHEN price <= 0 THEN 'nonpositive_price' WHEN shares = 0 THEN 'zero_volume' END AS reason,
        coalesce(regexp_matches(ts_code, '^((60|68)[0-9]{{4}}\\.SH|(00|30)[0-9]{{4}}\\.SZ)$'), false) AS a_share,
        lower(substr(ts_code, 8, 2)) || '.' || substr(ts_code, 1, 6) AS vendor_code FROM u""")
def lake_normalise_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _raw(spark, sf_dir).select("event_id", scalar.symbol(F.col("code")).alias("ts_code"), scalar.timestamp(F.col("stamp")).alias("ts"), F.col("price").try_cast("double").alias("price"), (F.col("lots").try_cast("bigint") * 100).alias("shares"))
    t = t.withColumn("minute_index", scalar.minute_index(F.col("ts")).cast("int"))
    reason = scalar.first_reason(("invalid_code", F.col("ts_code").isNull()), ("invalid_timestamp", F.col("ts").isNull()), ("outside_session", F.col("minute_index").isNull()), ("invalid_price", F.col("price").isNull()), ("nonpositive_price", F.col("price") <= 0), ("zero_volume", F.col("shares") == 0))
    return t.select("event_id", "ts_code", "minute_index", "price", "shares", reason.alias("reason"), F.coalesce(scalar.is_a_share(F.col("ts_code")), F.lit(False)).alias("a_share"), scalar.vendor_symbol(F.col("ts_code")).alias("vendor_code"))


@query(f"WITH {BARS_SQL} SELECT trade_date, ts_code, open, high, low, close, volume, {s('amount', 2)}, {s('twap * bar_count', 7, 'twap').removesuffix(' AS twap')} / bar_count AS twap, {s('amount', 2).removesuffix(' AS amount')} / volume AS vwap, bar_count, traded_bars FROM bars")
def lake_daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.bars(spark, sf_dir).selectExpr("trade_date", "ts_code", "open", "high", "low", "close", "volume", r("amount", 2), f"{rounded('twap * bar_count', 7)} / bar_count AS twap", f"({rounded('amount', 2)} + 0.0D) / volume AS vwap", "bar_count", "traded_bars")


@query(f"""WITH {BARS_SQL} SELECT trade_date, ts_code, day_index, close, {s('ret', 8)},
    CASE WHEN bar_count IS NULL OR bar_count = 0 THEN 'missing' WHEN bar_count <> 5 THEN 'partial_observation' WHEN volume <= 0 THEN 'complete_zero_volume' ELSE 'complete_trading' END AS status FROM ret""")
def lake_dense_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.returns(panel.densify(adapters.bars(spark, sf_dir)))
    return p.withColumn("status", scalar.day_status(F.col("bar_count"), F.col("volume"), bars=5)).selectExpr("trade_date", "ts_code", "day_index", "close", r("ret", 8), "status")


SNAP_SQL = """mem AS (
    SELECT 'IDX' || CAST(k AS VARCHAR) AS index_code, as_of_date, ts_code FROM (
        SELECT CAST(date_trunc('quarter', trade_date) AS DATE) AS as_of_date, ts_code, sum(amount) AS a FROM bars GROUP BY 1, 2), (SELECT unnest([0, 1]) AS k)
    WHERE CAST(floor(round_even(a * 100, 0) / 100) AS BIGINT) % 3 <> k)"""


def _snapshots(bars: DataFrame) -> DataFrame:
    a = bars.groupBy(F.to_date(F.date_trunc("quarter", "trade_date")).alias("as_of_date"), "ts_code").agg(F.sum("amount").alias("a"))
    a = a.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).where(F.floor(F.rint(F.col("a") * 100) / 100) % 3 != F.col("k"))
    return a.select(F.concat(F.lit("IDX"), "k").alias("index_code"), "as_of_date", "ts_code")


@query(f"""WITH {BARS_SQL}, {SNAP_SQL}
    SELECT b.trade_date, b.ts_code, m.index_code, m.as_of_date, b.close FROM bars AS b JOIN mem AS m ON b.ts_code = m.ts_code
    WHERE m.as_of_date = (SELECT max(x.as_of_date) FROM mem AS x WHERE x.index_code = m.index_code AND x.as_of_date <= b.trade_date)""")
def join_asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = adapters.bars(spark, sf_dir)
    return joins.members_as_of(b.select("trade_date", "ts_code", "close"), _snapshots(b), "index_code")


@query(f"""WITH {BARS_SQL}, fact AS (SELECT ts_code, trade_date AS as_of_date, max(close) AS anchor FROM bars WHERE day(trade_date) = 3 GROUP BY ts_code, trade_date)
    SELECT trade_date, b.ts_code, close, anchor FROM bars AS b ASOF LEFT JOIN fact AS f ON b.ts_code = f.ts_code AND b.trade_date >= f.as_of_date""")
def join_asof_per_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = adapters.bars(spark, sf_dir).select("trade_date", "ts_code", "close")
    facts = b.where(F.dayofmonth("trade_date") == 3).select("ts_code", F.col("trade_date").alias("as_of_date"), F.col("close").alias("anchor"))
    return joins.last_known(b, facts, "anchor").select("trade_date", "ts_code", "close", "anchor")


INTERVAL_SQL = """iv AS (
    SELECT 'N' || CAST(c_nationkey AS VARCHAR) AS index_code, 'C' || CAST(c_custkey AS VARCHAR) AS ts_code, DATE '1995-01-01' + CAST(c_custkey % 700 AS INT) AS effective_from,
        CASE WHEN c_custkey % 3 > 0 THEN DATE '1995-01-01' + CAST(c_custkey % 700 + c_custkey % 97 AS INT) END AS effective_to FROM customer),
    ends AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS as_of_date FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-06-01')"""


@query(f"WITH {INTERVAL_SQL} SELECT DISTINCT index_code, as_of_date, ts_code FROM iv JOIN ends ON effective_from <= as_of_date AND (effective_to IS NULL OR effective_to >= as_of_date)")
def join_intervals_to_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, first = F.col("c_custkey"), F.lit("1995-01-01").cast("date")
    start = F.date_add(first, (k % 700).cast("int"))
    iv = adapters.table(spark, sf_dir, "customer").select(F.concat(F.lit("N"), "c_nationkey").alias("index_code"), F.concat(F.lit("C"), k).alias("ts_code"), start.alias("effective_from"), F.when(k % 3 > 0, F.date_add(first, (k % 700 + k % 97).cast("int"))).alias("effective_to"))
    ends = adapters.table(spark, sf_dir, "orders").where("o_orderdate >= timestamp'1995-01-01' and o_orderdate < timestamp'1997-06-01'").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("as_of_date"))
    return joins.intervals_to_snapshots(iv, ends, "index_code")


@query(f"""WITH {BARS_SQL}, cov AS (SELECT ts_code, min(trade_date) AS a, max(trade_date) AS b FROM bars WHERE ts_code <> 'S3' OR year(trade_date) = 1997 GROUP BY ts_code)
    SELECT c.trade_date, count(cov.ts_code) AS listed, count(bars.ts_code) AS observed FROM cal AS c LEFT JOIN cov ON c.trade_date BETWEEN a AND b LEFT JOIN bars ON bars.trade_date = c.trade_date AND bars.ts_code = cov.ts_code GROUP BY c.trade_date""")
def join_range_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = adapters.bars(spark, sf_dir).select("trade_date", "ts_code")
    cov = b.where("ts_code <> 'S3' or year(trade_date) = 1997").groupBy("ts_code").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    days = panel.calendar(b).select("trade_date")
    listed = days.join(F.broadcast(cov), F.col("trade_date").between(F.col("a"), F.col("b")), "left").select("trade_date", "ts_code")
    seen = b.withColumn("seen", F.lit(1))
    return listed.join(seen, ["trade_date", "ts_code"], "left").groupBy("trade_date").agg(F.count("ts_code").alias("listed"), F.count("seen").alias("observed"))


@query(f"""WITH {BARS_SQL}, one AS (SELECT trade_date, ts_code, close FROM bars WHERE day(trade_date) % 2 = 0), two AS (SELECT trade_date, ts_code, open AS close FROM bars)
    SELECT * FROM one UNION ALL SELECT * FROM two WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.trade_date = two.trade_date AND one.ts_code = two.ts_code)""")
def join_precedence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = adapters.bars(spark, sf_dir)
    return joins.precedence_union(b.where(F.dayofmonth("trade_date") % 2 == 0).select("trade_date", "ts_code", "close"), b.select("trade_date", "ts_code", F.col("open").alias("close")), ["trade_date", "ts_code"])


@query(f"""WITH {BARS_SQL}, x AS (SELECT trade_date, ts_code, volume, high FROM bars WHERE day(trade_date) <> 9), y AS (SELECT trade_date, ts_code, CASE WHEN day(trade_date) = 5 THEN volume + 1 ELSE volume END AS volume, high FROM bars WHERE day(trade_date) <> 8),
    d AS (SELECT coalesce(x.trade_date, y.trade_date) AS trade_date, coalesce(x.ts_code, y.ts_code) AS ts_code, x.ts_code IS NOT NULL AS in_a, y.ts_code IS NOT NULL AS in_b,
        concat_ws(',', CASE WHEN x.volume IS DISTINCT FROM y.volume THEN 'volume' END, CASE WHEN x.high IS DISTINCT FROM y.high THEN 'high' END) AS differ
        FROM x FULL JOIN y ON x.trade_date = y.trade_date AND x.ts_code = y.ts_code)
    SELECT * FROM d WHERE NOT in_a OR NOT in_b OR differ <> ''""")
def join_full_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = adapters.bars(spark, sf_dir).select("trade_date", "ts_code", "volume", "high")
    day = F.dayofmonth("trade_date")
    return joins.differences(b.where(day != 9), b.where(day != 8).withColumn("volume", F.when(day == 5, F.col("volume") + 1).otherwise(F.col("volume"))), ["trade_date", "ts_code"], ["volume", "high"])


@query(f"""WITH {BARS_SQL} SELECT a.ts_code, a.day_index, a.close, b.close AS close_5, c.open AS open_1 FROM dense AS a LEFT JOIN dense AS b ON a.ts_code = b.ts_code AND b.day_index = a.day_index + 5
    LEFT JOIN dense AS c ON a.ts_code = c.ts_code AND c.day_index = a.day_index + 1""")
def join_calendar_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.densify(adapters.bars(spark, sf_dir)).select("ts_code", "day_index", "open", "close")
    p = joins.offset_join(p, {"close@5": 5, "open@1": 1})
    return p.select("ts_code", "day_index", "close", F.col("`close@5`").alias("close_5"), F.col("`open@1`").alias("open_1"))


@query(f"""WITH {BARS_SQL}, {SNAP_SQL} SELECT as_of_date, ts_code, CASE WHEN max(index_code = 'IDX1') THEN 'IDX1' WHEN max(index_code = 'IDX0') THEN 'IDX0' END AS sleeve FROM mem GROUP BY as_of_date, ts_code""")
def join_sleeve_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.sleeve(_snapshots(adapters.bars(spark, sf_dir)), ["IDX1", "IDX0"], "index_code", ["as_of_date", "ts_code"])


@query(f"""WITH {BARS_SQL}, {SNAP_SQL} SELECT as_of_date, ts_code FROM mem WHERE index_code = 'IDX0' EXCEPT SELECT as_of_date, ts_code FROM mem WHERE index_code = 'IDX1'""")
def set_index_overlap_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _snapshots(adapters.bars(spark, sf_dir))
    pick = lambda k: m.where(F.col("index_code") == k).select("as_of_date", "ts_code")
    return pick("IDX0").subtract(pick("IDX1"))


@query(f"""WITH {BARS_SQL} SELECT * FROM (
    SELECT 'daily_primary_key' AS check_name, 'error' AS severity, coalesce(sum(n - 1), 0)::BIGINT AS violations FROM (SELECT count(*) AS n FROM bars GROUP BY trade_date, ts_code HAVING count(*) > 1)
    UNION ALL SELECT 'lineitem_primary_key', 'warning', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'daily_ohlc', 'error', count(*) FILTER (WHERE NOT (least(open, high, low, close) > 0 AND high >= greatest(open, close) AND low <= least(open, close))) FROM bars
    UNION ALL SELECT 'tax_positive', 'warning', count(*) FILTER (WHERE NOT coalesce(l_tax > 0, false)) FROM lineitem), (SELECT 1) WHERE true""".replace("SELECT * FROM (", "SELECT check_name, severity, violations, violations = 0 AS passed FROM (", 1))
def lake_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, items = adapters.bars(spark, sf_dir), adapters.table(spark, sf_dir, "lineitem")
    return quality.report({
        "daily_primary_key": ("error", quality.duplicates(b, ["trade_date", "ts_code"])), "lineitem_primary_key": ("warning", quality.duplicates(items, ["l_orderkey", "l_linenumber"])),
        "daily_ohlc": ("error", quality.failing(b, scalar.ohlc_ok("open", "high", "low", "close"))), "tax_positive": ("warning", quality.failing(items, F.col("l_tax") > 0)),
    })


@query("""SELECT 'orders' AS dataset, count(*) AS n, CAST(min(o_orderdate) AS VARCHAR) AS first, CAST(max(o_orderdate) AS VARCHAR) AS last FROM orders
    UNION ALL SELECT 'lineitem', count(*), CAST(min(l_shipdate) AS VARCHAR), CAST(max(l_shipdate) AS VARCHAR) FROM lineitem""")
def lake_data_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.status({"orders": (adapters.table(spark, sf_dir, "orders"), "o_orderdate"), "lineitem": (adapters.table(spark, sf_dir, "lineitem"), "l_shipdate")})


@query(f"""WITH {BARS_SQL}, f AS (SELECT ts_code, trade_date, 1 + 0.1 * (day(trade_date) % 4) AS adj FROM bars WHERE day(trade_date) <= 4),
    l AS (SELECT ts_code, arg_max(adj, trade_date) AS last FROM f GROUP BY ts_code),
    j AS (SELECT b.trade_date, b.ts_code, close, adj FROM bars AS b ASOF LEFT JOIN f ON b.ts_code = f.ts_code AND b.trade_date >= f.trade_date)
    SELECT trade_date, j.ts_code, {s('adj / last', 8, 'ratio')}, {s('close * adj / last', 4, 'qfq_close')}, {s('close * adj', 4, 'hfq_close')} FROM j JOIN l ON l.ts_code = j.ts_code""")
def view_adjusted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward and backward adjusted prices: factors against the latest factor of each security."""
    b = adapters.bars(spark, sf_dir).select("trade_date", "ts_code", "close")
    day = F.dayofmonth("trade_date")
    f = b.where(day <= 4).select("ts_code", F.col("trade_date").alias("as_of_date"), (1 + F.lit(0.1) * (day % 4)).alias("adj"))
    last = f.groupBy("ts_code").agg(F.max_by("adj", "as_of_date").alias("last"))
    j = joins.last_known(b, f, "adj").join(last, "ts_code")
    return j.selectExpr("trade_date", "ts_code", f"{rounded('adj / last', 8)} AS ratio", f"{rounded('close * adj / last', 4)} AS qfq_close", f"{rounded('close * adj', 4)} AS hfq_close")


@query("""SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 2""")
def window_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return adapters.table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).where("k <= 2").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, 2""")
def scan_json_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events").select("event_type", "user_id", "ts", (F.get_json_object("props", "$.k").cast("bigint") % 10).alias("bucket"))
    return e.groupBy("event_type", "bucket").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""SELECT o_orderkey, o_custkey, CAST(o_totalprice / 1000000 AS DECIMAL(12, 8)) AS target_weight, CAST(o_totalprice AS DECIMAL(18, 2)) AS capital, CAST(floor(o_totalprice / 100) AS BIGINT) * 100 AS lot_shares,
    quarter(o_orderdate) AS quarter, week(o_orderdate) AS iso_week, year(o_orderdate) AS year, upper(left(o_orderpriority, 3)) AS tag, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS padded FROM orders""")
def projection_order_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = adapters.table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000000).cast("decimal(12,8)").alias("target_weight"), F.col("o_totalprice").cast("decimal(18,2)").alias("capital"), (F.floor(F.col("o_totalprice") / 100) * 100).alias("lot_shares"),
        F.quarter("o_orderdate").cast("bigint").alias("quarter"), F.weekofyear("o_orderdate").cast("bigint").alias("iso_week"), F.year("o_orderdate").cast("bigint").alias("year"), F.upper(F.substring("o_orderpriority", 1, 3)).alias("tag"), F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("padded"),
    )


#: Minutes, days and ratios made of the events, with some of each fault that the nine checks look for.
FAULTY_SQL = """ev AS (
    SELECT event_id, event_type AS ts_code, CAST(ts AS DATE) AS trade_date, ts AS datetime, 1 + value AS close, 1 + user_id % 50 AS lot, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS minute_index FROM events),
mi AS (
    SELECT ts_code, trade_date, CASE WHEN event_id % 89 = 0 AND minute_index > 0 THEN CAST(trade_date AS TIMESTAMP) + INTERVAL 12 HOUR ELSE datetime END AS datetime, minute_index, close - 0.5 AS open, CASE WHEN event_id % 83 = 0 THEN close - 0.25 ELSE close + 1 END AS high, close - 0.75 AS low, close,
        lot AS volume_lot, CASE WHEN event_id % 79 = 0 THEN lot ELSE lot * 100 END AS volume_share, CASE WHEN event_id % 73 = 0 THEN -1 ELSE lot END AS amount_cny FROM ev),
sums AS (SELECT ts_code, trade_date, arg_min(open, datetime) AS open, max(high) AS high, min(low) AS low, arg_max(close, datetime) AS close, sum(volume_lot) AS volume_lot, sum(volume_share) AS volume_share, sum(amount_cny) AS amount_cny, count(*) AS bar_count FROM mi GROUP BY 1, 2),
da AS (
    SELECT ts_code, trade_date, open, CASE WHEN day(trade_date) % 9 = 0 THEN low ELSE high END AS high, low, close, CASE WHEN day(trade_date) % 7 = 0 THEN NULL ELSE volume_lot END AS volume_lot, volume_share, amount_cny, bar_count,
        CASE WHEN day(trade_date) % 5 = 0 THEN 'missing' ELSE 'complete_trading' END AS observation_status FROM sums
    UNION ALL SELECT ts_code, trade_date, open, high, low, close, volume_lot, volume_share, amount_cny, bar_count, 'partial_observation' FROM sums WHERE ts_code = 'view' AND day(trade_date) % 11 = 0),
ad AS (
    SELECT ts_code, trade_date, 1 AS snapshot_date, CASE WHEN day(trade_date) % 4 = 0 THEN 'missing_ratio' ELSE 'valid' END AS validation_status FROM sums WHERE day(trade_date) % 13 <> 0
    UNION ALL SELECT ts_code, trade_date, 2, 'valid' FROM sums WHERE day(trade_date) % 8 = 0)"""


def _faulty(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = adapters.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("ts_code"), F.to_date("ts").alias("trade_date"), F.col("ts").alias("datetime"), (1 + F.col("value")).alias("close"), (1 + F.col("user_id") % 50).alias("lot"))
    e = e.withColumn("minute_index", F.row_number().over(Window.partitionBy("ts_code", "trade_date").orderBy("datetime", "event_id")) - 1)
    k, lot, close, day = F.col("event_id"), F.col("lot"), F.col("close"), F.dayofmonth("trade_date")
    mi = e.select(
        "ts_code", "trade_date", F.when((k % 89 == 0) & (F.col("minute_index") > 0), (F.col("trade_date").cast("timestamp") + F.expr("INTERVAL 12 HOURS")).cast(e.schema["datetime"].dataType)).otherwise(F.col("datetime")).alias("datetime"), "minute_index", (close - 0.5).alias("open"),
        F.when(k % 83 == 0, close - 0.25).otherwise(close + 1).alias("high"), (close - 0.75).alias("low"), "close", lot.alias("volume_lot"), F.when(k % 79 == 0, lot).otherwise(lot * 100).alias("volume_share"), F.when(k % 73 == 0, -1).otherwise(lot).alias("amount_cny"),
    )
    sums = mi.groupBy("ts_code", "trade_date").agg(
        F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "datetime").alias("close"), *(F.sum(c).alias(c) for c in ("volume_lot", "volume_share", "amount_cny")), F.count("*").alias("bar_count"),
    )
    da = sums.withColumn("high", F.when(day % 9 == 0, F.col("low")).otherwise(F.col("high"))).withColumn("volume_lot", F.when(day % 7 != 0, F.col("volume_lot"))).withColumn("observation_status", F.when(day % 5 == 0, "missing").otherwise("complete_trading"))
    da = da.unionByName(sums.where((F.col("ts_code") == "view") & (day % 11 == 0)).withColumn("observation_status", F.lit("partial_observation")))
    ad = sums.where(day % 13 != 0).select("ts_code", "trade_date", F.lit(1).alias("snapshot_date"), F.when(day % 4 == 0, "missing_ratio").otherwise("valid").alias("validation_status"))
    return mi, da, ad.unionByName(sums.where(day % 8 == 0).select("ts_code", "trade_date", F.lit(2).alias("snapshot_date"), F.lit("valid").alias("validation_status")))


@query(f"""WITH {FAULTY_SQL}, n AS (
    SELECT 'minute_primary_key' AS check_name, coalesce(sum(n - 1), 0) AS violations FROM (SELECT count(*) AS n FROM mi GROUP BY ts_code, datetime HAVING count(*) > 1)
    UNION ALL SELECT 'minute_ohlc', count(*) FROM mi WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR high < greatest(open, close) OR low > least(open, close)
    UNION ALL SELECT 'minute_session', count(*) FROM mi WHERE minute_index NOT BETWEEN 0 AND 63
    UNION ALL SELECT 'minute_volume_unit', count(*) FROM mi WHERE volume_share <> volume_lot * 100 OR volume_lot < 0 OR amount_cny < 0
    UNION ALL SELECT 'daily_primary_key', coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM da GROUP BY ts_code, trade_date HAVING count(*) > 1)
    UNION ALL SELECT 'daily_ohlc', count(*) FROM da WHERE observation_status <> 'missing' AND (open <= 0 OR high < greatest(open, close) OR low > least(open, close))
    UNION ALL SELECT 'daily_minute_reaggregation', count(*) FROM da AS d LEFT JOIN sums AS r USING (ts_code, trade_date) WHERE observation_status <> 'missing' AND (d.open IS DISTINCT FROM r.open OR d.high IS DISTINCT FROM r.high OR d.low IS DISTINCT FROM r.low
        OR d.close IS DISTINCT FROM r.close OR d.volume_lot IS DISTINCT FROM r.volume_lot OR d.volume_share IS DISTINCT FROM r.volume_share OR d.amount_cny IS DISTINCT FROM r.amount_cny OR d.bar_count IS DISTINCT FROM r.bar_count)
    UNION ALL SELECT 'adjustment_validity', count(*) FROM ad WHERE validation_status <> 'valid'
    UNION ALL SELECT 'adjustment_coverage', count(*) FROM da LEFT JOIN (SELECT * FROM ad QUALIFY row_number() OVER (PARTITION BY ts_code, trade_date ORDER BY snapshot_date DESC) = 1) AS a USING (ts_code, trade_date) WHERE observation_status <> 'missing' AND (validation_status IS NULL OR validation_status <> 'valid'))
    SELECT check_name, CASE WHEN check_name = 'adjustment_coverage' THEN 'warning' ELSE 'error' END AS severity, CAST(violations AS BIGINT) AS violations, violations = 0 AS passed FROM n""")
def lake_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine checks, over tables with faults of each kind; a session has 64 bars here."""
    return quality.lake_checks(*_faulty(spark, sf_dir), bars=64)


@query(f"""WITH {BARS_SQL} SELECT trade_date, ts_code, {s('CASE WHEN dayofweek(trade_date) = 0 THEN close * 2 WHEN month(trade_date) % 2 = 0 THEN close ELSE close + 1 END', 4, 'value')} FROM bars WHERE year(trade_date) < 1996""")
def store_versioned_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days installed in versions: even months first, all others with a bias while days that are there are skipped, Sundays replaced, and a replacement of everything rolled back."""
    b = adapters.bars(spark, sf_dir).where("year(trade_date) < 1996").select("trade_date", "ts_code", F.col("close").alias("value"))
    table = versions.DayTable(spark, shared_folder(spark, "days"))
    table.install(b.where("month(trade_date) % 2 = 0"))
    table.install(b.withColumn("value", F.col("value") + 1))
    good = table.install(b.where("dayofweek(trade_date) = 1").withColumn("value", F.col("value") * 2), "replace")
    table.install(b.withColumn("value", F.lit(0.0)), "replace")
    table.rollback(good.version)
    return table.read().selectExpr("trade_date", "ts_code", r("value", 4))
