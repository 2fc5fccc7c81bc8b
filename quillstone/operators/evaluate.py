"""Factor evaluation: ranks, information coefficients, groups, metrics, standardisation, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal_rank(column: str, by: list[str], tie: str = "ts_code") -> Column:
    """1, 2, ... in each cross-section; ties go by the code."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.col(column).asc_nulls_last(), tie))


def average_rank(column: str, by: list[str]) -> Column:
    """Ranks in which ties share their mean."""
    w = Window.partitionBy(*by).orderBy(F.col(column).asc_nulls_last())
    ties = F.count(column).over(Window.partitionBy(*by, column))
    return F.when(F.col(column).isNotNull(), F.rank().over(w) + (ties - 1) / 2)


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; null where either side is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 1e-12) & (sy > 1e-12), F.covar_pop(x, y) / (sx * sy))


def information_coefficients(df: DataFrame, factor: str, label: str, by: list[str]) -> DataFrame:
    """Per cross-section: pairs, Pearson IC, and rank ICs with ordinal and with average-tie ranks."""
    pairs = df.where(F.col(factor).isNotNull() & F.col(label).isNotNull())
    pairs = pairs.withColumn("_of", ordinal_rank(factor, by)).withColumn("_ol", ordinal_rank(label, by)).withColumn("_af", average_rank(factor, by)).withColumn("_al", average_rank(label, by))
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), safe_corr(factor, label).alias("ic"), safe_corr("_of", "_ol").alias("rank_ic"), safe_corr("_af", "_al").alias("rank_ic_avg"))


def summarise(ics: DataFrame, by: list[str], column: str = "rank_ic", annual: bool = True) -> DataFrame:
    """Mean, deviation, information ratio (per year of 252 sessions, or plain), share of positive ones."""
    sd = F.stddev_samp(column)
    ratio = F.when(sd > 1e-12, F.avg(column) / sd) * F.lit(252**0.5 if annual else 1.0)
    return ics.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), sd.alias("sd"), ratio.alias("icir"), F.avg(F.when(F.col(column).isNotNull(), (F.col(column) > 0).cast("double"))).alias("positive"))


def grouped_returns(df: DataFrame, factor: str, label: str, by: list[str], groups: int = 10) -> DataFrame:
    """Mean label of each quantile group (equal counts, ties by code) per cross-section."""
    w = Window.partitionBy(*by).orderBy(factor, "ts_code")
    return df.where(F.col(factor).isNotNull() & F.col(label).isNotNull()).withColumn("grp", F.ntile(groups).over(w)).groupBy(*by, "grp").agg(F.avg(label).alias("mean_label"), F.count("*").alias("n"))


def nearest_quantile(column: str, q: float) -> Column:
    """The order statistic at round((n - 1) q), as an aggregate over a cross-section of bounded size."""
    values = F.sort_array(F.collect_list(column))
    return F.element_at(values, (F.floor((F.count(column) - 1) * F.lit(q) + 0.5) + 1).cast("int"))


def winsorise(df: DataFrame, columns: list[str], by: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip each column to its cross-section's order statistics."""
    bounds = df.groupBy(*by).agg(*(F.when(F.count(c) > 0, nearest_quantile(c, q)).alias(f"_{k}_{c}") for c in columns for k, q in (("lo", low), ("hi", high))))
    clip = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(c, f"_lo_{c}"), f"_hi_{c}")).alias(c)
    return df.join(bounds, by).select(*(clip(c) if c in columns else F.col(c) for c in df.columns))


def z_score(column: str, by: list[str], sample: bool = True) -> Column:
    """Standardised within the cross-section; null where it hardly varies."""
    w = Window.partitionBy(*by)
    sd = (F.stddev_samp if sample else F.stddev_pop)(column).over(w)
    return F.when(sd > 1e-12, (F.col(column) - F.avg(column).over(w)) / sd)


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "factor_id", value: str = "factor_value") -> DataFrame:
    """One row per key and column, without nulls."""
    return df.unpivot(keys, columns, name, value).where(F.col(value).isNotNull())


def pivot(df: DataFrame, keys: list[str], ids: list[str], name: str = "factor_id", value: str = "factor_value") -> DataFrame:
    """One column per id, from a long table with unique keys; ids are given, so no pass looks for them."""
    return df.groupBy(*keys).pivot(name, ids).agg(F.first(value))


def forward_returns(panel: DataFrame, horizons: list[int], enter: str, leave: str, lag: int) -> DataFrame:
    """ret_h: from the price `enter` at T + lag to `leave` at T + lag + h, by session numbers; null unless both ends trade."""
    w = Window.partitionBy("ts_code").orderBy("day_index")
    # the panel is dense, so a shift of rows is a shift of sessions
    start = F.when(F.lead("tradable", lag).over(w) if lag else F.col("tradable"), F.lead(enter, lag).over(w) if lag else F.col(enter))
    out = panel
    for h in horizons:
        end = F.when(F.lead("tradable", lag + h).over(w), F.lead(leave, lag + h).over(w))
        out = out.withColumn(f"ret_{h}", F.try_divide(end, start) - 1)
    return out


def top_overlap(df: DataFrame, score: str, k: int) -> DataFrame:
    """Per session: how many of its top k are in the top k of the session before."""
    w = Window.partitionBy("trade_date").orderBy(F.col(score).desc_nulls_last(), "ts_code")
    top = df.where(F.col(score).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("day_index", "ts_code")
    before = top.select((F.col("day_index") + 1).alias("day_index"), "ts_code", F.lit(1).alias("_was"))
    return top.join(before, ["day_index", "ts_code"], "left").groupBy("day_index").agg(F.count("*").alias("k"), F.count("_was").alias("stayed"))


def diagnostics(df: DataFrame, factor: str, universe: int | None = None) -> DataFrame:
    """Coverage, quantiles, clipped mean and mean absolute change of a factor over all rows."""
    w = Window.partitionBy("ts_code").orderBy("day_index")
    t = df.withColumn("_d", F.abs(F.col(factor) - F.lag(factor).over(w)))
    q = t.agg(F.count("*").alias("rows"), F.count(factor).alias("present"), F.expr(f"percentile({factor}, 0.01)").alias("p01"), F.expr(f"percentile({factor}, 0.99)").alias("p99"), F.avg("_d").alias("mean_abs_change"))
    clipped = t.join(F.broadcast(q.select("p01", "p99"))).agg(F.avg(F.when(F.col(factor).isNotNull(), F.least(F.greatest(factor, "p01"), "p99"))).alias("clipped_mean"))
    return q.join(F.broadcast(clipped)).withColumn("coverage", F.try_divide(F.col("present").cast("double"), "rows"))


def weighted_icir(ics: DataFrame, by: list[str], half_life: float, column: str = "rank_ic") -> DataFrame:
    """ICIR with weights that halve every half_life sessions back from the last."""
    age = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("day_index"))) - 1
    t = ics.where(F.col(column).isNotNull()).withColumn("_w", F.pow(F.lit(0.5), age / F.lit(half_life)))
    m = F.sum(F.col("_w") * F.col(column)) / F.sum("_w")
    second = F.sum(F.col("_w") * F.col(column) * F.col(column)) / F.sum("_w")
    var = second - m * m
    return t.groupBy(*by).agg(m.alias("mean"), F.when(var > 1e-12, m / F.sqrt(var)).alias("icir"))


def concentration(df: DataFrame, weight: str, by: list[str], top: int = 10) -> DataFrame:
    """Herfindahl index, effective number, largest and top weights."""
    w = F.sort_array(F.collect_list(weight), asc=False)
    return df.groupBy(*by).agg(F.sum(F.col(weight) * F.col(weight)).alias("hhi"), F.max(weight).alias("largest"), F.aggregate(F.slice(w, 1, top), F.lit(0.0), lambda a, x: a + x).alias("top_weight"), F.count("*").alias("n")).withColumn("effective_n", F.try_divide(F.lit(1.0), "hhi"))


def sequences(panel: DataFrame, columns: list[str], length: int) -> DataFrame:
    """Samples of `length` consecutive sessions that all have a row: values (nulls as 0) and flags of missing ones, oldest first."""
    w = Window.partitionBy("ts_code").orderBy("day_index").rowsBetween(-(length - 1), 0)
    out = panel.withColumn("_first", F.min("day_index").over(w)).withColumn("_n", F.count("*").over(w))
    for c in columns:
        out = out.withColumn(f"{c}_values", F.collect_list(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).over(w)).withColumn(f"{c}_missing", F.collect_list(F.col(c).isNull().cast("int")).over(w))
    return out.where((F.col("_n") == length) & (F.col("day_index") - F.col("_first") == length - 1)).drop("_first", "_n")
