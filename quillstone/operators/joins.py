"""Point-in-time joins, interval joins and precedence rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in that order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def snapshot_dates(days: DataFrame, snapshots: DataFrame, group: str, date: str = "trade_date", as_of: str = "as_of_date") -> DataFrame:
    """For each group and session the latest snapshot date that isn't later: (group, date, as_of).

    Snapshots are turned into intervals [as_of, next as_of), so the join needs no rows but those that match. Both
    sides are calendars, bounded by time and by the number of groups.
    """
    s = snapshots.select(group, as_of).distinct()
    s = s.withColumn("_until", F.lead(as_of).over(Window.partitionBy(group).orderBy(as_of)))
    d = days.select(date).distinct()
    return d.join(F.broadcast(s), (F.col(date) >= F.col(as_of)) & (F.col("_until").isNull() | (F.col(date) < F.col("_until")))).select(group, date, as_of)


def members_as_of(rows: DataFrame, snapshots: DataFrame, group: str, code: str = "ts_code", date: str = "trade_date", as_of: str = "as_of_date") -> DataFrame:
    """Rows whose code is in its group's latest snapshot of that session, with the group and the snapshot's date.

    A code that the latest snapshot lacks is no member any more, whatever earlier ones say.
    """
    when = snapshot_dates(rows, snapshots, group, date, as_of)
    members = when.join(snapshots.select(group, as_of, code).distinct(), [group, as_of])
    return rows.join(members, [date, code])


def last_known(rows: DataFrame, facts: DataFrame, value: str, code: str = "ts_code", date: str = "trade_date", as_of: str = "as_of_date") -> DataFrame:
    """Backward as-of join per code: each row with the value of the code's last fact that isn't later (null before the first).

    Facts and rows are sorted together, and the last fact is carried on: one shuffle, no range join. Another fact of
    the same code and date overrides only if it is larger.
    """
    left = rows.withColumn("_t", F.col(date)).withColumn("_side", F.lit(1)).withColumn(value, F.lit(None).cast(facts.schema[value].dataType))
    right = facts.groupBy(code, F.col(as_of).alias("_t")).agg(F.max(value).alias(value)).withColumn("_side", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(code).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_side = 1").drop("_t", "_side")


def intervals_to_snapshots(intervals: DataFrame, dates: DataFrame, group: str, code: str = "ts_code", start: str = "effective_from", end: str = "effective_to", as_of: str = "as_of_date", inclusive: bool = True) -> DataFrame:
    """Members on each date: intervals that have begun and not ended (an open end never ends), each once.

    Only intervals are shuffled: a member's are sorted by their beginning, and each gives the dates that those before it
    haven't given, so that no dates have to be held to be told apart. `dates` is a calendar, and broadcast.
    """
    before = Window.partitionBy(group, code).orderBy(F.col(start), F.col(end).desc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    spans = intervals.where(F.col(start).isNotNull()).select(group, code, F.col(start).alias("_from"), F.col(end).alias("_to"), F.max(end).over(before).alias("_done"), F.coalesce(F.max(F.col(end).isNull()).over(before), F.lit(False)).alias("_open"))
    within = lambda last: (F.col(as_of) <= last) if inclusive else (F.col(as_of) < last)
    live = (F.col("_from") <= F.col(as_of)) & (F.col("_to").isNull() | within(F.col("_to"))) & (F.col("_done").isNull() | ~within(F.col("_done")))
    return spans.where(~F.col("_open")).join(F.broadcast(dates.select(as_of).distinct()), live).select(group, as_of, code)


def precedence_union(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the first, and those of the second whose key the first lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def offset_join(panel: DataFrame, columns: dict[str, int], code: str = "ts_code", order: str = "day_index") -> DataFrame:
    """Columns of later sessions: {"close@5": 5} reads close five sessions on. Joins on the session number, so a gap gives null.

    Each offset is a shift of the key, and all share the partitioning by code and session.
    """
    out = panel
    for name, k in columns.items():
        source = name.split("@")[0]
        later = panel.select(code, (F.col(order) - k).alias(order), F.col(source).alias(name))
        out = out.join(later, [code, order], "left")
    return out


def differences(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys that only one side has, or whose columns differ (nulls are equal): keys, in_a, in_b, and the names that differ."""
    x = a.select(*keys, F.lit(True).alias("in_a"), *(F.col(c).alias(f"a_{c}") for c in columns))
    y = b.select(*keys, F.lit(True).alias("in_b"), *(F.col(c).alias(f"b_{c}") for c in columns))
    both = x.join(y, keys, "full")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in columns)))
    out = both.select(*keys, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"), F.array_join(differ, ",").alias("differ"))
    return out.where("not in_a or not in_b or differ <> ''")


def sleeve(members: DataFrame, priority: list[str], group: str, keys: list[str]) -> DataFrame:
    """One group for each key: the first in the order of priority that it belongs to."""
    chosen = F.lit(None).cast("string")
    for name in reversed(priority):
        chosen = F.when(F.array_contains("_groups", name), F.lit(name)).otherwise(chosen)
    return members.groupBy(*keys).agg(F.collect_set(group).alias("_groups")).select(*keys, chosen.alias("sleeve"))


def step_function(facts: DataFrame, dates: DataFrame, value: str, code: str = "ts_code", effective: str = "effective_from", as_of: str = "as_of_date") -> DataFrame:
    """A code's value on each date: that of its last fact until then, from its first fact on."""
    codes = facts.groupBy(code).agg(F.min(effective).alias("_first"))
    grid = codes.join(F.broadcast(dates.select(as_of).distinct()), F.col(as_of) >= F.col("_first")).drop("_first")
    return last_known(grid, facts, value, code, as_of, effective)
