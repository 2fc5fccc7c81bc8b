"""Streams: one-minute bars from ticks with late data bounded, duplicates dropped, and a running z-score per security."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def minute_bars(ticks: DataFrame, lateness: str = "2 minutes", width: str = "1 minute") -> DataFrame:
    """ts_code, ts, price, quantity as bars of the given width; ticks later than that behind the newest are dropped."""
    t = ticks.withWatermark("ts", lateness)
    key = F.struct("ts", "tick_id")
    return t.groupBy(F.window("ts", width), "ts_code").agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"),
        F.sum("quantity").alias("volume"), F.sum(F.col("price") * F.col("quantity")).alias("amount"), F.count("*").alias("ticks"),
    ).select("ts_code", F.col("window.start").alias("datetime"), "open", "high", "low", "close", "volume", "amount", "ticks")


def distinct_ticks(ticks: DataFrame, lateness: str = "2 minutes") -> DataFrame:
    """Each tick_id once, as long as its copies arrive within the lateness; state is bounded by that."""
    return ticks.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["tick_id"])


def session_bars(ticks: DataFrame, gap: str = "30 minutes", lateness: str = "2 minutes") -> DataFrame:
    """Bursts of activity per security, ended by a gap."""
    t = ticks.withWatermark("ts", lateness)
    return t.groupBy(F.session_window("ts", gap), "ts_code").agg(F.count("*").alias("ticks"), F.sum("quantity").alias("volume")).select("ts_code", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "ticks", "volume")


def running_z(values: DataFrame, window: int = 20, least: int = 10) -> DataFrame:
    """z of each value against the up to `window` values before it of the same security, in order of day_index.

    State is the last `window` values; a day that comes again or too late gives no row and leaves the state as it is.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ring = state.get if state.exists else (-1, [])
        ring = list(ring)
        rows = []
        for _, x in pd.concat(list(batches)).sort_values("day_index").iterrows():
            day, v = int(x["day_index"]), float(x["value"])
            if day <= last:
                continue
            sd = float(np.std(ring, ddof=1)) if len(ring) >= max(least, 2) else 0.0
            rows.append((key[0], day, v, (v - float(np.mean(ring))) / sd if sd > 1e-12 else None))
            ring, last = [*ring, v][-window:], day
        state.update((last, ring))
        yield pd.DataFrame(rows, columns=["ts_code", "day_index", "value", "z"])

    return values.groupBy("ts_code").applyInPandasWithState(update, "ts_code string, day_index bigint, value double, z double", "last bigint, ring array<double>", "append", GroupStateTimeout.NoTimeout)
