"""Replay of completed days with the state of each security: rings of earlier sessions, timers, and a first state from a batch.

A day of a security counts once it is complete: rows downloaded before the cut-off hour of their own day are left out.
Days wait in the state until the watermark has passed their cut-off by `hold`, and are then taken in their order, so it
doesn't matter in which order or batch they arrived, and a day that comes again, or after it was taken, changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that this kind of state needs; set it as spark.sql.streaming.stateStore.providerClass.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = "smart double, tail double, curve array<double>"
OUT = "ts_code string, day_index bigint, smart_mean double, tail_z double, curve_rmse double"


@dataclass(frozen=True)
class Rings:
    """Sessions before that smart money's mean takes besides the day's own, and those that must be there; sessions of the baselines, and those that must be there."""

    smart: int = 9
    smart_least: int = 5
    base: int = 20
    base_least: int = 10


def cut_off(date: str = "trade_date", hour: int = 18) -> Column:
    """When a day is complete, in the exchange's time."""
    return F.col(date).cast("timestamp") + F.make_interval(hours=F.lit(hour))


def completed(rows: DataFrame, hour: int = 18) -> DataFrame:
    """Rows of days that were over when they were downloaded (`as_of`), with `closed`, their cut-off in milliseconds."""
    return rows.where(F.col("as_of") >= cut_off(hour=hour)).withColumn("closed", F.unix_millis(cut_off(hour=hour)))


def features(day: int, now: tuple, ring: dict[int, tuple], r: Rings) -> tuple[float | None, float | None, float | None]:
    """A day's features from its own values (smart, tail, curve) and those of earlier days by number; sessions that lack are holes.

    Mean of smart over the window and the day; tail against mean and sample deviation of the earlier ones; root mean
    square of the curve less the mean of the earlier curves (of equal length).
    """
    smart, tail, curve = now
    old = {d: v for d, v in ring.items() if d < day}
    some = [v[0] for d, v in sorted(old.items()) if d >= day - r.smart and v[0] is not None]
    mean = float(np.mean([*some, smart])) if smart is not None and len(some) >= r.smart_least else None
    tails = [v[1] for d, v in sorted(old.items()) if d >= day - r.base and v[1] is not None]
    sd = float(np.std(tails, ddof=1)) if len(tails) >= max(2, r.base_least) else 0.0
    z = (tail - float(np.mean(tails))) / sd if tail is not None and sd > 1e-12 else None
    curves = [v[2] for d, v in sorted(old.items()) if curve is not None and d >= day - r.base and v[2] is not None and len(v[2]) == len(curve)]
    rmse = float(np.sqrt(np.mean((np.asarray(curve) - np.mean(curves, axis=0)) ** 2))) if curve is not None and len(curve) and len(curves) >= r.base_least else None
    return mean, z, rmse


def _tidy(x: object) -> object:
    return None if x is None or (isinstance(x, float) and np.isnan(x)) else [float(v) for v in x] if isinstance(x, list | tuple | np.ndarray) else float(x)


class _Replay(StatefulProcessor):
    def __init__(self, rings: Rings, hold: int):
        self.rings, self.hold = rings, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day_index bigint", f"closed bigint, {DAY}")
        self.ring = handle.getMapState("ring", "day_index bigint", DAY)
        self.last = handle.getValueState("last", "day_index bigint")

    def _taken(self) -> int:
        return int(self.last.get()[0]) if self.last.exists() else -(1 << 60)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        for x in initialState.sort_values("day_index").itertuples():
            self._keep(int(x.day_index), (_tidy(x.smart), _tidy(x.tail), _tidy(x.curve)))

    def _keep(self, day: int, values: tuple) -> None:
        """A day goes into the ring, and those out of reach of the next one go."""
        self.ring.updateValue((day,), values)
        for (d,) in list(self.ring.keys()):
            if d <= day - max(self.rings.smart, self.rings.base):
                self.ring.removeKey((d,))
        self.last.update((day,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for t in rows:
            for x in t.itertuples():
                day = int(x.day_index)
                if day > self._taken() and not self.waiting.containsKey((day,)):
                    self.waiting.updateValue((day,), (int(x.closed), _tidy(x.smart), _tidy(x.tail), _tidy(x.curve)))
                    self.handle.registerTimer(int(x.closed) + self.hold)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        due = sorted((int(d), tuple(v)) for (d,), v in self.waiting.iterator() if int(v[0]) + self.hold <= expiredTimerInfo.getExpiryTimeInMs())
        out = []
        for day, (_, *values) in due:
            values = tuple(_tidy(v) for v in values)
            out.append((key[0], day, *features(day, values, {int(d): tuple(_tidy(x) for x in v) for (d,), v in self.ring.iterator()}, self.rings)))
            self.waiting.removeKey((day,))
            self._keep(day, values)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])

    def close(self) -> None:
        pass


def replay(days: DataFrame, first: DataFrame | None = None, rings: Rings = Rings(), hold: int = 3_600_000, lateness: str = "0 seconds", hour: int = 18) -> DataFrame:
    """ts_code, day_index, smart_mean, tail_z, curve_rmse of each completed day of a stream of ts_code, trade_date, day_index, as_of, smart, tail, curve.

    A day is taken when the watermark (the newest as_of less `lateness`) is `hold` milliseconds past its cut-off. first,
    a batch of ts_code, day_index, smart, tail, curve, fills the rings before the first day: the last one it has counts
    as taken. State per security: the rings' days, and days that wait.
    """
    rows = completed(days, hour).withWatermark("as_of", lateness).groupBy("ts_code")
    begun = None if first is None else first.select("ts_code", F.col("day_index").cast("bigint").alias("day_index"), "smart", "tail", "curve").groupBy("ts_code")
    return rows.transformWithStateInPandas(_Replay(rings, hold), OUT, "append", "EventTime", begun)
