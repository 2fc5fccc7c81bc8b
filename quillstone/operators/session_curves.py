"""Features of sessions against earlier sessions' curves: smart money pooled over sessions, spectra of what the usual day doesn't explain."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators import blocks
from quillstone.operators.minute import DAY

#: Frequencies of a spectrum, in cycles a session, and the band whose share is a feature (fixed values).
FREQUENCIES, BAND = range(1, 31), range(5, 21)
#: Bytes of curves in one batch for Python (a batch ends with the row that reaches them).
BATCH_BYTES = 16 << 20


def volume_curves(bars: DataFrame, power: float) -> DataFrame:
    """One row a stock-day: its bars with volume in descending order of |ln(close / open)| / volume^power (ties by minute), as arrays key, volume, amount."""
    key = F.abs(F.ln(F.col("close") / F.col("open"))) / F.pow("volume", F.lit(power))
    traded = bars.withColumn("_t", F.when(F.col("volume") > 0, F.struct((-key).alias("k"), "minute_index", F.col("volume").cast("double").alias("v"), F.col("amount").cast("double").alias("a"))))
    day = traded.groupBy(*DAY).agg(F.sort_array(F.collect_list("_t")).alias("_b"))
    return day.select(*DAY, F.transform("_b", lambda x: -x["k"]).alias("key"), F.col("_b.v").alias("volume"), F.col("_b.a").alias("amount"))


def _pooled(share: float, pool: int, least: int, reach: int, name: str):
    """For applyInArrow: merges the curves of a session and those before it, which come in order; the block's own sessions only are returned. Of a block no more than `pool` curves and one batch are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque[tuple[int, list[np.ndarray]]] = deque(maxlen=pool)
        for row in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            day = row.column("day_index")[0].as_py()
            # copies, as a view would keep its whole batch
            held.append((day, [np.array(row.column(c).flatten(), float) for c in ("key", "volume", "amount")]))
            if not row.column("_own")[0].as_py():
                continue
            before = [x for d, x in reversed(held) if d >= day - reach]  # the session itself first
            ratio = _ratio([*before[1:], before[0]], share) if len(before) > least else None
            yield pa.RecordBatch.from_arrays([*(row.column(c) for c in DAY), pa.array([ratio], pa.float64())], [*DAY, name])

    return run


def _ratio(curves: list[list[np.ndarray]], share: float) -> float | None:
    """Price of the bars that hold `share` of the volume against all. Curves are sorted already, the latest earlier session first and the session itself last: a stable sort merges them."""
    key, v, a = (np.concatenate(x) for x in zip(*curves, strict=True))
    order = np.argsort(-key, kind="stable")
    v, a = v[order], a[order]
    whole, money = v.sum(), a.sum()
    if not len(v) or whole <= 0 or money <= 0:
        return None
    cum = np.cumsum(v)
    last = min(int(np.searchsorted(cum, share * whole)), len(v) - 1)  # the bar that reaches the share is one of them
    return float(a[: last + 1].sum() / cum[last] / (money / whole))


def pooled_smart_ratio(bars: DataFrame, name: str = "mf_smart_q_pooled_b025_w10_p20", power: float = 0.25, share: float = 0.2, pool: int = 10, least: int = 5, reach: int = 40, block: int = 60) -> DataFrame:
    """Price of the bars with the most movement for their volume against all, both weighted by volume, over the session and the up to pool - 1 observed ones before it.

    Bars are pooled and taken in descending order of |ln(close / open)| / volume^power until they hold `share` of the
    pool's volume, the one that reaches it included. Ties go to the later of the earlier sessions, the session's own
    last, then by minute. Needs `least` earlier sessions within the `reach` calendar sessions before. Each stock-day's
    bars are sorted once, and blocks of sessions with a halo of `reach` merge the sorted curves, so a bar is sent
    (block + reach) / block times, not `pool` times, and Python holds the curves of one pool.
    """
    bars.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    curves = blocks.blocked(volume_curves(bars, power), block, reach).repartition("ts_code", "_block").sortWithinPartitions("ts_code", "_block", "day_index")
    types = dict(curves.dtypes)
    return curves.groupBy("ts_code", "_block").applyInArrow(_pooled(share, pool, least, reach, name), ", ".join([*(f"{k} {types[k]}" for k in DAY), f"{name} double"]))


def _spectrum(names: tuple[str, str]):
    """For mapInArrow: power at the frequencies for a batch of sessions, as one product with the cosines and sines of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waves: dict[int, np.ndarray] = {}
        for batch in batches:
            z = batch.column("z").to_pylist()
            peak, band = np.full(len(z), np.nan), np.full(len(z), np.nan)
            for n in {len(x) for x in z if x}:
                if n not in waves:
                    angle = 2 * np.pi * np.outer(np.arange(n), FREQUENCIES) / n
                    waves[n] = np.concatenate([np.cos(angle), np.sin(angle)], axis=1)
                at = [i for i, x in enumerate(z) if len(x) == n]
                x = np.array([z[i] for i in at])
                both = (x - x.mean(axis=1, keepdims=True)) @ waves[n]
                power = both[:, : len(FREQUENCIES)] ** 2 + both[:, len(FREQUENCIES) :] ** 2
                total = power.sum(axis=1)
                ok = np.where(total > 1e-12, total, np.nan)
                peak[at], band[at] = power.max(axis=1) / ok, power[:, BAND.start - 1 : BAND.stop - 1].sum(axis=1) / ok
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in DAY), *(pa.array(x, pa.float64(), from_pandas=True) for x in (peak, band))], [*DAY, *names])

    return run


def periodicity(bars: DataFrame, before: int = 20, least: int = 10, names: tuple[str, str] = ("mf_amount_periodicity_peak_share_w20", "mf_amount_periodicity_band_power_w20")) -> DataFrame:
    """Spectrum of the session's amount shares less the mean curve of the security's observed sessions before: the largest frequency's part of the power, and the band's.

    Frequencies are 1 to 30 cycles a session, the band 5 to 20. The curve takes up to `before` observed sessions, those
    with an amount counting, and a session has values where every bar has `least` of them and the power isn't 0.
    """
    day = Window.partitionBy("ts_code", "trade_date")
    share = bars.withColumn("_s", F.when(F.sum("amount").over(day) > 0, F.col("amount") / F.sum("amount").over(day)))
    w = Window.partitionBy("ts_code", "minute_index").orderBy("day_index").rowsBetween(-before, -1)
    z = F.when(F.count("_s").over(w) >= least, F.col("_s") - F.avg("_s").over(w))
    curves = share.withColumn("_z", z).groupBy(*DAY).agg(F.count("_z").alias("_n"), F.count("*").alias("_all"), F.sort_array(F.collect_list(F.when(F.col("_z").isNotNull(), F.struct("minute_index", "_z")))).alias("_c"))
    curves = curves.select(*DAY, F.when(F.col("_n") == F.col("_all"), F.col("_c._z")).otherwise(F.array().cast("array<double>")).alias("z"))
    types = dict(curves.dtypes)
    return curves.mapInArrow(_spectrum(names), ", ".join([*(f"{k} {types[k]}" for k in DAY), *(f"{k} double" for k in names)]))
