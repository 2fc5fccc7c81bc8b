"""Row-level normalisation: symbols, sessions, timestamps, units, reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bars of a full session: 09:30 is 0, 11:30 is 120, 13:01 is 121, 15:00 is 240.
SESSION_BARS = 241


def symbol(raw: Column) -> Column:
    """`sh600000` or `SZ000001` as `600000.SH`, `000001.SZ`; names in that form stay; others are null."""
    s = F.upper(F.trim(raw))
    return F.when(s.rlike(r"^[0-9]{6}\.(SH|SZ)$"), s).when(s.rlike(r"^(SH|SZ)[0-9]{6}$"), F.concat(F.substring(s, 3, 6), F.lit("."), F.substring(s, 1, 2)))


def vendor_symbol(code: Column) -> Column:
    """`600000.SH` as `sh.600000`."""
    return F.concat(F.lower(F.substring(code, 8, 2)), F.lit("."), F.substring(code, 1, 6))


def is_a_share(code: Column) -> Column:
    """Main boards, STAR and ChiNext; B shares, the Beijing board and funds aren't."""
    return code.rlike(r"^((60|68)[0-9]{4}\.SH|(00|30)[0-9]{4}\.SZ)$")


def timestamp(raw: Column) -> Column:
    """A timestamp of either form, `2026-01-05 09:30:00` or `2026/01/06 09:30`; null if it is neither."""
    s = F.replace(F.trim(raw), F.lit("/"), F.lit("-"))
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm")))


def minute_index(ts: Column) -> Column:
    """The bar's number in its session; null outside of it."""
    m = F.hour(ts) * 60 + F.minute(ts)
    return F.when(m.between(570, 690), m - 570).when(m.between(781, 900), m - 660).cast("smallint")


def ohlc_ok(o: str, h: str, low: str, c: str) -> Column:
    """Positive prices that lie within high and low."""
    return (F.least(o, h, low, c) > 0) & (F.col(h) >= F.greatest(o, c)) & (F.col(low) <= F.least(o, c))


def first_reason(*cases: tuple[str, Column]) -> Column:
    """The name of the first condition that holds (a null one doesn't), else null."""
    out = F.when(F.lit(False), F.lit(""))
    for name, failed in cases:
        out = out.when(F.coalesce(failed, F.lit(False)), F.lit(name))
    return out


def day_status(bar_count: Column, volume: Column, bars: int = SESSION_BARS) -> Column:
    """missing, partial_observation, complete_zero_volume or complete_trading."""
    return F.when(bar_count.isNull() | (bar_count == 0), "missing").when(bar_count != bars, "partial_observation").when(F.coalesce(volume, F.lit(0)) <= 0, "complete_zero_volume").otherwise("complete_trading")


def adjustment_status(raw: Column, factor: Column) -> Column:
    return F.when(factor.isNull() & raw.isNotNull(), "invalid_parse").when(factor.isNull() | (factor <= 0), "invalid_nonpositive").otherwise("valid")
