"""Blocks of sessions with a halo of earlier ones, and recursions as a scan over blocks.

A window over one security's sessions puts them all in one task. Here the unit is a block of consecutive sessions of one
security; a row also goes, as warm-up, to the later blocks whose first window reaches back to it. Windows then run inside
(security, block), warm-up rows are dropped, and what is left doesn't depend on how long the blocks are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sessions before the wanted ones that a recursion begins with, and those that there must be (fixed values). A rate of 1/20, the lowest in use, leaves 0.95^1024 of what came before.
BURN_IN, LEAST_PRIOR = 1024, 254


def blocked(df: DataFrame, size: int, halo: int, order: str = "day_index") -> DataFrame:
    """Each row with `_block`, its own block of `size` sessions, and `_own` true; and again, `_own` false, for each later block that starts at most `halo` sessions after it.

    Sessions are numbered; numbers that lack are gaps, not shorter windows. A projection: no shuffle.
    """
    at = F.col(order)
    first, last = F.floor(at / size), F.floor((at + halo) / size)
    return df.withColumn("_block", F.explode(F.sequence(first.cast("int"), last.cast("int")))).withColumn("_own", F.col("_block") == first)


def own(df: DataFrame) -> DataFrame:
    """Without the warm-up rows."""
    return df.where("_own").drop("_block", "_own")


def burn_in(panel: DataFrame, first: int, last: int, sessions: int = BURN_IN, least: int = LEAST_PRIOR, order: str = "day_index") -> DataFrame:
    """The part of a dense panel that sessions `first` to `last` need, with `_target`: false for the sessions that only warm up.

    ValueError where fewer than `least` sessions come before. The filter is on the session number, so it reaches the scan of a panel that is stored by it.
    """
    begin = panel.agg(F.min(order)).first()[0]
    if begin is None or first - begin < least:
        raise ValueError(f"need {least} prior sessions, found {0 if begin is None else max(0, first - begin)}")
    return panel.where(F.col(order).between(first - sessions, last)).withColumn("_target", F.col(order) >= first)


def _finite(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c), c)


def _average(rate: float) -> Callable[[Column, Column], Column]:
    return lambda s, v: (1 - rate) * s + rate * v


def scan(df: DataFrame, folds: dict[str, tuple[str, str, float]], size: int, code: str = "ts_code", order: str = "day_index", whole_codes: bool = False) -> DataFrame:
    """df with a column for each recursion {name: (kind, input, rate)} along a security's sessions.

    "ema": the first value, then (1 - rate) * state + rate * value; "grow": 1, then state * value for positive values. A
    null or NaN has no result and leaves the state. Each is an affine map of the state, and affine maps compose: within a
    block, windows give every row the map (a, b) from the block's beginning to it; a fold over one row a block (a
    security's blocks, a calendar's length over `size`) gives each block the state it begins with; and the row's state is
    a * state + b. No task has more of a security than a block, and no Python is involved. Columns _block, _a.., _b.. are
    used.

    With whole_codes a security's rows may lie in one task, as windows over all its sessions need them anyway: each row
    then looks back on the maps of its security's earlier blocks, and df is neither computed twice nor shuffled for a join.
    """
    df = df.withColumn("_block", F.floor(F.col(order) / size).cast("int"))
    along = Window.partitionBy(code).orderBy("_block", order)
    if whole_codes:  # this window comes first, so that rows are dealt by security once
        df = df.withColumn("_next", F.lead("_block").over(along))
    w = Window.partitionBy(code, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    maps: dict[str, Column] = {}
    for k, (kind, source, rate) in enumerate(folds.values()):
        x = _finite(F.col(source))
        seen = F.collect_list(x).over(w)
        if kind == "grow":
            maps |= {f"_a{k}": F.aggregate(seen, F.lit(1.0), lambda s, v: F.when(v > 0, s * v).otherwise(s)), f"_b{k}": F.lit(0.0)}
        else:
            maps |= {f"_a{k}": F.pow(F.lit(1 - rate), F.count(x).over(w)), f"_b{k}": F.aggregate(seen, F.lit(0.0), _average(rate))}
    mapped = df.withColumns(maps)
    n = range(len(folds))
    kinds = [(kind, source) for kind, source, _ in folds.values()]
    start = lambda k, first: F.lit(1.0) if kinds[k][0] == "grow" else first
    results = {name: F.when(_finite(F.col(source)).isNotNull(), F.col(f"_a{k}") * F.col(f"_s{k}") + F.col(f"_b{k}")) for k, (name, (_, source, _r)) in enumerate(folds.items())}
    if whole_codes:
        mapped = mapped.withColumns({f"_f{k}": F.first(_finite(F.col(kinds[k][1])), ignorenulls=True).over(w) for k in n})
        ends = F.when(F.col("_next").isNull() | (F.col("_next") != F.col("_block")), F.struct(*(F.col(f"_{x}{k}") for k in n for x in "abf")))
        mapped = mapped.withColumn("_line", F.collect_list(ends).over(along.rowsBetween(Window.unboundedPreceding, -1)))

        def carried(k: int) -> Column:
            """The state that a row's block begins with."""

            def step(s: Column, e: Column) -> Column:
                state = F.coalesce(s, start(k, e[f"_f{k}"]))
                return F.coalesce(e[f"_a{k}"] * state + e[f"_b{k}"], state)

            return F.coalesce(F.aggregate("_line", F.lit(None).cast("double"), step), start(k, F.col(f"_f{k}")))

        mapped = mapped.withColumns({f"_s{k}": carried(k) for k in n})
        return mapped.withColumns(results).drop("_block", "_next", "_line", *(f"_{x}{k}" for k in n for x in "abfs"))
    whole = mapped.groupBy(code, "_block").agg(*(F.struct(F.max_by(f"_a{k}", order).alias("a"), F.max_by(f"_b{k}", order).alias("b"), F.min_by(_finite(F.col(kinds[k][1])), F.when(_finite(F.col(kinds[k][1])).isNotNull(), F.col(order))).alias("first")).alias(f"_m{k}") for k in n))
    line = whole.groupBy(code).agg(F.sort_array(F.collect_list(F.struct("_block", *(f"_m{k}" for k in n)))).alias("_line"))

    def begun(k: int) -> Column:
        """Each block's state at its beginning; of the first that has a value, the value itself, which the map leaves as it is."""

        def step(done: Column, e: Column) -> Column:
            m = e[f"_m{k}"]
            state = F.coalesce(done["s"], start(k, m["first"]))
            after = F.coalesce(m["a"] * state + m["b"], state)
            return F.struct(after.alias("s"), F.array_append(done["l"], F.struct(e["_block"].alias("_block"), state.alias("s"))).alias("l"))

        empty = F.struct(F.lit(None).cast("double").alias("s"), F.array().cast("array<struct<_block:int,s:double>>").alias("l"))
        return F.aggregate("_line", empty, step)["l"]

    states = line.select(code, F.explode(F.arrays_zip(*(begun(k).alias(f"l{k}") for k in n))).alias("_z"))
    states = states.select(code, F.col("_z.l0._block").alias("_block"), *(F.col(f"_z.l{k}.s").alias(f"_s{k}") for k in n))
    out = mapped.join(states, [code, "_block"])
    return out.withColumns(results).drop("_block", *(f"_{x}{k}" for k in n for x in "abs"))


def fill_benchmark(index: DataFrame, panel: DataFrame, code: str = "ts_code", order: str = "day_index") -> DataFrame:
    """index (order, index_open, index_close) on every session of the panel, carried on where it lacks by the mean log return of the panel's securities.

    A session without a close gets the one before times exp(mean of ln(close / close before)) and an open likewise from
    ln(open / close before), over securities with positive prices on both sessions, which must follow each other. Where
    no security has them, the session stays null, and so do the next ones until the index has a close again: nothing is
    carried over such a hole, nor before the first close. Carrying on is a product over the sessions since the last
    close, so it is a window over sessions (one row each, in one task: a calendar's length), not a loop.
    """
    w = Window.partitionBy(code).orderBy(order).rangeBetween(-1, -1)
    prior, ok = F.max("close").over(w), (F.col("close") > 0) & (F.col("open") > 0)
    moves = panel.withColumn("_p", prior).withColumns({"_c": F.when(ok & (F.col("_p") > 0), F.ln(F.col("close") / F.col("_p"))), "_o": F.when(ok & (F.col("_p") > 0), F.ln(F.col("open") / F.col("_p")))})
    days = moves.groupBy(order).agg(F.avg("_c").alias("_c"), F.avg("_o").alias("_o")).join(index.select(order, "index_open", "index_close"), order, "full")
    line = Window.orderBy(order)
    known = F.col("index_close").isNotNull() & ~F.isnan("index_close")
    days = days.withColumn("_run", F.count(F.when(known, 1)).over(line))
    run = Window.partitionBy("_run").orderBy(order)
    log = F.sum(F.when(~known, F.col("_c"))).over(run)
    days = days.withColumns({"_base": F.first("index_close").over(run), "_log": F.coalesce(log, F.lit(0.0)), "_hole": F.max(~known & F.col("_c").isNull()).over(run)})
    close = F.when(~F.col("_hole") & (F.col("_run") > 0) & (F.col("_base") > 0), F.col("_base") * F.exp("_log"))
    days = days.withColumn("_close", F.when(known, F.col("index_close")).otherwise(close))
    opened = F.lag("_close").over(line) * F.exp("_o")
    return days.select(order, F.when(known, F.col("index_open")).when(F.col("_close").isNotNull(), opened).alias("index_open"), F.col("_close").alias("index_close"))
