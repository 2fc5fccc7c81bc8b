"""Queries of the panel primitives and of the daily formulas, a few formulas in each so that they share windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators import blocks
from quillstone.operators import evaluate as ev
from quillstone.plans import adapters, imports
from quillstone.plans.compiler import evaluate, shown, to_sql
from quillstone.plans.formulas import REGISTRY

#: Formulas in one query.
BATCH = 8

PRIMITIVES = {
    "primitives_cross_section": {"xr": "rank(C)", "scl": "scale(C - O, 1)", "scl2": "scale(C - O, 2)", "xx_max": "xmax(C)", "xx_min": "xmin(C)", "cw": "iif(C > O, H, L)", "pw_min": "pmin(C, O)", "pw_max": "pmax(C, delay(C))", "fil": "nz(C - C, 1)"},
    "primitives_shift": {"lag1": "delay(C)", "lag5": "delay(C, 5)", "delta1": "delta(C)", "delta7": "delta(V, 7)", "ratios": "C / delay(C)", "mfirst": "delay(C, 4)", "mcount": "count(C, 20)"},
    "primitives_moments": {"ts_sum": "sum(V, 10)", "sma": "mean(C, 10)", "std": "std(C, 10)", "tmin": "tmin(L, 10)", "tmax": "tmax(H, 10)", "cor": "corr(C, V, 10)", "cor_constant": "corr(C - C, V, 10)", "cov": "cov(C, V, 10)", "beta": "beta(RET, IDX / delay(IDX) - 1, 20)", "slope": "slope(C, 10)"},
    "primitives_order": {"ts_rank": "tsrank(C, 10)", "mrank": "tsrank(C, 10) / 10", "argmax": "argmax(C, 10)", "argmin": "argmin(C, 10)", "decay": "decay(C, 8)", "product": "prod(C / 1000, 5)"},
    "primitives_weights": {"wav": "wav(C, 1, 2, 3, 5)", "fill": "fill(C / delay(C) - 1, 0)", "wav_filled": "wav(fill(RET, 0), 0.5, 0, 1)"},
    "primitives_recursive": {"ema": "ema(C, 13, 2)", "ema_of_gaps": "ema(iif(C > delay(C), C, null), 7, 2)", "fold": "grow(C / delay(C) - 1)"},
}


def _batches() -> dict[str, dict[str, str]]:
    out = dict(PRIMITIVES)
    for family in ("wq", "gtja"):
        ids = [k for k in REGISTRY if k.startswith(family)]
        for i in range(0, len(ids), BATCH):
            some = ids[i : i + BATCH]
            out[f"formulas_{some[0]}_{some[-1][-3:]}"] = {k: REGISTRY[k] for k in some}
    return out


def _query(formulas: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = evaluate(adapters.dense(spark, sf_dir), formulas, decimals=adapters.DECIMALS)
        return df.selectExpr("trade_date", "ts_code", *(f"{shown(k)} AS {k}" for k in formulas))

    return run


def _oracle(formulas: dict[str, str], bars: str = adapters.BARS_SQL, decimals: int | None = adapters.DECIMALS) -> str:
    body = to_sql("panel", formulas, decimals=decimals)
    ctes, _, last = body.rpartition("SELECT trade_date")
    results = ", ".join(f"{shown(k, 'duckdb')} AS {k}" for k in formulas)
    head = f"WITH {bars.strip()}"
    return f"{head}{', ' + ctes.strip() if ctes.strip() else ''}, result AS (SELECT trade_date{last}) SELECT trade_date, ts_code, {results} FROM result"


#: Formulas that look back far, in one step and in several, and recursions of recursions.
FAR = {
    "year": "mean(C, 250)", "far": "C / mean(C, 1024) - 1", "ranks": "mean(rank(delta(C, 20)), 60)", "smooth": "ema(std(C, 20) - delay(std(C, 20), 5), 13, 2)", "twice": "delay(ema(ema(C, 20, 1), 7, 2), 3)",
    "growth": "grow(C / delay(C))", "reach": "corr(C, V, 100)",
}
#: Sessions of a block, and the last sessions of the panel that the burnt-in query shows.
BLOCK, LAST = 200, 40


#: Formulas of the registry in the two foreign notations: methods of a class, and functions of a vector script.
CLASS = """
class Signals:
    def wq002(self):
        '''volume against the move within the day'''
        move = (self.close - self.open) / self.open
        return -correlation(rank(delta(log(self.volume), 2)), rank(move), 6)
    def wq003(self):
        first = rank(self.open)
        traded = rank(self.volume)
        return -correlation(first, traded, 10).copy()
    def wq004(self):
        return -ts_rank(rank(self.low), 9)
    def wq005(self):
        mean = ts_sum(self.vwap, 10) / 10
        away = rank(self.close - self.vwap).abs()
        return rank(self.open - mean) * -away
    def wq006(self):
        return -correlation(self.open, self.volume, 10)
    def wq008(self):
        p = ts_sum(self.open, 5) * ts_sum(self.returns, 5)
        p = p - delay(p, 10)
        return -rank(p)
    def wq011(self):
        gap = self.vwap - self.close
        spread = rank(ts_max(gap, 3)) + rank(ts_min(gap, 3))
        return spread * rank(delta(self.volume, 3))
    def wq012(self):
        return sign(delta(self.volume, 1)) * -delta(self.close, 1)
"""
SCRIPT = r"""
def gtja001(open, close, vol) {
    // braces { in comments don't count
    traded = rowRank(deltas(log(vol), 1));
    return -mcorr(traded, rowRank((close - open) \ open), 6);
}
def gtja002(close, low, high) { place = (close - low - (high - close)) \ (high - low); return -deltas(place, 1) }
def gtja003(close, low, high) {
    p = move(close, 1);
    far = iif(close > p, min(low, p), max(high, p));
    return msum(iif(close == p, 0, close - far), 6);
}
def gtja004(close, vol) {
    m = mavg(close, 8); s = mstd(close, 8); now = mavg(close, 2);
    busy = vol \ mavg(vol, 20);
    return iif(m + s < now, -1, iif(now < m - s || busy >= 1, 1, -1));
}
def gtja005(vol, high) { return -mmax(mcorr(mrank(vol, false, 5), mrank(high, false, 5), 5), 3); }
def gtja006(open, high) { mix = open * 0.85 + high * 0.15; return -rowRank(sign(deltas(mix, 4))); }
def gtja007(vwap, close, vol) { gap = vwap - close; return rowRank(mmax(gap, 3)) + rowRank(mmin(gap, 3)) * rowRank(deltas(vol, 3)); }
def gtja008(high, low, vwap) { mix = (high + low) * 0.1 + vwap * 0.8; return rowRank(-deltas(mix, 4)); }
def gtja011(close, low, high, vol) { place = (close - low - (high - close)) \ (high - low); return msum(place * vol, 6); }
def gtja189(close) { away = abs(close - mavg(close, 6)); return mavg(away, 6); }
def weights(close) { return mavg(close, 1..4 * 0.5, 4); }
def parts(close) { return mrank(close, true, 10) + mfirst(close, 3) \ close - ratios(close); }
"""
#: What they are in the formula language, for the SQL.
NATIVE = ("wq002", "wq003", "wq004", "wq005", "wq006", "wq008", "wq011", "wq012", "gtja001", "gtja002", "gtja003", "gtja004", "gtja005", "gtja006", "gtja007", "gtja008", "gtja011", "gtja189")
IMPORTED = {k: REGISTRY[k] for k in NATIVE} | {"weights": "wav(C, 0.5, 1, 1.5, 2)", "parts": "tsrank(C, 10) / 10 + delay(C, 2) / C - C / delay(C)"}


def formulas_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty formulas from foreign texts; the SQL has them from the registry."""
    formulas = imports.methods(CLASS) | imports.scripts(SCRIPT)
    df = evaluate(adapters.dense(spark, sf_dir), formulas, decimals=adapters.DECIMALS)
    return df.selectExpr("trade_date", "ts_code", *(f"{shown(k)} AS {k}" for k in formulas))


def formulas_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of up to 1024 sessions in blocks of 200."""
    df = evaluate(adapters.dense(spark, sf_dir), FAR, block=BLOCK, decimals=adapters.DECIMALS)
    return df.selectExpr("trade_date", "ts_code", *(f"{shown(k)} AS {k}" for k in FAR))


def formulas_burnt_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's last sessions, from those and 1024 before them; recursions begin there, and have forgotten it by then."""
    panel = adapters.dense(spark, sf_dir)
    last = panel.agg({"day_index": "max"}).first()[0]
    some = {k: FAR[k] for k in ("year", "smooth", "twice", "reach")}
    df = evaluate(blocks.burn_in(panel, last - LAST + 1, last), some, ("trade_date", "ts_code", "_target"), block=BLOCK, decimals=adapters.DECIMALS)
    return df.where("_target").selectExpr("trade_date", "ts_code", *(f"{shown(k)} AS {k}" for k in some))


def panel_benchmark_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest open and the highest close as an index, as if two sessions of five and all from the 2000th on lacked, carried on by the securities' returns."""
    panel = adapters.panel.densify(adapters.bars(spark, sf_dir))
    days = panel.groupBy("day_index").agg(F.min("open").alias("index_open"), F.max("close").alias("index_close"))
    lacks = (F.col("day_index") % 5 >= 3) | (F.col("day_index") >= 2000)
    index = days.select("day_index", *(F.when(~lacks, F.col(k)).alias(k) for k in ("index_open", "index_close")))
    return blocks.fill_benchmark(index, panel).selectExpr("day_index", *(f"{shown(k)} AS {k}" for k in ("index_open", "index_close")))


_FILL_SQL = f"""WITH RECURSIVE {adapters.BARS_SQL.strip()},
    mv AS (SELECT day_index, avg(ln(close / p)) FILTER (WHERE close > 0 AND open > 0 AND p > 0) AS c, avg(ln(open / p)) FILTER (WHERE close > 0 AND open > 0 AND p > 0) AS o
        FROM (SELECT *, lag(close) OVER (PARTITION BY ts_code ORDER BY day_index) AS p FROM dense) GROUP BY day_index),
    ix AS MATERIALIZED (SELECT day_index, CASE WHEN day_index % 5 < 3 AND day_index < 2000 THEN min(open) END AS io, CASE WHEN day_index % 5 < 3 AND day_index < 2000 THEN max(close) END AS ic, any_value(mv.c) AS c, any_value(mv.o) AS o FROM dense JOIN mv USING (day_index) GROUP BY day_index),
    line AS (
        SELECT 0 AS day_index, CAST(NULL AS DOUBLE) AS index_open, CAST(NULL AS DOUBLE) AS index_close
        UNION ALL
        SELECT ix.day_index, CASE WHEN ic IS NOT NULL THEN io ELSE index_close * exp(o) END, coalesce(ic, index_close * exp(c)) FROM line JOIN ix ON ix.day_index = line.day_index + 1)
    SELECT day_index, {shown('index_open', 'duckdb')} AS index_open, {shown('index_close', 'duckdb')} AS index_close FROM line WHERE day_index > 0"""


#: Formulas over the wide panel, whose cross-sections have as many securities as there are suppliers. They look back a few sessions, as a month is one here. The panel isn't rounded, and windows are only where formulas rank what they give, as such ranks have ties.
WIDE = {
    "wide_primitives": {k: v for name in ("primitives_cross_section", "primitives_moments", "primitives_order") for k, v in PRIMITIVES[name].items() if k not in ("cor_constant", "fil")},
    "wide_formulas_wq": {k: REGISTRY[k] for k in ("wq002", "wq003", "wq004", "wq005", "wq006", "wq008", "wq011", "wq012", "wq013", "wq015", "wq016", "wq033", "wq053", "wq101")},
    "wide_formulas_gtja": {k: REGISTRY[k] for k in ("gtja001", "gtja002", "gtja005", "gtja007", "gtja008", "gtja009", "gtja011", "gtja013", "gtja014", "gtja018", "gtja020", "gtja024", "gtja031", "gtja189")},
}


def _decimals(name: str) -> int | None:
    return None if name == "wide_primitives" else adapters.DECIMALS


def _wide(name: str, formulas: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: evaluate(adapters.wide(spark, sf_dir), formulas, decimals=_decimals(name)).selectExpr("trade_date", "ts_code", *(f"{shown(k)} AS {k}" for k in formulas))


def wide_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten groups a session by reversal, and what each earns in the next one."""
    p = evaluate(adapters.wide(spark, sf_dir), {"f": "-RET"}, ("trade_date", "ts_code", "day_index", "RET"))
    p = p.withColumn("next", F.lead("RET").over(Window.partitionBy("ts_code").orderBy("day_index"))).withColumn("f", F.round("f", 9))
    return ev.grouped_returns(p, "f", "next", ["trade_date"]).selectExpr("trade_date", "grp", f"{shown('mean_label')} AS mean_label", "n")


_DECILES_SQL = f"""WITH {adapters.WIDE_SQL.strip()}, n AS (SELECT trade_date, ts_code, round(-RET, 9) AS f, lead(RET) OVER (PARTITION BY ts_code ORDER BY day_index) AS nxt FROM panel),
    g AS (SELECT *, ntile(10) OVER (PARTITION BY trade_date ORDER BY f, ts_code) AS grp FROM n WHERE f IS NOT NULL AND nxt IS NOT NULL),
    m AS (SELECT trade_date, grp, avg(nxt) AS mean_label, count(*) AS n FROM g GROUP BY 1, 2)
    SELECT trade_date, CAST(grp AS INT) AS grp, {shown('mean_label', 'duckdb')} AS mean_label, n FROM m"""


def _burnt_in_sql() -> str:
    body = _oracle({k: FAR[k] for k in ("year", "smooth", "twice", "reach")})
    return f"SELECT * FROM ({body}) WHERE trade_date IN (SELECT DISTINCT CAST(l_shipdate AS DATE) FROM lineitem ORDER BY 1 DESC LIMIT {LAST})"


QUERIES = {name: _query(f) for name, f in _batches().items()} | {f.__name__: f for f in (formulas_imported, formulas_blocked, formulas_burnt_in, panel_benchmark_fill, wide_deciles)} | {name: _wide(name, f) for name, f in WIDE.items()}
ORACLES = {name: _oracle(f) for name, f in _batches().items()} | {"formulas_imported": _oracle(IMPORTED), "formulas_blocked": _oracle(FAR), "formulas_burnt_in": _burnt_in_sql(), "panel_benchmark_fill": _FILL_SQL, "wide_deciles": _DECILES_SQL} | {name: _oracle(f, adapters.WIDE_SQL, _decimals(name)) for name, f in WIDE.items()}
