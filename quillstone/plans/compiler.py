"""Formula compiler: text -> stages of SQL expressions over a dense panel, for Spark and, as a check, for DuckDB.

A formula is parsed once. Every call that needs a window becomes a column of its own, computed in the stage after the
last of its inputs; equal calls, also of different formulas, share one column. All windows of a stage over time share
one partitioning (by security) and all over the cross-section another (by session), so a stage costs two shuffles at
most, however many formulas are compiled together. On request results of windows are rounded to fixed decimals: ranks
and comparisons of computed values then don't hang on the last bits of a sum, which depend on its order. The checks
ask for that; by default nothing is rounded.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import blocks

BASE = ("O", "H", "L", "C", "V", "VWAP", "RET", "IDX")
#: The part of its mean square under which a series' variance counts as none.
CONSTANT = 1e-18
ELEMENTWISE = {"abs": 1, "log": 1, "sign": 1, "sqrt": 1, "pmin": 2, "pmax": 2, "iif": 3, "nz": 2, "fill": 2}
CROSS = {"rank": 1, "scale": 2, "xmax": 1, "xmin": 1}
TIME = {"delay": 2, "delta": 2, "sum": 2, "mean": 2, "std": 2, "tmin": 2, "tmax": 2, "tsrank": 2, "corr": 3, "cov": 3, "argmax": 2, "argmin": 2, "decay": 2, "prod": 2, "slope": 2, "beta": 3, "count": 2}
FOLDS = {"ema": 3, "grow": 1}
#: Sessions of a block in the scan of recursions, where the caller asks for no blocks of windows.
SCAN = 64
DEFAULTS = {"delay": (1,), "delta": (1,), "scale": (1,)}


def rounded(sql: str, decimals: int, dialect: str = "spark") -> str:
    unit = f"1e{decimals}D" if dialect == "spark" else f"CAST(1e{decimals} AS DOUBLE)"
    return f"({'rint' if dialect == 'spark' else 'round_even'}(({sql}) * {unit}{'' if dialect == 'spark' else ', 0'}) / {unit})"


def shown(sql: str, dialect: str = "spark") -> str:
    """A result to five to nine digits: more would show the order in which an engine added up or multiplied."""
    big = f"CAST(format_string('%.8e', {sql}) AS DOUBLE)" if dialect == "spark" else f"CAST(printf('%.8e', {sql}) AS DOUBLE)"
    return f"CASE WHEN {sql} IS NULL THEN NULL WHEN abs({sql}) < 1000 THEN {rounded(sql, 5, dialect)} + 0.0 WHEN abs({sql}) < 1e5 THEN {rounded(sql, 4, dialect)} + 0.0 WHEN abs({sql}) < 1e9 THEN {rounded(sql, 0, dialect)} + 0.0 ELSE {big} END".replace("0.0", "0.0D" if dialect == "spark" else "CAST(0 AS DOUBLE)")


class FormulaError(ValueError):
    """A formula that the language doesn't have."""


@dataclass
class Stage:
    """Columns of one level: plain ones first, then windows over time and cross-section, then folds (name, kind, input, rate). halo: earlier sessions that its windows over time look at."""

    plain: dict[str, str] = field(default_factory=dict)
    windows: dict[str, str] = field(default_factory=dict)
    folds: dict[str, tuple[str, str, float]] = field(default_factory=dict)
    halo: int = 0


class Compiler:
    """Compiles formulas to stages; dialect is "spark" or "duckdb". along: what windows over time are partitioned by; decimals: what results of windows are rounded to."""

    def __init__(self, dialect: str = "spark", along: str = "ts_code", date: str = "trade_date", order: str = "day_index", decimals: int | None = None):
        self.dialect, self.along, self.date, self.order, self.decimals = dialect, along, date, order, decimals
        self.stages: list[Stage] = []
        self.memo: dict[str, tuple[str, int]] = {}
        self.names: dict[str, str] = {}
        self.results: dict[str, str] = {}

    # -- parsing

    def add(self, name: str, text: str) -> None:
        """Compile one formula; its result will be the column `name`."""
        *lets, last = [x.strip() for x in text.split(";")]
        scope: dict[str, ast.expr] = {}
        for let in lets:
            key, _, body = let.partition(":=")
            scope[key.strip()] = self._parse(body, scope)
        self.results[name] = self._value(self._parse(last, scope))[0]

    def _parse(self, text: str, scope: dict[str, ast.expr]) -> ast.expr:
        class Inline(ast.NodeTransformer):
            def visit_Name(self, node: ast.Name) -> ast.expr:
                return scope.get(node.id, node)

        try:
            return Inline().visit(ast.parse(text.strip(), mode="eval").body)
        except SyntaxError as e:
            raise FormulaError(f"{text!r}: {e}") from e

    # -- expressions: text of the expression and the stage whose columns it needs

    def _value(self, node: ast.expr) -> tuple[str, int]:
        sql, level, kind = self._expr(node)
        return (f"CAST({sql} AS INT)" if kind == "bool" and self.dialect == "duckdb" else f"cast({sql} AS int)") + " * 1.0D" * (self.dialect == "spark") if kind == "bool" else sql, level

    def _number(self, x: float) -> str:
        return f"{float(x)!r}D" if self.dialect == "spark" else f"CAST({float(x)!r} AS DOUBLE)"

    def _expr(self, node: ast.expr) -> tuple[str, int, str]:
        """SQL, level, and "num" or "bool"."""
        match node:
            case ast.Constant(value=bool()):
                raise FormulaError("truth values aren't numbers")
            case ast.Constant(value=int() | float()):
                return self._number(node.value), 0, "num"
            case ast.Name(id="null"):
                return "CAST(NULL AS DOUBLE)", 0, "num"
            case ast.Name(id=name) if name in BASE:
                return name, 0, "num"
            case ast.UnaryOp(op=ast.USub()):
                x, n = self._value(node.operand)
                return f"(-{x})", n, "num"
            case ast.UnaryOp(op=ast.Not()):
                x, n, _ = self._expr(node.operand)
                return f"(NOT {x})", n, "bool"
            case ast.BinOp():
                return self._binary(node)
            case ast.BoolOp():
                parts = [self._expr(x) for x in node.values]
                word = " AND " if isinstance(node.op, ast.And) else " OR "
                return f"({word.join(p[0] for p in parts)})", max(p[1] for p in parts), "bool"
            case ast.Compare(ops=[op], comparators=[right]):
                signs = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "=", ast.NotEq: "<>"}
                (a, m), (b, n) = self._value(node.left), self._value(right)
                return f"({a} {signs[type(op)]} {b})", max(m, n), "bool"
            case ast.Call(func=ast.Name(id=name), keywords=[]):
                return self._call(name, list(node.args))
        raise FormulaError(f"not in the language: {ast.unparse(node)}")

    def _binary(self, node: ast.BinOp) -> tuple[str, int, str]:
        (a, m), (b, n) = self._value(node.left), self._value(node.right)
        n = max(m, n)
        match node.op:
            case ast.Add():
                return f"({a} + {b})", n, "num"
            case ast.Sub():
                return f"({a} - {b})", n, "num"
            case ast.Mult():
                return f"({a} * {b})", n, "num"
            case ast.Div():
                return f"({a} / nullif({b}, {self._number(0)}))", n, "num"
            case ast.Pow():
                zero = self._number(0)
                return f"(CASE WHEN {a} > {zero} OR ({a} = {zero} AND {b} > {zero}) OR ({a} < {zero} AND {b} = floor({b})) THEN {self.rounded(f'power({a}, {b})')} END)", n, "num"
        raise FormulaError(f"no operator {type(node.op).__name__}")

    def _call(self, name: str, args: list[ast.expr]) -> tuple[str, int, str]:
        arity = (ELEMENTWISE | CROSS | TIME | FOLDS | {"pressure": 1, "wav": max(2, len(args))}).get(name)
        if arity is None:
            raise FormulaError(f"unknown function {name}")
        args += [ast.Constant(x) for x in DEFAULTS.get(name, ())[len(args) - arity :]] if len(args) < arity else []
        if len(args) != arity:
            raise FormulaError(f"{name} takes {arity} arguments")
        if name == "pressure":
            return self._expr(self._parse(_pressure(args[0].value), {}))
        if name == "wav":
            return self._expr(_weighted(args))
        if name in ELEMENTWISE:
            return self._elementwise(name, args)
        return self._windowed(name, args)

    def _elementwise(self, name: str, args: list[ast.expr]) -> tuple[str, int, str]:
        if name == "iif":
            p, k, _ = self._expr(args[0])
            (a, m), (b, n) = self._value(args[1]), self._value(args[2])
            return f"(CASE WHEN {p} THEN {a} ELSE {b} END)", max(k, m, n), "num"
        parts = [self._value(x) for x in args]
        a, n = parts[0][0], max(p[1] for p in parts)
        b = parts[1][0] if len(parts) > 1 else ""
        zero = self._number(0)
        return {
            "abs": f"abs({a})",
            "log": f"(CASE WHEN {a} > {zero} THEN {self.rounded(f'ln({a})')} END)",
            "sqrt": f"(CASE WHEN {a} >= {zero} THEN sqrt({a}) END)",
            "sign": f"(CASE WHEN {a} > {zero} THEN {self._number(1)} WHEN {a} < {zero} THEN {self._number(-1)} WHEN {a} = {zero} THEN {zero} END)",
            "nz": f"(CASE WHEN {a} = {zero} THEN {b} ELSE {a} END)",
            "fill": f"coalesce({a}, {b})",
            "pmin": f"(CASE WHEN {a} <= {b} THEN {a} WHEN {b} < {a} THEN {b} END)",
            "pmax": f"(CASE WHEN {a} >= {b} THEN {a} WHEN {b} > {a} THEN {b} END)",
        }[name], n, "num"

    # -- windows

    def rounded(self, sql: str) -> str:
        """Rounded half to even in double arithmetic, which is the same everywhere; as it is where no decimals are asked for."""
        return f"({sql})" if self.decimals is None else rounded(sql, self.decimals, self.dialect)

    def _stage(self, level: int) -> Stage:
        while len(self.stages) < level:
            self.stages.append(Stage())
        return self.stages[level - 1]

    def _column(self, kind: str, sql: str, level: int) -> str:
        """The name of a column of the stage `level` (from 1) for this expression."""
        key = f"{kind}:{level}:{sql}"
        if key not in self.names:
            self.names[key] = f"{kind}{len(self.names)}"
            getattr(self._stage(level), "plain" if kind == "p" else "windows")[self.names[key]] = sql
        return self.names[key]

    def _input(self, node: ast.expr) -> tuple[str, int]:
        """A column, or a plain expression made one in the stage that will use it."""
        return self._value(node)

    def _windowed(self, name: str, args: list[ast.expr]) -> tuple[str, int, str]:
        numbers = [x.value for x in args if isinstance(x, ast.Constant)]
        inputs = [self._input(x) for x in args if not isinstance(x, ast.Constant)]
        if len(inputs) != (2 if name in ("corr", "cov", "beta") else 1):
            raise FormulaError(f"{name} needs series, and numbers as its other arguments")
        memo = f"{name}({', '.join([x[0] for x in inputs] + [str(x) for x in numbers])})"
        if memo in self.memo:
            return *self.memo[memo], "num"
        level = max(x[1] for x in inputs) + 1
        cols = [sql if sql.isidentifier() else self._column("p", sql, level) for sql, _ in inputs]
        if name in FOLDS:
            rate = numbers[1] / numbers[0] if name == "ema" else 0.0
            out = self._column("f", memo, level)
            stage = self.stages[level - 1]
            stage.windows.pop(out, None)
            stage.folds[out] = (name, cols[0], rate)
        else:
            sql = self._window_sql(name, cols, numbers, level)
            out = self._column("w", sql, level)
        self.memo[memo] = (out, level)
        return out, level, "num"

    def _window_sql(self, name: str, cols: list[str], numbers: list[float], level: int) -> str:
        x = cols[0]
        across = f"OVER (PARTITION BY {self.date})"
        time = f"PARTITION BY {self.along} ORDER BY {self.order}"
        rounded = self.rounded
        if name == "rank":
            last = f"OVER (PARTITION BY {self.date} ORDER BY {x} ASC NULLS LAST)"
            return f"CASE WHEN {x} IS NOT NULL THEN CAST(rank() {last} AS DOUBLE) / count({x}) {across} END"
        if name == "scale":
            return rounded(f"{self._number(numbers[0])} * {x} / nullif(sum(abs({x})) {across}, {self._number(0)})")
        if name in ("xmax", "xmin"):
            return f"{name[1:]}({x}) {across}"
        n = int(numbers[0])
        if n < 1 or n != numbers[0]:
            raise FormulaError(f"{name} needs a positive whole number of sessions")
        self._stage(level).halo = max(self._stage(level).halo, n if name in ("delay", "delta") else n - 1)
        if name == "delay":
            return f"lag({x}, {n}) OVER ({time})"
        if name == "delta":
            return f"{x} - lag({x}, {n}) OVER ({time})"
        over = f"OVER ({time} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        full = lambda sql, of=x: f"CASE WHEN count({of}) {over} = {n} THEN {sql} END"
        if name == "count":
            return f"CAST(count({x}) {over} AS DOUBLE)"
        if name in ("sum", "mean", "std"):
            return full(rounded(f"{ {'sum': 'sum', 'mean': 'avg', 'std': 'stddev_samp'}[name]}({x}) {over}"))
        if name in ("tmin", "tmax"):
            return full(f"{name[1:]}({x}) {over}")
        items = f"{'collect_list' if self.dialect == 'spark' else 'list'}({x}) {over}"
        if name == "tsrank":
            if self.dialect == "spark":
                return full(f"CAST(size(filter({items}, e -> e < {x})) + 1 AS DOUBLE)")
            return full(f"CAST(len(list_filter({items}, lambda e: e < {x})) + 1 AS DOUBLE)")
        if name in ("argmax", "argmin"):
            best = f"{name[3:]}({x}) {over}"
            at = f"array_position({items}, {best})" if self.dialect == "spark" else f"list_position({items}, {best})"
            return full(f"CAST({at} AS DOUBLE)")
        if name == "decay":
            parts = " + ".join(f"{n - k} * {f'lag({x}, {k}) OVER ({time})' if k else x}" for k in range(n))
            return rounded(f"({parts}) / {self._number(n * (n + 1) / 2)}")
        if name == "prod":
            if self.dialect == "spark":
                return full(rounded(f"aggregate({items}, 1.0D, (a, e) -> a * e)"))
            return full(rounded(f"list_reduce({items}, lambda a, e: a * e, CAST(1 AS DOUBLE))"))
        if name == "slope":
            t = f"CAST({self.order} AS DOUBLE)"
            mean = f"avg({x}) {over}"
            return full(rounded(f"(avg({x} * {t}) {over} - {mean} * avg({t}) {over}) / {self._number((n * n - 1) / 12)}"))
        y = cols[1]
        pair = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END"
        # moments about a fixed point near the data lose nothing to large means
        cx, cy = (self._column("p", f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {z} END", level) for z in (x, y))
        mean = lambda z: f"avg({z}) {over}"
        covar = f"covar_pop({cx}, {cy}) {over}"
        if name == "cov":
            return f"CASE WHEN count({pair}) {over} = {n} THEN {rounded(f'{covar} * {self._number(n / (n - 1))}')} END"
        vx, vy = f"var_pop({cx}) {over}", f"var_pop({cy}) {over}"
        varies = lambda v, z: f"{v} > {self._number(CONSTANT)} * avg({z} * {z}) {over}"
        if name == "beta":
            return f"CASE WHEN count({pair}) {over} >= 2 AND {varies(vy, cy)} THEN {rounded(f'{covar} / {vy}')} END"
        return f"CASE WHEN count({pair}) {over} = {n} AND {varies(vx, cx)} AND {varies(vy, cy)} THEN {rounded(f'{covar} / sqrt({vx} * {vy})')} END"


def _pressure(variant: int) -> str:
    """The body that formulas 55 and 137 share; they differ in one term."""
    h, l_, hl, g = "abs(H - delay(C))", "abs(L - delay(C))", "abs(H - delay(L))", "abs(delay(C) - delay(O))"
    mid = hl if variant == 55 else h
    top = "16 * (delta(C) + (C - O) / 2 + delay(C) - delay(O))"
    low = f"iif({h} > {l_} and {h} > {hl}, {h} + {l_} / 2 + {g} / 4, iif({l_} > {hl} and {l_} > {h}, {l_} + {mid} / 2 + {g} / 4, {hl} + {g} / 4))"
    return f"({top}) / ({low}) * pmax({h}, {l_})"


def _weighted(args: list[ast.expr]) -> ast.expr:
    """wav(x, w1, ..., wn): the sessions up to this one, the last weighted by wn, over the sum of the weights."""
    x, *weights = args
    if not weights or not all(isinstance(w, ast.Constant) and isinstance(w.value, int | float) and not isinstance(w.value, bool) for w in weights) or not sum(w.value for w in weights):
        raise FormulaError("wav takes a series and weights that don't add up to 0")
    terms = []
    for k, w in enumerate(reversed(weights)):
        late = ast.Call(func=ast.Name(id="delay"), args=[x, ast.Constant(k)], keywords=[]) if k else x
        terms.insert(0, ast.BinOp(late, ast.Mult(), w))
    total = terms[0]
    for t in terms[1:]:
        total = ast.BinOp(total, ast.Add(), t)
    return ast.BinOp(total, ast.Div(), ast.Constant(sum(w.value for w in weights)))


def evaluate(panel: DataFrame, formulas: dict[str, str], keep: tuple[str, ...] = ("trade_date", "ts_code"), code: str = "ts_code", date: str = "trade_date", order: str = "day_index", block: int | None = None, decimals: int | None = None) -> DataFrame:
    """keep and one column for each formula, over a dense panel with the base columns and a session number. With `decimals`, results of windows are rounded to them.

    With `block`, windows over time run in blocks of so many sessions of a security, warmed up by as many as the stage
    looks back on, instead of all sessions of a security in one task. Results don't depend on it. It pays where there
    are fewer securities than the cluster has cores, or long histories; each stage then copies (block + look-back) / block
    times its rows. Recursions are scanned over blocks either way.
    """
    across = f"{order}, {date}"
    c = Compiler("spark", f"{code}, _block" if block else code, across, order, decimals)
    for name, text in formulas.items():
        c.add(name, text)
    sessions = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df, here = panel, None
    for group in _visits(c, f"PARTITION BY {across}", bool(block)):
        if group.plain:
            df = df.selectExpr("*", *(f"{sql} AS {name}" for name, sql in group.plain.items()))
        if group.across and not here:
            df = df.repartitionById(sessions, F.col(order).cast("int"))
        here = group.across
        if group.windows:
            df = blocks.blocked(df, block, group.halo, order) if block and not here else df
            df = df.selectExpr("*", *(f"{sql} AS {name}" for name, sql in group.windows.items()))
            df = blocks.own(df) if block and not here else df
        if group.folds:
            df = blocks.scan(df, group.folds, block or SCAN, code, order, not block)
            df = df.selectExpr(*(x for x in df.columns if x not in group.folds), *(f"{c.rounded(k)} AS {k}" for k in group.folds))
    return df.selectExpr(*keep, *(f"{sql} AS {name}" for name, sql in c.results.items()))


@dataclass
class Group(Stage):
    """A stage whose windows are all of one kind; across: over the cross-section, else over time."""

    across: bool = False


def _visits(c: Compiler, mark: str, blocked: bool = False) -> list[Group]:
    """The columns of all stages in groups, such that rows change between securities and sessions as seldom as may be.

    While rows lie by security, all windows over time whose inputs are there are computed, then those that need these,
    and so on; then all over the cross-section, whose SQL has the mark, in the same way. Folds wait until nothing else
    can be computed. Of the two orders the one with fewer changes is taken, where the panel lies by security; on a tie
    the cross-section comes first, as rows are short then.
    """
    kind, sql, level = {}, {}, {}
    for i, stage in enumerate(c.stages):
        for name, text in (stage.plain | stage.windows).items():
            kind[name], sql[name], level[name] = "plain" if name in stage.plain else "across" if mark in text else "along", text, i
        for name, fold in stage.folds.items():
            kind[name], sql[name], level[name] = "fold", fold[1], i
    words = lambda text: {w for w in re.findall(r"[A-Za-z_]\w*", text) if w in sql}
    needs = {name: words(text) - {name} for name, text in sql.items()}
    for i, (name, text) in enumerate(c.results.items()):
        others = set().union(*needs.values(), *(words(t) for n, t in c.results.items() if n != name))
        if not text.isidentifier() and words(text) - others:  # its inputs go as soon as it is there
            c.results[name], needs[f"_r{i}"], kind[f"_r{i}"] = f"_r{i}", words(text), "result"
            sql[f"_r{i}"] = text

    def ordered(now: str) -> list[Group]:
        done, out, idle = set(), [], 0
        ready = lambda n: all(m in done or (kind[m] == "plain" and ready(m)) for m in needs[n])
        pending = lambda k: [n for n in sql if n not in done and kind[n] == k and ready(n)]
        while any(n not in done and kind[n] != "plain" for n in sql):
            some = pending(now) or (pending("fold") if idle > 1 else [])
            if not some and idle > 1:
                some = pending("result")
            if not some:
                now, idle = "across" if now == "along" else "along", idle + 1
                continue
            early, late = pending("result"), list(some)
            for n in late:
                late += [m for m in needs[n] if kind[m] == "plain" and m not in done and m not in late]
            plain = {n: sql[n] for n in sql if n in early or (n in late and kind[n] == "plain")}
            folds = {n: c.stages[level[n]].folds[n] for n in some if kind[n] == "fold"}
            windows = {n: sql[n] for n in some if kind[n] in ("across", "along")}
            out.append(Group(plain, windows, folds, max((c.stages[level[n]].halo for n in windows), default=0), now == "across" and bool(windows)))
            done |= {*plain, *windows, *folds}
            if folds:
                now = "along"
            idle = 0
        return out

    def changes(groups: list[Group]) -> int:
        at = [False, *(g.across for g in groups if g.windows or g.folds)]
        return sum(a != b for a, b in zip(at, at[1:], strict=False))

    return min((ordered("across"), ordered("along")), key=changes)


def to_sql(panel: str, formulas: dict[str, str], keep: tuple[str, ...] = ("trade_date", "ts_code"), decimals: int | None = None) -> str:
    """DuckDB SQL for the same columns, from a relation or CTE `panel`."""
    c = Compiler("duckdb", decimals=decimals)
    for name, text in formulas.items():
        c.add(name, text)
    ctes, last = [], panel
    for i, stage in enumerate(c.stages):
        for part, columns in (("p", stage.plain), ("w", stage.windows), ("f", {k: _fold_sql(c, *v) for k, v in stage.folds.items()})):
            if columns:
                ctes.append(f"s{i}{part} AS MATERIALIZED (SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in columns.items())} FROM {last})")
                last = f"s{i}{part}"
    results = ", ".join(f"{sql} AS {name}" for name, sql in c.results.items())
    return (", ".join(ctes) + " " if ctes else "") + f"SELECT {', '.join(keep)}, {results} FROM {last}"


def _fold_sql(c: Compiler, kind: str, x: str, rate: float) -> str:
    items = f"list({x}) FILTER ({x} IS NOT NULL) OVER (PARTITION BY ts_code ORDER BY day_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    if kind == "grow":
        step = f"list_reduce({items}, lambda a, e: CASE WHEN e > 0 THEN a * e ELSE a END, CAST(1 AS DOUBLE))"
    else:
        step = f"list_reduce({items}, lambda a, e: CAST({1 - rate!r} AS DOUBLE) * a + CAST({rate!r} AS DOUBLE) * e)"
    return f"CASE WHEN {x} IS NOT NULL THEN {c.rounded(step)} END"
