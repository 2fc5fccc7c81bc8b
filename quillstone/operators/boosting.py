"""Gradient-boosted trees from summed histograms, for regression and for ranking within sessions.

Rows are packed once: one row a session with its securities' feature bins (a byte each) and labels, so that a pass over
the data needs no shuffle and ranking gradients, which need whole sessions, are local. Trees grow by levels. In each pass
every task adds up gradients by (window, node, feature, bin) over its sessions; one group a (window, node, feature) sums
the tasks' histograms and finds its best split; the driver gets one row for each of them and never any data. Several
training windows, as in rolling evaluation, grow their trees in the same passes. Gradients are rounded to fixed-point
whole numbers, so sums, splits and trees don't depend on how the rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.research import Split
from quillstone.session import checkpointed

#: Gradients are whole numbers of this part; and bytes of histograms that a task holds before it passes them on.
UNIT, HELD = 1 << 24, 1 << 26


@dataclass(frozen=True)
class Settings:
    """objective "regression" or "ranking"; trees, levels of a tree, learning rate, bins a feature (253 at most), rows that a leaf needs, penalty, part of the rows that each tree sees, places that count in ranking, grades of its labels, sessions after which a weight has halved (None: equal weights), trees between two writings of the scores."""

    objective: str = "regression"
    trees: int = 100
    depth: int = 5
    rate: float = 0.03
    bins: int = 253
    least: int = 20
    penalty: float = 0.0
    sample: float = 0.8
    seed: int = 42
    truncation: int = 100
    grades: int = 31
    half_life: float | None = None
    keep: int = 10


class Tree:
    """A tree in heap order: node i splits on feature[i] at bin cut[i], nulls (bin 0) going left or right; or it is a leaf (feature -1)."""

    def __init__(self, depth: int):
        n = 2 ** (depth + 1) - 1
        self.depth, self.feature, self.cut, self.left, self.value = depth, np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The node at which each row of bins ends."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            f = self.feature[at]
            b = x[rows, np.maximum(f, 0)]
            right = np.where(b == 0, ~self.left[at], b > self.cut[at])
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at


@dataclass
class Model:
    """What a window has learnt: scores start at `start`, and each tree's values, which have the rate in them, add up."""

    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def scores(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.full(len(x), 0.0 if first else self.start)
        for t in self.trees[first:]:
            out += t.value[t.place(x)]
        return out


def edges(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Ascending upper ends of the bins of each feature, by approximate quantiles; a number of values for each feature, whatever the rows are."""
    at = [k / bins for k in range(1, bins)]
    finite = [F.when(~F.isnan(c), F.col(c).cast("double")) for c in features]
    row = df.agg(*(F.percentile_approx(c, at, 20_000).alias(f"e{k}") for k, c in enumerate(finite))).first()
    return [np.unique(np.array(row[f"e{k}"] or [], float)) for k in range(len(features))]


def binned(values: np.ndarray, ends: list[np.ndarray]) -> np.ndarray:
    """0 for null, else 1 + the number of ends below the value."""
    out = np.zeros(values.shape, np.uint8)
    for k, e in enumerate(ends):
        v = values[:, k]
        ok = ~np.isnan(v)
        out[ok, k] = 1 + np.searchsorted(e, v[ok], "left")
    return out


def pack(df: DataFrame, features: list[str], label: str, ends: list[np.ndarray], session: str = "day_index", code: str = "ts_code") -> DataFrame:
    """One row a session: session, codes, bins, labels (NaN for null), scores (empty), done; a checkpoint, as every pass reads it.

    A session's rows go by code, equal codes by label and features. Rows without session are left out.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("code", "ascending"), ("y", "ascending"), *((f"x{k}", "ascending") for k in range(len(features)))])
        x = np.column_stack([table[f"x{k}"].to_numpy(zero_copy_only=False).astype(float) for k in range(len(features))])
        y = table["y"].to_numpy(zero_copy_only=False).astype(float)
        return pa.table({"session": pa.array([table["session"][0].as_py()], pa.int32()), "codes": pa.array([table["code"].to_pylist()], pa.list_(pa.string())), "bins": [binned(x, ends).tobytes()], "labels": [y.tobytes()], "scores": [b""], "done": pa.array([0], pa.int32())})

    some = df.where(F.col(session).isNotNull()).select(F.col(session).cast("int").alias("session"), F.col(code).cast("string").alias("code"), F.col(label).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)))
    return checkpointed(some.groupBy("session").applyInArrow(run, "session int, codes array<string>, bins binary, labels binary, scores binary, done int"))


def ranking_gradients(scores: np.ndarray, grades: np.ndarray, truncation: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the ranking loss of one session: pairs of different grades of which one is among the first `truncation` by score, weighed by what swapping them changes in the normalised discounted gain."""
    n = len(scores)
    g, h = np.zeros(n), np.zeros(n)
    gain, discount, top = 2.0**grades - 1, 1 / np.log2(2 + np.arange(n)), min(n, truncation)
    ideal = (np.sort(gain)[::-1][:top] * discount[:top]).sum()
    if n < 2 or ideal <= 0:
        return g, h
    order = np.argsort(-scores, kind="stable")
    s, q, grade = scores[order], gain[order], grades[order]
    differ = (grade[:top, None] != grade[None, :]) & (np.arange(n)[None, :] > np.arange(top)[:, None])
    delta = np.abs(q[:top, None] - q[None, :]) * np.abs(discount[:top, None] - discount[None, :]) / ideal
    apart = (s[:top, None] - s[None, :]) * np.where(grade[:top, None] > grade[None, :], 1, -1)
    if s[0] != s[-1]:
        delta = delta / (0.01 + np.abs(apart))
    p = 1 / (1 + np.exp(np.clip(apart, -50, 50)))
    force, curve = np.where(differ, delta * p, 0), np.where(differ, delta * p * (1 - p), 0)
    sign = np.where(grade[:top, None] > grade[None, :], -1, 1)
    np.add.at(g, order[:top], (force * sign).sum(axis=1))
    np.add.at(g, order, -(force * sign).sum(axis=0))
    np.add.at(h, order[:top], curve.sum(axis=1))
    np.add.at(h, order, curve.sum(axis=0))
    whole = 2 * force.sum()
    if whole > 0:
        g, h = g * np.log2(1 + whole) / whole, h * np.log2(1 + whole) / whole
    return g, h


def grades(labels: np.ndarray, levels: int) -> np.ndarray:
    """rank * levels // n of each label, ties by place."""
    rank = np.empty(len(labels), np.int64)
    rank[np.argsort(labels, kind="stable")] = np.arange(len(labels))
    return np.minimum(rank * levels // max(1, len(labels)), levels - 1)


def _sessions(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray, bytes, int, pa.RecordBatch, int]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("session", "codes", "bins", "labels", "scores", "done")}
            yield row["session"], row["codes"], np.frombuffer(row["bins"], np.uint8).reshape(-1, width), np.frombuffer(row["labels"]), row["scores"], row["done"], batch, i


def _inside(windows: dict[int, Split], session: int) -> list[int]:
    return [w for w in sorted(windows) if windows[w].train[0] <= session <= windows[w].train[1]]


def _before(scores: bytes, done: int, k: int, model: Model, x: np.ndarray) -> np.ndarray:
    """Scores of a session in its k-th window: those written, and the trees since."""
    kept = np.frombuffer(scores).reshape(-1, len(x))[k] if done else 0.0
    return kept + model.scores(x, done)


def _histograms(windows: dict[int, Split], models: dict[int, Model], growing: dict[int, Tree], level: int, iteration: int, width: int, s: Settings):
    """For mapInArrow: sums of gradients, second derivatives and rows by window, node of the level, feature and bin."""
    size, first = s.bins + 1, 2**level - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for w, a in sums.items():
                node, f = np.nonzero(a[:, :, :, 2].any(axis=2))
                if len(node):
                    yield pa.RecordBatch.from_arrays([pa.array([w] * len(node), pa.int32()), pa.array(node + first, pa.int32()), pa.array(f, pa.int32()), pa.array(a[node, f].reshape(len(node), -1).tolist(), pa.list_(pa.int64()))], ["w", "node", "feature", "h"])
            sums.clear()

        for session, _, x, y, scores, done, _, _ in _sessions(batches, width):
            ok = ~np.isnan(y)
            if not ok.any():
                continue
            for k, w in enumerate(_inside(windows, session)):
                if w not in growing:
                    continue
                at = _before(scores, done, k, models[w], x)[ok]
                if s.objective == "ranking":
                    g, h = ranking_gradients(at, grades(y[ok], s.grades), s.truncation)
                else:
                    g, h = at - y[ok], np.ones(len(at))
                if s.half_life:
                    weight = 0.5 ** ((windows[w].train[1] - session) / s.half_life)
                    g, h = g * weight, h * weight
                seen = np.random.default_rng([s.seed, iteration, session]).random(len(at)) < s.sample if s.sample < 1 else np.ones(len(at), bool)
                rows, node = x[ok], growing[w].place(x[ok])
                seen &= (node >= first) & (node < 2 * first + 1)
                if not seen.any():
                    continue
                cell = ((node[seen, None] - first) * width + np.arange(width)) * size + rows[seen]
                a = sums.setdefault(w, np.zeros((first + 1, width, size, 3), np.int64))
                for j, v in enumerate((np.rint(g[seen] * UNIT), np.rint(h[seen] * UNIT), np.ones(int(seen.sum())))):
                    a[:, :, :, j] += np.rint(np.bincount(cell.ravel(), np.repeat(v, width), (first + 1) * width * size)).astype(np.int64).reshape(first + 1, width, size)
                if sum(x.nbytes for x in sums.values()) > HELD:
                    yield from flush()
        yield from flush()

    return run


_SPLIT = "w int, node int, feature int, gain double, cut int, left boolean, gl bigint, hl bigint, g bigint, h bigint, n bigint"


def _best(s: Settings):
    """For applyInArrow: the best split of a window's node by one feature; gain 0 where there is none."""

    def run(table: pa.Table) -> pa.Table:
        # totals are whole numbers, so their order doesn't matter
        h = np.sum([np.array(x, np.int64) for x in table["h"].to_pylist()], axis=0).reshape(-1, 3)
        whole, best = h.sum(axis=0), (0.0, 0, True, 0, 0)
        term = lambda g, k: (g / UNIT) ** 2 / (k / UNIT + s.penalty)
        upto = np.cumsum(h[1:], axis=0)[:-1]
        for left in (True, False) if h[0, 2] else (True,):
            a = upto + (h[0] if left else 0)
            b = whole - a
            ok = (a[:, 2] >= s.least) & (b[:, 2] >= s.least) & (a[:, 1] > 0) & (b[:, 1] > 0)
            if ok.any():
                gain = np.where(ok, term(a[:, 0], np.maximum(a[:, 1], 1)) + term(b[:, 0], np.maximum(b[:, 1], 1)) - term(whole[0], max(int(whole[1]), 1)), 0.0)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-12:
                    best = (float(gain[k]), k + 1, left, int(a[k, 0]), int(a[k, 1]))
        row = [*(table[c][0].as_py() for c in ("w", "node", "feature")), *best, *(int(x) for x in whole)]
        types = [pa.int32()] * 3 + [pa.float64(), pa.int32(), pa.bool_()] + [pa.int64()] * 5
        return pa.table([pa.array([v], t) for v, t in zip(row, types, strict=True)], [x.split()[0] for x in _SPLIT.split(", ")])

    return run


def _settle(windows: dict[int, Split], models: dict[int, Model], width: int):
    """For mapInArrow: the same sessions with the scores of all trees so far written beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, x, _, scores, done, batch, i in _sessions(batches, width):
            session = batch.column("session")[i].as_py()
            inside = _inside(windows, session)
            now = [_before(scores, done, k, models[w], x) for k, w in enumerate(inside)]
            one = batch.slice(i, 1)
            n = len(next(iter(models.values())).trees)
            yield pa.RecordBatch.from_arrays([*(one.column(c) for c in ("session", "codes", "bins", "labels")), pa.array([np.array(now).tobytes()], pa.binary()), pa.array([n], pa.int32())], ["session", "codes", "bins", "labels", "scores", "done"])

    return run


def train(packed: DataFrame, windows: dict[int, Split], width: int, s: Settings) -> dict[int, Model]:
    """A model for each window, of `s.trees` trees; a node without a split that gains is a leaf. Windows without labels have models without trees.

    s.depth passes a tree, whatever the number of windows. What the driver gets in a pass is a row for each window, node
    and feature.
    """
    models = {w: Model() for w in windows}
    if s.objective == "regression":

        def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list[int]] = {}
            for session, _, _, y, *_ in _sessions(batches, width):
                v = y[~np.isnan(y)]
                for w in _inside(windows, session):
                    t = total.setdefault(w, [0, 0])
                    t[0], t[1] = t[0] + int(np.rint(v * UNIT).sum()), t[1] + len(v)
            yield pa.RecordBatch.from_pydict({"w": pa.array(list(total), pa.int32()), "y": pa.array([x[0] for x in total.values()], pa.int64()), "n": pa.array([x[1] for x in total.values()], pa.int64())})

        for x in packed.mapInArrow(means, "w int, y bigint, n bigint").groupBy("w").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).where("n > 0").collect():
            models[x["w"]].start = x["y"] / UNIT / x["n"]
    for iteration in range(s.trees):
        growing = {w: Tree(s.depth) for w in windows}
        for level in range(s.depth):
            found: dict[tuple[int, int], object] = {}
            sums = packed.mapInArrow(_histograms(windows, models, growing, level, iteration, width, s), "w int, node int, feature int, h array<bigint>")
            for x in sums.groupBy("w", "node", "feature").applyInArrow(_best(s), _SPLIT).collect():
                now = found.get((x["w"], x["node"]))
                if now is None or (-x["gain"], x["feature"]) < (-now["gain"], now["feature"]):
                    found[x["w"], x["node"]] = x
            value = lambda g, h: -s.rate * (g / UNIT) / (h / UNIT + s.penalty) if h > 0 else 0.0
            for (w, node), x in found.items():
                tree = growing[w]
                if level == 0:
                    tree.value[0] = value(x["g"], x["h"])
                if x["gain"] > 0:
                    tree.feature[node], tree.cut[node], tree.left[node] = x["feature"], x["cut"], x["left"]
                    tree.value[2 * node + 1], tree.value[2 * node + 2] = value(x["gl"], x["hl"]), value(x["g"] - x["gl"], x["h"] - x["hl"])
            if not any(x["gain"] > 0 for x in found.values()):
                break
        for w, tree in growing.items():
            models[w].trees.append(tree)
        if (iteration + 1) % s.keep == 0 and iteration + 1 < s.trees:
            packed = checkpointed(packed.mapInArrow(_settle(windows, models, width), packed.schema))
    return models


def predict(packed: DataFrame, windows: dict[int, Split], models: dict[int, Model], width: int) -> DataFrame:
    """window, session, code, prediction of the sessions that each window tests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for session, codes, x, *_ in _sessions(batches, width):
            for w in sorted(windows):
                if windows[w].test[0] <= session <= windows[w].test[1]:
                    yield pa.RecordBatch.from_arrays([pa.array([w] * len(x), pa.int32()), pa.array([session] * len(x), pa.int32()), pa.array(codes, pa.string()), pa.array(models[w].scores(x))], ["window", "session", "code", "prediction"])

    return packed.mapInArrow(run, "window int, session int, code string, prediction double")


def rolling_predictions(df: DataFrame, features: list[str], label: str, splits: list[Split], settings: Settings, session: str = "day_index", code: str = "ts_code") -> DataFrame:
    """Out-of-sample predictions by rolling windows: each split learns on its training sessions and predicts its test sessions.

    Null features have a bin of their own, which each split sends to the better side; rows with a null label are
    predicted but not learnt from. No splits or rows give no rows. Bins are those of all training sessions' features
    (never of labels) up to the last split's, so they don't look into its test.
    """
    windows = dict(enumerate(splits))
    last = max((x.train[1] for x in splits), default=None)
    ends = edges(df.where(F.col(session) <= last) if windows else df.limit(0), features, settings.bins)
    packed = pack(df, features, label, ends, session, code)
    models = train(packed, windows, len(features), settings) if windows else {}
    return predict(packed, windows, models, len(features)).withColumnsRenamed({"session": session, "code": code})
