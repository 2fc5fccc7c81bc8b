import numpy as np
import pytest

from quillstone.operators import boosting as b
from quillstone.operators.research import Split
from shown import rows

FEATURES = ["u", "v", "w"]


def _table(seed, sessions=24, codes=30):
    rng = np.random.default_rng(seed)
    out = []
    for d in range(1, sessions + 1):
        for c in range(codes):
            u, v, w = rng.normal(size=3).round(1)
            y = 0.5 * u - (v > 0.3) + 0.1 * rng.normal()
            out.append((d, f"c{c:02d}", float(u), None if rng.random() < 0.15 else float(v), float(w), None if rng.random() < 0.05 else float(y)))
    return out


def _plain(table, ends, split, s):
    """Trees by plain loops over the rows of the training sessions, in floating point; predictions of the test sessions."""
    table = sorted(table, key=lambda r: (r[0], r[1]))
    x = b.binned(np.array([[np.nan if v is None else v for v in r[2:5]] for r in table]), ends)
    y, day = np.array([np.nan if r[5] is None else r[5] for r in table]), np.array([r[0] for r in table])
    learn = (day >= split.train[0]) & (day <= split.train[1]) & ~np.isnan(y)
    score = np.full(len(table), y[learn].mean() if s.objective == "regression" else 0.0)
    for t in range(s.trees):
        g, h, seen = np.zeros(len(table)), np.ones(len(table)), np.zeros(len(table), bool)
        for d in np.unique(day[learn]):
            at = np.flatnonzero(learn & (day == d))
            seen[at] = np.random.default_rng([s.seed, t, int(d)]).random(len(at)) < s.sample if s.sample < 1 else True
            weight = 0.5 ** ((split.train[1] - d) / s.half_life) if s.half_life else 1.0
            if s.objective == "regression":
                g[at] = score[at] - y[at]
            else:
                grade, order = b.grades(y[at], s.grades), np.argsort(-score[at], kind="stable")
                gain, gg, hh, total = 2.0**grade - 1, np.zeros(len(at)), np.zeros(len(at)), 0.0
                ideal = sum(x / np.log2(2 + i) for i, x in enumerate(sorted(gain, reverse=True)[: s.truncation]))
                for i in range(min(s.truncation, len(at))):
                    for j in range(i + 1, len(at)):
                        p, q = order[i], order[j]
                        if grade[p] == grade[q]:
                            continue
                        high, low = (p, q) if grade[p] > grade[q] else (q, p)
                        apart = score[at][high] - score[at][low]
                        delta = abs(gain[p] - gain[q]) * abs(1 / np.log2(2 + i) - 1 / np.log2(2 + j)) / ideal
                        if score[at].max() != score[at].min():
                            delta /= 0.01 + abs(apart)
                        chance = 1 / (1 + np.exp(apart))
                        gg[high] -= delta * chance
                        gg[low] += delta * chance
                        hh[[high, low]] += delta * chance * (1 - chance)
                        total += 2 * delta * chance
                scale = np.log2(1 + total) / total if total > 0 else 1
                g[at], h[at] = gg * scale, hh * scale
            g[at], h[at] = g[at] * weight, h[at] * weight

        def grow(inside, level):
            """The value of each row under this node."""
            use = inside & seen
            G, H = g[use].sum(), h[use].sum()
            best = (1e-9, None)
            if level < s.depth:
                for f in range(3):
                    for left in (True, False):
                        for cut in range(1, s.bins):
                            side = np.where(x[:, f] == 0, left, x[:, f] <= cut)
                            a = use & side
                            if a.sum() >= s.least and use.sum() - a.sum() >= s.least:
                                ga, ha = g[a].sum(), h[a].sum()
                                if ha > 0 and H - ha > 1e-9:
                                    gain = ga**2 / (ha + s.penalty) + (G - ga) ** 2 / (H - ha + s.penalty) - G**2 / (H + s.penalty)
                                    if gain > best[0] + 1e-9:
                                        best = (gain, side)
            if best[1] is None:
                return np.where(inside, -s.rate * G / (H + s.penalty), 0.0)
            return grow(inside & best[1], level + 1) + grow(inside & ~best[1], level + 1)

        score = score + grow(np.ones(len(table), bool), 0)
    test = (day >= split.test[0]) & (day <= split.test[1])
    return {(int(d), r[1]): p for d, r, p, ok in zip(day, table, score, test, strict=True) if ok}


@pytest.mark.parametrize("s", [
    b.Settings("regression", trees=4, depth=3, rate=0.3, bins=9, least=10, sample=1.0, keep=2),
    b.Settings("regression", trees=3, depth=2, rate=0.3, bins=9, least=10, penalty=3.0, sample=0.7, half_life=6.0),
    b.Settings("ranking", trees=4, depth=2, rate=0.3, bins=7, least=10, truncation=10, grades=5, keep=1),
])
def test_trees_equal_plain_loops(spark, s):
    table, splits = _table(3), [Split((1, 12), (14, 18)), Split((5, 17), (19, 24))]
    df = spark.createDataFrame(table, "day_index int, ts_code string, u double, v double, w double, y double").repartition(5)
    ends = b.edges(df.where("day_index <= 17"), FEATURES, s.bins)
    got = b.rolling_predictions(df, FEATURES, "y", splits, s).collect()
    for w, split in enumerate(splits):
        want = _plain(table, ends, split, s)
        mine = {(r.day_index, r.ts_code): r.prediction for r in got if r.window == w}
        assert set(mine) == set(want) and all(abs(mine[k] - want[k]) < 1e-5 for k in want)


def test_trees_dont_depend_on_partitions_and_learn(spark):
    table, s = _table(7, sessions=40), b.Settings("ranking", trees=20, depth=3, rate=0.2, bins=15, truncation=30, grades=5)
    df = spark.createDataFrame(table, "day_index int, ts_code string, u double, v double, w double, y double")
    split = [Split((1, 30), (33, 40))]
    one, other = (b.rolling_predictions(df.repartition(n), FEATURES, "y", split, s) for n in (1, 7))
    got = rows(one)
    assert got == rows(other)
    truth = {(r[0], r[1]): r[5] for r in table}
    known = [(p, truth[d, c]) for _, d, c, p in got if truth[d, c] is not None]
    assert np.corrcoef(np.array(known).T)[0, 1] > 0.8


def test_nothing_to_learn_from(spark):
    schema, s = "day_index int, ts_code string, u double, v double, w double, y double", b.Settings(trees=2, depth=2)
    df = spark.createDataFrame([(1, "a", 1.0, None, float("nan"), None), (2, "a", None, None, 2.0, None), (None, "a", 1.0, 1.0, 1.0, 1.0)], schema)
    assert rows(b.rolling_predictions(df, FEATURES, "y", [Split((1, 1), (2, 2))], s)) == [(0, 2, "a", 0.0)]
    assert b.rolling_predictions(df, FEATURES, "y", [], s).count() == 0
    assert b.rolling_predictions(df.limit(0), FEATURES, "y", [Split((1, 1), (2, 2))], s).count() == 0
    g, h = b.ranking_gradients(np.zeros(3), np.zeros(3, int), 2)
    assert not g.any() and not h.any()
