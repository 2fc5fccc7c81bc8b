import random

import numpy as np
import pytest

from quillstone.llm import common, embedding_dedup, minhash_dedup


def parts(nodes, links):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = dict(common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    want = parts({x for e in edges[:-1] for x in e}, edges[:-1])
    assert got == want
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def _texts(seed):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = random.choices(vocabulary, k=random.randint(20, 120))
        for _ in range(random.randint(1, 8)):
            t = list(base)
            for _ in range(random.randint(0, 8)):
                t[random.randrange(len(t))] = random.choice(vocabulary)
            texts.append(" ".join(t))
    return texts + ["", None, "a b", "A  B", "a b c", "same words " * 30, "same words " * 31]


@pytest.mark.parametrize(("seed", "members"), [(0, 512), (1, 3)])
def test_minhash_equals_brute_force(spark, monkeypatch, seed, members):
    monkeypatch.setattr(minhash_dedup, "MEMBERS", members)
    monkeypatch.setattr(minhash_dedup, "GROUP", members)
    texts = _texts(seed)

    def shingles(t):
        w = t.lower().split() if t else []
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = parts(range(len(texts)), links)
    got = minhash_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), k=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in want}


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.int64).astype(np.uint64))
    for keep in (0.95, 0.85, 0.6):
        b = np.unique(np.concatenate([a[: int(keep * len(a))], rng.integers(0, 1 << 63, len(a) - int(keep * len(a)), dtype=np.int64).astype(np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (minhash_dedup.signature(s)[1].view(np.uint64) for s in (a, b))
        z = sum(int(v).bit_count() for v in x ^ y)
        estimate = 1 + minhash_dedup.BITS / 2 * np.log(1 - 2 * z / minhash_dedup.BITS) / (2 * minhash_dedup.SAMPLES)
        assert abs(estimate - true) < 0.2


def test_minhash_edges(spark, odd):
    got = minhash_dedup.dedup(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id == 5} == {0} and sum(r.kept for r in got if r.doc_id == 0) == 1
    assert all(r.component_id is None and not r.kept for r in got if r.doc_id is None)
    assert minhash_dedup.dedup(odd.limit(0)).count() == 0


def test_a_doc_id_of_several_texts_keeps_the_links_of_each(spark):
    random.seed(3)
    one, two = (random.choices([f"w{i}" for i in range(300)], k=100) for _ in range(2))
    near = lambda t: " ".join([*t[:-1], "other"])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (5, near(one)), (6, near(two)), (7, "something else altogether")]
    got = minhash_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 5: 1, 6: 1, 7: 7}


@pytest.mark.parametrize("tile", [2000, 7])
def test_embedding_join_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(25):
        base = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 9))):
            rows.append([float(np.float32(x)) for x in base + rng.normal(size=24) * rng.choice([0, 0.05, 0.2])])
    rows += [rows[0], [2 * x for x in rows[0]], [0.0] * 24, [float("nan")] * 24, None, [None] * 24, rows[0][:10], [1e-30 * x for x in rows[1]]]
    data = [(i, v, None if i == 1 else i % 2) for i, v in enumerate(rows)]
    ok = {i: np.array(v, float) for i, v, k in data if v and k is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in ok.items()}
    links = [(i, j) for i in ok for j in ok if i > j and len(ok[i]) == len(ok[j]) and data[i][2] == data[j][2] and unit[i] @ unit[j] >= 0.98]
    want = parts(range(len(data)), links)
    got = embedding_dedup.dedup(spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (sum(i in x for x in links), want[i]) for i in want}


@pytest.mark.parametrize("grid", [1, 2, 3])
def test_pairs_in_reach_meet_in_one_cell(spark, monkeypatch, grid):
    monkeypatch.setattr(embedding_dedup, "FEWER", 1 + 1e-6)
    monkeypatch.setattr(embedding_dedup, "TILE", 50)
    monkeypatch.setattr(embedding_dedup, "GRID", grid)
    rng = np.random.default_rng(grid)
    base = rng.normal(size=(60, 32))
    v = np.concatenate([base, base + 0.12 * rng.normal(size=base.shape), base + 0.12 * rng.normal(size=base.shape)])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & ~np.eye(len(v), dtype=bool)
    got = embedding_dedup.dedup(spark.createDataFrame([(i, x, 0) for i, x in enumerate(v.tolist())], "vec_id bigint, embedding array<double>, label int")).collect()
    assert near.sum() > 100 and {r.vec_id: r.n_links for r in got} == dict(enumerate(near.sum(axis=1).tolist()))


def test_embedding_edges(spark):
    schema = "vec_id bigint, embedding array<float>, label int, copies int"
    assert embedding_dedup.dedup(spark.createDataFrame([], schema)).count() == 0
    got = embedding_dedup.dedup(spark.createDataFrame([(1, [1.0, 0.0], 0, 9), (1, [1.0, 0.0], 0, 9), (None, [1.0, 0.0], 0, 9), (2, [1.0, 1e-3], 0, 9)], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got) == [(0, 0, None, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
