import numpy as np

from quillstone.llm import packing


def test_the_program_covers_every_length_and_best_fit_gets_the_rounding_only():
    rng = np.random.default_rng(5)
    lengths, counts = np.unique(rng.integers(1, 1025, 60_000), return_counts=True)
    h = {int(k): int(v) for k, v in zip(lengths, counts, strict=True)}
    short, number = lengths[lengths < 1024], counts[lengths < 1024]
    kinds, used, bound = packing.solve(short, number, 1024)
    assert np.allclose(np.array(kinds).T @ used, number)
    assert used.sum() <= 1.001 * bound
    out, left, least = packing.programmed(h, 1024)
    assert sum(left.values()) < 0.02 * sum(h.values())
    assert least <= sum(t for _, t in packing.plan(h, 1024)) <= 1.001 * least + 1


def test_plans_reach_the_bound_where_best_fit_does_not():
    rng = np.random.default_rng(3)
    h = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(300, 520, 200_000), return_counts=True), strict=True)}
    total, (_, _, bound) = sum(t for _, t in packing.plan(h, 1024)), packing.programmed(h, 1024)
    assert bound <= total <= 1.001 * bound + 1
    assert sum(t for _, t in packing.best_fit(h, 1024)) > 1.03 * bound


def test_few_pieces_of_many_lengths_have_a_whole_cover():
    for seed in range(12):
        rng = np.random.default_rng(seed)
        pool = rng.integers(1, 1024, 1200) if seed % 2 else np.minimum(1023, rng.lognormal(5, 1, 900).astype(int) + 1)
        lengths, counts = np.unique(pool, return_counts=True)
        kinds, used, bound = packing.solve(lengths, counts, 1024)
        assert np.allclose(np.array(kinds).T @ used, counts) and bound <= used.sum() + 1e-6
        h = {int(k): int(v) for k, v in zip(lengths, counts, strict=True)}
        placed = {}
        for kind, times in packing.plan(h, 1024):
            for n, c in kind.items():
                placed[n] = placed.get(n, 0) + c * times
        assert placed == h


def test_equal_ratios_leave_the_basis_regular():
    rng = np.random.default_rng(0)
    lengths, counts = np.unique(np.concatenate([rng.integers(330, 700, 300), rng.integers(1, 1024, 150)]), return_counts=True)
    kinds, used, bound = packing.solve(lengths, counts, 1024)
    assert np.allclose(np.array(kinds).T @ used, counts) and bound <= used.sum() + 1e-6


def test_weights_give_configurations_and_a_bound_and_polishing_reaches_the_optimum(monkeypatch):
    rng = np.random.default_rng(9)
    for pool in (rng.integers(300, 520, 20_000), rng.integers(1, 1024, 5000), np.array([400, 400, 700])):
        lengths, counts = np.unique(pool, return_counts=True)
        kinds, times, bound = packing.weighted(lengths, counts, 1024)
        assert all((lengths[has] * copies).sum() <= 1024 and (copies > 0).all() for has, copies in kinds) and (times > 0).all()
        _, with_weights, _ = packing.solve(lengths, counts, 1024)
        monkeypatch.setattr(packing, "FEW", 10**9)
        _, without, least = packing.solve(lengths, counts, 1024)
        monkeypatch.undo()
        assert bound <= with_weights.sum() + 1e-6 and abs(with_weights.sum() - without.sum()) <= max(0.5, 2e-4 * least)
