import numpy as np
import pytest

from quillstone.llm import minhash_dedup as m


def dropped(similarity: float) -> float:
    """Exact probability that the sketches of a pair differ in more bits than a linked pair's may."""
    most = 2 * m.SAMPLES * (1 - (0.8 - m.MARGIN))
    limit = m.BITS / 2 * (1 - np.exp(-2 * most / m.BITS))
    odd, total, chance = np.zeros(m.BITS + 1), 0.0, similarity**m.SAMPLES
    odd[0] = 1.0
    up, bits = 1 - np.arange(m.BITS + 1) / m.BITS, np.arange(m.BITS + 1)
    for n in range(m.SAMPLES + 1):
        total += chance * odd[bits > limit].sum()
        chance *= (m.SAMPLES - n) / (n + 1) * (1 - similarity) / similarity
        for _ in range(2):  # a sample that differs flips one bit for each document
            new = np.zeros_like(odd)
            new[1:] += (odd * up)[:-1]
            new[:-1] += (odd * (1 - up))[1:]
            odd = new
    return total


@pytest.mark.parametrize("similarity", [0.8, 0.82, 0.9])
def test_linked_pairs_are_hardly_ever_dropped_unseen(similarity):
    assert dropped(similarity) < 1e-7
