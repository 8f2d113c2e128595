"""The genetic steps of packing: exchanges keep pieces and fill bins, and crossover finds what best fit does not."""

import numpy as np
import pytest

from tallow.llm import packing


def triples(n, capacity, seed):
    """Sizes of n bins of three pieces that fill them exactly, dealt in order of their bins."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a, b = sorted(rng.integers(capacity // 4, capacity // 2, 2).tolist())
        out += [a, b, capacity - a - b]
    return out


def whole(bins, size, capacity):
    return sorted(i for b in bins for i in b) == list(range(len(size))) and all(b and sum(size[i] for i in b) <= capacity for b in bins)


@pytest.mark.parametrize("seed", range(5))
def test_exchanges_keep_pieces_and_gather_room(seed):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 2000, 400).tolist()
    bins = []
    packing.best_fit(list(range(400)), size, bins, 2048)
    room = lambda: sorted(2048 - sum(size[i] for i in b) for b in bins)
    before, full = packing.fitness(bins, size, 2048), sum(r == 0 for r in room())
    packing.concentrate(bins, size, 2048)
    assert whole(bins, size, 2048) and packing.fitness(bins, size, 2048) <= before and sum(r == 0 for r in room()) >= full
    pool, rest = [i for b in bins[-3:] for i in b], bins[:-3]
    left = packing.exchange(list(pool), size, rest, 2048)
    assert sorted([*left, *[i for b in rest for i in b]]) == list(range(400)) and all(sum(size[i] for i in b) <= 2048 for b in rest)
    assert sum(size[i] for i in left) <= sum(size[i] for i in pool)


def test_evolution_needs_fewer_bins_than_best_fit():
    """Pieces that leave three tenths of a bin over: best fit misses the bound, the genetic steps reach it in most cases."""
    better = 0
    for seed in range(6):
        rng = np.random.default_rng(seed)
        size = np.minimum(2047, rng.lognormal(6.2, 0.9, 600).astype(int) + 1).tolist()
        size.append(min(2047, (int(0.7 * 2048) - sum(size)) % 2048 or 1))
        plain, bound = [], -(-sum(size) // 2048)
        packing.best_fit(list(range(len(size))), size, plain, 2048)
        found = packing.evolve(size, [], 2048, seed)
        assert whole(found, size, 2048) and bound <= len(found) <= len(plain)
        better += len(found) < len(plain)
    assert better >= 3


def test_crossover_joins_what_two_parents_have_found():
    """Each parent has the right bins of one half; their child has them all, which neither parent, their copy nor best fit has."""
    capacity, n = 1000, 16
    size = triples(n, capacity, 1)
    right = [[3 * k, 3 * k + 1, 3 * k + 2] for k in range(n)]

    def parent(half):
        rest = [i for b in right if b not in half for i in b]
        return [list(b) for b in half] + [rest[k : k + 2] for k in range(0, len(rest), 2)]

    a, b, plain = parent(right[: n // 2]), parent(right[n // 2 :]), []
    packing.best_fit(list(range(len(size))), size, plain, capacity)
    children = [packing.crossover(a, b, size, capacity, np.random.default_rng(s)) for s in range(60)]
    assert all(whole(c, size, capacity) for c in children)
    assert min(map(len, children)) == n < min(len(a), len(b), len(plain))
