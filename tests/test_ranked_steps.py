"""Steps of many pairs at once against one pair after the other."""

import numpy as np

from larkspur.operators import factorise


def test_ranks_keep_the_order_of_each_row():
    rng = np.random.default_rng(4)
    pairs = np.unique(np.stack([rng.integers(0, 900, 6000), rng.integers(0, 700, 6000)], 1), axis=0)
    pairs = np.unique(np.vstack([pairs, np.stack([np.arange(900), np.full(900, 3)], 1)]), axis=0)  # one item of all users
    rank = factorise.ranks(pairs)
    ranked = np.column_stack([pairs, rank])[np.argsort(rank, kind="stable")]
    assert all(len(np.unique(ranked[ranked[:, 2] == r, c])) == (ranked[:, 2] == r).sum() for r in np.unique(rank) for c in (0, 1))
    users, items = (np.hstack([rng.uniform(-0.5, 0.5, (n, 8)), np.zeros((n, 1))]) for n in (900, 700))
    a, b, c, d = users.copy(), items.copy(), users.copy(), items.copy()
    factorise.steps(a, b, pairs, 0.05, 0.001)
    factorise.ranked_steps(c, d, ranked, 0.05, 0.001)
    assert np.abs(a - c).max() < 1e-12 and np.abs(b - d).max() < 1e-12
    none = np.zeros((0, 2), np.int32)
    assert len(factorise.ranks(none)) == 0
    factorise.ranked_steps(c, d, np.zeros((0, 3), np.int32), 0.05, 0.001)


def test_a_step_costs_less_than_a_pair_at_a_time():
    """60,000 pairs take few ranks, so most are stepped in bulk."""
    rng = np.random.default_rng(5)
    pairs = np.unique(np.stack([rng.integers(0, 6000, 60_000), rng.integers(0, 6000, 60_000)], 1), axis=0)
    assert factorise.ranks(pairs).max() < 200
