"""Packing for windows that the bins do not divide: every id once, by combinations, with little padding."""

import numpy as np
import pytest

from chalkline.llm import packing


@pytest.mark.parametrize("window", [1, 2, 7, 31, 33, 100, 1000, 1023, 2048, 4000])
def test_plan_of_any_window(window):
    rng = np.random.default_rng(window)
    lengths = rng.integers(0, 3 * window + 2, 600)
    held = [[] for _ in lengths]
    sizes = []
    for pieces in packing.plan(lengths, window):
        sizes.append(sum(n for _, _, n in pieces))
        assert 0 < sizes[-1] <= window and all(n > 0 for _, _, n in pieces)
        for k, start, n in pieces:
            held[k].append((start, n))
    for n, parts in zip(lengths, held):
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        assert at == n
    short = [s for s in sizes if s < window]
    assert all(s & (s - 1) == 0 for s in short) and sum(short) < window
