"""Substring hashes and window minima."""

from __future__ import annotations

import numpy as np
from pyspark import cloudpickle

from kithgraph.llm import rolling


def test_equal_substrings_have_equal_hashes():
    data = np.frombuffer(b"abcabcXabcabd" * 3, dtype=np.uint8)
    hasher, raw = rolling.Hasher(data), data.tobytes()
    seen: dict[int, bytes] = {}
    for i in range(len(raw)):
        for j in range(i + 1, len(raw) + 1):
            h = int(hasher.between(np.array([i]), np.array([j]))[0])
            assert seen.setdefault(h, raw[i:j]) == raw[i:j]
    assert len(seen) == len({raw[i:j] for i in range(len(raw)) for j in range(i + 1, len(raw) + 1)})


def test_leftmost_minimum():
    values = np.array([5, 3, 3, 9, 1, 1, 7, 2], dtype=np.uint64)
    for width in range(1, 9):
        want = [i + int(np.argmin(values[i:i + width])) for i in range(len(values) - width + 1)]
        assert rolling.leftmost_minimum(values, width).tolist() == want
    assert len(rolling.leftmost_minimum(values, 9)) == 0


def test_what_executors_get_stays_small():
    rolling.Hasher(np.zeros(3_000_000, dtype=np.uint8))
    assert len(cloudpickle.dumps(rolling.Hasher)) < 50_000
