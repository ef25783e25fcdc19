"""Array helpers that run inside tasks: substring hashes of a byte buffer and word boundaries.

Substrings get a polynomial hash modulo 2**64 from prefix sums, so one pass over the bytes gives the hash of
any substring in constant time.  Such a hash only proposes; the operators that need certainty compare bytes.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1


class Powers:
    """BASE**i and BASE**-i modulo 2**64, kept as far as they were asked for.  A copy sent to an executor starts empty."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __reduce__(self):
        return Powers, ()

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """At least the first n of each."""
        if len(self.up) < n:
            size = max(1 << 20, 1 << int(n).bit_length())
            steps = np.full(size, BASE, dtype=np.uint64), np.full(size, pow(BASE, -1, 1 << 64), dtype=np.uint64)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up, self.down


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Hasher:
    """Substring hashes of one buffer."""

    def __init__(self, data: np.ndarray):
        up, self.down = POWERS.of(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of data[start:end], element by element."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def order(self, width: int) -> np.ndarray:
        """32 well-mixed bits for each substring of ``width`` bytes, to choose among substrings."""
        n = max(0, len(self.sums) - width)
        return (((self.sums[width:] - self.sums[:n]) * self.down[:n]) * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(32)


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` 32-bit values the position of its least value, the leftmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least = (values << np.uint64(32)) | np.arange(len(values), dtype=np.uint64)  # the position breaks ties
    reach = 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: reach - width], least[width - reach:])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def word_table(word_bytes: set[int]) -> bytes:
    """Translation that lower-cases A-Z and turns every byte outside ``word_bytes`` into a space."""
    lower = lambda b: b + 32 if 65 <= b <= 90 else b
    return bytes(lower(b) if lower(b) in word_bytes else 32 for b in range(256))
