"""Edited copies against brute force, and what a fingerprint must withstand."""

from __future__ import annotations

import hashlib
import random

from kithgraph.llm import chunks


def prose(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(["a", "be", "ché", "d ", "ü. ", "漢", "x\n"]) for _ in range(n))


def slow_gear(data: bytes) -> list[int]:
    out, h = [], 0
    for b in data:
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def test_gear_hash_is_the_rolling_one():
    import numpy as np

    data = prose(random.Random(1), 300).encode()
    assert chunks.gear(np.frombuffer(data, dtype=np.uint8)).tolist() == slow_gear(data)


def test_chunks_cover_the_text_within_bounds():
    data = prose(random.Random(2), 3000).encode()
    ends = chunks.boundaries(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and max(sizes) <= chunks.MOST and min(sizes[:-1]) >= chunks.LEAST
    assert 0.5 * chunks.NORMAL < sum(sizes) / len(sizes) < 3 * chunks.NORMAL
    flat = b"a" * 5000
    assert len(chunks.boundaries(flat)) < 5000 // chunks.LEAST + 1


def test_shift_and_containment():
    rng = random.Random(3)
    a = prose(rng, 4000).encode()
    whole = chunks.chunk_weights(a)
    assert chunks.containment(whole, chunks.chunk_weights(b"inserted words " + a)) > 0.97
    assert chunks.containment(whole, chunks.chunk_weights(prose(rng, 4000).encode())) < 0.05
    assert chunks.containment(whole, chunks.chunk_weights(prose(rng, 4000).encode() + a)) > 0.97
    assert sum(whole.values()) == len(a)


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for i, (d, t) in enumerate(order):
        t, follow = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        w, e, n = (chunks.chunk_weights(x.encode()) for x in (t, edited, follow))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), chunks.as_text(w), chunks.as_text(e), chunks.containment(w, e), chunks.containment(w, n)))
    return sorted(out, key=str)


def test_edited_copies_agree_with_brute_force(documents):
    rng = random.Random(4)
    rows = [(i * 7 % 101, prose(rng, rng.randint(0, 400))) for i in range(101)] + [(-5, None), (200, ""), (201, "x"), (202, "xy"), (203, "é" * 20000)]
    rows += [(50, "same id"), (50, "same id"), (None, "no id"), (None, None)]
    for bucket_rows in (3, 1000):
        got = sorted((tuple(r) for r in chunks.edited_copies(documents(rows).repartition(4), bucket_rows=bucket_rows).collect()), key=str)
        assert got == expected(rows)


def test_small_tables(documents):
    assert chunks.edited_copies(documents([])).collect() == []
    row = chunks.edited_copies(documents([(1, "only one row here")])).first()
    assert (row["near_next"], row["id"]) == (1.0, 1)
