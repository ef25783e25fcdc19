"""Repeated strings against a dictionary of every string's first place."""

from __future__ import annotations

import random

import pytest

from kithgraph.llm import suffixes


def brute(rows, length):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    first, out = {}, []
    for k, (d, text) in enumerate(order):
        b = (text or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if first.setdefault(b[s:s + length], (k, s)) != (k, s):
                gone[s:s + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def make(seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdé ü\n") for _ in range(n))
    shared = [prose(n) for n in (99, 100, 101, 150, 400)]
    rows = [(1000, None), (1001, ""), (1002, "short"), (1003, "a" * 700), (1004, "xy" * 350), (1005, "a" * 160)]
    for i in range(30):
        text = prose(rng.randint(0, 120))
        for _ in range(rng.randint(0, 4)):
            piece = rng.choice(shared)
            cut = rng.randrange(len(piece))
            text += rng.choice([piece, piece, piece[cut:], piece[:cut]]) + prose(rng.randint(0, 60))
        rows.append((i * 13 % 97, text))
    copy = list(rows[-1][1])
    copy[len(copy) // 2:len(copy) // 2] = "Q"
    return rows + [(500, rows[-1][1]), (501, "".join(copy)), rows[8], (rows[9][0], "other " + rows[9][1]), (None, rows[10][1]), (None, None)]


@pytest.mark.parametrize("seed,length", [(1, 100), (2, 100), (3, 64)])
def test_agrees_with_brute_force(documents, seed, length):
    rows = make(seed)
    got = suffixes.cut_repeats(documents(rows).repartition(4), length=length).collect()
    assert sorted(((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=str) == brute(rows, length)


def test_unique_ids_and_a_very_long_text(documents):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdef ") for _ in range(60_000))
    rows = [(3, long), (4, long[20_000:20_500]), (5, long[::-1]), (1, long[:130])]
    got = suffixes.cut_repeats(documents(rows)).collect()
    assert sorted(((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=str) == brute(rows, 100)


def test_empty_table_and_bad_length(documents):
    assert suffixes.cut_repeats(documents([])).collect() == []
    with pytest.raises(ValueError):
        suffixes.cut_repeats(documents([]), length=20)
