"""The conversation trie against plain dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kithgraph.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, key string, level int, n int"


def remainder(c: int, m: int) -> int:
    return c - m * int(c / m)


def brute(rows: list[tuple]) -> list[tuple]:
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r[2], r[3]) for r in sorted(t)] for c, t in own.items()}
    members: dict[tuple, list] = {}
    ends: dict[tuple, list] = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        s = tuple(own.get(c - remainder(c, 5), [])[:h] + turns[h:])
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
        ends.setdefault(s, []).append(c)
    children: dict[tuple, int] = {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p],
             hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items()]


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def trie(df, **sizes):
    return tries.prefix_trie(*tries.inheriting(tries.numbered_turns(df)), **sizes)


def planted(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["", "a", "Ünd", "b" * 30, None, "x y", "x y ", "1"]
    rows: list[tuple] = []
    for c in rng.sample(range(-40, 120), 90):
        n = rng.choice([1, 2, 3, 5, 8, 12])
        rows += [(c, t, rng.choice(["user", "user", None]), rng.choice(texts[:rng.randint(1, 8)])) for t in range(n)]
    common = [("user", "hello"), ("bot", "hi"), ("user", "same"), ("bot", "again")]
    for c in range(200, 260):  # copies, and one very common start
        rows += [(c, t, *x) for t, x in enumerate(common[:rng.randint(1, 4)])] + ([(c, 9, "user", str(c))] if rng.random() < 0.3 else [])
    rows += [(300, t % 7, "user", str(t % 3)) for t in range(40)] + [(301, None, "user", "first"), (301, -1, "user", "second"), (301, None, None, None)]  # ties, nulls
    rows += [(None, 1, "user", "nobody"), rows[3], rows[3]] + [(400 + i, t, "u", str(t)) for i in range(3) for t in range(25)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,sizes", [(1, {}), (2, {"stretch": 3, "shard": 4, "packed_turns": 6, "piece": 2})])
def test_agrees_with_dictionaries(spark, seed, sizes):
    rows = planted(seed)
    assert in_order(trie(frame(spark, rows), **sizes).collect()) == in_order(brute(rows))


def test_empty_table_and_one_turnless_conversation(spark):
    none = frame(spark, [(1, 1, "u", "a")]).filter(F.lit(False))
    assert trie(none).collect() == []
    alone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    rows = [(alone, 1, "u", "lost")]  # its first turns are taken from a conversation that is not there
    assert [tuple(r) for r in trie(frame(spark, rows)).collect()] == brute(rows) and len(brute(rows)) == 1


def test_double_array_holds_what_it_packs():
    rng = random.Random(4)
    rows = sorted({tuple(rng.randint(1, 60) for _ in range(rng.randint(1, 6))) for _ in range(400)})
    packed = tries.packed([list(r) for r in rows])
    states = {}
    for r in rows:
        path = packed.walk(list(r))
        assert len(path) == len(r)
        for d in range(1, len(r) + 1):
            assert states.setdefault(path[d - 1], r[:d]) == r[:d]
    assert packed.walk([61]) == [] and len(packed.walk([*rows[0], 61])) == len(rows[0])
