"""SimHash components against brute force over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from kithgraph.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text: str | None, words: int = 4) -> int:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(lower)
    shingles = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints: list[tuple[int, int]], bits: int) -> dict[int, int]:
    label = {i: i for i, _ in prints}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in prints:
        for j, b in prints:
            if i < j and (a ^ b).bit_count() <= bits:
                x, y = sorted((top(i), top(j)))
                label[y] = x
    return {i: top(i) for i, _ in prints}


def corpus(seed: int = 3) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts: list[str | None] = [None, "", "  \t\n", "one", "One", "one two three", "$ % &", "x " * 5000, "é\x0bà\x85ü İ"]
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(30, 400))
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "  ", "\n"]).join(own))
    texts += texts[-5:]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("list_bound", [simhash.LIST_BOUND, 2])
def test_components_agree_with_all_pairs(documents, list_bound):
    rows = corpus()
    got = {r["id"]: r for r in simhash.near_duplicates(documents(rows).repartition(5), list_bound=list_bound).collect()}
    prints = [(i, brute_print(t)) for i, t in rows]
    assert {i: got[i]["fp"] & (1 << 64) - 1 for i in got} == dict(prints)
    assert {i: got[i]["component"] for i in got} == brute_components(prints, 4)


@pytest.mark.parametrize("bits,list_bound", [(2, 4096), (4, 4096), (4, 3), (6, 4096)])
def test_links_of_planted_fingerprints(spark, bits, list_bound):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = {int(b) for b in base}
    for b in base:
        for _ in range(20):
            values.add(int(b) ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 6), replace=False)))
    signed = [(v if v < 1 << 63 else v - (1 << 64),) for v in sorted(values)]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), bits, list_bound).collect()
    assert all(0 < ((e["a"] ^ e["b"]) & (1 << 64) - 1).bit_count() <= bits for e in edges)
    ids = {v: i for i, (v,) in enumerate(signed)}
    joined = {i: i for i in ids.values()}

    def top(i):
        while joined[i] != i:
            i = joined[i]
        return i

    for e in edges:
        x, y = sorted((top(ids[e["a"]]), top(ids[e["b"]])))
        joined[y] = x
    assert {i: top(i) for i in joined} == brute_components([(ids[v], v & (1 << 64) - 1) for (v,) in signed], bits)


def test_empty_table_and_repeated_rows(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    rows = sorted(tuple(r) for r in simhash.near_duplicates(documents([(4, "a b"), (4, "a b"), (None, "a b"), (None, "z")])).select("id", "component").collect() if r["id"])
    assert rows == [(4, 4), (4, 4)]


def test_unequal_bits_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 5)
