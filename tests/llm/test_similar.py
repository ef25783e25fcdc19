"""Near-duplicates by shingles against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from kithgraph.llm import similar, simhash


def shingles(text: str | None, words: int = 5) -> set[tuple[str, ...]]:
    w = (text or "").lower().split()
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def similarity(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_first(rows: list[tuple[int, str | None]]) -> tuple[set[int], list[float]]:
    """Ids of the first texts of their groups, and the similarities of the pairs that link."""
    sets, label, linked = [shingles(t) for _, t in rows], list(range(len(rows))), []

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (s := similarity(sets[i], sets[j])) >= 0.8:
                linked.append(s)
                x, y = sorted((top(i), top(j)))
                label[y] = x
    return {rows[i][0] for i in range(len(rows)) if top(i) == i}, linked


def planted(seed: int) -> list[tuple[int, str | None]]:
    """Texts with copies of about 0.7 to 1, on a line that many of them share."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    line = rng.choices(vocabulary, k=30)
    texts: list[str | None] = [None, "", " \n", "one", "One", "a b c d e"]
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(40, 300)) + (line if rng.random() < 0.6 else [])
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append("  ".join(own))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("list_bound", [similar.LIST_BOUND, 2])
def test_agrees_with_all_pairs(documents, list_bound):
    rows = planted(5)
    want, linked = brute_first(rows)
    assert sum(0.8 <= s < 0.95 for s in linked) > 20
    got = similar.without_similar(documents(rows).repartition(4), list_bound=list_bound)
    assert {r["doc_id"] for r in got.collect()} == want


def test_the_stage_drops_copies_of_four_fifths(spark, documents):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(104)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:50] + ["x"] + base[51:80] + ["y"] + base[81:])), (3, " ".join(base[:90])), (4, " ".join(base[:60]))]
    assert [round(similarity(shingles(rows[0][1]), shingles(t)), 2) for _, t in rows[1:]] == [0.82, 0.86, 0.56]
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, documents(rows), "").collect()) == [1, 4]


def test_repeated_rows_and_an_empty_table(documents):
    assert similar.without_similar(documents([])).collect() == []
    assert sorted((r["doc_id"], r["text"]) for r in similar.without_similar(documents([(4, "a b"), (4, "a b"), (5, "A  b"), (6, "z")])).collect()) == [(4, "a b"), (6, "z")]


def test_bitmaps_never_rule_out_a_similar_pair():
    rng = random.Random(3)
    for n in (1, 9, 100, 900, 4000):
        a = np.array(rng.sample(range(1 << 62), n), dtype=np.uint64)
        b = np.concatenate([a[: n - n // 9], np.array(rng.sample(range(1 << 62), n // 9), dtype=np.uint64)])
        differ = similar.differing_bits(similar.bitmap(a), similar.bitmap(b))
        assert differ <= len(set(a.tolist()) ^ set(b.tolist())) <= 2 * n / 9


def test_bitmaps_of_two_lengths_and_of_strangers():
    rng = random.Random(4)
    a = np.array(rng.sample(range(1 << 62), 1100), dtype=np.uint64)
    assert len(similar.bitmap(a)) == 2 * len(similar.bitmap(a[:1000]))
    assert 0 < similar.differing_bits(similar.bitmap(a), similar.bitmap(a[:1000])) <= 100
    for n in (200, 3000, 20000):
        x, y = (np.array(rng.sample(range(1 << 62), n), dtype=np.uint64) for _ in range(2))
        assert similar.differing_bits(similar.bitmap(x), similar.bitmap(y)) > 2 * n / 9


def test_fingerprints_give_the_pairs_that_simhash_links(documents):
    rows = planted(12)
    docs = documents(rows).repartition(3)
    found = similar.prefixes(docs.selectExpr("doc_id AS id", "text"), 5)
    prints = {r["id"]: r["fp"] for r in found.collect()}
    want = {r["id"]: (r["fp"], r["component"]) for r in simhash.near_duplicates(docs, words=5).collect()}
    assert prints == {i: fp for i, (fp, _) in want.items()}
    group = {i: i for i, _ in rows}
    pairs = similar.simhash_pairs(found.select("id", "fp")).collect()
    for _ in rows:
        for r in pairs:
            group[r["a"]] = group[r["b"]] = min(group[r["a"]], group[r["b"]])
    assert group == {i: c for i, (_, c) in want.items()} and len(set(group.values())) < len(rows) - 5
    assert len({(r["a"], r["b"]) for r in pairs}) == len(pairs) and all(r["a"] < r["b"] for r in pairs)
