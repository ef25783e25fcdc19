"""Contamination against a brute-force search of every window at every place."""

from __future__ import annotations

import random
import re

import pytest

from kithgraph.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for name, item in items:
            v = words(item)
            n = min(len(v), 10)
            for s in range(len(v) - n + 1) if n else []:
                for at in range(len(w) - n + 1):
                    if w[at:at + n] == v[s:s + n]:
                        hit |= set(range(at, at + n))
                        if name is not None:
                            ids.add(str(name))
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def make(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a", "été", "x1", "Zoë", "straße", "you", "no", "42"]
    some = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, rng.choice([" ", ", ", "\n"]).join(some(rng.choice([1, 2, 3, 5, 9, 10, 11, 14, 30])))) for i in range(14)]
    items += [(100, None), (101, ""), (102, "!?"), (3, items[3][1]), (None, "lonely item words here"), (7, "another text of the same item id seven eight nine ten eleven")]
    docs = [(200, None), (201, ""), (202, "?!"), (203, "the"), (204, "the " * 3000)]
    for i in range(40):
        parts = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            v = words(rng.choice(items)[1])
            low = rng.randrange(len(v) + 1)
            parts[len(parts) // 2:len(parts) // 2] = v[low:low + rng.randint(1, 15)]
        docs.append((i, " ".join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in parts)))
    docs.append((900, "Lonely ITEM, words... here"))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_brute_force(spark, documents, seed):
    docs, items = make(seed)
    docs = docs + [docs[-1], (5, "a second text of document five")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = decontaminate.contamination(documents(docs).repartition(3), bench).collect()
    assert sorted(((r["id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got), key=str) == brute(docs, items)


def test_very_long_passage_in_very_many_documents(spark, documents):
    passage = " ".join(f"w{i * i % 97}x{i}" for i in range(400))
    docs = [(i, f"before{i} {passage} after{i}") for i in range(60)]
    got = decontaminate.contamination(documents(docs), spark.createDataFrame([("q", passage), ("r", passage + " more")], "item_id string, text string")).collect()
    assert {(r["n_words"], r["n_hit"], tuple(r["items"])) for r in got} == {(402, 400, ("q", "r"))}


def test_empty_sides(spark, documents):
    no_items = spark.createDataFrame([], "item_id int, text string")
    assert [tuple(r) for r in decontaminate.contamination(documents([(1, "a b")]), no_items).collect()] == [(1, 2, 0, [])]
    assert decontaminate.contamination(documents([]), spark.createDataFrame([(1, "a b")], "item_id int, text string")).collect() == []


def test_clean_rows_stay_whole(spark, documents):
    docs = documents([(1, "a clean text"), (2, "it holds one two three leaks"), (None, None)])
    left = decontaminate.without_contaminated(docs, spark.createDataFrame([(1, "One two, three")], "item_id int, text string"))
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {1, None}
