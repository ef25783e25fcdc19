"""Targets against a loop that reshares excess, rates against a bisection, and the words that a mix takes."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from kithgraph.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(words: dict[str | None, int]) -> dict[str | None, float]:
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, goal, full = sum(words.values()), dict.fromkeys(words, 0.0), set()
    excess = float(total)
    while excess > 1e-9:
        free = [s for s in order if s not in full]
        share = sum(weight[s] for s in free)
        for s in free:
            goal[s] += excess * weight[s] / share
        excess = 0.0
        for s in free:
            if goal[s] >= 3 * words[s]:
                excess += goal[s] - 3 * words[s]
                goal[s] = 3.0 * words[s]
                full.add(s)
    return goal


def rows(seed=1):
    rng = random.Random(seed)
    sources = ["b", "a", "Z", "é", "z10", "z2", None, "", "tiny", "blank"]
    out = []
    for i in range(600):
        s = "b" if rng.random() < 0.4 else rng.choice(sources[:-2])
        out.append((i, " ".join(["w"] * int(rng.expovariate(1 / 60))), s))
    return out + [(700, "one two\x0bthree four", "tiny"), (701, None, "blank"), (702, "", "blank"), (703, "w " * 20000, "a"), (5, "w " * 9, "a"), (5, "w " * 9, "a"), (None, "w w", "b")]


def test_targets_rates_and_taken_words(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("copies", F.lit("clash")).withColumn("s", F.lit(1)).repartition(5)
    first = sorted(map(tuple, mixing.mix(docs).select("id", "size", "words", "target", "copies").collect()), key=str)
    again = sorted(map(tuple, mixing.mix(docs.repartition(2)).select("id", "size", "words", "target", "copies").collect()), key=str)
    assert first == again
    sizes = sorted(((d, len(WORD.findall(t or ""))) for d, t, _ in data), key=str)
    assert [r[:2] for r in sorted(first, key=lambda r: str((r[0], r[1])))] == sizes
    words = defaultdict(int)
    for _, t, s in data:
        words[s] += len(WORD.findall(t or ""))
    goals = brute_targets(dict(words))
    source = {(d, len(WORD.findall(t or ""))): s for d, t, s in data}
    taken = defaultdict(int)
    for d, size, own, target, copies in first:
        s = source[d, size]
        assert own == words[s] and math.isclose(target, goals[s], rel_tol=1e-9) and 0 <= copies <= 3
        taken[s] += size * copies
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= max(0.02 * goal, 30), (s, taken[s], goal)


def test_newton_finds_the_entropy_balanced_rates(spark):
    rng = random.Random(2)
    counts = [(s, z, rng.randint(1, 9)) for s in "abc" for z in range(0, 4000, 37)]
    words = {s: sum(n * z for q, z, n in counts if q == s) for s in "abc"}
    goals = spark.createDataFrame([(s, words[s], float(words[s] * f), words[s] / sum(n for q, _, n in counts if q == s))
                                   for s, f in (("a", 0.01), ("b", 2.97), ("c", 3.0))], "s string, words long, target double, mean double")
    found = {r["s"]: r for r in mixing.multipliers(spark.createDataFrame(counts, "s string, size long, n long"), goals).collect()}
    assert found["c"]["u"] is None
    for s in "ab":
        u, mean = found[s]["u"], found[s]["mean"]
        got = sum(n * z * 3 / (1 + 2 * math.exp(-u * z / mean)) for q, z, n in counts if q == s)
        assert math.isclose(got, found[s]["target"], rel_tol=1e-5)


def test_mixed_rows_repeat_as_often_as_taken(spark):
    docs = spark.createDataFrame(rows(3), "doc_id long, text string, source string").withColumn("whole", F.lit(0)).withColumn("size", F.lit("x"))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    want = {(r["id"], r["size"]): r["copies"] for r in mixing.mix(docs).collect()}
    got = defaultdict(int)
    for r in mixed.collect():
        got[r["doc_id"], len(WORD.findall(r["text"] or ""))] += 1
    twice = {(5, 9): 2}
    assert dict(got) == {k: c * twice.get(k, 1) for k, c in want.items() if c}


def test_empty_and_wordless_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).collect() == [] and mixing.mixed_rows(docs).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r["id"], r["size"], r["words"], r["target"]) for r in mixing.mix(blank).collect()} == {(1, 0, 0, 0.0), (2, 0, 0, 0.0)}
