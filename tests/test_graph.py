from __future__ import annotations

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithgraph.operators import neighbours, paths, streaks, traversal, vectors
from kithgraph.session import shared_dir
from kithgraph.sources import sinks

EDGE = "src_label string, src string, rel string, dst_label string, dst string, seen_at timestamp"


def edge_frame(spark, rows):
    return spark.createDataFrame([(a[0], a, rel, b[0], b, None) for a, rel, b in rows], EDGE)


def test_related_nodes_are_the_nodes_within_k_hops(spark):
    rnd = random.Random(3)
    ids = [f"{c}{i}" for c in "ABC" for i in range(6)]
    rows = sorted({(rnd.choice(ids), "R", rnd.choice(ids)) for _ in range(25)})
    near = defaultdict(set)
    for a, _, b in rows:
        near[a].add(b)
        near[b].add(a)
    edges = edge_frame(spark, rows)
    types = [tuple(r) for r in edges.select("src_label", "rel", "dst_label").distinct().collect()]
    starts = spark.createDataFrame([(i,) for i in ids if i[0] == "A"], "id string")
    for depth in (1, 2, 3):
        want = set()
        for s in (i for i in ids if i[0] == "A"):
            seen, level = {s}, {s}
            for _ in range(depth):
                level = {n for x in level for n in near[x]} - seen
                seen |= level
            want |= {(s, n) for n in seen - {s} if n[0] == "B"}
        plain = traversal.related_nodes(edges, starts, ["B"], depth)
        guided = traversal.related_nodes(edges, starts, ["B"], depth, ["A"], types)
        assert {(r["start"], r["id"]) for r in plain.collect()} == want
        assert {(r["start"], r["id"]) for r in guided.collect()} == want


def test_ego_nodes_only_read_edges_of_the_centers_labels(spark):
    def part(rel, rows):
        a, b = rows[0][0][0], rows[0][1][0]
        return spark.createDataFrame([(x, y, None) for x, y in rows], "src string, dst string, seen_at timestamp").select(
            F.lit(a).alias("src_label"), "src", F.lit(rel).alias("rel"), F.lit(b).alias("dst_label"), "dst", "seen_at")

    edges = part("R", [("A1", "B1"), ("A2", "B1")]).unionByName(part("UNUSED", [("C1", "D1")])).unionByName(part("S", [("B1", "C1")]))
    centers = spark.createDataFrame([("B1", "B"), ("B2", "B")], "id string, label string")
    got = traversal.ego_nodes(edges, centers, ["B"])
    assert {(r["center"], r["id"]) for r in got.collect()} == {("B1", "B1"), ("B1", "A1"), ("B1", "A2"), ("B1", "C1"), ("B2", "B2")}
    assert "UNUSED" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in got._jdf.queryExecution().optimizedPlan().toString()


def trails(rows, start, hops):
    out, frontier = [], [(start, ())]
    for _ in range(hops):
        grown = []
        for node, used in frontier:
            for e in rows:
                key = "|".join(e)
                if key in used:
                    continue
                for here, there in {(e[0], e[2]), (e[2], e[0])}:
                    if here == node:
                        grown.append((there, used + (key,)))
        frontier = grown
        out += [(start, n, p) for n, p in grown]
    return out


@pytest.mark.parametrize("candidates", [None, 5])
def test_paths_never_reuse_an_edge(spark, candidates):
    rows = [("A1", "R", "B1"), ("A1", "R", "B2"), ("B1", "R", "C1"), ("B2", "R", "C1"), ("C1", "R", "A2"), ("A2", "R", "A2"), ("A2", "R", "B3")]
    edges = edge_frame(spark, rows)
    starts = spark.createDataFrame([("A1",), ("A2",)], "id string")
    got = paths.enumerate_paths(edges, starts, ["B", "C"], ["R"], 3, candidates)
    have = {(r["start"], r["target"], tuple(r["edge_ids"])) for r in got.collect()}
    want = set()
    for s in ("A1", "A2"):
        mine = sorted({t for t in trails(rows, s, 3) if t[1][0] in "BC"}, key=lambda t: (len(t[2]), ">".join(t[2])))
        want |= set(mine[:candidates] if candidates else mine)
    assert have == want


def test_guided_paths_equal_plain_ones(spark):
    rows = [("A1", "R", "B1"), ("B1", "S", "C1"), ("A2", "R", "B1"), ("C1", "S", "D1"), ("D1", "X", "A1")]
    edges = edge_frame(spark, rows)
    starts = spark.createDataFrame([("A1",)], "id string")
    types = [(a[0], r, b[0]) for a, r, b in rows]
    plain = paths.enumerate_paths(edges, starts, ["C", "A"], ["R", "S"], 4)
    guided = paths.enumerate_paths(edges, starts, ["C", "A"], ["R", "S"], 4, start_labels=["A"], edge_types=types)
    assert {tuple(r["edge_ids"]) for r in plain.collect()} == {tuple(r["edge_ids"]) for r in guided.collect()}


def test_bounded_search_writes_compressed_tables_only(spark):
    """Edges and trails of a bounded search grow with the input; plain checkpoints of them took most of its disk."""
    rows = [("A1", "R", f"B{i}") for i in range(3)] + [("A2", "R", "B1"), ("C1", "R", "B2")]
    starts = spark.createDataFrame([("A1",), ("A2",)], "id string")
    kept = lambda: {f for _, folders, _ in os.walk(shared_dir(spark)) for f in folders if f.startswith("rdd-")}
    before = (shared_dir(spark), kept())[1]
    got = paths.enumerate_paths(edge_frame(spark, rows), starts, ["B", "C"], ["R"], 3, 3).collect()
    assert kept() == before
    for s in ("A1", "A2"):
        want = sorted({t for t in trails(rows, s, 3) if t[1][0] in "BC"}, key=lambda t: (len(t[2]), ">".join(t[2])))[:3]
        mine = sorted((r for r in got if r["start"] == s), key=lambda r: r["candidate"])
        assert [r["candidate"] for r in mine] == [1, 2, 3]
        assert [(r["start"], r["target"], tuple(r["edge_ids"])) for r in mine] == want


def test_longest_runs_over_many_chunks(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(4)}", i, rnd.random() < 0.8) for i in range(600)]
    want = {}
    for key in {r[0] for r in rows}:
        best = run = 0
        for _, _, flag in sorted((r for r in rows if r[0] == key), key=lambda r: -r[1]):
            run = run + 1 if flag else 0
            best = max(best, run)
        want[key] = best
    got = streaks.longest_runs(spark.createDataFrame(rows, "k string, i int, f boolean"), "k", [F.desc("i")], F.col("f"))
    assert {r["k"]: r["longest_run"] for r in got.collect()} == want


def test_neighbours_are_exact_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "QUERY_CHUNK", 24)
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(4, 6)) * 3
    x = np.concatenate([centers[0] + rng.normal(size=(70, 6)) * 0.2, centers[1:].repeat(10, axis=0) + rng.normal(size=(30, 6)), np.zeros((3, 6))])
    ids = [f"v{i:03d}" for i in range(len(x))]
    frame = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in zip(ids, x)], "id string, vector array<double>")
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    sims = np.round(unit @ unit.T, 12)
    want = {}
    for i, name in enumerate(ids):
        ranked = sorted(((sims[i, j], ids[j]) for j in range(len(ids)) if j != i), reverse=True)[:4]
        want[name] = [n for _, n in ranked]
    got = defaultdict(dict)
    for r in neighbours.nearest(frame, frame, 4, not_self=True).collect():
        got[r["query"]][r["position"]] = r["id"]
    assert {q: [p[k] for k in sorted(p)] for q, p in got.items()} == want


def test_neighbours_are_sent_to_few_blocks(spark, monkeypatch):
    """Vectors without clusters meet every block, so blocks grow with the vectors up to a bound; copies tie and the larger id wins."""
    seen = []
    visit = neighbours._visit
    monkeypatch.setattr(neighbours, "_visit", lambda asked, blocks, *more: (seen.append((asked.count(), blocks.count())), visit(asked, blocks, *more))[1])
    for name, size in (("BLOCK", 8), ("QUERY_CHUNK", 8), ("MAX_BLOCK", 64), ("BLOCKS", 4), ("SLICE", 32)):
        monkeypatch.setattr(neighbours, name, size, raising=False)
    x = np.random.default_rng(2).normal(size=(200, 24))
    x[150:] = x[:50]
    ids = [f"v{i:03d}" for i in range(len(x))]
    frame = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in zip(ids, x)], "id string, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 12)
    got = defaultdict(dict)
    for r in neighbours.nearest(frame, frame, 3, not_self=True).collect():
        got[r["query"]][r["position"]] = r["id"]
    for i, name in enumerate(ids):
        want = [n for _, n in sorted(((sims[i, j], ids[j]) for j in range(len(ids)) if j != i), reverse=True)[:3]]
        assert [got[name][p] for p in (1, 2, 3)] == want
    assert all(sent <= 8 * len(x) for pair in seen for sent in pair)


def test_neighbours_of_other_queries(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    rng = np.random.default_rng(2)
    data, asked = rng.normal(size=(40, 3)), rng.normal(size=(9, 3))
    make = lambda p, m: spark.createDataFrame([(f"{p}{i:02d}", [float(a) for a in v]) for i, v in enumerate(m)], "id string, vector array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    best = (unit(asked) @ unit(data).T).argmax(axis=1)
    got = {r["query"]: r["id"] for r in neighbours.nearest(make("q", asked), make("d", data), 1).collect()}
    assert got == {f"q{i:02d}": f"d{j:02d}" for i, j in enumerate(best)}


def test_components_match_union_find(spark):
    rnd = random.Random(11)
    names = [f"n{i:03d}" for i in range(120)]
    rows = [(rnd.choice(names), rnd.choice(names)) for _ in range(70)] + [("n000", n) for n in names[90:]] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(20, 60)]
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in rows:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = vectors.connected_components(spark.createDataFrame(rows, "a string, b string"), spark.createDataFrame([(n,) for n in names], "id string"))
    assert {r["id"]: r["component"] for r in got.collect()} == {n: find(n) for n in names}


NODE_UPDATE = "label string, id string, props map<string,string>, source_uri string, ts timestamp, seq bigint, user string"


def test_upsert_is_idempotent_and_keeps_first_and_last(spark):
    from datetime import datetime as d

    rows = [("Person", "p", {"a": "1", "b": "x"}, "s1", d(2024, 1, 1), 1, "ann"), ("Person", "p", {"a": None, "b": "y"}, "s2", d(2024, 1, 3), 1, "bob"),
            ("Person", "p", {"a": "2", "id": "no"}, "s3", d(2024, 1, 2), 1, "cas"), ("Person", "q", {}, "", d(2024, 1, 2), 1, "cas")]
    updates = spark.createDataFrame(rows, NODE_UPDATE)
    once = sinks.upsert_nodes(sinks.empty_items(spark, sinks.NODE_KEY), updates)
    twice = sinks.upsert_nodes(once, updates)
    row = once.collect()
    assert len(row) == 1 and row[0]["props"] == {"a": "2", "b": "y"}
    assert (row[0]["source_uri"], row[0]["created_by"], row[0]["updated_by"], row[0]["created_at"].day, row[0]["updated_at"].day) == ("s1", "ann", "bob", 1, 3)
    assert [r.asDict() for r in twice.collect()] == [r.asDict() for r in row]
    assert sinks.without_source(updates).count() == 1


def test_edges_need_both_ends_and_unlabelled_ends_match_all(spark):
    nodes = spark.createDataFrame([("Person", "1"), ("Org", "1"), ("Org", "2")], "label string, id string")
    rows = [(None, "1", "R", "Org", "2", {}, "s", None, 1, "u"), ("Person", "1", "R", "Org", "9", {}, "s", None, 1, "u")]
    updates = spark.createDataFrame(rows, "src_label string, src string, rel string, dst_label string, dst string, props map<string,string>, source_uri string, ts timestamp, seq bigint, user string")
    got = sinks.upsert_edges(sinks.empty_items(spark, sinks.EDGE_KEY), updates, nodes)
    assert {(r["src_label"], r["src"], r["dst_label"], r["dst"]) for r in got.collect()} == {("Person", "1", "Org", "2"), ("Org", "1", "Org", "2")}


def test_component_rounds_are_kept_as_compressed_tables(spark, monkeypatch):
    from kithgraph.operators import vectors

    monkeypatch.setattr(vectors, "cut_lineage", None)
    rows = [(f"n{i}", f"n{i + 1}") for i in range(0, 9)] + [("m1", "m2"), ("m2", "m1"), ("m3", "m3")]
    got = vectors.connected_components(spark.createDataFrame(rows, "a string, b string"))
    assert {(r["id"], r["component"]) for r in got.collect()} == {*((f"n{i}", "n0") for i in range(10)), ("m1", "m1"), ("m2", "m1")}
