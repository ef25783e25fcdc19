"""Indexed and cut-down forms against the plain ones, on data with many ties and frequent values."""

from __future__ import annotations

import math
import random
import re
from difflib import SequenceMatcher
from itertools import product

import pytest

from kithgraph import model
from kithgraph.operators import alerts, alike, paths, resolve, search


def norm(x):
    return (x or "").strip().lower() or None


def tokens(x):
    return re.sub("[_-]", " ", norm(x) or "").split()


def ratio(a, b):
    a, b = norm(a), norm(b)
    if a is None or b is None:
        return 0.0
    direct = SequenceMatcher(None, a, b).ratio()
    return max(direct, SequenceMatcher(None, " ".join(sorted(tokens(a))), " ".join(sorted(tokens(b)))).ratio()) if tokens(a) and tokens(b) else direct


def names(seed, n):
    rnd = random.Random(seed)
    parts = ["ann", "anna", "smith", "smyth", "o-neil", "Li", "x", "aab", "baa", "customer#0001", "customer#0011", "Ünal"]
    return [rnd.choice(["", " "]) + rnd.choice([" ", "_", "-"]).join(rnd.choices(parts, k=rnd.randint(1, 3))) for _ in range(n)] + ["", "  ", "--", "a"]


@pytest.mark.parametrize("least", [0.7, 0.85, 0.97, 1.0])
def test_alike_finds_every_pair(spark, least):
    left, right = names(1, 40), names(2, 60)
    frames = [spark.createDataFrame([(v,) for v in x], "value string") for x in (left, right)]
    want = {(a, b): round(ratio(a, b), 9) for a, b in product(set(left), set(right)) if ratio(a, b) >= least}
    got = {(r["left"], r["right"]): round(r["sim"], 9) for r in alike.alike(*frames, least).collect()}
    assert got == want


@pytest.mark.parametrize("bound", [0, 10_000])
def test_contained_and_alike(spark, bound):
    left, right = names(3, 40), names(4, 60)
    frames = [spark.createDataFrame([(v,) for v in x], "value string") for x in (left, right)]
    want = {(a, b) for a, b in product(set(left), set(right)) if ratio(a, b) >= 0.7 and (a.lower() in b.lower() or any(t in b.lower() for t in tokens(a)))}
    assert {(r["left"], r["right"]) for r in alike.contained_alike(*frames, 0.7, bound).collect()} == want


PERSON = ("name", "email", "phone", "org_id", "org_name", "org_domain")


def people(seed, n, prefix):
    rnd = random.Random(seed)
    pool = {"name": ["Ann Lee", "Ann Li", "Anne Lee", "Bob", "Bobby", "Zoe Q", None], "phone": ["12345", "12346", None, None], "org_id": ["o1", "o2", None], "org_name": ["Acme", "Acne", None],
            "email": ["a@hot.com", "b@hot.com", "c@hot.com", "d@hot.co", None, None], "org_domain": ["hot.com", "cold.org", None]}
    return [(f"{prefix}{i:03d}", *(rnd.choice(pool[f]) for f in PERSON)) for i in range(n)]


def domain(x):
    return norm(x).split("@")[-1] if norm(x) else None


def brute_people(mentions, candidates, context, offered, limits):
    weights, bonus = model.RESOLUTION_RULES["person"], model.CONTEXT_BONUS["person"]

    def least(key):
        return model.threshold("person", f"{key}_similarity")

    def sim(a, b, key):
        return r if (r := ratio(a, b)) >= least(key) else 0.0

    out = {}
    for mid, *m in mentions:
        m = dict(zip(PERSON, m))
        scored = []
        for cid, *c in candidates:
            c = dict(zip(PERSON, c))
            tail, low = domain(m["email"]), (c["name"] or "").lower()
            named = m["name"] is not None and c["name"] is not None and (m["name"].lower() in low or any(t in low for t in tokens(m["name"])))
            if not (named or m["email"] and norm(c["email"]) == norm(m["email"]) or m["phone"] and c["phone"] == m["phone"]
                    or tail and ((c["email"] or "").lower().endswith(tail) or (c["org_domain"] or "").lower().endswith(tail))):
                continue
            mail, phone, name = sim(m["email"], c["email"], "email"), sim(m["phone"], c["phone"], "phone"), sim(m["name"], c["name"], "name")
            org = sim(m["org_id"], c["org_id"], "org") or sim(m["org_name"], c["org_name"], "org")
            own = sim(domain(m["email"]), domain(c["email"]) or domain(c["org_domain"]), "domain")
            base = mail * weights["email_score"] + phone * weights["phone_score"] + own * weights["domain_score"]
            base += weights["name_org_score"] * max(name, org) if name and org else weights["name_only_score"] * name
            kinds = {k for k, v in context.get(mid, []) for k2, v2 in offered.get(cid, []) if k == k2 and ratio(v, v2) >= least(k)}
            kinds |= {"org" for a in (m["org_id"], m["org_name"]) for b in (c["org_id"], c["org_name"]) if ratio(a, b) >= least("org")}
            kinds |= {"domain" for a in (m["email"], m["org_domain"]) for b in (c["email"], c["org_domain"]) if ratio(domain(a), domain(b)) >= least("domain")}
            score = base + sum(bonus[k] for k in kinds)
            if score >= limits["candidate_floor"]:
                scored.append((-round(score, 9), cid))
        out[mid] = sorted(scored)[:int(limits["max_alternates"]) + 1]
    return out


def test_people_resolve_as_if_all_pairs_were_scored(spark):
    mentions, candidates = people(5, 25, "t"), people(6, 70, "p")
    rnd = random.Random(7)
    values = {"project": ["Apollo", "Zeus", "apolo"], "document": ["plan", "note"], "location": ["Rome", "Oslo"]}

    def contexts(ids, share):
        return {i: [(k, rnd.choice(v)) for k, v in values.items() if rnd.random() < share] for i in ids}

    asked, offered = contexts([m[0] for m in mentions], 0.7), contexts([c[0] for c in candidates], 0.7)
    columns = ", ".join(f"{f} string" for f in PERSON)
    m = spark.createDataFrame([(*r, r[0]) for r in mentions], f"temp_id string, {columns}, context_id string")
    c = spark.createDataFrame(candidates, f"id string, {columns}")
    rows = [spark.createDataFrame([(i, k, v) for i, kv in side.items() for k, v in kv], f"{name} string, kind string, value string") for side, name in ((asked, "context_id"), (offered, "id"))]
    got = {r["temp_id"]: [(-round(x["score"], 9), x["id"]) for x in r["identity_candidates"]] for r in resolve.resolve(m, c, "person", *rows).collect()}
    assert got == brute_people(mentions, candidates, asked, offered, model.RESOLUTION_LIMITS)


def test_ids_are_kept_apart_by_preview_and_history_grows(spark):
    m = spark.createDataFrame([("one", "t", "Acme"), ("two", "t", "Zeta"), ("two", "t", "Zeta")], "preview string, temp_id string, name string")
    c = spark.createDataFrame([("o1", "Acme"), ("o2", "Zeta")], "id string, name string")
    done = resolve.resolve(m, c, "org")
    edges = spark.createDataFrame([("one", "t", "x"), ("two", "x", "t")], "preview string, src string, dst string")
    got = resolve.rewrite(edges, resolve.id_map(done), ["src", "dst"]).collect()
    assert {(r["preview"], r["src"], r["dst"]) for r in got} == {("one", "o1", "x"), ("two", "x", "o2")} and len(got) == 2
    again = resolve.resolve(done.select("preview", "temp_id", "name", "identity_history"), c, "org").collect()
    assert [[h["status"] for h in r["identity_history"]] for r in again] == [["resolved", "resolved"]] * 3


def test_paths_between_meet_in_the_middle(spark):
    rnd = random.Random(8)
    nodes = [f"n{i}" for i in range(9)]
    edges = sorted({("A", a, "R", "A", b) for a, b in ((rnd.choice(nodes), rnd.choice(nodes)) for _ in range(16)) if a != b})
    ids = {e: f"{e[1]}|R|{e[4]}" for e in edges}
    pairs = [("n0", "n3"), ("n1", "n1"), ("n2", "n8"), ("n5", "n0"), ("n0", "nowhere")]
    want = {}
    for start, target in pairs:
        trails, grown = [], [([], start)]
        for hop in range(1, 5):
            grown = [(t + [ids[e]], b) for t, at in grown for e in edges for a, b in {(e[1], e[4]), (e[4], e[1])} if a == at and ids[e] not in t]
            trails += [(hop, ">".join(t)) for t, at in grown if at == target]
        want[start, target] = sorted(trails)[:6]
    df = spark.createDataFrame([(*e, None) for e in edges], "src_label string, src string, rel string, dst_label string, dst string, seen_at timestamp")
    got = paths.paths_between(df, spark.createDataFrame(pairs, "start string, target string"), ["R"], 4, 6).collect()
    found = {p: [] for p in pairs}
    for r in got:
        found[r["start"], r["target"]].append((r["hops"], ">".join(r["edge_ids"])))
        assert (r["node_ids"][0], r["node_ids"][-1], len(r["node_ids"])) == (r["start"], r["target"], r["hops"] + 1)
    assert {p: sorted(t) for p, t in found.items()} == want


def test_paths_between_hold_parallel_edges_and_few_candidates(spark):
    rnd = random.Random(12)
    nodes = [f"n{i}" for i in range(5)]
    edges = sorted({(rnd.choice(nodes), f"R{rnd.randint(0, 9)}", rnd.choice(nodes)) for _ in range(45)})
    pairs = [(a, b) for a in nodes for b in nodes]
    df = spark.createDataFrame([("A", a, r, "A", b, None) for a, r, b in edges], "src_label string, src string, rel string, dst_label string, dst string, seen_at timestamp")
    around = [(a, b, "|".join(e)) for e in edges for a, b in {(e[0], e[2]), (e[2], e[0])}]
    want = set()
    for start, target in pairs:
        grown, trails = [([], start)], []
        for hop in range(1, 5):
            grown = [(t + [i], b) for t, at in grown for a, b, i in around if a == at and i not in t]
            trails += [(hop, ">".join(t)) for t, at in grown if at == target]
        want |= {(start, target, *t) for t in sorted(trails)[:40]}
    got = paths.paths_between(df, spark.createDataFrame(pairs, "start string, target string"), [f"R{i}" for i in range(10)], 4, 40).collect()
    assert len(got) == len(want) and {(r["start"], r["target"], r["hops"], ">".join(r["edge_ids"])) for r in got} == want


def test_paths_between_walk_no_hub_for_every_start(spark, monkeypatch):
    sizes = []
    cut = paths.cut_lineage

    def counted(df):
        done = cut(df)
        sizes.append(done.count())
        return done

    monkeypatch.setattr(paths, "cut_lineage", counted)
    n = 60
    edges = [("A", f"{side}{i}", "R", "H", "hub", None) for side in "st" for i in range(n)]
    df = spark.createDataFrame(edges, "src_label string, src string, rel string, dst_label string, dst string, seen_at timestamp")
    pairs = spark.createDataFrame([(f"s{i}", f"t{i}") for i in range(n)] + [(f"s{i}", f"none{i}") for i in range(n)], "start string, target string")
    got = paths.paths_between(df, pairs, ["R"], 4, 15).collect()
    assert len(got) == n and {r["hops"] for r in got} == {2} and max(sizes) <= 4 * n


@pytest.mark.parametrize("depth", [1, 3])
def test_search_reads_no_further_than_needed_and_loses_nothing(spark, depth):
    rnd = random.Random(9)
    rows = [(f"id{i:03d}", "L", " ".join(rnd.choices(["hot", "hot", "hot", "warm", "rare", f"w{i % 7}"], k=rnd.randint(1, 4)))) for i in range(160)] + [("none", "L", None)]
    asked = ["hot", "hot warm", "warm rare hot", "w1 hot", "nothing", "rare"]
    named = [(i, n.split()) for i, _, n in rows if n]
    df = {t: sum(t in words for _, words in named) for t in {t for _, words in named for t in words}}
    average = sum(len(w) for _, w in named) / len(named)

    def score(words, query):
        return sum(math.log(1 + (len(named) - df[t] + 0.5) / (df[t] + 0.5)) * words.count(t) * 2.2 / (words.count(t) + 1.2 * (0.25 + 0.75 * len(words) / average))
                   for t in set(query.split()) if t in words)

    want = {q: [(i, round(s, 7)) for s, i in sorted(((-round(score(w, q), 9), i) for i, w in named if score(w, q) > 0))][:depth] for q in asked}
    nodes, queries = spark.createDataFrame(rows, "id string, label string, name string"), spark.createDataFrame([(q,) for q in asked], "query string")
    got = {q: [] for q in asked}
    for r in search.search(nodes, queries, depth).orderBy("query", "position").collect():
        got[r["query"]].append((r["id"], -round(r["score"], 7)))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    totals = {r["query"]: r["total"] for r in search.matches(nodes, queries).collect()}
    assert totals == {q: n for q in asked if (n := sum(bool(set(q.split()) & set(w)) for _, w in named))}


@pytest.mark.parametrize("page", [1, 3, 4, 9])
def test_pages(spark, page):
    rows = [(f"a{i:02d}", i % 5) for i in range(33)]
    df = spark.createDataFrame(rows, "id string, first_detected_at int").withColumnRenamed("first_detected_at", "k")
    got = alerts.page_of(df, (df["k"].desc(), df["id"].asc()), page, 10).orderBy("position").collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))[10 * (page - 1):10 * page]
    assert [(r["id"], r["k"]) for r in got] == want and all((r["total"], r["total_pages"]) == (33, 4) for r in got)


def test_values_held_as_a_whole_need_no_pieces(spark, monkeypatch):
    left, right = [f"{a}_{b}{i}" for i in range(8) for a, b in (("Customer#0", "x"), (" anna", "O-Neil"))] + ["İX", "abc"], names(11, 40) + ["xabcx", "abcd", "i̇x", "Customer#0_x3 "]
    frames = [spark.createDataFrame([(v,) for v in x], "value string") for x in (left, right + left)]
    for whole, least in ((64, 0.7), (64, 0.95), (5, 0.7)):
        monkeypatch.setattr(alike, "WHOLE", whole)
        want = {(a, b) for a, b in product(left, {*right, *left}) if ratio(a, b) >= least and (a.lower() in b.lower() or any(t in b.lower() for t in tokens(a)))}
        assert {(r["left"], r["right"]) for r in alike.contained_alike(*frames, least).collect()} == want
    monkeypatch.setattr(alike, "WHOLE", 64)
    monkeypatch.setattr(alike, "piece_index", None)  # single words ask for no index of the names
    plain = [spark.createDataFrame([(f"customer#{i:03d}",) for i in x], "value string") for x in (range(0, 40, 2), range(40))]
    assert {(r["left"], r["right"]) for r in alike.contained_alike(*plain, 0.85).collect()} == {(f"customer#{i:03d}",) * 2 for i in range(0, 40, 2)}


def test_equal_contexts_form_no_other_pairs_of_values(spark, monkeypatch):
    pairs = spark.createDataFrame([("m1", "c1"), ("m2", "c1"), ("m2", "c2")], "profile string, signature string")
    asked = spark.createDataFrame([("m1", "project", "Big Plan"), ("m2", "org", "o1"), ("m2", "project", "--"), ("m2", "project", "none")], "profile string, kind string, value string")
    offered = spark.createDataFrame([("c1", "a", "project", "plan_big"), ("c1", "a", "project", "plan"), ("c1", None, "org", " O1 "), ("c1", "a", "location", "o1"), ("c2", "b", "project", "--")],
                                    "signature string, id string, kind string, value string")
    want = {("m1", "c1", "a", ("project",)), ("m2", "c1", None, ("org",)), ("m2", "c2", "b", ("project",))}
    strict = {"person": {f"{k}_similarity": 1.0 for k in ("project", "document", "location", "domain", "org")}}

    def hits(thresholds):
        return {(r["profile"], r["signature"], r["id"], tuple(r["kinds"])) for r in resolve.context_hits(pairs, asked, offered, "person", thresholds).collect()}

    assert hits({"person": {**strict["person"], "project_similarity": 0.99}}) == want
    monkeypatch.setattr(resolve, "graded", None)  # nothing is compared
    assert hits(strict) == want


@pytest.mark.parametrize("hub, chunk", [(0, 64), (2, 1), (4, 2)])
def test_paths_between_meet_at_hubs_and_elsewhere(spark, monkeypatch, hub, chunk):
    monkeypatch.setattr(paths, "HUB", hub, raising=False)
    monkeypatch.setattr(paths, "CHUNK", chunk, raising=False)
    rnd = random.Random(21)
    nodes = [f"n{i}" for i in range(12)]
    edges = sorted({(rnd.choice(nodes[:3] if rnd.random() < 0.4 else nodes), f"R{rnd.randint(0, 1)}", rnd.choice(nodes)) for _ in range(26)})
    pairs = [(a, b) for a in nodes[:6] for b in nodes[3:9]]
    around = [(a, b, "|".join(e)) for e in edges for a, b in {(e[0], e[2]), (e[2], e[0])}]
    want = set()
    for start, target in pairs:
        grown, trails = [([], start)], []
        for hop in range(1, 5):
            grown = [(t + [i], b) for t, at in grown for a, b, i in around if a == at and i not in t]
            trails += [(hop, ">".join(t)) for t, at in grown if at == target]
        want |= {(start, target, *t) for t in sorted(trails)[:8]}
    df = spark.createDataFrame([("A", a, r, "A", b, None) for a, r, b in edges] + [("A", "n1", "R0", "A", None, None), ("A", None, "R0", "A", "n4", None)],
                               "src_label string, src string, rel string, dst_label string, dst string, seen_at timestamp")
    got = paths.paths_between(df, spark.createDataFrame(pairs, "start string, target string"), ["R0", "R1"], 4, 8).collect()
    assert len(got) == len(want) and {(r["start"], r["target"], r["hops"], ">".join(r["edge_ids"])) for r in got} == want
