from __future__ import annotations

import json
import random
from collections import Counter
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithgraph import model
from kithgraph.operators import beliefs, concepts, feedback, policy, resolve
from kithgraph.streaming import memory, routing

SAMPLES = [("materialised", {"path_length": 4.0, "recency": 0.9, "commitment_age": 20.0}), ("materialised", {"path_length": 3.0, "recency": 0.8, "commitment_age": 18.0}),
           ("acknowledged", {"path_length": 2.0, "recency": 0.5}), ("acknowledged", {"path_length": 2.0, "recency": 0.4, "sentiment_slope": 0.1}),
           ("false_positive", {"path_length": 1.0, "recency": 0.1}), ("false_positive", {"path_length": 1.0, "recency": 0.2, "edge_type::made": 1.0})]


def brute_training(rows, epochs=300):
    names = sorted({k for _, f in rows for k in f})
    x = np.array([[f.get(n, 0.0) for n in names] + [1.0] for _, f in rows])
    out = {}
    for o in model.OUTCOMES:
        y, w = np.array([float(r[0] == o) for r in rows]), np.zeros(x.shape[1])
        for _ in range(epochs):
            grad = (1 / (1 + np.exp(-x @ w)) - y) @ x / len(rows)
            w = w - 0.08 * (grad + 0.001 * np.append(w[:-1], 0.0))
        out[o] = dict(zip(names + ["(b)"], w))
    return out


def test_training_equals_plain_gradient_descent(spark, monkeypatch):
    rows = SAMPLES + SAMPLES[:3]
    frame = spark.createDataFrame(rows, "outcome string, features map<string,double>")
    want = brute_training(rows)
    for per_task, epochs in ((20_000, 300), (2, 12)):
        monkeypatch.setattr(policy, "ROWS_PER_TASK", per_task)
        got = policy.train(frame, epochs=epochs)
        want = brute_training(rows, epochs)
        for o in model.OUTCOMES:
            assert abs(got.intercepts[o] - want[o]["(b)"]) < 1e-9
            assert all(abs(got.weights[o][k] - want[o][k]) < 1e-9 for k in got.weights[o])
    assert got.trained and not policy.Policy().trained


def test_mllib_fit_ranks_like_the_parity_fit(spark):
    frame = spark.createDataFrame(SAMPLES, "outcome string, features map<string,double>")
    fitted = policy.train_with_mllib(frame)
    scored = policy.evaluate(frame, fitted).collect()
    assert min(r["score"] for r in scored if r["outcome"] == "materialised") > max(r["score"] for r in scored if r["outcome"] != "materialised")


def test_path_features(spark):
    rows = [([(None, None, datetime(2026, 1, 8)), (-1.0, 0.4, None), (1.0, 0.2, None)], [("MADE", datetime(2026, 1, 19)), ("Mentions", None)])]
    schema = "nodes array<struct<sentiment_score:double,influence:double,due_at:timestamp>>, edges array<struct<rel:string,seen_at:timestamp>>"
    got = spark.createDataFrame(rows, schema).select(policy.path_features(F.col("nodes"), F.col("edges"), F.lit("2026-01-20").cast("timestamp"))).first()[0]
    assert got == {"path_length": 2.0, "recency": 0.5, "sentiment_slope": 2.0, "commitment_age": 12.0, "influence_centrality": 0.4, "edge_type::made": 0.5, "edge_type::mentions": 0.5}


def test_same_alert_again_is_a_duplicate_sample(spark):
    schema = "alert_id string, outcome string, features map<string,double>, timestamp timestamp"
    log = spark.createDataFrame([("a|materialised",)], "sample_key string")
    rows = [("a", "Materialised", {"x": 1.0}, datetime(2024, 1, 1)), ("b", "acknowledged", {"x": 1.0}, datetime(2024, 1, 1)),
            ("b", "acknowledged", {"x": 1.0}, datetime(2024, 1, 2)), ("c", "other", {"x": 1.0}, datetime(2024, 1, 1))]
    assert [r["sample_key"] for r in policy.new_samples(log, spark.createDataFrame(rows, schema)).collect()] == ["b|acknowledged"]


# --- resolution -------------------------------------------------------------------------

CANDIDATE = "id string, name string, email string, phone string, org_id string, org_domain string"


def resolved(spark, mention, candidates, **kw):
    m = spark.createDataFrame([mention], "temp_id string, name string, email string, org_id string")
    return resolve.resolve(m, spark.createDataFrame(candidates, CANDIDATE), "person", **kw).first()


def test_exact_email_resolves(spark):
    r = resolved(spark, ("t", "Bob", "bob@acme.com", None), [("p1", "Robert", "BOB@acme.com", None, None, None), ("p2", "Eve", "eve@x.org", None, None, None)])
    assert (r["canonical_id"], r["resolution_status"], r["confidence_level"]) == ("p1", "resolved", "high")


def test_name_only_stays_new_and_needs_review(spark):
    r = resolved(spark, ("t", "Bob", None, None), [("p1", "Bob", None, None, None, None)])
    assert (r["canonical_id"], r["best_guess_id"], round(r["confidence"], 6), r["resolution_status"], r["needs_review"]) == (None, "p1", 0.6, "new", True)
    assert r["review_reasons"] == ["confidence_below:0.9"] and r["is_new"]


def test_domain_matches_a_differently_named_person(spark):
    r = resolved(spark, ("t", "Bob Smith", "bob@corp.com", None), [("p1", "Robert J. Smith", "rjs@corp.com", None, None, None)])
    assert r["best_guess_id"] == "p1" and r["confidence"] >= 0.7


def test_context_picks_one_of_two_equal_names(spark):
    m = spark.createDataFrame([("t", "Alex Lee", "c1")], "temp_id string, name string, context_id string")
    c = spark.createDataFrame([("p1", "Alex Lee"), ("p2", "Alex Lee")], "id string, name string")
    context = spark.createDataFrame([("c1", "project", "Apollo")], "context_id string, kind string, value string")
    offered = spark.createDataFrame([("p2", "project", "apollo"), ("p1", "project", "Zeus")], "id string, kind string, value string")
    limits = {**model.RESOLUTION_LIMITS, "min_confidence": 0.8}
    r = resolve.resolve(m, c, "person", context, offered, limits=limits).first()
    assert (r["canonical_id"], r["resolution_status"]) == ("p2", "resolved")
    assert [x["id"] for x in r["identity_candidates"]] == ["p2", "p1"] and [x["id"] for x in r["alternates"]] == ["p1"]


def test_rarest_piece_blocking_finds_every_containing_name(spark):
    rnd = random.Random(2)
    names = sorted({"".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, 9))).strip() or "a" for _ in range(60)})
    needles = sorted({n[i:j] for n in names[:20] for i in range(len(n)) for j in range(i + 1, min(len(n), i + 5) + 1)} | {"zz", "abcabcabca"})
    got = resolve.containing(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert {(r["needle"], r["name"]) for r in got.collect()} == {(a, b) for a in needles for b in names if a and a in b}


def test_misspelt_organisations_are_found(spark):
    m = spark.createDataFrame([("t", "Acmee")], "temp_id string, name string")
    c = spark.createDataFrame([("o1", "Acme"), ("o2", "Something Else")], "id string, name string")
    assert resolve.resolve(m, c, "org").first()["best_guess_id"] == "o1"


# --- concepts ---------------------------------------------------------------------------

def test_tiny_pink_cow(spark):
    table = spark.createDataFrame([("animals", "concept_cow", "cow", ["tiny pink cow"], ["tiny"], [1.0, 0.0]), ("animals", "concept_car", "car", [], [], [0.0, 1.0])],
                                  "concept_key string, id string, name string, aliases array<string>, disallowed_attributes array<string>, embedding array<double>")
    hints = spark.createDataFrame([("e1", "animals", "tiny pink cow", None, [1.0, 0.05])], "entity_id string, concept_key string, value string, entity_type string, embedding array<double>")
    applied = concepts.apply_to_entities(hints, table)
    row = applied.first()
    assert (row["status"], row["canonical_id"], row["modifiers"]) == ("matched", "concept_cow", ["tiny", "pink"])
    attributes, tensions, open_ = concepts.alignment_edges(applied)
    assert {r["dst"] for r in attributes.collect()} == {"attr_tiny", "attr_pink"}
    assert {(r["attribute"], r["contradiction_type"]) for r in tensions.collect()} == {("tiny", "identity_conflict"), ("pink", "modifier_variation")}
    assert open_.count() == 0


# --- contradictions ---------------------------------------------------------------------

BELIEF = "id string, subject_ref string, predicate string, object_ref string, object_label string, start_at date, end_at date"
INSTANTS = BELIEF.replace("date", "timestamp")


def random_beliefs(prefix, n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        start = date(2024, 1, rnd.randrange(1, 20)) if rnd.random() < 0.8 else None
        end = date(2024, 1, start.day + rnd.randrange(0, 9)) if start and rnd.random() < 0.9 else None
        out.append((f"{prefix}{i}", rnd.choice(["S:hot", "S:hot", "S:a"]), rnd.choice(["OWNS", "WORKS_WITH", "STATE", "HAS_SSN"]), f"O:{rnd.randrange(3)}",
                    rnd.choice(["L1", "L2", None]), start, end))
    return out


def moments(rows, seed):
    """Beliefs with windows of minutes, with null and empty objects, several windows of one statement and repeated ids."""
    rnd = random.Random(seed)
    out = []
    for r in rows:
        start = datetime(2024, 1, 1, 12, rnd.randrange(0, 20)) if rnd.random() < 0.8 else None
        end = start + timedelta(minutes=rnd.randrange(0, 9)) if start and rnd.random() < 0.9 else None
        out.append((rnd.choice(rows)[0] if rnd.random() < 0.2 else r[0], r[1], r[2], rnd.choice([r[3], r[3], None, ""]), r[4], start, end))
    return out


@pytest.mark.parametrize("schema,rules", [(BELIEF, beliefs.Rules(paradox=(("STATE", "S:hot"),))),
                                          (INSTANTS, beliefs.Rules(temporal={"OWNS": "temporal_overlap", "WORKS_WITH": "temporal_overlap", "STATE": "temporal_overlap"}))])
def test_counts_agree_with_the_pairs(spark, schema, rules):
    new, old = random_beliefs("n", 60, 1), random_beliefs("e", 90, 2)
    if schema is INSTANTS:
        new, old = moments(new, 3), moments(old, 4)
    new_df, old_df = spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)
    pairs = Counter((r["new_id"], r["code"]) for r in beliefs.contradictions(new_df, old_df, rules).collect())
    names = {"n_temporal": ("temporal_overlap",), "n_cardinality": ("cardinality_conflict", "identity_conflict"), "n_type_mismatch": ("type_mismatch",), "n_disagreement": ("value_disagreement",)}
    counts = beliefs.conflict_counts(new_df, old_df, rules).collect()
    assert len(counts) == len(new) and sum(pairs.values()) > 300
    totals = Counter()
    for row in counts:
        totals.update({(row["id"], column): row[column] for column in names})
    for (ident, column), n in totals.items():
        assert n == sum(pairs[(ident, c)] for c in names[column]), (ident, column)


def test_touching_windows_overlap_and_pair_kinds(spark):
    new = spark.createDataFrame([("n", "S:1", "OWNS", "O:1", "L", date(2024, 1, 5), date(2024, 1, 9)), ("m", "Concept:schrodinger_cat", "STATE", "O:1", "L", None, None)], BELIEF)
    old = spark.createDataFrame([("a", "S:1", "OWNS", "O:2", "L", date(2024, 1, 9), date(2024, 1, 12)), ("b", "S:1", "OWNS", "O:2", "L", date(2024, 2, 1), date(2024, 2, 2)),
                                 ("c", "S:1", "OWNS", "O:1", "X", None, None), ("d", "Concept:schrodinger_cat", "STATE", "O:1", "M", None, None)], BELIEF)
    got = {(r["existing_id"], r["code"], r["type"]) for r in beliefs.contradictions(new, old).collect()}
    assert got == {("a", "temporal_overlap", "hard"), ("b", "cardinality_conflict", "hard"), ("c", "type_mismatch", "soft"), ("d", "type_mismatch", "paradoxical")}


# --- feedback, memory, routing ----------------------------------------------------------

def diff(before, after, path=""):
    if isinstance(before, dict) and isinstance(after, dict):
        out = []
        for k in sorted(set(before) | set(after)):
            p = f"{path}.{k}" if path else k
            out += [(p, None, after[k])] if k not in before else [(p, before[k], None)] if k not in after else diff(before[k], after[k], p)
        return out
    if isinstance(before, list) and isinstance(after, list):
        out = []
        for i in range(max(len(before), len(after))):
            p = f"{path}[{i}]"
            out += [(p, None, after[i])] if i >= len(before) else [(p, before[i], None)] if i >= len(after) else diff(before[i], after[i], p)
        return out
    return [] if before == after else [(path or "root", before, after)]


def test_json_diff_by_levels(spark):
    docs = [({"a": 1, "b": {"c": [1, {"d": "x"}], "e": None}, "f": []}, {"a": 1, "b": {"c": [1, {"d": "y", "z": {}}], "e": {"g": 1}}, "h": [1, 2]}), ([1, 2, 3], [1, 4]), ({"a": [1]}, {"a": {"b": 1}}), (5, 5)]
    frame = spark.createDataFrame([(i, json.dumps(b), json.dumps(a)) for i, (b, a) in enumerate(docs)], "id int, b string, a string")
    got = sorted((r["id"], r["path"], json.loads(r["before"]) if r["before"] else None, json.loads(r["after"]) if r["after"] else None) for r in feedback.json_diff(frame, "id", "b", "a").collect())
    assert [json.dumps(g) for g in got] == [json.dumps(x) for x in sorted((i, *d) for i, (b, a) in enumerate(docs) for d in diff(b, a))]


def test_items_expire_after_their_last_use(spark):
    t = lambda s: datetime(2024, 1, 1, 0, s // 60, s % 60)
    rows = [("s", "i", "record", 0.9, "x", t(0)), ("s", "i", "reinforce", 0.1, "y", t(1)), ("s", "i", "record", 0.2, "z", t(10)), ("s", "p", "pin", 0.0, "w", t(0)), ("s", "p", "record", 0.0, "v", t(300))]
    lives = memory.item_lives(spark.createDataFrame(rows, "session_id string, item_id string, op string, importance double, content string, ts timestamp"), 1)
    got = sorted((r["item_id"], r["created_at"], r["strength"], r["pinned"], r["content"]) for r in lives.collect())
    assert got == [("i", t(0), 1.0, False, "y"), ("i", t(10), 0.0, False, "z"), ("p", t(0), 0.0, True, "v")]
    live = memory.live_at(lives, F.lit("2024-01-01 00:00:02").cast("timestamp"))
    assert {r["item_id"] for r in live.collect()} == {"i", "p"}
    later = memory.live_at(lives, F.lit("2024-01-01 00:00:03").cast("timestamp"))
    assert {r["item_id"] for r in later.collect()} == {"p"}


def test_modules_below_the_threshold_do_not_run(spark):
    table = {(r["event_type"], r["module"]): r["activation"] for r in routing.activation_table(spark).collect()}
    assert table[("ontology.candidate_detected", "module.ontology_proposal_summariser")] >= 0.45 > table[("*", "module.ontology_proposal_summariser")]


def test_gate(spark):
    rows = spark.createDataFrame([("suggestion.x", "{}"), ("plain", '{"pipeline_id":"pipeline.concept_update"}'), ("plain", '{"module_name":"none"}')], "event_type string, payload string")
    assert (routing.allowed(rows, "shadow").count(), routing.allowed(rows, "active").count()) == (1, 2)


@pytest.mark.parametrize("few", [0, 500_000])
def test_conflicts_send_both_sides_once_and_leave_out_renewed_beliefs(spark, monkeypatch, few):
    monkeypatch.setattr(beliefs, "FEW", few, raising=False)
    schema = "id string, subject_ref string, predicate string, object_ref string, object_label string, start_at date, end_at date"
    new = spark.createDataFrame([("n1", "P:1", "OWNS", "A", None, None, None), ("n1", "P:1", "OWNS", "A", None, None, None), ("n2", "P:2", "OWNS", "A", "X", None, None),
                                 (None, "P:1", "OWNS", "B", None, None, None), ("n3", None, "OWNS", "A", None, None, None)], schema)
    old = spark.createDataFrame([("n2", "P:1", "OWNS", "C", None, None, None), ("o1", "P:1", "OWNS", "B", None, None, None), (None, "P:1", "OWNS", "A", None, None, None),
                                 ("o2", "P:2", "OWNS", "B", "Y", None, None), ("o3", None, "OWNS", "B", None, None, None)], schema)
    counts = beliefs.conflict_counts(new, old)
    got = sorted((str(r["id"]), str(r["subject_ref"]), r["object_ref"], r["n_pairs"], r["n_cardinality"]) for r in counts.collect())
    assert got == [("None", "P:1", "B", 2, 1), ("n1", "P:1", "A", 2, 1), ("n1", "P:1", "A", 2, 1), ("n2", "P:2", "A", 1, 1), ("n3", "None", "A", 0, 0)]
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join LeftOuter" in plan and plan.count("Join LeftOuter") == 1  # the rules


def test_about_links_send_what_beliefs_name_once(spark):
    digest = "0123456789abcdef"
    ids = [f"belief_{digest}", f"belief_{digest}", digest, f"x{digest.upper()}", f"belief_{digest}\n", "short", "", None]
    rows = spark.createDataFrame([(i, "Person:p:1", ref) for i in ids for ref in ("Org:o1", "Org:none", "Belief:b", "nothing", "Org:")], "id string, subject_ref string, object_ref string")
    nodes = spark.createDataFrame([("Person", "p:1"), ("Org", "o1"), ("Belief", "b")], "label string, id string")
    links = beliefs.about_links(rows, nodes)
    assert Counter((r["src"], r["dst"]) for r in links.collect()) == Counter({(i, e): 1 for i in set(ids) for e in ("p:1", "o1")})
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        plan = beliefs.about_links(rows, nodes)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(entity_id") == plan.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set(key, before)
