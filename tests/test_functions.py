from __future__ import annotations

import hashlib
import json
import uuid
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from kithgraph.functions import ids, text, values, vectors
from kithgraph.functions.similarity import similarity
from kithgraph.operators import extract


def one(spark, column, **cells):
    schema = ", ".join(f"{k} string" for k in cells)
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("v")).first()["v"]


def test_name_uuid_is_version_five(spark):
    assert one(spark, ids.alert_id(F.col("r"), F.col("e")), r="rule", e="person:1") == str(uuid.uuid5(uuid.NAMESPACE_URL, "rule:person:1"))


def test_belief_id_hashes_sorted_compact_json(spark):
    payload = {"object": 'Org:"x"', "polarity": "unknown", "predicate": "WORKS_FOR", "subject": "Person:1"}
    digest = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    got = one(spark, ids.belief_id(F.col("s"), F.col("p"), F.col("o"), F.lit("unknown")), s="Person:1", p="WORKS_FOR", o='Org:"x"')
    assert got == f"belief_{digest}"


def test_similarity_takes_the_better_of_plain_and_sorted_tokens(spark):
    got = one(spark, similarity(F.col("a"), F.col("b")), a="Smith-Alice", b="alice smyth")
    assert abs(got - max(SequenceMatcher(None, "smith-alice", "alice smyth").ratio(), SequenceMatcher(None, "alice smith", "alice smyth").ratio())) < 1e-12
    assert one(spark, similarity(F.col("a"), F.col("b")), a="  ", b="x") == 0.0


def test_token_embedding_matches_the_byte_formula(spark):
    raw = [0.0] * 24
    for token in "tiny pink cow".split():
        digest = hashlib.sha256(token.encode()).digest()
        raw = [r + digest[i] / 127.5 - 1.0 for i, r in enumerate(raw)]
    norm = sum(r * r for r in raw) ** 0.5
    got = one(spark, vectors.token_embedding(F.col("t")), t=" Tiny pink\ncow ")
    assert max(abs(a - b / norm) for a, b in zip(got, raw)) < 1e-12


def test_zero_vector_has_norm_one(spark):
    row = spark.sql("select array(0.0D, 0.0D) z, array(3.0D, 4.0D) v").select(
        vectors.norm(F.col("z")).alias("n"), vectors.cosine(F.col("z"), F.col("v")).alias("c"), vectors.norm(F.col("v")).alias("m")).first()
    assert (row["n"], row["c"], row["m"]) == (1.0, 0.0, 5.0)


def test_flexible_timestamp(spark):
    rows = spark.createDataFrame([(v,) for v in ("2024-01-02T03:04:05Z", "2024-01-02", "1704164645", "1704164645000", "soon", "")], "v string")
    got = [r[0] for r in rows.select(F.unix_seconds(values.flexible_timestamp(F.col("v")))).collect()]
    assert got == [1704164645, 1704153600, 1704164645, 1704164645, None, None]


def test_salient_phrases_and_attribute_ids(spark):
    assert one(spark, text.salient_phrases(F.col("t")), t="The very tiny, pink cow") == ["tiny", "pink"]
    assert one(spark, text.attribute_id(F.col("t")), t="Sky-Blue  Pink") == "attr_sky_blue_pink"
    assert one(spark, text.attribute_id(F.col("t")), t=" ") == "attr_unknown"


def test_collection_and_label_names(spark):
    for label, collection in (("Commitment", "commitments"), ("RiskCategory", "risk_categories"), ("Day", "days"), ("News", "news")):
        assert one(spark, text.plural_label(F.col("t")), t=label) == collection
    for key, label in (("stakeholder_types", "Concept"), ("work_items", "WorkItem"), ("parties", "Party")):
        assert one(spark, text.collection_label(F.col("t")), t=key) == label
    assert one(spark, text.concept_kind(F.col("t")), t="risk_categories") == "RiskCategory"
    assert one(spark, text.hierarchy_kind(F.col("t")), t="outcome_types") == "OutcomeType"


def test_version_bump_slug_and_salvage(spark):
    assert one(spark, text.next_patch_version(F.col("t")), t="1.2.9") == "1.2.10"
    assert one(spark, text.next_patch_version(F.col("t")), t="x") == "0.0.1"
    assert one(spark, text.slug(F.col("t")), t="--") == "item"
    assert one(spark, text.json_salvage(F.col("t")), t='ok {"a": {"b": 1}} bye') == '{"a": {"b": 1}}'
    assert one(spark, text.json_salvage(F.col("t")), t="{no") is None


def test_mentions_are_unicode_aware(spark):
    words = "Jane Doe met ÉAnn Lee and Ann Lee of Acme Pty Ltd. We Will ship it by Friday.\nJane Doe"
    assert one(spark, extract.persons(F.col("t")), t=words) == ["Jane Doe", "Ann Lee", "Acme Pty", "We Will", "Jane Doe"]
    assert one(spark, extract.orgs(F.col("t")), t=words) == ["Acme Pty Ltd"]
    assert one(spark, extract.commitments(F.col("t")), t=words) == ["Will ship it by Friday"]


def test_closed_status(spark):
    rows = spark.createDataFrame([(" Done ",), ("open",), (None,)], "s string")
    assert [r[0] for r in rows.select(values.is_closed(F.col("s"))).collect()] == [True, False, False]


def test_graph_hash_of_a_list(spark):
    payload = {"neighbours": ["a", "é"], "node_id": "n"}
    want = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert one(spark, ids.graph_hash(F.col("n"), F.array(F.lit("é"), F.lit("a"))), n="n") == want


def test_printed_numbers_are_rounded_by_their_exact_value(spark):
    from kithgraph.functions.values import rounded

    values = [0.3125, 0.0625, -0.3125, 0.0005, 1.0005, 2.0015, 0.1235, -0.0003, 0.0, 0.1875, -1.4375, 123456.0625, 0.31250000000000006, 0.31249999999999994, 1e9,
              *[i / 2000 for i in range(-400, 400)], *[i / 7 for i in range(50)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 3):
        got = df.select("v", F.format_string(f"%+.{digits}f", rounded(F.col("v"), digits)).alias("text")).collect()
        assert [(r["v"], r["text"]) for r in got if r["text"] != f"{r['v']:+.{digits}f}"] == []
