"""Concept assignment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph import model
from kithgraph.functions.vectors import token_embedding
from kithgraph.operators import concepts as ops
from kithgraph.plans.registry import query
from kithgraph.sources.graph import Graph

CONCEPTS_VALUES = ",\n ".join(
    "('{}','{}','{}','{}',{})".format(key, cid, name, description.replace("'", "''"), "[" + ",".join(f"'{a.lower()}'" for a in applies) + "]::VARCHAR[]")
    for key, cid, name, description, _, applies in model.CONCEPTS)
# Hints: people by market segment, organisations as suppliers, parts as risks of their type.
HINTS_SQL = f""",
concepts AS (SELECT * FROM (VALUES {CONCEPTS_VALUES}) t(concept_key, concept_id, concept_name, description, applies_to)),
hints AS (SELECT id AS entity_id, 'stakeholder_types' AS concept_key, 'the '||lower(segment)||' Community Representative' AS value, 'Person' AS entity_type FROM person
  UNION ALL SELECT id, 'stakeholder_types', name||' Supplier', 'Org' FROM org
  UNION ALL SELECT id, 'risk_categories', 'very '||split_part(name, ' ', 1)||' schedule', NULL FROM project),
texts AS (SELECT DISTINCT value AS t FROM hints UNION SELECT concept_id||chr(10)||concept_name||chr(10)||description FROM concepts),
tok AS (SELECT t, list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda x: x <> '') AS w FROM texts),
raw AS (SELECT t, list_transform(range(0, 24), lambda i: list_sum(list_transform(w, lambda x: ('0x'||substr(sha256(x), i * 2 + 1, 2))::INT / 127.5 - 1.0))) AS v FROM tok),
emb AS (SELECT t, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM raw),
pairs AS (SELECT DISTINCT h.concept_key, h.value, h.entity_type, c.concept_id, c.concept_name,
    greatest(-1.0, least(1.0, list_cosine_similarity(a.v, b.v))) AS cosine,
    CASE WHEN len(c.applies_to) = 0 OR h.entity_type IS NULL THEN 0.5 WHEN list_contains(c.applies_to, lower(h.entity_type)) THEN 1.0 ELSE 0.0 END::DOUBLE AS structural
  FROM (SELECT DISTINCT concept_key, value, entity_type FROM hints) h JOIN concepts c USING (concept_key) JOIN emb a ON a.t = h.value JOIN emb b ON b.t = c.concept_id||chr(10)||c.concept_name||chr(10)||c.description)
"""


def hints(g: Graph) -> DataFrame:
    """Entities with the hint that says what they are."""
    people = g.persons.select(F.col("id").alias("entity_id"), F.lit("stakeholder_types").alias("concept_key"),
                              ops.hint_column(F.lit(""), F.concat(F.lit("the "), F.lower("segment"), F.lit(" Community Representative"))).alias("value"),
                              F.lit("Person").alias("entity_type"))
    orgs = g.orgs.select(F.col("id").alias("entity_id"), F.lit("stakeholder_types").alias("concept_key"),
                         F.concat("name", F.lit(" Supplier")).alias("value"), F.lit("Org").alias("entity_type"))
    risks = g.projects.select(F.col("id").alias("entity_id"), F.lit("risk_categories").alias("concept_key"),
                              F.concat(F.lit("very "), F.substring_index("name", " ", 1), F.lit(" schedule")).alias("value"),
                              F.lit(None).cast("string").alias("entity_type"))
    return people.unionByName(orgs).unionByName(risks)


@query("c01_token_embedding", sql="""
WITH n AS (SELECT DISTINCT p_name AS t FROM part UNION SELECT DISTINCT c_name||' '||c_mktsegment FROM customer),
raw AS (SELECT t, list_transform(range(0, 24), lambda i: list_sum(list_transform(string_split(lower(t), ' '), lambda x: ('0x'||substr(sha256(x), i * 2 + 1, 2))::INT / 127.5 - 1.0))) AS v FROM n)
SELECT t AS name, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(v[24] / sqrt(list_inner_product(v, v)), 6) AS last FROM raw""", graph=False)
def token_embeddings(g: Graph) -> DataFrame:
    names = g.projects.select("name").unionByName(g.persons.select(F.concat_ws(" ", "name", "segment").alias("name"))).distinct()
    rows = names.withColumn("v", token_embedding(F.col("name")))
    return rows.select("name", F.round(F.get("v", 0), 6).alias("first"), F.round(F.get("v", 23), 6).alias("last"))


@query("c02_lexical_score", sql=HINTS_SQL + """
SELECT h.entity_id, c.concept_id, 1.0::DOUBLE AS lexical FROM (SELECT id AS entity_id, 'stakeholder_types' AS concept_key, 'supplier' AS value FROM org UNION ALL SELECT id, 'risk_categories', 'rc_esg' FROM project) h
JOIN concepts c ON c.concept_key = h.concept_key AND (h.value = lower(c.concept_name) OR h.value = c.concept_id)""")
def lexical(g: Graph) -> DataFrame:
    """Exact hits of names and ids."""
    rows = g.orgs.select(F.col("id").alias("entity_id"), F.lit("stakeholder_types").alias("concept_key"), F.lit("Supplier ").alias("value")) \
        .unionByName(g.projects.select(F.col("id").alias("entity_id"), F.lit("risk_categories").alias("concept_key"), F.lit("RC_ESG").alias("value")))
    joined = rows.join(ops.prepared(model.concept_table(g.spark)), "concept_key")
    score = ops.lexical_score(F.col("value"), F.col("concept_id"), F.col("concept_name"), F.col("aliases"))
    return joined.select("entity_id", "concept_id", score.alias("lexical")).filter(F.col("lexical") == 1.0)


@query("c03_structural_score", sql=HINTS_SQL + "SELECT value, concept_id, structural, round(cosine, 6) AS cosine FROM pairs")
def structural(g: Graph) -> DataFrame:
    rows = ops.scored(hints(g), model.concept_table(g.spark))
    return rows.select("value", "concept_id", "structural", F.round("cosine", 6).alias("cosine"))


@query("c04_assignment")
def assignment(g: Graph) -> DataFrame:
    """Assignment of every distinct hint.  The lexical part has no SQL form, so tests check it by brute force."""
    rows = ops.assign(hints(g), model.concept_table(g.spark))
    return rows.select("concept_key", "value", "status", "canonical_id", F.round("score", 6).alias("score"), F.size("candidates").alias("n_candidates"))


@query("c05_anomalies", sql="""
SELECT DISTINCT value, attribute, CASE WHEN attribute IN ('red','hot') THEN 'identity_conflict' ELSE 'modifier_variation' END AS contradiction_type FROM (
  SELECT p_name||' '||lower(p_type) AS value, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) AS attribute FROM part)""", graph=False)
def anomaly_kinds(g: Graph) -> DataFrame:
    value = F.concat_ws(" ", "name", F.lower("type"))
    rows = g.projects.select(value.alias("value"), ops.salient_phrases(value).alias("modifiers"))
    kinds = ops.anomalies(F.col("value"), F.col("modifiers"), F.array(F.lit("red"), F.lit("hot")))
    return rows.select("value", F.explode(kinds).alias("x")).select("value", "x.attribute", "x.contradiction_type").distinct()


@query("c06_apply_to_entities")
def apply_to_entities(g: Graph) -> DataFrame:
    rows = ops.apply_to_entities(hints(g), model.concept_table(g.spark))
    return rows.select("entity_id", "concept_key", "value", "status", "canonical_id", F.round("score", 6).alias("score"))


@query("c07_attribute_edges", sql=HINTS_SQL + """
SELECT src, 'HAS_ATTRIBUTE' AS rel, 'attr_'||attribute AS dst FROM (
  SELECT id AS src, unnest([lower(segment), 'community']) AS attribute FROM person UNION ALL SELECT id, lower(name) FROM org UNION ALL SELECT id, split_part(name, ' ', 1) FROM project)""")
def attribute_edges(g: Graph) -> DataFrame:
    attributes, _, _ = ops.alignment_edges(ops.apply_to_entities(hints(g), model.concept_table(g.spark)))
    return attributes.select("src", "rel", "dst")


@query("c07_tension_edges")
def tension_edges(g: Graph) -> DataFrame:
    _, tensions, _ = ops.alignment_edges(ops.apply_to_entities(hints(g), model.concept_table(g.spark)))
    return tensions.select("src", "rel", "dst", "attribute", "contradiction_type")
