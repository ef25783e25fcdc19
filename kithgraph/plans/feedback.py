"""Feedback learning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.operators import feedback as ops
from kithgraph.plans.registry import query
from kithgraph.sources.graph import Graph

# One feedback entry per event; its kind decides what was corrected.
FEEDBACK_SQL = """
WITH entries AS (SELECT event_id AS entry_id, ts, CASE event_type WHEN 'error' THEN 'commitments[0].text' WHEN 'view' THEN 'persons[0].name' WHEN 'click' THEN 'Scores.Confidence' WHEN 'purchase' THEN 'concept.type' ELSE 'notes' END AS path,
  CASE event_type WHEN 'view' THEN 'user '||user_id WHEN 'click' THEN user_id::VARCHAR WHEN 'signup' THEN props END AS before,
  CASE event_type WHEN 'error' THEN props WHEN 'view' THEN 'User '||user_id WHEN 'click' THEN value::VARCHAR WHEN 'purchase' THEN 'segment '||user_id WHEN 'signup' THEN '  ' END AS after FROM events),
newest AS (SELECT * FROM entries ORDER BY ts DESC, entry_id DESC LIMIT 50)
"""


def entries(g: Graph) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    path = F.when(kind == "error", "commitments[0].text").when(kind == "view", "persons[0].name").when(kind == "click", "Scores.Confidence") \
        .when(kind == "purchase", "concept.type").otherwise("notes")
    before = F.when(kind == "view", F.concat(F.lit("user "), user)).when(kind == "click", user).when(kind == "signup", F.col("props"))
    after = F.when(kind == "error", F.col("props")).when(kind == "view", F.concat(F.lit("User "), user)).when(kind == "click", F.col("value").cast("string")) \
        .when(kind == "purchase", F.concat(F.lit("segment "), user)).when(kind == "signup", "  ")
    return g.table("events").select(F.col("event_id").alias("entry_id"), "ts", F.array(F.struct(
        path.alias("path"), before.alias("before"), after.alias("after"))).alias("corrections"))


def all_corrections(g: Graph) -> DataFrame:
    return ops.corrections(entries(g))


@query("w05_recent_feedback", sql=FEEDBACK_SQL + "SELECT entry_id FROM newest", graph=False)
def recent_feedback(g: Graph) -> DataFrame:
    rows = entries(g)
    newest = rows.agg(F.max("ts").alias("ts"))
    current = rows.join(F.broadcast(newest), "ts").select(*rows.columns)  # one row of one aggregate
    return ops.recent(rows.join(current.select("entry_id"), "entry_id", "left_anti"), 50, current).select("entry_id")


@query("a09_recurring_obligations", sql=FEEDBACK_SQL + "SELECT after AS phrase, count(*)::BIGINT AS n FROM entries WHERE path LIKE 'commitments%' GROUP BY 1 HAVING count(*) >= 2", graph=False)
def obligations(g: Graph) -> DataFrame:
    return ops.recurring_obligations(all_corrections(g))


@query("a09_recurring_synonyms", sql=FEEDBACK_SQL + "SELECT before AS before_text, after AS after_text, path, count(*)::BIGINT AS n FROM entries WHERE path LIKE 'persons%' GROUP BY ALL HAVING count(*) >= 2", graph=False)
def synonyms(g: Graph) -> DataFrame:
    return ops.recurring_synonyms(all_corrections(g))


@query("a09_corrections_per_path", sql=FEEDBACK_SQL + "SELECT path, count(*)::BIGINT AS n FROM entries GROUP BY 1", graph=False)
def per_path(g: Graph) -> DataFrame:
    return ops.correction_counts(all_corrections(g))


@query("a10_threshold_step", sql=FEEDBACK_SQL + """
SELECT name, before, round(least(1.0, greatest(0.0, before + CASE WHEN (SELECT avg(after::DOUBLE - before::DOUBLE) FROM entries WHERE path = 'Scores.Confidence') < 0 THEN 0.01 ELSE -0.01 END)), 4) AS after
FROM (VALUES ('name_similarity', 0.85::DOUBLE), ('org_similarity', 0.85), ('domain_similarity', 0.95), ('email_similarity', 0.97), ('phone_similarity', 0.98), ('project_similarity', 0.8), ('document_similarity', 0.8),
 ('location_similarity', 0.7), ('ambiguity_gap', 0.1), ('concept_similarity', 0.75)) t(name, before)""", graph=False)
def threshold_step(g: Graph) -> DataFrame:
    return ops.stepped_thresholds(ops.confidence_step(all_corrections(g)))


@query("k01_reflect", sql=FEEDBACK_SQL + """
SELECT output, count(*)::BIGINT AS n, min(value) AS first_value FROM (
  SELECT 'lexicon_updates' AS output, after AS value FROM newest WHERE path LIKE 'commitments%' GROUP BY 2 HAVING count(*) >= 2
  UNION ALL SELECT 'synonym_updates', before||' -> '||after FROM newest WHERE path LIKE 'persons%' GROUP BY before, after HAVING count(*) >= 2
  UNION ALL SELECT 'threshold_updates', name||'='||printf('%.2f', v + s) FROM (VALUES ('name_similarity', 0.85), ('org_similarity', 0.85), ('domain_similarity', 0.95), ('email_similarity', 0.97), ('phone_similarity', 0.98), ('project_similarity', 0.8), ('document_similarity', 0.8), ('location_similarity', 0.7), ('ambiguity_gap', 0.1), ('concept_similarity', 0.75)) t(name, v),
    (SELECT CASE WHEN avg(after::DOUBLE - before::DOUBLE) < 0 THEN 0.01 ELSE -0.01 END AS s, count(*) AS n FROM newest WHERE path = 'Scores.Confidence') WHERE n >= 2
  UNION ALL SELECT DISTINCT 'concept_promotions', after FROM newest WHERE path = 'concept.type'
  UNION ALL SELECT 'review_items', path FROM (SELECT DISTINCT path, before, after FROM newest WHERE path = 'notes')) GROUP BY 1""", graph=False)
def reflect(g: Graph) -> DataFrame:
    """The newest 50 entries, as the learning step takes them."""
    return ops.reflect(entries(g)).groupBy("output").agg(F.count("*").alias("n"), F.min("value").alias("first_value"))


@query("k01_reflect_all", sql=FEEDBACK_SQL + """
SELECT output, count(*)::BIGINT AS n FROM (
  SELECT 'lexicon_updates' AS output, after FROM entries WHERE path LIKE 'commitments%' GROUP BY 2 HAVING count(*) >= 2
  UNION ALL SELECT 'synonym_updates', after FROM entries WHERE path LIKE 'persons%' GROUP BY before, after HAVING count(*) >= 2
  UNION ALL SELECT 'threshold_updates', unnest(range(10))::VARCHAR
  UNION ALL SELECT DISTINCT 'concept_promotions', after FROM entries WHERE path = 'concept.type'
  UNION ALL SELECT 'review_items', path FROM (SELECT DISTINCT path, before, after FROM entries WHERE path = 'notes')) GROUP BY 1""", graph=False)
def reflect_all(g: Graph) -> DataFrame:
    """The whole log at once."""
    return ops.reflect(entries(g), limit=None).groupBy("output").agg(F.count("*").alias("n"))


@query("k02_correction_routing", sql=FEEDBACK_SQL + """
SELECT path, path LIKE 'commitments%' AS obligation, path LIKE 'persons%' AS synonym, path = 'Scores.Confidence' AS confidence, path = 'concept.type' AS concept, count(*)::BIGINT AS n FROM entries GROUP BY ALL""", graph=False)
def correction_routing(g: Graph) -> DataFrame:
    rows = all_corrections(g)
    return rows.groupBy("path", *[F.col(f"is_{k}").alias(k) for k in ("obligation", "synonym", "confidence", "concept")]).agg(F.count("*").alias("n"))


@query("u03_json_diff", sql="""
SELECT doc, path, before, after FROM (
  SELECT o_orderkey AS doc, 'meta.status' AS path, '"'||o_orderstatus||'"' AS before, '"done"' AS after FROM orders
  UNION ALL SELECT o_orderkey, 'tags[1]', '"'||o_orderpriority||'"', NULL FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT o_orderkey, 'tags[2]', NULL, '{"k":['||o_custkey||']}' FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey, 'meta.owner', NULL, o_custkey::VARCHAR FROM orders WHERE o_orderstatus = 'P')""", graph=False)
def json_diff(g: Graph) -> DataFrame:
    """Every order as a preview before and after a review."""
    state = F.col("o_orderstatus")
    owner = F.when(state == "P", F.concat(F.lit(',"owner":'), "o_custkey")).otherwise("")
    prio = F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))
    before = F.concat(F.lit('{"meta":{"status":"'), state, F.lit('"},"tags":["a",'), prio, F.lit(']}'))
    tags = F.when(state == "O", F.lit('"a"')).when(state == "F", F.concat(F.lit('"a",'), prio, F.lit(',{"k":['), "o_custkey", F.lit(']}'))) \
        .otherwise(F.concat(F.lit('"a",'), prio))
    after = F.concat(F.lit('{"meta":{"status":"done"'), owner, F.lit('},"tags":['), tags, F.lit(']}'))
    rows = g.table("orders").select("o_orderkey", before.alias("before"), after.alias("after"))
    return ops.json_diff(rows, "o_orderkey", "before", "after").withColumnRenamed("o_orderkey", "doc")
