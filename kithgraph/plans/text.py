"""Source, extraction and preview queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.operators import extract as ex
from kithgraph.plans.registry import query
from kithgraph.session import scratch_path
from kithgraph.sources import sinks
from kithgraph.sources.graph import Graph

# Documents, and one note per order that states an obligation.
TEXTS_SQL = r"""
WITH texts AS (
  SELECT 'document:'||doc_id AS id, text, 'doc://'||source AS source_uri FROM documents
  UNION ALL SELECT 'note:'||o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Order '||o_orderkey||' is closed. Thanks, Anna Bell of Acme Pty Ltd.'
    ELSE 'Jane Moss Shall deliver order '||o_orderkey||' by '||strftime(o_orderdate, '%d %b %Y')||'. Priority '||o_orderpriority END, 'order://'||o_orderkey FROM orders),
marked AS (SELECT id, regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g') AS t FROM texts)
"""
PERSONS_SQL = TEXTS_SQL + r""",
person_names AS (SELECT id, replace(unnest(regexp_extract_all(t, '(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+  [A-Z][a-z]+)(?:[^\p{L}\p{N}_]|$)', 1)), '  ', ' ') AS name FROM marked)
"""


def texts(g: Graph) -> DataFrame:
    notes = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Order "), "o_orderkey", F.lit(" is closed. Thanks, Anna Bell of Acme Pty Ltd."))) \
        .otherwise(F.concat(F.lit("Jane Moss Shall deliver order "), "o_orderkey", F.lit(" by "), F.date_format("o_orderdate", "dd MMM yyyy"),
                            F.lit(". Priority "), "o_orderpriority"))
    orders = g.table("orders").select(F.concat(F.lit("note:"), "o_orderkey").alias("id"), notes.alias("text"),
                                      F.concat(F.lit("order://"), "o_orderkey").alias("source_uri"))
    return g.documents.select("id", "text", "source_uri").unionByName(orders)


@query("s01_raw_text_source", sql="""
SELECT 'document:'||doc_id AS interaction_id, CASE WHEN lang = 'en' THEN 'note' ELSE 'interaction' END AS interaction_type, 'text' AS source_type, 'doc://'||source AS source_uri, length(text)::BIGINT AS n_chars FROM documents""", graph=False)
def raw_text_source(g: Graph) -> DataFrame:
    rows = g.documents.select(
        F.col("id").alias("interaction_id"), F.when(F.col("lang") == "en", "note").alias("interaction_type"),
        F.lit(None).cast("timestamp").alias("interaction_at"), "source_uri", F.lit(None).cast("string").alias("source_type"),
        F.when(F.col("lang") != "de", F.col("text")).alias("raw_text"), "text")
    raw = ex.raw_inputs(rows, F.lit("2024-01-31").cast("timestamp"))
    return raw.select("interaction_id", "interaction_type", "source_type", "source_uri", F.length("text").cast("bigint").alias("n_chars"))


@query("s02_file_source", sql="""
SELECT lang, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1""", graph=False)
def file_source(g: Graph) -> DataFrame:
    """Documents written as JSON text files per language and read back from the files with their folder as source."""
    path = scratch_path(g.spark, "texts")
    g.documents.select("lang", "text").write.partitionBy("lang").json(path)
    rows = g.spark.read.schema("text string, lang string").json(path)
    source = F.regexp_extract(F.col("_metadata.file_path"), "lang=([^/]+)/", 1)
    return rows.select(source.alias("lang"), "text").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("s03_feedback_log", sql="""
SELECT role, count(*)::BIGINT AS n, count(DISTINCT conv_id)::BIGINT AS n_sessions FROM conversations GROUP BY 1""", graph=False)
def feedback_log(g: Graph) -> DataFrame:
    """Append turns as feedback lines in two runs, with a broken line per session between them, and read what is valid."""
    path = scratch_path(g.spark, "feedback")
    turns = g.table("conversations").select("conv_id", "turn", "role")
    sinks.append_feedback(turns.filter(F.col("role") == "user"), path)
    turns.select("conv_id").distinct().select(F.concat(F.lit('{"conv_id": '), "conv_id", F.lit(', "role": ')).alias("value")) \
        .write.mode("append").text(path)
    sinks.append_feedback(turns.filter(F.col("role") != "user"), path)
    log = sinks.read_feedback(g.spark, path, "conv_id bigint, turn bigint, role string")
    return log.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_sessions"))


@query("x01_person_mentions", sql=PERSONS_SQL + "SELECT name, count(*)::BIGINT AS n, count(DISTINCT id)::BIGINT AS n_texts FROM person_names GROUP BY 1", graph=False)
def person_mentions(g: Graph) -> DataFrame:
    names = texts(g).select("id", F.explode(ex.persons(F.col("text"))).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_texts"))


@query("x02_org_mentions", sql=TEXTS_SQL + r"""
SELECT name, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '\b([A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*)*\s+(?:Pty Ltd|Pty|Ltd|LLC|Inc|Corporation|Corp|Company))\b', 1)) AS name FROM texts) GROUP BY 1""", graph=False)
def org_mentions(g: Graph) -> DataFrame:
    return texts(g).select(F.explode(ex.orgs(F.col("text"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("x03_commitment_phrases", sql=TEXTS_SQL + r"""
SELECT id, name AS phrase FROM (SELECT id, unnest(regexp_extract_all(text, '(?i)\b(?:will|shall)\b[^.]*?\bby\s+[^\.\n]+')) AS name FROM texts)""", graph=False)
def commitment_phrases(g: Graph) -> DataFrame:
    return texts(g).select("id", F.explode(ex.commitments(F.col("text"))).alias("phrase"))


@query("x04_extraction_record", sql=PERSONS_SQL + r""",
pc AS (SELECT id, count(*) AS n FROM person_names GROUP BY 1)
SELECT t.id, coalesce(pc.n, 0)::BIGINT AS n_persons, len(regexp_extract_all(text, '(?i)\b(?:will|shall)\b[^.]*?\bby\s+[^\.\n]+'))::BIGINT AS n_commitments, 0.0::DOUBLE AS sentiment, substr(text, 1, 140) AS summary
FROM texts t LEFT JOIN pc ON pc.id = t.id""", graph=False)
def extraction_record(g: Graph) -> DataFrame:
    records = ex.extraction_record(texts(g))
    return records.select("id", F.size("entities.persons").cast("bigint").alias("n_persons"),
                          F.size("entities.commitments").cast("bigint").alias("n_commitments"), "sentiment", "summary")


@query("x05_previews", sql=PERSONS_SQL + r""",
pc AS (SELECT id, string_agg(name, ';' ORDER BY name) AS names FROM person_names GROUP BY 1)
SELECT t.id AS interaction_id, coalesce(names, '') AS persons, true AS ready FROM texts t LEFT JOIN pc ON pc.id = t.id""", graph=False)
def previews(g: Graph) -> DataFrame:
    rows = ex.previews(ex.extraction_record(texts(g)))
    names = F.array_join(F.array_sort(F.transform(F.element_at("entities", "persons"), lambda e: e["name"])), ";")
    return rows.select("interaction_id", names.alias("persons"), "ready")


@query("x07_learned_candidates", sql=TEXTS_SQL + r"""
SELECT 'obligation_phrases' AS list, count(DISTINCT name)::BIGINT AS n, min(name) AS first_value FROM (SELECT unnest(regexp_extract_all(text, '(?i)\b(?:will|shall)\b[^.]*?\bby\s+[^\.\n]+')) AS name FROM texts)
UNION ALL SELECT 'stakeholder_types', count(DISTINCT c_mktsegment), min(c_mktsegment) FROM customer
UNION ALL SELECT 'risk_categories', count(DISTINCT lower(p_type)), min(p_type) FROM part
UNION ALL SELECT 'relationship_types', count(DISTINCT event_type), min(event_type) FROM events""", graph=False)
def learned_candidates(g: Graph) -> DataFrame:
    found = ex.mentions(ex.extraction_record(texts(g))).select("collection", "name")
    roles = g.table("customer").select(F.lit("roles").alias("collection"), F.col("c_mktsegment").alias("name"))
    risks = g.table("part").select(F.lit("risks").alias("collection"), F.col("p_type").alias("name"))
    rels = g.table("events").select(F.lit("relationships").alias("collection"), F.col("event_type").alias("name"))
    rows = ex.learning_candidates(found.unionByName(roles).unionByName(risks).unionByName(rels))
    return rows.groupBy("list").agg(F.count("*").alias("n"), F.min("value").alias("first_value"))


@query("x08_learning_signals", sql="""
SELECT target, status, count(DISTINCT payload)::BIGINT AS n FROM (
  SELECT CASE event_type WHEN 'error' THEN 'lexicon_updates' WHEN 'view' THEN 'sentiment_updates' WHEN 'click' THEN 'schema_updates' END AS target, 'applied' AS status, props AS payload FROM events
  UNION ALL SELECT CASE event_type WHEN 'error' THEN 'lexicon_pattern' WHEN 'view' THEN 'sentiment_override' WHEN 'click' THEN 'schema_node_type' ELSE event_type END, 'pending', props FROM events) WHERE target IS NOT NULL GROUP BY ALL""", graph=False)
def learning_signals(g: Graph) -> DataFrame:
    kind = F.col("event_type")
    signals = g.table("events").select(
        F.when(kind == "error", "lexicon_patterns").when(kind == "view", "sentiment_overrides").when(kind == "click", "schema_suggestions")
        .otherwise(kind).alias("signal_type"), F.col("props").alias("payload"))
    return ex.learning_signals(signals).groupBy("target", "status").agg(F.count("*").alias("n"))
