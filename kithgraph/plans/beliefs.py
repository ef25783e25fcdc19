"""Belief and contradiction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.functions import ids
from kithgraph.operators import beliefs as ops
from kithgraph.plans.registry import query
from kithgraph.session import stored
from kithgraph.sources.graph import Graph

BELIEF_SQL = """,
b AS (SELECT 'belief_'||substr(sha256('{"object":"'||dst_label||':'||dst||'","polarity":"unknown","predicate":"'||rel||'","subject":"'||src_label||':'||src||'"}'), 1, 16) AS id,
  src_label||':'||src AS subject_ref, rel AS predicate, dst_label||':'||dst AS object_ref, src, dst, CASE rel WHEN 'MADE' THEN 0.9 WHEN 'MENTIONS' THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence,
  CASE rel WHEN 'MENTIONS' THEN 'event:'||src END AS event_id FROM edges)
"""


def belief_edges(edges: DataFrame) -> DataFrame:
    rel = F.col("rel")
    return edges.withColumns({
        "confidence": F.when(rel == "MADE", "0.9").when(rel == "MENTIONS", "0.0").when(rel == "WORKS_FOR", "likely"),
        "source_uri": F.lit("crm://edges")})


def beliefs(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return ops.beliefs_from_edges(belief_edges(edges), F.when(F.col("rel") == "MENTIONS", F.concat(F.lit("event:"), "src")))


@query("b01_beliefs_from_edges", sql=BELIEF_SQL + "SELECT id, subject_ref, predicate, object_ref, confidence FROM b")
def beliefs_from_edges(g: Graph) -> DataFrame:
    return beliefs(g.edges)[0].select("id", "subject_ref", "predicate", "object_ref", "confidence")


@query("b01_evidence", sql=BELIEF_SQL + "SELECT 'evidence_'||id AS id, id AS belief_id, 'supports' AS relation_type, event_id FROM b")
def evidence(g: Graph) -> DataFrame:
    return beliefs(g.edges)[1].select("id", "belief_id", "relation_type", "event_id")


@query("b02_preview_beliefs", sql="""
SELECT 'Person:'||p.id AS subject_ref, 'MADE' AS predicate, CASE WHEN c.status = 'open' THEN 'Entity:'||c.id ELSE 'Commitment:'||c.id END AS object_ref FROM commitment c JOIN person p ON p.id = c.owner_id""")
def preview_beliefs(g: Graph) -> DataFrame:
    """Each order is a preview: its customer and, unless open, its commitment are mentioned."""
    none = F.lit(None).cast("string")
    rels = g.commitments.select(F.col("id").alias("interaction_id"), F.col("owner_id").alias("src"), F.lit("MADE").alias("rel"), F.col("id").alias("dst"),
                                none.alias("confidence"), F.lit("erp://").alias("source_uri"))
    mentions = g.commitments.select(F.col("id").alias("interaction_id"), F.lit("persons").alias("collection"), F.col("owner_id").alias("id"), none.alias("canonical_id"),
                                    none.alias("temp_id"), F.lit("x").alias("name")) \
        .unionByName(g.commitments.filter(F.col("status") != "open").select(
            F.col("id").alias("interaction_id"), F.lit("commitments").alias("collection"), F.lit("").alias("id"), none.alias("canonical_id"), F.col("id").alias("temp_id"), none.alias("name")))
    rows, _ = ops.beliefs_from_edges(ops.preview_edges(rels, mentions))
    return rows.select("subject_ref", "predicate", "object_ref")


@query("b03_contradiction_markers", sql="""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'CONTRADICTS' ELSE 'DISPUTES' END AS rel, CASE WHEN event_type = 'error' THEN 'event://error' ELSE 'interaction://'||event_id END AS source_uri
FROM events WHERE event_type IN ('error', 'view')""", graph=False)
def contradiction_markers(g: Graph) -> DataFrame:
    kind = F.col("event_type")
    lines = g.table("events").select(
        F.concat(F.lit("i:"), "event_id").alias("src"), F.when(kind.isin("error", "view"), F.concat(F.lit("p:"), "user_id")).alias("dst"), F.when(kind == "error", "").otherwise("DISPUTES").alias("rel"),
        F.when(kind == "error", "event://error").alias("source_uri"), F.concat(F.lit("interaction://"), "event_id").alias("interaction_source"))
    return ops.contradiction_markers(lines).select(F.substring_index("src", ":", -1).cast("bigint").alias("event_id"), "rel", "source_uri")


@query("j22_about_links", sql=BELIEF_SQL + """
SELECT DISTINCT id AS src, 'ABOUT' AS rel, e AS dst FROM (SELECT id, unnest([src, dst]) AS e FROM b) WHERE e IN (SELECT id FROM nodes WHERE label <> 'Interaction')""")
def about_links(g: Graph) -> DataFrame:
    return ops.about_links(beliefs(g.edges)[0], g.nodes.filter(F.col("label") != "Interaction"))


@query("j23_support_links", sql=BELIEF_SQL + """
SELECT CASE WHEN event_id IS NOT NULL THEN 'Event' ELSE 'Evidence' END AS src_label, count(*)::BIGINT AS n, round(sum(CASE WHEN confidence = 0 THEN 0.5 ELSE confidence END), 4) AS total FROM b GROUP BY 1""")
def support_links(g: Graph) -> DataFrame:
    return ops.support_links(beliefs(g.edges)[1]).groupBy("src_label").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("total"))


@query("s15_belief_sink", sql=BELIEF_SQL + """
SELECT id, CASE WHEN predicate IN ('MADE','MENTIONS') THEN CASE WHEN confidence = 0 THEN 0.5 ELSE confidence END ELSE 0.7 END::DOUBLE AS confidence,
  CASE WHEN predicate = 'MENTIONS' THEN '2024-01-31' ELSE '2023-01-01' END AS created_on, CASE WHEN predicate IN ('MADE','MENTIONS') THEN '2024-01-31' ELSE '2023-01-01' END AS updated_on FROM b""")
def belief_sink(g: Graph) -> DataFrame:
    """Stored beliefs of all but mentions, then an upsert of commitments and mentions."""
    rows = beliefs(g.edges)[0]
    day = F.lit("2023-01-01").cast("timestamp")
    stored = rows.filter(F.col("predicate") != "MENTIONS").withColumns({"confidence": F.lit(0.7), "created_at": day, "updated_at": day})
    merged = ops.upsert_beliefs(stored, rows.filter(F.col("predicate").isin("MADE", "MENTIONS")), F.lit("2024-01-31").cast("timestamp"))
    return merged.select("id", "confidence", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"))


@query("b04_belief_projection", sql=BELIEF_SQL + """
SELECT (SELECT count(*) FROM b)::BIGINT AS beliefs, (SELECT count(*) FROM b)::BIGINT AS supports,
  (SELECT count(*) FROM (SELECT DISTINCT id, e FROM (SELECT id, unnest([src, dst]) AS e FROM b) WHERE e IN (SELECT id FROM nodes)))::BIGINT AS about""")
def belief_projection(g: Graph) -> DataFrame:
    rows, proofs = beliefs(stored(g.edges, "edges"))
    parts = {"beliefs": rows.select("id").distinct(), "supports": ops.support_links(proofs), "about": ops.about_links(rows, g.nodes)}
    # one after the other, so that the disk holds what one of them sends
    counts = [stored(part.agg(F.count("*").alias(name)), name) for name, part in parts.items()]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


@query("b07_statement_fields", sql="""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'flat:'||o_custkey ELSE 'Person:'||o_custkey END AS subject_ref, 'OWNS' AS predicate,
  CASE o_orderstatus WHEN 'F' THEN o_orderpriority WHEN 'O' THEN o_orderkey::VARCHAR ELSE 'Thing:'||o_orderkey END AS object_ref, CASE WHEN o_orderstatus = 'P' THEN 'Thing' END AS object_label FROM orders""", graph=False)
def statement_fields(g: Graph) -> DataFrame:
    state = F.col("o_orderstatus")
    obj = F.when(state == "P", F.struct(F.concat(F.lit("Thing:"), "o_orderkey").alias("ref"), F.lit("Thing").alias("label"), F.lit(None).cast("bigint").alias("value"))) \
        .otherwise(F.struct(F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("label"), F.col("o_orderkey").alias("value")))
    rows = g.table("orders").select(
        "o_orderkey", F.when(state == "F", F.concat(F.lit("flat:"), "o_custkey")).alias("subject_ref"), F.when(state == "F", "OWNS").otherwise("").alias("predicate"),
        F.when(state == "F", F.col("o_orderpriority")).alias("object_ref"),
        F.to_json(F.struct(F.struct(F.concat(F.lit("Person:"), "o_custkey").alias("ref")).alias("subject"), F.lit("OWNS").alias("predicate"), obj.alias("object"))).alias("statement"))
    return ops.statement_fields(rows).select("o_orderkey", "subject_ref", "predicate", "object_ref", "object_label")


# New beliefs: returned lines; existing ones: all other lines.  A part is owned by its supplier for 30
# days from shipping, and its buyers disagree on the delivery state.
CONFLICT_SQL = """
WITH lines AS (SELECT l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey||'-'||strftime(l_shipdate, '%Y%m%d')||'-'||l_quantity::INT AS k, * FROM lineitem),
bel AS (SELECT 'own:'||k AS id, 'Project:'||l_partkey AS subject_ref, 'OWNS' AS predicate, 'Contract:'||l_suppkey AS object_ref, CASE WHEN l_linenumber <= 4 THEN 'Contract' WHEN l_linenumber = 5 THEN 'Org' END AS object_label,
    l_shipdate::DATE AS start_at, CASE WHEN l_quantity <= 45 THEN (l_shipdate + INTERVAL 30 DAY)::DATE END AS end_at, l_returnflag = 'R' AS is_new FROM lines
  UNION ALL SELECT 'int:'||k, 'Project:'||l_partkey, 'INTERESTED_IN', 'Flag:'||l_linestatus, CASE WHEN l_linenumber <= 4 THEN 'Flag' WHEN l_linenumber = 5 THEN 'Note' END, NULL, NULL, l_returnflag = 'R' FROM lines
  UNION ALL SELECT 'state:'||k, 'Project:'||l_partkey, 'STATE', 'Mode:'||l_linenumber, 'Mode'||(l_linenumber >= 6), NULL, NULL, l_returnflag = 'R' FROM lines),
pairs AS (SELECT n.id, n.subject_ref, n.predicate, n.object_ref, CASE
    WHEN n.predicate = 'OWNS' AND n.start_at <= e.end_at AND e.start_at <= n.end_at AND n.object_ref <> e.object_ref THEN 'temporal_overlap'
    WHEN n.predicate = 'OWNS' AND n.object_ref <> e.object_ref THEN 'cardinality_conflict'
    WHEN n.object_label <> e.object_label THEN 'type_mismatch'
    WHEN n.object_ref <> e.object_ref AND n.predicate = 'INTERESTED_IN' THEN 'value_disagreement' END AS code
  FROM bel n JOIN bel e ON n.is_new AND NOT e.is_new AND n.subject_ref = e.subject_ref AND n.predicate = e.predicate)
"""
PARADOX = (("STATE", None), (None, "Project:7"))


def conflict_beliefs(g: Graph) -> tuple[DataFrame, DataFrame]:
    t = g.table("lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"),
                                                        F.col("l_quantity").cast("int")))
    line = F.col("l_linenumber")
    subject, none = F.concat(F.lit("Project:"), "l_partkey").alias("subject_ref"), F.lit(None).cast("date")
    flag = F.col("l_returnflag").alias("flag")

    def rows(prefix: str, predicate: str, obj: F.Column, label: F.Column, start: F.Column, end: F.Column) -> DataFrame:
        return t.select(F.concat(F.lit(prefix), "k").alias("id"), subject, F.lit(predicate).alias("predicate"), obj.alias("object_ref"), label.alias("object_label"),
                        start.alias("start_at"), end.alias("end_at"), flag)

    every = rows("own:", "OWNS", F.concat(F.lit("Contract:"), "l_suppkey"), F.when(line <= 4, "Contract").when(line == 5, "Org"), F.to_date("l_shipdate"),
                 F.when(F.col("l_quantity") <= 45, F.date_add(F.to_date("l_shipdate"), 30))) \
        .unionByName(rows("int:", "INTERESTED_IN", F.concat(F.lit("Flag:"), "l_linestatus"), F.when(line <= 4, "Flag").when(line == 5, "Note"), none, none)) \
        .unionByName(rows("state:", "STATE", F.concat(F.lit("Mode:"), line), F.concat(F.lit("Mode"), (line >= 6).cast("string")), none, none))
    return every.filter("flag = 'R'").drop("flag"), every.filter("flag <> 'R'").drop("flag")


@query("j16_belief_pairs", sql=CONFLICT_SQL + "SELECT id, count(*)::BIGINT AS n_pairs FROM pairs GROUP BY 1", graph=False)
def belief_pairs(g: Graph) -> DataFrame:
    """Number of existing beliefs each new belief is compared with."""
    new, existing = conflict_beliefs(g)
    known = existing.join(new.select("id").distinct(), "id", "left_anti")
    return ops.key_counts(new, known, ["subject_ref", "predicate"], "n_pairs").filter("n_pairs > 0").groupBy("id").agg(F.sum("n_pairs").alias("n_pairs"))


@query("j17_temporal_overlap", sql=CONFLICT_SQL + """
SELECT n.id, count(*)::BIGINT AS n_overlap FROM bel n JOIN bel e ON n.is_new AND NOT e.is_new AND n.subject_ref = e.subject_ref AND n.predicate = e.predicate AND n.start_at <= e.end_at AND e.start_at <= n.end_at GROUP BY 1""", graph=False)
def temporal_overlap(g: Graph) -> DataFrame:
    new, existing = conflict_beliefs(g)
    return ops.overlap_counts(new, existing, ["subject_ref", "predicate"], "n_overlap").filter("n_overlap > 0").groupBy("id").agg(F.sum("n_overlap").alias("n_overlap"))


@query("b05_pair_classification", sql=CONFLICT_SQL + """
SELECT id, count(*) FILTER (code = 'temporal_overlap')::BIGINT AS n_temporal, count(*) FILTER (code = 'cardinality_conflict')::BIGINT AS n_cardinality,
  count(*) FILTER (code = 'type_mismatch')::BIGINT AS n_type_mismatch, count(*) FILTER (code = 'value_disagreement')::BIGINT AS n_disagreement FROM pairs GROUP BY 1 HAVING count(code) > 0""", graph=False)
def pair_classification(g: Graph) -> DataFrame:
    """Contradictions of each new belief by code, counted without writing out the pairs."""
    new, existing = conflict_beliefs(g)
    names = ["n_temporal", "n_cardinality", "n_type_mismatch", "n_disagreement"]
    rows = ops.conflict_counts(new, existing).groupBy("id").agg(*[F.sum(c).alias(c) for c in names])
    return rows.filter(" + ".join(names) + " > 0")


@query("b06_paradox_override", sql=CONFLICT_SQL + """
SELECT predicate, predicate = 'STATE' OR subject_ref = 'Project:7' AS paradoxical, count(code)::BIGINT AS n FROM pairs GROUP BY ALL HAVING count(code) > 0""", graph=False)
def paradox_override(g: Graph) -> DataFrame:
    new, existing = conflict_beliefs(g)
    total = F.col("n_temporal") + F.col("n_cardinality") + F.col("n_type_mismatch") + F.col("n_disagreement")
    counts = ops.conflict_counts(new, existing, ops.Rules(paradox=PARADOX))
    return counts.groupBy("predicate", "paradoxical").agg(F.sum(total).alias("n")).filter("n > 0")


@query("a08_contradiction_counts", sql=CONFLICT_SQL + """
SELECT count(*) FILTER (NOT par AND code IN ('temporal_overlap','cardinality_conflict'))::BIGINT AS hard, count(*) FILTER (NOT par AND code IN ('type_mismatch','value_disagreement'))::BIGINT AS soft,
  count(*) FILTER (par AND code IS NOT NULL)::BIGINT AS paradoxical, count(code)::BIGINT AS total FROM (SELECT *, predicate = 'STATE' OR subject_ref = 'Project:7' AS par FROM pairs)""", graph=False)
def contradiction_counts(g: Graph) -> DataFrame:
    new, existing = conflict_beliefs(g)
    return ops.counts_by_type(ops.conflict_counts(new, existing, ops.Rules(paradox=PARADOX)))


@query("s16_contradiction_sink", sql="""
WITH ord AS (SELECT DISTINCT 'Person:'||o_custkey AS s, o_orderpriority AS o, o_orderdate < DATE '2001-07-01' AS old FROM orders),
p AS (SELECT n.s, n.o AS a, e.o AS b FROM ord n JOIN ord e ON NOT n.old AND e.old AND n.s = e.s AND n.o <> e.o WHERE (e.s, e.o) NOT IN (SELECT (s, o) FROM ord WHERE NOT old))
SELECT 'INVOLVES' AS rel, 2 * count(*)::BIGINT AS n FROM p UNION ALL SELECT 'DIALECTICAL_TENSION', count(*) FROM p UNION ALL SELECT 'node', count(*) FROM p""", graph=False)
def contradiction_sink(g: Graph) -> DataFrame:
    """Contradiction nodes and edges of the last month's orders against all earlier ones.

    A belief is identified by its statement, so equal statements of one owner are one belief and a pair
    exists per two different priorities, not per two orders.
    """
    cut = F.lit("2001-07-01").cast("timestamp")
    rows = g.table("orders").select(F.concat(F.lit("Person:"), "o_custkey").alias("subject_ref"), F.lit("OWNS").alias("predicate"),
                                    F.col("o_orderpriority").alias("object_ref"), (F.col("o_orderdate") < cut).alias("old")).distinct()
    stated = rows.withColumns({
        "id": ids.belief_id(F.col("subject_ref"), F.col("predicate"), F.col("object_ref"), F.lit("unknown")),
        "object_label": F.lit(None).cast("string"), "start_at": F.lit(None).cast("date"), "end_at": F.lit(None).cast("date")})
    pairs = ops.contradictions(stated.filter(~F.col("old")), stated.filter("old"))
    nodes, involves, tension = ops.contradiction_graph(pairs)
    parts = nodes.select(F.lit("node").alias("rel")).unionByName(involves.select("rel")).unionByName(tension.select("rel"))
    return parts.groupBy("rel").agg(F.count("*").alias("n"))
