"""Merge, sink and guard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.operators import extract as ex
from kithgraph.operators import guard
from kithgraph.plans.registry import query
from kithgraph.sources import sinks
from kithgraph.sources.graph import Graph


def stored_people(g: Graph) -> DataFrame:
    day = F.lit("2023-12-31").cast("timestamp")
    return g.persons.select(
        F.lit("Person").alias("label"), "id", F.create_map(F.lit("segment"), F.col("segment"), F.lit("stage"), F.lit("new")).alias("props"),
        F.lit("crm://import").alias("source_uri"), day.alias("created_at"), day.alias("updated_at"), day.alias("first_seen_at"),
        day.alias("last_seen_at"), F.lit("loader").alias("created_by"), F.lit("loader").alias("updated_by"))


def person_updates(g: Graph) -> DataFrame:
    """Every event updates its user; clicks carry a null stage, which must not overwrite."""
    kind = F.col("event_type")
    return g.table("events").select(
        F.lit("Person").alias("label"), F.concat(F.lit("person:"), "user_id").alias("id"),
        F.create_map(F.lit("last_event"), kind, F.lit("stage"), F.when(kind != "click", kind), F.lit("id"), F.lit("x")).alias("props"),
        F.concat(F.lit("event://"), kind).alias("source_uri"), F.col("ts"), F.col("event_id").alias("seq"), kind.alias("user"))


@query("s06_node_upsert", sql=""",
upd AS (SELECT 'person:'||user_id AS id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS last_event,
  arg_max(event_type, struct_pack(a := ts, b := event_id)) FILTER (event_type <> 'click') AS stage, max(ts) AS updated_at FROM events GROUP BY 1)
SELECT p.id, p.segment, u.last_event, coalesce(u.stage, 'new') AS stage, 'crm://import' AS source_uri, 'loader' AS created_by, coalesce(u.last_event, 'loader') AS updated_by,
  '2023-12-31' AS created_on, strftime(coalesce(u.updated_at, TIMESTAMP '2023-12-31'), '%Y-%m-%d %H:%M:%S') AS updated_at FROM person p LEFT JOIN upd u ON u.id = p.id""")
def node_upsert(g: Graph) -> DataFrame:
    merged = sinks.upsert_nodes(stored_people(g), person_updates(g))
    return merged.select("id", *[F.element_at("props", k).alias(k) for k in ("segment", "last_event", "stage")], "source_uri", "created_by",
                         "updated_by", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"),
                         F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def line_edges(g: Graph) -> DataFrame:
    return g.table("lineitem").select(
        F.lit(None).cast("string").alias("src_label"), F.concat(F.lit("commitment:"), "l_orderkey").alias("src"), F.lit("RELATES_TO").alias("rel"),
        F.when(F.col("l_linestatus") == "F", "Project").alias("dst_label"), F.concat(F.lit("project:"), "l_partkey").alias("dst"),
        F.create_map(F.lit("flag"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.lit("line"), F.col("l_linenumber").cast("string")).alias("props"),
        F.lit("erp://lines").alias("source_uri"), F.col("l_shipdate").alias("ts"), F.col("l_linenumber").alias("seq"), F.lit("erp").alias("user"))


@query("s07_relationship_upsert", sql=""",
kept AS (SELECT 'commitment:'||l_orderkey AS src, 'project:'||l_partkey AS dst, l_returnflag, l_linenumber, l_shipdate FROM lineitem
  JOIN part ON p_partkey = l_partkey AND p_size > 25 JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P')
SELECT src, 'RELATES_TO' AS rel, dst, arg_max(l_linenumber::VARCHAR, struct_pack(a := l_shipdate, b := l_linenumber)) AS line,
  arg_max(l_returnflag, struct_pack(a := l_shipdate, b := l_linenumber)) FILTER (l_returnflag <> 'N') AS flag, strftime(min(l_shipdate), '%Y-%m-%d') AS first_seen, strftime(max(l_shipdate), '%Y-%m-%d') AS last_seen
FROM kept GROUP BY ALL""")
def relationship_upsert(g: Graph) -> DataFrame:
    """Only edges between stored nodes survive: large parts and orders that are not pending."""
    nodes = g.table("part").filter("p_size > 25").select(F.lit("Project").alias("label"), F.concat(F.lit("project:"), "p_partkey").alias("id")) \
        .unionByName(g.table("orders").filter("o_orderstatus <> 'P'").select(F.lit("Commitment").alias("label"), F.concat(F.lit("commitment:"), "o_orderkey").alias("id")))
    merged = sinks.upsert_edges(sinks.empty_items(g.spark, sinks.EDGE_KEY), line_edges(g), nodes)
    return merged.select("src", "rel", "dst", F.element_at("props", "line").alias("line"), F.element_at("props", "flag").alias("flag"),
                         F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"))


def bundles(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each event is a bundle: the interaction and its user, the mention, and a tension line for errors."""
    e = g.table("events").withColumn("interaction_id", F.col("event_id").cast("string")).withColumn("user", F.lit("ui")) \
        .withColumn("source_uri", F.when(F.col("event_type") != "click", F.concat(F.lit("event://"), "event_type")))
    inter, person = F.concat(F.lit("interaction:"), "event_id"), F.concat(F.lit("person:"), "user_id")

    def nodes(label: str, ident: F.Column) -> DataFrame:
        return e.select("interaction_id", F.lit(label).alias("label"), ident.alias("id"), F.create_map(F.lit("kind"), F.col("event_type")).alias("props"),
                        "source_uri", "ts", F.col("event_id").alias("seq"), "user")

    def edges(rows: DataFrame, rel: str) -> DataFrame:
        return rows.select("interaction_id", F.lit("Interaction").alias("src_label"), inter.alias("src"), F.lit(rel).alias("rel"), F.lit("Person").alias("dst_label"),
                           person.alias("dst"), F.create_map(F.lit("kind"), F.col("event_type")).alias("props"), "source_uri", "ts", F.col("event_id").alias("seq"), "user")

    return (nodes("Interaction", inter).unionByName(nodes("Person", person)), edges(e, "MENTIONS"),
            edges(e.filter("event_type = 'error'"), "DIALECTICAL_TENSION"))


@query("s08_commit_counts", sql="""
SELECT kind, count(*)::BIGINT AS n_bundles, sum(n)::BIGINT AS n FROM (
  SELECT event_id, 'nodes' AS kind, 2 AS n FROM events UNION ALL SELECT event_id, 'relationships', 1 FROM events UNION ALL SELECT event_id, 'dialectical_lines', 1 FROM events WHERE event_type = 'error') GROUP BY 1""", graph=False)
def bundle_commit_counts(g: Graph) -> DataFrame:
    nodes, edges, lines = bundles(g)
    _, _, counts = sinks.commit_bundles(sinks.empty_items(g.spark, sinks.NODE_KEY), sinks.empty_items(g.spark, sinks.EDGE_KEY), nodes, edges, lines)
    return counts.groupBy("kind").agg(F.count("*").alias("n_bundles"), F.sum("n").alias("n"))


@query("s08_bundle_commit", sql="""
SELECT 'MENTIONS' AS rel, coalesce('event://'||CASE WHEN event_type <> 'click' THEN event_type END, 'interaction://'||event_id) AS source_uri, 'interaction:'||event_id AS src, 'person:'||user_id AS dst FROM events
UNION ALL SELECT 'DIALECTICAL_TENSION', 'event://error', 'interaction:'||event_id, 'person:'||user_id FROM events WHERE event_type = 'error'""", graph=False)
def bundle_commit(g: Graph) -> DataFrame:
    nodes, edges, lines = bundles(g)
    _, new_edges, _ = sinks.commit_bundles(sinks.empty_items(g.spark, sinks.NODE_KEY), sinks.empty_items(g.spark, sinks.EDGE_KEY), nodes, edges, lines)
    return new_edges.select("rel", "source_uri", "src", "dst")


@query("s09_concept_inserts", sql="""
SELECT concept_id AS id, 'OrgCategory' AS kind, count(*)::BIGINT AS n_links FROM org GROUP BY 1
UNION ALL SELECT segment, 'StakeholderType', count(*) FROM person GROUP BY 1 UNION ALL SELECT type, 'EventForm', count(*) FROM interaction GROUP BY 1""")
def concept_inserts(g: Graph) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = g.orgs.select(F.lit("Org").alias("label"), "id", "concept_id", none.alias("concept_kind"), F.lit("crm://").alias("source_uri")) \
        .unionByName(g.persons.select(F.lit("Person").alias("label"), "id", F.col("segment").alias("concept_id"), none.alias("concept_kind"), F.lit("crm://").alias("source_uri"))) \
        .unionByName(g.interactions.select(F.lit("Interaction").alias("label"), "id", F.col("type").alias("concept_id"), F.lit("EventForm").alias("concept_kind"), "source_uri"))
    concepts, links = sinks.concept_inserts(rows)
    counts = links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_links"))
    return concepts.select("id", "kind").join(counts, "id")


STATUS_SQL = """
WITH log AS (SELECT 'session:'||user_id AS interaction_id, CASE event_type WHEN 'view' THEN 'draft' WHEN 'click' THEN 'preview_ready' WHEN 'error' THEN 'failed' ELSE 'committed' END AS state, ts, event_id FROM events),
cur AS (SELECT interaction_id, arg_max(state, struct_pack(a := ts, b := event_id)) AS state, max(ts) AS updated_at FROM log GROUP BY 1)
"""


def status_log(g: Graph) -> DataFrame:
    kind = F.col("event_type")
    return g.table("events").select(
        F.concat(F.lit("session:"), "user_id").alias("interaction_id"), F.when(kind == "view", "draft").when(kind == "click", "preview_ready")
        .when(kind == "error", "failed").otherwise("committed").alias("state"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))


@query("s11_current_status", sql=STATUS_SQL + "SELECT interaction_id, state, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM cur", graph=False)
def current_status(g: Graph) -> DataFrame:
    return sinks.current_status(status_log(g)).select("interaction_id", "state", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("s12_prune", sql=STATUS_SQL + """
SELECT state, count(*) FILTER (NOT (state IN ('committed','failed') AND updated_at < TIMESTAMP '2024-03-01 06:00:00' - INTERVAL 30 DAY))::BIGINT AS kept,
  count(*) FILTER (state IN ('committed','failed') AND updated_at < TIMESTAMP '2024-03-01 06:00:00' - INTERVAL 30 DAY)::BIGINT AS removed FROM (SELECT interaction_id, state, ts AS updated_at FROM log) GROUP BY 1""", graph=False)
def prune(g: Graph) -> DataFrame:
    kept, removed = sinks.prune(status_log(g), F.lit("2024-03-01 06:00:00").cast("timestamp"))
    both = kept.select("state", F.lit(1).alias("k"), F.lit(0).alias("r")).unionByName(removed.select("state", F.lit(0).alias("k"), F.lit(1).alias("r")))
    return both.groupBy("state").agg(F.sum("k").alias("kept"), F.sum("r").alias("removed"))


@query("s13_change_feed", sql="""
SELECT lower(label)||'s' AS collection, count(*)::BIGINT AS n FROM nodes GROUP BY 1 UNION ALL SELECT 'relationships', count(*) FROM edges WHERE rel <> 'INSTANCE_OF'""")
def change_feed(g: Graph) -> DataFrame:
    return sinks.feed_summary(sinks.change_feed(g.nodes, g.edges))


@query("s14_concept_hierarchy", sql="""
SELECT DISTINCT p_type AS src, 'PARENT_OF' AS rel, p_brand AS dst FROM part UNION SELECT 'form_part', 'PARENT_OF', p_brand FROM part
UNION SELECT 'old', 'PARENT_OF', p_type FROM part""", graph=False)
def concept_hierarchy(g: Graph) -> DataFrame:
    """Brands get their types and a form as parents; brands lose an old parent, types keep theirs."""
    part = g.table("part")
    concepts = part.select(F.col("p_brand").alias("id"), F.array("p_type", F.lit("form_part"), F.lit("")).alias("parents"))
    old = part.select(F.explode(F.array("p_brand", "p_type")).alias("dst")).distinct().select(F.lit("old").alias("src"), F.lit("PARENT_OF").alias("rel"), "dst")
    return sinks.replace_hierarchy(old, concepts)


@query("s17_learned_append", sql="""
SELECT name, context, '1.4.'||(7 + row_number() OVER (ORDER BY name NULLS FIRST, context NULLS FIRST)) AS added_in_version FROM (
  SELECT DISTINCT p_name AS name, CASE WHEN p_type <> 'ECONOMY' THEN p_type END AS context FROM part
  EXCEPT SELECT p_name, CASE WHEN p_type <> 'ECONOMY' THEN p_type END FROM part WHERE p_size <= 5)""", graph=False)
def learned_append(g: Graph) -> DataFrame:
    context = F.when(F.col("p_type") != "ECONOMY", F.col("p_type"))
    names = g.table("part").select(F.col("p_name").alias("name"), context.alias("context"), "p_size")
    known = names.filter("p_size <= 5").select("name", "context")
    added = sinks.append_learned(known, names.select("name", "context"), ["name", "context"], "1.4.7", F.lit("2024-01-31").cast("timestamp"))
    return added.select("name", "context", "added_in_version")


@query("j15_property_relationships", sql="""
SELECT 'WORKS_FOR' AS rel, id AS src, org_id AS dst FROM person UNION ALL SELECT 'MADE', id, owner_id FROM commitment
UNION ALL SELECT 'PARTY_TO', id, org_id FROM contract UNION ALL SELECT 'PARTY_TO', id, 'org:home' FROM contract""")
def property_relationships(g: Graph) -> DataFrame:
    src = F.lit("crm://").alias("source_uri")
    rows = g.persons.select(F.lit("Person").alias("label"), "id", F.create_map(F.lit("org_id"), F.col("org_id"), F.lit("name"), F.col("name")).alias("props"), src) \
        .unionByName(g.commitments.select(F.lit("Commitment").alias("label"), "id", F.create_map(F.lit("owner_id"), F.col("owner_id"), F.lit("org_id"), F.lit("org:0")).alias("props"), src)) \
        .unionByName(g.contracts.select(F.lit("Contract").alias("label"), "id", F.create_map(F.lit("org_ids"), F.to_json(F.array("org_id", F.lit("org:home")))).alias("props"), src))
    return ex.property_relationships(rows).select("rel", "src", "dst")


BUNDLE_SQL = """
WITH ent AS (SELECT o_orderkey AS interaction_id, 'Commitment' AS label, 'commitment:'||o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS concept_id FROM orders
  UNION ALL SELECT o_orderkey, 'Person', 'person:'||o_custkey, NULL FROM orders)
"""


def bundle_entities(g: Graph) -> DataFrame:
    orders = g.table("orders")
    key = F.col("o_orderkey").alias("interaction_id")
    closed = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    return orders.select(key, F.lit("commitments").alias("collection"), F.concat(F.lit("commitment:"), "o_orderkey").alias("id"),
                         F.create_map(F.lit("category"), closed, F.lit("name"), F.col("o_orderpriority")).alias("props"), F.lit("erp://").alias("source_uri")) \
        .unionByName(orders.select(key, F.lit("persons").alias("collection"), F.concat(F.lit("person:"), "o_custkey").alias("id"),
                                   F.create_map(F.lit("name"), F.lit("x")).alias("props"), F.lit("erp://").alias("source_uri")))


@query("x06_bundle_build", sql=BUNDLE_SQL + """
SELECT label, count(*)::BIGINT AS n_nodes, count(concept_id)::BIGINT AS n_links, count(DISTINCT concept_id)::BIGINT AS n_concepts FROM ent GROUP BY 1""", graph=False)
def bundle_build(g: Graph) -> DataFrame:
    nodes, _, links = ex.bundle_nodes(bundle_entities(g))
    counts = nodes.groupBy("label").agg(F.count("*").alias("n_nodes"))
    linked = links.groupBy(F.col("src_label").alias("label")).agg(F.count("*").alias("n_links"), F.countDistinct("dst").alias("n_concepts"))
    return counts.join(linked, "label", "left").na.fill({"n_links": 0, "n_concepts": 0})


@query("x06_derived_concepts", sql=BUNDLE_SQL + "SELECT id, 'Commitment' AS kind, 'proposed' AS status, count(*)::BIGINT AS n FROM (SELECT concept_id AS id FROM ent WHERE concept_id IS NOT NULL) GROUP BY ALL", graph=False)
def derived_concepts(g: Graph) -> DataFrame:
    _, derived, _ = ex.bundle_nodes(bundle_entities(g))
    return derived.groupBy("id", "kind", "status").agg(F.count("*").alias("n"))


@query("o01_ontology_guard", sql="""
SELECT code, count(*)::BIGINT AS n, count(DISTINCT l_orderkey)::BIGINT AS n_bundles FROM (
  SELECT l_orderkey, unnest(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN ['PARTICULAR_MISSING_INSTANCE_OF','ORPHAN_PARTICULAR'] WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN ['AUTOMATIC_FORM_CREATION_FORBIDDEN'] ELSE [] END) AS code
  FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linestatus, l_returnflag FROM lineitem)
  UNION ALL SELECT o_orderkey, 'INVALID_CONCEPT_STATUS' FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""", graph=False)
def ontology_guard(g: Graph) -> DataFrame:
    """Lines are particulars, linked by an edge, by a concept id or not at all; every order is a concept."""
    nodes, links = guard_bundles(g)
    return guard.violations(nodes, links).groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("interaction_id").alias("n_bundles"))


def guard_bundles(g: Graph) -> tuple[DataFrame, DataFrame]:
    lines = g.table("lineitem").select("l_orderkey", "l_partkey", "l_linestatus", "l_returnflag").distinct()
    state, flag, none = F.col("l_linestatus"), F.col("l_returnflag"), F.lit(None).cast("string")
    ident = F.concat_ws("/", "l_partkey", state, flag)
    particulars = lines.select(F.col("l_orderkey").alias("interaction_id"), F.lit("Particular").alias("label"), ident.alias("id"), none.alias("status"),
                               F.when(state == "O", F.lit("concept:line")).alias("concept_id"), F.when((state == "O") & (flag == "R"), "Form").alias("concept_kind"))
    concepts = g.table("orders").select(F.col("o_orderkey").alias("interaction_id"), F.lit("Concept").alias("label"), F.lit("concept:order").alias("id"),
                                        F.when(F.col("o_orderstatus") == "F", "canonical").when(F.col("o_orderstatus") == "O", "proposed").alias("status"),
                                        none.alias("concept_id"), none.alias("concept_kind"))
    links = lines.filter((state == "F") & (flag != "A")).select(F.col("l_orderkey").alias("interaction_id"), ident.alias("src"), F.lit("concept:order").alias("dst"))
    return particulars.unionByName(concepts), links


@query("o01_committable_bundles", sql="""
SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (
  SELECT l_orderkey FROM lineitem WHERE (l_linestatus = 'F' AND l_returnflag = 'A') OR (l_linestatus = 'O' AND l_returnflag = 'R'))""", graph=False)
def committable_bundles(g: Graph) -> DataFrame:
    nodes, links = guard_bundles(g)
    orders = g.table("orders").select(F.col("o_orderkey").alias("interaction_id"))
    return guard.committable(orders, guard.violations(nodes, links)).select(F.col("interaction_id").alias("o_orderkey"))
