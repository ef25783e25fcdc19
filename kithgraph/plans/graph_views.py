"""Traversal and view queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph import model
from kithgraph.functions.values import is_closed, is_primary, role_type
from kithgraph.operators import alerts as alert_ops
from kithgraph.operators import paths
from kithgraph.operators import traversal as t
from kithgraph.plans.alerts import PATH_STARTS, PATHS_SQL, path_arguments, path_starts
from kithgraph.plans.registry import query
from kithgraph.sources.graph import EDGE_TYPES, Graph

ORDERS_AS_OF = "2000-01-01"
EVENTS_AS_OF = "2024-01-31"

# Alerts used by the view queries: one per overdue open commitment.
ALERTS_SQL = """,
alerts AS (
  SELECT 'alert:'||c.id AS id, 'unresolved_commitment' AS type, CASE WHEN c.text LIKE '1%' THEN 'acknowledged' ELSE 'open' END AS status,
         c.owner_id AS stakeholder_id, p.org_id AS org_id, c.id AS entity_id, c.due_date AS first_detected_at,
         CASE WHEN c.text LIKE '1%' THEN (c.due_date + INTERVAL 45 DAY)::DATE END AS last_updated_at
  FROM commitment c JOIN person p ON p.id = c.owner_id
  WHERE c.status NOT IN ('accepted','done') AND c.due_date < DATE '2000-01-01' - INTERVAL 7 DAY)
"""


def overdue_alerts(g: Graph) -> DataFrame:
    overdue = alert_ops.unresolved_commitments(g.commitments, g.persons, F.lit(ORDERS_AS_OF).cast("date"))
    return (overdue.join(g.persons.select(F.col("id").alias("person_id"), "org_id"), "person_id")
            .select(F.concat(F.lit("alert:"), F.col("id")).alias("id"), F.lit("unresolved_commitment").alias("type"),
                    F.when(F.col("text").startswith("1"), "acknowledged").otherwise("open").alias("status"),
                    F.col("person_id").alias("stakeholder_id"), "org_id", F.col("id").alias("entity_id"),
                    F.col("due_date").alias("first_detected_at"),
                    F.when(F.col("text").startswith("1"), F.date_add("due_date", 45)).alias("last_updated_at")))


@query("j01_ego_network", sql="""
SELECT from_id AS center, count(*)::BIGINT AS n_edges, count(DISTINCT to_id)::BIGINT AS n_neighbours,
       count(DISTINCT to_label)::BIGINT AS n_labels
FROM undirected WHERE from_label IN ('Person','Org') GROUP BY 1""")
def ego_network(g: Graph) -> DataFrame:
    centers = g.persons.select("id").unionByName(g.orgs.select("id"))
    return t.ego_summary(t.ego_edges(g.edges, centers, ["Person", "Org"]))


@query("j01_ego_edges_of_orgs", sql="""
SELECT DISTINCT from_id AS center, src, rel, dst FROM undirected WHERE from_label = 'Org'""")
def ego_edges_of_orgs(g: Graph) -> DataFrame:
    return t.ego_edges(g.edges, g.orgs.select("id"), ["Org"]).select("center", "src", "rel", "dst")


@query("j02_two_hop_related_nodes", sql=""",
hop1 AS (SELECT DISTINCT from_id AS start, to_id AS node, to_label AS label FROM undirected WHERE from_label = 'Org'),
hop2 AS (SELECT DISTINCT h.start, u.to_id AS node, u.to_label AS label FROM hop1 h JOIN undirected u ON u.from_id = h.node
         WHERE u.to_label IN ('Project','Commitment')),
hits AS (SELECT start, node, label FROM hop1 WHERE label IN ('Project','Commitment') UNION SELECT start, node, label FROM hop2)
SELECT start, label, count(*)::BIGINT AS n, min(node) AS first_id, max(node) AS last_id FROM hits WHERE node <> start GROUP BY ALL""")
def two_hop(g: Graph) -> DataFrame:
    hits = t.related_nodes(g.edges, g.orgs.select("id"), ["Project", "Commitment"], 2, ["Org"], EDGE_TYPES)
    return hits.groupBy("start", "label").agg(F.count("*").alias("n"), F.min("id").alias("first_id"),
                                              F.max("id").alias("last_id"))


@query("j02_projects_of_people", sql=""",
hits AS (SELECT src AS start, dst AS id FROM involved_in
         UNION SELECT m.src, r.dst FROM made m JOIN relates_to r ON r.src = m.dst)
SELECT start, count(*)::BIGINT AS n FROM hits GROUP BY 1""")
def projects_of_people(g: Graph) -> DataFrame:
    """Two hops from every person to projects.  Only steps that can end at a project are followed."""
    useful = g.made.unionByName(g.relates_to).unionByName(g.involved_in)
    direct = t.related_nodes(useful, g.persons.select("id"), ["Project"], 1)
    through = (g.made.select(F.col("src").alias("start"), F.col("dst").alias("mid"))
               .join(g.relates_to.select(F.col("src").alias("mid"), F.col("dst").alias("id")), "mid")
               .select("start", "id"))
    return (direct.select("start", "id").unionByName(through).distinct()
            .groupBy("start").agg(F.count("*").alias("n")))


@query("j03_interactions_in_range", sql="""
SELECT p.org_id AS start, count(*)::BIGINT AS n, strftime(min(i.tm), '%Y-%m-%d %H:%M:%S') AS first_at,
       strftime(max(i.tm), '%Y-%m-%d %H:%M:%S') AS last_at
FROM interaction i JOIN person p ON p.id = i.person_id
WHERE i.tm >= TIMESTAMP '2024-01-10' AND i.tm <= TIMESTAMP '2024-01-20' GROUP BY 1""")
def interactions_in_range(g: Graph) -> DataFrame:
    hits = t.related_interactions(g.edges, g.orgs.select("id"), g.interactions_since("2024-01-10"),
                                  F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"),
                                  start_labels=["Org"], edge_types=EDGE_TYPES)
    return hits.groupBy("start").agg(F.count("*").alias("n"),
                                     F.date_format(F.min("at"), "yyyy-MM-dd HH:mm:ss").alias("first_at"),
                                     F.date_format(F.max("at"), "yyyy-MM-dd HH:mm:ss").alias("last_at"))


@query("j04_project_nodes", sql="""
SELECT DISTINCT dst AS project_id, 'Commitment' AS label, src AS id FROM relates_to""")
def project_nodes(g: Graph) -> DataFrame:
    groups = model.label_groups()
    return t.project_nodes(g.edges, groups["commitment"] + groups["issue"] + groups["risk"])


@query("j05_project_stakeholders", sql="""
SELECT i.dst AS project_id, i.src AS stakeholder_id, 'INVOLVED_IN' AS rel_type, p.org_id
FROM involved_in i LEFT JOIN person p ON p.id = i.src""")
def project_stakeholders(g: Graph) -> DataFrame:
    groups = model.label_groups()
    return t.project_stakeholders(g.edges, groups["person"] + groups["org"], groups["org"], ["INVOLVED_IN"],
                                  ["WORKS_FOR"]).select("project_id", "stakeholder_id", "rel_type", "org_id")


@query("j06_project_map", sql=""",
chain AS (SELECT r.dst AS project_id, r.src AS commitment_id, p.id AS person_id, p.org_id
          FROM relates_to r LEFT JOIN made m ON m.dst = r.src LEFT JOIN person p ON p.id = m.src),
pc AS (SELECT DISTINCT c.project_id, k.id AS contract_id FROM (SELECT DISTINCT project_id, org_id FROM chain) c JOIN contract k ON k.org_id = c.org_id),
a AS (SELECT project_id, count(DISTINCT commitment_id) AS n_commitments, count(DISTINCT person_id) AS n_persons, count(DISTINCT org_id) AS n_orgs FROM chain GROUP BY 1),
b AS (SELECT project_id, count(*) AS n_contracts FROM pc GROUP BY 1)
SELECT pr.id AS project_id, coalesce(n_commitments,0)::BIGINT AS n_commitments, coalesce(n_persons,0)::BIGINT AS n_persons,
       coalesce(n_orgs,0)::BIGINT AS n_orgs, coalesce(n_contracts,0)::BIGINT AS n_contracts,
       (coalesce(n_persons,0) + coalesce(n_contracts,0))::BIGINT AS n_edges
FROM project pr LEFT JOIN a ON a.project_id = pr.id LEFT JOIN b ON b.project_id = pr.id""")
def project_map(g: Graph) -> DataFrame:
    return t.project_map(g.projects, g.made, g.relates_to, g.works_for, g.party_to)


@query("j07_interaction_search_slice", sql=""",
hits AS (SELECT id, person_id FROM interaction WHERE contains(lower(coalesce(summary,'')), 'purchase') OR contains(lower(coalesce(source_uri,'')), 'purchase'))
SELECT 'Interaction' AS label, id FROM hits UNION SELECT 'Person', person_id FROM hits
UNION SELECT 'Org', p.org_id FROM hits h JOIN person p ON p.id = h.person_id""")
def interaction_search(g: Graph) -> DataFrame:
    return t.interaction_slice(g.interactions, g.mentions, g.works_for, "Purchase")[0]


@query("u02_view_segments", sql=""",
hits AS (SELECT id, person_id FROM interaction WHERE contains(lower(coalesce(source_uri,'')), 'error') OR contains(lower(coalesce(summary,'')), 'error'))
SELECT rel, count(*)::BIGINT AS n FROM (
  SELECT DISTINCT id AS src, 'MENTIONS' AS rel, person_id AS dst FROM hits
  UNION SELECT p.id, 'WORKS_FOR', p.org_id FROM hits h JOIN person p ON p.id = h.person_id) GROUP BY 1""")
def view_segments(g: Graph) -> DataFrame:
    return t.interaction_slice(g.interactions, g.mentions, g.works_for, "error")[1].groupBy("rel") \
        .agg(F.count("*").alias("n"))


@query("j08_alerts_of_entity", sql=ALERTS_SQL + """,
named AS (SELECT stakeholder_id AS entity, id FROM alerts UNION SELECT org_id, id FROM alerts UNION SELECT entity_id, id FROM alerts)
SELECT entity, count(*)::BIGINT AS n_alerts, min(id) AS first_alert FROM named GROUP BY 1""")
def alerts_of_entity(g: Graph) -> DataFrame:
    return t.alerts_of(overdue_alerts(g)).groupBy("entity").agg(F.count("*").alias("n_alerts"),
                                                               F.min("alert_id").alias("first_alert"))


@query("j09_scope_members", sql=""",
m AS (SELECT org_id AS scope_id, id, 'Person' AS label FROM person UNION SELECT org_id, id, 'Contract' FROM contract
      UNION SELECT from_id, to_id, to_label FROM undirected WHERE from_label = 'Org')
SELECT scope_id, label, count(*)::BIGINT AS n FROM m GROUP BY ALL""")
def scope_members(g: Graph) -> DataFrame:
    nodes = (g.persons.select("id", "org_id", F.lit("Person").alias("label"))
             .unionByName(g.contracts.select("id", "org_id", F.lit("Contract").alias("label"))))
    return t.scope_members(nodes, g.edges, "Org", "org_id").groupBy("scope_id", "label").agg(F.count("*").alias("n"))


@query("j18_reasoning_paths", sql=PATHS_SQL + "SELECT start, target, hops::BIGINT AS hops, path, candidate::BIGINT AS candidate FROM cand")
def reasoning_paths(g: Graph) -> DataFrame:
    """The first trails of up to four hops from every stakeholder, organisation and project, as many as a ranking takes in."""
    targets, rels = path_arguments()
    found = paths.enumerate_paths(g.edges, path_starts(g), targets, rels, 4, 15, start_labels=PATH_STARTS, edge_types=EDGE_TYPES)
    return found.select("start", "target", F.col("hops").cast("bigint").alias("hops"), F.array_join("edge_ids", ">").alias("path"),
                        F.col("candidate").cast("bigint").alias("candidate"))


@query("a01_distinct_collection", sql="""
SELECT from_id AS center, to_label AS label, count(DISTINCT to_id)::BIGINT AS n FROM undirected WHERE from_label = 'Project' GROUP BY ALL""")
def distinct_collection(g: Graph) -> DataFrame:
    nodes = t.ego_nodes(g.edges, g.projects.select("id", F.lit("Project").alias("label")), ["Project"])
    return nodes.filter(F.col("id") != F.col("center")).groupBy("center", "label").agg(F.count("*").alias("n"))


@query("a02_total_beside_page", sql=ALERTS_SQL + """
SELECT (SELECT count(*) FROM alerts WHERE status = 'open')::BIGINT AS total, id, status FROM alerts WHERE status = 'open'
ORDER BY coalesce(last_updated_at, first_detected_at) DESC, id LIMIT 20""")
def total_beside_page(g: Graph) -> DataFrame:
    page = alert_ops.alert_page(overdue_alerts(g), statuses=["open"], page=1, size=20)
    return page.select("total", "id", "status")


@query("l01_page", sql=ALERTS_SQL + """
SELECT id, ceil((SELECT count(*) FROM alerts) / 50.0)::BIGINT AS total_pages FROM alerts ORDER BY coalesce(last_updated_at, first_detected_at) DESC, id LIMIT 50 OFFSET 100""")
def page(g: Graph) -> DataFrame:
    return alert_ops.alert_page(overdue_alerts(g), page=3, size=50).select("id", "total_pages")


@query("l03_alerts_newest_first", sql=ALERTS_SQL + """
SELECT id, first_detected_at, last_updated_at, row_number() OVER (ORDER BY coalesce(last_updated_at, first_detected_at) DESC, id)::BIGINT AS position
FROM (SELECT * FROM alerts ORDER BY coalesce(last_updated_at, first_detected_at) DESC, id LIMIT 20)""")
def alerts_newest_first(g: Graph) -> DataFrame:
    page = alert_ops.alert_page(overdue_alerts(g), page=1, size=20)
    return page.select("id", "first_detected_at", "last_updated_at", F.col("position").cast("bigint").alias("position"))


@query("p12_alert_filter", sql=ALERTS_SQL + """
SELECT org_id, status, count(*)::BIGINT AS n FROM alerts WHERE type IN ('unresolved_commitment') AND status IN ('open','acknowledged')
AND org_id IN (SELECT id FROM org) GROUP BY ALL""")
def alert_filter(g: Graph) -> DataFrame:
    kept = overdue_alerts(g).filter(alert_ops.alert_condition(types=["unresolved_commitment"],
                                                              statuses=["open", "acknowledged"]))
    return kept.groupBy("org_id", "status").agg(F.count("*").alias("n"))


@query("r13_stakeholder_views", sql=ALERTS_SQL + """
SELECT o.id AS start, (SELECT count(*) FROM person p WHERE p.org_id = o.id)::BIGINT AS n_persons, 0::BIGINT AS n_orgs,
  (SELECT count(*) FROM interaction i JOIN person p ON p.id = i.person_id WHERE p.org_id = o.id)::BIGINT AS n_interactions,
  (SELECT count(*) FROM interaction i JOIN person p ON p.id = i.person_id WHERE p.org_id = o.id)::BIGINT AS n_trend_points,
  (SELECT round(avg(i.sentiment_score), 6) FROM interaction i JOIN person p ON p.id = i.person_id WHERE p.org_id = o.id) AS mean_sentiment,
  (SELECT count(DISTINCT i.dst) FROM involved_in i JOIN person p ON p.id = i.src WHERE p.org_id = o.id)::BIGINT AS n_projects,
  (SELECT count(*) FROM contract k WHERE k.org_id = o.id)::BIGINT AS n_contracts, 0::BIGINT AS n_issues,
  (SELECT count(*) FROM commitment c JOIN person p ON p.id = c.owner_id WHERE p.org_id = o.id AND c.status <> 'done')::BIGINT AS n_open,
  (SELECT count(*) FROM commitment c JOIN person p ON p.id = c.owner_id WHERE p.org_id = o.id AND c.status = 'done')::BIGINT AS n_closed,
  (SELECT count(*) FROM alerts a WHERE a.org_id = o.id)::BIGINT AS n_alerts
FROM org o""")
def stakeholder_views(g: Graph) -> DataFrame:
    views = t.stakeholder_views(g.edges, g.orgs.select("id"), g.interactions, g.commitments, overdue_alerts(g),
                                start_labels=["Org"], edge_types=EDGE_TYPES)
    return views.withColumn("mean_sentiment", F.round("mean_sentiment", 6))


@query("r14_project_map_view", sql=""",
s AS (SELECT i.dst AS project_id, count(DISTINCT i.src) AS n_stakeholders, count(DISTINCT p.org_id) AS n_orgs
      FROM involved_in i JOIN person p ON p.id = i.src GROUP BY 1),
c AS (SELECT r.dst AS project_id, count(*) AS n_commitments, count(*) FILTER (k.status NOT IN ('done','closed','cancelled','resolved')) AS n_open
      FROM relates_to r JOIN commitment k ON k.id = r.src GROUP BY 1)
SELECT pr.id AS project_id, pr.name, coalesce(n_stakeholders,0)::BIGINT AS n_stakeholders, coalesce(n_orgs,0)::BIGINT AS n_orgs,
       coalesce(n_commitments,0)::BIGINT AS n_commitments, coalesce(n_open,0)::BIGINT AS n_open, 0::BIGINT AS n_issues, 0::BIGINT AS n_risks
FROM project pr LEFT JOIN s ON s.project_id = pr.id LEFT JOIN c ON c.project_id = pr.id""")
def project_map_view(g: Graph) -> DataFrame:
    groups = model.label_groups()
    people = t.project_stakeholders(g.edges, groups["person"] + groups["org"], groups["org"], ["INVOLVED_IN"],
                                    ["WORKS_FOR"])
    stakeholders = people.groupBy("project_id").agg(F.countDistinct("stakeholder_id").alias("n_stakeholders"),
                                                    F.countDistinct("org_id").alias("n_orgs"))
    near = t.project_nodes(g.edges, groups["commitment"] + groups["issue"] + groups["risk"])
    counts = (near.join(g.commitments.select("id", "status"), "id", "left").groupBy("project_id").agg(
        F.count_if(F.col("label").isin(*groups["commitment"])).alias("n_commitments"),
        F.count_if(F.col("label").isin(*groups["commitment"]) & ~is_closed(F.col("status"))).alias("n_open"),
        F.count_if(F.col("label").isin(*groups["issue"])).alias("n_issues"),
        F.count_if(F.col("label").isin(*groups["risk"])).alias("n_risks")))
    out = (g.projects.select(F.col("id").alias("project_id"), "name").join(stakeholders, "project_id", "left")
           .join(counts, "project_id", "left"))
    return out.na.fill({c: 0 for c in out.columns if c.startswith("n_")})


@query("p08_role_extraction", sql="""
SELECT CASE WHEN l_returnflag = 'A' THEN l_linestatus ELSE l_returnflag END AS role_type,
       CASE WHEN l_linestatus = 'F' THEN 'true' ELSE l_returnflag END AS is_primary, count(*)::BIGINT AS n
FROM lineitem GROUP BY ALL""", graph=False)
def role_extraction(g: Graph) -> DataFrame:
    flag, state = F.col("l_returnflag"), F.col("l_linestatus")
    props = F.when(state == "F", F.create_map(F.lit("role_type"), F.when(flag == "A", "").otherwise(flag), F.lit("role"),
                                              state, F.lit("is_primary"), F.lit("true"))) \
        .otherwise(F.create_map(F.lit("role_type"), F.when(flag == "A", "").otherwise(flag), F.lit("role"), state,
                                F.lit("primary"), flag))
    edges = g.table("lineitem").select(props.alias("props"))
    return edges.groupBy(role_type(F.col("props")).alias("role_type"), is_primary(F.col("props")).alias("is_primary")) \
        .agg(F.count("*").alias("n"))
