"""Search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph import model
from kithgraph.operators import search as ops
from kithgraph.operators.traversal import scope_members
from kithgraph.plans.registry import query
from kithgraph.sources.graph import Graph

# Named nodes, and one query per distinct project name and per organisation.
SEARCH_SQL = """,
named AS (SELECT label, id, name FROM nodes WHERE name IS NOT NULL AND label IN ('Agent','Commitment','Concept','Contract','Org','Person','Project','Topic')),
tok AS (SELECT id, name, unnest(list_filter(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS term FROM named),
tf AS (SELECT id, name, term, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT id, count(*) AS length FROM tok GROUP BY 1),
df AS (SELECT term, count(DISTINCT id) AS df FROM tok GROUP BY 1),
tot AS (SELECT (SELECT count(*) FROM named) AS n, (SELECT count(*) FROM tok) / (SELECT count(*) FROM named)::DOUBLE AS avg_length),
queries AS (SELECT DISTINCT name AS query FROM project UNION SELECT name||' '||id FROM org UNION SELECT split_part(name, '#', 1)||' '||segment FROM person
  UNION SELECT DISTINCT text||' '||status FROM commitment),
asked AS (SELECT DISTINCT query, unnest(list_filter(regexp_split_to_array(lower(query), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS term FROM queries),
scored AS (SELECT a.query, tf.id, tf.name, sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * length / avg_length))) AS score
  FROM asked a JOIN df USING (term) JOIN tf USING (term) JOIN len ON len.id = tf.id, tot GROUP BY ALL)
"""


def named(g: Graph) -> DataFrame:
    """Nodes of every label that has a name at all."""
    labels = [label for label, (_, properties) in model.NODE_TYPES.items() if "name" in properties]
    return g.nodes.filter(F.col("name").isNotNull() & F.col("label").isin(*labels)).select("label", "id", "name")


def asked(g: Graph) -> DataFrame:
    return g.projects.select(F.col("name").alias("query")).distinct() \
        .unionByName(g.orgs.select(F.concat_ws(" ", "name", "id").alias("query"))) \
        .unionByName(g.persons.select(F.concat_ws(" ", F.substring_index("name", "#", 1), "segment").alias("query")).distinct()) \
        .unionByName(g.commitments.select(F.concat(F.col("text"), F.lit(" "), F.col("status")).alias("query")).filter("query IS NOT NULL")).distinct()


@query("q01_ranked_search", sql=SEARCH_SQL + """
SELECT query, id, round(score, 5) AS score, position::BIGINT AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS position FROM scored) WHERE position <= 25""")
def ranked_search(g: Graph) -> DataFrame:
    return ops.search(named(g), asked(g)).select("query", "id", F.round("score", 5).alias("score"),
                                                 F.col("position").cast("bigint").alias("position"))


@query("l02_top_hits", sql=SEARCH_SQL + """
SELECT query, count(*)::BIGINT AS n, round(max(score), 5) AS best FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS position FROM scored) WHERE position <= 25 GROUP BY 1""")
def top_hits(g: Graph) -> DataFrame:
    return ops.search(named(g), asked(g)).groupBy("query").agg(F.count("*").alias("n"), F.round(F.max("score"), 5).alias("best"))


@query("q02_filtered_paged_search", sql=SEARCH_SQL + """,
scope AS (SELECT org_id AS scope_id, id FROM person UNION SELECT org_id, id FROM contract UNION SELECT concept_id, id FROM org UNION SELECT id, concept_id FROM org),
kept AS (SELECT s.* FROM scored s WHERE s.id IN (SELECT id FROM scope WHERE scope_id IN (SELECT id FROM org)) AND s.id IN (SELECT id FROM person UNION ALL SELECT id FROM contract)),
q2 AS (SELECT query, count(*) AS total FROM kept GROUP BY 1)
SELECT query, id, total::BIGINT AS total, ceil(total / 20.0)::BIGINT AS total_pages FROM (
  SELECT k.*, total, row_number() OVER (PARTITION BY k.query ORDER BY round(score, 9) DESC, id) AS position FROM kept k JOIN q2 ON q2.query = k.query) WHERE position > 20 AND position <= 40""")
def filtered_paged_search(g: Graph) -> DataFrame:
    """Second page of 20 of the people and contracts in any organisation's scope.

    Scores use the statistics of the whole index; filters only choose what is shown.
    """
    members = g.persons.select("id", "org_id", F.lit("Person").alias("label")) \
        .unionByName(g.contracts.select("id", "org_id", F.lit("Contract").alias("label")))
    scope = scope_members(members, g.edges, "Org", "org_id").select("id").distinct()
    shown = named(g).filter(F.col("label").isin("Person", "Contract")).join(scope, "id", "left_semi")
    return ops.filtered_page(named(g), shown, asked(g), page=2, size=20).select("query", "id", "total", "total_pages")


@query("q02_project_scoped_search", sql=SEARCH_SQL + """,
kept AS (SELECT s.* FROM scored s WHERE s.id IN (SELECT src FROM involved_in UNION SELECT src FROM relates_to)),
q2 AS (SELECT query, count(*) AS total FROM kept GROUP BY 1)
SELECT query, id, total::BIGINT AS total, ceil(total / 20.0)::BIGINT AS total_pages FROM (
  SELECT k.*, total, row_number() OVER (PARTITION BY k.query ORDER BY round(score, 9) DESC, id) AS position FROM kept k JOIN q2 ON q2.query = k.query) WHERE position <= 20""")
def project_scoped_search(g: Graph) -> DataFrame:
    """First page of the people and commitments in any project's scope."""
    members = g.persons.select("id", F.lit(None).cast("string").alias("project_id"), F.lit("Person").alias("label")) \
        .unionByName(g.commitments.select("id", F.lit(None).cast("string").alias("project_id"), F.lit("Commitment").alias("label")))
    scope = scope_members(members, g.edges, "Project", "project_id").select("id").distinct()
    shown = named(g).filter(F.col("label").isin("Person", "Commitment")).join(scope, "id", "left_semi")
    return ops.filtered_page(named(g), shown, asked(g), page=1, size=20).select("query", "id", "total", "total_pages")
