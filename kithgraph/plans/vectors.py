"""Embedding, cluster and governance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.vectors import centroids, text_embedding
from kithgraph.operators import vectors as ops
from kithgraph.operators.neighbours import nearest
from kithgraph.plans.registry import query
from kithgraph.sources.graph import Graph

KNN_SQL = """,
sims AS (SELECT a.id AS query, b.id AS id, round(list_cosine_similarity(a.vector, b.vector), 12) AS sim FROM vec a JOIN vec b ON a.id <> b.id),
knn AS (SELECT query, id, sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id DESC) AS position FROM sims QUALIFY position <= 5),
knn_edges AS (SELECT least(query, id) AS a, greatest(query, id) AS b, max(sim) AS sim FROM knn GROUP BY ALL)
"""
CENTER_SQL = """,
cells AS (SELECT id, cluster, unnest(vector) AS x, unnest(range(64)) AS pos FROM vec),
means AS (SELECT cluster, pos, avg(x) AS m FROM cells GROUP BY ALL),
centers AS (SELECT cluster, list(m ORDER BY pos) AS centroid FROM means GROUP BY 1)
"""


def labelled(g: Graph) -> DataFrame:
    """Vectors as the text vectors of particulars and interactions: two frames, one union (U01)."""
    particulars = g.vectors.filter(F.col("cluster") < "5").select(F.lit("Particular").alias("label"), "id", "vector", "cluster")
    interactions = g.vectors.filter(F.col("cluster") >= "5").select(F.lit("Interaction").alias("label"), "id", "vector", "cluster")
    return particulars.unionByName(interactions)


def concept_vectors(g: Graph) -> DataFrame:
    return centroids(g.vectors, ["cluster"], "vector").select(F.concat(F.lit("concept:"), "cluster").alias("id"), F.col("centroid").alias("vector"))


@query("u01_vector_union", sql="SELECT CASE WHEN cluster < '5' THEN 'Particular' ELSE 'Interaction' END AS label, count(*)::BIGINT AS n FROM vec GROUP BY 1")
def vector_union(g: Graph) -> DataFrame:
    return labelled(g).groupBy("label").agg(F.count("*").alias("n"))


@query("j20_cosine_knn", sql=KNN_SQL + "SELECT a, b, round(sim, 6) AS sim FROM knn_edges")
def cosine_knn(g: Graph) -> DataFrame:
    return ops.knn_edges(g.vectors).select("a", "b", F.round("sim", 6).alias("sim"))


@query("j21_nearest_concepts", sql=CENTER_SQL + """
SELECT v.id AS query, 'concept:'||c.cluster AS id, round(list_cosine_similarity(v.vector, c.centroid), 6) AS sim FROM vec v, centers c
QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY round(list_cosine_similarity(v.vector, c.centroid), 12) DESC, 'concept:'||c.cluster DESC) <= 3""")
def nearest_concepts(g: Graph) -> DataFrame:
    return nearest(g.vectors.select("id", "vector"), concept_vectors(g), 3).select("query", "id", F.round("sim", 6).alias("sim"))


@query("a13_centroid", sql=CENTER_SQL + "SELECT cluster, pos::BIGINT AS pos, round(m, 6) AS m FROM means")
def centroid(g: Graph) -> DataFrame:
    rows = centroids(g.vectors, ["cluster"], "vector").select("cluster", F.posexplode("centroid").alias("pos", "m"))
    return rows.select("cluster", F.col("pos").cast("bigint").alias("pos"), F.round("m", 6).alias("m"))


@query("a14_cohesion", sql=CENTER_SQL + "SELECT v.cluster, count(*)::BIGINT AS n, round(avg(list_cosine_similarity(v.vector, c.centroid)), 6) AS cohesion FROM vec v JOIN centers c USING (cluster) GROUP BY 1")
def cohesion(g: Graph) -> DataFrame:
    return ops.cohesion(g.vectors, "cluster").select("cluster", "n", F.round("cohesion", 6).alias("cohesion"))


@query("a15_membership", sql="""
SELECT a.cluster AS component, a.id, round(greatest(0.0, least(1.0, (avg(list_cosine_similarity(a.vector, b.vector)) + 1.0) / 2.0)), 6) AS score FROM vec a JOIN vec b ON a.cluster = b.cluster AND a.id <> b.id GROUP BY ALL""".replace("SELECT a.", ", one AS (SELECT 1) SELECT a.", 1))
def membership(g: Graph) -> DataFrame:
    rows = g.vectors.select(F.col("cluster").alias("component"), "id", "vector")
    return ops.membership_scores(rows).select("component", "id", F.round("score", 6).alias("score"))


@query("m01_text_embedding", sql="""
WITH n AS (SELECT DISTINCT p_name||' '||p_brand AS t FROM part),
raw AS (SELECT t, list_transform(range(0, 32), lambda i: ('0x'||substr(sha256(lower(t)), i * 2 + 1, 2))::INT / 127.5 - 1.0) AS v FROM n)
SELECT t AS name, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(v[32] / sqrt(list_inner_product(v, v)), 6) AS last FROM raw""", graph=False)
def text_embeddings(g: Graph) -> DataFrame:
    rows = g.projects.select(F.concat_ws(" ", "name", "brand").alias("name")).distinct().withColumn("v", text_embedding(F.col("name")))
    return rows.select("name", F.round(F.get("v", 0), 6).alias("first"), F.round(F.get("v", 31), 6).alias("last"))


@query("m02_incremental_refresh", sql="""
SELECT (SELECT count(*) FROM part WHERE p_size > 40 OR p_type = 'ECONOMY')::BIGINT AS updated, (SELECT count(*) FROM part)::BIGINT AS total, 0::BIGINT AS again""", graph=False)
def incremental_refresh(g: Graph) -> DataFrame:
    """Stored vectors miss one part type and are out of date for large parts; a second refresh has nothing to do."""
    text = F.concat_ws("\n", "p_name", "p_type")
    nodes = g.table("part").select(F.lit("Project").alias("label"), F.col("p_partkey").cast("string").alias("id"), text.alias("text"), "p_size", "p_type")
    old = nodes.filter("p_type <> 'ECONOMY'").withColumn("text", F.when(F.col("p_size") > 40, F.lit("old text")).otherwise(F.col("text")))
    empty = g.spark.createDataFrame([], "label string, id string, vector array<double>, content_hash string")
    stored, _ = ops.refresh_text(old, empty)
    fresh, snapshot = ops.refresh_text(nodes, stored)
    again, _ = ops.refresh_text(nodes, snapshot)
    return fresh.agg(F.count("*").alias("updated")).join(snapshot.agg(F.count("*").alias("total"))).join(again.agg(F.count("*").alias("again")))


@query("m03_graph_embedding", sql=""",
adj AS (SELECT src, dst FROM edges WHERE rel IN ('WORKS_FOR','INSTANCE_OF','PARTY_TO') UNION SELECT dst, src FROM edges WHERE rel IN ('WORKS_FOR','INSTANCE_OF','PARTY_TO')),
ids AS (SELECT DISTINCT src AS id FROM adj),
v0 AS (SELECT id, i, ('0x'||substr(sha256('7:'||id), i * 2 + 1, 2))::INT / 127.5 - 1.0 AS x FROM ids, range(0, 8) r(i)),
b1 AS (SELECT v.id, v.i, 0.6 * v.x + 0.4 * m.x AS x FROM v0 v JOIN (SELECT a.src AS id, n.i, avg(n.x) AS x FROM adj a JOIN v0 n ON n.id = a.dst GROUP BY ALL) m USING (id, i)),
v1 AS (SELECT id, i, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM b1),
b2 AS (SELECT v.id, v.i, 0.6 * v.x + 0.4 * m.x AS x FROM v1 v JOIN (SELECT a.src AS id, n.i, avg(n.x) AS x FROM adj a JOIN v1 n ON n.id = a.dst GROUP BY ALL) m USING (id, i)),
v2 AS (SELECT id, i, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM b2),
b3 AS (SELECT v.id, v.i, 0.6 * v.x + 0.4 * m.x AS x FROM v2 v JOIN (SELECT a.src AS id, n.i, avg(n.x) AS x FROM adj a JOIN v2 n ON n.id = a.dst GROUP BY ALL) m USING (id, i)),
v3 AS (SELECT id, i, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM b3)
SELECT id, i::BIGINT AS i, round(x, 5) AS x FROM v3""")
def graph_embedding(g: Graph) -> DataFrame:
    """Three smoothing rounds over the organisation backbone: people, organisations, contracts and concepts."""
    edges = g.works_for.unionByName(g.instance_of).unionByName(g.party_to)
    rows = ops.graph_embedding(g.orgs.select("id"), edges).select("id", F.posexplode("vector").alias("i", "x"))
    return rows.select("id", F.col("i").cast("bigint").alias("i"), F.round("x", 5).alias("x"))


@query("m04_valid_vectors", sql="SELECT cluster, count(*) FILTER (vector[1] > 0)::BIGINT AS n FROM vec GROUP BY 1")
def valid_vectors(g: Graph) -> DataFrame:
    """Vectors whose first number is not positive arrive broken in one of three ways and are dropped."""
    v = F.col("vector")
    broken = g.vectors.withColumn("vector", F.when(F.get(v, 0) > 0, v).when(F.col("cluster") < "3", F.array().cast("array<double>"))
                                  .when(F.col("cluster") < "6", F.array_append(v, F.lit(None).cast("double"))))
    return ops.valid_vectors(broken).groupBy("cluster").agg(F.count("*").alias("n"))


HYPOTHESIS_SQL = CENTER_SQL + """,
scored AS (SELECT v.id, v.cluster, list_cosine_similarity(v.vector, c.centroid) AS sim FROM vec v JOIN centers c USING (cluster)),
digest AS (SELECT cluster, sum(('0x'||substr(sha1(CASE WHEN cluster < '5' THEN 'Particular' ELSE 'Interaction' END||':'||id), 1, 15))::BIGINT)::VARCHAR AS d, count(*) AS n FROM vec GROUP BY 1),
ex AS (SELECT cluster, string_agg(id, ',' ORDER BY position) AS exemplars FROM (SELECT id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY round(sim, 12) DESC, id DESC) AS position FROM scored WHERE cluster < '5') WHERE position <= 5 GROUP BY 1),
near AS (SELECT cluster, string_agg(id, ',' ORDER BY position) AS nearest FROM (SELECT a.cluster, 'concept:'||b.cluster AS id, row_number() OVER (PARTITION BY a.cluster ORDER BY round(list_cosine_similarity(a.centroid, b.centroid), 12) DESC, 'concept:'||b.cluster DESC) AS position FROM centers a, centers b) WHERE position <= 3 GROUP BY 1)
"""


@query("m05_text_hypotheses", sql=HYPOTHESIS_SQL + """
SELECT d.cluster AS grp, 'cluster_'||substr(sha1('embedding_hypothesis_text:hdbscan:'||d.cluster||':2024-01-31:'||d.d), 1, 16) AS cluster_id, d.n::BIGINT AS n,
  (SELECT round(avg(sim), 6) FROM scored s WHERE s.cluster = d.cluster) AS cohesion, coalesce(exemplars, '') AS exemplars, nearest FROM digest d LEFT JOIN ex USING (cluster) JOIN near USING (cluster)""")
def text_hypotheses(g: Graph) -> DataFrame:
    rows = ops.text_hypotheses(labelled(g), concept_vectors(g), "2024-01-31", cluster="cluster")
    return rows.select("grp", "cluster_id", "n", F.round("cohesion", 6).alias("cohesion"), F.coalesce(F.array_join("exemplars", ","), F.lit("")).alias("exemplars"),
                       F.array_join("nearest_concepts", ",").alias("nearest"))


@query("m05_single_cluster", sql=CENTER_SQL + """,
c AS (SELECT list(m ORDER BY pos) AS centroid FROM (SELECT pos, avg(x) AS m FROM cells GROUP BY 1))
SELECT count(*)::BIGINT AS n, round(avg(list_cosine_similarity(vector, centroid)), 6) AS cohesion FROM vec, c""")
def single_cluster(g: Graph) -> DataFrame:
    return ops.text_hypotheses(labelled(g), concept_vectors(g), "2024-01-31").select("n", F.round("cohesion", 6).alias("cohesion"))


@query("f13_cluster_id", sql=HYPOTHESIS_SQL + "SELECT cluster, 'cluster_'||substr(sha1('k:a:s:'||d), 1, 16) AS cluster_id FROM digest")
def cluster_ids(g: Graph) -> DataFrame:
    from kithgraph.functions import ids

    rows = labelled(g).groupBy("cluster").agg(ops.member_digest(F.col("label"), F.col("id")).alias("d"))
    return rows.select("cluster", ids.cluster_id(F.lit("k"), F.lit("a"), F.lit("s"), F.col("d")).alias("cluster_id"))


@query("m06_connected_components", sql=KNN_SQL.replace(", \nsims", ",\nsims") + """,
both_ways AS (SELECT a, b FROM knn_edges UNION SELECT b, a FROM knn_edges),
reach AS (WITH RECURSIVE r(id, root) AS (SELECT id, id FROM vec UNION SELECT e.b, r.root FROM r JOIN both_ways e ON e.a = r.id) SELECT * FROM r)
SELECT id, min(root) AS component FROM reach GROUP BY 1""")
def components(g: Graph) -> DataFrame:
    return ops.communities(g.vectors).select("id", "component")


@query("m06_business_components", sql="""
SELECT o.concept_id AS component, count(*)::BIGINT AS n FROM (
  SELECT p.id, org_id FROM person p UNION ALL SELECT id, org_id FROM contract UNION ALL SELECT c.id, p.org_id FROM commitment c JOIN person p ON p.id = c.owner_id UNION ALL SELECT i.id, p.org_id FROM interaction i JOIN person p ON p.id = i.person_id
  UNION ALL SELECT id, id FROM org UNION ALL SELECT concept_id, min(id) FROM org GROUP BY 1) m JOIN org o ON o.id = m.org_id GROUP BY 1""")
def business_components(g: Graph) -> DataFrame:
    """Components of the graph without projects: one per region.  Named by the region they hold."""
    edges = g.edges.filter(F.col("dst_label") != "Project").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    parts = ops.connected_components(edges)
    named = parts.join(g.concepts.select("id"), "id", "left_semi").select(F.col("id").alias("concept"), "component")
    return parts.groupBy("component").agg(F.count("*").alias("n")).join(named, "component").select(F.col("concept").alias("component"), "n")


@query("m05_density_clusters")
def density_clusters(g: Graph) -> DataFrame:
    """Clusters joined by close neighbours; tests check it by brute force."""
    return ops.density_clusters(g.vectors, 5, 0.5)


@query("m07_hypothesis_sink", sql="""
SELECT 'IN_CLUSTER' AS rel, count(*)::BIGINT AS n, count(DISTINCT cluster)::BIGINT AS n_clusters FROM vec UNION ALL SELECT 'CANDIDATE_INSTANCE_OF', sum(least(n, 5))::BIGINT, count(*) FROM (SELECT cluster, count(*) AS n FROM vec WHERE cluster < '5' GROUP BY 1)""")
def hypothesis_sink(g: Graph) -> DataFrame:
    rows = labelled(g)
    clusters = ops.text_hypotheses(rows, concept_vectors(g), "2024-01-31", cluster="cluster")
    members = rows.join(clusters.select(F.col("grp").alias("cluster"), "cluster_id"), "cluster").withColumn("score", F.lit(1.0))
    exemplars = clusters.select("cluster_id", F.explode("exemplars").alias("id"))
    _, edges = ops.hypothesis_graph(clusters, members, exemplars, F.lit("2024-01-31").cast("timestamp"))
    return edges.groupBy("rel").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("n_clusters"))


@query("m08_concept_drift", sql=CENTER_SQL + """,
now AS (SELECT cluster, list(m ORDER BY pos) AS centroid FROM (SELECT cluster, pos, avg(x) AS m FROM cells WHERE id IN (SELECT id FROM vec WHERE vector[1] > 0.05) GROUP BY ALL) GROUP BY 1)
SELECT a.cluster AS key, round(1.0 - list_cosine_similarity(a.centroid, b.centroid), 6) AS drift_score, 'open' AS status FROM centers a JOIN now b USING (cluster) WHERE 1.0 - list_cosine_similarity(a.centroid, b.centroid) > 0.15""")
def concept_drift(g: Graph) -> DataFrame:
    """Drift between the centroids of all vectors and of those left after a change of the data."""
    prior = centroids(g.vectors, ["cluster"], "vector").withColumnRenamed("cluster", "key")
    current = centroids(g.vectors.filter(F.get("vector", 0) > 0.05), ["cluster"], "vector").withColumnRenamed("cluster", "key")
    return ops.drift(prior, current).select("key", F.round("drift_score", 6).alias("drift_score"), "status")


@query("m09_propose_concepts", sql="SELECT 'brand:'||p_brand AS cluster_id, count(DISTINCT p_name)::BIGINT AS n_particulars, 'proposed' AS status FROM part GROUP BY 1", graph=False)
def propose_concepts(g: Graph) -> DataFrame:
    nodes, edges = ops.propose_concepts(g.projects.select(F.concat(F.lit("brand:"), "brand").alias("cluster_id"), F.col("name").alias("particular_id")))
    linked = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("linked"))
    return nodes.join(linked, "id").filter("linked = n_particulars").select("cluster_id", "n_particulars", "status")


# Governance: brands are concepts (high numbers are canonical already), part names are particulars.
GOVERN_SQL = """
WITH concepts AS (SELECT DISTINCT p_brand AS id, CASE WHEN p_brand < 'Brand#2' THEN 'canonical' ELSE 'proposed' END AS status FROM part),
cand AS (SELECT p_name AS src, p_brand AS dst, min(p_type) AS algorithm FROM part GROUP BY ALL),
inst AS (SELECT p_name AS src, p_brand AS dst FROM part WHERE p_size > 45 GROUP BY ALL),
decisions AS (SELECT id, status, CASE WHEN id < 'Brand#22' THEN 'promote' WHEN id < 'Brand#24' THEN 'merge' ELSE 'reject' END AS decision FROM concepts UNION ALL SELECT 'Brand#none', NULL, 'promote'),
valid AS (SELECT * FROM decisions WHERE status = 'proposed' AND (decision <> 'merge' OR 'Brand#25' IN (SELECT id FROM concepts)))
"""


def governance(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    part, none = g.table("part"), F.lit(None).cast("string")
    brand = F.col("p_brand")
    concepts = part.select(brand.alias("id"), F.when(brand < "Brand#2", "canonical").otherwise("proposed").alias("status")).distinct()
    day = F.lit("2024-01-01").cast("timestamp")
    candidates = part.groupBy(F.col("p_name").alias("src"), brand.alias("dst")).agg(F.min("p_type").alias("algorithm")).select(
        "src", F.lit("CANDIDATE_INSTANCE_OF").alias("rel"), "dst", "algorithm", day.alias("created_at"))
    instances = part.filter("p_size > 45").select(F.col("p_name").alias("src"), F.lit("INSTANCE_OF").alias("rel"), brand.alias("dst"), F.lit("manual").alias("algorithm"),
                                                  F.lit("2023-01-01").cast("timestamp").alias("created_at")).distinct()
    decision = F.when(F.col("id") < "Brand#22", "promote").when(F.col("id") < "Brand#24", "merge").otherwise("reject")
    decisions = concepts.select(F.col("id").alias("concept_id"), decision.alias("decision"), F.when(decision == "merge", "Brand#25").alias("target_id"), none.alias("reason")) \
        .unionByName(part.agg(F.lit("Brand#none").alias("concept_id"), F.lit("promote").alias("decision"), none.alias("target_id"), none.alias("reason")))
    return concepts, candidates.unionByName(instances), decisions


@query("m10_promote_concepts", sql=GOVERN_SQL + """
SELECT c.src, c.dst, CASE WHEN i.src IS NULL THEN c.algorithm ELSE 'manual' END AS algorithm FROM cand c JOIN valid v ON v.id = c.dst AND v.decision = 'promote' LEFT JOIN inst i ON i.src = c.src AND i.dst = c.dst""", graph=False)
def promote_concepts(g: Graph) -> DataFrame:
    concepts, edges, decisions = governance(g)
    valid, _ = ops.check_decisions(decisions, concepts)
    _, merged, _ = ops.govern(concepts, edges, valid)
    promoted = valid.filter("decision = 'promote'").select(F.col("concept_id").alias("dst"))
    return merged.filter("rel = 'INSTANCE_OF'").join(promoted, "dst", "left_semi").select("src", "dst", "algorithm")


@query("m10_decision_rejects", sql=GOVERN_SQL + """
SELECT id AS concept_id, CASE WHEN status IS NULL THEN 'CONCEPT_NOT_FOUND' WHEN status <> 'proposed' THEN 'CONCEPT_NOT_PROPOSED' ELSE 'TARGET_CONCEPT_NOT_FOUND' END AS code FROM decisions WHERE id NOT IN (SELECT id FROM valid)""", graph=False)
def decision_rejects(g: Graph) -> DataFrame:
    concepts, _, decisions = governance(g)
    return ops.check_decisions(decisions, concepts)[1].select("concept_id", "code")


@query("m11_merge_concepts", sql=GOVERN_SQL + """
SELECT src, dst FROM cand WHERE dst NOT IN (SELECT id FROM valid WHERE decision IN ('promote','merge')) UNION SELECT src, 'Brand#25' FROM cand WHERE dst IN (SELECT id FROM valid WHERE decision = 'merge')""", graph=False)
def merge_concepts(g: Graph) -> DataFrame:
    concepts, edges, decisions = governance(g)
    valid, _ = ops.check_decisions(decisions, concepts)
    return ops.govern(concepts, edges, valid)[1].filter("rel = 'CANDIDATE_INSTANCE_OF'").select("src", "dst")


@query("m12_concept_states", sql=GOVERN_SQL + """
SELECT c.id, CASE v.decision WHEN 'promote' THEN 'canonical' WHEN 'merge' THEN 'merged' WHEN 'reject' THEN 'rejected' ELSE c.status END AS status, CASE WHEN v.decision = 'merge' THEN 'Brand#25' END AS merged_into,
  CASE WHEN v.decision = 'reject' THEN 'manual_rejection' END AS rejection_reason FROM concepts c LEFT JOIN valid v ON v.id = c.id""", graph=False)
def concept_states(g: Graph) -> DataFrame:
    concepts, edges, decisions = governance(g)
    valid, _ = ops.check_decisions(decisions, concepts)
    return ops.govern(concepts, edges, valid)[0]
