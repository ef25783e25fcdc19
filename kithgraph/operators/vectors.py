"""Embedding refresh, clusters, communities, drift and concept governance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithgraph import model
from kithgraph.functions import ids
from kithgraph.functions.text import non_empty
from kithgraph.functions.vectors import centroids, cosine, dot, signed_byte, text_embedding, unit
from kithgraph.operators.neighbours import nearest
from kithgraph.session import cut_lineage, stored


def valid_vectors(df: DataFrame) -> DataFrame:
    """Rows with a usable vector: not empty and without missing numbers."""
    ok = F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    return df.filter(F.col("id").isNotNull() & ok)


def refresh_text(nodes: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new vectors, full snapshot): a vector is recomputed only where its text changed or it is missing.

    Nodes: label, id, text; stored: label, id, vector, content_hash.
    """
    hashed = nodes.filter(non_empty("text").isNotNull()).withColumn("content_hash", ids.text_hash(F.col("text")))
    old = stored.select("label", "id", F.col("content_hash").alias("old_hash"), F.col("vector").alias("old_vector"))
    changed = hashed.join(old, ["label", "id"], "left").filter(
        ~F.col("content_hash").eqNullSafe(F.col("old_hash")) | F.col("old_vector").isNull())
    fresh = changed.select("label", "id", text_embedding(F.col("text")).alias("vector"), "content_hash")
    kept = stored.join(fresh.select("label", "id"), ["label", "id"], "left_anti").select("label", "id", "vector", "content_hash")
    return fresh, kept.unionByName(fresh)


def graph_embedding(node_ids: DataFrame, edges: DataFrame, dims: int = 8, seed: str = "7", rounds: int = 3) -> DataFrame:
    """Seeded vectors smoothed over neighbours: 0.6 of its own, 0.4 of the neighbours' mean, unit length, each round.

    Components are plain columns, so a round is one join and one codegen'd partial aggregate; a hub's
    neighbours are averaged on the map side.  Seeds are digest bytes of (seed, id).
    """
    names = [f"v{i}" for i in range(dims)]
    pairs = edges.select("src", "dst").filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    around = cut_lineage(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    every = node_ids.select("id").unionByName(around.select(F.col("src").alias("id"))).distinct()
    digest = F.sha2(F.concat_ws(":", F.lit(seed), "id"), 256)
    current = every.select("id", *[signed_byte(digest, F.lit(i % 32)).alias(n) for i, n in enumerate(names)])
    for _ in range(rounds):
        current = cut_lineage(current)
        means = (around.join(current.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"))
                 .agg(*[F.avg(n).alias(f"m_{n}") for n in names]))
        blend = [F.when(F.col(f"m_{n}").isNull(), F.col(n)).otherwise(0.6 * F.col(n) + 0.4 * F.col(f"m_{n}")).alias(n) for n in names]
        mixed = current.join(means, "id", "left").select("id", *blend)
        length = F.coalesce(F.nullif(F.sqrt(reduce(lambda a, b: a + b, [F.col(n) * F.col(n) for n in names])), F.lit(0.0)), F.lit(1.0))
        current = mixed.withColumn("__n", length).select("id", *[(F.col(n) / F.col("__n")).alias(n) for n in names])
    return current.select("id", F.array(*names).alias("vector"))


def knn_edges(vectors: DataFrame, k: int | None = None) -> DataFrame:
    """Undirected nearest-neighbour edges (a < b) with their similarity."""
    rows = valid_vectors(vectors).select("id", "vector")
    if k is None:
        k = min(5, max(2, rows.count() - 1))
    hits = nearest(rows, rows, k, not_self=True)
    return hits.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id of each connected component.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edge set stops changing,
    in a logarithmic number of rounds.  A step is a minimum per node, joined back; neighbour lists are
    never gathered, so hubs are only skewed join keys, which the adaptive join splits.
    """
    current = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")) \
            .select("e.u", "e.v").filter("u <> v").distinct()
        current = stored(small, "links")
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == mark:
            break
        before = mark
    found = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = found.select(F.col("component").alias("id"), "component").distinct()
    out = found.unionByName(roots).distinct()
    if nodes is not None:
        alone = nodes.select("id").distinct().join(out, "id", "left_anti").select("id", F.col("id").alias("component"))
        out = out.unionByName(alone)
    return out


def communities(vectors: DataFrame, k: int | None = None) -> DataFrame:
    """(id, component) of the nearest-neighbour graph; fewer than three vectors have none, singletons are dropped."""
    rows = valid_vectors(vectors)
    if rows.limit(3).count() < 3:
        return rows.sparkSession.createDataFrame([], "id string, component string")
    parts = connected_components(knn_edges(rows, k))
    return parts.join(parts.groupBy("component").agg(F.count("*").alias("n")).filter("n >= 2").select("component"), "component", "left_semi")


def density_clusters(vectors: DataFrame, k: int, least_sim: float) -> DataFrame:
    """Clusters of vectors joined by close nearest-neighbour edges; the rest is noise and left out."""
    return connected_components(knn_edges(vectors, k).filter(F.col("sim") >= least_sim))


def membership_scores(members: DataFrame) -> DataFrame:
    """Mean cosine of each member to its peers, moved to [0, 1]; a singleton scores 1.

    The mean is taken from the sum of the unit vectors of the community, so no pairs are formed.
    """
    units = members.select("component", "id", unit(F.col("vector")).alias("u"))
    sizes = units.groupBy("component").agg(F.count("*").alias("n"))
    means = centroids(units, ["component"], "u")
    rows = units.join(means, "component").join(sizes, "component")
    own = dot(F.col("u"), F.col("u"))
    peers = (dot(F.col("u"), F.col("centroid")) * F.col("n") - own) / (F.col("n") - 1)
    score = F.when(F.col("n") == 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (peers + 1.0) / 2.0)))
    return rows.select("component", "id", score.alias("score"))


def cohesion(members: DataFrame, key: str) -> DataFrame:
    """Mean cosine of the members to their centroid, with the centroid."""
    centers = centroids(members, [key], "vector")
    return members.join(centers, key).groupBy(key).agg(F.count("*").alias("n"), F.avg(cosine(F.col("vector"), F.col("centroid"))).alias("cohesion")) \
        .join(centers, key)


def member_digest(label: Column, ident: Column) -> Column:
    return ids.set_digest(F.concat_ws(":", label, ident))


def text_hypotheses(vectors: DataFrame, concepts: DataFrame, created_at: str, particular: str = "Particular", cluster: str | None = None) -> DataFrame:
    """Cluster hypotheses over text vectors (label, id, vector).

    Without a cluster column all vectors form one cluster, each scored by its cosine to the centroid.
    Clusters under two members are dropped.  Gives centroid, cohesion, five exemplars among the particulars
    and the three nearest concepts.
    """
    rows = valid_vectors(vectors).withColumn("grp", F.col(cluster).cast("string") if cluster else F.lit("0"))
    base = cohesion(rows, "grp").filter("n >= 2")
    digest = rows.groupBy("grp").agg(member_digest(F.col("label"), F.col("id")).alias("digest"))
    scored = rows.filter(F.col("label") == particular).join(base.select("grp", "centroid"), "grp").withColumn("score", cosine(F.col("vector"), F.col("centroid")))
    order = Window.partitionBy("grp").orderBy(F.desc(F.round("score", 12)), F.desc("id"))
    exemplars = scored.withColumn("position", F.row_number().over(order)).filter("position <= 5").groupBy("grp").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda e: e["id"]).alias("exemplars"))
    near = nearest_concepts(base.select(F.col("grp").alias("id"), F.col("centroid").alias("vector")), concepts)
    named = near.groupBy(F.col("query").alias("grp")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda e: e["id"]).alias("nearest_concepts"))
    out = base.join(digest, "grp").join(exemplars, "grp", "left").join(named, "grp", "left")
    return out.withColumn("cluster_id", ids.cluster_id(F.lit("embedding_hypothesis_text"), F.lit("hdbscan"), F.concat_ws(":", "grp", F.lit(created_at)), F.col("digest")))


def nearest_concepts(centers: DataFrame, concepts: DataFrame, k: int = 3) -> DataFrame:
    return nearest(centers, valid_vectors(concepts).select("id", "vector"), k)


def hypothesis_graph(clusters: DataFrame, members: DataFrame, exemplars: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Proposed concept nodes, and IN_CLUSTER and CANDIDATE_INSTANCE_OF edges."""
    nodes = clusters.select(F.lit("Concept").alias("label"), F.col("cluster_id").alias("id"), F.lit("proposed").alias("status"), "cohesion", as_of.alias("created_at"))
    inside = members.select(F.col("label").alias("src_label"), F.col("id").alias("src"), F.lit("IN_CLUSTER").alias("rel"), F.col("cluster_id").alias("dst"), "score")
    shown = exemplars.select(F.lit("Particular").alias("src_label"), F.col("id").alias("src"), F.lit("CANDIDATE_INSTANCE_OF").alias("rel"),
                             F.col("cluster_id").alias("dst"), F.lit(None).cast("double").alias("score"))
    return nodes, inside.unionByName(shown)


def drift(prior: DataFrame, current: DataFrame, threshold: float = model.DRIFT_THRESHOLD) -> DataFrame:
    """Review items for clusters whose centroid moved: both frames hold key and centroid."""
    both = prior.select("key", F.col("centroid").alias("was")).join(current.select("key", "centroid"), "key")
    return both.select("key", (1.0 - cosine(F.col("was"), F.col("centroid"))).alias("drift_score")).filter(F.col("drift_score") > threshold) \
        .withColumns({"kind": F.lit("concept_drift"), "status": F.lit("open"), "threshold": F.lit(threshold)})


def propose_concepts(clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A proposed concept per cluster and candidate edges from its distinct particulars.

    Rows: cluster_id, particular_id.
    """
    distinct = clusters.filter(non_empty("particular_id").isNotNull()).select("cluster_id", "particular_id").distinct()
    concepts = distinct.groupBy("cluster_id").agg(F.count("*").alias("n_particulars"), member_digest(F.lit("Particular"), F.col("particular_id")).alias("digest"))
    concept_id = F.concat(F.lit("concept_"), F.substring(F.sha1(F.concat_ws(":", "cluster_id", "digest")), 1, 16))
    nodes = concepts.select("cluster_id", concept_id.alias("id"), F.lit("proposed").alias("status"), "n_particulars")
    edges = distinct.join(nodes.select("cluster_id", "id"), "cluster_id").select(
        F.col("particular_id").alias("src"), F.lit("CANDIDATE_INSTANCE_OF").alias("rel"), F.col("id").alias("dst"))
    return nodes, edges


def check_decisions(decisions: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): a decision needs an existing proposed concept; a merge also an existing target."""
    known = concepts.select(F.col("id").alias("concept_id"), "status")
    targets = concepts.select(F.col("id").alias("target_id"), F.lit(True).alias("target_known"))
    rows = decisions.join(known, "concept_id", "left").join(targets, "target_id", "left")
    code = (F.when(F.col("status").isNull(), "CONCEPT_NOT_FOUND").when(F.col("status") != "proposed", "CONCEPT_NOT_PROPOSED")
            .when((F.col("decision") == "merge") & F.col("target_known").isNull(), "TARGET_CONCEPT_NOT_FOUND"))
    rows = rows.withColumn("code", code).select("concept_id", "decision", "target_id", "reason", "code")
    return rows.filter(F.col("code").isNull()).drop("code"), rows.filter(F.col("code").isNotNull())


def govern(concepts: DataFrame, edges: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply promote, merge and reject decisions; returns concepts, edges and the counts per decision.

    Edges: src, rel, dst, algorithm, created_at.  A promotion turns candidate edges into INSTANCE_OF, a merge
    points them at the target; an edge that was there keeps its first algorithm and time.
    """
    d = decisions.select(F.col("concept_id").alias("id"), "decision", "target_id", "reason")
    state = F.when(F.col("decision") == "promote", "canonical").when(F.col("decision") == "merge", "merged").when(F.col("decision") == "reject", "rejected")
    new_concepts = concepts.join(d, "id", "left").select(
        "id", F.coalesce(state, "status").alias("status"), F.when(F.col("decision") == "merge", F.col("target_id")).alias("merged_into"),
        F.when(F.col("decision") == "reject", F.coalesce(non_empty("reason"), F.lit("manual_rejection"))).alias("rejection_reason"))
    touched = edges.join(d.select(F.col("id").alias("dst"), "decision", "target_id"), "dst", "left")
    candidate = F.col("rel") == "CANDIDATE_INSTANCE_OF"
    promote, merge = candidate & F.coalesce(F.col("decision") == "promote", F.lit(False)), candidate & F.coalesce(F.col("decision") == "merge", F.lit(False))
    moved = touched.select(
        "src", F.when(promote, "INSTANCE_OF").otherwise(F.col("rel")).alias("rel"), F.when(merge, F.col("target_id")).otherwise(F.col("dst")).alias("dst"),
        "algorithm", "created_at", F.when(promote | merge, 1).otherwise(0).alias("arrived"))
    first = F.struct("arrived", "created_at", "algorithm")
    merged = moved.groupBy("src", "rel", "dst").agg(
        F.min_by("algorithm", F.when(F.col("algorithm").isNotNull(), first)).alias("algorithm"),
        F.min_by("created_at", F.when(F.col("created_at").isNotNull(), first)).alias("created_at"))
    counts = touched.filter(promote | merge).groupBy("decision").agg(F.count("*").alias("n"))
    return new_concepts, merged, counts
