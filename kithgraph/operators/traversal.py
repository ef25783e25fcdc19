"""Graph patterns as joins over the edge frame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.values import is_closed


EdgeType = tuple[str, str, str]  # source label, relationship, target label


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge seen from both ends, a loop once; ``src``/``dst`` keep the stored direction."""
    out = edges.select(F.col("src_label").alias("from_label"), F.col("src").alias("from_id"), "rel",
                       F.col("dst_label").alias("to_label"), F.col("dst").alias("to_id"), "src", "dst", "seen_at")
    back = edges.filter(F.col("src") != F.col("dst")).select(
        F.col("dst_label").alias("from_label"), F.col("dst").alias("from_id"), "rel",
        F.col("src_label").alias("to_label"), F.col("src").alias("to_id"), "src", "dst", "seen_at")
    return out.unionByName(back)


def useful_steps(edge_types: Sequence[EdgeType], start_labels: Sequence[str], targets: Sequence[str], depth: int) -> list[list[EdgeType]]:
    """Per hop the (from, rel, to) steps that lie on some walk from a start label to a target label.

    Edge types are schema, a handful of triples.  Labels are literals in each branch of the edge union, so a
    filter on them removes whole branches from the plan.
    """
    both = sorted({*edge_types, *((t, r, s) for s, r, t in edge_types)})
    every = {label for s, _, t in both for label in (s, t)}
    reach = [set(targets) if targets else every]
    for _ in range(depth):
        reach.append(reach[-1] | {s for s, _, t in both if t in reach[-1]})
    now, hops = set(start_labels), []
    for hop in range(1, depth + 1):
        steps = [(s, r, t) for s, r, t in both if s in now and t in reach[depth - hop]]
        hops.append(steps)
        now = {t for _, _, t in steps}
    return hops


def step_filter(steps: Sequence[EdgeType]) -> Column:
    cond = F.lit(False)
    for s, r, t in steps:
        cond = cond | ((F.col("from_label") == s) & (F.col("rel") == r) & (F.col("to_label") == t))
    return cond


def label_filter(column: str, labels: Sequence[str]) -> Column:
    """Label-set test; no labels means no filter."""
    return F.col(column).isin(*labels) if labels else F.lit(True)


def ego_edges(edges: DataFrame, centers: DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    """Incident edges of each center (``id``), either direction, once each.  Centers and edges are unique by key.

    Where the labels of the centers are known, edges without an end of such a label are not read.
    """
    return (undirected(edges).filter(label_filter("from_label", labels)).join(centers.select(F.col("id").alias("from_id")), "from_id")
            .select(F.col("from_id").alias("center"), "src", "rel", "dst", F.col("to_id").alias("neighbour"),
                    F.col("to_label").alias("neighbour_label")))


def ego_summary(ego: DataFrame) -> DataFrame:
    """Edges, distinct neighbours and labels of each center, in two plain aggregates."""
    around = ego.groupBy("center", "neighbour", "neighbour_label").agg(F.count("*").alias("n"))
    return around.groupBy("center").agg(F.sum("n").alias("n_edges"), F.count("*").alias("n_neighbours"),
                                        F.size(F.collect_set("neighbour_label")).cast("bigint").alias("n_labels"))


def ego_nodes(edges: DataFrame, centers: DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    """Each center with itself and its direct neighbours."""
    around = ego_edges(edges, centers, labels).select("center", F.col("neighbour").alias("id"),
                                              F.col("neighbour_label").alias("label"))
    own = centers.select(F.col("id").alias("center"), "id", "label")
    return own.unionByName(around).dropDuplicates(["center", "id", "label"])


def related_nodes(edges: DataFrame, starts: DataFrame, labels: Sequence[str] = (), depth: int = 2,
                  start_labels: Sequence[str] = (), edge_types: Sequence[EdgeType] = ()) -> DataFrame:
    """Distinct nodes of the wanted labels within ``depth`` hops of each start, start excluded.

    A shortest path never repeats an edge, so the reachable set needs no edge bookkeeping: each hop keeps
    distinct (start, node) pairs.  Where the start labels and the edge types are known, a hop only reads edges that
    can still lead to a wanted label.
    """
    steps = undirected(edges)
    hops = useful_steps(edge_types, start_labels, labels, depth) if edge_types and start_labels else None
    frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("node"))
    found: list[DataFrame] = []
    for hop in range(1, depth + 1):
        usable = steps if hops is None else steps.filter(step_filter(hops[hop - 1]))
        if hop == depth:
            found.append(_expand(frontier, usable.filter(label_filter("to_label", labels))))
            break
        grown = _expand(frontier, usable).distinct()
        found.append(grown.filter(label_filter("label", labels)))
        onward = label_filter("label", sorted({s for s, _, _ in hops[hop]})) if hops is not None and hops[hop] else F.lit(True)
        frontier = grown.filter(onward).select("start", "node")
    out = reduce(DataFrame.unionByName, found)
    return (out.filter(F.col("node") != F.col("start"))
            .select("start", F.col("node").alias("id"), "label").distinct())


def _expand(frontier: DataFrame, steps: DataFrame) -> DataFrame:
    return (frontier.join(steps.select(F.col("from_id").alias("node"), "to_id", "to_label"), "node")
            .select("start", F.col("to_id").alias("node"), F.col("to_label").alias("label")))


def related_interactions(edges: DataFrame, starts: DataFrame, interactions: DataFrame, since: Column | None = None,
                         until: Column | None = None, **schema) -> DataFrame:
    """Interactions within two hops whose time lies in the closed range; a missing bound is open."""
    window = interactions
    if since is not None:
        window = window.filter(F.col("at") >= since)
    if until is not None:
        window = window.filter(F.col("at") <= until)
    hits = related_nodes(edges, starts, ["Interaction"], 2, **schema)
    return hits.join(window.select("id", "at", "sentiment_score"), "id").select("start", "id", "at", "sentiment_score")


def project_nodes(edges: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One-hop nodes of each project by label."""
    return (undirected(edges).filter((F.col("from_label") == "Project") & label_filter("to_label", labels))
            .select(F.col("from_id").alias("project_id"), F.col("to_label").alias("label"), F.col("to_id").alias("id"))
            .distinct())


def project_stakeholders(edges: DataFrame, stakeholder_labels: Sequence[str], org_labels: Sequence[str],
                         involved: Sequence[str], works_for: Sequence[str]) -> DataFrame:
    """Stakeholders of each project with their organisation, if any."""
    steps = undirected(edges)
    people = (steps.filter((F.col("to_label") == "Project") & label_filter("from_label", stakeholder_labels)
                           & label_filter("rel", involved))
              .select(F.col("to_id").alias("project_id"), F.col("from_id").alias("stakeholder_id"),
                      F.col("from_label").alias("stakeholder_label"), F.col("rel").alias("rel_type")).distinct())
    employers = (steps.filter(label_filter("to_label", org_labels) & label_filter("rel", works_for))
                 .select(F.col("from_id").alias("stakeholder_id"), F.col("to_id").alias("org_id")).distinct())
    return people.join(employers, "stakeholder_id", "left")


def project_chain(made: DataFrame, relates_to: DataFrame, works_for: DataFrame) -> DataFrame:
    """Project, commitment, maker and the maker's organisation.

    The maker-to-organisation segment is optional as a unit: a maker without an organisation
    leaves both empty, as one optional pattern does.
    """
    makers = (made.select(F.col("src").alias("person_id"), F.col("dst").alias("commitment_id"))
              .join(works_for.select(F.col("src").alias("person_id"), F.col("dst").alias("org_id")), "person_id"))
    return (relates_to.select(F.col("dst").alias("project_id"), F.col("src").alias("commitment_id"))
            .join(makers, "commitment_id", "left"))


def project_map(projects: DataFrame, made: DataFrame, relates_to: DataFrame, works_for: DataFrame,
                party_to: DataFrame) -> DataFrame:
    """Size of each project's map: distinct nodes by role and distinct edges.

    Contracts hang off the organisation, not the project, so they are counted once per
    organisation and added up; (project, contract) pairs are never formed.
    """
    chain = project_chain(made, relates_to, works_for)
    per_project = chain.groupBy("project_id").agg(
        F.countDistinct("commitment_id").alias("n_commitments"), F.countDistinct("person_id").alias("n_persons"))
    contracts = party_to.groupBy(F.col("src").alias("org_id")).agg(F.countDistinct("dst").alias("contracts"))
    orgs = (chain.filter(F.col("org_id").isNotNull()).select("project_id", "org_id").distinct()
            .join(contracts, "org_id", "left").groupBy("project_id")
            .agg(F.count("*").alias("n_orgs"), F.sum(F.coalesce("contracts", F.lit(0))).alias("n_contracts")))
    joined = projects.select(F.col("id").alias("project_id")).join(per_project, "project_id", "left") \
        .join(orgs, "project_id", "left")
    zero = {c: 0 for c in ("n_commitments", "n_persons", "n_orgs", "n_contracts")}
    return joined.na.fill(zero).withColumn("n_edges", F.col("n_persons") + F.col("n_contracts"))


def interaction_slice(interactions: DataFrame, mentions: DataFrame, works_for: DataFrame, text: str) -> tuple[
        DataFrame, DataFrame]:
    """Interactions whose summary or source holds the text, with mentioned people and their organisations."""
    needle = text.lower()
    hits = interactions.filter(F.lower(F.coalesce("summary", F.lit(""))).contains(needle)
                               | F.lower(F.coalesce("source_uri", F.lit(""))).contains(needle)).select("id")
    seen = mentions.join(hits, F.col("src") == F.col("id"), "left_semi").select("src", "rel", "dst")
    employers = (works_for.join(seen.select(F.col("dst").alias("p")).distinct(), F.col("src") == F.col("p"), "left_semi")
                 .select("src", "rel", "dst"))
    nodes = (hits.select(F.lit("Interaction").alias("label"), "id")
             .unionByName(seen.select(F.lit("Person").alias("label"), F.col("dst").alias("id")))
             .unionByName(employers.select(F.lit("Org").alias("label"), F.col("dst").alias("id"))).distinct())
    return nodes, seen.unionByName(employers).distinct()


def alerts_of(alerts: DataFrame) -> DataFrame:
    """(entity_id, alert id) for the three ways an alert names an entity.

    One union of projections in place of an OR join, so it hashes on one key.
    """
    parts = [alerts.select(F.col(c).alias("entity"), F.col("id").alias("alert_id"))
             for c in ("stakeholder_id", "org_id", "entity_id")]
    return reduce(DataFrame.unionByName, parts).filter(F.col("entity").isNotNull()).distinct()


def scope_members(nodes: DataFrame, edges: DataFrame, scope_label: str, prop: str) -> DataFrame:
    """Nodes in the scope of each anchor: they carry its id as a property or are adjacent to it."""
    by_prop = nodes.filter(F.col(prop).isNotNull()).select(F.col(prop).alias("scope_id"), "id", "label")
    adjacent = (undirected(edges).filter(F.col("from_label") == scope_label)
                .select(F.col("from_id").alias("scope_id"), F.col("to_id").alias("id"), F.col("to_label").alias("label")))
    return by_prop.unionByName(adjacent).distinct()


def stakeholder_views(edges: DataFrame, starts: DataFrame, interactions: DataFrame, commitments: DataFrame,
                      alerts: DataFrame, **schema) -> DataFrame:
    """One row per stakeholder: linked people and organisations, interactions, trend, commitments, projects, alerts."""
    one_hop = related_nodes(edges, starts, ["Person", "Org"], 1, **schema).groupBy("start").agg(
        F.count_if(F.col("label") == "Person").alias("n_persons"), F.count_if(F.col("label") == "Org").alias("n_orgs"))
    seen = related_interactions(edges, starts, interactions, **schema).groupBy("start").agg(
        F.count("*").alias("n_interactions"),
        F.count_if(F.col("at").isNotNull() & F.col("sentiment_score").isNotNull()).alias("n_trend_points"),
        F.avg("sentiment_score").alias("mean_sentiment"))
    near = related_nodes(edges, starts, ["Commitment", "Project", "Contract", "Issue"], 2, **schema)
    counts = near.groupBy("start").agg(
        *[F.count_if(F.col("label") == label).alias(name) for label, name in
          (("Project", "n_projects"), ("Contract", "n_contracts"), ("Issue", "n_issues"))])
    promised = near.filter(F.col("label") == "Commitment").join(commitments.select("id", "status"), "id") \
        .groupBy("start").agg(F.count_if(~is_closed(F.col("status"))).alias("n_open"),
                              F.count_if(is_closed(F.col("status"))).alias("n_closed"))
    raised = alerts_of(alerts).groupBy(F.col("entity").alias("start")).agg(F.count("*").alias("n_alerts"))
    out = starts.select(F.col("id").alias("start"))
    for part in (one_hop, seen, counts, promised, raised):
        out = out.join(part, "start", "left")
    return out.na.fill({c: 0 for c in out.columns if c.startswith("n_")})
