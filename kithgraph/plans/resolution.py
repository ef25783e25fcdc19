"""Entity resolution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.similarity import similarity
from kithgraph.operators import resolve as ops
from kithgraph.plans.registry import query
from kithgraph.sources.graph import Graph

# Mentions: every organisation in lower case, half of them with a domain; the user of every event,
# purchases naming the organisation mention; every project name in upper case.
# Names here are NATION_<digits>, so the similarity of two of them follows from the digits.  An equal domain also counts as
# the mention's own context (0.15), and so does the organisation of a person (0.25).
RESOLVE_SQL = """,
om AS (SELECT 'tmp:'||o.id AS temp_id, lower(o.name) AS name, CASE WHEN o.concept_id < 'concept:3' THEN md5(o.name)||'.com' END AS domain, split_part(o.name, '_', 2) AS d FROM org o),
oc AS (SELECT id, lower(name) AS name, md5(name)||'.com' AS domain, split_part(name, '_', 2) AS d FROM org),
op AS (SELECT temp_id, oc.id, 2.0 * (7 + CASE WHEN om.d = oc.d THEN length(om.d) WHEN contains(oc.d, om.d[1]) OR contains(oc.d, om.d[-1]) THEN 1 ELSE 0 END) / (length(om.name) + length(oc.name)) AS raw_sim,
  CASE WHEN om.domain = oc.domain THEN 1.0 ELSE 0.0 END AS domain_sim FROM om, oc),
os AS (SELECT *, CASE WHEN raw_sim >= 0.85 THEN raw_sim ELSE 0.0 END AS name_sim FROM op),
oscore AS (SELECT temp_id, id, name_sim, domain_sim, 0.9 * name_sim + 1.15 * domain_sim AS score FROM os WHERE name_sim > 0 OR domain_sim > 0),
orank AS (SELECT *, row_number() OVER (PARTITION BY temp_id ORDER BY round(score, 9) DESC, id) AS position FROM oscore WHERE score >= 0.5 QUALIFY position <= 4),
odec AS (SELECT 'org' AS category, temp_id, max(score) AS confidence, arg_min(id, position) AS best, max(score) FILTER (position = 2) AS second FROM orank GROUP BY temp_id),
pm AS (SELECT 'tmp:'||i.id AS temp_id, p.id AS person_id, CASE WHEN i.type = 'purchase' THEN 1.17 ELSE 0.6 END AS confidence, CASE WHEN i.type = 'purchase' THEN 0.92 ELSE 0.6 END AS base FROM interaction i JOIN person p ON p.id = i.person_id),
jm AS (SELECT 'tmp:'||pr.id AS temp_id, min(c.id) AS best, count(*) AS n FROM project pr JOIN project c ON c.name = pr.name GROUP BY 1),
dec AS (SELECT category, temp_id, confidence, best, CASE WHEN confidence >= 0.9 AND confidence - second <= 0.1 THEN 'multi_resolved' WHEN confidence >= 0.9 THEN 'resolved' ELSE 'new' END AS status FROM odec
  UNION ALL SELECT 'person', temp_id, confidence, person_id, CASE WHEN confidence >= 0.9 THEN 'resolved' ELSE 'new' END FROM pm
  UNION ALL SELECT 'project', temp_id, 0.9, best, CASE WHEN n > 1 THEN 'multi_resolved' ELSE 'resolved' END FROM jm),
final AS (SELECT *, CASE WHEN confidence >= 0.9 THEN best END AS canonical_id, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS level,
  concat_ws(';', CASE WHEN status = 'multi_resolved' THEN 'status:multi_resolved' END, CASE WHEN confidence < 0.6 THEN 'confidence_below:medium' END, CASE WHEN confidence < 0.9 THEN 'confidence_below:0.9' END) AS reasons FROM dec)
"""


def org_mentions(g: Graph) -> DataFrame:
    return g.orgs.select(F.concat(F.lit("tmp:"), "id").alias("temp_id"), F.lower("name").alias("name"),
                         F.when(F.col("concept_id") < "concept:3", F.concat(F.md5("name"), F.lit(".com"))).alias("domain"))


def org_candidates(g: Graph) -> DataFrame:
    return g.orgs.select("id", "name", F.concat(F.md5("name"), F.lit(".com")).alias("domain"))


def person_mentions(g: Graph) -> DataFrame:
    """The user of every event; the organisation is named on purchases only, by its mention."""
    employer = g.persons.select(F.col("id").alias("person_id"), "name", "org_id")
    rows = g.interactions.select("id", "type", "person_id").join(employer, "person_id")
    return rows.select(F.concat(F.lit("tmp:"), "id").alias("temp_id"), F.lower("name").alias("name"),
                       F.when(F.col("type") == "purchase", F.concat(F.lit("tmp:"), "org_id")).alias("org_id"))


def rewritten_person_mentions(g: Graph) -> DataFrame:
    return ops.rewrite(person_mentions(g), g.orgs.select(F.concat(F.lit("tmp:"), "id").alias("temp_id"), F.col("id").alias("canonical_id")), ["org_id"])


def person_candidates(g: Graph) -> DataFrame:
    return g.persons.select("id", "name", "org_id")


def project_mentions(g: Graph) -> DataFrame:
    return g.projects.select(F.concat(F.lit("tmp:"), "id").alias("temp_id"), F.upper("name").alias("name"))


def resolved(g: Graph) -> tuple[dict[str, DataFrame], DataFrame]:
    relationships = g.mentions.select(F.concat(F.lit("tmp:"), "src").alias("src"), "rel", F.concat(F.lit("tmp:"), "src").alias("dst"))
    return ops.resolve_preview(org_mentions(g), person_mentions(g), project_mentions(g), relationships, {
        "org": org_candidates(g), "person": person_candidates(g), "project": g.projects.select("id", "name")})


def all_records(g: Graph) -> DataFrame:
    columns = ["category", "temp_id", "canonical_id", "best_guess_id", "confidence", "resolution_status", "confidence_level", "needs_review",
               "review_reasons", "is_new", "id", "identity_candidates", "alternates", "identity_history"]
    parts = [r.select(*columns) for r in resolved(g)[0].values()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("f03_similarity", sql="""
SELECT p_partkey, 1.0::DOUBLE AS swapped, round(2.0 * length(p_name) / (2 * length(p_name) + 1), 6) AS longer FROM part""", graph=False)
def name_similarity(g: Graph) -> DataFrame:
    name = F.col("p_name")
    swapped = F.concat_ws("-", F.substring_index(F.upper(name), " ", -1), F.substring_index(F.upper(name), " ", 1))
    return g.table("part").select("p_partkey", F.round(similarity(name, swapped), 6).alias("swapped"),
                                  F.round(similarity(name, F.concat(name, F.lit("x"))), 6).alias("longer"))


@query("j10_org_candidates", sql=RESOLVE_SQL + "SELECT temp_id, id, (SELECT count(*) FROM org)::BIGINT AS n_offered FROM os WHERE name_sim > 0 OR domain_sim > 0")
def j10(g: Graph) -> DataFrame:
    """Every organisation is offered to a mention; the rows are those that carry a signal."""
    m, c = ops.sides(org_mentions(g), org_candidates(g))
    pairs = ops.paired(m, c, "org")
    offered = g.orgs.agg(F.count("*").alias("n_offered"))
    return pairs.join(m.select("profile", "temp_id"), "profile").join(c.select("signature", "id"), "signature").select("temp_id", "id").join(F.broadcast(offered))


@query("j11_person_candidates", sql=RESOLVE_SQL + "SELECT temp_id, person_id AS id FROM pm")
def j11(g: Graph) -> DataFrame:
    m, c = ops.sides(person_mentions(g), person_candidates(g))
    pairs = ops.paired(ops.distinct_profiles(m), c, "person")
    return pairs.join(m.select("profile", "temp_id"), "profile").join(c.select("signature", "id"), "signature").select("temp_id", "id")


@query("j12_project_candidates", sql="SELECT lower(p_name) AS name, count(*)::BIGINT AS n_candidates, min('project:'||p_partkey) AS first_id FROM part GROUP BY 1", graph=False)
def j12(g: Graph) -> DataFrame:
    """Candidates per distinct project mention; equal mentions share one profile."""
    m, c = ops.sides(project_mentions(g).drop("temp_id"), g.projects.select("id", "name"))
    pairs = ops.paired(m, c, "project").join(m.select("profile", F.lower("name").alias("low")).distinct(), "profile")
    return pairs.join(c.select("signature", "id"), "signature").groupBy(F.col("low").alias("name")).agg(
        F.count("*").alias("n_candidates"), F.min("id").alias("first_id"))


@query("e01_field_similarity", sql=RESOLVE_SQL + "SELECT temp_id, id, round(name_sim, 6) AS name_sim, round(domain_sim, 6) AS domain_sim FROM os WHERE name_sim > 0 OR domain_sim > 0")
def e01(g: Graph) -> DataFrame:
    m, c = ops.sides(org_mentions(g), org_candidates(g))
    scored = ops.scored_pairs(ops.paired(m, c, "org"), m, c, "org")
    rows = scored.join(m.select("profile", "temp_id"), "profile").join(c.select("signature", "id"), "signature")
    return rows.select("temp_id", "id", F.round("name_sim", 6).alias("name_sim"), F.round("domain_sim", 6).alias("domain_sim"))


@query("e02_candidate_scores", sql=RESOLVE_SQL + """
SELECT temp_id, person_id AS id, base::DOUBLE AS score, CASE WHEN base > 0.9 THEN 'name_org' ELSE 'name' END AS matched FROM pm""")
def e02(g: Graph) -> DataFrame:
    m, c = ops.sides(rewritten_person_mentions(g), person_candidates(g))
    p = ops.distinct_profiles(m)
    scored = ops.scored_pairs(ops.paired(p, c, "person"), p, c, "person")
    rows = m.select("profile", "temp_id").join(scored, "profile").join(c.select("signature", "id"), "signature")
    return rows.select("temp_id", "id", F.round("base_score", 6).alias("score"), F.array_join("matched_fields", ",").alias("matched"))


@query("e03_context_bonus", sql=RESOLVE_SQL + """,
ctx AS (SELECT m.temp_id, m.person_id, any_value(m.base) AS base, coalesce(bool_or('project:'||l.l_partkey = 'project:'||e.event_id), false) AS hit
  FROM pm m JOIN events e ON m.temp_id = 'tmp:interaction:'||e.event_id
  LEFT JOIN orders ON 'person:'||o_custkey = m.person_id LEFT JOIN lineitem l ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT temp_id, person_id AS id, (0.25 * hit::INT + 0.25 * (base > 0.9)::INT)::DOUBLE AS bonus, concat_ws(',', CASE WHEN base > 0.9 THEN 'org' END, CASE WHEN hit THEN 'project' END) AS kinds
FROM ctx WHERE hit OR base > 0.9""")
def e03(g: Graph) -> DataFrame:
    """Each event's context names one project, and its person's own organisation is context too where it is named.

    A person involved in the project, or of the organisation, gets its bonus.  Thresholds are set to equality so that the check can
    be an equality too.
    """
    equal = {"person": {f"{k}_similarity": 1.0 for k in ("name", "org", "email", "phone", "domain", "project", "document", "location")}}
    mentions = rewritten_person_mentions(g).withColumn("context_id", F.col("temp_id"))
    context = mentions.select("context_id", F.lit("project").alias("kind"), F.regexp_replace("context_id", "^tmp:interaction:", "project:").alias("value"))
    offered = g.involved_in.select(F.col("src").alias("id"), F.lit("project").alias("kind"), F.col("dst").alias("value"))
    m, c = ops.sides(mentions, person_candidates(g))
    pairs = ops.paired(m, c, "person", equal)
    paired = c.join(pairs.select("signature").distinct(), "signature", "left_semi")  # what others offer is not asked for
    hits = ops.context_hits(pairs, ops.own_context(m, context), ops.offered_context(paired, offered), "person", equal)
    # a null id speaks for all persons of the signature
    each = hits.join(c.select("signature", F.col("id").alias("of")), "signature").filter("id IS NULL OR id = of")
    kinds = each.groupBy("profile", "of").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))
    return kinds.join(m.select("profile", "temp_id"), "profile").select("temp_id", F.col("of").alias("id"), F.round(ops.bonus(F.col("kinds"), "person"), 6).alias("bonus"),
                                                                        F.array_join("kinds", ",").alias("kinds"))


@query("w08_candidate_ranking", sql=RESOLVE_SQL + "SELECT temp_id, id, round(score, 6) AS score, position::BIGINT AS position FROM orank")
def w08(g: Graph) -> DataFrame:
    m, c = ops.sides(org_mentions(g), org_candidates(g))
    asked, offered = ops.own_context(m, None), ops.offered_context(c, None)
    pairs = ops.paired(m, c, "org", asked=asked, offered=offered, kinds=("org", "domain"))
    ranked = ops.ranked_candidates(ops.scored_pairs(pairs, m, c, "org"), c, "org", ops.context_hits(pairs, asked, offered, "org"))
    return ranked.join(m.select("profile", "temp_id"), "profile").select("temp_id", "id", F.round("score", 6).alias("score"),
                                                                         F.col("position").cast("bigint").alias("position"))


@query("e04_decisions", sql=RESOLVE_SQL + "SELECT category, temp_id, canonical_id, status AS resolution_status, round(confidence, 6) AS confidence FROM final")
def e04(g: Graph) -> DataFrame:
    return all_records(g).select("category", "temp_id", "canonical_id", "resolution_status", F.round("confidence", 6).alias("confidence"))


@query("e05_levels_and_review", sql=RESOLVE_SQL + "SELECT category, level AS confidence_level, reasons <> '' AS needs_review, reasons, count(*)::BIGINT AS n FROM final GROUP BY ALL")
def e05(g: Graph) -> DataFrame:
    return all_records(g).groupBy("category", "confidence_level", "needs_review", F.array_join("review_reasons", ";").alias("reasons")) \
        .agg(F.count("*").alias("n"))


@query("e06_resolved_records", sql=RESOLVE_SQL + """,
shown AS (SELECT temp_id, count(*) AS n FROM orank GROUP BY 1 UNION ALL SELECT temp_id, 1 FROM pm UNION ALL SELECT temp_id, least(n, 4) FROM jm)
SELECT f.temp_id, coalesce(canonical_id, f.temp_id) AS id, canonical_id IS NULL AS is_new, n::BIGINT AS n_candidates, (n - (canonical_id IS NOT NULL)::INT)::BIGINT AS n_alternates, status AS last_status
FROM final f JOIN shown USING (temp_id)""")
def e06(g: Graph) -> DataFrame:
    return all_records(g).select("temp_id", "id", "is_new", F.size("identity_candidates").cast("bigint").alias("n_candidates"),
                                 F.size("alternates").cast("bigint").alias("n_alternates"), F.element_at("identity_history", -1)["status"].alias("last_status"))


@query("e07_resolution_log", sql=RESOLVE_SQL + "SELECT category, temp_id, best AS best_guess_id, status AS resolution_status FROM final WHERE status <> 'resolved' OR reasons <> ''")
def e07(g: Graph) -> DataFrame:
    return ops.resolution_log(all_records(g)).select("category", "temp_id", "best_guess_id", "resolution_status")


@query("e08_preview_resolution", sql=RESOLVE_SQL + "SELECT category, status AS resolution_status, count(*)::BIGINT AS n, count(canonical_id)::BIGINT AS n_canonical, round(avg(confidence), 6) AS mean_confidence FROM final GROUP BY ALL")
def e08(g: Graph) -> DataFrame:
    return all_records(g).groupBy("category", "resolution_status").agg(
        F.count("*").alias("n"), F.count("canonical_id").alias("n_canonical"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("j13_id_rewrite", sql=RESOLVE_SQL + """
SELECT coalesce(f.canonical_id, 'tmp:'||i.id) AS src, coalesce(f.canonical_id, 'tmp:'||i.id) AS dst, count(*)::BIGINT AS n FROM interaction i JOIN final f ON f.temp_id = 'tmp:'||i.id GROUP BY ALL""")
def j13(g: Graph) -> DataFrame:
    return resolved(g)[1].groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("j14_reassignment", sql=RESOLVE_SQL + """
SELECT f.temp_id, coalesce('merged:'||p.id, canonical_id) AS canonical_id, 'merged:'||f.best AS best_guess_id, 'reassigned' AS last_status FROM final f LEFT JOIN person p ON p.id = f.canonical_id WHERE category = 'person'""")
def j14(g: Graph) -> DataFrame:
    """Every person id moves to a merged one; records, candidates and history follow."""
    mapping = g.persons.select(F.col("id").alias("temp_id"), F.concat(F.lit("merged:"), "id").alias("canonical_id"))
    moved = ops.reassign(resolved(g)[0]["person"], mapping)
    return moved.select("temp_id", "canonical_id", "best_guess_id", F.element_at("identity_history", -1)["status"].alias("last_status"))
