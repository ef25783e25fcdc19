"""Alert, score, path and policy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph import model
from kithgraph.functions import ids
from kithgraph.functions.text import intent, query_keywords
from kithgraph.functions.values import entity_category, preferred_label, primary_id, sentiment_score
from kithgraph.operators import alerts as ops
from kithgraph.operators import paths
from kithgraph.operators import policy as pol
from kithgraph.operators import search
from kithgraph.plans.registry import query
from kithgraph.sources.graph import EDGE_TYPES, Graph
from kithgraph.sources.sinks import append_samples

# A trained policy for the queries that need one.
TRAINED = pol.Policy(
    "1.0.1",
    {"materialised": {"path_length": 0.15, "recency": 0.8, "sentiment_slope": -0.5, "commitment_age": 0.001,
                      "influence_centrality": 0.6, "edge_type::made": 0.3, "negative_sentiment_streak": 0.2,
                      "overdue_commitments": 0.05, "interaction_count": 0.01}},
    {"materialised": -0.4}, True)


WINDOW_START = "2024-01-17"  # 14 days before the evaluation time


def as_of() -> F.Column:
    return F.lit("2024-01-31").cast("timestamp")


def as_of_orders() -> F.Column:
    return F.lit("2000-01-01").cast("date")


@query("r01_unresolved_commitments", sql="""
SELECT c.id, c.text, c.due_date, c.status, p.id AS person_id, p.name AS person_name
FROM commitment c JOIN person p ON p.id = c.owner_id
WHERE c.status NOT IN ('accepted','done') AND c.due_date < DATE '2000-01-01' - INTERVAL 7 DAY""")
def unresolved(g: Graph) -> DataFrame:
    return ops.unresolved_commitments(g.open_commitments_before("1999-12-25"), g.persons, as_of_orders())


@query("j19_ownership", sql="""
SELECT p.id AS person_id, c.status, count(*)::BIGINT AS n, min(c.due_date) AS first_due
FROM commitment c JOIN person p ON p.id = c.owner_id GROUP BY ALL""")
def ownership(g: Graph) -> DataFrame:
    owned = g.made.select(F.col("src").alias("person_id"), F.col("dst").alias("id")).join(g.commitments, "id")
    return owned.groupBy("person_id", "status").agg(F.count("*").alias("n"), F.min("due_date").alias("first_due"))


RECENT_SQL = """,
recent AS (
  SELECT p.org_id, i.id, i.tm, i.sentiment, row_number() OVER (PARTITION BY p.org_id ORDER BY i.tm DESC, i.id, p.id) AS position
  FROM interaction i JOIN person p ON p.id = i.person_id
  WHERE i.tm >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY AND i.sentiment IS NOT NULL)
"""


@query("r02_sentiment_drop", sql=RECENT_SQL + """
SELECT o.id AS org_id, o.name AS org_name FROM org o JOIN recent r ON r.org_id = o.id WHERE r.position <= 3
GROUP BY ALL HAVING count(*) = 3 AND bool_and(r.sentiment = 'negative')""")
def sentiment_drop(g: Graph) -> DataFrame:
    return ops.sentiment_drop(g.interactions_since(WINDOW_START), g.works_for, g.orgs, as_of())


@query("w01_last_three_sentiments", sql=RECENT_SQL + """
SELECT org_id, id, sentiment, position::BIGINT AS position FROM recent WHERE position <= 3""")
def last_three(g: Graph) -> DataFrame:
    moods = ops.recent_moods(g.interactions_since(WINDOW_START), g.works_for, as_of())
    return moods.select("org_id", "id", "sentiment", F.col("position").cast("bigint").alias("position"))


TARGETS_SQL = """,
recent AS (SELECT * FROM interaction WHERE tm IS NULL OR tm >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY),
targets AS (
  SELECT 'Interaction' AS kind, id AS item, person_id AS entity, 'stakeholder' AS category, tm, sentiment_score, NULL::DATE AS due_date, NULL AS status FROM recent
  UNION ALL SELECT 'Commitment', id, owner_id, 'stakeholder', NULL, NULL, due_date, status FROM commitment
  UNION ALL SELECT 'Commitment', c.id, r.dst, 'project', NULL, NULL, c.due_date, c.status FROM relates_to r JOIN commitment c ON c.id = r.src)
"""
SCORES_SQL = TARGETS_SQL + """,
marked AS (SELECT *, sum(CASE WHEN sentiment_score < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY tm DESC, item ROWS UNBOUNDED PRECEDING) AS island
           FROM targets WHERE kind = 'Interaction' AND sentiment_score IS NOT NULL),
streaks AS (SELECT entity, max(n) AS streak FROM (
  SELECT entity, island, count(*) FILTER (sentiment_score < 0) AS n FROM marked GROUP BY ALL) GROUP BY 1),
aged AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(coalesce(tm, due_date::TIMESTAMP, TIMESTAMP '2024-01-31'))) / 86400000000.0 AS age FROM targets),
moods AS (SELECT entity, count(*) AS n, arg_min(sentiment_score, struct_pack(a := tm, b := item)) AS oldest,
          arg_max(sentiment_score, struct_pack(a := tm, b := item)) AS newest FROM targets WHERE kind = 'Interaction' AND sentiment_score IS NOT NULL GROUP BY 1),
rolled AS (
  SELECT entity, category, count(*) FILTER (kind = 'Interaction')::BIGINT AS interaction_count, count(*) FILTER (kind = 'Commitment')::BIGINT AS commitment_count,
         count(*) FILTER (kind = 'Commitment' AND coalesce(status,'') NOT IN ('done','cancelled') AND due_date < DATE '2024-01-31')::BIGINT AS overdue_commitments,
         count(*)::DOUBLE AS path_length, avg(1.0 / (1.0 + greatest(0.0, age))) AS recency,
         coalesce(max(CASE WHEN kind = 'Commitment' THEN greatest(0.0, age) END), 0.0) AS commitment_age
  FROM aged GROUP BY ALL),
scores AS (
  SELECT r.*, coalesce(s.streak, 0)::BIGINT AS negative_streak,
         CASE WHEN m.n >= 2 THEN (m.oldest - m.newest) / (m.n - 1) ELSE 0.0 END AS sentiment_slope,
         least(1.0, interaction_count / 10.0) AS influence_score
  FROM rolled r LEFT JOIN streaks s USING (entity) LEFT JOIN moods m USING (entity)),
risk AS (SELECT *, 1.0 / (1.0 + exp(-(-0.4 + 0.2 * negative_streak + 0.05 * overdue_commitments + 0.01 * interaction_count))) AS score FROM scores)
"""


def targets(g: Graph) -> DataFrame:
    return ops.collect_targets(g.incidents(WINDOW_START), as_of())


def scores(g: Graph) -> DataFrame:
    return ops.entity_scores(targets(g), as_of())


@query("r03_collect_targets", sql=TARGETS_SQL + """
SELECT kind, category, count(*)::BIGINT AS n, count(DISTINCT entity)::BIGINT AS n_entities, count(DISTINCT item)::BIGINT AS n_items FROM targets GROUP BY ALL""")
def collect_targets(g: Graph) -> DataFrame:
    return targets(g).groupBy("kind", "category").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("n_entities"),
                                                      F.countDistinct("item").alias("n_items"))


@query("l04_newest_targets", sql=TARGETS_SQL + """,
capped AS (SELECT id FROM recent ORDER BY tm DESC NULLS FIRST, id LIMIT 200)
SELECT entity, count(*)::BIGINT AS n FROM targets WHERE kind = 'Interaction' AND item IN (SELECT id FROM capped) GROUP BY 1""")
def newest_targets(g: Graph) -> DataFrame:
    capped = ops.collect_targets(g.incidents(WINDOW_START), as_of(), limit=200)
    return capped.filter(F.col("kind") == "Interaction").groupBy("entity").agg(F.count("*").alias("n"))


@query("r04_entity_scores", sql=SCORES_SQL + """
SELECT entity, category, interaction_count, commitment_count, overdue_commitments, negative_streak, round(influence_score, 6) AS influence_score,
       round(recency, 6) AS recency, round(sentiment_slope, 6) AS sentiment_slope, round(commitment_age, 4) AS commitment_age, round(score, 6) AS score FROM risk""")
def entity_scores(g: Graph) -> DataFrame:
    scored = pol.entity_score(scores(g), TRAINED)
    return scored.select(
        "entity", "category", "interaction_count", "commitment_count", "overdue_commitments",
        F.col("negative_streak").cast("bigint").alias("negative_streak"), F.round("influence_score", 6).alias("influence_score"),
        F.round("recency", 6).alias("recency"), F.round("sentiment_slope", 6).alias("sentiment_slope"),
        F.round("commitment_age", 4).alias("commitment_age"), F.round("score", 6).alias("score"))


@query("a03_entity_rollup", sql=SCORES_SQL + "SELECT entity, category, interaction_count, commitment_count FROM scores")
def entity_rollup(g: Graph) -> DataFrame:
    return targets(g).groupBy("entity", "category").agg(
        F.count_if(F.col("kind") == "Interaction").alias("interaction_count"),
        F.count_if(F.col("kind") == "Commitment").alias("commitment_count"))


@query("a04_overdue_count", sql=SCORES_SQL + "SELECT entity, overdue_commitments FROM scores WHERE category = 'project'")
def overdue_count(g: Graph) -> DataFrame:
    return scores(g).filter(F.col("category") == "project").select("entity", "overdue_commitments")


@query("a05_influence", sql=SCORES_SQL + "SELECT entity, interaction_count, round(influence_score, 6) AS influence_score FROM scores WHERE interaction_count > 0")
def influence(g: Graph) -> DataFrame:
    return scores(g).filter(F.col("interaction_count") > 0).select("entity", "interaction_count",
                                                                   F.round("influence_score", 6).alias("influence_score"))


@query("w02_negative_streak", sql=""",
marked AS (SELECT person_id, sentiment_score, sum(CASE WHEN sentiment_score < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY person_id ORDER BY tm DESC, id ROWS UNBOUNDED PRECEDING) AS island FROM interaction)
SELECT person_id, max(n)::BIGINT AS longest_run FROM (SELECT person_id, island, count(*) FILTER (sentiment_score < 0) AS n FROM marked GROUP BY ALL) GROUP BY 1""")
def negative_streak(g: Graph) -> DataFrame:
    moods = g.interactions.filter(F.col("sentiment_score").isNotNull())
    return ops.longest_runs(moods, "person_id", [F.desc("at"), F.asc("id")], F.col("sentiment_score") < 0)


@query("r05_untrained_score", sql=SCORES_SQL + "SELECT entity, 0.5::DOUBLE AS score, 'Neutral fallback because reasoning path model is not trained.' AS explanation FROM scores")
def untrained_score(g: Graph) -> DataFrame:
    return pol.entity_score(scores(g), pol.Policy()).select("entity", "score", "explanation")


@query("r06_alert_rules", sql=SCORES_SQL + """,
u AS (SELECT entity, score, unnest(['unresolved_commitment','sentiment_drop']) AS type FROM risk WHERE score >= 0.6),
h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('learned_'||type||':'||entity)) AS d FROM u)
SELECT entity, type, 'open' AS status, 'Model scored path risk at '||printf('%.2f', score) AS summary,
  substr(d,1,8)||'-'||substr(d,9,4)||'-5'||substr(d,14,3)||'-'||substr('89ab', (('0x'||substr(d,17,1))::INT % 4) + 1, 1)||substr(d,18,3)||'-'||substr(d,21,12) AS id FROM h""")
def alert_rules(g: Graph) -> DataFrame:
    return ops.raise_alerts(pol.entity_score(scores(g), TRAINED)).select("entity", "type", "status", "summary", "id")


@query("r06_alert_rules_strict", sql=SCORES_SQL + """
SELECT type, count(*)::BIGINT AS n FROM (SELECT *, unnest(['unresolved_commitment','sentiment_drop']) AS type FROM risk WHERE score >= 0.6)
WHERE (type = 'sentiment_drop' AND negative_streak >= 3) OR (type = 'unresolved_commitment' AND overdue_commitments > 0) GROUP BY 1""")
def alert_rules_strict(g: Graph) -> DataFrame:
    raised = ops.raise_alerts(pol.entity_score(scores(g), TRAINED), strict=True)
    return raised.groupBy("type").agg(F.count("*").alias("n"))


@query("s10_alert_sink", sql=SCORES_SQL + """,
fresh AS (SELECT type||':'||entity AS id, entity, type, score FROM (SELECT entity, score, unnest(['unresolved_commitment','sentiment_drop']) AS type FROM risk WHERE score >= 0.6)),
old AS (SELECT 'unresolved_commitment:'||id AS id, id AS entity FROM person UNION ALL SELECT 'sentiment_drop:'||id, id FROM org)
SELECT coalesce(f.id, o.id) AS id, coalesce(f.entity, o.entity) AS entity, CASE WHEN o.id IS NOT NULL THEN 'acknowledged' ELSE 'open' END AS status,
  CASE WHEN o.id IS NOT NULL THEN '2024-01-01' ELSE '2024-01-31' END AS created_on, CASE WHEN f.id IS NOT NULL THEN '2024-01-31' ELSE '2024-01-01' END AS updated_on
FROM fresh f FULL JOIN old o ON o.id = f.id""")
def alert_sink(g: Graph) -> DataFrame:
    fresh = ops.raise_alerts(pol.entity_score(scores(g), TRAINED)).withColumn("id", F.concat_ws(":", "type", "entity"))
    day = F.lit("2024-01-01").cast("timestamp")
    people = g.persons.select("id", F.lit("unresolved_commitment").alias("type"))
    orgs = g.orgs.select("id", F.lit("sentiment_drop").alias("type"))
    old = people.unionByName(orgs).select(
        F.concat_ws(":", "type", "id").alias("id"), F.col("id").alias("entity"), "type", F.lit("acknowledged").alias("status"),
        F.lit("acknowledged").alias("outcome"), F.lit(0.0).alias("score"), day.alias("created_at"), day.alias("updated_at"))
    merged = ops.merge_alerts(old, fresh, as_of())
    return merged.select("id", "entity", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"),
                         F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"))


@query("s10_alert_links", sql=SCORES_SQL + """
SELECT type, 'ASSOCIATED_WITH' AS rel, count(*)::BIGINT AS n FROM (SELECT entity, unnest(['unresolved_commitment','sentiment_drop']) AS type FROM risk WHERE score >= 0.6)
WHERE entity IN (SELECT id FROM person) GROUP BY ALL""")
def alert_links(g: Graph) -> DataFrame:
    raised = ops.raise_alerts(pol.entity_score(scores(g), TRAINED))
    links = ops.alert_links(raised, g.persons.select("id"))
    return links.join(raised.select(F.col("id").alias("src"), "type"), "src").groupBy("type", "rel").agg(F.count("*").alias("n"))


# --- labelled samples -------------------------------------------------------------------

SAMPLES_SQL = """
WITH samples AS (
  SELECT 'alert:'||d.doc_id AS alert_id, CASE WHEN l.toxic = 1 THEN 'false_positive' WHEN l.quality = 1 THEN 'materialised' ELSE 'acknowledged' END AS outcome,
    CASE d.lang WHEN 'en' THEN 1.0 WHEN 'fr' THEN 2.0 WHEN 'de' THEN 3.0 ELSE 4.0 END AS path_length, 1.0 / (1.0 + n_chars / 1000.0) AS recency,
    (l.quality - l.toxic) * 0.5 AS sentiment_slope, ln(1.0 + n_chars) AS commitment_age,
    least(1.0, len(string_split(d.text, chr(10))) / 10.0) AS influence_centrality, d.doc_id
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
scored AS (SELECT *, 0.15 * path_length AS c1, 0.8 * recency AS c2, -0.5 * sentiment_slope AS c3, 0.001 * commitment_age AS c4, 0.6 * influence_centrality AS c5 FROM samples),
final AS (SELECT *, 1.0 / (1.0 + exp(-(-0.4 + c1 + c2 + c3 + c4 + c5))) AS score FROM scored)
"""


def samples(g: Graph) -> DataFrame:
    """Labelled samples: outcome from the labels, features from the documents."""
    docs = g.table("documents").join(g.table("labels"), "doc_id")
    lang = F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "fr", 2.0).when(F.col("lang") == "de", 3.0).otherwise(4.0)
    return docs.select(
        F.concat(F.lit("alert:"), "doc_id").alias("alert_id"),
        F.when(F.col("toxic") == 1, "false_positive").when(F.col("quality") == 1, "materialised").otherwise("acknowledged")
        .alias("outcome"),
        F.create_map(
            F.lit("path_length"), lang, F.lit("recency"), 1.0 / (1.0 + F.col("n_chars") / 1000.0),
            F.lit("sentiment_slope"), (F.col("quality") - F.col("toxic")) * 0.5,
            F.lit("commitment_age"), F.log(1.0 + F.col("n_chars")),
            F.lit("influence_centrality"), F.least(F.lit(1.0), F.size(F.split("text", "\n")) / 10.0)).alias("features"),
        F.lit("2024-01-31").cast("timestamp").alias("timestamp"))


@query("r07_policy_evaluation", sql=SAMPLES_SQL + """,
long AS (SELECT alert_id, score, unnest([{'f':'path_length','v':c1},{'f':'recency','v':c2},{'f':'sentiment_slope','v':c3},{'f':'commitment_age','v':c4},{'f':'influence_centrality','v':c5}]) AS e FROM final),
ranked AS (SELECT alert_id, score, e.f AS f, e.v AS v, row_number() OVER (PARTITION BY alert_id ORDER BY abs(e.v) DESC, e.f) AS rn FROM long)
SELECT alert_id, round(score, 6) AS score, printf('Path score %.2f from logistic policy v1.0.1; top contributions: ', score) ||
  string_agg(printf('%s=%+.3f', f, v), ', ' ORDER BY rn) || '.' AS explanation FROM ranked WHERE rn <= 3 GROUP BY alert_id, score""", graph=False)
def policy_evaluation(g: Graph) -> DataFrame:
    return pol.evaluate(samples(g), TRAINED).select("alert_id", F.round("score", 6).alias("score"), "explanation")


@query("w07_top_features", sql=SAMPLES_SQL + """,
long AS (SELECT alert_id, unnest([{'f':'path_length','v':c1},{'f':'recency','v':c2},{'f':'sentiment_slope','v':c3},{'f':'commitment_age','v':c4},{'f':'influence_centrality','v':c5}]) AS e FROM final),
ranked AS (SELECT alert_id, e.f AS feature, e.v AS v, row_number() OVER (PARTITION BY alert_id ORDER BY abs(e.v) DESC, e.f)::BIGINT AS position FROM long)
SELECT alert_id, feature, position, round(v, 6) AS contribution FROM ranked WHERE position <= 3""", graph=False)
def top_features(g: Graph) -> DataFrame:
    scored = pol.evaluate(samples(g), TRAINED).select("alert_id", F.posexplode("top").alias("i", "e"))
    return scored.select("alert_id", "e.feature", (F.col("i") + 1).cast("bigint").alias("position"),
                         F.round("e.contribution", 6).alias("contribution"))


@query("r09_policy_training")
def policy_training(g: Graph) -> DataFrame:
    """Weights of the policy fitted on all labelled samples, one row per outcome and feature."""
    fitted = pol.train(samples(g).select("outcome", "features"))
    rows = [(o, f, float(w)) for o in model.OUTCOMES for f, w in
            list(fitted.weights[o].items()) + [("(intercept)", fitted.intercepts[o])]]
    return g.spark.createDataFrame(rows, "outcome string, feature string, weight double")


@query("r10_policy_accuracy", sql=SAMPLES_SQL + """
SELECT round(avg(CASE WHEN (CASE WHEN score >= 0.55 THEN 'materialised' WHEN score >= 0.35 THEN 'acknowledged' ELSE 'false_positive' END) = outcome THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       count(*)::BIGINT AS n FROM final""", graph=False)
def policy_accuracy(g: Graph) -> DataFrame:
    return pol.accuracy(samples(g), TRAINED).select(F.round("accuracy", 6).alias("accuracy"), "n")


STATUSES_SQL = """
WITH statuses AS (SELECT 'alert:'||event_id AS alert_id, CASE event_type WHEN 'view' THEN ' Acknowledged ' WHEN 'purchase' THEN 'closed' WHEN 'error' THEN 'IGNORED' ELSE 'open' END AS status,
  user_id, value, ts FROM events),
mapped AS (SELECT *, CASE lower(trim(status)) WHEN 'acknowledged' THEN 'acknowledged' WHEN 'closed' THEN 'materialised' WHEN 'ignored' THEN 'false_positive' END AS outcome FROM statuses)
"""


def outcome_events(g: Graph) -> DataFrame:
    kind = F.col("event_type")
    return g.table("events").select(
        F.concat(F.lit("alert:"), "event_id").alias("alert_id"),
        F.when(kind == "view", " Acknowledged ").when(kind == "purchase", "closed").when(kind == "error", "IGNORED")
        .otherwise("open").alias("status"), "user_id", "value", F.col("ts").alias("timestamp"))


@query("r11_outcome_recording", sql=STATUSES_SQL + """
SELECT user_id, outcome, count(*)::BIGINT AS n, count(*) >= 25 AS retrain FROM mapped WHERE outcome IS NOT NULL GROUP BY ALL""", graph=False)
def outcome_recording(g: Graph) -> DataFrame:
    rows = outcome_events(g).withColumn("outcome", pol.outcome_label(F.col("status"))).filter(F.col("outcome").isNotNull())
    return rows.groupBy("user_id", "outcome").agg(F.count("*").alias("n"),
                                                  (F.count("*") >= model.RETRAIN_THRESHOLD).alias("retrain"))


@query("r11_archive", sql="""
SELECT user_id::VARCHAR AS policy_id, event_id, position::BIGINT AS position FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position FROM events) WHERE position <= 25""", graph=False)
def archive(g: Graph) -> DataFrame:
    versions = g.table("events").select(F.col("user_id").cast("string").alias("policy_id"), F.col("ts").alias("archived_at"),
                                        F.col("event_id").alias("version"))
    return pol.archive(versions).select("policy_id", F.col("version").alias("event_id"),
                                        F.col("position").cast("bigint").alias("position"))


@query("r12_labelled_alerts", sql=STATUSES_SQL + """
SELECT outcome, count(*)::BIGINT AS n, round(avg(value), 4) AS mean_score FROM mapped WHERE outcome IS NOT NULL GROUP BY 1""", graph=False)
def labelled_alerts(g: Graph) -> DataFrame:
    alerts = outcome_events(g).select("alert_id", F.col("status").alias("outcome"), "value",
                                      F.create_map(F.lit("recency"), F.col("value")).alias("features"))
    return ops.labelled_alerts(alerts).groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_score"))


@query("s04_reinforcement_log", sql=SAMPLES_SQL + """
SELECT DISTINCT alert_id||'|'||outcome AS sample_key, alert_id, outcome FROM samples""", graph=False)
def reinforcement_log(g: Graph) -> DataFrame:
    """Append twice: first the toxic rows, then everything; the second append only adds new keys."""
    rows = samples(g)
    path = append_samples(g.spark, rows.filter(F.col("outcome") == "false_positive"))
    append_samples(g.spark, rows.unionByName(rows), path)
    return g.spark.read.parquet(path).select("sample_key", "alert_id", "outcome").orderBy("sample_key")


@query("f14_sample_key", sql=SAMPLES_SQL + """
SELECT alert_id||'|'||outcome AS named, 'anon|'||outcome||'|2024-01-31T00:00:00|commitment_age,influence_centrality,path_length,recency,sentiment_slope' AS anonymous FROM samples""", graph=False)
def sample_keys(g: Graph) -> DataFrame:
    def key(alert: F.Column) -> F.Column:
        return ids.sample_key(alert, F.upper("outcome"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.map_keys("features"))

    return samples(g).select(key(F.col("alert_id")).alias("named"), key(F.lit("")).alias("anonymous"))


# --- paths ------------------------------------------------------------------------------

# What a path's policy reads, worked out from lists of a path's nodes, relationships and times.
SCORED_SQL = """
cells AS (SELECT key, unnest(nodes) AS id, generate_subscripts(nodes, 1) AS pos FROM cand),
seen AS (SELECT key, max(coalesce(influence_score, 0.0)) AS influence,
    max(greatest(0.0, coalesce((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(due_date::TIMESTAMP)) / 86400000000.0, 0.0))) AS age,
    list(sentiment_score ORDER BY pos) FILTER (sentiment_score IS NOT NULL) AS moods FROM cells JOIN nodes USING (id) GROUP BY key),
feats AS (SELECT c.*, influence, age, CASE WHEN len(moods) >= 2 THEN (moods[-1] - moods[1]) / (len(moods) - 1) ELSE 0.0 END AS slope,
    coalesce(list_avg(list_transform(list_filter(times, lambda t: t IS NOT NULL), lambda t: 1.0 / (1.0 + greatest(0.0, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(t)) / 86400000000.0)))), 0.5) AS recency,
    len(list_filter(rels, lambda r: r = 'MADE')) / hops::DOUBLE AS made_share FROM cand c JOIN seen USING (key)),
scored AS (SELECT *, 1.0 / (1.0 + exp(-(-0.4 + 0.15 * hops + 0.8 * recency - 0.5 * slope + 0.001 * age + 0.6 * influence + 0.3 * made_share))) AS score FROM feats)
"""


def _paths_sql() -> str:
    """Trails hop by hop; starts that have 15 grow no further."""
    parts = [""",
steps AS (SELECT *, src||'|'||rel||'|'||dst AS eid FROM undirected WHERE rel <> 'INSTANCE_OF'),
wanted AS (SELECT unnest(['Risk','Issue','Commitment','Project','Contract','Topic','Person','Org']) AS l),
g0 AS (SELECT id AS start, id AS target, label, []::VARCHAR[] AS eids, [id] AS nodes, []::VARCHAR[] AS rels, []::TIMESTAMP[] AS times FROM nodes WHERE label IN ('Person', 'Org', 'Project')),
l0 AS (SELECT start FROM g0)"""]
    for h in range(1, 5):
        done = " UNION ALL ".join(f"SELECT start FROM t{i}" for i in range(1, h + 1))
        parts.append(f"""g{h} AS MATERIALIZED (SELECT g.start, s.to_id AS target, s.to_label AS label, list_append(eids, eid) AS eids, list_append(g.nodes, s.to_id) AS nodes,
    list_append(rels, s.rel) AS rels, list_append(times, s.seen_at) AS times
  FROM g{h - 1} g JOIN steps s ON s.from_id = g.target WHERE g.start IN (SELECT start FROM l{h - 1}) AND NOT list_contains(eids, eid)),
t{h} AS (SELECT *, {h} AS hops, array_to_string(eids, '>') AS path FROM g{h} WHERE label IN (SELECT l FROM wanted)),
l{h} AS (SELECT g0.start FROM g0 LEFT JOIN ({done}) d ON d.start = g0.start GROUP BY 1 HAVING count(d.start) < 15)""")
    parts.append("""cand AS (SELECT *, start||'>'||path AS key, row_number() OVER (PARTITION BY start ORDER BY hops, path) AS candidate
  FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4) QUALIFY candidate <= 15)""")
    return ",\n".join(parts) + "," + SCORED_SQL


PATHS_SQL = _paths_sql()

# Purchases name a customer and, by their number, a project.
BETWEEN_SQL = """,
steps AS (SELECT *, src||'|'||rel||'|'||dst AS eid FROM undirected WHERE rel <> 'INSTANCE_OF'),
pairs AS (SELECT DISTINCT 'person:'||user_id AS start, 'project:'||event_id AS target FROM events WHERE event_type = 'purchase'),
f1 AS (SELECT from_id AS a, to_id AS z, [eid] AS eids, [from_id, to_id] AS nodes, [rel] AS rels, [seen_at] AS times FROM steps WHERE from_id IN (SELECT start FROM pairs)),
b1 AS (SELECT from_id AS a, to_id AS z, [eid] AS eids, [to_id, from_id] AS nodes, [rel] AS rels, [seen_at] AS times FROM steps WHERE from_id IN (SELECT target FROM pairs)),
t1 AS (SELECT p.start, p.target, 1 AS hops, f.eids, f.nodes, f.rels, f.times FROM pairs p JOIN f1 f ON f.a = p.start AND f.z = p.target),
t2 AS (SELECT p.start, p.target, 2, f.eids || b.eids, f.nodes || b.nodes[2:], f.rels || b.rels, f.times || b.times
       FROM pairs p JOIN f1 f ON f.a = p.start JOIN b1 b ON b.a = p.target AND b.z = f.z WHERE f.eids[1] <> b.eids[1]),
l2 AS (SELECT p.start, p.target FROM pairs p LEFT JOIN (SELECT start, target FROM t1 UNION ALL SELECT start, target FROM t2) d USING (start, target)
       GROUP BY ALL HAVING count(d.start) < 15),
f2 AS MATERIALIZED (SELECT f.a, s.to_id AS z, list_append(eids, eid) AS eids, list_append(f.nodes, s.to_id) AS nodes, list_append(rels, s.rel) AS rels, list_append(times, s.seen_at) AS times
       FROM f1 f JOIN steps s ON s.from_id = f.z WHERE f.a IN (SELECT start FROM l2) AND s.eid <> f.eids[1]),
t3 AS (SELECT p.start, p.target, 3, f.eids || b.eids, f.nodes || b.nodes[2:], f.rels || b.rels, f.times || b.times
       FROM l2 p JOIN f2 f ON f.a = p.start JOIN b1 b ON b.a = p.target AND b.z = f.z WHERE NOT list_contains(f.eids, b.eids[1])),
n3 AS (SELECT start, target FROM t1 UNION ALL SELECT start, target FROM t2 UNION ALL SELECT start, target FROM t3),
l3 AS (SELECT p.start, p.target FROM pairs p LEFT JOIN n3 d USING (start, target) GROUP BY ALL HAVING count(d.start) < 15),
b2 AS (SELECT b.a, s.to_id AS z, list_prepend(eid, eids) AS eids, list_prepend(s.to_id, b.nodes) AS nodes, list_prepend(s.rel, rels) AS rels, list_prepend(s.seen_at, times) AS times
       FROM b1 b JOIN steps s ON s.from_id = b.z WHERE b.a IN (SELECT target FROM l3) AND s.eid <> b.eids[1]),
t4 AS (SELECT p.start, p.target, 4, f.eids || b.eids, f.nodes || b.nodes[2:], f.rels || b.rels, f.times || b.times
       FROM l3 p JOIN f2 f ON f.a = p.start JOIN b2 b ON b.a = p.target AND b.z = f.z WHERE NOT list_has_any(f.eids, b.eids)),
cand AS (SELECT *, start||'>'||target||'>'||path AS key, row_number() OVER (PARTITION BY start, target ORDER BY hops, path) AS candidate
  FROM (SELECT *, array_to_string(eids, '>') AS path FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4)) QUALIFY candidate <= 15),""" + SCORED_SQL

PATH_STARTS = ("Person", "Org", "Project")


def path_arguments() -> tuple[list[str], list[str]]:
    groups = model.label_groups()
    return [label for role in model.PATH_TARGET_ROLES for label in groups[role]], model.reasoning_relationships()


def path_starts(g: Graph) -> DataFrame:
    return g.nodes.filter(F.col("label").isin(*PATH_STARTS)).select("id")


def best_paths(g: Graph) -> DataFrame:
    targets_, rels = path_arguments()
    return paths.ranked_paths(g.edges, g.nodes, path_starts(g), targets_, rels, TRAINED, as_of(), start_labels=PATH_STARTS, edge_types=EDGE_TYPES)


@query("r08_ranked_paths", sql=PATHS_SQL + """
SELECT start, target, hops::BIGINT AS hops, round(score, 6) AS score, position::BIGINT AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY start ORDER BY score DESC, candidate) AS position FROM scored) WHERE position <= 3""")
def ranked_paths(g: Graph) -> DataFrame:
    """The best paths of every stakeholder, organisation and project."""
    return best_paths(g).select("start", "target", F.col("hops").cast("bigint").alias("hops"), F.round("score", 6).alias("score"),
                                F.col("position").cast("bigint").alias("position"))


@query("r08_paths_to_target", sql=BETWEEN_SQL + """
SELECT start, target, hops::BIGINT AS hops, round(score, 6) AS score, position::BIGINT AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY start, target ORDER BY score DESC, candidate) AS position FROM scored) WHERE position <= 3""")
def ranked_paths_to_target(g: Graph) -> DataFrame:
    """The best paths from the customer of a purchase to the project it names."""
    pairs = g.table("events").filter(F.col("event_type") == "purchase").select(
        F.concat(F.lit("person:"), "user_id").alias("start"), F.concat(F.lit("project:"), "event_id").alias("target"))
    best = paths.ranked_paths_between(g.edges, g.nodes, pairs, path_arguments()[1], TRAINED, as_of())
    return best.select("start", "target", F.col("hops").cast("bigint").alias("hops"), F.round("score", 6).alias("score"),
                       F.col("position").cast("bigint").alias("position"))


@query("l05_top_paths", sql=PATHS_SQL + """
SELECT split_part(start, ':', 1) AS kind, hops::BIGINT AS hops, count(*)::BIGINT AS n, round(max(score), 6) AS best FROM (
  SELECT *, row_number() OVER (PARTITION BY start ORDER BY score DESC, candidate) AS position FROM scored) WHERE position <= 1 GROUP BY ALL""")
def top_paths(g: Graph) -> DataFrame:
    """The best path of every start; limit 3 takes the candidates, rank 1 is reported."""
    kind = F.substring_index("start", ":", 1).alias("kind")
    return best_paths(g).filter(F.col("position") == 1).groupBy(kind, F.col("hops").cast("bigint").alias("hops")).agg(
        F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


@query("a11_path_features", sql=PATHS_SQL + """
SELECT start, path, round(recency, 6) AS recency, round(age, 4) AS commitment_age, round(influence, 6) AS influence_centrality,
       hops::DOUBLE AS path_length, round(slope, 6)::DOUBLE AS sentiment_slope FROM feats""")
def path_features(g: Graph) -> DataFrame:
    targets_, rels = path_arguments()
    found = paths.enumerate_paths(g.edges, path_starts(g), targets_, rels, 4, 15, start_labels=PATH_STARTS, edge_types=EDGE_TYPES)
    rows = paths.with_features(found, g.nodes, as_of())
    return rows.select("start", F.array_join("edge_ids", ">").alias("path"), *[
        F.round(F.element_at("features", k), digits).alias(k) for k, digits in
        (("recency", 6), ("commitment_age", 4), ("influence_centrality", 6), ("path_length", 6), ("sentiment_slope", 6))])


@query("a12_edge_mix", sql="""
SELECT l_orderkey, rel, round(n / sum(n) OVER (PARTITION BY l_orderkey), 6) AS share FROM (
  SELECT l_orderkey, lower(l_returnflag) AS rel, count(*) AS n FROM lineitem GROUP BY ALL)""", graph=False)
def edge_mix(g: Graph) -> DataFrame:
    rels = g.table("lineitem").select("l_orderkey", F.lower("l_returnflag").alias("rel"))
    return pol.edge_shares(rels, "l_orderkey", "rel").select("l_orderkey", "rel", F.round("share", 6).alias("share"))


@query("a16_concept_assignments", sql="""
SELECT DISTINCT o.id AS node_id, o.concept_id, 'OrgCategory' AS concept_kind FROM person p JOIN org o ON o.id = p.org_id""")
def concept_assignments(g: Graph) -> DataFrame:
    """Distinct assignments over all one-hop paths of people that carry a concept."""
    touched = g.works_for.select(F.col("dst").alias("id")).distinct()
    return (touched.join(g.nodes.filter(F.col("concept_id").isNotNull()).select("id", "concept_id", "label"), "id")
            .select(F.col("id").alias("node_id"), "concept_id",
                    F.when(F.col("label") == "Org", model.NODE_TYPES["Org"][0]).alias("concept_kind")).distinct())


@query("r15_dialogue_plan", sql="""
SELECT DISTINCT q AS query, CASE WHEN q LIKE 'risk%' THEN 'risk' WHEN q LIKE 'who%' THEN 'who' ELSE 'search' END AS intent,
  CASE WHEN q LIKE 'risk%' THEN 'top_paths' ELSE 'search_entities' END AS action,
  CASE WHEN q LIKE 'risk%' THEN id END AS start
FROM (SELECT 'risk for '||name AS q, id FROM org UNION ALL SELECT 'who owns '||name, NULL FROM org UNION ALL SELECT name, NULL FROM project)""")
def dialogue_plan(g: Graph) -> DataFrame:
    asked = (g.orgs.select(F.concat(F.lit("risk for "), "name").alias("query"), F.col("id").alias("stakeholder_id"))
             .unionByName(g.orgs.select(F.concat(F.lit("who owns "), "name").alias("query"), F.lit(None).cast("string").alias("stakeholder_id")))
             .unionByName(g.projects.select(F.col("name").alias("query"), F.lit(None).cast("string").alias("stakeholder_id"))).distinct())
    return search.dialogue_plan(asked)


@query("p14_sentiment_coding", sql="""
SELECT event_type, round(CASE event_type WHEN 'view' THEN value WHEN 'error' THEN -1 WHEN 'purchase' THEN 1 WHEN 'click' THEN 0 END, 6) AS score, count(*)::BIGINT AS n FROM events GROUP BY ALL""", graph=False)
def sentiment_coding(g: Graph) -> DataFrame:
    kind = F.col("event_type")
    label = F.when(kind == "error", "Very NEGATIVE").when(kind == "purchase", "positive-ish").when(kind == "click", "neutral")
    score = F.when(kind == "view", F.col("value").cast("string")).when(kind == "error", "n/a")
    return g.table("events").groupBy("event_type", F.round(sentiment_score(score, label), 6).alias("score")).agg(F.count("*").alias("n"))


@query("p15_entity_category", sql="""
SELECT label, CASE WHEN label IN ('Person','Org') THEN 'stakeholder' ELSE 'project' END AS category, count(*)::BIGINT AS n FROM nodes WHERE label IN ('Person','Org','Project') GROUP BY ALL""")
def entity_categories(g: Graph) -> DataFrame:
    labels = list(model.NODE_TYPES)
    category = entity_category(F.array("label"), model.keyword_matches(labels, model.STAKEHOLDER_KEYWORDS),
                               model.keyword_matches(labels, ("project",)))
    return g.nodes.withColumn("category", category).filter(F.col("category").isNotNull()).groupBy("label", "category") \
        .agg(F.count("*").alias("n"))


@query("p16_primary_id", sql="""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderkey::VARCHAR WHEN o_totalprice / 1000.0 >= o_custkey THEN 'price' ELSE 'customer' END AS primary_id FROM orders""", graph=False)
def primary_ids(g: Graph) -> DataFrame:
    candidates = F.array(F.struct(F.lit("price").alias("id"), (F.col("o_totalprice") / 1000.0).alias("confidence")),
                         F.struct(F.lit("customer").alias("id"), F.col("o_custkey").cast("double").alias("confidence")))
    own = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string"))
    return g.table("orders").select("o_orderkey", primary_id(own, candidates).alias("primary_id"))


@query("p09_entity_label", sql="""
SELECT label, CASE WHEN label = 'Commitment' THEN 'Entity' WHEN label IN ('Person','Org') THEN label ELSE 'Entity' END AS chosen, count(*)::BIGINT AS n FROM nodes GROUP BY ALL""")
def entity_label(g: Graph) -> DataFrame:
    labels = F.array(F.lit("Entity"), F.col("label"))
    return g.nodes.groupBy("label", preferred_label(labels, ["Person", "Org", "Thing"]).alias("chosen")).agg(F.count("*").alias("n"))


@query("f19_query_keywords", sql="""
SELECT DISTINCT q AS query, CASE WHEN q LIKE 'who%' THEN 'who' ELSE 'search' END AS intent, list_aggregate(list_sort(list_distinct(list_filter(regexp_extract_all(lower(q), '[\\w-]+'), lambda t: length(t) > 2))), 'string_agg', ',') AS keywords
FROM (SELECT name||' of '||brand||' '||type AS q FROM project UNION ALL SELECT 'who owns '||name FROM org)""")
def keywords(g: Graph) -> DataFrame:
    asked = g.projects.select(F.concat_ws(" ", "name", F.lit("of"), "brand", "type").alias("query")) \
        .unionByName(g.orgs.select(F.concat(F.lit("who owns "), "name").alias("query"))).distinct()
    words = query_keywords(F.col("query"))
    return asked.select("query", intent(words).alias("intent"), F.array_join(words, ",").alias("keywords"))
