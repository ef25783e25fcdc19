"""Alert rules, entity scores and the alert table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithgraph import model
from kithgraph.session import cut_lineage
from kithgraph.functions import ids
from kithgraph.functions.text import strip
from kithgraph.functions.values import age_days, recency, rounded
from kithgraph.operators import policy as pol
from kithgraph.operators.streaks import longest_runs


def unresolved_commitments(commitments: DataFrame, persons: DataFrame, as_of: Column,
                           grace_days: int = model.OVERDUE_GRACE_DAYS) -> DataFrame:
    """Commitments past due by more than the grace period, with their makers; a null status never matches."""
    late = commitments.filter(~F.col("status").isin(*model.RESOLVED_STATUSES)
                              & (F.col("due_date") < F.date_sub(as_of, grace_days)))
    makers = persons.select(F.col("id").alias("person_id"), F.col("name").alias("person_name"))
    return (late.join(makers, late["owner_id"] == makers["person_id"])
            .select("id", "text", "due_date", "status", "person_id", "person_name"))


def mentioned(interactions: DataFrame, mentions: DataFrame) -> DataFrame:
    """Interactions with each person they mention.  Skip this join where the rows already name the person."""
    return (mentions.select(F.col("src").alias("id"), F.col("dst").alias("person_id"))
            .join(interactions.select("id", "at", "sentiment"), "id"))


def recent_moods(seen: DataFrame, works_for: DataFrame, as_of: Column, days: int = model.ALERT_WINDOW_DAYS,
                 last: int = 3) -> DataFrame:
    """Newest sentiments per organisation; one row per mentioned member, null sentiments left out.

    ``seen`` holds id, person_id, at, sentiment.
    """
    window = seen.filter((F.col("at") >= as_of - F.make_dt_interval(F.lit(days))) & F.col("sentiment").isNotNull())
    rows = window.select("id", "person_id", "at", "sentiment").join(
        works_for.select(F.col("src").alias("person_id"), F.col("dst").alias("org_id")), "person_id")
    order = Window.partitionBy("org_id").orderBy(F.desc("at"), "id", "person_id")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= last)


def sentiment_drop(seen: DataFrame, works_for: DataFrame, orgs: DataFrame, as_of: Column,
                   days: int = model.ALERT_WINDOW_DAYS, last: int = 3) -> DataFrame:
    """Organisations whose newest sentiments are all negative."""
    moods = recent_moods(seen, works_for, as_of, days, last)
    low = moods.groupBy("org_id").agg(F.count("*").alias("n"), F.every(F.col("sentiment") == "negative").alias("low")) \
        .filter((F.col("n") == last) & F.col("low"))
    return low.join(orgs.select(F.col("id").alias("org_id"), F.col("name").alias("org_name")), "org_id") \
        .select("org_id", "org_name")


def alert_condition(types: Sequence[str] | None = None, statuses: Sequence[str] | None = None,
                    owners: dict[str, str] | None = None) -> Column:
    """Conjunction of the filters that are set; ``owners`` maps an id column to its value."""
    cond = F.lit(True)
    if types:
        cond = cond & F.col("type").isin(*types)
    if statuses:
        cond = cond & F.col("status").isin(*statuses)
    for column, value in (owners or {}).items():
        cond = cond & (F.col(column) == value)
    return cond


def page_of(rows: DataFrame, order: Sequence[Column], page: int = 1, size: int = 20) -> DataFrame:
    """One page in the given order, with the position, the total and the number of pages beside every row.

    The order is cut into range chunks, written once.  Their counts (one row for each chunk) tell the total and which chunk holds the page; only
    that one is read and sorted, so a late page costs no more than an early one.  The order must leave no ties.
    """
    size = min(max(size, 1), 200)
    skip = max(page - 1, 0) * size
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunked = cut_lineage(rows.repartitionByRange(width, *order).withColumn("__chunk", F.spark_partition_id()))
    counts = sorted((r["__chunk"], r["n"]) for r in chunked.groupBy("__chunk").agg(F.count("*").alias("n")).collect())
    held, before, total = [], 0, sum(n for _, n in counts)
    for chunk, n in counts:
        if before + n > skip and before < skip + size:
            held.append((chunk, before))
        before += n
    first = held[0][1] if held else 0
    found = chunked.filter(F.col("__chunk").isin([chunk for chunk, _ in held])).drop("__chunk").orderBy(*order).offset(skip - first).limit(size) if held else chunked.drop("__chunk").limit(0)
    return (found.withColumn("position", F.row_number().over(Window.orderBy(*order)) + skip)  # a page of rows
            .withColumn("total", F.lit(total).cast("bigint"))
            .withColumn("total_pages", F.lit(math.ceil(total / size)).cast("bigint")))


def alert_page(alerts: DataFrame, types: Sequence[str] | None = None, statuses: Sequence[str] | None = None,
               page: int = 1, size: int = 20) -> DataFrame:
    """One page of the alerts that pass the filters, last updated (or else detected) first, with the total beside every row."""
    moment = F.coalesce("last_updated_at", "first_detected_at") if "last_updated_at" in alerts.columns else F.col("first_detected_at")
    return page_of(alerts.filter(alert_condition(types, statuses)), (moment.desc_nulls_last(), F.col("id").asc()), page, size)


def incidents(interactions: DataFrame, commitments: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (kind, item, entity, entity_label, ...) of everything that touches an interaction or a commitment.

    The general form, for nodes and edges kept apart; a source whose rows hold both should build the rows directly.
    """
    items = {"Interaction": interactions.select(F.col("id").alias("item"), "at", "sentiment_score"),
             "Commitment": commitments.select(F.col("id").alias("item"), "due_date", "status")}
    out = None
    for kind, frame in items.items():
        there = edges.filter(F.col("src_label") == kind).select(F.col("src").alias("item"), F.col("dst").alias("entity"), F.col("dst_label").alias("entity_label"))
        back = edges.filter(F.col("dst_label") == kind).select(F.col("dst").alias("item"), F.col("src").alias("entity"), F.col("src_label").alias("entity_label"))
        rows = there.unionByName(back).distinct().join(frame, "item").withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def collect_targets(rows: DataFrame, as_of: Column, days: int = model.ALERT_WINDOW_DAYS, limit: int | None = None) -> DataFrame:
    """Incident rows of recent interactions and all commitments, for stakeholders and projects only.

    ``limit`` takes the newest items first, nulls before all, and is off unless asked for.
    """
    interaction = F.col("kind") == "Interaction"
    kept = rows.filter(~interaction | F.col("at").isNull() | (F.col("at") >= as_of - F.make_dt_interval(F.lit(days))))
    if limit is not None:
        newest = kept.filter(interaction).select("item", "at").distinct().orderBy(F.desc_nulls_first("at"), "item").limit(limit)
        first = kept.filter(~interaction).select("item").distinct().orderBy("item").limit(limit)
        kept = kept.join(newest.select("item").unionByName(first), "item", "left_semi")
    labels = [n for n in model.NODE_TYPES if any(k in n.lower() for k in model.STAKEHOLDER_KEYWORDS + ("project",))]
    stakeholders = model.keyword_matches(labels, model.STAKEHOLDER_KEYWORDS)
    return kept.filter(F.col("entity_label").isin(*labels)).withColumn(
        "category", F.when(F.col("entity_label").isin(*stakeholders), "stakeholder").otherwise("project"))


def entity_scores(targets: DataFrame, as_of: Column) -> DataFrame:
    """Streak, counts and path features of each entity.

    Everything but the streak is one partial aggregate; the streak is taken by chunks of the
    timeline, so an entity with a large share of the interactions is split between tasks.
    """
    is_interaction = F.col("kind") == "Interaction"
    mood = F.when(is_interaction, F.col("sentiment_score"))
    when = F.struct(F.coalesce("at", F.lit("0001-01-01").cast("timestamp")).alias("at"), "item")
    due = F.col("due_date").cast("timestamp")
    excluded = F.coalesce(F.lower("status").isin(*model.OVERDUE_EXCLUDED_STATUSES), F.lit(False))
    seen = F.when(is_interaction, F.coalesce(F.col("at"), as_of)).otherwise(F.coalesce(due, as_of))
    n, n_mood = F.count("*"), F.count(mood)
    rolled = targets.groupBy("entity", "category").agg(
        F.count_if(is_interaction).alias("interaction_count"),
        F.count_if(~is_interaction).alias("commitment_count"),
        F.count_if(~is_interaction & ~excluded & (due < as_of)).alias("overdue_commitments"),
        n.cast("double").alias("path_length"),
        F.avg(recency(as_of, seen)).alias("recency"),
        F.when(n_mood >= 2, (F.min_by(mood, F.when(mood.isNotNull(), when)) - F.max_by(mood, F.when(mood.isNotNull(), when)))
               / (n_mood - 1)).otherwise(0.0).alias("sentiment_slope"),
        F.coalesce(F.max(F.when(~is_interaction, age_days(as_of, due))), F.lit(0.0)).alias("commitment_age"))
    moods = targets.filter(is_interaction & F.col("sentiment_score").isNotNull())
    streaks = longest_runs(moods, "entity", [F.desc("at"), F.asc("item")], F.col("sentiment_score") < 0)
    joined = rolled.join(streaks.withColumnRenamed("longest_run", "negative_streak"), "entity", "left") \
        .na.fill({"negative_streak": 0})
    return (joined.withColumn("influence_score", F.least(F.lit(1.0), F.col("interaction_count") / 10.0))
            .withColumn("features", F.create_map(
                F.lit("negative_sentiment_streak"), F.col("negative_streak").cast("double"),
                F.lit("interaction_count"), F.col("interaction_count").cast("double"),
                F.lit("overdue_commitments"), F.col("overdue_commitments").cast("double")))
            .withColumn("path_features", F.create_map(
                F.lit("path_length"), F.col("path_length"), F.lit("recency"), F.col("recency"),
                F.lit("sentiment_slope"), F.col("sentiment_slope"), F.lit("commitment_age"), F.col("commitment_age"),
                F.lit("influence_centrality"), F.lit(0.0),
                F.lit("edge_type::interaction"), F.col("interaction_count") / F.col("path_length"),
                F.lit("edge_type::commitment"), F.col("commitment_count") / F.col("path_length"))))


def raise_alerts(scored: DataFrame, minimum: float = model.MIN_MODEL_SCORE, strict: bool = False,
                 min_negative: int = 3) -> DataFrame:
    """Alerts of every entity at or above the limit: one of each type.

    ``strict`` also asks for an overdue commitment or a long enough streak respectively.
    """
    types = F.array(F.lit("unresolved_commitment"), F.lit("sentiment_drop"))
    rows = scored.filter(F.col("score") >= minimum).withColumn("type", F.explode(types))
    if strict:
        rows = rows.filter(F.when(F.col("type") == "sentiment_drop", F.col("negative_streak") >= min_negative)
                           .otherwise(F.col("overdue_commitments") > 0))
    return (rows.withColumn("id", ids.alert_id(F.concat(F.lit("learned_"), F.col("type")), F.col("entity")))
            .withColumn("status", F.lit("open")).withColumn("rule_id", F.lit("learned_path_score"))
            .withColumn("summary", F.format_string("Model scored path risk at %.2f", rounded(F.col("score"), 2))))


def merge_alerts(existing: DataFrame, fresh: DataFrame, as_of: Column) -> DataFrame:
    """Upsert by alert id; an alert that exists keeps its status, outcome and creation time."""
    old = existing.select("id", F.col("entity").alias("o_entity"), F.col("type").alias("o_type"),
                          F.col("status").alias("o_status"), F.col("outcome").alias("o_outcome"),
                          F.col("score").alias("o_score"), F.col("created_at").alias("o_created_at"),
                          F.col("updated_at").alias("o_updated_at"))
    new = fresh.select("id", "entity", "type", "status", "score")
    both = old.join(new, "id", "full")
    return both.select(
        "id", F.coalesce("entity", "o_entity").alias("entity"), F.coalesce("type", "o_type").alias("type"),
        F.coalesce("o_status", "status").alias("status"), F.col("o_outcome").alias("outcome"),
        F.coalesce("score", "o_score").alias("score"), F.coalesce("o_created_at", as_of).alias("created_at"),
        F.when(F.col("entity").isNotNull(), as_of).otherwise(F.col("o_updated_at")).alias("updated_at"))


def alert_links(alerts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from alerts to the entities that exist; the alert itself stays either way."""
    known = nodes.select(F.col("id").alias("entity"))
    return alerts.join(known, "entity", "left_semi").select(
        F.col("id").alias("src"), F.lit("ASSOCIATED_WITH").alias("rel"), F.col("entity").alias("dst"))


def labelled_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts usable for training: a mapped outcome and stored features."""
    label = pol.outcome_label(F.col("outcome"))
    return alerts.withColumn("outcome", F.when(F.lower(strip(F.col("outcome"))).isin(*model.OUTCOMES), F.lower(strip(F.col("outcome"))))
                             .otherwise(label)).filter(F.col("outcome").isNotNull() & F.col("features").isNotNull())
