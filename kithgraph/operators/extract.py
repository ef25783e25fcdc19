"""Text extraction and preview building as table jobs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph import model
from kithgraph.functions.text import (collection_label, concept_kind, first_words, is_concept_collection,
                                      regex_quote, slug, summary)


def raw_inputs(rows: DataFrame, received_at: Column) -> DataFrame:
    """Raw inputs with the missing meta filled in."""
    return rows.select(
        "interaction_id", F.coalesce("interaction_type", F.lit("interaction")).alias("interaction_type"),
        F.coalesce("interaction_at", received_at).alias("interaction_at"), "source_uri",
        F.coalesce("source_type", F.lit("text")).alias("source_type"), F.coalesce("raw_text", "text").alias("text"))


def _all(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    flags = "(?iU)" if ignore_case else "(?U)"
    group = 1 if "(" in re.sub(r"\\.|\(\?:", "", pattern) else 0
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group))


def persons(text: Column) -> Column:
    return _all(text, model.PERSON_PATTERN)


def orgs(text: Column) -> Column:
    return _all(text, model.ORG_PATTERN)


def commitments(text: Column, lexicon: tuple[tuple[str, bool], ...] = model.OBLIGATION_PATTERNS) -> Column:
    """Obligation phrases of every lexicon pattern, in pattern order, duplicates kept."""
    return F.concat(*[_all(text, p.replace("\\ ", " ").replace("\\-", "-"), ci) for p, ci in lexicon])


def extraction_record(docs: DataFrame) -> DataFrame:
    """One extraction record per text.  All row-local."""
    return docs.withColumn("entities", F.struct(
        persons(F.col("text")).alias("persons"), orgs(F.col("text")).alias("orgs"),
        commitments(F.col("text")).alias("commitments"))).withColumn("sentiment", F.lit(0.0)) \
        .withColumn("summary", summary(F.col("text"))).withColumn("headline", first_words(F.col("text"), 10))


def mentions(records: DataFrame) -> DataFrame:
    """One row per mention: its collection and label, and a new mention's fields."""
    kinds = F.array(*[F.struct(F.lit(k).alias("collection"), F.col(f"entities.{k}").alias("names"))
                      for k in ("persons", "orgs", "commitments")])
    cells = records.select("id", F.explode(kinds).alias("k")).select("id", "k.collection", F.posexplode("k.names").alias("pos", "name"))
    return cells.withColumn("label", collection_label(F.col("collection"))).withColumn("temp_id", F.col("name")) \
        .withColumn("is_new", F.lit(True))


def previews(records: DataFrame) -> DataFrame:
    """Preview per text.  Mentions of one text are already in its row, so nothing is gathered."""
    def entries(kind: str) -> Column:
        return F.transform(F.col(f"entities.{kind}"), lambda n: F.struct(
            n.alias("temp_id"), n.alias("name"), F.lit(True).alias("is_new")))

    return records.select(
        F.col("id").alias("interaction_id"), "summary", F.map_from_arrays(
            F.array(*[F.lit(k) for k in ("persons", "orgs", "commitments")]),
            F.array(*[entries(k) for k in ("persons", "orgs", "commitments")])).alias("entities"),
        F.array().cast("array<struct<src:string,dst:string,rel:string>>").alias("relationships"), F.lit(True).alias("ready"))


def property_relationships(nodes: DataFrame) -> DataFrame:
    """Edges derived from id properties; a list value fans out."""
    rules = model.relationship_rules(nodes.sparkSession)
    cells = nodes.select("label", "id", "source_uri", F.explode("props").alias("prop", "value")).join(rules, "prop") \
        .filter(F.array_contains("source_labels", F.col("label")))
    targets = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    return cells.select(F.col("label").alias("src_label"), F.col("id").alias("src"), "rel", F.col("target_label").alias("dst_label"),
                        F.explode(targets).alias("dst"), "source_uri").filter(F.col("dst").isNotNull())


def bundle_nodes(entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, derived concept nodes and INSTANCE_OF edges of entity rows.

    Rows: interaction_id, collection, id, props, source_uri.  A derived concept node appears once
    per interaction and is proposed, so that the ontology guard lets it pass.
    """
    is_concept = is_concept_collection(F.col("collection"))
    concept = F.coalesce(*[F.nullif(F.element_at("props", k), F.lit("")) for k in ("concept_id", "concept", "type", "category")])
    nodes = entities.select(
        "interaction_id", collection_label(F.col("collection")).alias("label"), "id",
        F.map_filter("props", lambda k, v: k != "concept_id").alias("props"), "source_uri",
        F.when(~is_concept, concept).alias("concept_id"),
        F.when(is_concept, F.coalesce(F.element_at("props", "kind"), concept_kind(F.col("collection")))).alias("concept_kind"))
    linked = nodes.filter(F.col("concept_id").isNotNull())
    derived = linked.groupBy("interaction_id", F.col("concept_id").alias("id")).agg(
        F.min("label").alias("kind"), F.min("source_uri").alias("source_uri")).withColumn("status", F.lit("proposed"))
    links = linked.select("interaction_id", F.col("label").alias("src_label"), F.col("id").alias("src"), F.lit("INSTANCE_OF").alias("rel"),
                          F.lit("Concept").alias("dst_label"), F.col("concept_id").alias("dst"), "source_uri")
    return nodes, derived, links


def learning_candidates(mentions_: DataFrame) -> DataFrame:
    """What an extraction can teach: one distinct row per list and value."""
    kind, name = F.col("collection"), F.col("name")
    target = F.when(kind == "commitments", "obligation_phrases").when(kind == "roles", "stakeholder_types") \
        .when(kind == "risks", "risk_categories").when(kind == "relationships", "relationship_types")
    prefix = F.when(kind == "roles", "st_").when(kind == "risks", "rc_")
    entry = F.when(kind == "commitments", regex_quote(name)).when(prefix.isNotNull(), F.concat(prefix, slug(name))).otherwise(name)
    return mentions_.select(target.alias("list"), entry.alias("entry"), name.alias("value")).filter(F.col("list").isNotNull()) \
        .groupBy("list", "entry").agg(F.min("value").alias("value"))


def learning_signals(signals: DataFrame) -> DataFrame:
    """Route learning signals: lexicon patterns, sentiment overrides and schema suggestions feed their own
    lists; every signal is queued as well."""
    kind = F.col("signal_type")
    applied = F.when(kind == "lexicon_patterns", "lexicon_updates").when(kind == "sentiment_overrides", "sentiment_updates") \
        .when(kind == "schema_suggestions", "schema_updates")
    queued = F.when(kind == "lexicon_patterns", "lexicon_pattern").when(kind == "sentiment_overrides", "sentiment_override") \
        .when(kind == "schema_suggestions", "schema_node_type").otherwise(kind)
    rows = signals.select(F.explode(F.filter(F.array(
        F.struct(applied.alias("target"), F.lit("applied").alias("status"), "payload"),
        F.struct(queued.alias("target"), F.lit("pending").alias("status"), "payload")), lambda s: s["target"].isNotNull())).alias("s"))
    return rows.select("s.*").distinct()


