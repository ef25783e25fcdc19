"""Concept assignment and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithgraph import model
from kithgraph.functions.similarity import ratio
from kithgraph.functions.text import attribute_id, non_empty, normalise_text, salient_phrases
from kithgraph.functions.vectors import clamped_cosine, token_embedding, unit

SET = model.ASSIGNMENT


def prepared(concepts: DataFrame) -> DataFrame:
    """Concepts with their embedding and normalised names."""
    for name, kind in (("aliases", "array<string>"), ("disallowed_attributes", "array<string>"), ("embedding", "array<double>"),
                       ("description", "string"), ("applies_to", "array<string>")):
        if name not in concepts.columns:
            concepts = concepts.withColumn(name, F.lit(None).cast(kind))
    basis = F.concat_ws("\n", non_empty("id"), non_empty("name"), non_empty("description"), non_empty(F.array_join("aliases", " ")))
    own = F.when(F.size(F.coalesce("embedding", F.array().cast("array<double>"))) > 0, unit(F.col("embedding")))
    empty = F.array().cast("array<string>")

    def norm(c: str) -> Column:
        return F.filter(F.transform(F.coalesce(c, empty), normalise_text), lambda v: v.isNotNull())

    return concepts.select(
        "concept_key", F.col("id").alias("concept_id"), F.col("name").alias("concept_name"),
        F.coalesce(own, token_embedding(basis, SET["dimensions"])).alias("concept_vector"), norm("aliases").alias("aliases"),
        norm("applies_to").alias("applies_to"), norm("disallowed_attributes").alias("disallowed"))


def lexical_score(value: Column, concept_id: Column, concept_name: Column, aliases: Column) -> Column:
    """1 for an exact id, name or alias, else the similarity to the name."""
    v, name = normalise_text(value), normalise_text(concept_name)
    exact = (v == normalise_text(concept_id)) | (v == name) | F.array_contains(aliases, v)
    return F.when(F.coalesce(exact, F.lit(False)), 1.0).when(v.isNull() | name.isNull(), 0.0).otherwise(ratio(v, name))


def structural_score(entity_type: Column, applies_to: Column) -> Column:
    kind = normalise_text(entity_type)
    return F.when((F.size(applies_to) == 0) | kind.isNull(), 0.5).when(F.array_contains(applies_to, kind), 1.0).otherwise(0.0)


def hint_values(hints: DataFrame) -> DataFrame:
    """Distinct (concept_key, value, entity_type) with a value embedding; equal hints are scored once."""
    if "embedding" not in hints.columns:
        hints = hints.withColumn("embedding", F.lit(None).cast("array<double>"))
    rows = hints.filter(F.coalesce("value", F.lit("")) != "").select("concept_key", "value", "entity_type", "embedding").distinct()
    own = F.when(F.size(F.coalesce("embedding", F.array().cast("array<double>"))) > 0, unit(F.col("embedding")))
    return rows.withColumn("value_vector", F.coalesce(own, token_embedding(F.col("value"), SET["dimensions"])))


def scored(hints: DataFrame, concepts: DataFrame) -> DataFrame:
    """Score parts of each distinct hint against the concepts of its key (an equi-join on the key)."""
    rows = hint_values(hints).join(prepared(concepts), "concept_key")
    parts = rows.withColumns({
        "cosine": clamped_cosine(F.col("value_vector"), F.col("concept_vector")),
        "structural": structural_score(F.col("entity_type"), F.col("applies_to")),
        "lexical": lexical_score(F.col("value"), F.col("concept_id"), F.col("concept_name"), F.col("aliases"))})
    total = SET["embedding_weight"] * F.col("cosine") + SET["structural_weight"] * F.col("structural") + SET["lexical_weight"] * F.col("lexical")
    return parts.withColumn("score", total).drop("value_vector", "concept_vector", "aliases", "applies_to")


def assign(hints: DataFrame, concepts: DataFrame) -> DataFrame:
    """One assignment per distinct hint: status, chosen concept, candidates, modifiers and anomalies."""
    key = ["concept_key", "value", "entity_type", "embedding"]
    order = Window.partitionBy(*key).orderBy(F.desc(F.round("score", 9)), "concept_id")
    top = scored(hints, concepts).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= SET["candidate_limit"])
    rows = top.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(
        "position", "concept_id", "concept_name", "score", "cosine", "disallowed"))).alias("candidates"))
    best, runner_up = F.get("candidates", 0), F.get("candidates", 1)
    status = (F.when((best["cosine"] < SET["embedding_similarity_threshold"]) | (best["score"] < SET["decision_threshold"]), "unmatched")
              .when(F.coalesce(best["score"] - runner_up["score"] <= SET["ambiguity_gap"], F.lit(False)), "ambiguous").otherwise("matched"))
    rows = rows.withColumns({"status": status, "score": best["score"], "modifiers": salient_phrases(F.col("value"))})
    rows = rows.withColumn("canonical_id", F.when(F.col("status") == "matched", best["concept_id"]))
    return rows.withColumn("anomalies", anomalies(F.col("value"), F.col("modifiers"), best["disallowed"]))


def anomalies(value: Column, modifiers: Column, disallowed: Column) -> Column:
    """A modifier the concept forbids is an identity conflict, any other longer one a variation."""
    kinds = F.transform(modifiers, lambda m: F.struct(
        m.alias("attribute"), F.when(F.array_contains(disallowed, normalise_text(m)), "identity_conflict")
        .when(F.length(m) > 2, "modifier_variation").alias("contradiction_type")))
    return F.filter(kinds, lambda k: k["contradiction_type"].isNotNull())


def hint_column(*preferred: Column) -> Column:
    """First filled hint in order of precedence."""
    return F.coalesce(*[non_empty(c) for c in preferred])


def apply_to_entities(entities: DataFrame, concepts: DataFrame) -> DataFrame:
    """Entities (entity_id, concept_key, value, entity_type) with their assignment.

    The assignment table has one row per distinct hint, so a hint shared by most entities is still one
    row on that side.
    """
    rows = entities if "embedding" in entities.columns else entities.withColumn("embedding", F.lit(None).cast("array<double>"))
    done = assign(rows, concepts)
    a, b = rows.alias("a"), done.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("entity_type", "embedding")]
    return a.join(b, [F.col("a.concept_key") == F.col("b.concept_key"), F.col("a.value") == F.col("b.value"), *same]).select(
        "a.entity_id", "a.concept_key", "a.value", "b.status", "b.canonical_id", "b.score", "b.modifiers", "b.anomalies")


def alignment_edges(applied: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """HAS_ATTRIBUTE edges, DIALECTICAL_TENSION edges and the unresolved particulars."""
    attributes = applied.select("entity_id", F.explode("modifiers").alias("attribute")).select(
        F.col("entity_id").alias("src"), F.lit("HAS_ATTRIBUTE").alias("rel"), attribute_id(F.col("attribute")).alias("dst"), "attribute")
    tensions = applied.select("entity_id", "canonical_id", F.explode("anomalies").alias("x")).select(
        F.col("entity_id").alias("src"), F.lit("DIALECTICAL_TENSION").alias("rel"), F.coalesce("canonical_id", "entity_id").alias("dst"),
        F.col("x.attribute").alias("attribute"), F.col("x.contradiction_type").alias("contradiction_type"))
    open_ = applied.filter(F.col("canonical_id").isNull()).select("entity_id", "concept_key", "status")
    return attributes, tensions, open_
