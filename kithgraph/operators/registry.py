"""Observed schema: types, their properties and their use; normalisation of loosely typed entries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph import model
from kithgraph.functions.text import non_empty, rel_key, strip

STALE_DAYS = 180
SUCCESS_FLOOR = 0.2


def resolve_labels(asked: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """Requested type to known label: case-insensitive, then letters and digits only; unknown stays null."""
    rows = [(label.lower(), "".join(ch for ch in label.lower() if ch.isalnum()), label) for label in labels]
    known = model.rule_table(asked.sparkSession, rows, "low string, plain string, label string")
    requested = strip(F.col(column))
    keyed = asked.select(requested.alias("requested")).filter(F.col("requested") != "").withColumn(
        "plain", F.regexp_replace(F.lower("requested"), r"[^\p{L}\p{N}]", ""))
    direct = known.select("low", F.col("label").alias("direct"))
    loose = known.select("plain", F.col("label").alias("loose"))
    return (keyed.join(direct, F.lower("requested") == F.col("low"), "left").join(loose, "plain", "left")
            .select("requested", F.coalesce("direct", "loose").alias("label")))


def id_property_values(rows: DataFrame, keyword: str) -> DataFrame:
    """(id, value) of every property whose name says it holds an id of this kind."""
    cells = rows.select("id", F.explode("props").alias("key", "value"))
    low = F.lower("key")
    return cells.filter(low.contains(keyword) & low.contains("id") & F.col("value").isNotNull()).select("id", "value").distinct()


def coerce_mentions(rows: DataFrame, column: str) -> DataFrame:
    """A plain text becomes a new mention of that name; a JSON object keeps its fields."""
    parsed = F.when(F.col(column).startswith("{"), F.from_json(column, "temp_id string, name string, is_new boolean"))
    return (rows.withColumn("__m", parsed)
            .withColumn("temp_id", F.when(F.col("__m").isNull(), F.col(column)).otherwise(F.col("__m.temp_id")))
            .withColumn("name", F.when(F.col("__m").isNull(), F.col(column)).otherwise(F.col("__m.name")))
            .withColumn("is_new", F.when(F.col("__m").isNull(), F.lit(True)).otherwise(F.col("__m.is_new"))).drop("__m"))


def normalise_entities(rows: DataFrame) -> DataFrame:
    """Entries with an id (own, else name, else text), a name, and the commitment owner under one key."""
    out = rows.withColumn("id", F.coalesce(non_empty("id"), non_empty("name"), non_empty("text"))).filter(F.col("id").isNotNull())
    return (out.withColumn("name", F.coalesce("name", "title", "text", "id"))
            .withColumn("owner_id", F.when((F.col("label") == "Commitment") & F.col("owner_id").isNull(), F.col("person_id"))
                        .otherwise(F.col("owner_id"))))


def canonical_relationships(rows: DataFrame, column: str, aliases: Mapping[str, str],
                            known: Sequence[str] = model.RELATIONSHIP_TYPES) -> DataFrame:
    """Canonical spelling of a relationship type and whether the type is known."""
    table = [(k, k) for k in known] + [(a, b) for a, b in aliases.items()]
    lookup = model.rule_table(rows.sparkSession, table, "__key string, __canonical string")
    keyed = rows.withColumn("__key", rel_key(F.col(column)))
    return (keyed.join(lookup, "__key", "left").withColumn("known", F.col("__canonical").isNotNull())
            .withColumn(column, F.coalesce("__canonical", "__key")).drop("__key", "__canonical"))


def observe(rows: DataFrame) -> DataFrame:
    """Usage per type from (label, used_at, keys) rows.

    Counting and collecting property names are separate partial aggregates, so a type that most
    rows share is reduced on the map side; only its distinct property names are gathered.
    """
    counts = rows.groupBy("label").agg(F.count("*").alias("usage_count"), F.to_date(F.max("used_at")).alias("last_used"))
    names = (rows.select("label", F.explode("keys").alias("key")).distinct()
             .groupBy("label").agg(F.array_sort(F.collect_list("key")).alias("properties")))
    return counts.join(names, "label", "left")


def merge_registry(prior: DataFrame, observed: DataFrame, version: int, success: DataFrame | None = None) -> DataFrame:
    """Prior registry plus an observation; a new type gets the version it first appears in."""
    old = prior.select("label", F.col("properties").alias("old_props"), F.col("usage_count").alias("old_count"),
                       "introduced_in_version", "deprecated")
    both = old.join(observed, "label", "full")
    empty = F.array().cast("array<string>")
    merged = both.select(
        "label", F.array_sort(F.array_union(F.coalesce("old_props", empty), F.coalesce("properties", empty))).alias("properties"),
        (F.coalesce("old_count", F.lit(0)) + F.coalesce("usage_count", F.lit(0))).alias("usage_count"), "last_used",
        F.coalesce("introduced_in_version", F.lit(version)).alias("introduced_in_version"),
        F.coalesce("deprecated", F.lit(False)).alias("deprecated"))
    if success is None:
        return merged
    return merged.join(success, "label", "left").withColumn(
        "deprecated", F.col("deprecated") | F.coalesce(F.col("success_score") < SUCCESS_FLOOR, F.lit(False)))


def stale(registry: DataFrame, as_of: Column, min_usage: int = 1, days: int = STALE_DAYS) -> DataFrame:
    """Sweep: rarely used types not seen for a while."""
    old = (F.col("usage_count") <= min_usage) & (F.date_add("last_used", days) < as_of)
    return registry.withColumn("stale", F.coalesce(old, F.lit(False)))
