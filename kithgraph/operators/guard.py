"""Ontology guard: rules a bundle must meet before it is committed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(interaction_id, code, node_id) of every broken rule.

    Nodes: interaction_id, label, id, status, concept_id, concept_kind; links are the INSTANCE_OF
    edges of the bundle: interaction_id, src, dst.
    """
    key = ["interaction_id"]
    bad_status = nodes.filter((F.col("label") == "Concept") & ~F.coalesce(F.col("status").isin("proposed", "canonical"), F.lit(False))) \
        .select(*key, F.lit("INVALID_CONCEPT_STATUS").alias("code"), F.col("id").alias("node_id"))
    particulars = nodes.filter(F.col("label") == "Particular")
    unlinked = particulars.filter(F.coalesce("concept_id", F.lit("")) == "").join(
        links.select(*key, F.col("src").alias("id")).distinct(), key + ["id"], "left_anti")
    orphan = unlinked.select(*key, F.explode(F.array(F.lit("PARTICULAR_MISSING_INSTANCE_OF"), F.lit("ORPHAN_PARTICULAR"))).alias("code"),
                             F.col("id").alias("node_id"))
    forms = particulars.filter((F.coalesce("concept_id", F.lit("")) != "") & (F.col("concept_kind") == "Form")).join(
        nodes.select(*key, F.col("id").alias("concept_id")).distinct(), key + ["concept_id"], "left_anti") \
        .select(*key, F.lit("AUTOMATIC_FORM_CREATION_FORBIDDEN").alias("code"), F.col("id").alias("node_id"))
    return bad_status.unionByName(orphan).unionByName(forms)


def committable(bundles: DataFrame, broken: DataFrame) -> DataFrame:
    """Bundles without any violation."""
    return bundles.join(broken.select("interaction_id").distinct(), "interaction_id", "left_anti")
