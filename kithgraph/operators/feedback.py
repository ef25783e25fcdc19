"""Learning from reviewed previews: structural diffs, recurring corrections, threshold steps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph import model
from kithgraph.functions.text import keyword_any, non_empty, strip
from kithgraph.functions.values import rounded
from kithgraph.session import cut_lineage


def recent(entries: DataFrame, limit: int = model.FEEDBACK_LIMIT, current: DataFrame | None = None) -> DataFrame:
    """Newest entries, with the current one appended before the limit is taken again."""
    rows = entries.orderBy(F.desc("ts"), F.desc("entry_id")).limit(limit)
    if current is not None:
        rows = rows.unionByName(current).orderBy(F.desc("ts"), F.desc("entry_id")).limit(limit)
    return rows


def corrections(entries: DataFrame) -> DataFrame:
    """One row per correction, with its text and number readings and the routes its path opens.

    One correction may feed several outputs.
    """
    rows = entries.select("entry_id", F.explode("corrections").alias("c")).select("entry_id", "c.path", "c.before", "c.after")
    path = F.coalesce("path", F.lit(""))

    def text(c: str) -> Column:
        return F.when(F.col(c).try_cast("double").isNull(), non_empty(strip(F.col(c))))

    return rows.withColumns({
        "path": path, "before_text": text("before"), "after_text": text("after"), "before_number": F.col("before").try_cast("double"),
        "after_number": F.col("after").try_cast("double"), **{f"is_{k}": keyword_any(path, words) for k, words in model.CORRECTION_ROUTES.items()}})


def correction_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.count("*").alias("n"))


def recurring_obligations(rows: DataFrame, least: int = model.FEEDBACK_THRESHOLD) -> DataFrame:
    return rows.filter(F.col("is_obligation") & F.col("after_text").isNotNull()).groupBy(F.col("after_text").alias("phrase")) \
        .agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def recurring_synonyms(rows: DataFrame, least: int = model.FEEDBACK_THRESHOLD) -> DataFrame:
    return rows.filter(F.col("is_synonym") & (F.col("before_text") != F.col("after_text"))).groupBy("before_text", "after_text", "path") \
        .agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def confidence_step(rows: DataFrame, least: int = model.FEEDBACK_THRESHOLD) -> DataFrame:
    """One row: mean change of the corrected confidences and the step it asks for, null when there are too few."""
    deltas = rows.filter(F.col("is_confidence")).select((F.col("after_number") - F.col("before_number")).alias("d")).filter(F.col("d").isNotNull())
    return deltas.agg(F.count("*").alias("n"), F.avg("d").alias("mean_delta")).withColumn(
        "step", F.when(F.col("n") >= least, F.when(F.col("mean_delta") < 0, 0.01).otherwise(-0.01)))


def stepped_thresholds(step: DataFrame, defaults: Mapping[str, float] = model.MERGE_THRESHOLDS["defaults"]) -> DataFrame:
    """Default thresholds before and after the step, held to [0, 1]."""
    table = model.rule_table(step.sparkSession, sorted(defaults.items()), "name string, before double")
    one = step.select("step").filter(F.col("step").isNotNull())  # at most one row
    return table.join(F.broadcast(one)).select("name", "before", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("before") + F.col("step"))), 4).alias("after"))


def concept_candidates(rows: DataFrame) -> DataFrame:
    value = F.coalesce("after_text", F.when(F.col("after").startswith("{"), F.col("after")))
    return rows.filter(F.col("is_concept")).select("path", value.alias("value")).filter(F.col("value").isNotNull()).distinct()


def review_items(rows: DataFrame) -> DataFrame:
    """Corrections that leave nothing behind need a person."""
    return rows.filter(F.col("after_text").isNull() & F.col("after_number").isNull()).select("path", "before", "after").distinct()


def reflect(entries: DataFrame, limit: int | None = model.FEEDBACK_LIMIT) -> DataFrame:
    """All outputs of a reflection as (output, value) rows."""
    rows = corrections(recent(entries, limit) if limit is not None else entries)
    none = F.lit(None).cast("string")
    step = stepped_thresholds(confidence_step(rows))
    parts = [
        recurring_obligations(rows).select(F.lit("lexicon_updates").alias("output"), F.col("phrase").alias("value")),
        recurring_synonyms(rows).select(F.lit("synonym_updates").alias("output"), F.concat_ws(" -> ", "before_text", "after_text").alias("value")),
        step.select(F.lit("threshold_updates").alias("output"), F.format_string("%s=%.2f", "name", rounded(F.col("after"), 2)).alias("value")),
        concept_candidates(rows).select(F.lit("concept_promotions").alias("output"), "value"),
        review_items(rows).select(F.lit("review_items").alias("output"), F.coalesce("path", none).alias("value"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def json_diff(rows: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Corrections (key, path, before, after) that turn one JSON document into another.

    Works level by level: two objects or two lists are opened and their members matched by a full outer
    join on (document, path); everything else that differs is a correction.  A member present on one
    side only is one correction with its whole value.  The loop runs as deep as the documents do.
    """
    level = rows.select(F.col(key).alias("doc"), F.lit("").alias("path"), F.col(before).alias("b"), F.col(after).alias("a"),
                        F.lit(True).alias("has_b"), F.lit(True).alias("has_a"))
    found: DataFrame | None = None
    while True:
        kind_b, kind_a = F.left(F.ltrim("b"), F.lit(1)), F.left(F.ltrim("a"), F.lit(1))
        opened = F.col("has_b") & F.col("has_a") & (kind_b == kind_a) & kind_b.isin("{", "[")
        level = cut_lineage(level.withColumn("open", F.coalesce(opened, F.lit(False))))
        leaf = level.filter(~F.col("open") & ~F.col("b").eqNullSafe(F.col("a"))).select(
            F.col("doc").alias(key), F.when(F.col("path") == "", "root").otherwise(F.col("path")).alias("path"), F.col("b").alias("before"), F.col("a").alias("after"))
        found = leaf if found is None else found.unionByName(leaf)
        deeper = level.filter("open")
        if deeper.isEmpty():
            return found
        left, right = _members(deeper, "b"), _members(deeper, "a")
        level = left.join(right, ["doc", "path"], "full").select(
            "doc", "path", "b", "a", F.coalesce("has_b", F.lit(False)).alias("has_b"), F.coalesce("has_a", F.lit(False)).alias("has_a"))


def _members(level: DataFrame, side: str) -> DataFrame:
    """Members of every open object or list on one side, each as JSON text with its path."""
    variant = F.parse_json(side)
    opened = level.select("doc", "path", variant.alias("v"))
    spark = level.sparkSession
    cells = opened.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    step = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), "pos", F.lit("]"))) \
        .otherwise(F.when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key")))
    return cells.select("doc", step.alias("path"), F.to_json("value").alias(side), F.lit(True).alias(f"has_{side}"))
