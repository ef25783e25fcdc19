"""Merges and sinks.

Parquet cannot merge in place, so every merge is a plan from the old snapshot and the updates to
the new snapshot; the caller writes it to a new version folder and never over what is being read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph import model
from kithgraph.functions.text import plural_label
from kithgraph.functions.values import clean_props
from kithgraph.operators import policy as pol
from kithgraph.operators.numbering import global_positions
from kithgraph.session import scratch_path

META = ("source_uri", "created_at", "updated_at", "first_seen_at", "last_seen_at", "created_by", "updated_by")
NODE_KEY = ("label", "id")
EDGE_KEY = ("src_label", "src", "rel", "dst_label", "dst")


def empty_items(spark: SparkSession, keys: Sequence[str]) -> DataFrame:
    cols = ", ".join(f"{k} string" for k in keys)
    return spark.createDataFrame([], f"{cols}, props map<string,string>, source_uri string, created_at timestamp, "
                                     "updated_at timestamp, first_seen_at timestamp, last_seen_at timestamp, "
                                     "created_by string, updated_by string")


def without_source(updates: DataFrame) -> DataFrame:
    """Updates that must be rejected: they say nothing about where they come from."""
    return updates.filter(F.coalesce("source_uri", F.lit("")) == "")


def merge_items(existing: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Property-level merge by key.

    Later updates win per property, a null never overwrites, first-seen fields keep the oldest
    value.  All of it is partial aggregation, so an item updated millions of times is reduced on
    the map side; only the distinct property names of an item meet in one row.
    """
    keys = list(keys)
    base = existing.select(*keys, "props", "source_uri", F.col("created_at").alias("c"), F.col("updated_at").alias("u"),
                           F.col("created_by").alias("cb"), F.col("updated_by").alias("ub"),
                           F.struct(F.lit(0).alias("gen"), F.coalesce("updated_at", F.lit(0).cast("timestamp")).alias("ts"),
                                    F.lit(0).cast("bigint").alias("seq")).alias("ord"))
    new = updates.filter(F.coalesce("source_uri", F.lit("")) != "").select(
        *keys, clean_props(F.col("props")).alias("props"), "source_uri", F.col("ts").alias("c"), F.col("ts").alias("u"),
        F.col("user").alias("cb"), F.col("user").alias("ub"),
        F.struct(F.lit(1).alias("gen"), F.col("ts").alias("ts"), F.col("seq").cast("bigint").alias("seq")).alias("ord"))
    rows = base.unionByName(new)

    def first(c: str) -> Column:
        return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ord")))

    def last(c: str) -> Column:
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ord")))

    meta = rows.groupBy(*keys).agg(
        first("source_uri").alias("source_uri"), first("c").alias("created_at"), last("u").alias("updated_at"),
        first("c").alias("first_seen_at"), last("u").alias("last_seen_at"), first("cb").alias("created_by"),
        last("ub").alias("updated_by"))
    cells = rows.select(*keys, "ord", F.explode("props").alias("k", "v")).filter(F.col("v").isNotNull())
    props = (cells.groupBy(*keys, "k").agg(F.max_by("v", "ord").alias("v"))
             .groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("props")))
    return meta.join(props, keys, "left").select(
        *keys, F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"), *META)


def upsert_nodes(existing: DataFrame, updates: DataFrame) -> DataFrame:
    return merge_items(existing, updates, NODE_KEY)


def resolve_endpoints(updates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Keep edges whose two ends exist; an end without a label matches every node with that id."""
    known = nodes.select("label", "id").distinct()
    src = known.select(F.col("label").alias("s_label"), F.col("id").alias("src"))
    dst = known.select(F.col("label").alias("d_label"), F.col("id").alias("dst"))
    both = (updates.join(src, "src").filter(F.col("src_label").isNull() | (F.col("src_label") == F.col("s_label")))
            .join(dst, "dst").filter(F.col("dst_label").isNull() | (F.col("dst_label") == F.col("d_label"))))
    return both.withColumn("src_label", F.col("s_label")).withColumn("dst_label", F.col("d_label")).drop("s_label", "d_label")


def upsert_edges(existing: DataFrame, updates: DataFrame, nodes: DataFrame) -> DataFrame:
    return merge_items(existing, resolve_endpoints(updates, nodes), EDGE_KEY)


def with_default_source(updates: DataFrame) -> DataFrame:
    return updates.withColumn("source_uri", F.coalesce("source_uri", F.concat(F.lit("interaction://"), "interaction_id")))


def commit_bundles(nodes: DataFrame, edges: DataFrame, node_updates: DataFrame, edge_updates: DataFrame,
                   lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Commit bundles: nodes, then relationships, then dialectical lines.

    Returns the new node and edge snapshots and the committed counts per interaction and kind.
    """
    node_updates, edge_updates, lines = (with_default_source(d) for d in (node_updates, edge_updates, lines))
    new_nodes = upsert_nodes(nodes, node_updates)
    new_edges = upsert_edges(edges, edge_updates.unionByName(lines), new_nodes)
    counts = None
    for kind, part in (("nodes", node_updates), ("relationships", edge_updates), ("dialectical_lines", lines)):
        rows = part.groupBy("interaction_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        counts = rows if counts is None else counts.unionByName(rows)
    return new_nodes, new_edges, counts


def concept_inserts(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concept nodes and INSTANCE_OF edges implied by nodes that carry a concept id."""
    kinds = F.create_map(*[F.lit(x) for label, (kind, _) in model.NODE_TYPES.items() for x in (label, kind)])
    kind = F.coalesce("concept_kind", F.element_at(kinds, F.col("label")), F.lit("DynamicConcept"))
    linked = nodes.filter(F.coalesce("concept_id", F.lit("")) != "").withColumn("kind", kind)
    concepts = linked.groupBy(F.col("concept_id").alias("id")).agg(
        F.min("kind").alias("kind"), F.min("source_uri").alias("source_uri")) \
        .select(F.lit("Concept").alias("label"), "id", F.col("id").alias("name"), "kind", "source_uri")
    links = linked.select(F.col("label").alias("src_label"), F.col("id").alias("src"), F.lit("INSTANCE_OF").alias("rel"),
                          F.lit("Concept").alias("dst_label"), F.col("concept_id").alias("dst"), "source_uri").distinct()
    return concepts, links


def replace_hierarchy(existing: DataFrame, concepts: DataFrame) -> DataFrame:
    """PARENT_OF edges after loading concept entries: the loaded children lose their old parents."""
    parents = concepts.select(F.col("id").alias("dst"), F.explode(F.filter(
        "parents", lambda p: p.isNotNull() & (p != ""))).alias("src")).distinct()
    fresh = parents.select("src", F.lit("PARENT_OF").alias("rel"), "dst")
    kept = existing.join(parents.select("dst").distinct(), "dst", "left_anti")
    return kept.select("src", "rel", "dst").unionByName(fresh)


def current_status(log: DataFrame) -> DataFrame:
    """Latest state per interaction of an append-only status log."""
    rest = [c for c in log.columns if c != "interaction_id"]
    ordered = [c for c in ("updated_at", "seq") if c in rest]
    return log.groupBy("interaction_id").agg(F.max_by(F.struct(*rest), F.struct(*ordered)).alias("s")) \
        .select("interaction_id", "s.*")


def prune(statuses: DataFrame, as_of: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): committed and failed interactions older than the limit go."""
    old = F.coalesce(F.col("state").isin("committed", "failed")
                     & (F.col("updated_at") < as_of - F.make_dt_interval(F.lit(days))), F.lit(False))
    return statuses.filter(~old), statuses.filter(old)


def change_feed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per changed entity and relationship of a commit, with its collection.

    Rows, not lists: a collection may hold any number of entities.
    """
    entities = nodes.select(plural_label(F.col("label")).alias("collection"), F.col("id").alias("key"))
    links = edges.filter(F.col("rel") != "INSTANCE_OF").select(
        F.lit("relationships").alias("collection"), F.concat_ws("|", "src", "rel", "dst").alias("key"))
    return entities.unionByName(links)


def feed_summary(feed: DataFrame) -> DataFrame:
    return feed.groupBy("collection").agg(F.count("*").alias("n"))


def append_learned(existing: DataFrame, candidates: DataFrame, unique: Sequence[str], version: str, as_of: Column,
                   actor: str = "system") -> DataFrame:
    """Entries to append: not there yet by the unique fields (null equals null), one each, versions in order."""
    fresh = candidates.dropDuplicates(list(unique)).alias("n").join(
        existing.select(*unique).distinct().alias("e"),
        [F.col(f"n.{c}").eqNullSafe(F.col(f"e.{c}")) for c in unique], "left_anti")
    numbered = global_positions(fresh, [F.col(c).asc_nulls_first() for c in unique], "__n")
    major, minor, patch = version.split(".")
    return (numbered.withColumn("added_in_version", F.concat(F.lit(f"{major}.{minor}."), (F.col("__n") + int(patch)).cast("string")))
            .withColumn("added_by", F.lit(actor)).withColumn("added_on", as_of).drop("__n"))


def append_samples(spark: SparkSession, rows: DataFrame, path: str | None = None) -> str:
    """Append labelled samples to the reinforcement log, skipping keys it already has."""
    if path is None:
        path = scratch_path(spark, "samples")
        log = spark.createDataFrame([], "sample_key string")
    else:
        log = spark.read.parquet(path)
    fresh = pol.new_samples(log, rows).select("sample_key", "alert_id", "outcome", "features", "timestamp")
    fresh.write.mode("append").parquet(path)
    return path


def append_feedback(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_feedback(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Feedback log; lines that are not valid JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files, one row each, with the file as the source."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("source_uri"))


