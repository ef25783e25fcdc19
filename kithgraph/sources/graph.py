"""The stakeholder graph as DataFrames over the business tables."""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.model import RESOLVED_STATUSES
from kithgraph.session import measured_broadcasts, short_lived_shuffles, sized_tasks

STATUS_OF_ORDER = {"F": "done", "O": "open", "P": "accepted"}
SENTIMENT_OF_EVENT = {"error": "negative", "view": "negative", "click": "neutral", "purchase": "positive",
                      "signup": "positive"}

# Edge types of this graph: the schema that lets a traversal read only what it can use.
EDGE_TYPES = (
    ("Person", "WORKS_FOR", "Org"), ("Org", "INSTANCE_OF", "Concept"), ("Org", "PARTY_TO", "Contract"), ("Person", "MADE", "Commitment"),
    ("Commitment", "RELATES_TO", "Project"), ("Person", "INVOLVED_IN", "Project"), ("Interaction", "MENTIONS", "Person"))
NODE_COLUMNS = ("label", "id", "name", "status", "due_date", "at", "sentiment", "sentiment_score", "influence_score",
                "concept_id", "source_uri")
EDGE_COLUMNS = ("src_label", "src", "rel", "dst_label", "dst", "seen_at")


def _mapped(c: Column, mapping: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in mapping.items():
        out = F.when(c == key, value).otherwise(out)
    return out


def prefixed(kind: str, c: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))


class Graph:
    """Lazy frames; every view is a plan over parquet scans, so filters and columns are pushed down."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # naive times are UTC
        measured_broadcasts(spark)
        sized_tasks(spark, folder)
        short_lived_shuffles(spark)

    def stored(self, name: str) -> DataFrame:
        """The table as it lies on disk; filters on its columns reach the scan."""
        return self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))

    def table(self, name: str) -> DataFrame:
        """The table with naive times read as UTC instants."""
        df = self.stored(name)
        naive = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
        return df.withColumns(naive) if naive else df

    # --- nodes by label -----------------------------------------------------------------

    @cached_property
    def persons(self) -> DataFrame:
        return self.table("customer").select(
            prefixed("person", "c_custkey").alias("id"), F.col("c_name").alias("name"),
            prefixed("org", "c_nationkey").alias("org_id"), F.col("c_mktsegment").alias("segment"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c_acctbal") / 10000.0)).alias("influence_score"))

    @cached_property
    def orgs(self) -> DataFrame:
        return self.table("nation").select(
            prefixed("org", "n_nationkey").alias("id"), F.col("n_name").alias("name"),
            prefixed("concept", "n_regionkey").alias("concept_id"))

    @cached_property
    def concepts(self) -> DataFrame:
        return self.table("region").select(
            prefixed("concept", "r_regionkey").alias("id"), F.col("r_name").alias("name"),
            F.lit("OrgCategory").alias("kind"), F.lit("canonical").alias("status"))

    @cached_property
    def projects(self) -> DataFrame:
        return self.table("part").select(
            prefixed("project", "p_partkey").alias("id"), F.col("p_name").alias("name"),
            F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))

    @cached_property
    def contracts(self) -> DataFrame:
        return self.table("supplier").select(
            prefixed("contract", "s_suppkey").alias("id"), F.col("s_name").alias("name"),
            prefixed("org", "s_nationkey").alias("org_id"), F.col("s_acctbal").alias("value"))

    @cached_property
    def commitments(self) -> DataFrame:
        return self._commitments(self.table("orders"))

    def open_commitments_before(self, day: str) -> DataFrame:
        """Commitments still open and due before a day, filtered on the stored columns."""
        settled = [k for k, v in STATUS_OF_ORDER.items() if v in RESOLVED_STATUSES]
        rows = self.stored("orders").filter((F.col("o_orderdate") < F.lit(day).cast("timestamp_ntz"))
                                            & ~F.col("o_orderstatus").isin(*settled))
        return self._commitments(rows)

    @staticmethod
    def _commitments(orders: DataFrame) -> DataFrame:
        return orders.select(
            prefixed("commitment", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"),
            F.to_date("o_orderdate").alias("due_date"), _mapped(F.col("o_orderstatus"), STATUS_OF_ORDER).alias("status"),
            prefixed("person", "o_custkey").alias("owner_id"), F.col("o_totalprice").alias("value"))

    @cached_property
    def interactions(self) -> DataFrame:
        return self._interactions(self.stored("events"))

    def interactions_since(self, moment: str) -> DataFrame:
        """Interactions from a moment on, filtered on the stored column."""
        return self._interactions(self.stored("events").filter(F.col("ts") >= F.lit(moment).cast("timestamp_ntz")))

    @staticmethod
    def _interactions(events: DataFrame) -> DataFrame:
        label = _mapped(F.col("event_type"), SENTIMENT_OF_EVENT)
        return events.select(
            prefixed("interaction", "event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"),
            F.col("event_type").alias("type"),
            label.alias("sentiment"),
            F.when(label == "negative", -1.0).when(label == "positive", 1.0).when(label == "neutral", 0.0)
            .alias("sentiment_score"),
            prefixed("person", "user_id").alias("person_id"), F.col("props").alias("summary"),
            F.concat(F.lit("event://"), F.col("event_type")).alias("source_uri"))

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents").select(
            prefixed("document", "doc_id").alias("id"), "text", "lang",
            F.concat(F.lit("doc://"), F.col("source")).alias("source_uri"))

    def incidents(self, since: str) -> DataFrame:
        """Everything that touches an interaction or a commitment, as rows with the item's own fields.

        The business rows name both ends, so interactions and makers need no join at all; only the
        projects of a commitment are looked up.
        """
        none = {c: F.lit(None).cast(kind) for c, kind in
                (("at", "timestamp"), ("sentiment_score", "double"), ("due_date", "date"), ("status", "string"))}
        columns = ["kind", "item", "entity", "entity_label", *none]

        def rows(df: DataFrame, kind: str, entity: str, label: str) -> DataFrame:
            missing = {c: v for c, v in none.items() if c not in df.columns}
            named = df.withColumns({"kind": F.lit(kind), "item": F.col("id"), "entity": F.col(entity), "entity_label": F.lit(label), **missing})
            return named.select(*columns)

        promised = self.commitments.select("id", "due_date", "status", "owner_id")
        needed = self.relates_to.select(F.col("src").alias("id"), F.col("dst").alias("project_id"))
        return (rows(self.interactions_since(since).select("id", "at", "sentiment_score", "person_id"), "Interaction", "person_id", "Person")
                .unionByName(rows(promised, "Commitment", "owner_id", "Person"))
                .unionByName(rows(promised.drop("owner_id").join(needed, "id"), "Commitment", "project_id", "Project")))

    # --- all nodes and edges ------------------------------------------------------------

    @staticmethod
    def _node(df: DataFrame, label: str) -> DataFrame:
        types = {"due_date": "date", "at": "timestamp", "sentiment_score": "double", "influence_score": "double"}
        return df.select(
            F.lit(label).alias("label"), "id",
            *[(F.col(c) if c in df.columns else F.lit(None)).cast(types.get(c, "string")).alias(c)
              for c in NODE_COLUMNS[2:]])

    @cached_property
    def nodes(self) -> DataFrame:
        parts = [("Person", self.persons), ("Org", self.orgs), ("Concept", self.concepts),
                 ("Project", self.projects), ("Contract", self.contracts),
                 ("Commitment", self.commitments.withColumn("name", F.col("text"))),
                 ("Interaction", self.interactions)]
        frames = [self._node(df, label) for label, df in parts]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    @staticmethod
    def _edge(df: DataFrame, src_label: str, src: Column, rel: str, dst_label: str, dst: Column,
              seen_at: Column | None = None) -> DataFrame:
        return df.select(F.lit(src_label).alias("src_label"), src.alias("src"), F.lit(rel).alias("rel"),
                         F.lit(dst_label).alias("dst_label"), dst.alias("dst"),
                         (seen_at if seen_at is not None else F.lit(None)).cast("timestamp").alias("seen_at"))

    @cached_property
    def works_for(self) -> DataFrame:
        return self._edge(self.persons, "Person", F.col("id"), "WORKS_FOR", "Org", F.col("org_id"))

    @cached_property
    def instance_of(self) -> DataFrame:
        return self._edge(self.orgs, "Org", F.col("id"), "INSTANCE_OF", "Concept", F.col("concept_id"))

    @cached_property
    def party_to(self) -> DataFrame:
        return self._edge(self.contracts, "Org", F.col("org_id"), "PARTY_TO", "Contract", F.col("id"))

    @cached_property
    def made(self) -> DataFrame:
        return self._edge(self.commitments, "Person", F.col("owner_id"), "MADE", "Commitment", F.col("id"),
                          F.col("due_date"))

    @cached_property
    def relates_to(self) -> DataFrame:
        pairs = self.table("lineitem").select("l_orderkey", "l_partkey").distinct()
        return self._edge(pairs, "Commitment", prefixed("commitment", "l_orderkey"), "RELATES_TO", "Project",
                          prefixed("project", "l_partkey"))

    @cached_property
    def involved_in(self) -> DataFrame:
        pairs = (self.table("lineitem").select("l_orderkey", "l_partkey")
                 .join(self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
                 .select("o_custkey", "l_partkey").distinct())
        return self._edge(pairs, "Person", prefixed("person", "o_custkey"), "INVOLVED_IN", "Project",
                          prefixed("project", "l_partkey"))

    @cached_property
    def mentions(self) -> DataFrame:
        return self._edge(self.interactions, "Interaction", F.col("id"), "MENTIONS", "Person", F.col("person_id"),
                          F.col("at"))

    @cached_property
    def edges(self) -> DataFrame:
        out = self.works_for
        for part in (self.instance_of, self.party_to, self.made, self.relates_to, self.involved_in, self.mentions):
            out = out.unionByName(part)
        return out

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            prefixed("vec", "vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
            F.col("label").cast("string").alias("cluster"))

    @cached_property
    def turns(self) -> DataFrame:
        return self.table("conversations").select(
            F.concat(F.lit("session:"), F.col("conv_id")).alias("session_id"), "turn", "role", "text")


# The same graph for the SQL check.
GRAPH_SQL = """
WITH person AS (
  SELECT 'person:'||c_custkey AS id, c_name AS name, 'org:'||c_nationkey AS org_id, c_mktsegment AS segment,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal / 10000.0)) AS influence_score FROM customer),
org AS (SELECT 'org:'||n_nationkey AS id, n_name AS name, 'concept:'||n_regionkey AS concept_id FROM nation),
concept AS (SELECT 'concept:'||r_regionkey AS id, r_name AS name, 'OrgCategory' AS kind, 'canonical' AS status FROM region),
project AS (SELECT 'project:'||p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS type FROM part),
contract AS (SELECT 'contract:'||s_suppkey AS id, s_name AS name, 'org:'||s_nationkey AS org_id, s_acctbal AS value FROM supplier),
commitment AS (
  SELECT 'commitment:'||o_orderkey AS id, o_orderpriority AS text, o_orderdate::DATE AS due_date,
         CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' WHEN 'P' THEN 'accepted' END AS status,
         'person:'||o_custkey AS owner_id, o_totalprice AS value FROM orders),
interaction AS (
  SELECT 'interaction:'||event_id AS id, ts AS tm, event_type AS type,
         CASE WHEN event_type IN ('error','view') THEN 'negative' WHEN event_type = 'click' THEN 'neutral' ELSE 'positive' END AS sentiment,
         CASE WHEN event_type IN ('error','view') THEN -1.0::DOUBLE WHEN event_type = 'click' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS sentiment_score,
         'person:'||user_id AS person_id, props AS summary, 'event://'||event_type AS source_uri FROM events),
doc AS (SELECT 'document:'||doc_id AS id, text, lang, 'doc://'||source AS source_uri FROM documents),
vec AS (SELECT 'vec:'||vec_id AS id, embedding::DOUBLE[] AS vector, label::VARCHAR AS cluster FROM embeddings),
turns AS (SELECT 'session:'||conv_id AS session_id, turn, role, text FROM conversations),
nodes AS (
  SELECT 'Person' AS label, id, name, NULL AS status, NULL::DATE AS due_date, NULL::TIMESTAMP AS tm, NULL AS sentiment,
         NULL::DOUBLE AS sentiment_score, influence_score, NULL AS concept_id, NULL AS source_uri FROM person
  UNION ALL SELECT 'Org', id, name, NULL, NULL, NULL, NULL, NULL, NULL, concept_id, NULL FROM org
  UNION ALL SELECT 'Concept', id, name, status, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM concept
  UNION ALL SELECT 'Project', id, name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM project
  UNION ALL SELECT 'Contract', id, name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM contract
  UNION ALL SELECT 'Commitment', id, text, status, due_date, NULL, NULL, NULL, NULL, NULL, NULL FROM commitment
  UNION ALL SELECT 'Interaction', id, NULL, NULL, NULL, tm, sentiment, sentiment_score, NULL, NULL, source_uri FROM interaction),
works_for AS (SELECT id AS src, org_id AS dst FROM person),
made AS (SELECT owner_id AS src, id AS dst, due_date::TIMESTAMP AS seen_at FROM commitment),
relates_to AS (SELECT DISTINCT 'commitment:'||l_orderkey AS src, 'project:'||l_partkey AS dst FROM lineitem),
involved_in AS (SELECT DISTINCT 'person:'||o_custkey AS src, 'project:'||l_partkey AS dst
                FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS (
  SELECT 'Person' AS src_label, src, 'WORKS_FOR' AS rel, 'Org' AS dst_label, dst, NULL::TIMESTAMP AS seen_at FROM works_for
  UNION ALL SELECT 'Org', id, 'INSTANCE_OF', 'Concept', concept_id, NULL FROM org
  UNION ALL SELECT 'Org', org_id, 'PARTY_TO', 'Contract', id, NULL FROM contract
  UNION ALL SELECT 'Person', src, 'MADE', 'Commitment', dst, seen_at FROM made
  UNION ALL SELECT 'Commitment', src, 'RELATES_TO', 'Project', dst, NULL FROM relates_to
  UNION ALL SELECT 'Person', src, 'INVOLVED_IN', 'Project', dst, NULL FROM involved_in
  UNION ALL SELECT 'Interaction', id, 'MENTIONS', 'Person', person_id, tm FROM interaction),
undirected AS (
  SELECT src_label AS from_label, src AS from_id, rel, dst_label AS to_label, dst AS to_id, src, dst, seen_at FROM edges
  UNION ALL SELECT dst_label, dst, rel, src_label, src, src, dst, seen_at FROM edges)
"""
