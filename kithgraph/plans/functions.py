"""Predicates, projections and scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph import model
from kithgraph.functions import ids, text, values, vectors
from kithgraph.operators import registry as types
from kithgraph.operators.traversal import undirected
from kithgraph.plans.registry import query
from kithgraph.sources.graph import Graph


# --- labels and types -------------------------------------------------------------------

@query("p01_label_filter", sql="SELECT label, count(*)::BIGINT AS n FROM nodes WHERE label IN ('Person','Commitment','Risk') GROUP BY 1")
def label_filter(g: Graph) -> DataFrame:
    wanted = F.array(*[F.lit(x) for x in ("Person", "Commitment", "Risk")])
    return g.nodes.filter(F.arrays_overlap(F.array("label"), wanted)).groupBy("label").agg(F.count("*").alias("n"))


@query("p02_role_groups", sql="""
SELECT role, label, count(*)::BIGINT AS n FROM nodes JOIN (VALUES ('person','person'),('org','org'),('org','organisation'),('project','project'),('commitment','commitment'),
 ('interaction','interaction'),('contract','contract'),('risk','risk'),('issue','issue'),('topic','topic'),('alert','alert')) k(role, kw) ON contains(lower(label), kw) GROUP BY ALL""")
def role_groups(g: Graph) -> DataFrame:
    return g.nodes.join(model.label_roles(g.spark), "label").groupBy("role", "label").agg(F.count("*").alias("n"))


@query("s05_rule_tables", sql="""
SELECT dst_label AS target_label, rel, count(*)::BIGINT AS n FROM edges WHERE (rel, dst_label) IN (('WORKS_FOR','Org'),('RELATES_TO','Project')) GROUP BY ALL""")
def rule_tables(g: Graph) -> DataFrame:
    """Edges that a property rule could have produced; the rules are a broadcast dimension table."""
    rules = model.relationship_rules(g.spark).select("rel", "target_label", F.explode("source_labels").alias("src_label"))
    edges = g.edges.withColumnRenamed("dst_label", "target_label")
    return edges.join(rules, ["rel", "target_label", "src_label"], "left_semi").groupBy("target_label", "rel").agg(F.count("*").alias("n"))


REQUESTED_SQL = """,
asked AS (SELECT DISTINCT unnest([lower(label), ' '||upper(label)||' ', substr(label,1,2)||'_'||substr(label,3)]) AS raw FROM nodes UNION SELECT segment FROM person),
known AS (SELECT unnest(['Agent','Commitment','Concept','Contract','Interaction','Issue','Org','Outcome','Person','Project','Risk','Topic']) AS label),
resolved AS (SELECT trim(raw) AS requested, label FROM asked LEFT JOIN known ON regexp_replace(lower(raw), '[^\\p{L}\\p{N}]', '', 'g') = lower(label))
"""


@query("p03_requested_types", sql=REQUESTED_SQL + "SELECT DISTINCT requested, label FROM resolved")
def requested_types(g: Graph) -> DataFrame:
    label = F.col("label")
    forms = g.nodes.select(F.explode(F.array(F.lower(label), F.concat(F.lit(" "), F.upper(label), F.lit(" ")),
                                             F.concat(F.left(label, F.lit(2)), F.lit("_"), F.substr(label, F.lit(3))))).alias("raw"))
    asked = forms.distinct().unionByName(g.persons.select(F.col("segment").alias("raw")).distinct())
    return types.resolve_labels(asked, "raw", list(model.NODE_TYPES)).distinct()


@query("p04_id_property_match", sql="""
SELECT owner_id AS value, count(*)::BIGINT AS n FROM commitment GROUP BY 1""")
def id_property_match(g: Graph) -> DataFrame:
    """Commitments found by any property that holds a stakeholder's id."""
    props = F.create_map(F.lit("owner_id"), F.lit(None).cast("string"), F.lit("person_id"), F.col("owner_id"),
                         F.lit("person_name"), F.col("text"), F.lit("org_id"), F.lit("none"))
    rows = g.commitments.select("id", props.alias("props"))
    return types.id_property_values(rows, "person").groupBy("value").agg(F.count("*").alias("n"))


@query("p05_flexible_timestamp", sql="""
SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (event_type = 'signup')::BIGINT AS n_bad,
  sum(CASE event_type WHEN 'view' THEN epoch_us(date_trunc('day', ts)) // 1000000 WHEN 'signup' THEN NULL ELSE epoch_us(ts) // 1000000 END)::BIGINT AS total FROM events GROUP BY 1""", graph=False)
def flexible_timestamp(g: Graph) -> DataFrame:
    kind, ts = F.col("event_type"), F.col("ts")
    raw = (F.when(kind == "error", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
           .when(kind == "view", F.date_format(ts, "yyyy-MM-dd"))
           .when(kind == "click", F.unix_seconds(ts).cast("string"))
           .when(kind == "purchase", F.unix_millis(ts).cast("string")).otherwise("next week"))
    parsed = values.flexible_timestamp(raw)
    return g.table("events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(parsed.isNull()).alias("n_bad"), F.sum(F.unix_seconds(parsed)).alias("total"))


@query("p06_keyword_coalesce", sql="""
SELECT strftime(coalesce(o_orderdate, NULL), '%Y-%m') AS month, count(*)::BIGINT AS n FROM orders GROUP BY 1""", graph=False)
def keyword_coalesce(g: Graph) -> DataFrame:
    """First filled due date of the properties whose name says due or date, in alphabetical order."""
    chosen = values.keyword_coalesce(["o_orderdate", "due_on", "o_comment", "update_note"], ["due", "date"])
    rows = g.table("orders").withColumn("due_on", F.lit(None).cast("timestamp")).withColumn(
        "update_note", F.lit(None).cast("timestamp"))
    return rows.groupBy(F.date_format(F.coalesce(*[F.col(c) for c in chosen]), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("p07_closed_commitments", sql="""
SELECT status, CASE WHEN status = 'done' THEN true ELSE false END AS closed, count(*)::BIGINT AS n FROM (SELECT nullif(status, 'accepted') AS status FROM commitment) GROUP BY ALL""")
def closed_commitments(g: Graph) -> DataFrame:
    status = F.nullif(F.col("status"), F.lit("accepted"))
    padded = F.concat(F.lit(" "), F.upper(status), F.lit(" "))
    return g.commitments.groupBy(status.alias("status"), values.is_closed(padded).alias("closed")).agg(F.count("*").alias("n"))


@query("p10_clean_props", sql="""
SELECT CASE WHEN l_returnflag = 'N' THEN 'flag' ELSE 'flag,ship' END AS keys, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""", graph=False)
def clean_props(g: Graph) -> DataFrame:
    props = F.create_map(F.lit("id"), F.col("l_orderkey").cast("string"), F.lit("flag"), F.col("l_returnflag"), F.lit("ship"),
                         F.when(F.col("l_returnflag") != "N", F.date_format("l_shipdate", "yyyy-MM-dd")))
    keys = F.array_join(F.array_sort(F.map_keys(values.clean_props(props))), ",")
    return g.table("lineitem").groupBy(keys.alias("keys")).agg(F.count("*").alias("n"))


@query("p11_identifiers", sql="""
SELECT name, regexp_matches(upper(substr(name,1,1))||substr(name,2), '^[A-Z][A-Za-z0-9_]*$') AS label_ok, regexp_matches(upper(name), '^[A-Z0-9_]+$') AS rel_ok
FROM (SELECT p_name AS name FROM part UNION SELECT n_name FROM nation UNION SELECT event_type FROM events UNION SELECT lang FROM documents)""", graph=False)
def identifiers(g: Graph) -> DataFrame:
    names = g.table("part").select(F.col("p_name").alias("name")).unionByName(g.table("nation").select(F.col("n_name").alias("name"))) \
        .unionByName(g.table("events").select(F.col("event_type").alias("name"))).unionByName(g.table("documents").select(F.col("lang").alias("name")))
    return names.distinct().select("name", values.valid_label(F.col("name")).alias("label_ok"),
                                   values.valid_relationship(F.col("name")).alias("rel_ok"))


@query("p17_mention_coercion", sql="""
SELECT event_id, CASE WHEN event_type = 'click' THEN event_type ELSE 't'||user_id END AS temp_id, CASE WHEN event_type = 'click' THEN event_type ELSE 'user '||user_id END AS name,
  event_type = 'click' AS is_new FROM events""", graph=False)
def mention_coercion(g: Graph) -> DataFrame:
    raw = F.when(F.col("event_type") == "click", F.col("event_type")).otherwise(F.to_json(F.struct(
        F.concat(F.lit("t"), "user_id").alias("temp_id"), F.concat(F.lit("user "), "user_id").alias("name"), F.lit(False).alias("is_new"))))
    return types.coerce_mentions(g.table("events").withColumn("raw", raw), "raw").select("event_id", "temp_id", "name", "is_new")


@query("p18_entity_normalisation", sql="""
SELECT CASE WHEN o_orderstatus = 'F' THEN o_orderkey::VARCHAR WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE 'text '||o_custkey END AS id,
  CASE WHEN o_orderstatus = 'F' THEN o_orderkey::VARCHAR WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE 'text '||o_custkey END AS name, o_custkey::VARCHAR AS owner_id, count(*)::BIGINT AS n
FROM orders GROUP BY ALL""", graph=False)
def entity_normalisation(g: Graph) -> DataFrame:
    state = F.col("o_orderstatus")
    raw = g.table("orders").select(
        F.lit("Commitment").alias("label"), F.when(state == "F", F.col("o_orderkey").cast("string")).alias("id"),
        F.when(state == "O", F.col("o_orderpriority")).alias("name"), F.lit(None).cast("string").alias("title"),
        F.when(state == "P", F.concat(F.lit("text "), "o_custkey")).alias("text"),
        F.col("o_custkey").cast("string").alias("person_id"), F.lit(None).cast("string").alias("owner_id"))
    return types.normalise_entities(raw).groupBy("id", "name", "owner_id").agg(F.count("*").alias("n"))


@query("p19_collection_labels", sql="""
SELECT DISTINCT label, CASE label WHEN 'Commitment' THEN 'commitments' ELSE lower(label)||'s' END AS collection, label AS back FROM nodes""")
def collection_labels(g: Graph) -> DataFrame:
    labels = g.nodes.select("label").distinct().withColumn("collection", text.plural_label(F.col("label")))
    return labels.select("label", "collection", F.when(F.col("collection") == "concepts", "Concept").otherwise(
        text.collection_label(F.col("collection"))).alias("back"))


@query("p20_relationship_types", sql="""
SELECT CASE WHEN p_type = 'ECONOMY' THEN 'WORKS_FOR' ELSE upper(replace(p_name, ' ', '_')) END AS rel, bool_or(p_type = 'ECONOMY') AS known, count(*)::BIGINT AS n
FROM part GROUP BY 1""", graph=False)
def relationship_types(g: Graph) -> DataFrame:
    raw = F.when(F.col("p_type") == "ECONOMY", "works-for").otherwise(F.col("p_name"))
    rels = types.canonical_relationships(g.table("part").withColumn("rel", raw), "rel", {})
    return rels.groupBy("rel").agg(F.bool_or("known").alias("known"), F.count("*").alias("n"))


# --- scalar functions -------------------------------------------------------------------

@query("f01_normalise_text", sql="""
SELECT nullif(lower(trim(o_orderpriority)), '') AS v, nullif(trim(CASE WHEN o_orderstatus = 'F' THEN '  ' ELSE o_orderstatus END), '') AS s, count(*)::BIGINT AS n FROM
 (SELECT o_orderpriority, lower(o_orderstatus) AS low, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE lower(o_orderstatus) END AS o_orderstatus FROM orders) GROUP BY ALL""", graph=False)
def normalise_text(g: Graph) -> DataFrame:
    padded = F.concat(F.lit(" \t"), "o_orderpriority", F.lit("\n "))
    state = F.when(F.col("o_orderstatus") == "F", "  ").otherwise(F.col("o_orderstatus"))
    return g.table("orders").groupBy(text.normalise_text(padded).alias("v"), text.normalise_text(state).alias("s")).agg(F.count("*").alias("n"))


@query("f02_name_tokens", sql="""
SELECT DISTINCT p_name AS name, list_aggregate(list_sort(string_split(p_name||' '||lower(replace(p_brand, '#', ' '))||' '||lower(p_type), ' ')), 'string_agg', ' ') AS signature, p_brand, p_type FROM part""", graph=False)
def name_tokens(g: Graph) -> DataFrame:
    joined = F.concat_ws("_", "p_name", F.regexp_replace("p_brand", "#", "-"), "p_type")
    return g.table("part").select(F.col("p_name").alias("name"), text.token_signature(joined).alias("signature"), "p_brand", "p_type").distinct()


@query("f04_domain", sql=r"SELECT page_id, lower(trim(url)) AS plain, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS domain FROM pages", graph=False)
def domain(g: Graph) -> DataFrame:
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return g.table("pages").select("page_id", text.domain_of(F.col("url")).alias("plain"),
                                   text.domain_of(F.concat(F.lit("Web@x@"), host)).alias("domain"))


@query("f05_context_values", sql="""
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name||',n'||c_nationkey ELSE c_name||','||c_mktsegment||',n'||c_nationkey END AS vals FROM customer""", graph=False)
def context_values(g: Graph) -> DataFrame:
    fields = {"project": F.col("c_name"), "project_id": F.lit(""), "project_name": F.nullif("c_mktsegment", F.lit("BUILDING"))}
    plural = F.array(F.concat(F.lit("n"), "c_nationkey"), F.lit(None).cast("string"))
    return g.table("customer").select("c_custkey", F.array_join(text.context_values("project", fields, plural), ",").alias("vals"))


@query("f06_recency", sql="""
SELECT id, round(1.0 / (1.0 + greatest(0.0, (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(tm)) / 86400000000.0)), 6) AS recency FROM interaction""")
def recency(g: Graph) -> DataFrame:
    return g.interactions.select("id", F.round(values.recency(F.lit("2024-01-20").cast("timestamp"), F.col("at")), 6).alias("recency"))


@query("f07_cosine", sql="""
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.c), 6) AS sim FROM embeddings a JOIN (
  SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM (
    SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS pos FROM embeddings) GROUP BY ALL) GROUP BY 1) b ON a.label = b.label""", graph=False)
def cosine(g: Graph) -> DataFrame:
    rows = g.table("embeddings")
    centers = vectors.centroids(rows, ["label"], "embedding")
    return rows.join(centers, "label").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("centroid")), 6).alias("sim"))


@query("f08_sigmoid", sql="SELECT event_id, round(1.0 / (1.0 + exp(-(value - 10.0))), 6) AS s FROM events", graph=False)
def sigmoid(g: Graph) -> DataFrame:
    return g.table("events").select("event_id", F.round(vectors.sigmoid(F.col("value") - 10.0), 6).alias("s"))


@query("f09_text_hash", sql=r"""
SELECT doc_id, sha256(list_aggregate(list_transform(regexp_split_to_array(trim(text, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '\r\n|\n|\r'), lambda t: rtrim(t, ' '||chr(9)||chr(11)||chr(12))), 'string_agg', chr(10))) AS h FROM documents""", graph=False)
def text_hash(g: Graph) -> DataFrame:
    return g.table("documents").select("doc_id", ids.text_hash(F.col("text")).alias("h"))


@query("f10_graph_hash", sql="""
SELECT from_id AS id, sha256(from_id||':'||count(DISTINCT to_id)||':'||(SELECT sum(('0x'||substr(sha1(n), 1, 15))::BIGINT) FROM (SELECT unnest(list_distinct(list(to_id))) AS n))) AS h FROM undirected WHERE from_label IN ('Org','Concept') GROUP BY 1""")
def graph_hash(g: Graph) -> DataFrame:
    """Content hash of the neighbourhoods of organisations and concepts.

    The digest of the neighbours needs no order, so a hub is reduced on the map side and never gathered.
    """
    around = undirected(g.edges).filter(F.col("from_label").isin("Org", "Concept")).select(F.col("from_id").alias("id"), "to_id").distinct()
    rows = around.groupBy("id").agg(F.count("*").alias("n"), ids.set_digest(F.col("to_id")).alias("digest"))
    return rows.select("id", F.sha2(F.concat_ws(":", "id", "n", "digest"), 256).alias("h"))


@query("f11_belief_id", sql="""
SELECT src, dst, 'belief_'||substr(sha256('{"object":"Project:'||dst||'","polarity":"unknown","predicate":"RELATES_TO","subject":"Commitment:'||src||'"}'), 1, 16) AS id FROM relates_to""")
def belief_id(g: Graph) -> DataFrame:
    return g.relates_to.select("src", "dst", ids.belief_id(
        text.labelled_ref(F.col("src_label"), F.col("src")), F.col("rel"), text.labelled_ref(F.col("dst_label"), F.col("dst")),
        F.lit("unknown")).alias("id"))


@query("f12_alert_id", sql="""
SELECT id AS entity, substr(d,1,8)||'-'||substr(d,9,4)||'-5'||substr(d,14,3)||'-'||substr('89ab', (('0x'||substr(d,17,1))::INT % 4) + 1, 1)||substr(d,18,3)||'-'||substr(d,21,12) AS alert_id
FROM (SELECT id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('rule:'||id||':'||owner_id)) AS d FROM commitment)""")
def alert_id(g: Graph) -> DataFrame:
    return g.commitments.select(F.col("id").alias("entity"), ids.alert_id(F.lit("rule"), F.col("id"), F.col("owner_id")).alias("alert_id"))


@query("f15_slug", sql=r"""
SELECT DISTINCT url, coalesce(nullif(trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'item') AS slug FROM pages""", graph=False)
def slug(g: Graph) -> DataFrame:
    return g.table("pages").select("url", text.slug(F.col("url")).alias("slug")).distinct()


@query("f16_embedding_text", sql="SELECT p_partkey, p_name||chr(10)||p_type AS preferred, p_brand||chr(10)||p_type AS fallback FROM part", graph=False)
def embedding_text(g: Graph) -> DataFrame:
    preferred = {"name": F.col("p_name"), "type": F.concat(F.lit(" "), "p_type"), "brand": F.col("p_brand"), "title": F.lit(" ")}
    fallback = {"kind_of": F.col("p_type"), "brand": F.col("p_brand"), "note": F.lit(None).cast("string")}
    return g.table("part").select("p_partkey", text.embedding_text(preferred).alias("preferred"), text.embedding_text(fallback).alias("fallback"))


@query("f17_summaries", sql=r"""
SELECT doc_id, substr(text, 1, 140) AS head, list_aggregate(w[1:10], 'string_agg', ' ') AS ten FROM (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS w FROM documents)""", graph=False)
def summaries(g: Graph) -> DataFrame:
    return g.table("documents").select("doc_id", text.summary(F.col("text")).alias("head"), text.first_words(F.col("text"), 10).alias("ten"))


@query("f18_tokens", sql=r"""
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> ''))::BIGINT AS n_tokens FROM documents""", graph=False)
def tokens(g: Graph) -> DataFrame:
    return g.table("documents").select("doc_id", F.size(text.words(F.col("text"))).cast("bigint").alias("n_tokens"))


@query("f20_salient_phrases", sql="""
SELECT DISTINCT 'the very '||p_name AS value, string_split(p_name, ' ')[1] AS phrases FROM part""", graph=False)
def salient_phrases(g: Graph) -> DataFrame:
    value = F.concat(F.lit("the very "), "p_name")
    return g.table("part").select(value.alias("value"), F.array_join(text.salient_phrases(value), ",").alias("phrases")).distinct()


@query("f21_json_salvage", sql="""
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS body FROM events""", graph=False)
def json_salvage(g: Graph) -> DataFrame:
    noisy = F.when(F.col("event_type") == "error", F.concat(F.lit("oops {"), "props")).otherwise(F.concat(F.lit("Sure!\n"), "props", F.lit("\ndone")))
    return g.table("events").select("event_id", text.json_salvage(noisy).alias("body"))


@query("f22_version_bump", sql="""
SELECT DISTINCT o_orderpriority, '1.'||substr(o_orderpriority,1,1)||'.'||(o_custkey + 1) AS good, '0.0.1' AS bad, o_custkey FROM orders""", graph=False)
def version_bump(g: Graph) -> DataFrame:
    version = F.concat_ws(".", F.lit("1"), F.left("o_orderpriority", F.lit(1)), F.col("o_custkey").cast("string"))
    return g.table("orders").select("o_orderpriority", text.next_patch_version(version).alias("good"),
                                    text.next_patch_version(F.col("o_orderpriority")).alias("bad"), "o_custkey").distinct()


@query("f23_labelled_ref", sql="SELECT id, label||':'||id AS ref, 'Entity:'||id AS plain FROM nodes")
def labelled_ref(g: Graph) -> DataFrame:
    return g.nodes.select("id", text.labelled_ref(F.col("label"), F.col("id")).alias("ref"), text.labelled_ref(F.lit(" "), F.col("id")).alias("plain"))


@query("f24_truncation", sql="""
SELECT doc_id, length(CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000)||'…' ELSE text END)::BIGINT AS n, CASE WHEN length(text) > 2000 THEN substr(text, 1999, 2)||'…' END AS tail FROM documents""", graph=False)
def truncation(g: Graph) -> DataFrame:
    short = text.truncate(F.col("text"))
    return g.table("documents").select("doc_id", F.length(short).cast("bigint").alias("n"),
                                       F.when(F.length("text") > 2000, F.right(short, F.lit(3))).alias("tail"))


# --- type registry ----------------------------------------------------------------------

@query("a06_type_registry", sql="""
SELECT label, count(*)::BIGINT AS usage_count, max(used)::DATE AS last_used, list_aggregate(list_sort(list_distinct(flatten(list(keys)))), 'string_agg', ',') AS properties FROM (
  SELECT 'Commitment' AS label, o_orderdate AS used, CASE WHEN o_orderstatus = 'P' THEN ['due_date','text'] ELSE ['due_date','status','text'] END AS keys FROM orders
  UNION ALL SELECT 'Interaction', ts, CASE WHEN event_type = 'click' THEN ['at'] ELSE ['at','sentiment'] END FROM events) GROUP BY 1""", graph=False)
def type_registry(g: Graph) -> DataFrame:
    promised = g.table("orders").select(F.lit("Commitment").alias("label"), F.col("o_orderdate").alias("used_at"), F.when(
        F.col("o_orderstatus") == "P", F.array(F.lit("due_date"), F.lit("text"))).otherwise(
        F.array(F.lit("due_date"), F.lit("status"), F.lit("text"))).alias("keys"))
    seen = g.table("events").select(F.lit("Interaction").alias("label"), F.col("ts").alias("used_at"), F.when(
        F.col("event_type") == "click", F.array(F.lit("at"))).otherwise(F.array(F.lit("at"), F.lit("sentiment"))).alias("keys"))
    usage = types.observe(promised.unionByName(seen))
    return usage.select("label", "usage_count", "last_used", F.array_join("properties", ",").alias("properties"))


@query("u04_property_union", sql="""
SELECT 'Commitment' AS label, 'due_date,name,owner_id,priority,relates_to_contract_id,relates_to_project_id,source_uri,status,text' AS properties, (SELECT count(*) FROM orders)::BIGINT + 1 AS usage_count, false AS deprecated
UNION ALL SELECT 'Gadget', 'kind', (SELECT count(*) FROM part)::BIGINT, false""", graph=False)
def property_union(g: Graph) -> DataFrame:
    seen = g.table("orders").select(F.lit("Commitment").alias("label"), F.col("o_orderdate").alias("used_at"), F.array(F.lit("status"), F.lit("priority")).alias("keys"))
    parts = g.table("part").select(F.lit("Gadget").alias("label"), F.lit("2024-01-01").cast("timestamp").alias("used_at"), F.array(F.lit("kind")).alias("keys"))
    prior = model.rule_table(g.spark, [("Commitment", sorted(model.NODE_TYPES["Commitment"][1]), 1, 1, False)],
                             "label string, properties array<string>, usage_count bigint, introduced_in_version int, deprecated boolean")
    merged = types.merge_registry(prior, types.observe(seen.unionByName(parts)), version=2)
    return merged.select("label", F.array_join("properties", ",").alias("properties"), "usage_count", "deprecated")


@query("a06_stale_types", sql="""
SELECT p_brand AS label, count(*)::BIGINT AS usage_count, max(l_shipdate)::DATE AS last_used, (count(*) <= 1000 AND max(l_shipdate)::DATE + INTERVAL 180 DAY < DATE '2002-06-01') AS stale
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""", graph=False)
def stale_types(g: Graph) -> DataFrame:
    used = g.table("lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_shipdate").join(g.table("part").select("p_partkey", "p_brand"), "p_partkey") \
        .select(F.col("p_brand").alias("label"), F.col("l_shipdate").alias("used_at"), F.array(F.lit("brand")).alias("keys"))
    return types.stale(types.observe(used), F.lit("2002-06-01").cast("date"), min_usage=1000).select("label", "usage_count", "last_used", "stale")


@query("a07_commit_counts", sql="""
SELECT lower(label)||'s' AS collection, count(*)::BIGINT AS n FROM nodes GROUP BY 1""")
def commit_counts(g: Graph) -> DataFrame:
    return g.nodes.groupBy(F.concat(F.lower("label"), F.lit("s")).alias("collection")).agg(F.count("*").alias("n"))
