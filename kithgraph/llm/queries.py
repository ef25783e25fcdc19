"""The named queries: each applies its operator with production parameters to whole tables and derives the asked columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm import bytepairs, centroids, chunks, decontaminate, langid, lm, mixing, pii, quality, simhash, suffixes, tries, urls
from kithgraph.llm.common import table
from kithgraph.llm.registry import query


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM words, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, s, n FROM places JOIN windows USING (n, t)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op2_benchmark_decontamination", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS t
           FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS s FROM bytes WHERE length(h) >= 200)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS r FROM places) WHERE r > 1),
runs AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS opens FROM later),
numbered AS (SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM runs),
spans AS (SELECT doc_id, run, min(s) AS low, max(s) + 100 AS high FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(high) OVER w, 0) AS low, low AS high FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY low)
         UNION ALL SELECT doc_id, max(high), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN g.high IS NULL THEN substr(h, 2 * low + 1) ELSE substr(h, 2 * low + 1, 2 * (g.high - low)) END, '' ORDER BY low) AS k
         FROM gaps g JOIN bytes USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM bytes LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query("op3_suffix_array_dedup", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.cut_repeats(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_document_fingerprints")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.edited_copies(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def id_fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(folds))


@query("op5_quality_classifier")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, folder, "labels"), id_fold("doc_id", 3) != 1)
    return (quality.score(docs, model).select("doc_id", (id_fold("doc_id", 3) == 1).alias("held_out"), "score",
                                              (F.col("score") >= 0.5).cast("int").alias("predicted")))


@query("op6_lm_scoring")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counts = lm.token_counts(docs)
    return lm.score_whole(docs, lm.train(docs, counted=counts), counts).drop("text")


OP7_SQL = r"""
WITH rules(rule, r_host, r_path, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                                                     ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
hosts AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rests),
parts AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM hosts),
best AS (SELECT page_id, host, path, max_by(rules, length(rule)) AS b
         FROM parts LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY ALL)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM best"""

OP7_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op7_url_filters", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{r}', '{v}')" for r, v in OP7_RULES) + " AS t(rule, verdict)")
    return urls.judge(table(spark, folder, "pages"), rules).withColumnRenamed("id", "page_id")


@query("op8_pii_surrogates")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.replace(docs, count_name="n_entities")


@query("op9_language_id")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.train(docs, id_fold("doc_id", 4) != 2)
    return (langid.identify(docs.select("doc_id", "text"), model)
            .select("doc_id", (id_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"))


@query("op10_entropy_mixing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mix(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", F.col("words").alias("source_size"), "target",
                        (F.col("copies") * F.col("size")).alias("taken"))


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Assignments and moves written out round by round; sums and products stay below 2**53, so doubles are exact."""
    parts = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, v, list_inner_product(v, v) AS vv
  FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v AS m FROM kept QUALIFY c < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, c, d FROM (SELECT r, c, vv - 2 * list_inner_product(v, m) + list_inner_product(m, m) AS d FROM kept, c{i})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(w.m, c{i}.m) AS m FROM c{i} LEFT JOIN (
    SELECT c, list(q ORDER BY p) AS m FROM (
      SELECT c, p, floor(sum(x) / count(*)) AS q
      FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i} JOIN kept USING (r)) GROUP BY c, p) GROUP BY c) w USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(m, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (c)"""


@query("op11_centroid_clustering", _op11_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = centroids.cluster(table(spark, folder, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
                        F.sha2("centroid", 256).alias("centroid_sha256"))


OP12_SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
           FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(unicode(s) AS BIGINT)),
                 lambda a, x: list_reduce([xor(a, x)] || range(8), lambda b, i: xor(b >> 1, 3988292384 * (b & 1))))) AS crc
        FROM (SELECT DISTINCT c FROM t)),
convs AS (SELECT c, c - c % 5 AS base, crc % 9 AS h FROM crc),
built AS (SELECT c, list({'r': role, 't': text} ORDER BY part, n) AS s FROM (
            SELECT v.c, 0 AS part, t.n, role, text FROM convs v JOIN t ON t.c = v.base AND t.n <= h
            UNION ALL SELECT v.c, 1, t.n, role, text FROM convs v JOIN t ON t.c = v.c AND t.n > h) GROUP BY c),
whole AS (SELECT c, coalesce(s, []) AS s FROM convs LEFT JOIN built USING (c)),
starts AS (SELECT c, s, d, list_slice(s, 1, d) AS p FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM whole)),
nodes AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(s) = d), '') AS ends,
                 CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * octet_length(encode(p[d].t)) END AS saved
          FROM starts GROUP BY p, d),
children AS (SELECT list_slice(p, 1, d - 1) AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (p, d)),
sums AS (SELECT list_slice(p, 1, a) AS p, a AS d, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
         FROM (SELECT p, saved, n_children, unnest(range(0, d + 1)) AS a FROM full_) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN sums USING (p, d) LEFT JOIN nodes up ON f.d > 0 AND up.d = f.d - 1 AND up.p = list_slice(f.p, 1, f.d - 1)"""


@query("op12_conversation_prefix_trie", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = tries.prefix_trie(*tries.inheriting(tries.numbered_turns(table(spark, folder, "conversations"))))
    return found.select(F.col("least").alias("conv_id"), "depth", F.col("parent_least").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                        F.col("ends").alias("ends_sha256"))


@query("op13_byte_bpe")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bytepairs.decode(bytepairs.encode(table(spark, folder, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN), path)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
