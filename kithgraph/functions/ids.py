"""Stable identifiers and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kithgraph.functions.text import strip

# Fixed value: the URL name space of name-based UUIDs (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def text_hash(c: Column) -> Column:
    lines = F.transform(F.split(strip(c), r"\r\n|\n|\r"), lambda t: F.rtrim(t, F.lit(" \t\f\x0b")))
    return F.sha2(F.array_join(lines, "\n"), 256)


def graph_hash(node_id: Column, neighbours: Column) -> Column:
    """Hash of a node and its sorted neighbours as compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(F.array_sort(neighbours).alias("neighbours"), node_id.alias("node_id"))), 256)


def set_digest(member: Column) -> Column:
    """Digest of a set of distinct texts that needs no order: the sum of their hashes.  Use inside an aggregate."""
    return F.sum(F.conv(F.substring(F.sha1(member), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")


def json_string(c: Column) -> Column:
    """JSON string literal, non-ASCII characters kept."""
    quoted = F.to_json(F.struct(c.alias("v")))
    return F.regexp_extract(quoted, r'(?s)^\{"v":(.*)\}$', 1)


def belief_id(subject: Column, predicate: Column, obj: Column, polarity: Column) -> Column:
    payload = F.concat(F.lit('{"object":'), json_string(obj), F.lit(',"polarity":'), json_string(polarity),
                       F.lit(',"predicate":'), json_string(predicate), F.lit(',"subject":'), json_string(subject),
                       F.lit("}"))
    return F.concat(F.lit("belief_"), F.substring(F.sha2(payload, 256), 1, 16))


def name_uuid(key: Column) -> Column:
    """Name-based UUID, version 5, in the URL name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(key, "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("bigint")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
                       F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def alert_id(rule: Column, entity: Column, subject: Column | None = None) -> Column:
    parts = [rule, entity] + ([subject] if subject is not None else [])
    return name_uuid(F.concat_ws(":", *parts))


def cluster_id(kind: Column, algorithm: Column, seed: Column, members_digest: Column) -> Column:
    return F.concat(F.lit("cluster_"),
                    F.substring(F.sha1(F.concat_ws(":", kind, algorithm, seed, members_digest)), 1, 16))


def sample_key(alert: Column, outcome: Column, timestamp: Column, feature_names: Column) -> Column:
    label = F.lower(strip(outcome))
    anonymous = F.concat_ws("|", F.lit("anon"), label, timestamp, F.array_join(F.array_sort(feature_names), ","))
    return F.when(F.coalesce(alert, F.lit("")) != "", F.concat_ws("|", alert, label)).otherwise(anonymous)
