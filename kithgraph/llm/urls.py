"""URL rules by hashed expressions: every URL is expanded into host suffixes and path prefixes, looked up by a short
hash prefix and confirmed by the full digest.  Built-in functions only.

A rule is a host and a path as one string (``example.net/en/``) with a verdict.  It fits its host and all subdomains where the URL's
path starts with the rule's.  A rule's path starts and ends with a slash, so a URL has one expression for each
host suffix and each slash of its path, and no other rule can fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.llm.common import LOWER

PREFIX_DIGITS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.  Path: from there up to ``?``, ``#`` or the end.
    Both are empty for null or where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    cut = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(cut) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(cut, *LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def expressions(host: Column, path: Column) -> Column:
    """All ``suffix + prefix`` strings: suffixes of the host at its dots, prefixes of the path that end in a slash."""
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    some = F.when(F.startswith(path, F.lit("/")), F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(some, lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for each page row.  ``rules`` has ``rule`` and ``verdict`` (allow or block).

    The longest fitting rule wins; of equally long ones the longer host, then the block; a rule listed with both verdicts
    blocks.  Without a fitting rule the rule is null and the verdict ``default``.  Null, empty and malformed urls have an empty host and
    path, which no rule fits, as a path must start with the rule's.  Null rules and empty tables are fine.  Repeated pages give
    repeated rows: distinct (host, path) are judged once, so a url on a third of all pages costs as much as any other.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    digest = lambda c: F.sha2(c, 256)
    short = lambda c: F.substring(c, 1, PREFIX_DIGITS)
    listed = (rules.filter(F.col("rule").isNotNull()).groupBy("rule").agg(F.max(F.col("verdict") == "block").alias("blocks"))
              .select("rule", "blocks", digest("rule").alias("rule_digest")).withColumn("prefix", short("rule_digest")))
    found = (rows.select("host", "path").distinct()
             .select("host", "path", F.explode(expressions(F.col("host"), F.col("path"))).alias("expression"))
             .withColumn("digest", digest("expression")).withColumn("prefix", short("digest"))
             .join(listed, "prefix").filter("digest = rule_digest")
             .groupBy("host", "path")
             .agg(F.max(F.struct(F.length("rule").alias("size"), F.instr("rule", "/").alias("host_size"), "blocks", "rule")).alias("best")))
    return (rows.join(found, ["host", "path"], "left")
            .select("id", "host", "path", F.col("best.rule").alias("rule"),
                    F.when(F.col("best").isNull(), default).when(F.col("best.blocks"), "block").otherwise("allow").alias("verdict")))
