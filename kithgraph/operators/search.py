"""Ranked name search over a term table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithgraph.functions.text import intent, query_keywords
from kithgraph.operators.numbering import global_positions
from kithgraph.session import cut_lineage

# Usual constants of the BM25 ranking function.
K1, B = 1.2, 0.75


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def term_table(names: DataFrame) -> DataFrame:
    """(name, term, tf, length) per distinct name: equal names are indexed once."""
    distinct = names.select("name").filter(F.col("name").isNotNull()).distinct()
    tokens = distinct.withColumn("terms", terms(F.col("name"))).withColumn("length", F.size("terms"))
    return tokens.select("name", "length", F.explode("terms").alias("term")).groupBy("name", "length", "term") \
        .agg(F.count("*").alias("tf"))


def postings(nodes: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """(term, name, impact, least, copies, rank) of every distinct name that is shown: what a term adds to its BM25 score.

    Statistics run over all named nodes.  A term's names are ranked by impact, then by the least id that is shown under the name; ranks come
    from range chunks of the whole order, so no list goes through one task.
    """
    named = nodes.filter(F.col("name").isNotNull())
    index = term_table(nodes)
    copies = named.groupBy("name").agg(F.count("*").alias("copies"))
    df = index.join(copies, "name").groupBy("term").agg(F.sum("copies").alias("df"))
    totals = copies.withColumn("length", F.size(terms(F.col("name")))).agg(
        F.sum("copies").alias("n"), (F.sum(F.col("copies") * F.col("length")) / F.sum("copies")).alias("avg_length"))
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    first = (named if shown is None else shown.filter(F.col("name").isNotNull())).groupBy("name").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    rows = index.join(df, "term").crossJoin(F.broadcast(totals)).withColumn("impact", idf * tf).select("term", "name", "impact")  # totals: exactly one row
    order = (F.col("term"), F.desc(F.round("impact", 9)), F.col("least"), F.col("name"))
    placed = cut_lineage(global_positions(rows.join(first, "name"), order, "place"))
    starts = placed.groupBy("term").agg(F.min("place").alias("start"), F.count("*").alias("size"))
    return cut_lineage(placed.join(starts, "term").withColumn("rank", F.col("place") - F.col("start") + 1).drop("place", "start"))


def best_nodes(index: DataFrame, nodes: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """The first ``depth`` nodes of each query, by score and then id; ``nodes`` are those that are shown.

    Of each term only its best names are read, and looked up for the query's other terms.  A name that has not been read scores at most
    what the ends of the read lists add up to, and, at that score, has an id beyond theirs.  A query is done when ``depth`` nodes
    come before that; the others are read deeper.  A frequent term so costs what its page needs, not its whole list.
    """
    by_name = Window.partitionBy("name").orderBy("id")
    offered = cut_lineage(nodes.filter(F.col("name").isNotNull()).select("id", "label", "name")
                          .withColumn("__r", F.row_number().over(by_name)).filter(F.col("__r") <= depth).drop("__r"))
    asked = cut_lineage(_asked(queries).join(index.select("term").distinct(), "term", "left_semi"))
    order = Window.partitionBy("query").orderBy(F.desc("__score"), "id")
    found: list[DataFrame] = []
    read, open_ = 4 * depth, asked
    while True:
        seen = open_.join(index.filter(F.col("rank") <= read).select("term", "name"), "term").select("query", "name").distinct()
        scored = seen.join(open_, "query").join(index.select("term", "name", "impact"), ["term", "name"]).groupBy("query", "name").agg(F.sum("impact").alias("score"))
        best = scored.join(offered, "name").withColumn("__score", F.round("score", 9)).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= depth)
        ends = index.filter((F.col("rank") == read) & (F.col("size") > read)).select("term", F.col("impact").alias("end"), F.col("least").alias("end_id"))
        bounds = open_.join(ends, "term", "left").groupBy("query").agg(F.round(F.sum("end"), 9).alias("most"), F.max("end_id").alias("after"))
        best = cut_lineage(best.join(bounds, "query"))
        ahead = F.sum(((F.col("__score") > F.col("most")) | ((F.col("__score") == F.col("most")) & (F.col("id") <= F.col("after")))).cast("int"))
        done = bounds.filter("most IS NULL").select("query").unionByName(best.groupBy("query").agg(ahead.alias("ahead")).filter(F.col("ahead") >= depth).select("query"))
        done = cut_lineage(done.distinct())
        found.append(best.join(done, "query", "left_semi").drop("__score", "most", "after"))
        open_ = cut_lineage(open_.join(done, "query", "left_anti"))
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found)
        read *= 8


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query", F.explode(F.array_distinct(terms(F.col("query")))).alias("term")).distinct()


def match_counts(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, total): shown nodes with any term of the query, worked out once for each set of terms.

    The most frequent term of a set counts as a whole; of the other terms only the names without it are added.
    """
    lists = index.groupBy("term").agg(F.sum("copies").alias("n"))
    asked = _asked(queries).join(lists, "term")
    sets = cut_lineage(asked.groupBy("query").agg(F.array_sort(F.collect_list("term")).alias("terms"), F.max_by("term", F.struct("n", "term")).alias("main"), F.max("n").alias("n")))
    kinds = sets.select("terms", "main", "n").distinct()
    others = kinds.select("terms", "main", F.explode("terms").alias("term")).filter("term <> main").join(index.select("term", "name", "copies"), "term") \
        .select("terms", "main", "name", "copies").distinct()
    main = index.select(F.col("term").alias("main"), "name")
    more = others.join(main, ["main", "name"], "left_anti").groupBy("terms").agg(F.sum("copies").alias("more"))
    return sets.join(more, "terms", "left").select("query", (F.col("n") + F.coalesce("more", F.lit(0))).alias("total"))


def search(nodes: DataFrame, queries: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    """Best nodes per query by score, then id; the page is taken per query."""
    return best_nodes(postings(nodes), nodes, queries, limit + offset).filter(F.col("position") > offset)


def matches(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Number of matching nodes per query: the total shown beside a page."""
    return match_counts(postings(nodes), queries)


def dialogue_plan(queries: DataFrame) -> DataFrame:
    """What each query asks for: its intent, the action that answers it and where paths start."""
    mood = intent(query_keywords(F.col("query")))
    planned = queries.withColumn("intent", mood).withColumn(
        "action", F.when(mood == "risk", "top_paths").otherwise("search_entities"))
    return planned.select("query", "intent", "action",
                          F.when(F.col("action") == "top_paths", F.col("stakeholder_id")).alias("start"))


def filtered_page(nodes: DataFrame, shown: DataFrame, queries: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """One page per query of the nodes that pass the filters, with total and page count."""
    size = min(max(size, 1), 200)
    skip = max(page - 1, 0) * size
    index = postings(nodes, shown)
    rows = best_nodes(index, shown, queries, skip + size).filter(F.col("position") > skip)
    return rows.join(match_counts(index, queries), "query").withColumn("total_pages", F.ceil(F.col("total") / size))
