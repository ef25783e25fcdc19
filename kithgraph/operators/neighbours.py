"""Exact cosine nearest neighbours without forming all pairs.

Vectors are cut into cells around pivots, and cells into blocks of bounded size.  Each query first looks at one
block of its own cell, which bounds how far its k-th neighbour can be; by the triangle inequality only
blocks that could hold something nearer are visited afterwards.  Blocks and query chunks are
bounded, so a cell with a third of all vectors is only more blocks, never a bigger task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithgraph.session import cut_lineage

BLOCK = 1024
QUERY_CHUNK = 4096
MAX_BLOCK = 16384  # rows of either side that meet in a task; a row is sent once for each block of the other side it may meet
BLOCKS = 16  # blocks that are enough to keep a cluster busy
SLICE = 512  # queries whose similarities are held at a time
MAX_PIVOTS = 256
SLACK = 1e-9
ROUNDING = 1e-11
ZERO_CELL = -1


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 1))


def _units(column: pd.Series) -> np.ndarray:
    x = _matrix(column)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def _chord(sim: np.ndarray) -> np.ndarray:
    """Distance of two unit vectors from their cosine."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * sim))


def _with_cell(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot and the distance to it; zero vectors form a cell of their own."""
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = _units(pdf["vector"])
            d = _chord(x @ pivots.T)
            best = d.argmin(axis=1)
            zero = ~x.any(axis=1)
            yield pdf.assign(id=pdf["id"].astype(object), cell=np.where(zero, ZERO_CELL, best).astype("int32"),
                             radius=np.where(zero, 0.0, d[np.arange(len(x)), best]))

    return df.select("id", "vector").mapInPandas(assign, "id string, vector array<double>, cell int, radius double")


def _visit(asked: DataFrame, blocks: DataFrame, k: int, not_self: bool) -> DataFrame:
    """Best k of each visited block per query, of those that reach its floor where it has one; ties go to the larger id."""
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": pd.Series([], dtype=object), "id": pd.Series([], dtype=object), "sim": pd.Series([], dtype=float)})
        right = right.sort_values("other", ascending=False, kind="stable")
        names, queries = right["other"].to_numpy(dtype=object), left["query"].to_numpy(dtype=object)
        asks, offers = _units(left["vector"]), _units(right["other_vector"]).T
        floors = left["floor"].to_numpy(dtype=float)
        codes = pd.factorize(np.concatenate([queries, names]))[0]
        mine, theirs = codes[:len(queries)], codes[len(queries):]
        out = []
        for at in range(0, len(asks), SLICE):
            sims = asks[at:at + SLICE] @ offers
            if not_self:
                sims[mine[at:at + SLICE, None] == theirs[None, :]] = -np.inf
            floor = floors[at:at + SLICE].copy()
            open_ = np.flatnonzero(np.isnan(floor))
            if len(open_):
                last = sims.shape[1] - k
                floor[open_] = np.partition(sims[open_], last, axis=1)[:, last] if last > 0 else -np.inf
            row, col = np.nonzero((sims >= (floor - ROUNDING)[:, None]) & (sims > -np.inf))
            value = np.round(sims[row, col], 12)
            order = np.lexsort((col, -value, row))  # names fall, so the larger id comes first
            row, col, value = row[order], col[order], value[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append(pd.DataFrame({"query": pd.Series(queries[at + row[keep]], dtype=object), "id": pd.Series(names[col[keep]], dtype=object), "sim": value[keep]}))
        return pd.concat(out, ignore_index=True)

    key = ["cell", "block", "chunk"]
    return asked.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInPandas(best, "query string, id string, sim double")


def nearest(queries: DataFrame, data: DataFrame, k: int, not_self: bool = False) -> DataFrame:
    """(query, id, sim, position) of the k nearest data vectors of each query, both with id and vector."""
    n = data.count()
    if n == 0 or k <= 0:
        return queries.sparkSession.createDataFrame([], "query string, id string, sim double, position int")
    block = max(BLOCK, min(MAX_BLOCK, math.ceil(n / BLOCKS)))
    wanted = min(MAX_PIVOTS, math.ceil(n / block))
    picked = data.orderBy(F.xxhash64("id"), "id").limit(wanted).toPandas()  # at most MAX_PIVOTS vectors
    pivots = _units(picked["vector"])
    cells = cut_lineage(_with_cell(data, pivots))
    stats = {r["cell"]: (r["n"], r["radius"]) for r in
             cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).collect()}  # one row per pivot
    n_blocks = {c: math.ceil(size / block) for c, (size, _) in stats.items()}
    asked = cells if queries is data else cut_lineage(_with_cell(queries, pivots))
    asked = asked.select(F.col("id").alias("query"), "vector", "cell")

    order = Window.partitionBy("query").orderBy(F.desc("sim"), F.desc("id"))
    if n <= BLOCK and len(stats) == 1:  # one block holds everything
        near = _round(asked.withColumns({"cells": F.array(F.lit(next(iter(stats)))), "kth": F.lit(None).cast("double")}), cells, n_blocks, block, k, not_self, one_block=True)
        return near.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
    first = asked.filter(F.col("cell").isin(*stats)) if queries is not data else asked
    near = _round(first.withColumns({"cells": F.array("cell"), "kth": F.lit(None).cast("double")}), cells, n_blocks, block, k, not_self, one_block=True)
    bound = near.groupBy("query").agg(F.count("*").alias("n"), F.min("sim").alias("kth")) \
        .select("query", F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
    reach = sorted(c for c in stats if c != ZERO_CELL)
    centers = pivots[[c for c in reach]] if reach else pivots[:0]
    radii = np.array([stats[c][1] for c in reach])
    has_zero = ZERO_CELL in stats

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = _units(pdf["vector"])
            floor = pdf["kth"].fillna(-np.inf).to_numpy()
            reachable = _chord(x @ centers.T) - radii[None, :]
            allowed = np.where(np.isneginf(floor), np.inf, _chord(np.clip(floor, -1, 1)))[:, None] + SLACK
            zero = ~x.any(axis=1)
            hit = (reachable <= allowed) | zero[:, None]
            lists = [[reach[j] for j in np.flatnonzero(row)] + ([ZERO_CELL] if has_zero and (z or f <= SLACK) else [])
                     for row, z, f in zip(hit, zero, floor)]
            yield pd.DataFrame({"query": pdf["query"].astype(object), "vector": pdf["vector"], "kth": pdf["kth"], "cells": pd.Series(lists, index=pdf.index, dtype=object)})

    bounded = asked.join(bound, "query", "left").select("query", "vector", "kth")
    spread = bounded.mapInPandas(candidates, "query string, vector array<double>, kth double, cells array<int>")
    near = _round(spread, cells, n_blocks, block, k, not_self, one_block=False)
    return near.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def _round(asked: DataFrame, cells: DataFrame, n_blocks: dict[int, int], block: int, k: int, not_self: bool, one_block: bool) -> DataFrame:
    """Send queries to blocks of the cells they name; a busy cell is split into query chunks as well."""
    table = F.create_map(*[F.lit(x) for c, b in sorted(n_blocks.items()) for x in (c, b)])
    rows = asked.select("query", "vector", F.col("kth").alias("floor"), F.explode("cells").alias("cell")).filter(F.col("cell").isin(*n_blocks))
    rows = cut_lineage(rows)
    busy = {r["cell"]: math.ceil(r["n"] / max(QUERY_CHUNK, block)) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    if not busy:
        return rows.sparkSession.createDataFrame([], "query string, id string, sim double")
    chunks = F.create_map(*[F.lit(x) for c, b in sorted(busy.items()) for x in (c, b)])
    spot = F.xxhash64("query")
    rows = rows.withColumn("chunk", F.pmod(spot, F.element_at(chunks, F.col("cell"))).cast("int"))
    blocks_of = F.element_at(table, F.col("cell"))
    if one_block:
        rows = rows.withColumn("block", F.pmod(spot, blocks_of).cast("int"))
    else:
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), blocks_of - 1)))
    # new names and expressions: both sides may come from one frame, whose columns must not be mixed up
    data = cells.filter(F.col("cell").isin(*busy)).select(
        F.col("id").alias("other"), F.col("vector").alias("other_vector"), (F.col("cell") + 0).alias("cell"), F.pmod(F.xxhash64("id"), blocks_of).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.element_at(chunks, F.col("cell")) - 1)).alias("chunk"))
    return _visit(rows, data, k, not_self)
