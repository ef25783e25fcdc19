"""Centroid clustering of integer vectors with a LAESA pivot table.

A few fixed pivots are taken once, and every vector's distances to them are stored beside it.  In each round the triangle inequality bounds
the distance of a vector to a centroid from below by the largest difference of their distances to a pivot; only centroids whose bound does
not exceed an exact distance already known are measured, in integers.  Bounds carry slack for rounding, so the nearest centroid is never lost.

A round is one pass over the stored table: each task adds up its vectors by centroid, Spark adds up the tasks' rows, and the driver takes
``k`` sums and sends ``k`` centroids back.  Nothing else travels, however many vectors one centroid has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.llm.common import arrow, written

PIVOTS = 12
POOL = 400  # vectors with the least hashes, from which pivots are taken
LARGEST = 1 << 27  # of a component's integer: so every squared distance of up to 64 components fits in 63 bits
CELLS = 1 << 18  # vectors times centroids looked at together
PAIRS = 1 << 13  # exact distances worked out together


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def roots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of every point to every pivot, rounded to doubles."""
    return np.sqrt(np.stack([squared(points, p[None, :]) for p in pivots], axis=1).astype(np.float64))


def nearest(points: np.ndarray, point_roots: np.ndarray, centres: np.ndarray, centre_roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centre of each point (ties: the smaller), the squared distance, and how many distances were measured."""
    n, k = len(points), len(centres)
    low = np.zeros((n, k))
    for p in range(point_roots.shape[1]):
        np.maximum(low, np.abs(point_roots[:, p, None] - centre_roots[None, :, p]), out=low)
    each, guess = np.arange(n), low.argmin(axis=1)
    known = squared(points, centres[guess])
    slack = 1e-9 * (1 + max(point_roots.max(), centre_roots.max()))
    alive = low <= (np.sqrt(known.astype(np.float64)) + slack)[:, None]
    alive[each, guess] = False
    found = np.full((n, k), np.iinfo(np.int64).max)
    found[each, guess] = known
    rows, columns = np.nonzero(alive)
    for i in range(0, len(rows), PAIRS):
        r, c = rows[i:i + PAIRS], columns[i:i + PAIRS]
        found[r, c] = squared(points[r], centres[c])
    best = found.argmin(axis=1)
    return best, found[each, best], n + len(rows)


def farthest(pool: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: the pool's first vector, then again and again the one farthest from those taken."""
    taken, gap = [0], squared(pool, pool[:1])
    while len(taken) < min(count, len(pool)) and gap.max() > 0:
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, squared(pool, pool[taken[-1]][None, :]))
    return pool[taken]


def whole(column: str, width: int) -> F.Column:
    """Vectors of ``width`` components, none of them null or not finite."""
    each = F.col(column).cast("array<double>")
    return F.coalesce((F.size(each) == width) & F.forall(each, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def _rows(matrix: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in matrix]


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(values * scale), -LARGEST, LARGEST).astype(np.int64)


def pivot_table(kept: DataFrame, pivots: np.ndarray, scale: int) -> DataFrame:
    """(id, point, roots): integer vectors and their distances to the pivots, each packed as bytes."""
    kind, width = kept.schema["id"].dataType, pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = _integers(batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale)
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(_rows(points), pa.binary()), pa.array(_rows(roots(points, pivots)), pa.binary())],
                                                 ["id", "point", "roots"])

    return kept.mapInArrow(run, f"id {kind.simpleString()}, point binary, roots binary")


def _measured(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, centres: np.ndarray) -> Iterator[tuple]:
    """Slices of a batch's ids with their points, centroids and distances."""
    width, beside, step = centres.shape[1], roots(centres, pivots), max(1, CELLS // len(centres))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            points = _matrix(part["point"], np.int64, width)
            best, distance, _ = nearest(points, _matrix(part["roots"], np.float64, len(pivots)), centres, beside)
            yield part["id"], points, best, distance


def assigned(stored: DataFrame, pivots: np.ndarray, centres: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector of a pivot table."""
    kind = stored.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, best, distance in _measured(batches, pivots, centres):
            yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    return stored.mapInArrow(run, f"id {kind.simpleString()}, cluster int, distance long")


def moved(stored: DataFrame, pivots: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Centroids after one round: exact floor of the mean of their vectors; those without vectors stay."""
    k, width = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for _, points, best, _ in _measured(batches, pivots, centres):
            order = np.argsort(best, kind="stable")
            present, starts = np.unique(best[order], return_index=True)
            counts += np.bincount(best, minlength=k)
            sums[present] += np.add.reduceat(points[order], starts, axis=0)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), *(pa.array(sums[used, d]) for d in range(width))],
                                         ["cluster", "n", *names])

    names = [f"s{d}" for d in range(width)]
    parts = stored.mapInArrow(run, "cluster int, n long, " + ", ".join(f"{s} long" for s in names))
    totals = parts.groupBy("cluster").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *names])).collect()  # k rows at most
    after = centres.copy()
    for row in totals:
        after[row["cluster"]] = [int(row[s]) // int(row["n"]) for s in names]
    return after


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64,
            scale: int = 256, salt: str = "2:", pivots: int = PIVOTS) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every vector with ``width`` finite components; others are left out.

    A component x becomes floor(scale * x), held within 2**27 on both sides so that distances fit.  The first centroids are the ``k`` vectors
    whose ids have the least SHA-256 after ``salt``, in that order (ties and null ids: by components, null ids last); with fewer vectors
    there are fewer centroids.  Each of ``rounds`` rounds assigns and moves, then vectors are assigned once more.  ``distance`` is squared;
    inertia is its sum over the cluster and over all, null where it does not fit in a long.  ``centroid`` holds the final components, joined
    by commas.  Repeated rows and ids count each.  Extra columns are not looked at.  An empty table gives an empty table.
    """
    if width * (2 * LARGEST) ** 2 >= 1 << 63:
        raise ValueError("width must be below 128")
    spark = vectors.sparkSession
    kept = vectors.filter(whole(vector_col, width)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind = kept.schema["id"].dataType.simpleString()
    least = kept.select("vector", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("name"))
    pool = [r["vector"] for r in least.orderBy(F.col("name").asc_nulls_last(), "vector").limit(max(k, POOL)).collect()]
    if not pool:
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid string")
    pool = _integers(np.array(pool), scale)
    fixed, centres = farthest(pool, pivots), pool[:k].copy()
    stored = written(pivot_table(kept, fixed, scale), "centroids-pivots")
    for _ in range(rounds):
        centres = moved(stored, fixed, centres)
    found = written(assigned(stored, fixed, centres), "centroids-assigned")
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    schema = pa.schema([("cluster", pa.int32()), ("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid", pa.string())])
    each = arrow(schema, list(sums), [fits(d) for d in sums.values()], [fits(sum(sums.values()))] * len(sums),
                 [",".join(map(str, centres[c])) for c in sums])
    return found.join(F.broadcast(spark.createDataFrame(pa.Table.from_batches([each]))), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")

