"""SimHash near-duplicates through an inverted index over byte positions.

Two 64-bit fingerprints that differ in at most ``d`` bits agree in at least ``8 - d`` of their 8 bytes.  The index
therefore has one posting list for every choice of ``8 - d`` positions with the bytes found there; a pair meets
in a list exactly when its tally of shared positional bytes reaches the guaranteed minimum.  Pairs that meet are
verified by their differing bits.  The index holds distinct fingerprints only, so exact copies never multiply.

A posting list gives the edges of a spanning forest of its links, never its pairs.  Lists longer than
``LIST_BOUND`` take another exact way whose output is linear: two fingerprints within 4 bits have a point within 2
bits of both, so each fingerprint is joined with the points around it (see ``_meet_halfway``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithgraph.llm.common import arrow, bounded_slices, row_keyed, written
from kithgraph.operators.vectors import connected_components

BYTES = 8
LIST_BOUND = 4096
BIT_TABLE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; a shorter text is one shingle, no words give none."""
    parts = text.translate(LOWER_TABLE).split()  # bytes.split() cuts at space and 0x09-0x0D
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)] if parts else [], dtype=np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1:].tolist())
    return np.array([digest(joined[a:b], seed) for a, b in pairs], dtype=np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """Bit i is 1 where over half the hashes have it; no hashes give 0."""
    by_byte = hashes.astype("<u8").view(np.uint8).reshape(-1, BYTES)
    counts = np.concatenate([np.bincount(by_byte[:, i], minlength=256) @ BIT_TABLE for i in range(BYTES)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp) for each row; fp is the fingerprint as a signed long.  Null and wordless texts have fingerprint 0."""
    kind = pa.int64()
    schema = pa.schema([("id", kind), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in bounded_slices(batches, "text"):
            found = np.array([majority_bits(shingle_hashes(t, words, seed)) for t in texts], dtype=np.uint64)
            yield arrow(schema, rows.column(0), found.view(np.int64))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def index_keys(fp: Column, max_bits: int) -> Column:
    """One key for each choice of ``8 - max_bits`` byte positions: which choice, and the bytes there."""
    piece = [F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)) for i in range(BYTES)]
    keys = []
    for number, chosen in enumerate(combinations(range(BYTES), BYTES - max_bits)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, 8).bitwiseOR(piece[i])
        keys.append(key)
    return F.array(*keys)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Columns (key, fp) of rows sorted by key, cut so that no key is split."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
        if len(key) and (last := int(np.searchsorted(key, key[-1]))):
            yield key[:last], fp[:last]
            key, fp = key[last:], fp[last:]
    if len(key):
        yield key, fp


def spanning_edges(fp: np.ndarray, close: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges (positions) of a forest that joins whatever links join; each search step looks at unreached members only."""
    left, edges = np.arange(len(fp)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = close(fp[left], fp[at])
            if near.any():
                found = left[near].tolist()
                edges += [(at, x) for x in found]
                queue += found
                left = left[~near]
    return edges


def _forest(max_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x ^ y) <= max_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in _runs(batches):
            cut = np.flatnonzero(np.diff(key)) + 1
            start, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
            two = start[end - start == 2]
            two = two[close(fp[two], fp[two + 1])]
            out = [np.stack([fp[two], fp[two + 1]], 1)]
            for s, e in zip(start[end - start > 2].tolist(), end[end - start > 2].tolist()):
                if edges := spanning_edges(fp[s:e], close):
                    out.append(fp[s:e][np.array(edges)])
            pairs = np.unique(np.concatenate(out), axis=0).view(np.int64)
            yield arrow(schema, pairs[:, 0], pairs[:, 1])

    return run


def _meet_halfway(fps: DataFrame, max_bits: int) -> DataFrame:
    """Edges among fingerprints of long lists: every one goes to the points within half the distance of it, and is linked
    with the least fingerprint at each.  Two of them share a point exactly when they differ in at most ``max_bits``
    bits (an even number)."""
    flips = [sum(1 << i for i in c) for n in range(max_bits // 2 + 1) for c in combinations(range(64), n)]
    masks = np.array(flips, dtype=np.uint64)
    schema = pa.schema([("point", pa.int64()), ("fp", pa.int64())])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for lo in range(0, len(fp), 64):
                own = fp[lo:lo + 64]
                yield arrow(schema, (own.view(np.uint64)[:, None] ^ masks).view(np.int64).ravel(), np.repeat(own, len(masks)))

    points = written(fps.select("fp").distinct().mapInArrow(around, "point long, fp long"), "simhash-points")
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return points.join(least, "point").filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, max_bits: int = 4, list_bound: int = LIST_BOUND) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) with the same components as all links of at most ``max_bits`` bits."""
    if not 0 < max_bits < BYTES or max_bits % 2:
        raise ValueError("max_bits must be 2, 4 or 6")
    index = fps.select("fp", F.explode(index_keys(F.col("fp"), max_bits)).alias("key"))
    # one shuffle: a fingerprint has one row of its 70 in a list, so no list holds more than a seventieth of the index
    counted = index.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    posted = written(counted.filter("n > 1"), "simhash-postings")
    short = posted.filter(F.col("n") <= list_bound).select("key", "fp").repartition("key").sortWithinPartitions("key")
    edges = short.mapInArrow(_forest(max_bits), "a long, b long")
    long = posted.filter(F.col("n") > list_bound)
    if long.limit(1).count():
        edges = edges.unionByName(_meet_halfway(long, max_bits))
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42,
                    max_bits: int = 4, list_bound: int = LIST_BOUND) -> DataFrame:
    """(id, fp, component): every row's fingerprint and the smallest id reachable over links of at most ``max_bits`` bits.

    Rows with null or wordless text have fingerprint 0 and are linked like any other.  Repeated rows give repeated
    rows.  A null id never names a component, unless it has no other.  An empty table gives an empty table.
    """
    prints = written(fingerprints(docs, id_col, text_col, words, seed), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    parts = connected_components(links(distinct.select("fp"), max_bits, list_bound))
    parts = parts.select(F.col("id").alias("fp"), F.col("component").alias("part"))
    named = parts.join(distinct, "fp").groupBy("part").agg(F.min("least").alias("component"))
    found = parts.join(named, "part").select("fp", "component")
    each = distinct.join(found, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    return prints.join(each, "fp").select("id", "fp", "component")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` that come first, by (id, text), in their group of near-duplicates; groups are the components of links.

    Null and wordless texts are one group.  Repeated rows are a group of which one stays.  Extra columns stay as they are.
    """
    keyed = row_keyed(docs, id_col, text_col)
    found = near_duplicates(keyed, "__key", text_col, words, max_bits=max_bits)
    gone = written(found.filter("id <> component").select(F.col("id").alias("__key")), "simhash-gone")
    return keyed.join(gone, "__key", "left_anti").select(*docs.columns)
