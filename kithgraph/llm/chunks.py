"""Document fingerprints by content-defined chunking.

A gear hash runs over the bytes (each step shifts it left and adds a value of the byte, so 32 bytes decide it).  A chunk ends where
its top bits are zero: more bits are asked for before the normal size, fewer after it, which draws chunk sizes towards the
normal one.  Cuts depend on the bytes nearby only, so an edit moves few of them.  A fingerprint is the set of
chunk digests, each with the bytes it stands for; containment is the share of those bytes that the other one also has.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.llm.common import bounded_slices, utf8
from kithgraph.llm.rolling import mix

GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
LEAST, NORMAL, MOST = 12, 48, 192
STRICT_BITS, LOOSE_BITS = 7, 5
DIGEST_BITS = 48
BUCKET_ROWS, MOST_BUCKETS = 256, 20_000


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, by doubling the number of bytes it has seen."""
    hashed, seen = GEAR[data], 1
    while seen < 32:
        further = hashed.copy()
        further[seen:] += hashed[:-seen] << np.uint32(seen)
        hashed, seen = further, 2 * seen
    return hashed


def boundaries(text: bytes) -> list[int]:
    """Chunk ends, the last of them the text's."""
    hashed = gear(np.frombuffer(text, dtype=np.uint8))
    loose = np.flatnonzero(hashed < np.uint32(1 << (32 - LOOSE_BITS)))
    strict = (loose[hashed[loose] < np.uint32(1 << (32 - STRICT_BITS))] + 1).tolist()
    loose, cuts, start, size = (loose + 1).tolist(), [], 0, len(text)
    while start < size:
        i = bisect.bisect_left(strict, start + LEAST)
        end = strict[i] if i < len(strict) else size
        if end > start + NORMAL:
            i = bisect.bisect_left(loose, start + NORMAL)
            end = min(loose[i] if i < len(loose) else size, start + MOST, size)
        cuts.append(end)
        start = end
    return cuts


def chunk_weights(text: bytes) -> dict[int, int]:
    """Bytes by chunk digest."""
    weights: dict[int, int] = {}
    start = 0
    for end in boundaries(text) if text else []:
        name = xxhash.xxh64_intdigest(text[start:end]) >> (64 - DIGEST_BITS)
        weights[name] = weights.get(name, 0) + end - start
        start = end
    return weights


def as_text(weights: dict[int, int]) -> str:
    return ",".join(f"{k:0{DIGEST_BITS // 4}x}:{v}" for k, v in sorted(weights.items()))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's bytes whose chunks b has as well; two empty fingerprints are alike, an empty and a filled one are not."""
    if not a:
        return 1.0 if not b else 0.0
    return sum(min(v, b.get(k, 0)) for k, v in a.items()) / sum(a.values())


def head(text: bytes, points: int) -> bytes:
    """The first ``points`` code points of UTF-8 bytes."""
    return text[: _offset(text, points)]


def _offset(text: bytes, points: int) -> int:
    starts = np.flatnonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)
    return int(starts[points]) if points < len(starts) else len(text)


def _points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80))


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(bucket, extra, id, text): rows dealt by ranges of the id, so that a row and the next one by descending id share a bucket.

    The first row of each bucket is also sent, marked extra, to the bucket before it (the very first to the last).  The driver
    holds the range bounds and each bucket's largest id: at most ``MOST_BUCKETS`` numbers each.
    """
    ids = docs.select("id")
    parts = max(1, min(-(-ids.count() // bucket_rows), MOST_BUCKETS))
    found = ids.approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = np.unique(np.array(found, dtype=np.int64))

    def bucket_of(column: pa.Array) -> np.ndarray:
        """Buckets count down the ids; null ids have the last."""
        filled = column.fill_null(0).to_numpy(zero_copy_only=False)
        bucket = len(bounds) - np.searchsorted(bounds, filled, side="left")
        return np.where(column.is_null().to_numpy(zero_copy_only=False), len(bounds) + 1, bucket).astype(np.int32)

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.table({"bucket": bucket_of(batch.column(0)), "id": batch.column(0)}).group_by("bucket").aggregate([("id", "max")])
            yield from pa.table({"bucket": rows["bucket"], "id": rows["id_max"]}).to_batches()

    tops = {r["bucket"]: r["id"] for r in ids.mapInArrow(largest, "bucket int, id long").groupBy("bucket").agg(F.max("id").alias("id")).collect()}
    order = sorted(tops)
    before = {b: order[i - 1] for i, b in enumerate(order)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "extra", "id", "text"]
        for batch in batches:
            bucket = bucket_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.zeros(len(bucket), dtype=bool)), *batch.columns], names)
            first = [i for i, (b, v) in enumerate(zip(bucket.tolist(), batch.column(0).to_pylist())) if v == tops[b]]
            if first:
                rows = batch.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([pa.array([before[int(bucket[i])] for i in first], pa.int32()), pa.array([True] * len(first)), *rows.columns], names)

    return docs.select("id", "text").mapInArrow(deal, "bucket int, extra boolean, id long, text string")


def edited_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The edited text has the last half (rounded down) of the row's code points replaced by the first as many, or all, of the next
    row's, by descending id; the first row follows the last.  ``near_*`` are containments of the row's fingerprint in the edited text's and
    in the next row's.  Null texts are empty, and an empty text has an empty fingerprint.  Equal ids follow each other in the order of
    their texts, null ids come last; a single row is its own next.  An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = with_next(rows, bucket_rows).repartition("bucket").sortWithinPartitions(
        "bucket", "extra", F.col("id").desc_nulls_last(), F.col("text").asc())
    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (bucket, id, text, weights) of the row whose next one is awaited
        for batch in batches:
            out = []
            for bucket, extra, name, text in zip(*(c.to_pylist() for c in batch.columns[:3]), utf8(batch.column(3))):
                weights = None
                if held is not None and held[0] == bucket:
                    weights = chunk_weights(text)
                    _, own_name, own, own_weights = held
                    points = _points(own)
                    half = points // 2
                    edited = head(own, points - half) + head(text, half)
                    edited_weights = chunk_weights(edited)
                    out.append((own_name, points, hashlib.sha256(edited).hexdigest(), as_text(own_weights), as_text(edited_weights),
                                containment(own_weights, edited_weights), containment(own_weights, weights)))
                held = None if extra else (bucket, name, text, chunk_weights(text) if weights is None else weights)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    return dealt.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
