"""Repeated byte strings by distributed prefix doubling over sampled suffixes.

The question is which strings of ``length`` bytes also start earlier.  Sorting every suffix of a corpus many times moves far more
than the corpus, so positions are ranked in steps that double what a rank stands for only where needed:

1. Suffixes start at sampled positions: the leftmost least of the 32-byte strings in a window.  The choice depends on the
   window's bytes alone, so equal windows choose alike; some 3 in 100 positions are chosen.  The rank pair is
   (the 32 bytes there, all bytes of the windows that chose the position).
2. What is left is cut into blocks of 8 window starts.  The rank pair is (the 93 bytes that the block's windows share, all their bytes).
3. What is left are single windows, ranked by all their bytes.

Spark sorts the rank pairs.  A first rank held once is unique: its windows do not repeat.  Equal pairs are past the threshold: all windows
of all but the first are repeats.  Equal first ranks with unequal second ones go to the next step, one position for each
pair.  A rank is a 64-bit name of the bytes, a pair 128 bits (a single window is ranked by two names).
The sorted ranks are read as a stream that remembers one row, so a string with any number of places needs no memory.

Texts are shuffled once, by document; the steps and the cut share that exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.llm.common import arrow, bounded_slices, row_keyed, written
from kithgraph.llm.rolling import Hasher, leftmost_minimum, mix

LENGTH = 100
FIRST = 32
BLOCK = 8
RANKED = "outer long, inner long, key long, spot long"
JUDGED = "key long, start int, n int, at int, again boolean"
_RANKED = pa.schema([("outer", pa.int64()), ("inner", pa.int64()), ("key", pa.int64()), ("spot", pa.int64())])
_JUDGED = pa.schema([("key", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("at", pa.int32()), ("again", pa.bool_())])


def _pack(start: np.ndarray, n: np.ndarray, at: np.ndarray, settled: np.ndarray) -> np.ndarray:
    """A spot as one number that sorts by its first window: that window, how many there are, the position's distance, and the flag."""
    return start.astype(np.int64) << 32 | n.astype(np.int64) << 17 | (at - start).astype(np.int64) << 1 | settled.astype(np.int64)


def _judged(batch: pa.RecordBatch, again: np.ndarray) -> pa.RecordBatch:
    spot = batch.column(3).to_numpy()
    start = spot >> 32
    return arrow(_JUDGED, batch.column(2), start, spot >> 17 & 0x7FFF, start + (spot >> 1 & 0xFFFF), again)


def _sampled(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """For each sampled position of the texts: text number, first window, number of windows, the position, and its rank pair."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    hasher = Hasher(data)
    chosen = leftmost_minimum(hasher.order(FIRST), length - FIRST + 1)
    window = np.arange(len(chosen))
    owner = np.searchsorted(ends, window, side="right")
    inside = window + length <= ends[owner]
    window, owner, chosen = window[inside], owner[inside], chosen[inside]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    low = np.flatnonzero(new)
    n = np.diff(np.append(low, len(window)))
    first, at, owner = window[low], chosen[low], owner[low]
    inner = hasher.between(first, first + n - 1 + length) ^ mix((at - first).astype(np.uint64) + np.uint64(1))
    base = np.concatenate(([0], ends[:-1]))[owner]
    return owner, first - base, n, at - base, hasher.between(at, at + FIRST), inner


def _sample(docs: DataFrame, length: int) -> DataFrame:
    """Rank pairs of sampled positions.  ``settled`` rows repeat one that is earlier in the same task; they only travel along,
    spread by document, so frequent strings meet once per task at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in bounded_slices(batches, "text"):
            keys = rows.column(0).to_numpy()
            owner, start, n, at, outer, inner = _sampled(texts, length)
            order = np.lexsort((start, keys[owner], inner, outer))
            owner, start, n, at, outer, inner = (x[order] for x in (owner, start, n, at, outer, inner))
            later = np.zeros(len(order), dtype=bool)
            later[1:] = (outer[1:] == outer[:-1]) & (inner[1:] == inner[:-1])
            outer = np.where(later, mix(keys[owner].view(np.uint64)), outer)
            yield arrow(_RANKED, outer.view(np.int64), inner.view(np.int64), keys[owner], _pack(start, n, at, later))

    return docs.select("key", "text").mapInArrow(run, RANKED)


def _refine(ranked: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one (``again`` false) and rows to be ranked in smaller steps (``again`` true)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        waiting: pa.RecordBatch | None = None  # first of its rank: whether another pair follows is not known yet
        for batch in batches:
            settled = batch.column(3).to_numpy() & 1 == 1
            if settled.any():
                yield _judged(batch.filter(pa.array(settled)), np.zeros(int(settled.sum()), dtype=bool))
                batch = batch.filter(pa.array(~settled))
            if not batch.num_rows:
                continue
            outer, inner = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            run_start, pair_start = np.ones(len(outer), dtype=bool), np.ones(len(outer), dtype=bool)
            run_start[1:] = outer[1:] != outer[:-1]
            pair_start[1:] = run_start[1:] | (inner[1:] != inner[:-1])
            if last is not None:
                run_start[0] = outer[0] != last[0]
                pair_start[0] = run_start[0] or inner[0] != last[1]
            last = (int(outer[-1]), int(inner[-1]))
            pairs = np.flatnonzero(pair_start)
            again = np.zeros(len(outer), dtype=bool)
            if len(pairs):
                opens = run_start[pairs]
                again[pairs] = ~opens
                again[pairs[:-1]] |= ~opens[1:]
                if waiting is not None and not opens[0]:
                    yield waiting
                waiting = None
                if opens[-1]:
                    waiting = _judged(batch.slice(int(pairs[-1]), 1), np.ones(1, dtype=bool))
            keep = np.flatnonzero(again | ~pair_start)
            if len(keep):
                yield _judged(batch.take(pa.array(keep)), again[keep])

    sort = ranked.repartition("outer").sortWithinPartitions("outer", "inner", "key", "spot")
    return sort.mapInArrow(run, JUDGED)


def _by_document(judged: DataFrame, suffix: str) -> DataFrame:
    spot = F.struct("start", "n", "at")
    return judged.groupBy("key").agg(F.collect_list(F.when(~F.col("again"), spot)).alias(f"done{suffix}"),
                                     F.collect_list(F.when(F.col("again"), spot)).alias(f"open{suffix}"))


def _with_open(texts: DataFrame, found: DataFrame, step: int) -> DataFrame:
    """Documents that still have open spots."""
    left = found.filter(F.size(f"open{step}") > 0).select("key", f"open{step}")
    return texts.join(left.hint("shuffle_hash"), "key").select("key", "id", "text", f"open{step}")


def _spots(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row number, start, n, at) of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], dtype=np.int64)
    flat = column.flatten()
    start, n, at = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
    return np.repeat(np.arange(len(lengths)), lengths), start, n, at


def _blocks(start: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cut runs of windows into blocks aligned with their sampled position: (number of the run, first window, windows, block's place)."""
    low, high = (at - start - n + 1) // BLOCK, (at - start) // BLOCK
    count = high - low + 1
    owner = np.repeat(np.arange(len(start)), count)
    number = low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    place = at[owner] - BLOCK * number
    first = np.maximum(place - BLOCK + 1, start[owner])
    last = np.minimum(place, start[owner] + n[owner] - 1)
    return owner, first, last - first + 1, place


def _rank_again(found: DataFrame, step: int, length: int) -> DataFrame:
    """Rank pairs of the open spots of each document in blocks (step 2) or single windows (step 3)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in bounded_slices(batches, "text"):
            keys = rows.column(0).to_numpy()
            row, start, n, at = _spots(rows.column(3))
            base = np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1])).astype(np.int64)
            hasher = Hasher(np.frombuffer(b"".join(texts), dtype=np.uint8))
            if step == 2:
                owner, first, many, place = _blocks(start, n, at)
                row = row[owner]
                place, first = place + base[row], first + base[row]
                outer = hasher.between(place, place + length - BLOCK + 1)
                inner = hasher.between(first, first + many - 1 + length) ^ mix((place - first).astype(np.uint64) + np.uint64(1))
            else:
                row, many = np.repeat(row, n), np.ones(int(n.sum()), dtype=np.int64)
                first = np.repeat(start - np.cumsum(n) + n, n) + np.arange(len(row)) + base[row]
                place = first
                outer = hasher.between(first, first + length)
                inner = hasher.between(first, first + length // 2) ^ mix(hasher.between(first + length // 2, first + length))
            start = first - base[row]
            yield arrow(_RANKED, outer.view(np.int64), inner.view(np.int64), keys[row], _pack(start, many, place - base[row], np.zeros(len(row), dtype=bool)))

    return found.mapInArrow(run, RANKED)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for each row: the bytes left after every byte is removed that lies in a string of
    ``length`` bytes which also starts earlier, in a row of smaller id or earlier in the same row.

    Strings are judged on the input; they never cross rows.  Null texts are empty; texts shorter than ``length`` stay whole.
    Repeated rows, equal ids and null ids (first) are rows of their own in the order (id, text): all but the first of equal long
    texts go.  An empty table gives an empty table.  ``kept`` is binary, as a cut may fall inside a character.
    """
    if not FIRST + BLOCK <= length < 1 << 15:
        raise ValueError(f"length must be from {FIRST + BLOCK} to {(1 << 15) - 1}")
    keyed = row_keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", "key")
    first = written(_refine(_sample(keyed, length)), "suffix-ranks")
    texts = keyed.select("key", "id", "text")
    one = _by_document(first, 1)
    two = _by_document(_refine(_rank_again(_with_open(texts, one, 1), 2, length)), 2)
    three = _by_document(_refine(_rank_again(_with_open(texts, two, 2), 3, length)), 3)
    found = texts
    for i, part in enumerate((one, two, three), 1):
        found = found.join(part.select("key", f"done{i}").hint("shuffle_hash"), "key", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts_ in bounded_slices(batches, "text"):
            sizes = np.array([len(t) for t in texts_], dtype=np.int64)
            base = np.cumsum(sizes + 1) - sizes - 1  # a gap keeps the runs of two texts apart
            edge = np.zeros(int(sizes.sum()) + len(sizes) + 1, dtype=np.int64)
            for i in (3, 4, 5):
                row, start, n, _ = _spots(rows.column(i))
                np.add.at(edge, base[row] + start, 1)
                np.add.at(edge, base[row] + start + n - 1 + length, -1)
            gone = np.cumsum(edge) > 0
            opens = gone & ~np.concatenate(([False], gone[:-1]))
            removed, spans = (np.concatenate(([0], np.cumsum(x))) for x in (gone, opens))
            kept = [np.frombuffer(t, dtype=np.uint8)[~gone[b:b + len(t)]].tobytes() for t, b in zip(texts_, base.tolist())]
            yield pa.RecordBatch.from_arrays([rows.column(1), pa.array(sizes), pa.array(removed[base + sizes] - removed[base]),
                                              pa.array(spans[base + sizes] - spans[base]), pa.array(kept, pa.binary())],
                                             ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = dict(docs.dtypes)[id_col]
    return found.select("key", "id", "text", "done1", "done2", "done3").mapInArrow(
        cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
