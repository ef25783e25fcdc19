"""Benchmark decontamination: a prefix-filtered set join of word shingles, verified over item-sized windows.

A window is ``window`` consecutive words of an item, or the whole of a shorter item.  As a set of shingles it can only
occur where all its shingles do, so its rarest shingle (counted over all documents) is a sufficient prefix: the anchor.
Neighbouring windows mostly share their anchor and are joined as one.  Documents give the occurrences of
anchors with the words around them; the join on the anchor is confirmed word by word, within the window's length
and position bounds.

The only thing broadcast is a bitmap of fixed size that tells which shingles may be in an item; if it fills up, more rows
reach the join and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithgraph.llm.common import arrow, bounded_slices, row_keyed, written
from kithgraph.llm.rolling import Hasher, word_table

WINDOW = 10
SHINGLE = 3
BITMAP_BITS = 26
WORDS = word_table({*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)})


class Words:
    """The words of several texts in one buffer, with shingle hashes."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\0".join(b" ".join(t.translate(WORDS).split()) for t in texts) + b"\0"
        array = np.frombuffer(self.data, dtype=np.uint8)
        cut = np.flatnonzero(array <= 32)
        start = np.concatenate(([0], cut[:-1] + 1))
        owner = np.concatenate(([0], np.cumsum(array[cut] == 0)[:-1]))
        full = cut > start
        self.start, self.end, self.owner = start[full], cut[full], owner[full]
        self.counts = np.bincount(self.owner, minlength=len(texts))
        self.first = np.cumsum(self.counts) - self.counts
        self.hasher = Hasher(array)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, hash) of each run of ``size`` words within a text."""
        at = np.arange(max(0, len(self.start) - size + 1))
        at = at[self.owner[at] == self.owner[at + size - 1]]
        return at, self.hasher.between(self.start[at], self.end[at + size - 1])

    def text(self, first: int, last: int) -> list[str]:
        """Words first to last-1."""
        return self.data[self.start[first]:self.end[last - 1]].decode("utf-8", "replace").split(" ") if last > first else []


def _in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - BITMAP_BITS)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _bitmap(tokens: DataFrame) -> np.ndarray:
    """2**26 bits, whatever the number of tokens: at most a million 64-bit words come to the driver."""
    slot = F.shiftrightunsigned("token", 64 - BITMAP_BITS)
    rows = (tokens.select(F.shiftrightunsigned(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(token, {64 - BITMAP_BITS}) & 63 as int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas())
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    bitmap[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return bitmap


def _item_shingles(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item, at, size, token): every shingle of each item; an item shorter than a shingle is one."""
    schema = pa.schema([("item", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("token", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in bounded_slices(batches, "text"):
            words, ids = Words(texts), rows.column(0).to_numpy()
            for size in range(1, shingle + 1):
                at, token = words.shingles(size)
                keep = (words.counts[words.owner[at]] == size) if size < shingle else slice(None)
                at, token = at[keep], token[keep]
                owner = words.owner[at]
                yield arrow(schema, ids[owner], at - words.first[owner], np.full(len(at), size), token.view(np.int64))

    return items.select("__item", "text").mapInArrow(run, "item long, at int, size int, token long")


def _count_in_documents(docs: DataFrame, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """(token, n): how often documents have the shingles of items; a few others may be among them."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in bounded_slices(batches, "text"):
            words = Words(texts)
            for size in sizes:
                token = words.shingles(size)[1]
                kinds, n = np.unique(token[_in_bitmap(shared.value, token)], return_counts=True)
                yield arrow(schema, kinds.view(np.int64), n)

    return docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _anchors(shingles: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(token, item_id, size, length, core, before, after): each anchor with the words that its windows reach.

    ``before`` runs backwards from the anchor.  Of equal counts the lesser token, then the earlier place wins, so the windows of
    an anchor are consecutive.
    """
    fan = Window.partitionBy("item").orderBy("at").rowsBetween(0, window - SHINGLE)
    own = Window.partitionBy("item")
    chosen = (shingles.withColumn("words", F.max(F.col("at") + F.col("size")).over(own))
              .withColumn("length", F.least("words", F.lit(window)))
              .withColumn("best", F.min(F.struct("n", "token", F.col("at").alias("place"), "size")).over(fan))
              .filter(F.col("at") + F.col("length") <= F.col("words"))
              .groupBy("item", "length", "best").agg(F.min("at").alias("low"), F.max("at").alias("high")))
    schema = pa.schema([("token", pa.int64()), ("item_id", pa.string()), ("size", pa.int32()), ("length", pa.int32()), ("core", pa.string()),
                        ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in bounded_slices(batches, "text"):
            words, out = Words(texts), []
            for i, (name, spots) in enumerate(zip(rows.column(1).to_pylist(), rows.column(2).to_pylist())):
                base = int(words.first[i])
                for s in spots:
                    at, size, length = s["best"]["place"], s["best"]["size"], s["length"]
                    out.append((s["best"]["token"], name, size, length, " ".join(words.text(base + at, base + at + size)),
                                words.text(base + s["low"], base + at)[::-1], words.text(base + at + size, base + s["high"] + length)))
            yield arrow(schema, *(zip(*out) if out else [[]] * len(schema)))

    spots = chosen.groupBy(F.col("item").alias("__item")).agg(F.collect_list(F.struct("best", "length", "low", "high")).alias("spots"))
    return items.join(spots, "__item").select("text", "item_id", "spots").mapInArrow(
        run, "token long, item_id string, size int, length int, core string, before array<string>, after array<string>")


def _scan(docs: DataFrame, bitmap: np.ndarray, sizes: list[int], window: int) -> DataFrame:
    """(key, id, n_words, found): every document with the places where anchors may be, and the words around them."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    spot = pa.struct([("token", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("core", pa.string()),
                      ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in bounded_slices(batches, "text"):
            words = Words(texts)
            found: list[list[dict]] = [[] for _ in texts]
            for size in sizes:
                at, token = words.shingles(size)
                hit = _in_bitmap(shared.value, token)
                for i, t in zip(at[hit].tolist(), token[hit].view(np.int64).tolist()):
                    d = int(words.owner[i])
                    low, high = int(words.first[d]), int(words.first[d] + words.counts[d])
                    found[d].append({"token": t, "at": i - low, "size": size, "core": " ".join(words.text(i, i + size)),
                                     "before": words.text(max(low, i - window + size), i)[::-1],
                                     "after": words.text(i + size, min(high, i + window))})
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(words.counts, pa.int64()), pa.array(found, pa.list_(spot))],
                                             ["key", "id", "n_words", "found"])

    kind = f"key long, id {dict(docs.dtypes)['id']}, n_words long, found array<struct<token: long, at: int, size: int, core: string, before: array<string>, after: array<string>>>"
    return docs.select("__key", "id", "text").mapInArrow(run, kind)


def _agree(left: str, right: str) -> Column:
    """How many leading words two lists share."""
    first = F.array_position(F.zip_with(left, right, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(left), F.size(right)))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, items) for each document row: its words, those inside an occurrence of a window, and the ids (strings,
    sorted, distinct) of items with occurring windows.

    Null and wordless texts have no words; such items have no window.  A null item id marks words but is not listed.
    Repeated documents are judged one by one, repeated items count once.  Empty tables are fine on either side.
    """
    spark = docs.sparkSession
    docs = row_keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    items = written(benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text")).distinct()
                    .withColumn("__item", F.xxhash64("item_id", "text")), "items")
    shingles = written(_item_shingles(items, window, SHINGLE), "item-shingles")
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())  # 1 to SHINGLE
    counted = _count_in_documents(docs, _bitmap(shingles), sizes)
    ranked = shingles.join(counted, "token", "left").fillna(0, ["n"])
    anchors = written(_anchors(ranked, items, window), "anchors")
    scanned = written(_scan(docs, _bitmap(anchors), sizes, window), "scanned")
    spots = scanned.select("key", F.explode("found").alias("f")).select("key", "f.*")
    a = anchors.select("token", "item_id", "length", *[F.col(c).alias(f"i_{c}") for c in ("size", "core", "before", "after")])
    back, on = _agree("before", "i_before"), _agree("after", "i_after")
    hits = (spots.join(a, "token").filter((F.col("core") == F.col("i_core")) & (back + F.col("size") + on >= F.col("length")))
            .select("key", "item_id", (F.col("at") - back).alias("low"), (F.col("at") + F.col("size") + on).alias("high")).distinct())
    reach = Window.partitionBy("key").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("high") - F.greatest("low", F.coalesce(F.max("high").over(reach), F.lit(0))))
    judged = (hits.withColumn("fresh", fresh).groupBy("key")
              .agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items")))
    every = scanned.select("key", "id", "n_words").join(judged, "key", "left")
    return every.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                        F.coalesce("items", F.array().cast("array<string>")).alias("items"))



def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                         item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs; extra columns stay as they are."""
    keyed = row_keyed(docs, id_col, text_col)
    found = contamination(keyed, benchmark, "__key", text_col, item_col, item_text_col, window)
    gone = written(found.filter("n_hit > 0").select(F.col("id").alias("__key")), "contaminated")
    return keyed.join(gone, "__key", "left_anti").select(*docs.columns)
