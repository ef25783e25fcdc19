"""Quality classifier: logistic regression over hashed token n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of word bytes or of other marks; features are hashed 1- to 3-grams of them.  Two n-grams stand for themselves whatever
their words: a 3-gram that the text has shown before, and a word that comes again within two tokens.  Counts are damped by a logarithm and each
text's vector has length 1, so the score is a sparse dot product put through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithgraph.llm.common import bounded_slices, utf8, written
from kithgraph.llm.rolling import Hasher, mix

BITS = 20
ORDER = 3
SAMPLE_PER_LABEL = 3000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.02
#: Byte classes: 0 white space and controls, 1 word bytes (letters, digits, anything beyond ASCII), 2 other marks.
CLASS = np.array([0 if b <= 32 or b == 127 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], dtype=np.uint8)
BIAS, REPEATS, DOUBLED = 0, 1, 2


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value) of the sparse vectors of several texts, sorted by row and index."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    kind = CLASS[data]
    opens = np.flatnonzero(np.diff(kind, prepend=0) != 0)
    closes = np.append(opens[1:], len(data))
    full = kind[opens] > 0
    start, end = opens[full], closes[full]
    owner = np.searchsorted(ends, start, side="right")
    token = Hasher(data).between(start, end)
    grams, rows = [], []
    gram = np.zeros_like(token)
    for n in range(1, ORDER + 1):
        m = max(0, len(token) - n + 1)
        gram = mix(gram[:m] * np.uint64(31) + token[n - 1:] + np.uint64(n))
        within = owner[:m] == owner[n - 1:]
        grams.append(gram[within])
        rows.append(owner[:m][within])
    row = np.concatenate(rows)
    index = (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)
    index[index <= DOUBLED] += 3
    key, count = np.unique(row << BITS | index, return_counts=True)
    last_row, last = rows[-1], grams[-1]
    distinct = np.unique(np.stack([last_row.astype(np.uint64), last]), axis=1)[0].astype(np.int64) if len(last) else np.zeros(0, np.int64)
    repeats = np.bincount(last_row, minlength=len(texts)) - np.bincount(distinct, minlength=len(texts))
    again = np.zeros(len(token), dtype=bool)
    for gap in (1, 2):
        again[gap:] |= (token[gap:] == token[:-gap]) & (owner[gap:] == owner[:-gap])
    doubled = np.bincount(owner[again & (kind[start] == 1)], minlength=len(texts))
    extra = np.arange(len(texts))
    key = np.concatenate([key, *(extra << BITS | i for i in (BIAS, REPEATS, DOUBLED))])
    value = np.log1p(np.concatenate([count, np.ones(len(texts)), repeats, doubled]).astype(float))
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    row = key >> BITS
    norm = np.sqrt(np.bincount(row, weights=value ** 2, minlength=len(texts)))
    return row, key & ((1 << BITS) - 1), value / norm[row]


@dataclass
class Model:
    weights: np.ndarray


def logistic(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """Proximal follow-the-regularised-leader, one example at a time; weights come from the sums of gradients when they are needed.
    Both labels weigh the same in all."""
    labels = np.array([r[2] for r in rows], dtype=np.int64)
    share = len(rows) / (2.0 * np.maximum(1, np.bincount(labels, minlength=2)))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weight(i: np.ndarray | slice) -> np.ndarray:
        away = np.sign(z[i]) * np.maximum(np.abs(z[i]) - L1, 0.0)
        return -away / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            index, value, label = rows[k]
            w = weight(index)
            g = share[label] * (logistic(float(w @ value)) - label) * value
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            z[index] += g - sigma * w
            n[index] += g * g
    return Model(weight(slice(None)).astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Fits on a bounded sample: of each label the ``per_label`` usable ids of least hash.

    Vectors are made where the texts are; only the sample's come to the driver.  Null labels and ids without a document are not used.  Without
    examples every score is 0.5.
    """
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    rows = labels.filter(F.lit(True) if usable is None else usable).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    # a few ids have no document, so ranks go past the bound and the bound is applied again below
    picked = written(rows.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("label").alias("label"))
                     .join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
                     .withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_label).select("id", "label"), "quality-sample")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, out = batch.schema.names.index("text"), []
            for text in utf8(batch.column(where)):
                _, index, value = features([text])
                out.append((index.astype(np.int32).tobytes(), value.astype(np.float32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *(pa.array(c, pa.binary()) for c in zip(*out))],
                                                 ["id", "label", "index", "value"])

    found = texts.select("id", "label", "text").mapInArrow(vectors, "id long, label int, index binary, value binary").collect()
    found.sort(key=lambda r: (r["id"], bytes(r["index"]), bytes(r["value"])))
    return follow_the_leader([(np.frombuffer(r["index"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(float), r["label"]) for r in found])


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """Adds the probability of label 1 to every row; rows keep all their columns.  A null or empty text is scored by the bias alone."""
    names = [c for c in docs.columns if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)  # 2**BITS numbers
    schema = docs.select(*names).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in bounded_slices(batches, text_col):
            row, index, value = features(texts)
            sums = np.bincount(row, weights=shared.value[index] * value, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(logistic(sums))], [*names, name])

    return docs.select(*names).mapInArrow(run, schema)
