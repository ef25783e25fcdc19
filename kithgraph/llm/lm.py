"""Language-model scoring by masked pseudo-likelihood.

Every token is predicted from the tokens on both sides by a small network (embeddings of the left and the right neighbour, added up and
squashed, then a softmax over the vocabulary); a document's score is the sum of the conditional log-probabilities of its tokens.

The window has one token on each side, so the counts of (left, token, right) over the corpus are all that the pseudo-likelihood
depends on.  Spark gathers them over every token of every document, and training is full-batch: each step adds
up the loss's gradient over the partitions of that table, in numpy, and Adam moves the weights.  No token is sampled or cut off.  For
scoring the network is evaluated once for every pair of neighbours in a slice of texts, and a token costs a look-up.

The network's vocabulary is the corpus's most frequent tokens and, for all others, classes by kind and length.  ``score`` takes a
class for its tokens.  ``score_whole`` has no such cut: the probability of a class between its neighbours is multiplied by the token's own
share in its class, counted over the whole corpus, which is a distribution over all tokens.  Shares of tokens that make up
more than one in ``KNOWN`` of the corpus are looked up where the text is; all others meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.llm.common import arrow, bounded_slices, row_keyed, written
from kithgraph.llm.rolling import Hasher

FREQUENT = 224
CLASSES = 31  # for tokens that are not frequent
EDGE = FREQUENT + CLASSES  # stands before the first and after the last token
SIZE = EDGE + 1
HIDDEN = 32
STEPS, RATE = 40, 0.1
PARTS = 24  # files of the table of counts, which has at most SIZE**3 rows whatever the corpus
SLICE = 4 << 20
KNOWN = 65_536  # fewer tokens than this make up more than one in so many each
FIXED = 1 << 32  # logarithms are added up in these fractions, so that sums don't depend on their order
#: Byte classes: 0 white space and controls, 1 digits, 2 letters and anything beyond ASCII, 3 other marks.
KIND = np.array([0 if b <= 32 or b == 127 else 1 if 48 <= b <= 57 else 2 if b >= 128 or chr(b).isalpha() else 3 for b in range(256)], dtype=np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


class Tokens:
    """Tokens of several texts, A-Z lower-cased: runs of letters, of digits or of other marks."""

    def __init__(self, texts: list[bytes]):
        data = LOWER[np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)]
        kind = KIND[data]
        opens = np.flatnonzero(np.diff(kind, prepend=0) != 0)
        closes = np.append(opens[1:], len(data))
        full = kind[opens] > 0
        start, end = opens[full], closes[full]
        self.owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
        self.names = Hasher(data).between(start, end)
        # kind and length stand for a token that is not frequent: 16 lengths of letters, 7 of digits, 8 of marks
        n = end - start
        self.rare = FREQUENT + np.select([kind[start] == 2, kind[start] == 1], [np.minimum(n, 16) - 1, 15 + np.minimum(n, 7)], 22 + np.minimum(n, 8))

    def ids(self, vocabulary: np.ndarray) -> np.ndarray:
        """Token ids; ``vocabulary`` holds the names of the frequent ones."""
        order = np.argsort(vocabulary)
        if not len(order):
            return self.rare
        at = order[np.minimum(np.searchsorted(vocabulary[order], self.names), len(order) - 1)]
        return np.where(vocabulary[at] == self.names, at, self.rare)

    def sides(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Left and right neighbour of each token; texts do not touch."""
        left, right = np.full(len(ids), EDGE), np.full(len(ids), EDGE)
        same = self.owner[1:] == self.owner[:-1]
        left[1:][same] = ids[:-1][same]
        right[:-1][same] = ids[1:][same]
        return left, right


def token_counts(docs: DataFrame) -> DataFrame:
    """(name, kind, n) of every token of all documents, ``kind`` being its class; a written table."""
    schema = pa.schema([("name", pa.int64()), ("kind", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in bounded_slices(batches, "text", SLICE):
            tokens = Tokens(texts)
            names, at, n = np.unique(tokens.names, return_index=True, return_counts=True)
            yield arrow(schema, names.view(np.int64), tokens.rare[at].astype(np.int32), n)

    counts = docs.mapInArrow(run, "name long, kind int, n long").groupBy("name").agg(F.min("kind").alias("kind"), F.sum("n").alias("n"))
    return written(counts, "lm-tokens")


def vocabulary(counts: DataFrame, size: int = FREQUENT) -> np.ndarray:
    """Names of the ``size`` most frequent tokens."""
    rows = counts.orderBy(F.desc("n"), "name").limit(size).select("name").collect()
    return np.array([r["name"] for r in rows], dtype=np.int64).view(np.uint64)


def triples(docs: DataFrame, names: np.ndarray) -> DataFrame:
    """(side, token, n): counts of each token between each pair of neighbours, ``side`` being left * SIZE + right."""
    shared = docs.sparkSession.sparkContext.broadcast(names)
    schema = pa.schema([("side", pa.int32()), ("token", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in bounded_slices(batches, "text", SLICE):
            tokens = Tokens(texts)
            ids = tokens.ids(shared.value)
            left, right = tokens.sides(ids)
            key, n = np.unique((left * SIZE + right) * SIZE + ids, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((key // SIZE).astype(np.int32)), pa.array((key % SIZE).astype(np.int32)), pa.array(n)], schema=schema)

    return docs.mapInArrow(run, "side int, token int, n long").groupBy("side", "token").agg(F.sum("n").alias("n"))


@dataclass
class Network:
    """Weights; ``parts`` in the order left, right, bias, out, out bias."""

    parts: list[np.ndarray]

    @staticmethod
    def start(shares: np.ndarray) -> Network:
        """Small seeded weights; the output bias starts at the tokens' own log shares."""
        rng = np.random.default_rng(7)
        return Network([rng.normal(0, 0.1, (SIZE, HIDDEN)), rng.normal(0, 0.1, (SIZE, HIDDEN)), np.zeros(HIDDEN),
                        rng.normal(0, 0.1, (HIDDEN, SIZE)), np.log(shares)])

    def logs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden layer and log-probabilities of all tokens between the neighbours."""
        l, r, bias, out, own = self.parts
        hidden = np.tanh(l[left] + r[right] + bias)
        x = hidden @ out + own
        x -= x.max(axis=1, keepdims=True)
        return hidden, x - np.log(np.exp(x).sum(axis=1, keepdims=True))

    def gradient(self, side: np.ndarray, token: np.ndarray, n: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Negative log-likelihood of the counts and its gradient."""
        kinds, at = np.unique(side, return_inverse=True)
        left, right = kinds // SIZE, kinds % SIZE
        counts = np.zeros((len(kinds), SIZE))
        counts[at, token] = n
        hidden, logs = self.logs(left, right)
        wrong = np.exp(logs) * counts.sum(axis=1, keepdims=True) - counts
        back = (wrong @ self.parts[3].T) * (1 - hidden ** 2)
        by_left, by_right = np.zeros_like(self.parts[0]), np.zeros_like(self.parts[1])
        np.add.at(by_left, left, back)
        np.add.at(by_right, right, back)
        return float(-(counts * logs).sum()), [by_left, by_right, back.sum(axis=0), hidden.T @ wrong, wrong.sum(axis=0)]


def _total_gradient(counts: DataFrame, network: Network) -> tuple[float, list[np.ndarray]]:
    """Added up where the counts are; at most ``PARTS`` vectors of fixed length come to the driver."""
    shared = counts.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                loss, parts = shared.value.gradient(*(c.to_numpy() for c in batch.columns))
                flat = np.concatenate([[loss], *(p.ravel() for p in parts)])
                total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["flat"])

    flat = sum(np.frombuffer(bytes(r["flat"])) for r in counts.mapInArrow(run, "flat binary").collect())
    shared.destroy()
    cuts = np.cumsum([1, *(p.size for p in network.parts)])
    return float(flat[0]), [flat[a:b].reshape(p.shape) for a, b, p in zip(cuts, cuts[1:], network.parts)]


@dataclass
class Model:
    names: np.ndarray
    network: Network
    losses: list[float]  # mean negative log-probability before each step


def train(docs: DataFrame, text_col: str = "text", steps: int = STEPS, rate: float = RATE, counted: DataFrame | None = None) -> Model:
    """Fits the network to every token of ``docs``; ``counted`` are their ``token_counts``, where they are known.

    Without tokens the model stays as it starts.
    """
    docs = docs.select(F.col(text_col).alias("text"))
    names = vocabulary(token_counts(docs) if counted is None else counted)
    counts = written(triples(docs, names).repartition(PARTS, "side").sortWithinPartitions("side"), "lm-counts")
    own = np.zeros(SIZE)
    for r in counts.groupBy("token").agg(F.sum("n").alias("n")).collect():  # at most SIZE rows
        own[r["token"]] = r["n"]
    network = Network.start((own + 0.5) / (own.sum() + 0.5 * SIZE))
    first, second = ([np.zeros_like(p) for p in network.parts] for _ in range(2))
    losses: list[float] = []
    for step in range(1, (steps if own.sum() else 0) + 1):
        loss, slope = _total_gradient(counts, network)
        losses.append(loss / own.sum())
        pace = rate * min(1.0, 2 - 2 * step / (steps + 1))
        for i, g in enumerate(slope):
            g = g / own.sum()
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            network.parts[i] = network.parts[i] - pace * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.99 ** step)) + 1e-8)
    return Model(names, network, losses)


@dataclass
class Shares:
    """What is looked up of the tokens outside the network's vocabulary."""

    spread: np.ndarray  # logarithm of the tokens of each class and one more, which is left to tokens never seen
    names: np.ndarray  # sorted, of the most frequent
    logs: np.ndarray  # logarithms of their counts

    @staticmethod
    def of(counts: DataFrame, total: int, known: int) -> Shares:
        spread = np.zeros(CLASSES)
        for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect():  # at most CLASSES rows
            spread[r["kind"] - FREQUENT] = np.log(r["n"] + 1)
        rows = counts.filter(F.col("n") * known > total).collect()  # fewer than ``known``
        names, n = np.array([r["name"] for r in rows], dtype=np.int64).view(np.uint64), np.array([r["n"] for r in rows], dtype=np.int64)
        order = np.argsort(names)
        return Shares(spread, names[order], np.log(n[order]))

    def split(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the names are known, and their logarithms; 0 for the others."""
        if not len(self.names):
            return np.zeros(len(names), dtype=bool), np.zeros(len(names))
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        known = self.names[at] == names
        return known, np.where(known, self.logs[at], 0.0)


def token_logs(texts: list[bytes], model: Model, shares: Shares | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, log-probability) of every token of the texts; with ``shares`` less the logarithm of its class's tokens, plus its own if known."""
    tokens = Tokens(texts)
    ids = tokens.ids(model.names)
    left, right = tokens.sides(ids)
    kinds, at = np.unique(left * SIZE + right, return_inverse=True)
    out = np.zeros(len(ids))
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(0, len(kinds), 2048))
    for k, (low, high) in enumerate(zip(cuts, [*cuts[1:], len(order)])):
        block = kinds[k * 2048:(k + 1) * 2048]
        logs = model.network.logs(block // SIZE, block % SIZE)[1]
        mine = order[low:high]
        out[mine] = logs[at[mine] - k * 2048, ids[mine]]
    if shares is not None:
        rare = ids >= FREQUENT
        out[rare] += shares.split(tokens.names[rare])[1] - shares.spread[ids[rare] - FREQUENT]
    return tokens.owner, out


def score(docs: DataFrame, model: Model, text_col: str = "text", shares: Shares | None = None) -> DataFrame:
    """Adds n_tokens, log_prob (the sum over the tokens) and mean_log_prob (null without tokens) to every row; all columns stay.

    Null, empty and blank texts have no tokens and log_prob 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, shares))  # a vocabulary and weights of fixed size
    names = [c for c in docs.columns if c not in ("n_tokens", "log_prob", "mean_log_prob")]
    schema = docs.select(*names).schema.add("n_tokens", "long").add("log_prob", "double").add("mean_log_prob", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in bounded_slices(batches, text_col, SLICE):
            owner, logs = token_logs(texts, *shared.value)
            n = np.bincount(owner, minlength=len(texts))
            total = np.bincount(owner, weights=logs, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1), mask=n == 0)],
                                             [*names, "n_tokens", "log_prob", "mean_log_prob"])

    return docs.select(*names).mapInArrow(run, schema)


def score_whole(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN) -> DataFrame:
    """As ``score``, for every token by itself: log_prob and mean_log_prob take in the token's share in its class; all columns stay.

    ``counts`` are the ``token_counts`` of the corpus that the model was trained on.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    rare = counts.filter(~F.col("name").isin(model.names.view(np.int64).tolist()))
    shares = Shares.of(rare, total, known)
    shared = docs.sparkSession.sparkContext.broadcast((model.names, shares))  # of bounded size
    keyed = row_keyed(docs, id_col, text_col)
    schema = pa.schema([("__key", pa.int64()), ("name", pa.int64()), ("times", pa.int64())])

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, looked_up = shared.value
        for rows, texts in bounded_slices(batches, "text", SLICE):
            tokens = Tokens(texts)
            left = (tokens.ids(frequent) >= FREQUENT) & ~looked_up.split(tokens.names)[0]
            owner, names = tokens.owner[left], tokens.names[left]
            order = np.lexsort((names, owner))
            owner, names = owner[order], names[order]
            first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | np.append(True, names[1:] != names[:-1])[:len(names)])
            yield arrow(schema, rows.column(0).to_numpy()[owner[first]], names[first].view(np.int64), np.diff(np.append(first, len(names))))

    # the logarithm of a count of one is zero, so only tokens met more than once are joined
    often = rare.filter((F.col("n") > 1) & (F.col("n") * known <= total)).select("name", F.round(F.log("n") * FIXED).cast("long").alias("log"))
    texts = keyed.select("__key", F.col(text_col).alias("text"))
    met = texts.mapInArrow(unknown, "__key long, name long, times long").join(often, "name")
    far = met.groupBy("__key").agg((F.sum(F.col("times") * F.col("log")) / FIXED).alias("__far"))
    own = score(keyed, model, text_col, shares).join(far, "__key", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("__far", F.lit(0.0)))
    return own.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))).drop("__key", "__far")
