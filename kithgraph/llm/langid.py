"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  A word's probability is the sum over all its
segmentations into pieces of the product of their probabilities, which a forward pass over the word's bytes adds up; a
text's log-probability is the sum over its words.  Every single byte is a piece as well, so no word is impossible.
Piece probabilities are fitted by expectation maximisation (forward and backward passes over the words of labelled texts).

Words are runs of letters, lower-cased, with a space in front that stands for the vocabulary's word mark; very long runs are cut.  Forward passes run over
all distinct words of a batch at once, for all languages.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithgraph.llm.common import text_bytes, written
from kithgraph.llm.rolling import Hasher

VOCABULARY = os.environ.get("LLM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SAMPLE_PER_LANGUAGE = 400
EM_ROUNDS = 4
SHARE_OF_ALL = 0.01
SCALE = 64.0  # keeps products near 1: about 6 bits for each byte
MOST_BYTES = 40  # longer runs of letters, as in writing without spaces, are cut into words of so many bytes
SLICE = 1 << 20
UNDETERMINED = "und"
NOT_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Lower-case pieces of a sentencepiece model, the word mark as a space, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace("▁", " ")
            if piece == piece.lower() and " " not in piece[1:]:
                found.add(piece.encode())
    return sorted(found)


class Pieces:
    """Looks up pieces by the hash of their bytes."""

    SLOT_BITS = 20

    def __init__(self, pieces: list[bytes]):
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        starts = np.concatenate(([0], ends[:-1]))
        self.hashes = Hasher(data).between(starts, ends)
        self.longest = max(len(p) for p in pieces)
        self.sorted = np.argsort(self.hashes)
        slots = (self.hashes >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        self.table = np.full(1 << self.SLOT_BITS, -1, dtype=np.int32)
        self.table[slots] = np.arange(len(pieces))
        lost = np.flatnonzero(self.table[slots] != np.arange(len(pieces)))  # pushed out of their slot by another piece
        self.rest = lost[np.argsort(self.hashes[lost])]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece number of each hash, or -1."""
        at = self.table[(hashes >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)]
        wrong = (at >= 0) & (self.hashes[at] != hashes)
        if wrong.any():
            where = np.flatnonzero(wrong)
            place = np.minimum(np.searchsorted(self.hashes[self.rest], hashes[where]), max(0, len(self.rest) - 1))
            found = self.rest[place] if len(self.rest) else np.full(len(where), 0)
            at[where] = np.where(self.hashes[found] == hashes[where], found, -1)
        return at


class Words:
    """The words of several texts, each with a space in front, and which are the same."""

    def __init__(self, texts: list[str]):
        parts = [t.lower().encode("utf-8", "replace").translate(NOT_LETTERS).split() for t in texts]
        counts = np.array([len(p) for p in parts], dtype=np.int64)
        self.data = b" " + b" ".join(b" ".join(p) for p in parts if p) if counts.sum() else b""
        array = np.frombuffer(self.data, dtype=np.uint8)
        start = np.flatnonzero(array == 32)
        end = np.append(start[1:], len(array)) if len(start) else start
        self.hasher = Hasher(array)
        owner = np.repeat(np.arange(len(texts)), counts)
        parts_of = np.maximum(1, -(-(end - start) // MOST_BYTES))
        place = np.arange(parts_of.sum()) - np.repeat(np.cumsum(parts_of) - parts_of, parts_of)
        start, end, self.owner = np.repeat(start, parts_of) + MOST_BYTES * place, np.repeat(end, parts_of), np.repeat(owner, parts_of)
        end = np.minimum(end, start + MOST_BYTES)
        _, first, self.which = np.unique(self.hasher.between(start, end), return_index=True, return_inverse=True)
        self.start, self.length = start[first], (end - start)[first]

    def groups(self, limit: int = 1 << 13) -> Iterator[np.ndarray]:
        """Distinct words of one length, in portions."""
        order = np.argsort(self.length, kind="stable")
        cuts = np.flatnonzero(np.diff(self.length[order])) + 1
        for group in np.split(order, cuts):
            for i in range(0, len(group), limit):
                if len(group[i:i + limit]):
                    yield group[i:i + limit]


def _found(words: Words, pieces: Pieces, group: np.ndarray) -> tuple[int, dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]]:
    """Length of the group's words, and for each (i, j) which words have a piece there and which piece."""
    size = int(words.length[group[0]])
    at = words.start[group]
    found = {}
    for i in range(size):
        for j in range(i + 1, min(size, i + pieces.longest) + 1):
            piece = pieces.find(words.hasher.between(at + i, at + j))
            if len(have := np.flatnonzero(piece >= 0)):
                found[i, j] = have, piece[have]
    return size, found


def _forward(size: int, found: dict, p: np.ndarray, n: int) -> np.ndarray:
    """alpha[j, word, language]: the sum over the segmentations of the first j bytes, times SCALE**j."""
    alpha = np.zeros((size + 1, n, p.shape[1]))
    alpha[0] = 1.0
    for i, j in sorted(found, key=lambda span: span[1]):
        have, piece = found[i, j]
        alpha[j, have] += alpha[i, have] * p[piece] * SCALE ** (j - i)
    return alpha


def word_logs(words: Words, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log-probability of each distinct word in each language."""
    out = np.zeros((len(words.start), p.shape[1]))
    for group in words.groups():
        size, found = _found(words, pieces, group)
        out[group] = np.log(_forward(size, found, p, len(group))[size]) - size * np.log(SCALE)
    return out


def expected_counts(words: Words, weights: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words (weights[word, language]) over all segmentations."""
    counts = np.zeros_like(p)
    for group in words.groups():
        group = group[weights[group].any(axis=1)]
        if not len(group):
            continue
        size, found = _found(words, pieces, group)
        alpha = _forward(size, found, p, len(group))
        beta = np.zeros_like(alpha)
        beta[size] = 1.0
        spans = sorted(found)
        for i, j in reversed(spans):
            have, piece = found[i, j]
            beta[i, have] += beta[j, have] * p[piece] * SCALE ** (j - i)
        share = weights[group] / alpha[size]
        for i, j in spans:
            have, piece = found[i, j]
            np.add.at(counts, piece, alpha[i, have] * p[piece] * SCALE ** (j - i) * beta[j, have] * share[have])
    return counts


@dataclass
class Model:
    languages: list[str]
    pieces: list[bytes]
    p: np.ndarray  # piece by language


def fit(texts: list[str], langs: list[str], vocabulary: list[bytes], rounds: int = EM_ROUNDS) -> Model:
    """Piece probabilities by expectation maximisation; each is mixed with a little of all languages' and of the uniform one."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], vocabulary, np.zeros((len(vocabulary), 0)))
    seen: dict[bytes, Counter] = {}  # distinct words only, so the passes below stay small
    for text, lang in zip(texts, langs):
        for word, n in Counter(text.lower().encode("utf-8", "replace").translate(NOT_LETTERS).split()).items():
            seen.setdefault(word, Counter())[lang] += n
    pieces, words = Pieces(vocabulary), Words([w.decode("utf-8", "replace") for w in seen])
    counted = np.array([[c[x] for x in languages] for c in seen.values()], dtype=float).reshape(len(seen), len(languages))
    weights = np.zeros((len(words.start), len(languages)))
    np.add.at(weights, words.which, counted[words.owner])
    lengths = np.array([len(v) for v in vocabulary], dtype=float)
    p = np.repeat((SCALE ** -lengths / (SCALE ** -lengths).sum())[:, None], len(languages), axis=1)
    for _ in range(rounds):
        counts = expected_counts(words, weights, pieces, p) + 1e-9
        own, every = counts / counts.sum(axis=0), counts.sum(axis=1, keepdims=True) / counts.sum()
        p = (1 - SHARE_OF_ALL) * own + SHARE_OF_ALL * (0.9 * every + 0.1 / len(vocabulary))
    return Model(languages, vocabulary, p)


def sample(docs: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """At most ``per_language`` texts of each language, those of least id hash.  Only ids are ranked; texts follow by a join."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    rows = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = written(rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
                  .withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_language).select("id").distinct(), "lang-sample")
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).join(ids, "id")


def train(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = SAMPLE_PER_LANGUAGE, vocabulary_path: str = VOCABULARY) -> Model:
    """Fits on a bounded sample: ``per_language`` labelled texts of each language."""
    rows = sample(docs, F.lit(True) if usable is None else usable, id_col, text_col, lang_col, per_language).select("text", "lang").collect()
    rows.sort()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], read_pieces(vocabulary_path))


def _score(texts: list[str | None], model: Model, pieces: Pieces) -> tuple[list[str], np.ndarray]:
    words = Words([t or "" for t in texts])
    logs = np.zeros((len(texts), len(model.languages)))
    np.add.at(logs, words.owner, word_logs(words, pieces, model.p)[words.which])
    logs -= logs.max(axis=1, keepdims=True)
    odds = np.exp(logs)
    best, score = odds.argmax(axis=1), odds.max(axis=1) / odds.sum(axis=1)
    known = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], dtype=bool)
    return [model.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist())], np.where(known, score, 0.0)


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """Adds the predicted language and the posterior probability of it (languages equally likely beforehand) to every row.

    Null texts and texts without a letter (number signs are none) are ``und`` with score 0, and so is everything where the model knows no
    language.  Letters of scripts that the pieces do not cover count through their bytes.  Rows keep all their columns.
    """
    names = [c for c in docs.columns if c not in (lang_name, score_name)]
    if not model.languages:
        return docs.select(*names, F.lit(UNDETERMINED).alias(lang_name), F.lit(0.0).alias(score_name))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages
    at = names.index(text_col)
    schema = docs.select(*names).schema.add(lang_name, "string").add(score_name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value.pieces)
        for batch in batches:
            sizes = np.cumsum(text_bytes(batch.column(at)))
            cuts = np.flatnonzero(np.diff(sizes // SLICE, prepend=0)).tolist() if len(sizes) else []
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
                if high > low:
                    part = batch.slice(low, high - low)
                    lang, score = _score(part.column(at).to_pylist(), shared.value, pieces)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], [*names, lang_name, score_name])

    return docs.select(*names).mapInArrow(run, schema)


def without_undetermined(docs: DataFrame, least_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                         per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs`` whose language can be told: a letter at least, and a posterior of ``least_score``.

    The model is fitted on the labelled rows of ``docs``.  Where none is labelled no language is known, and only null texts and texts
    without a letter go.  Extra columns stay as they are.
    """
    model = train(docs, None, id_col, text_col, lang_col, per_language)
    if not model.languages:
        return docs.filter(F.col(text_col).rlike(r"\p{L}"))
    judged = identify(docs, model, text_col, "__lang", "__score")
    return judged.filter((F.col("__lang") != UNDETERMINED) & (F.col("__score") >= least_score)).select(*docs.columns)
