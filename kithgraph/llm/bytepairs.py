"""Byte-pair encoding and decoding with a public rank file.

Text is split by the tokenizer's pattern, and each piece is encoded by backtracking instead of by merging: at every place the longest token is
tried first, and kept if the merges of it and its left neighbour together would give just these two; otherwise a shorter one is tried, and
when none is left the last token is given back.  A sequence in which all neighbours agree in this sense is the one that merging by rank
gives.  No place is tried twice after it has failed, so a piece takes time in proportion to its length, however long it is.

Longest tokens come from the trie of an Aho-Corasick automaton over the tokens' bytes, mapped to Latin-1, and only where a token is asked for.
Whether two tokens agree is worked out once along their edges, and remembered, as are the pieces met lately.

Documents are rows of their own: there is no shuffle.  The rank file is read on the driver and travels as a broadcast; its size is that of the
vocabulary.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator, Mapping
from itertools import accumulate, chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithgraph.llm.common import bounded_slices

PAIRS = 1 << 19  # remembered pairs of tokens
PIECES = 1 << 17  # remembered pieces, twice
SHORT = 48  # letters of a remembered piece at most
WHOLE = 1 << 21  # letters that are split at once; a longer text goes piece by piece
SLICE = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged(ranks: dict[bytes, int], data: bytes) -> list[bytes]:
    """Merging by rank, the leftmost first, written out plainly; for the few bytes of a token or two."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, len(ranks) + (1 << 30)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if parts[at] + parts[at + 1] not in ranks:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Vocabulary:
    """What tasks need of a rank file: each token's bytes, and of those that merging can bring about the longest shorter one they start with.

    ``first`` and ``last`` are the tokens along a token's left and right edge while it is merged, from its first or last byte to itself.
    Where no token ranks before the two it is merged from (``ordered``), merges happen in the order of ranks: one that came up late with a lower
    rank would, within its own bytes, be a token that ranks before its parts.  Then edges tell which tokens agree.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = {rank: token for token, rank in ranks.items()}
        parts = {token: (token,) if len(token) == 1 else _halves(ranks, token) for token in ranks}
        reached = {token for token, p in parts.items() if p is not None}  # others never come out of a merge
        self.shorter = {ranks[token]: next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in reached), -1) for token in reached}
        self.ordered = all(ranks[half] < ranks[token] for token in reached for half in parts[token] if half != token)
        self.first, self.last = {}, {}
        for token in sorted(reached, key=len):
            left, right = parts[token][0], parts[token][-1]
            self.first[ranks[token]] = (self.first[ranks[left]] if left != token else ()) + (ranks[token],)
            self.last[ranks[token]] = (self.last[ranks[right]] if right != token else ()) + (ranks[token],)


def _halves(ranks: dict[bytes, int], token: bytes) -> tuple[bytes, bytes] | None:
    """The two parts whose merge brings a token about, or none."""
    parts = merged({t: r for t, r in ((token[i:j], ranks.get(token[i:j])) for i in range(len(token)) for j in range(i + 1, len(token) + 1)) if r is not None and t != token}, token)
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Encoder:
    """Encodes by the fields of a ``Vocabulary``."""

    def __init__(self, vocabulary: Mapping, pattern: str):
        self.bytes, self.shorter, self.first, self.last, self.ordered = (vocabulary[k] for k in ("bytes", "shorter", "first", "last", "ordered"))
        self.pattern = regex.compile(pattern)
        self.ranks = {token: rank for rank, token in self.bytes.items()}
        self.lengths = {rank: len(token) for rank, token in self.bytes.items()}
        self.known = {self.bytes[rank].decode("latin-1"): rank for rank in self.shorter} | {"": -1}
        self.most = max(map(len, self.known))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for token in filter(None, self.known):
            self.automaton.add_word(token)
        self.agreed: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    def _agree(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens together gives these two."""
        if not self.ordered:
            return merged(self.ranks, self.bytes[left] + self.bytes[right]) == [self.bytes[left], self.bytes[right]]
        # what stands at the border on both sides, as ranks go by: the two must never be merged before one of them is merged away from it
        a, b, i, j, never = self.last[left], self.first[right], 0, 0, len(self.ranks) + (1 << 30)
        while True:
            across = self.ranks.get(self.bytes[a[i]] + self.bytes[b[j]], never)
            left_goes = a[i + 1] if i + 1 < len(a) else never
            right_goes = b[j + 1] if j + 1 < len(b) else never
            if across < left_goes and across <= right_goes and across < never:  # of equal ranks the left one is merged first
                return False
            if left_goes == right_goes == never:
                return True
            if left_goes <= right_goes:
                i += 1
            else:
                j += 1

    def _longest(self, piece: str, at: int) -> int:
        """The longest token that starts at a place: a prefix the trie has, cut to one that is a token."""
        part = piece[at:at + self.most]
        n = self.automaton.longest_prefix(part)
        token = self.known.get(part[:n])
        while token is None:
            n -= 1
            token = self.known.get(part[:n])
        return token

    def _piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        text, failed, shorter, lengths, agreed = piece.decode("latin-1"), set(), self.shorter, self.lengths, self.agreed
        taken: list[int] = []
        at, size, last, token = 0, len(piece), -1, self._longest(text, 0)
        while at < size:
            while token != -1:
                end = at + lengths[token]
                if end not in failed:
                    if last == -1:
                        break
                    pair = last << 32 | token
                    fits = agreed.get(pair)
                    if fits is None:
                        if len(agreed) >= PAIRS:
                            agreed.clear()
                        fits = agreed[pair] = self._agree(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token != -1:
                taken.append(token)
                at, last = end, token
                token = self._longest(text, at) if at < size else -1
            elif taken:
                failed.add(at)
                token = taken.pop()
                at -= lengths[token]
                last = taken[-1] if taken else -1
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return tuple(taken)

    def _met(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece that is not among the latest ones: from the ones before, or worked out."""
        found = self.before.get(piece)
        if found is None:
            found = self._piece(piece.encode())
            if len(piece) > SHORT:
                return found
        if len(self.pieces) >= PIECES:  # what is met again lives on, the rest is forgotten
            self.before, self.pieces = self.pieces, {}
        self.pieces[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.pattern.findall(text) if len(text) <= WHOLE else (m.group() for m in self.pattern.finditer(text)):
            ids += self.pieces.get(piece) or self._met(piece)
        return ids


def _with_column(df: DataFrame, name: str, kind: str) -> tuple[DataFrame, T.StructType]:
    rest = df.select(*(F.col(f"`{c}`") for c in df.columns if c != name))
    return rest, T.StructType([*rest.schema.fields, *T.StructType.fromDDL(f"{name} {kind}").fields])


def _lists(rows: list[list[int]]) -> pa.ListArray:
    values = np.fromiter(chain.from_iterable(rows), np.int32, sum(map(len, rows)))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), pa.array(values))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", name: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the text's token ids (array of int); a column that is called ``name`` already is replaced.

    Null and empty texts have no ids.  Bytes that are not UTF-8 count as U+FFFD.  Rows are independent, so repeated rows repeat, and an empty
    table gives an empty table.  Special tokens are ordinary text.
    """
    rest, schema = _with_column(docs, name, "array<int>")
    shared = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary(read_ranks(path))))  # of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = shared.value  # stays with the Python worker, and so does the encoder with the pieces it has met
        if "encoder" not in worker:
            worker["encoder"] = Encoder(worker, pattern)
        encoder = worker["encoder"]
        for part, texts in bounded_slices(batches, text_col, SLICE):
            ids = _lists([encoder.encode(t.decode("utf-8", "replace")) for t in texts])
            yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, name])

    return rest.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the bytes of its token ids; a column that is called ``name`` already is replaced.  Null ids have no bytes."""
    rest, schema = _with_column(df, name, "binary")
    tokens = {rank: token for token, rank in read_ranks(path).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * SLICE // max(1, batch[ids_col].nbytes))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                ids, sizes = part[ids_col].flatten().to_pylist(), pc.fill_null(pc.list_value_length(part[ids_col]), 0).to_pylist()
                ends = list(accumulate(sizes))
                found = [b"".join(map(tokens.__getitem__, ids[end - n:end])) for n, end in zip(sizes, ends)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*part.schema.names, name])

    return rest.mapInArrow(run, schema)
