"""Byte-pair ids against the tokenizer's own library, and round trips."""

from __future__ import annotations

import random
import time

import public_tokenizers
import pytest
import tiktoken

from kithgraph.llm import bytepairs

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bytepairs.read_ranks(PATH)
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bytepairs.Encoder(vars(bytepairs.Vocabulary(RANKS)), public_tokenizers.PATTERN)


def hard_texts() -> list[str]:
    rng = random.Random(6)
    letters = "aeiou thns'\n\t 0123éßçñüöжщ日本語तमिแ🙂‍́½Ⅳ<|endoftext|>"
    texts = ["", " ", "\n\n  \n", "I'll we've 'S", "a\x1cb\x1d \x1e\x1f c\x85d\xa0e\u2028f\u3000 \u200bg\u180eh", "<|endoftext|>", "\x00\x7f", "a" * 700, "ab" * 400, " " * 300 + "x", "=" * 500, "日本語" * 200, "é" * 333, "🙂" * 99]
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 300))) for _ in range(150)]
    texts += ["".join(rng.choices("abcdefgh", k=rng.randint(50, 400))) for _ in range(60)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x370, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(60)) for _ in range(60)]
    return texts


def test_encoder_agrees_with_the_library():
    for text in hard_texts():
        assert list(ENCODER.encode(text)) == OWN.encode_ordinary(text), text
        assert [t for p in ENCODER.pattern.findall(text) for t in ENCODER._piece(p.encode())] == OWN.encode_ordinary(text), text


@pytest.mark.parametrize("seed", range(3))
def test_random_vocabularies_agree_with_the_library(seed):
    """Few letters and many merges: back steps happen all the time, and some tokens can't be reached by merges."""
    rng = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}
    tokens = [b"a", b"b", b"c"]
    while len(ranks) < 330:
        token = rng.choice(tokens) + rng.choice(tokens)
        if token not in ranks:
            ranks[token] = len(ranks)
            tokens.append(token)
    for _ in range(10):
        token = bytes(rng.choices(b"abc", k=rng.randint(3, 5)))
        ranks.setdefault(token, len(ranks))
    encoder = bytepairs.Encoder(vars(bytepairs.Vocabulary(ranks)), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for _ in range(400):
        text = "".join(rng.choices("abc", k=rng.randint(1, 80)))
        assert list(encoder.encode(text)) == own.encode_ordinary(text), text


def test_time_grows_with_length():
    rng = random.Random(1)

    def seconds(n):
        text = "".join(rng.choices("abcdefghij", k=n))
        start = time.process_time()
        ENCODER.encode(text)
        return time.process_time() - start

    seconds(20_000)
    assert seconds(400_000) < 40 * max(seconds(40_000), 0.02)


def test_frames(spark, documents):
    texts = [None, *hard_texts()[:80], "word " * 60_000, "x" * 300_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "no id"), (5, None)]
    docs = documents(rows).withColumnRenamed("id", "ids").withColumnRenamed("fp", "decoded")
    got = bytepairs.decode(bytepairs.encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    assert set(got.columns) == set(docs.columns)
    found = sorted(((r["doc_id"], r["text"], r["ids"], bytes(r["decoded"]), r["key"]) for r in got.collect()), key=repr)
    assert found == sorted(((i, t, OWN.encode_ordinary(t or ""), (t or "").encode(), "x") for i, t in rows), key=repr)
    assert bytepairs.decode(bytepairs.encode(docs.limit(0), PATH, public_tokenizers.PATTERN), PATH).collect() == []
