"""Trained models: language, quality and the masked language model."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithgraph.llm import langid, lm, quality

LANGS = {"aa": ["the", "and", "of", "with", "thing", "other", "ship"], "bb": ["der", "und", "schön", "nicht", "über", "keit", "ung"],
         "cc": ["que", "ción", "los", "mente", "niño", "para", "una"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(LANGS[lang], k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def labelled(seed, n):
    rng = random.Random(seed)
    return [(i, text(rng, lang, rng.randint(3, 60)), lang) for i in range(n) for lang in [rng.choice(list(LANGS))]]


def slow_forward(word: bytes, p: dict[bytes, float]) -> float:
    """Sum over all segmentations, written out as a recursion."""
    if not word:
        return 1.0
    return sum(p[word[:k]] * slow_forward(word[k:], p) for k in range(1, len(word) + 1) if word[:k] in p)


def test_word_probability_sums_all_segmentations():
    vocabulary = sorted({bytes([b]) for b in range(256)} | {b" t", b"th", b"he", b" the", b"the", "é".encode(), b"ab", b"aba", b"ba"})
    rng = np.random.default_rng(0)
    p = rng.random((len(vocabulary), 2))
    p /= p.sum(axis=0)
    words = langid.Words(["the THE ababa", "été thé x"])
    logs = langid.word_logs(words, langid.Pieces(vocabulary), p)
    for w in range(len(words.start)):
        own = words.data[words.start[w]:words.start[w] + words.length[w]]
        for k in range(2):
            assert math.isclose(logs[w, k], math.log(slow_forward(own, dict(zip(vocabulary, p[:, k])))), rel_tol=1e-9)


def test_expected_counts_spell_the_words_and_training_raises_the_likelihood():
    vocabulary = langid.read_pieces()
    rows = labelled(1, 60)
    words, pieces = langid.Words([t for _, t, _ in rows]), langid.Pieces(vocabulary)
    weights = np.ones((len(words.start), 1))
    p = np.full((len(vocabulary), 1), 1 / len(vocabulary))
    before = langid.word_logs(words, pieces, p).sum()
    counts = langid.expected_counts(words, weights, pieces, p)
    assert math.isclose((counts[:, 0] * [len(v) for v in vocabulary]).sum(), words.length.sum(), rel_tol=1e-9)
    assert langid.word_logs(words, pieces, counts / counts.sum() + 1e-12).sum() > before


def test_very_long_words_do_not_overflow():
    model = langid.fit(["the ship " * 5, "der und " * 5], ["aa", "bb"], langid.read_pieces())
    langs, score = langid._score(["x" * 50_000 + " the ship", "漢" * 3000, None, "", "12 ?!", "É"], model, langid.Pieces(model.pieces))
    assert np.isfinite(score).all() and langs[2:5] == ["und"] * 3 and langs[5] != "und" and list(score[2:5]) == [0, 0, 0]


def test_held_out_languages(documents, spark):
    rows = labelled(2, 400) + [(900, None, "aa"), (901, "", "bb"), (902, "42 !", "cc"), (904, "½ ² ⅓ ①② Ⅳ", "cc"), (903, "the thing", None), (1, "der und keit", "bb"), (1, "der und keit", "bb")]
    docs = documents(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(docs, F.col("doc_id") % 4 != 2, per_language=80)
    found = langid.identify(docs, model).filter("doc_id % 4 = 2 AND doc_id < 900").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found)
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).filter("doc_id >= 900").collect()}
    assert odd[900] == odd[901] == odd[902] == odd[904] == ("und", 0.0) and odd[903][0] == "aa"
    left = langid.without_undetermined(docs, per_language=50)
    assert left.columns == docs.columns and left.count() == len(rows) - 4


def test_language_of_empty_and_unlabelled_tables(documents):
    schema = "doc_id long, text string, lang string"
    empty = documents([], schema)
    assert langid.identify(empty, langid.train(empty)).collect() == [] and langid.without_undetermined(empty).collect() == []
    some = documents([(1, "words", None), (2, "?", None)], schema)
    assert [r["lang_pred"] for r in langid.identify(some, langid.train(some)).collect()] == ["und", "und"]
    assert [r["doc_id"] for r in langid.without_undetermined(some).collect()] == [1]


def quality_rows(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        good = text(rng, rng.choice(list(LANGS)), rng.randint(20, 80))
        bad = rng.choice([" | ".join(good.split()), " ".join(w + "%%%" for w in good.split()), (good.split()[0] + " ") * 60])
        out.append((i, good, 1) if rng.random() < 0.8 else (i, bad, 0))
    return out


def test_quality_on_held_out_rows(spark, documents):
    rows = quality_rows(4, 500)
    docs = documents([(i, t) for i, t, _ in rows] + [(900, None), (901, "")]).repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1, None), (7777, 1), (None, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.col("doc_id") % 3 != 1, per_label=150)
    assert np.array_equal(model.weights, quality.train(docs.repartition(2), labels, F.col("doc_id") % 3 != 1, per_label=150).weights)
    truth = {i: q for i, _, q in rows}
    scored = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [i for i in truth if i % 3 == 1]
    assert sum((scored[i] >= 0.5) == truth[i] for i in held) >= 0.97 * len(held)
    assert 0 <= scored[900] <= 1 and scored[900] == scored[901]


def test_quality_features_by_hand():
    import collections

    row, index, value = quality.features([b"a b, a b, a", b""])
    mine = dict(zip(index[row == 0].tolist(), value[row == 0].tolist()))
    # tokens a b , a b , a: 7 of them, 3 + 3 + 3 distinct n-grams; two 3-grams come again; no word comes again within two tokens
    assert len(mine) == 9 + 3 and math.isclose(sum(v * v for v in mine.values()), 1.0)
    assert math.isclose(mine[quality.REPEATS] / mine[quality.BIAS], math.log(3) / math.log(2)) and mine[quality.DOUBLED] == 0
    assert collections.Counter(index[row == 1].tolist()) == {quality.BIAS: 1, quality.REPEATS: 1, quality.DOUBLED: 1}


def test_quality_without_examples(spark, documents):
    model = quality.train(documents([]), spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in quality.score(documents([(1, "x"), (2, None)]), model).collect()] == [0.5, 0.5]


def test_gradient_of_the_masked_model_by_differences():
    rng = np.random.default_rng(1)
    net = lm.Network.start(np.full(lm.SIZE, 1 / lm.SIZE))
    side, token, n = rng.integers(0, lm.SIZE ** 2, 40), rng.integers(0, lm.SIZE, 40), rng.integers(1, 9, 40)
    _, slope = net.gradient(side, token, n)
    for k, at in ((0, (int(side[0] // lm.SIZE), 3)), (1, (int(side[0] % lm.SIZE), 5)), (2, (7,)), (3, (2, int(token[0]))), (4, (int(token[1]),))):
        losses = []
        for step in (1e-5, -1e-5):
            net.parts[k][at] += step
            losses.append(net.gradient(side, token, n)[0])
            net.parts[k][at] -= step
        assert math.isclose((losses[0] - losses[1]) / 2e-5, slope[k][at], rel_tol=1e-4, abs_tol=1e-4)


def test_masked_scores_agree_with_the_network_token_by_token(documents):
    rng = random.Random(6)
    rows = [(i, text(rng, "aa", 30)) for i in range(40)] + [(90, None), (91, " \n"), (92, "one"), (93, "the, 42 !! " * 400), (0, "a second row")]
    docs = documents(rows).repartition(3)
    model = lm.train(docs, steps=8)
    assert model.losses[-1] < model.losses[0]
    got = {(r["doc_id"], r["text"]): r for r in lm.score(docs, model).collect()}
    for d, t in rows:
        tokens = lm.Tokens([(t or "").encode()])
        ids = [lm.EDGE, *tokens.ids(model.names).tolist(), lm.EDGE]
        want = sum(model.network.logs(np.array([a]), np.array([c]))[1][0, b] for a, b, c in zip(ids, ids[1:], ids[2:]))
        assert got[d, t]["n_tokens"] == len(ids) - 2 and math.isclose(got[d, t]["log_prob"], want, rel_tol=1e-9, abs_tol=1e-12)
        assert (got[d, t]["mean_log_prob"] is None) == (len(ids) == 2)


@pytest.mark.parametrize("known", [1, 20, 1 << 40])
def test_every_token_has_a_probability_of_its_own(documents, known):
    rng = random.Random(7)
    rows = [(i, text(rng, "bb", 30) + "".join(rng.choices("abcdefg", k=5))) for i in range(60)]
    rows += [(70, rows[3][1]), (71, None), (72, ""), (73, "zyxwv"), (74, "zyxwv"), (75, "vwxyz"), (76, "vwxyz vwxyz"), (75, "again the same id")]
    docs = documents(rows).repartition(3)
    counts = lm.token_counts(docs)
    model = lm.train(docs, steps=3, counted=counts)
    assert model.names.tolist() == lm.train(docs, steps=0).names.tolist()
    counted, spread = {}, {}
    for _, t in rows:
        tokens = lm.Tokens([(t or "").encode()])
        for name, i, kind in zip(tokens.names.tolist(), tokens.ids(model.names).tolist(), tokens.rare.tolist()):
            if i >= lm.FREQUENT:
                counted[name] = counted.get(name, 0) + 1
                spread[kind] = spread.get(kind, 0) + 1
    new = rows + [(99, "qqqqq neverseen 77")]
    got = sorted(lm.score_whole(documents(new).repartition(2), model, counts, known=known).collect(), key=lambda r: (r["doc_id"], r["text"] or ""))
    assert len(got) == len(new) and len(counted) > 50
    for r in got:
        tokens = lm.Tokens([(r["text"] or "").encode()])
        ids = [lm.EDGE, *tokens.ids(model.names).tolist(), lm.EDGE]
        want = sum(model.network.logs(np.array([a]), np.array([c]))[1][0, b] for a, b, c in zip(ids, ids[1:], ids[2:]))
        want += sum(math.log(counted.get(n, 1) / (spread.get(i, 0) + 1)) for n, i in zip(tokens.names.tolist(), ids[1:]) if i >= lm.FREQUENT)
        assert r["n_tokens"] == len(ids) - 2 and math.isclose(r["log_prob"], want, rel_tol=1e-8, abs_tol=1e-9)
        assert r["mean_log_prob"] == (None if len(ids) == 2 else r["log_prob"] / r["n_tokens"])
    alone, twice = (next(r["mean_log_prob"] for r in got if r["doc_id"] == d) for d in (75, 76))
    assert twice != alone


def test_masked_model_of_an_empty_table(documents):
    model = lm.train(documents([]), steps=2)
    assert lm.score(documents([]), model).collect() == [] and lm.score(documents([(1, "x y")]), model).first()["n_tokens"] == 2


def test_whole_scores_of_an_empty_table(documents):
    none = lm.token_counts(documents([]))
    assert lm.score_whole(documents([(1, "x y")]), lm.train(documents([]), steps=2, counted=none), none).first()["n_tokens"] == 2
