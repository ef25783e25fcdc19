"""What is detected, what a surrogate keeps, and that surrogates of a corpus are distinct and stable."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from kithgraph.llm import pii


def found(text):
    return [(text[s:e], kind) for s, e, kind, _ in pii.detect(text)]


def test_detects_and_leaves_alone():
    text = ('Mail JANE.Doe+x@Mail3.example.com or 97.51.17.173; card 4111 1111 1111 1111, not 4111111111111112; call +1 (017) 555-7713. '
            'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" by Mrs. Anna Schmidt, at 999.1.1.1 and 1.2.3.4.5 in 2024-05-06, v1.2.3')
    assert found(text) == [("JANE.Doe+x@Mail3.example.com", "mail"), ("97.51.17.173", "ip"), ("4111 1111 1111 1111", "card"), ("+1 (017) 555-7713", "phone"),
                           ("04dbebab91ab85687d33eeaaf9ac699e1188f962", "secret"), ("Anna Schmidt", "name")]
    for clean in (None, "", "plain words only", "0000 0000 0000 0000", "a@b", "1234567890123456", "Dr no one", "x" * 100_000, "1 " * 20_000):
        assert pii.detect(clean) == []


@pytest.mark.parametrize("kind,value,gender", [("card", "4111-1111-1111-1111", ""), ("phone", "+1 (017) 555-7713", ""), ("ip", "97.51.17.173", ""),
                                               ("mail", "und.34@mail7.example.com", ""), ("secret", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", ""),
                                               ("name", "Anna Schmidt", "f"), ("name", "Иван Петров", "m"), ("name", "KIM LEE", "n")])
def test_surrogates_keep_type_and_form(kind, value, gender):
    entity = pii.identity(kind, value, gender)
    new = pii.in_form_of(kind, value, pii.canonical(kind, entity, 0))
    assert new != value and new == pii.in_form_of(kind, value, pii.canonical(kind, entity, 0)) != pii.in_form_of(kind, value, pii.canonical(kind, entity, 1))
    shape = lambda s: re.sub(r"\d", "0", s)
    if kind in ("card", "phone"):
        assert shape(new) == shape(value)
    if kind == "card":
        assert new[0] == value[0] and pii.luhn(re.sub(r"\D", "", new)) % 10 == 0
    if kind == "secret":
        assert re.fullmatch("[0-9A-F]{40}", new)
    if kind == "mail":
        assert re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.example\.(com|net|org)", new) and found(f"to {new} now") == [(new, "mail")]
    if kind == "ip":
        assert found(f"x {new} y") == [(new, "ip")]
    if kind == "name":
        cyrillic = bool(re.search("[а-я]", new.lower()))
        assert cyrillic == bool(re.search("[а-я]", value.lower())) and len(new.split()) == 2 and new.isupper() == value.isupper()
        assert new.split()[0].lower() in [g.lower() for g in pii.GIVEN["cyrillic" if cyrillic else "latin", gender]]


def test_coreference_across_forms():
    text = "4111 1111 1111 1111 then 4111-1111-1111-1111; A.B@Mail.example.com and a.b@mail.example.com"
    new, n = pii.rewrite(text, lambda *_: 0)
    a, b, c, d = [v for v, _ in found(new)]
    assert n == 4 and re.sub(r"\D", "", a) == re.sub(r"\D", "", b) and c.lower() == d.lower() and c != d


def test_collisions_draw_again(spark, monkeypatch):
    rows = [("ip", f"1.1.1.{i}") for i in range(200)] + [("name", f"f:anna name{i}") for i in range(300)]
    entities = spark.createDataFrame(rows, "kind string, entity string").repartition(3)
    small = {"key": b"k"}
    settled = pii.settle(entities, small["key"]).collect()
    assert sorted((r["kind"], r["entity"]) for r in settled) == sorted(rows)
    assert len({(r["kind"], r["surrogate"]) for r in settled}) == len(rows) and any(r["counter"] for r in settled)
    plain = {e.split(":")[-1] for _, e in rows}
    assert not plain & {r["surrogate"] for r in settled}
    assert sorted(map(str, settled)) == sorted(map(str, pii.settle(entities.repartition(5), small["key"]).collect()))


def test_documents_are_rewritten_consistently(documents):
    rng = random.Random(1)
    names = [f"{a} {b}" for a in ("Eva", "Rita", "Olga", "Ines", "Kira") for b in ("Alt", "Neu", "Berg", "Tal", "Wald", "Feld", "Stein", "Bach")]
    rows = [(i, " ".join(f"word{i} Mrs {rng.choice(names)}, says ip 10.0.{i}.{rng.randrange(9)}." for _ in range(rng.randint(0, 4)))) for i in range(120)]
    rows += [(500, None), (501, ""), (7, rows[7][1]), (None, "Mrs Eva Alt, once more")]
    docs = documents(rows).repartition(4)
    out = pii.replace(docs, count_name="n_found")
    assert out.columns == [*docs.columns, "n_found"]
    seen: dict[str, str] = {}
    result = sorted(((r["doc_id"], r["text"], r["n_found"]) for r in out.collect()), key=str)
    source = {(d, t) for d, t in rows}
    for (d, new, n) in result:
        olds = [t for e, t in source if e == d]
        assert any((t is None and new is None) or (t is not None and len(pii.detect(t)) == n and re.sub(r"Mrs \w+ \w+|\d+\.\d+\.\d+\.\d+", "?", t)
                                                   == re.sub(r"Mrs \w+ \w+|\d+\.\d+\.\d+\.\d+", "?", new)) for t in olds)
        for t in olds:
            for (a, _), (b, _) in zip(found(t or ""), found(new or "")):
                assert seen.setdefault(a, b) == b and a != b
    assert len(set(seen.values())) == len(seen) and not set(seen) & set(seen.values())
    assert sorted(((r["doc_id"], r["text"], r["n_found"]) for r in pii.replace(docs.repartition(2), count_name="n_found").collect()), key=str) == result


def test_empty_and_clean_tables(documents):
    assert pii.replace(documents([])).collect() == []
    clean = documents([(1, "nothing here"), (2, None)])
    assert sorted(map(str, pii.replace(clean).collect())) == sorted(map(str, clean.select(*[F.col(c) for c in clean.columns]).collect()))
