"""The corpus pipeline stage by stage against plain Python on a small corpus."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from kithgraph.llm import mixing, pii
from tests.llm.test_decontaminate import words
from tests.llm.test_models import text
from tests.llm.test_similar import brute_first

ITEM = "one item of the benchmark that nobody may learn from before the test"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = [(i, text(rng, lang, rng.randint(30, 90)), lang, f"src{i % 4}") for i in range(90) for lang in [rng.choice(["aa", "bb", "cc"])]]
    base = rows[3][1].split()
    rows += [(100 + k, " ".join(base[:k] + ["changed"] + base[k + 1:]), "aa", "src0") for k in (2, 9)]
    rows += [(110, rows[5][1], "bb", "src1"), (111, f"{rows[6][1]} {ITEM} {rows[7][1]}", "cc", None), (112, f"Write to me@mail.example.com {rows[8][1]}", "aa", "src2"),
             (116, f"Write to you@mail.example.com {text(rng, 'aa', 50)}", "aa", "src2"), (113, None, None, None), (114, "12 34 !", None, "src3"), (115, "", "aa", "src3")]
    rows += [rows[10]]
    where = str(tmp_path_factory.mktemp("corpus"))
    frame = [(d, t, lang, s, len(t) if t is not None else None) for d, t, lang, s in rows]
    spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, results = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), "stage")
        assert docs.columns == columns
        results.append([tuple(r) for r in docs.collect()])
    source = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    language, single, clean, private, mixed = results
    assert Counter(language) == Counter(r for r in source if r[0] not in (113, 114, 115))
    order = sorted(language)
    first, _ = brute_first([(i, r[1]) for i, r in enumerate(order)])
    assert Counter(single) == Counter(order[i] for i in first) and not {110, 112} & {r[0] for r in single}
    assert Counter(clean) == Counter(r for r in single if " ".join(words(ITEM)[:10]) not in " ".join(words(r[1])))
    assert 111 not in {r[0] for r in clean} and len(single) - len(clean) == 1
    before, after = {r[0]: r for r in clean}, {r[0]: r for r in private}
    assert before.keys() == after.keys()
    changed = [d for d in before if before[d] != after[d]]
    assert changed == [116] and "you@mail.example.com" not in after[116][1] and after[116][4] == len(after[116][1])
    assert len(pii.detect(after[116][1])) == 1
    copies = {r["id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(private, spark.read.parquet(f"{folder}/documents.parquet").schema)).collect()}
    assert Counter(mixed) == Counter({r: copies[r[0]] for r in private if copies[r[0]]})


def test_run_gives_the_last_stage(spark, folder):
    assert len(corpus_pipeline.run(spark, folder).collect()) > 50
