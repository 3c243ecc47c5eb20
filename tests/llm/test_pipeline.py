"""The pipeline, stage by stage, against brute force on the small tables with planted rows."""

from __future__ import annotations

import re

import pytest
from test_corpus_operators import brute_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = base.orderBy("doc_id").first()
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()
    rows = [
        (90001, first.text + " tail", first.lang, "s", 1), (90002, item.text, "en", "s", 1), (90003, None, None, "s", None), (90004, "... 123", None, "s", 7),
        (90005, first.text[:300] + ' token = "0123456789abcdef0123456789abcdef" ' + first.text[300:900], None, None, 5), (None, first.text, first.lang, "s", 1), (90006, first.text[1000:2500], first.lang, "s", 1), (90006, first.text[1000:2500], first.lang, "s", 1),
    ]
    return base.unionAll(spark.createDataFrame(rows, base.schema))


def test_stages(spark, sf_dir, docs):
    from tessera.llm.common import stage

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    steps = dict(corpus_pipeline.STAGES)

    one = stage(steps[names[0]](spark, docs, sf_dir))
    assert one.columns == docs.columns
    gone = {r.doc_id for r in docs.select("doc_id").exceptAll(one.select("doc_id")).collect()}
    assert {90003, 90004} <= gone and len(gone) <= 4
    assert one.where("lang is null").count() == 0

    two = stage(steps[names[1]](spark, one, sf_dir))
    rows = [(r.doc_id, r.text) for r in one.collect() if r.doc_id is not None]
    want = {i for i, (_, c) in brute_components(list(dict(rows).items())).items() if i == c}
    got = [r.doc_id for r in two.collect()]
    assert two.columns == docs.columns and sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1
    assert 90001 not in want and 90006 in want

    three = stage(steps[names[2]](spark, two, sf_dir))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        v = split(r.text)
        windows |= {tuple(v[k : k + 13]) for k in range(max(1, len(v) - 12)) if v}
    keep = []
    for r in two.collect():
        w, hit = split(r.text), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            keep.append(r.doc_id)
    ids = [r.doc_id for r in three.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, keep)) and 90002 not in ids

    four = stage(steps[names[3]](spark, three, sf_dir))
    before, after = ({r.doc_id: r for r in d.collect()} for d in (three, four))
    assert four.columns == docs.columns and set(before) == set(after)
    assert "[REDACTED]" in after[90005].text and after[90005].n_chars == len(after[90005].text) and "0123456789abcdef" not in after[90005].text
    for i, r in before.items():
        if "[REDACTED]" not in (after[i].text or ""):
            assert after[i].text == r.text and after[i].n_chars == r.n_chars

    five = steps[names[4]](spark, four, sf_dir).collect()
    assert {r.doc_id for r in five} == set(after)
    for d in after:
        parts = sorted((r.start, r.length) for r in five if r.doc_id == d)
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))


def test_rows_that_share_an_id(spark, sf_dir, docs):
    words = lambda k, n=60: " ".join(f"v{(k * 7919 + j * 104729) % 9973}" for j in range(n))
    rows = [(1, words(1), "en", "b", 1), (1, words(2), "en", "a", 1), (1, words(1), "en", "a", 2), (2, words(2) + " tail", "en", "s", 1), (3, words(3), "en", "s", 1), (0, words(3), "en", "s", 1), (5, None, "en", "s", 1), (5, None, "en", "s", 1)]
    step = dict(corpus_pipeline.STAGES)["near-dedup"]
    for parts in (1, 4):
        got = sorted((r.doc_id, r.text or "", r.source, r.n_chars) for r in step(spark, spark.createDataFrame(rows, docs.schema).repartition(parts), sf_dir).collect())
        assert got == sorted([(1, words(1), "a", 2), (1, words(2), "a", 1), (0, words(3), "s", 1), (5, "", "s", 1)])


def test_empty_documents(spark, sf_dir, docs):
    out = docs.where("false")
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, out, sf_dir)
    assert out.count() == 0


def test_queries_are_registered():
    import __spark_entry__ as e

    found = e.queries()
    assert "pipeline" in found
    assert all(sum(n.startswith(f"op{k}_") for n in found) == 1 for k in range(1, 11))
