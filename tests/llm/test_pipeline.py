"""The pipeline's stages on a small corpus, each against what brute force would keep."""

from __future__ import annotations

import random

import pytest
from test_operators import VOCABULARY, brute_components, brute_lines, prose

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    item = " ".join(rng.choices(VOCABULARY, k=40))
    clean = [prose(rng, rng.randint(40, 120)) for _ in range(25)]
    shared = prose(rng, 45)
    texts = clean + [clean[0], clean[1].replace(" ", "  ")]
    texts += [f"{prose(rng, 40)}\n{shared}", f"{prose(rng, 40)}\n{shared}", prose(rng, 30) + " " + item, "| ".join(VOCABULARY[:50]), "few words", "", None, "same again " * 40]
    rows = [(k, t, None if k % 3 else "xx", f"s{k % 2}", None if t is None else len(t)) for k, t in enumerate(texts)] + [(None, prose(rng, 60), None, None, None), (5, clean[5], "xx", "s1", len(clean[5]))]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]

    kept = stages["quality_rules"](spark, docs, folder)
    assert kept.columns == names
    before = {(r.doc_id, r.text) for r in docs.collect()}
    after = {(r.doc_id, r.text) for r in kept.collect()}
    assert {x[0] for x in before - after} == {30, 31, 32, 33, 34}  # signs, few words, empty, null, repeated words

    lines = stages["line_dedup"](spark, kept, folder)
    assert lines.columns == names
    rows = [r for r in kept.collect() if r.doc_id is not None]
    want = brute_lines([(r.doc_id, r.text) for r in rows])
    got = {r.doc_id: r for r in lines.collect() if r.doc_id is not None}
    for r in rows:
        text = want.get((r.doc_id, r.text), r.text)
        assert (r.doc_id in got) == bool(text.strip())
        if text.strip():
            assert (got[r.doc_id].text, got[r.doc_id].n_chars) == (text, len(text))
    assert want

    unique = stages["near_dedup"](spark, lines, folder)
    assert unique.columns == names
    rows = [r for r in lines.collect() if r.doc_id is not None]
    whole = brute_components([(r.doc_id, r.text) for r in rows], 80)
    assert {str(r.doc_id) for r in unique.collect() if r.doc_id is not None} == {i for i, _, c in whole if i == c}

    safe = stages["decontamination"](spark, unique, folder)
    assert safe.columns == names
    assert {r.doc_id for r in unique.collect()} - {r.doc_id for r in safe.collect()} == {29}

    packed = stages["packing"](spark, safe, folder)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in safe.collect()}
    assert {str(r.doc_id) for r in corpus_pipeline.run(spark, folder).collect()} == {str(r.doc_id) for r in packed.collect()}


def test_rows_without_an_id_or_with_a_shared_one(spark, tmp_path):
    rng = random.Random(4)
    item, one, two, three = (prose(rng, 40) for _ in range(4))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    rows = [(1, one), (None, one), (2, two), (2, two), (2, two), (3, three), (3, f"x {item} y"), (None, f"{item} z"), (None, "a b c " + three), (4, None), (None, None)]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    unique = stages["near_dedup"](spark, docs, f"file://{tmp_path}")
    left = sorted((str(r.doc_id), r.text) for r in unique.collect() if r.text)
    assert left == sorted([("1", one), ("2", two), ("3", three), ("3", f"x {item} y")])
    safe = stages["decontamination"](spark, docs, f"file://{tmp_path}")
    assert sorted((str(r.doc_id), str(r.text)) for r in safe.collect()) == sorted((str(i), str(t)) for i, t in rows if not t or item not in t)


def test_an_empty_corpus(spark, folder):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
