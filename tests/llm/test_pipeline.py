"""The pipeline's stages and its whole run against plain Python."""

import re

import pytest

from sarspark.llm import quality

from .test_pairs import EDGE, frame, slow_components, slow_fingerprint, slow_shingles, slow_spans
from .test_rows import check_pieces

pipeline = pytest.importorskip("corpus_pipeline")


def test_run_against_brute_force(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    docs = {r.doc_id: r for r in table.collect()}
    kept = {r.doc_id for r in quality.score(table).where("kept").collect()}
    assert all(len((docs[i].text or "").split()) >= 20 for i in kept)
    fps = {i: slow_fingerprint(docs[i].text) for i in kept}
    comp = slow_components(set(fps.values()))
    one = {}
    for i in sorted(kept, reverse=True):
        one[comp[fps[i]]] = i
    items = [slow_shingles(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    clean = [i for i in one.values() if not any(s and len(s & slow_shingles(docs[i].text)) >= 0.8 * len(s) for s in items)]
    stage, now = {}, table
    for name, f in pipeline.STAGES[:-1]:
        now = f(spark, now, data)
        assert now.columns == table.columns
        stage[name] = {r.doc_id: r.text for r in now.collect()}
    assert set(stage["quality rules"]) == kept and set(stage["near-duplicates"]) == set(one.values())
    assert set(stage["benchmark decontamination"]) == set(clean) == set(stage["personal data"])
    for i, text in stage["personal data"].items():
        assert not slow_spans(text)
        if not slow_spans(docs[i].text):
            assert text == docs[i].text
    check_pieces(pipeline.run(spark, data).collect(), list(stage["personal data"].items()))


def test_stages_take_odd_rows(spark, data):
    docs = frame(spark, EDGE).select("doc_id", "text", "lang", "source", "n_chars")
    for name, f in pipeline.STAGES:
        for d in (docs, docs.limit(0), docs.unionByName(docs)):
            out = f(spark, d, data).collect()
            assert d.count() or not out, name


def test_names():
    assert [re.sub("[^a-z -]", "", n) for n, _ in pipeline.STAGES] == ["quality rules", "near-duplicates", "benchmark decontamination", "personal data", "packing"]
