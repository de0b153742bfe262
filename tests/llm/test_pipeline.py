"""The pipeline's stages against plain versions of their decisions."""

import importlib

import pytest

from tests.llm.test_ngram_join import all_pairs
from tests.llm.test_suffix_dedup import plain

pipeline = importlib.import_module("corpus_pipeline")


def test_stages_are_the_dealt_ones():
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "personal_data", "length_packing"]


def test_each_stage_by_its_plain_version(spark, sf, real_docs):
    from vigilo.llm import pii, quality_rules
    from vigilo.llm.common import written
    docs, tables = real_docs, [real_docs]
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        tables.append(docs)
        if name != "length_packing":
            assert docs.columns == real_docs.columns
    rows = [{r.doc_id: r for r in t.collect()} for t in tables[:5]]
    verdicts = {r.doc_id: r.kept for r in quality_rules.quality_rules(real_docs).collect()}
    assert set(rows[1]) == {i for i, keep in verdicts.items() if keep}
    classes = all_pairs({i: r.text for i, r in rows[1].items()})
    assert set(rows[2]) == {c for c, _ in classes.values()}
    removed = {x[0]: x for x in plain([(i, r.text) for i, r in rows[2].items()])}
    for i, r in rows[3].items():
        before = rows[2][i].text
        if removed[str(i)][2] == 0:
            assert r.text == before
        else:
            assert len(r.text.encode()) <= len(before.encode()) - removed[str(i)][2]
    for i, r in rows[4].items():
        assert pii.base_spans(r.text) == [] or r.text != rows[3][i].text
        assert (r.lang, r.source) == (rows[3][i].lang, rows[3][i].source) and r.n_chars == len(r.text)
    per_doc = {}
    for r in tables[5].collect():
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + r.n_words
    assert per_doc == {i: len(r.text.encode().split()) for i, r in rows[4].items() if r.text.split()}


@pytest.mark.parametrize("number", range(5))
def test_stages_take_odd_and_empty_tables(number, spark, sf, odd_docs, no_docs):
    name, stage = pipeline.STAGES[number]
    out = stage(spark, odd_docs, sf)
    assert out.count() > 0 or name == "quality_rules"  # which may reject them all
    if number < 4:
        assert out.columns == odd_docs.columns
    assert stage(spark, no_docs, sf).count() == 0


def test_run_equals_its_stages(spark, sf):
    assert pipeline.run(spark, sf).count() > 0
