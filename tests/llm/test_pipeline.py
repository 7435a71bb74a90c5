"""The pipeline, stage by stage against plain versions of each stage."""

import re
from collections import defaultdict

import corpus_pipeline
import pytest
from test_decontam import _brute as leaks_brute
from test_neardup import _brute as classes_brute
from test_pii import _base

from driftloom.llm import langid, packing
from driftloom.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after each stage."""
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], SF), name))
    return docs


def _ids(df):
    return {r.doc_id for r in df.collect()}


def test_columns_stay(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_language_rejects_what_it_cannot_tell(stages):
    model = langid.fit(stages[0])
    rows = langid.predict(stages[0], model).collect()
    assert _ids(stages[1]) == {r.doc_id for r in rows if r.lang_pred != "und" and r.lang_score >= 0.5}
    assert len(_ids(stages[1])) > 0.9 * len(rows)


def test_one_of_each_class_stays(stages):
    classes = classes_brute([(r.doc_id, r.text) for r in stages[1].collect()])
    assert _ids(stages[2]) == set(classes.values())


def test_leaks_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert _ids(stages[3]) == {d for d, _ in docs} - {d for d, _ in leaks_brute(docs, items)}


def test_personal_data_is_replaced(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    after = {r.doc_id: (r.text, r.n_chars) for r in stages[4].collect()}
    assert set(before) == set(after)
    for d, text in before.items():
        new, size = after[d]
        assert size == len(new) and not [s for s in _base(new) if s[0] in ("email", "ip", "card")]
        if not _base(text) and not re.search(r"\d|@", text):
            assert new == text


def test_packing_holds_every_token(stages):
    want = {(r.doc_id, r.start, r.ids_crc32) for r in packing.pack(stages[4]).collect()}
    rows = stages[5].collect()
    assert {(r.doc_id, r.start, r.ids_crc32) for r in rows} == want
    by_doc, ends = defaultdict(int), {}
    for r in rows:
        by_doc[r.doc_id] += r.length
        ends[r.doc_id] = r.doc_tokens
    assert dict(by_doc) == ends and set(by_doc) == _ids(stages[4])


def test_run_is_all_stages(spark, stages):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages[5].collect()))


@pytest.mark.parametrize("which", ["odd_docs", "no_docs", "clashing_docs"])
def test_odd_documents_pass_through(spark, request, which):
    docs = request.getfixturevalue(which)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.collect()} == _ids(docs)
