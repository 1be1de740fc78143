"""Each stage against a plain version, on its own input."""

import hashlib
import os

import corpus_pipeline as cp
import pytest
from test_line_dedup import plain as deduped
from test_mixing import docs_of, draws
from test_simhash import groups
from test_simhash import plain as fingerprint

from strandloom.llm import sp_dropout


@pytest.fixture
def docs(table, odd):
    line = "this line of some length is in many documents of the corpus"
    texts = [f"{line} number {i % 4}\nand a line of its own {i * 7919} here\n{line}" for i in range(12)]
    return table(texts + ["alpha beta gamma delta epsilon"] * 3 + odd, langs=["en"] * 15 + [None] * len(odd)).select(*cp.COLUMNS)


def test_language_stage_drops_what_it_cannot_tell(spark, docs):
    out = cp.language_id(spark, docs, "")
    assert out.columns == cp.COLUMNS
    want = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in out.collect()} == want and {r.lang for r in out.collect()} == {"en"}


def test_language_is_found_once_a_document(spark, docs):
    plan = cp.language_id(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_line_stage(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    got = sorted(cp.line_deduplication(spark, docs, "").collect(), key=lambda r: r.doc_id)
    assert [r.text for r in got] == deduped([r.text for r in rows])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_near_stage_keeps_the_first_of_each_group(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    ids = [r.doc_id for r in rows]
    got = sorted(r.doc_id for r in cp.near_dedup(spark, docs, "").collect())
    assert got == sorted(set(groups([fingerprint(r.text) for r in rows], ids)))


def test_mixing_stage(spark, docs):
    out = cp.source_mixing(spark, docs, "")
    assert out.columns == cp.COLUMNS
    want = sorted(i for i, _ in draws(docs_of(docs), None))
    assert sorted(r.doc_id for r in out.collect()) == want


@pytest.mark.skipif(not os.path.exists(sp_dropout.MODEL), reason="no tokenizer files here")
def test_copies_of_a_document_are_cut_apart(spark, table):
    docs = table(["one source has this short text about unbelievable anthropomorphism"] + ["words of another source " * 60] * 4).select(*cp.COLUMNS)
    stages = dict(cp.STAGES)
    mixed = stages["mixing"](spark, docs, "")
    out = stages["SentencePiece"](spark, mixed, "").collect()
    same = [r.pieces_sha256 for r in out if r.doc_id == 0]
    assert len(out) == mixed.count() and len(same) > 1 and len(set(same)) > 1


@pytest.mark.skipif(not os.path.exists(sp_dropout.MODEL), reason="no tokenizer files here")
def test_last_stage_and_the_whole(spark, docs, tmp_path):
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in cp.sentencepiece(spark, docs, "").collect():
        assert r.lossless and r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    whole = cp.run(spark, str(tmp_path))
    step = docs
    for _, f in cp.STAGES:
        step = f(spark, step, str(tmp_path))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, step.collect()), key=str)
    assert [k for k, _ in cp.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing", "SentencePiece"]
