"""The pipeline's stages, each on what the one before kept."""

import hashlib

import pytest
from llm_fixtures import SCHEMA, rows, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    cols, ids = d.columns, {r.doc_id for r in d.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = d
        d = stage(spark, d, sf).persist()
        now = {r.doc_id for r in d.select("doc_id").collect()}
        assert now <= ids and now, name
        if k < 4:
            assert d.columns == cols
        if k == 0:
            assert all(len(words(r.text)) >= 50 for r in d.collect())
        if k == 4:
            import public_tokenizers

            from zephyrine.llm.token_counts import load

            t = load(public_tokenizers.path("word_bpe_49k.json"))
            want = {r.doc_id: hashlib.sha256(" ".join(map(str, t.encode(r.text, add_special_tokens=False).ids)).encode()).hexdigest() for r in before.collect()}
            assert {r.doc_id: r.ids_sha256 for r in d.collect()} == want
        ids = now


def test_copies_go_as_a_whole(spark):
    """A later copy leaves neither a stub of its short lines nor blank lines; untouched blank texts stay."""
    text = "Short.\n\nA line that is long enough to be held.\n\n\t\nAnother line of more than that many signs.\nEnd"
    d = spark.createDataFrame(rows([(1, text), (2, text), (3, text + "\nNew"), (4, " \n\n"), (5, None)]), SCHEMA)
    got = {x.doc_id: x.text for x in corpus_pipeline.lines(spark, d, "").collect()}
    assert set(got) == {1, 3, 4, 5} and got[1] == text and got[3].strip() == "New" and got[4] == " \n\n" and got[5] is None
