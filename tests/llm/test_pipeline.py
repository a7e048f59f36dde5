"""The pipeline's stages on documents with planted cases."""

import random

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, base = prose(80), prose(150)
    rows = [(10_000 + i, prose(60)) for i in range(30)]
    rows += [(20_001, base), (20_000, base), (20_002, base)]
    rows += [(30_000, prose(50) + " " + passage + " " + prose(50)), (30_001, prose(50) + " " + passage + " " + prose(70))]
    rows += [(40_000, None), (40_001, "")]
    return spark.createDataFrame([(i, t, "en", "src1", len(t or ""), "extra") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, row string")


def test_copies_go(spark, docs):
    ids = {r.doc_id for r in corpus_pipeline.without_copies(spark, docs, SF).collect()}
    assert {20_000, 10_000, 30_000, 40_000} <= ids and not ids & {20_001, 20_002, 40_001}


def test_repeats_are_cut(spark, docs):
    out = corpus_pipeline.without_repeats(spark, docs, SF)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert 20_000 not in rows and rows[10_003].n_chars == len(rows[10_003].text)
    assert rows[30_000].n_chars == len(rows[30_000].text) < 800 and rows[40_000].text is None and rows[40_001].text == ""


def test_stages_keep_the_columns_and_clean_documents(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.where("doc_id between 10000 and 10029").count() == 30
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_delivers_documents(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "epoch", "n_tokens"} <= set(out.columns)
