"""The pipeline against its stages, checked one by one."""

import importlib.util
import re

import pytest

import corpus_pipeline
from tonemark.llm import neighbour_quality

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        out.append((name, docs))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "exact_dedup", "ngram_jaccard", "decontamination", "packing",
    ]
    for name, df in stages:
        assert sorted(df.columns) == sorted(COLUMNS), name


def test_rejected_documents_go(spark, stages):
    docs, kept = stages[0][1], stages[1][1]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = neighbour_quality.score(docs, labels).collect()
    assert ids(kept) == {r.doc_id for r in scores if r.predicted == 1}


def test_largest_of_equal_texts_stays(stages):
    best = {}
    for r in stages[1][1].collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert ids(stages[2][1]) == set(best.values())


def test_one_of_near_copies_stays(stages):
    from llm.test_copies import brute_near

    rows = [(r.doc_id, r.text) for r in stages[2][1].collect()]
    assert ids(stages[3][1]) == {own for _, own, _ in brute_near(rows)}


def test_holders_of_items_go(spark, stages):
    def plain(text):
        return " " + " ".join(re.findall(r"\w+", text.lower())) + " "

    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: plain(r.text) for r in stages[3][1].collect()}
    assert ids(stages[4][1]) == {d for d, t in rows.items() if not any(i in t for i in items)}


def test_run(spark, stages):
    pieces = corpus_pipeline.run(spark, SF)
    assert ids(pieces) == ids(stages[4][1])
    assert importlib.util.find_spec("__spark_entry__") is not None
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
