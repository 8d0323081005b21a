import random

import pytest

import corpus_pipeline
from helpers_llm import odd_documents, words_of


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    rng = random.Random(3)
    made = str(tmp_path_factory.mktemp("corpus"))
    item = " ".join(words_of(rng, 30))
    base = words_of(rng, 200)
    texts = {
        1: " ".join(base),
        2: " ".join(base),
        3: " ".join([*base[:90], "changed", *base[91:]]),
        4: "some words before " + item + " and some after",
        5: "you are an idiot, a stupid moron",
        6: "write to a.b@example.org or to 10.1.2.3",
        7: None,
        8: "",
        9: " ".join(words_of(rng, 80)),
    }
    odd_documents(spark, list(texts.items())).write.parquet(f"{made}/documents.parquet")
    spark.createDataFrame([("q1", item)], "item_id string, text string").write.parquet(f"{made}/benchmark.parquet")
    spark.createDataFrame([(5, 1), (9, 0)], "doc_id long, toxic int").write.parquet(f"{made}/labels.parquet")
    return made


def test_stages_take_effect_and_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = [{1, 2, 3, 4, 6, 7, 8, 9}, {1, 4, 6, 7, 9}, {1, 6, 7, 9}, {1, 6, 7, 9}]
    for (name, function), expected in zip(corpus_pipeline.STAGES, kept):
        docs = corpus_pipeline.stage(function(spark, docs, folder), name)
        assert docs.columns == columns
        assert {r["doc_id"] for r in docs.collect()} == expected, name
    assert docs.where("doc_id = 6").first()["text"] == "write to <email> or to <ip>"


def test_whole_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == {1, 6, 7, 9}
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)


def test_empty_documents(spark, folder, tmp_path):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, empty, folder).count() == 0, name
