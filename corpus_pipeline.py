"""A training corpus from raw documents, in stages that are each written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.llm import golay, packing, pii, toxicity, winnowing
from filewright.llm.store import attach, fresh, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject; NULL and empty texts stay."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(toxicity.training_texts(docs, labels))
    return docs.where(model.score(F.col("text")) < 0.5)


def without_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of copies and near copies, that of the least id."""
    return golay.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text")
    identity, mark = fresh(docs, "hit_id"), fresh(docs, "hit_digest")
    hits = winnowing.contaminated(docs, items).toDF(identity, mark)
    digest = fresh(docs, "text_digest")
    joined = attach(docs.withColumn(digest, F.xxhash64("text")), ["doc_id", digest], stage(hits, "contaminated"), [identity, mark])
    return joined.where(F.col(mark).isNull()).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with their personal data replaced by its kind."""
    return pii.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of training sequences along the curve."""
    found = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
