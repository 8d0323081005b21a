"""Language by the nearest of several centroids of each language.

A text is its byte n-grams, hashed into a vector of log counts times inverse
document frequencies, of length one. Each language has a few centroids, found by
spherical k-means on labelled texts; the nearest by cosine names the language.
A text that is farther from it than nearly all texts it was made of is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filewright.llm.store import may_match, stage
from filewright.llm.text import text_chunks, trimmed

BUCKET_BITS = 14
GRAMS = (2, 3, 4)
CENTROIDS = 3
ROUNDS = 10
MAX_TEXTS = 400  # a language, chosen by a hash of the id
PARTS = 64
REJECT_SHARE = 0.01
UNKNOWN = "und"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

# Bytes that are not letters become spaces; bytes of other scripts stay.
FOLDED = np.full(256, 32, np.uint8)
FOLDED[97:123] = np.arange(97, 123)
FOLDED[128:] = np.arange(128, 256)


def counts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, log count) of the n-grams of one lower-cased text; runs of what is no letter count as one space."""
    folded = FOLDED[data]
    folded = np.concatenate(([np.uint8(32)], folded, [np.uint8(32)]))
    folded = folded[np.append(True, (folded[1:] != 32) | (folded[:-1] != 32))].astype(np.uint64)
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for size in GRAMS:
        if len(folded) < size:
            continue
        code = np.full(len(folded) - size + 1, size, np.uint64)
        for at in range(size):
            code = code << np.uint64(8) | folded[at : at + len(code)]
        total += np.bincount((code * MULTIPLIER >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
    buckets = np.flatnonzero(total)
    return buckets, 1 + np.log(total[buckets])


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, offsets, data in text_chunks(pc.utf8_lower(column)):
        for start, end in zip(offsets, offsets[1:]):
            yield counts(data[start:end])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = list(_texts(batch.column(1)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([buckets for buckets, _ in made], pa.list_(pa.int32())),
                pa.array([logs for _, logs in made], pa.list_(pa.float64())),
            ],
            ["lang", "buckets", "logs"],
        )


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of the partition have each bucket."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "texts"])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def cluster(rows: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of rows of length one: (centroids, cosine below which a text is rejected, of each).

    Starts with the row nearest the mean, then always the row farthest from those chosen.
    """
    chosen = [int(np.argmax(rows @ rows.mean(axis=0)))]
    while len(chosen) < min(wanted, len(rows)):
        chosen.append(int(np.argmin((rows @ rows[chosen].T).max(axis=1))))
    centroids = rows[chosen]
    for _ in range(ROUNDS):
        near = (rows @ centroids.T).argmax(axis=1)
        means = [rows[near == k].mean(axis=0) if (near == k).any() else centroids[k] for k in range(len(centroids))]
        centroids = _unit(np.array(means))
    cosines = rows @ centroids.T
    near = cosines.argmax(axis=1)
    least = [np.quantile(cosines[near == k, k], REJECT_SHARE) if (near == k).any() else 0.0 for k in range(len(centroids))]
    return centroids, np.array(least)


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, least: np.ndarray):
        self.idf, self.langs, self.centroids, self.least = idf, langs, centroids, least

    def nearest(self, text: Column) -> Column:
        """Struct (lang, score, rejected) of a text."""
        idf, langs, least = self.idf, self.langs, self.least
        by_bucket = np.ascontiguousarray(self.centroids.T)

        def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                found = []
                for buckets, logs in _texts(pa.array(texts, pa.large_string(), from_pandas=True)):
                    weights = logs * idf[buckets]
                    size = np.linalg.norm(weights)
                    cosines = (weights @ by_bucket[buckets]) / size if size > 0 else np.zeros(len(langs))
                    best = int(cosines.argmax()) if len(langs) else -1
                    score = min(max(float(cosines[best]), 0.0), 1.0) if len(langs) else 0.0
                    found.append((langs[best] if len(langs) else UNKNOWN, score, not len(langs) or score < least[best]))
                yield pd.DataFrame(found, columns=["lang", "score", "rejected"])

        kind = "lang string, score double, rejected boolean"
        run = trimmed(judged)
        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        return F.pandas_udf(run, kind)(text)


def training_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, limit: int = MAX_TEXTS) -> DataFrame:
    """(lang, text) of at most ``limit`` rows a language outside the held-out third, chosen by a hash of the id."""
    rows = docs.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    rows = rows.withColumn("number", F.xxhash64(F.lit("language"), "id"))
    # The least hashes of a language are among the least of each of its parts, so no task reads a whole language.
    drawn = rows.select("lang", "id", "number", F.pmod("number", F.lit(PARTS)).alias("part"))
    for keys in (("lang", "part"), ("lang",)):
        first = F.row_number().over(Window.partitionBy(*keys).orderBy("number", "id"))
        drawn = drawn.withColumn("place", first).where(F.col("place") <= limit).drop("place")
    drawn = drawn.select("lang", "id")
    drawn = stage(drawn, "language-sample")
    texts = may_match(rows.select("lang", "text", "id"), ["lang", "id"], drawn, ["lang", "id"])
    return texts.join(drawn, ["lang", "id"], "left_semi").select("lang", "text")


def held_out(identity: Column) -> Column:
    return F.coalesce(F.crc32(identity.cast("string")) % 3 == 1, F.lit(True))


def train(texts: DataFrame) -> Model:
    """A model from (lang, text); what reaches the driver is the idf and the centroids."""
    counted = stage(texts.mapInArrow(trimmed(_counted), "lang string, buckets array<int>, logs array<double>"), "language-training")
    total = counted.count()
    seen = counted.select("buckets").mapInArrow(trimmed(_seen), "bucket int, texts bigint").groupBy("bucket").agg(F.sum("texts").alias("texts"))
    idf = np.full(1 << BUCKET_BITS, np.log(total + 1.0) + 1)
    for row in seen.toLocalIterator():
        idf[row["bucket"]] = np.log((total + 1.0) / (row["texts"] + 1)) + 1

    def clustered(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = np.zeros((len(rows), len(idf)), np.float32)
        for at, (buckets, logs) in enumerate(zip(rows["buckets"], rows["logs"])):
            vectors[at, buckets] = logs * idf[buckets]
        centroids, least = cluster(_unit(vectors), CENTROIDS)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": list(centroids.astype(np.float32)), "least": least})

    made = counted.groupBy("lang").applyInPandas(clustered, "lang string, centroid array<float>, least double").toPandas()
    made = made.sort_values("lang", kind="stable")
    centroids = np.stack(made["centroid"].to_numpy()) if len(made) else np.zeros((0, len(idf)), np.float32)
    return Model(idf, made["lang"].tolist(), centroids, made["least"].to_numpy(float))


def languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) of every row of ``docs``.

    ``lang_pred`` is the nearest language, also where ``rejected`` says that it is far off; a text
    that is NULL or has no letter is ``und`` with score 0 and rejected, and so is every text if no language could be
    learned. A NULL id counts as held out. Repeated rows each get their result; an empty table gives none.
    """
    model = train(training_texts(docs, id_col, text_col, lang_col))
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    judged = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select(
        "id", has_letter.alias("letters"), model.nearest(F.col("text")).alias("near")
    )
    return judged.select(
        "id",
        held_out(F.col("id")).alias("held_out"),
        F.when(F.col("letters"), F.col("near.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letters"), F.col("near.score")).otherwise(0.0).alias("score"),
        (~F.col("letters") | F.col("near.rejected")).alias("rejected"),
    )
