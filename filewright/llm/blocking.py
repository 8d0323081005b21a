"""Ranked lexical search with geometric blocks of posting lists.

All documents are ranked for a set of queries by an integer score of the BM25 family, and the best few of each
query are returned, exactly. The queries are taken in blocks of bounded size against all documents.

Documents become vectors over the terms of the queries, are range-sorted by a hash that similar vectors share,
and are read in segments of neighbours. In a segment every term that the search opens has its posting list, which
is cut by similarity: each posting joins the nearest, by cosine of random projections, of a few centroids taken
from the list itself. Every such block stores the coordinatewise maximum of its documents' scores, over the terms
that queries with the list's term have. The sum of these maxima over the terms of a query bounds what any document
of the block can score, so a block is skipped only if this exact bound is below the score of the query's last hit so
far; the same holds for lists whose terms cannot reach that score together, and for whole segments. All other
blocks are scored in full. A task keeps the hits of its own segments and nothing of the documents behind it.
Summaries live as long as their segment: written out they would take many times the room of the texts.

Documents: ids are whole numbers; NULL ids sort before all others. A text that is NULL or has no terms is none
of the counted documents. Repeated rows are ranked one by one. Queries: rows of equal id and text are one query;
of one id and several texts each text has a ranking of its own. Queries without terms, and empty tables, give no rows.
Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from filewright.llm.store import stage
from filewright.llm.text import trimmed

HITS = 50
QUERY_TERMS = 1 << 17  # about as many terms of queries go in one block of queries
SEGMENT_CELLS = 1 << 21  # documents of a segment times its terms
SEGMENT_ROWS = 4096
BLOCK_ROWS = 32
DIMENSIONS = 32
TERMS = re.compile(rb"[0-9a-z\x80-\xff]+")
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(1 << 63)


@dataclass
class Queries:
    """A block of queries: their ids, their terms as numbers, and the number of each term."""

    ids: list
    terms: list[np.ndarray]
    numbers: dict[bytes, int]

    def signs(self) -> np.ndarray:
        """A direction of +1 and -1 for each term, drawn from its number."""
        return np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (len(self.numbers), DIMENSIONS))

    def partners(self) -> list[np.ndarray]:
        """For each term the terms of all queries that have it."""
        found: list[set[int]] = [set() for _ in self.numbers]
        for terms in self.terms:
            for term in terms.tolist():
                found[term].update(terms.tolist())
        return [np.array(sorted(terms), np.int64) for terms in found]


@dataclass
class Weights:
    """Term weights by number, and the counts that a document's length is measured by."""

    weights: np.ndarray
    documents: int
    length: int

    def scores(self, terms: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        size = 100 - 50 + (50 * lengths * self.documents) // self.length
        return self.weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * size))


def _vectors(queries: Broadcast):
    """(id, n, terms, counts, nearby) of documents: terms of queries with their counts, and a hash that similar documents share."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Queries(*queries.value)
        numbers, signs = asked.numbers, asked.signs()
        bits = np.int64(1) << np.arange(DIMENSIONS - 1, -1, -1)
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in batch.column(1):
                found = Counter(TERMS.findall((text.as_py() or "").encode("utf-8", "replace").lower()))
                lengths.append(found.total())
                known = sorted((numbers[term], count) for term, count in found.items() if term in numbers)
                terms.append([term for term, _ in known])
                counts.append([count for _, count in known])
            nearby = [int(bits[signs[of].sum(0) > 0].sum()) if of else 0 for of in terms]
            arrays = [
                batch.column(0),
                pa.array(lengths, pa.int64()),
                pa.array(terms, pa.list_(pa.int32())),
                pa.array(counts, pa.list_(pa.int32())),
                pa.array(nearby, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "terms", "counts", "nearby"])

    return trimmed(run)


class Hits:
    """The best documents of one query so far."""

    def __init__(self, limit: int):
        self.limit, self.scores, self.ids = limit, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def bar(self) -> int:
        """No document with a lower score can be among the best."""
        return int(self.scores[-1]) if len(self.scores) == self.limit else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        near = scores >= self.bar
        if near.any():
            scores, ids = np.append(self.scores, scores[near]), np.append(self.ids, ids[near])
            best = np.lexsort((ids, -scores))[: self.limit]
            self.scores, self.ids = scores[best], ids[best]


class Segment:
    """Vectors of neighbouring documents, with posting lists that are made when they are first opened."""

    def __init__(self, ids, scores: np.ndarray, terms: np.ndarray, rows: np.ndarray, signs: np.ndarray, partners: list[np.ndarray]):
        self.ids, self.partners = ids, partners
        self.terms, places = np.unique(terms, return_inverse=True)
        self.column = np.full(len(signs), -1, np.int64)
        self.column[self.terms] = np.arange(len(self.terms))
        self.cells = np.zeros((len(ids), len(self.terms)), np.int64)
        self.cells[rows, places] = scores
        self.greatest = self.cells.max(0, initial=0)
        points = (self.cells > 0).astype(np.float32) @ signs[self.terms]
        self.points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
        self.lists: dict[int, tuple] = {}
        self.opened = self.skipped = 0

    def blocks(self, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, first place of each block, places of columns in the summaries, summaries) of one posting list."""
        if column not in self.lists:
            rows = np.flatnonzero(self.cells[:, column])
            if len(rows) > BLOCK_ROWS:
                centroids = rows[:: BLOCK_ROWS]
                nearest = (self.points[rows] @ self.points[centroids].T).argmax(1)
                order = np.argsort(nearest, kind="stable")
                rows, nearest = rows[order], nearest[order]
                first = np.flatnonzero(np.append(True, nearest[1:] != nearest[:-1]))
                within = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
                first = np.flatnonzero(within % (2 * BLOCK_ROWS) == 0)
            else:
                first = np.zeros(1, np.int64)
            columns = self.column[self.partners[self.terms[column]]]
            columns = columns[columns >= 0]
            summaries = np.maximum.reduceat(self.cells[np.ix_(rows, columns)], first, axis=0)
            place = np.full(len(self.terms), -1, np.int64)
            place[columns] = np.arange(len(columns))
            self.lists[column] = rows, first, place, summaries
        return self.lists[column]

    def search(self, terms: np.ndarray, hits: Hits) -> None:
        """Add the documents that are among the best of a query."""
        columns = self.column[terms]
        columns = columns[columns >= 0]
        bar = hits.bar
        if not len(columns) or self.greatest[columns].sum() < bar:
            return
        # Documents that have only terms of the first lists, in order of their greatest score, stay below the bar.
        columns = columns[np.argsort(self.greatest[columns], kind="stable")]
        needed = columns[np.cumsum(self.greatest[columns]) >= bar]
        near = np.zeros(len(self.ids), bool)
        for column in needed.tolist():
            rows, first, place, summaries = self.blocks(column)
            open_blocks = summaries[:, place[columns]].sum(1) >= bar
            near[rows[np.repeat(open_blocks, np.diff(np.append(first, len(rows))))]] = True
            self.opened += int(open_blocks.sum())
            self.skipped += int((~open_blocks).sum())
        rows = np.flatnonzero(near)
        if len(rows):
            hits.add(self.cells[np.ix_(rows, columns)].sum(1), self.ids[rows])


def _segments(batches: Iterable[pa.RecordBatch], weights: Weights, signs: np.ndarray, partners: list[np.ndarray]) -> Iterator[Segment]:
    """Segments of as many documents as their cells allow, one at least."""
    limit = max(1, min(SEGMENT_ROWS, SEGMENT_CELLS // max(len(signs), 1)))
    parts: list[tuple] = []

    def made() -> Segment:
        ids, lengths, sizes, terms, counts = (np.concatenate(column) for column in zip(*parts))
        rows = np.repeat(np.arange(len(ids)), sizes)
        return Segment(ids, weights.scores(terms, counts, lengths[rows]), terms, rows, signs, partners)

    held = 0
    for batch in batches:
        first = 0
        while first < batch.num_rows:
            part = batch.slice(first, limit - held)
            ids, lengths, terms, counts = (part.column(name) for name in ("id", "n", "terms", "counts"))
            sizes = np.diff(terms.offsets.to_numpy())
            numbers = [column.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for column in (terms, counts)]
            parts.append((ids.to_numpy(), lengths.to_numpy(), sizes, *numbers))
            first, held = first + part.num_rows, held + part.num_rows
            if held == limit:
                yield made()
                parts, held = [], 0
    if parts:
        yield made()


def _search(queries: Broadcast, weights: Weights, limit: int, kind: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Queries(*queries.value)
        hits = [Hits(limit) for _ in asked.ids]
        for segment in _segments(batches, weights, asked.signs(), asked.partners()):
            for terms, best in zip(asked.terms, hits):
                segment.search(terms, best)
        for first in range(0, len(hits), 1000):
            part = range(first, min(first + 1000, len(hits)))
            sizes = [len(hits[number].ids) for number in part]
            arrays = [
                pa.array([asked.ids[n] for n, size in zip(part, sizes) for _ in range(size)], kind),
                pa.array(np.repeat(np.array(part, np.int32), sizes)),
                pa.array(np.concatenate([hits[number].ids for number in part])),
                pa.array(np.concatenate([hits[number].scores for number in part])),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["item", "number", "id", "score"])

    return trimmed(run)


def _asked(items: DataFrame, block: int, blocks: int) -> Queries:
    """One block of queries. Blocks are drawn by hash and sized by the terms of all queries."""
    rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).select("item", "terms").collect()
    numbers: dict[bytes, int] = {}
    terms = []
    for row in sorted(rows, key=lambda row: (str(row.item), row.terms)):
        terms.append(np.array(sorted(numbers.setdefault(term.encode(), len(numbers)) for term in row.terms), np.int64))
    return Queries([row.item for row in sorted(rows, key=lambda row: (str(row.item), row.terms))], terms, numbers)


def _weights(vectors: DataFrame, terms: int) -> Weights | None:
    """Weights from counts over all documents; None if no document has a term."""
    documents, length = vectors.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    found = np.zeros(terms, np.int64)
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        found[row["term"]] = row["count"]
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in found.tolist()]
    return Weights(np.array(weights, np.int64), documents, length)


def rank(
    docs: DataFrame,
    items: DataFrame,
    limit: int = HITS,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """(item, rank, id, score) of the ``limit`` best documents of every query, best first, equal scores by id."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(id_column).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(text_column).alias("text"))
    terms = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(PATTERN), F.lit(0)))
    items = items.select(F.col(item_column).alias("item"), F.col(item_text_column).alias("text")).distinct()
    items = items.withColumn("terms", F.sort_array(terms)).where(F.size("terms") > 0)
    kind = items.schema["item"].dataType
    schema = f"item {kind.simpleString()}, number int, id bigint, score bigint"
    blocks = -(-(items.agg(F.sum(F.size("terms"))).first()[0] or 0) // QUERY_TERMS)
    found = spark.createDataFrame([], f"block int, {schema}")
    for block in range(blocks):
        asked = _asked(items, block, blocks)
        queries = spark.sparkContext.broadcast((asked.ids, asked.terms, asked.numbers))
        vectors = texts.mapInArrow(_vectors(queries), "id bigint, n bigint, terms array<int>, counts array<int>, nearby bigint")
        vectors = stage(vectors, "query-vectors")
        weights = _weights(vectors, len(asked.numbers))
        if weights is None:
            continue
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        nearby = vectors.where(F.size("terms") > 0).repartitionByRange(parts, "nearby", "id").sortWithinPartitions("nearby", "id")
        best = nearby.mapInArrow(_search(queries, weights, limit, to_arrow_type(kind)), schema)
        found = found.unionByName(best.withColumn("block", F.lit(block)))
    window = Window.partitionBy("block", "number").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)
    return ranked.select("item", "rank", F.nullif("id", F.lit(NO_ID)).alias("id"), "score")
