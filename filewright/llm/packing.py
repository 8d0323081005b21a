"""Sequences for training, packed along a space-filling curve.

A document's token counts are hashed into buckets, projected to a few dimensions
and scaled by means and deviations over all documents. The cell it falls in
gives a key on a Hilbert curve, so neighbours on the curve hold similar tokens.
Documents are range-sorted by that key and cut into full sequences in that order;
only the last sequence is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.llm.bpe import encoder
from filewright.llm.store import passing, stage
from filewright.llm.text import mix, text_chunks, trimmed

SEQUENCE = 2048
END_ID = 1
DIMENSIONS = 4
CELL_BITS = 8
BUCKETS = 1024
SEED = 7
CHUNK_BYTES = 1 << 18
PART_TOKENS = 1 << 26  # in a range of the curve, by which a longer table gets more ranges


def projection(buckets: int, dimensions: int) -> np.ndarray:
    """Fixed random directions, orthonormal."""
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((buckets, dimensions)))[0]


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each cell (rows of whole numbers below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    count = len(x)
    at = 1 << bits - 1
    while at > 1:  # undo excess rotations, from the highest bit down
        low = at - 1
        for axis in range(count):
            on = (x[axis] & at) > 0
            swap = np.where(on, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(on, low, swap)
            if axis:
                x[axis] ^= swap
        at >>= 1
    for axis in range(1, count):
        x[axis] ^= x[axis - 1]
    turned = np.zeros_like(x[0])
    at = 1 << bits - 1
    while at > 1:
        turned ^= np.where(x[-1] & at, at - 1, 0)
        at >>= 1
    x ^= turned
    keys = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in range(count):
            keys = keys << 1 | (x[axis] >> bit & 1)
    return keys


def _encode(path: str):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = encoder(path)
        kind = np.dtype(token_type(tokens_of.size))
        # What a token adds to a document's place: its bucket's direction, with a sign of its own.
        hashed = mix(np.arange(tokens_of.size, dtype=np.uint64) + np.uint64(SEED))
        adds = projection(BUCKETS, DIMENSIONS)[(hashed % np.uint64(BUCKETS)).astype(np.int64)]
        adds *= np.where(hashed >> np.uint64(63), 1.0, -1.0)[:, None]
        for batch in batches:
            for first, offsets, data in text_chunks(batch.column(1), CHUNK_BYTES):
                ids, counts = tokens_of.encode(offsets, data)
                rows = len(counts)
                ends = np.cumsum(counts)
                sums = np.vstack((np.zeros((1, DIMENSIONS)), np.cumsum(adds[ids], axis=0)))
                points = (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1)[:, None]
                whole = np.insert(ids, ends, END_ID).astype(kind)
                bounds = np.append(0, (ends + np.arange(1, rows + 1))) * kind.itemsize
                tokens = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(whole)]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, rows),
                        tokens.cast(pa.binary()),
                        pa.array(counts + 1),
                        pa.array(list(points), pa.list_(pa.float64())),
                    ],
                    ["id", "tokens", "n", "point"],
                )

    return made


def _keyed(means: np.ndarray, spreads: np.ndarray):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            points = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(rows, DIMENSIONS)
            scaled = np.clip((points - means) / spreads / 3, -1, 1)  # three deviations either way
            cells = np.minimum(((scaled + 1) / 2 * (1 << CELL_BITS)).astype(np.int64), (1 << CELL_BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(hilbert_keys(cells, CELL_BITS))], ["id", "tokens", "n", "curve"]
            )

    return made


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the tokens of a partition's documents in their order."""
    from pyspark import TaskContext

    partition, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        counts = batch.column(2).to_numpy()
        ends = total + np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else total
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns,
                pa.array(np.full(len(counts), partition, np.int32)),
                pa.array((ends - counts).astype(np.int64)),
            ],
            ["id", "tokens", "n", "curve", "part", "before"],
        )


def token_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _cut(befores: dict[int, int], sequence: int, path: str, with_tokens: bool):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = token_type(encoder(path).size)
        for batch in batches:
            rows = []
            for at, (tokens, part, before) in enumerate(
                zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist())
            ):
                ids = np.frombuffer(tokens, width).astype("<u4")
                first = befores[part] + before
                start = 0
                while start < len(ids):
                    place = (first + start) % sequence
                    piece = ids[start : start + sequence - place]
                    rows.append((at, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), (first + start) // sequence, place, piece if with_tokens else None))
                    start += len(piece)
            columns = list(zip(*rows)) if rows else [()] * 8
            kept = [
                batch.column(0).take(pa.array(columns[0], pa.int64())),
                *(pa.array(column, pa.int64()) for column in columns[1:7]),
                batch.column(3).take(pa.array(columns[0], pa.int64())),
            ]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve"]
            if with_tokens:
                kept.append(pa.array(columns[7], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(kept, names)

    return made


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE,
    with_tokens: bool = False,
) -> DataFrame:
    """One row per piece of a document: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve), with its ids on request.

    ``tokenizer`` is the path of a tokenizer file that every executor can read. Each document is its
    ids and an end id, so NULL and empty texts have one. Sequences fill up in the order of the curve, equal keys in that of the id;
    rows that repeat are packed each. All but the last sequence are full. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with passing(spark) as tables:
        encoded = stage(
            narrow.mapInArrow(trimmed(_encode(tokenizer)), f"id {kind}, tokens binary, n bigint, point array<double>"), "tokens"
        )
        places = range(DIMENSIONS)
        moments = encoded.agg(
            F.sum("n").alias("n"),
            *(f(F.col("point")[j]).alias(f"{f.__name__}{j}") for j in places for f in (F.avg, F.stddev_pop)),
        ).first()
        means = np.array([moments[f"avg{j}"] or 0.0 for j in places])
        spreads = np.array([moments[f"stddev_pop{j}"] or 1.0 for j in places])
        keyed = encoded.mapInArrow(trimmed(_keyed(means, spreads)), f"id {kind}, tokens binary, n bigint, curve bigint")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (moments["n"] or 0) // PART_TOKENS, 1)
        ordered = keyed.repartitionByRange(parts, "curve", "id", "n").sortWithinPartitions("curve", "id", "n")
        schema = f"id {kind}, tokens binary, n bigint, curve bigint, part int, before bigint"
        chained = stage(ordered.mapInArrow(trimmed(_chained), schema), "curve-order")
        tables.pop()  # the order stays, the tokens are in it
    befores, total = {}, 0
    for row in chained.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row per partition
        befores[row["part"]], total = total, total + row["n"]
    made = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, curve bigint"
    cut = _cut(befores, sequence, tokenizer, with_tokens)
    return chained.mapInArrow(trimmed(cut), made + (", ids array<int>" if with_tokens else ""))
