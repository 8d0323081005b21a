"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by a fast pseudo-random rotation, three rounds of random signs
and a Hadamard transform, and hashed to the nearest of the signed axes. A table
joins several such hashes. Every vector is filed in its own bucket of each table
and sought in the buckets of its nearest axes and the next nearest ones. Vectors
that meet are compared by a bit sketch first and by their cosine then.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.llm.components import components
from filewright.llm.store import stage
from filewright.llm.text import trimmed

THRESHOLD = 0.95
TABLES = 7
HASHES = 3  # of 128 axes for 64 dimensions: two million buckets a table
PROBES = 2  # axes tried for each hash
SKETCH_WORDS = 4
SEED = 11
ROUNDS = 3


def rotate(rows: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """Rows turned pseudo-randomly; their width is a power of two."""
    width = rows.shape[1]
    signs = np.random.default_rng(seed).integers(0, 2, (ROUNDS, width)) * 2.0 - 1
    for sign in signs:
        rows = rows * sign
        size = 1
        while size < width:
            pairs = rows.reshape(len(rows), -1, 2, size)
            rows = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(rows), width)
            size *= 2
        rows = rows / np.sqrt(width)
    return rows


def padded(rows: np.ndarray) -> np.ndarray:
    width = 1 << max(int(rows.shape[1]) - 1, 1).bit_length()
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def axes(rows: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest signed axes of each row, nearest first."""
    size = np.abs(rows)
    near = np.argsort(-size, axis=1, kind="stable")[:, :count]
    return near * 2 + (np.take_along_axis(rows, near, axis=1) < 0)


def sketches(rows: np.ndarray) -> np.ndarray:
    """Signs of the row after several rotations, ``SKETCH_WORDS`` words of 64 bits."""
    bits = []
    turn = 0
    while sum(part.shape[1] for part in bits) < 64 * SKETCH_WORDS:
        bits.append(rotate(rows, (SEED, 1, turn)) > 0)
        turn += 1
    packed = np.packbits(np.concatenate(bits, axis=1)[:, : 64 * SKETCH_WORDS], axis=1)
    return packed.reshape(len(rows), SKETCH_WORDS, 8).view("<i8")[:, :, 0]


def sketch_bound(threshold: float) -> int:
    """Differing sketch bits up to which vectors are compared: six deviations over the mean of a pair at the threshold."""
    share = np.arccos(threshold) / np.pi
    total = 64 * SKETCH_WORDS
    return int(np.ceil(total * share + 6 * np.sqrt(total * share * (1 - share))))


def _by_width(vectors: list) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for at, vector in enumerate(vectors):
        found.setdefault(len(vector), []).append(at)
    return found


def _hashed(tables: int, hashes: int, probes: int):
    """(sought, key, node, sketch) rows: one filed row a table, and one sought row for each bucket probed."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                nodes = part.column(0).to_numpy()
                vectors = part.column(1).to_pylist()
                for width, places in _by_width(vectors).items():
                    rows = np.array([vectors[at] for at in places], float)
                    rows = padded(rows / np.linalg.norm(rows, axis=1, keepdims=True))
                    own, marks = nodes[places], sketches(rows)
                    keys, sought = [], []
                    for table in range(tables):
                        near = [axes(rotate(rows, (SEED, 0, table, k)), probes) for k in range(hashes)]
                        for probe in product(range(near[0].shape[1]), repeat=hashes):
                            key = np.full(len(rows), table * 1_000_003 + width, np.int64)
                            for k, choice in enumerate(probe):
                                key = key * (2 * rows.shape[1] + 1) + near[k][:, choice]
                            keys.append(key)
                            sought.append(any(probe))
                    for key, is_probe in zip(keys, sought):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(key), is_probe)),
                                pa.array(key),
                                pa.array(own),
                                *(pa.array(np.ascontiguousarray(marks[:, w])) for w in range(SKETCH_WORDS)),
                            ],
                            ["probe", "key", "node", *(f"s{w}" for w in range(SKETCH_WORDS))],
                        )

    return made


def _verified(threshold: float):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                places = np.flatnonzero(widths == width)
                for low in range(0, len(places), 8192):
                    part = batch.take(pa.array(places[low : low + 8192]))
                    left, right = (
                        part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width) for at in (2, 3)
                    )
                    dots = np.einsum("ij,ij->i", left, right)
                    near = dots / (np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)) >= threshold
                    yield part.select(["a", "b"]).filter(pa.array(near))

    return made


def links(
    nodes: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES
) -> DataFrame:
    """(a, b) with a > b: pairs of ``nodes`` (node, vector) found whose cosine is at least ``threshold``."""
    kinds = "probe boolean, key bigint, node bigint, " + ", ".join(f"s{w} bigint" for w in range(SKETCH_WORDS))
    hashed = stage(nodes.select("node", "vector").mapInArrow(trimmed(_hashed(tables, hashes, probes)), kinds), "vector-keys")
    filed = hashed.where("NOT probe").drop("probe").withColumnRenamed("node", "b")
    sought = hashed.drop("probe").withColumnsRenamed({"node": "a", **{f"s{w}": f"t{w}" for w in range(SKETCH_WORDS)}})
    differing = sum((F.bit_count(F.col(f"s{w}").bitwiseXOR(F.col(f"t{w}"))) for w in range(SKETCH_WORDS)), F.lit(0))
    met = sought.join(filed, "key").where((F.col("a") != F.col("b")) & (differing <= sketch_bound(threshold)))
    pairs = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    # Two joins on nodes: pairs hold only ids until they have passed the sketch.
    first = nodes.select(F.col("node").alias("a"), F.col("vector").alias("left"))
    second = nodes.select(F.col("node").alias("b"), F.col("vector").alias("right"))
    joined = pairs.join(first, "a").join(second, "b").where("size(left) = size(right)")
    return joined.select("a", "b", "left", "right").mapInArrow(trimmed(_verified(threshold)), "a bigint, b bigint")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, n_links, component) of every row of ``vectors``.

    Equal vectors are one node, so their pairs are counted, not made. A vector that is NULL, empty or
    zero, or holds a NULL, NaN or infinite component, has no link and is its own component, as is any vector
    without a near one; vectors of different widths are not compared. The component is the least id that links reach, NULL
    if only rows with a NULL id are in it. Repeated rows count as other vectors. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.coalesce(
        F.col("vector").isNotNull() & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0), F.lit(False)
    )
    whole = F.when(usable, F.transform("vector", lambda x: x.cast("double") + F.lit(0.0)))
    rows = rows.select("id", whole.alias("vector"))
    grouped = rows.where("vector IS NOT NULL").groupBy("vector").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    nodes = stage(grouped.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    linked = stage(links(nodes, threshold), "vector-links")
    roots = components(linked).withColumnRenamed("root", "top")
    size = nodes.select(F.col("node").alias("other"), "copies")
    both = linked.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        linked.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    reached = both.join(size, "other").groupBy("node").agg(F.sum("copies").alias("reached"))
    rooted = nodes.join(roots, "node", "left").withColumn("top", F.coalesce("top", "node"))
    named = rooted.join(rooted.groupBy("top").agg(F.min("least").alias("component")), "top")
    facts = named.join(reached, "node", "left").select(
        "vector", (F.coalesce("reached", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"
    )
    found = rows.where("vector IS NOT NULL").join(facts, "vector").select("id", "n_links", "component")
    alone = rows.where("vector IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return found.unionByName(alone)
