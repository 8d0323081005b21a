"""Benchmark decontamination by winnowing word k-grams.

Every window of ten words keeps the least hash of its six five-word grams, so
two texts that share ten words in a row keep the same hash there. Kept hashes of
the benchmark become a bit table of fixed size, which drops nearly all windows of
the documents where they are read. The rest are joined with the benchmark by the
kept hash, and a hit is extended to the ten words by their joint hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.llm.store import stage
from filewright.llm.text import mix, powers, text_chunks, trimmed

WINDOW = 10
GRAM = 5
TABLE_BITS = 23
BYTE_BASE, WORD_BASE, GRAM_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9

# A-Z become a-z; words are digits, letters and all that is not ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True

WINDOWS = "windows array<struct<start:int,words:int,kept:bigint,joint:bigint>>"


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of every word, in order."""
    inside = IS_WORD[data]
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] |= inside[edges]
    starts = np.flatnonzero(begins)
    places = np.flatnonzero(inside)
    first = np.flatnonzero(begins[places])
    lengths = np.diff(np.append(first, len(places)))
    within = np.arange(len(places)) - np.repeat(first, lengths)
    values = (LOWER[data[places]].astype(np.uint64) + np.uint64(1)) * powers(BYTE_BASE, int(lengths.max()))[within]
    hashes = mix(np.add.reduceat(values, first) * np.uint64(BYTE_BASE) ^ (lengths.astype(np.uint64) << np.uint64(40)))
    return hashes, np.searchsorted(offsets, starts, "right") - 1


def _joint(hashes: np.ndarray, count: int, base: int) -> np.ndarray:
    """Hash of each run of ``count`` words."""
    size = max(len(hashes) - count + 1, 0)
    total = np.full(size, count, np.uint64)
    for at, power in enumerate(powers(base, count)):
        total += hashes[at : at + size] * power
    return mix(total)


def windows(hashes: np.ndarray, texts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, kept hash, joint hash) of every window of ``words`` words that lies in one text."""
    joint = _joint(hashes, words, WORD_BASE)
    starts = np.flatnonzero(texts[: len(joint)] == texts[words - 1 :]) if len(joint) else np.zeros(0, np.int64)
    gram = min(GRAM, words)
    grams = _joint(hashes, gram, GRAM_BASE)
    kept = grams[: len(joint)].copy()
    for at in range(1, words - gram + 1):
        np.minimum(kept, grams[at : at + len(joint)], out=kept)
    kept = mix(kept + np.uint64(words))
    return starts, kept[starts], joint[starts]


def _cell(kept: np.ndarray) -> np.ndarray:
    return (kept >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _scan(lengths: list[int] | None, table: np.ndarray | None):
    """Words and windows of each text: windows of all ``lengths`` that the bit table has; without a table a text's own windows."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, data in text_chunks(batch.column(1)):
                rows = len(offsets) - 1
                hashes, texts = word_hashes(offsets, data)
                counts = np.bincount(texts, minlength=rows)
                before = np.cumsum(counts) - counts
                found = []
                for words in range(1, WINDOW + 1) if lengths is None else lengths:
                    starts, kept, joint = windows(hashes, texts, words)
                    owner = texts[starts]
                    if table is None:
                        good = counts[owner] == words if words < WINDOW else np.ones(len(owner), bool)
                    else:
                        cell = _cell(kept)
                        good = table[cell >> 3] >> (cell & 7) & 1 > 0
                    starts, owner = starts[good], owner[good]
                    found.append((owner, starts - before[owner], np.full(len(owner), words), kept[good], joint[good]))
                owner, start, words, kept, joint = map(np.concatenate, zip(*found)) if found else [np.zeros(0, np.int64)] * 5
                order = np.argsort(owner, kind="stable")
                fields = [
                    pa.array(start[order].astype(np.int32)),
                    pa.array(words[order].astype(np.int32)),
                    pa.array(kept[order].astype(np.uint64).view(np.int64)),
                    pa.array(joint[order].astype(np.uint64).view(np.int64)),
                ]
                ends = np.append(0, np.cumsum(np.bincount(owner, minlength=rows))).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(ends), pa.StructArray.from_arrays(fields, ["start", "words", "kept", "joint"])
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, rows),
                        batch.column(2).slice(first, rows),
                        pa.array(counts.astype(np.int64)),
                        lists,
                    ],
                    ["id", "digest", "n_words", "windows"],
                )

    return made


def _scanned(rows: DataFrame, id_col: str, text_col: str, lengths: list[int] | None, table: np.ndarray | None) -> DataFrame:
    kind = rows.schema[id_col].dataType.simpleString()
    narrow = rows.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest")
    )
    return narrow.mapInArrow(trimmed(_scan(lengths, table)), f"id {kind}, digest bigint, n_words bigint, {WINDOWS}")


def _bit_table(kept: DataFrame) -> np.ndarray:
    """The bit table of the kept hashes: 2**23 bits, however many hashes there are."""
    cell = F.shiftrightunsigned("kept", 64 - TABLE_BITS)
    words = kept.groupBy(F.shiftright(cell, 6).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(kept, {64 - TABLE_BITS}) & 63 AS int))")).alias("bits")
    )
    table = np.zeros(1 << TABLE_BITS - 6, np.int64)
    for row in words.toLocalIterator():
        table[row["at"]] = row["bits"]
    return table.view(np.uint8)


def _hex_of(items: Column) -> Column:
    return F.sha2(F.concat_ws(",", F.sort_array(items)), 256)


def _met(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their windows that may be known, windows of the items, and windows found in both, all stored."""
    known = stage(
        _scanned(items, item_col, item_text_col, None, None)
        .select(F.col("id").cast("string").alias("item"), F.inline("windows"))
        .select("item", "words", "kept", "joint")
        .distinct(),
        "benchmark-windows",
    )
    lengths = sorted(row["words"] for row in known.select("words").distinct().collect())
    scanned = stage(_scanned(docs, id_col, text_col, lengths, _bit_table(known)), "document-windows")
    key = ["words", "kept", "joint"]
    met = scanned.where(F.size("windows") > 0).select("id", "digest", F.inline("windows")).distinct()
    hits = stage(met.join(stage(known.select(*key).distinct(), "known-windows"), key, "left_semi"), "hits")
    return scanned, known, hits


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, digest) of the documents with a window of an item; the digest is the hash of the text."""
    return _met(docs, items, id_col, text_col, item_col, item_text_col)[2].select("id", "digest").distinct()


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated) of every row of ``docs``.

    A word of a document is hit if it lies in ten words in a row that an item has
    too, or in the words of a whole item of fewer than ten. ``items`` holds the
    sorted ids, as strings, of all items with such a window. NULL texts have no words, and an
    item without words has no window. Items with a NULL id hit words but are not
    listed. Repeated rows each get their result. Empty tables are fine on either side.

    The bit table sent to the executors has 2**23 bits at any size of the
    benchmark; a fuller one lets more windows through to the join.
    """
    scanned, known, hits = _met(docs, items, id_col, text_col, item_col, item_text_col)
    key = ["words", "kept", "joint"]
    place = F.explode(F.expr("sequence(start, start + words - 1)"))
    covered = hits.select("id", "digest", place.alias("at")).distinct().groupBy("id", "digest").agg(F.count("*").alias("n_hit"))
    named = (
        hits.select("id", "digest", *key)
        .distinct()
        .join(known.where("item IS NOT NULL"), key)
        .groupBy("id", "digest")
        .agg(F.collect_set("item").alias("items"))
    )
    facts = covered.join(
        named.withColumnsRenamed({"id": "i", "digest": "d"}),
        F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")),
        "left",
    ).select(F.col("id").alias("i"), F.col("digest").alias("d"), "n_hit", "items")
    found = scanned.select("id", "digest", "n_words").join(
        facts, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left"
    )
    listed = F.sort_array(F.coalesce("items", F.array().cast("array<string>")))
    return found.select(
        "id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        listed.alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.withColumn("items_sha256", _hex_of(F.col("items"))).drop("items")
