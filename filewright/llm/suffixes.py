"""Removal of long repeated byte strings, with suffix arrays built shard by shard.

Every string of 400 bytes has an anchor, the least hash of the byte k-grams in it,
which depends on the string alone. Equal strings thus have equal anchor hashes and the same place
relative to them. Strings whose anchor hash occurs once are unique and go no further.
The others are cut out as segments, one for each run of strings with one anchor,
and equal segments are merged and counted. Segments are dealt to shards by anchor hash.
Each shard sorts its suffixes by Larsson-Sadakane refinement, takes common prefixes of neighbours after
Kasai, and reports which strings repeat. An anchor with very many segments is spread
over several shards, whose sorted strings are then merged by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.llm.store import attach, may_match, stage
from filewright.llm.text import mix, powers, text_bytes, trimmed

LENGTH = 400
GRAM = 128
PIECE_BYTES = 1 << 20
SHARD_BYTES = 1 << 20
COMPARED_BYTES = 1 << 20
SPLIT_SEGMENTS = 512  # distinct segments of one anchor in one shard
MERGE_ROWS = 100_000
BASE = 0x9E3779B97F4A7C15
PLACE_BITS = np.uint64(24)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each run of ``GRAM`` bytes."""
    size = len(data)
    up = powers(BASE, size)
    down = powers(pow(BASE, -1, 1 << 64), size)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))
    return mix((sums[GRAM:] - sums[:-GRAM]) * down[: size - GRAM + 1])


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width``, from running minima within blocks."""
    blocks = -(-len(values) // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(values)] = values
    grid = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first start, number of starts, anchor place, hash) of runs of strings with one anchor; places count from the start of the text.

    ``offsets`` are the bounds of the texts in ``data``, which is shorter than 2**24 bytes.
    """
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    hashes = _gram_hashes(data)
    place = np.arange(len(hashes), dtype=np.uint64)
    marked = (hashes >> PLACE_BITS << PLACE_BITS) | place  # the first of equal hashes is the least
    chosen = (_window_least(marked, length - GRAM + 1) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    starts = np.arange(len(chosen))
    owner = np.searchsorted(offsets, starts, "right") - 1
    valid = starts + length <= offsets[owner + 1]
    starts, owner, chosen = starts[valid], owner[valid], chosen[valid]
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    first = np.flatnonzero(np.append(True, (np.diff(chosen) != 0) | (np.diff(owner) != 0) | (np.diff(starts) != 1)))
    runs = np.diff(np.append(first, len(starts)))
    text, base = owner[first], offsets[owner[first]]
    return text, starts[first] - base, runs, chosen[first] - base, hashes[chosen[first]]


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end text, first byte, end byte): runs of texts of about a piece, or parts of a longer text that overlap by a string less a byte."""
    first = 0
    while first < len(offsets) - 1:
        end = max(int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1, first + 1)
        if end - first == 1:
            for low in range(int(offsets[first]), int(offsets[end]), PIECE_BYTES):
                yield first, end, low, min(low + PIECE_BYTES + LENGTH - 1, int(offsets[end]))
        else:
            yield first, end, int(offsets[first]), int(offsets[end])
        first = end


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, digest, start, runs, place, anchor, segment) of every segment; ``segment`` is a hash of its bytes and its place at the anchor."""
    for batch in batches:
        offsets, data = text_bytes(batch.column(1)) if batch.num_rows else (np.zeros(1, np.int64), b"")
        for first, end, low, high in _pieces(offsets):
            part = data[low:high]
            bounds = np.clip(offsets[first : end + 1] - low, 0, len(part))
            text, start, runs, place, anchor = anchors(part, bounds, LENGTH)
            if not len(text):
                continue
            raw = part.tobytes()
            begins = bounds[text] + start
            marks = [
                xxhash.xxh3_128_digest(raw[b : b + n + LENGTH - 1], seed=p)
                for b, n, p in zip(begins.tolist(), runs.tolist(), (place - start).tolist())
            ]
            shift = low - int(offsets[first]) if end - first == 1 else 0
            rows = pa.array(first + text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(2).take(rows),
                    pa.array(start + shift),
                    pa.array(runs.astype(np.int32)),
                    pa.array((place - start).astype(np.int32)),
                    pa.array(anchor.view(np.int64)),
                    pa.array(marks, pa.binary()),
                ],
                ["id", "digest", "start", "runs", "place", "anchor", "segment"],
            )


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text."""
    fields = ("id", "digest", "start", "runs", "place", "copies", "anchor", "segment", "shard", "parts")
    for batch in batches:
        for at in range(batch.num_rows):
            raw = batch.column(0)[at].as_py().encode()
            wanted = batch.column(1).slice(at, 1).flatten()
            columns = dict(zip((field.name for field in wanted.type), wanted.flatten()))
            cut = [
                raw[start : start + runs + LENGTH - 1]
                for start, runs in zip(columns["start"].to_pylist(), columns["runs"].to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*(columns[f] for f in fields), pa.array(cut, pa.binary())], [*fields, "bytes"])


def refine(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each suffix), sorted by the first ``length`` bytes; equal ranks mean equal bytes.

    Larsson-Sadakane: suffixes sorted by h bytes are sorted by 2h, by the rank of the suffix h bytes on, and only
    within groups that are still tied. A rank is the group's first place. Past the end, bytes count as zero. Suffixes
    of one rank are in the order of the text.
    """
    size = len(data)
    depth = 8
    ahead = np.concatenate((data, np.zeros(depth, np.uint8))).astype(np.uint64)
    key = np.zeros(size, np.uint64)
    for at in range(depth):
        key = key << np.uint64(8) | ahead[at : at + size]
    order = np.argsort(key)
    rank = np.empty(size, np.int64)
    new = np.append(True, np.diff(key[order]) != 0)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(size), 0))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in the order, by ascending group
    while depth < length and len(tied):
        step = min(depth, length - depth)
        suffixes = order[tied]
        behind = suffixes + step
        second = np.where(behind < size, rank[np.minimum(behind, size - 1)] + 1, 0)
        first = rank[suffixes]
        place = np.argsort(first * (size + 1) + second)
        suffixes, first, second = suffixes[place], first[place], second[place]
        order[tied] = suffixes
        new = np.append(True, (np.diff(first) != 0) | (np.diff(second) != 0))
        rank[suffixes] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        depth += step
    return np.argsort(rank, kind="stable"), rank


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For each place in the order the common prefix with the suffix before it, up to ``length``, where both have one rank; else 0.

    After Kasai, the pairs of a suffix and its predecessor are taken by place in the text: where the next suffix has the
    next predecessor, their common prefix is one byte shorter, so a run of such pairs is compared once.
    """
    size = len(data)
    found = np.zeros(size, np.int64)
    places = np.flatnonzero(np.append(False, rank[order[1:]] == rank[order[:-1]]))
    if not len(places):
        return found
    by_text = places[np.argsort(order[places], kind="stable")]
    own = order[by_text]
    shift = own - order[by_text - 1]
    first = np.flatnonzero(np.append(True, (np.diff(own) != 1) | (np.diff(shift) != 0)))
    reach = np.diff(np.append(first, len(own))) + length - 1  # bytes to compare for each run of pairs
    upto = np.cumsum(reach)
    low = 0
    while low < len(first):
        high = max(int(np.searchsorted(upto, (upto[low - 1] if low else 0) + COMPARED_BYTES)), low + 1)
        part = slice(int(first[low]), int(first[high]) if high < len(first) else len(own))
        found[by_text[part]] = _compared(data, own[part], shift[part], first[low:high] - first[low], reach[low:high], length)
        low = high
    return found


def _compared(
    data: np.ndarray, own: np.ndarray, shift: np.ndarray, first: np.ndarray, reach: np.ndarray, length: int
) -> np.ndarray:
    """Common prefixes, up to ``length``, of the suffixes ``own`` with those ``shift`` before, by runs that begin at ``first``."""
    size = len(data)
    begins = np.cumsum(reach) - reach
    at = np.arange(int(reach.sum())) + np.repeat(own[first] - begins, reach)
    differs = at >= size
    at[differs] = size - 1
    differs |= data[at] != data[at - np.repeat(shift[first], reach)]
    stops = np.append(np.flatnonzero(differs), len(differs) + length)
    places = np.repeat(begins - first, reach - length + 1) + np.arange(len(own))
    return np.minimum(stops[np.searchsorted(stops, places)] - places, length)


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Spans of a shard's strings that repeat, and for anchors of several shards the hashes of the distinct strings."""
    rows = rows.drop_duplicates(["anchor", "segment"])  # repeated rows of a table are cut out each
    parts = [np.frombuffer(b, np.uint8) for b in rows["bytes"]]
    data = np.concatenate(parts)
    sizes = np.array([len(p) for p in parts])
    bases = np.cumsum(sizes) - sizes
    order, rank = refine(data, LENGTH)
    same = common_prefixes(data, order, rank, LENGTH) >= LENGTH
    runs = rows["runs"].to_numpy().astype(np.int64)
    bounds = np.append(0, np.cumsum(runs))
    owner = np.repeat(np.arange(len(rows)), runs)
    within = np.arange(len(owner)) - bounds[owner]
    starts = bases[owner] + within
    is_start = np.zeros(len(data), bool)
    is_start[starts] = True
    # Only these starts are whole strings; other suffixes of their rank run over the end of a segment.
    group = np.empty(len(data), np.int64)
    group[order] = np.cumsum(~same)
    group = group[starts]
    repeated = np.bincount(group)[group] > 1
    first = np.zeros(int(group.max()) + 1, np.int64)
    first[group[::-1]] = np.arange(len(group))[::-1]
    sent = (rows["parts"].to_numpy()[owner] > 1) & (first[group] == np.arange(len(group)))
    found, marks = [], []
    raw = data.tobytes()
    begins, places = rows["start"].to_numpy(), rows["place"].to_numpy()
    for at in range(len(rows)):
        low, high = bounds[at], bounds[at + 1]
        found.append(
            [{"low": int(begins[at] + a), "high": int(begins[at] + b)} for a, b in _joined(np.flatnonzero(repeated[low:high]))]
        )
        marks.append(
            [
                {"at": int(begins[at] + w), "mark": xxhash.xxh3_128_digest(raw[b : b + LENGTH], seed=int(places[at] - w))}
                for w, b in ((w, int(starts[low + w])) for w in np.flatnonzero(sent[low:high]))
            ]
        )
    kept = rows[["id", "digest", "copies", "anchor"]]
    return kept.assign(found=found, sent=marks)


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """Strings that several shards have: each is sought in the merged sorted lists of all shards by binary search."""
    marks = np.array([(m[:8], m[8:]) for m in rows["mark"]], dtype="S8,S8")
    _, codes = np.unique(marks, return_inverse=True)
    merged = np.sort(codes)
    times = np.searchsorted(merged, codes, "right") - np.searchsorted(merged, codes, "left")
    kept = rows[times > 1]
    return pd.DataFrame({"id": kept["id"], "digest": kept["digest"], "low": kept["at"], "high": kept["at"] + LENGTH})


def _joined(places: np.ndarray) -> list[tuple[int, int]]:
    """Union of the strings at these sorted places, as (start, end)."""
    if not len(places):
        return []
    breaks = np.flatnonzero(np.diff(places) > LENGTH)
    firsts, lasts = places[np.append(0, breaks + 1)], places[np.append(breaks, len(places) - 1)]
    return list(zip(firsts.tolist(), (lasts + LENGTH).tolist()))


RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _removed(with_text: bool):
    """Merge the spans of each text and hash what is left; with the text that stays on request."""
    import hashlib

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode()
                merged: list[list[int]] = []
                for span in sorted((s["low"], s["high"]) for s in spans or ()):
                    if merged and span[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], span[1])
                    else:
                        merged.append(list(span))
                kept, at = [], 0
                for low, high in merged:
                    kept.append(raw[at:low])
                    at = high
                kept.append(raw[at:])
                left = b"".join(kept)
                rows.append((len(raw), len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest()))
                texts.append(left)
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, (pa.int64(),) * 3 + (pa.string(),))]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(texts, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return made


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(id, digest, spans) of the texts of ``rows`` (id, text, digest) with a string that also starts elsewhere; spans (low, high) in bytes may overlap."""
    kind = rows.schema["id"].dataType.simpleString()
    owner = f"id {kind}, digest bigint"
    schema = f"{owner}, start bigint, runs int, place int, anchor bigint, segment binary"
    every = stage(rows.select("id", "text", "digest").mapInArrow(trimmed(_anchored), schema), "anchors")
    # Stored, so that both sides of the join are plain shuffles, whose hot partitions adaptive execution splits.
    often = stage(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "often")
    wanted = stage(every.join(often, "anchor", "left_semi"), "repeated-anchors")
    segments = stage(
        wanted.groupBy("anchor", "segment").agg(
            F.count("*").alias("copies"), F.min(F.struct("id", "digest", "start", "runs", "place")).alias("first")
        ),
        "segments",
    )
    # All strings of a segment with copies repeat. Only anchors with several distinct segments need their bytes.
    whole = wanted.join(segments.where("copies > 1").select("anchor", "segment"), ["anchor", "segment"], "left_semi")
    whole = whole.select("id", "digest", F.col("start").alias("low"), F.expr(f"start + runs + {LENGTH - 1}").alias("high"))
    variants = stage(segments.groupBy("anchor").agg(F.count("*").alias("variants")).where("variants > 1"), "variants")
    mixed = stage(segments.join(variants, "anchor").select("first.*", "anchor", "segment", "copies", "variants"), "mixed")
    size = mixed.agg(F.sum(F.col("runs") + LENGTH - 1)).first()[0] or 0
    shards = max(-(-size // SHARD_BYTES), 1)
    parts = F.ceil(F.col("variants") / SPLIT_SEGMENTS).cast("int")
    placed = mixed.withColumn("parts", parts).withColumn(
        "shard", F.pmod(F.xxhash64("anchor", F.pmod(F.xxhash64("segment"), "parts")), F.lit(shards))
    )
    fields = ["id", "digest", "start", "runs", "place", "copies", "anchor", "segment", "shard", "parts"]
    listed = placed.groupBy(F.col("id").alias("i"), F.col("digest").alias("d")).agg(F.collect_list(F.struct(*fields)).alias("wanted"))
    texts = may_match(rows.select("id", "digest", "text"), ["id", "digest"], mixed, ["id", "digest"])
    sources = texts.join(listed, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d"))).select("text", "wanted")
    cut = sources.mapInArrow(
        trimmed(_cut_out),
        f"{owner}, start bigint, runs int, place int, copies bigint, anchor bigint, segment binary, shard bigint, parts int, bytes binary",
    )
    found = "array<struct<low:bigint,high:bigint>>"
    sent = "array<struct<at:bigint,mark:binary>>"
    judged = cut.groupBy("shard").applyInPandas(_shard, f"{owner}, copies bigint, anchor bigint, found {found}, sent {sent}")
    judged = stage(judged, "shards")
    inside = judged.select("id", "digest", F.inline("found"))
    across = stage(judged.where(F.size("sent") > 0).select("id", "digest", F.inline("sent")), "split-anchors")
    buckets = max(-(-across.count() // MERGE_ROWS), 1)
    merged = across.groupBy(F.pmod(F.xxhash64("mark"), F.lit(buckets))).applyInPandas(_merged, f"{owner}, low bigint, high bigint")
    spans = whole.unionByName(inside).unionByName(merged)
    return stage(spans.groupBy("id", "digest").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "spans")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``, with the bytes that stay on request (kept).

    A byte is removed if a string of 400 bytes that covers it also starts anywhere else in the table, judged
    on the texts as they are. NULL texts are empty. Repeated rows hold each other's strings. An empty table
    gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    spans = repeated_spans(rows).withColumnsRenamed({"id": "i", "digest": "d"})
    joined = attach(rows, ["id", "digest"], spans, ["i", "d"])
    schema = f"id {kind}, {RESULT}" + (", kept binary" if with_text else "")
    return joined.select("id", "text", "spans").mapInArrow(trimmed(_removed(with_text)), schema)
