"""SimHash near-duplicates, found by fuzzy hashing with the binary Golay code.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. If two
fingerprints differ in at most three bits, two of the segments differ in at most
one bit each. The Golay code is perfect: every word of 23 bits has exactly one
codeword within three bits. That codeword is within four bits of any word that
differs in one bit, so a fingerprint is filed under the nearest codewords of each
two segments and looked up under all codewords within four bits. Every pair of
the wanted kind meets in this way, and the difference is then counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate, chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filewright.llm.components import components
from filewright.llm.store import attach, fresh, may_match, passing, stage
from filewright.llm.text import mix, powers, text_bytes, trimmed

SEED = 42
MAX_BITS = 3
# Fixed values of the code: 23 bits, 12 of them free, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
CODE_BITS = 23
CHECK_BITS = 11
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = tuple(combinations(range(len(SEGMENTS)), 2))


def _remainder(word: int) -> int:
    for bit in range(CODE_BITS - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << bit - CHECK_BITS
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each bit, and by remainder the error patterns of up to four bits, the one of up to three first, -1 if none."""
    bits = np.array([_remainder(1 << bit) for bit in range(CODE_BITS)], np.int64)
    patterns = np.full((1 << CHECK_BITS, 6), -1, np.int64)
    filled = np.zeros(1 << CHECK_BITS, np.int64)
    for weight in range(5):
        for chosen in combinations(range(CODE_BITS), weight):
            rest = 0
            for bit in chosen:
                rest ^= int(bits[bit])
            if weight == 4 and patterns[rest, 0].item().bit_count() < 3:
                continue  # its nearest codeword is near enough for every neighbour
            patterns[rest, filled[rest]] = sum(1 << bit for bit in chosen)
            filled[rest] += 1
    return bits, patterns


_MADE: list = []


def codewords(words: np.ndarray) -> np.ndarray:
    """For each word of 23 bits the indices (12 bits) of its nearest codeword and of those within four bits; -1 fills up."""
    if not _MADE:
        _MADE.extend(_tables())
    bits, patterns = _MADE
    rest = np.zeros(len(words), np.int64)
    for bit in range(CODE_BITS):
        rest ^= np.where(words >> bit & 1, bits[bit], 0)
    errors = patterns[rest]
    return np.where(errors >= 0, (words[:, None] ^ np.maximum(errors, 0)) >> CHECK_BITS, -1)


def shingles(text: bytes, words: int) -> list[bytes]:
    """All runs of ``words`` words, or the whole sequence if it is shorter; none without a word."""
    tokens = text.lower().split()
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return [joined] if tokens else []
    ends = [end + at for at, end in enumerate(accumulate(map(len, tokens)))]
    starts = [0, *(end + 1 for end in ends[:-1])]
    return [joined[s:e] for s, e in zip(starts, ends[words - 1 :])]


def fingerprint(runs: list[bytes], seed: int = SEED) -> int:
    """The fingerprint of a text's shingles as a signed number; zero if there are none."""
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, len(runs), 1 << 16):
        hashes = np.array([digest(run, seed) for run in runs[low : low + (1 << 16)]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(runs), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, fp) of each row of ``docs``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column(1)) if batch.num_rows else (np.zeros(1, np.int64), b"")
            found = [fingerprint(shingles(data[s:e].tobytes(), words)) for s, e in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(made), f"id {kind}, fp bigint")


def _keys(every: bool):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for low in range(0, len(values), 4096):
                part = values[low : low + 4096]
                found = [codewords(part >> shift & (1 << width) - 1) for shift, width in SEGMENTS]
                if not every:
                    found = [near[:, :1] for near in found]
                keys, owners = [], []
                for at, (left, right) in enumerate(PAIRS):
                    key = (found[left][:, :, None] << 12 | found[right][:, None, :]) | at << 24
                    valid = (found[left] >= 0)[:, :, None] & (found[right] >= 0)[:, None, :]
                    keys.append(key[valid])
                    owners.append(np.broadcast_to(part[:, None, None], key.shape)[valid])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).astype(np.int32)), pa.array(np.concatenate(owners))], ["key", "fp"]
                )

    return made


def links(fps: DataFrame) -> DataFrame:
    """(a, b) with a > b: all pairs of the distinct fingerprints ``fps`` (fp) that differ in one to three bits."""
    filed = fps.select("fp").mapInArrow(trimmed(_keys(False)), "key int, fp bigint").withColumnRenamed("fp", "b")
    sought = fps.select("fp").mapInArrow(trimmed(_keys(True)), "key int, fp bigint").withColumnRenamed("fp", "a")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    met = sought.join(filed, (sought["key"] == filed["key"]) & (F.col("a") != F.col("b")) & close)
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3
) -> DataFrame:
    """(id, fp, component) of every row of ``docs``; the component is the least id that links reach.

    Rows with equal fingerprints are one node, so copies are never paired. A NULL
    text is empty; texts without a word have fingerprint 0 and are linked like
    any other. Repeated rows are kept, each with its result. A component whose
    ids are all NULL has component NULL. An empty table gives no rows.
    """
    made = stage(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = stage(made.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(links(nodes)).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    return made.join(named, "fp").select("id", "fp", "component")


# Near copies by similarity: links between texts whose sets of word shingles have at least this Jaccard similarity.
SIMILARITY, SIMILAR_WORDS = 0.8, 5
FINGERPRINTS = 4
# At that similarity 38 of the 256 bits differ on average, and 48 in the smallest sets, of four and five shingles. Pairs
# go on that are within four deviations of the latter, in the fingerprint where they meet and its neighbour and then in
# all; of unlike texts half of the bits differ.
SIMILAR_BITS, SIMILAR_BITS_OF_TWO = 73, 42
# In sets of this size and more 39 bits differ on average, and at most 63 within four deviations.
LARGE_SET, SIMILAR_BITS_OF_LARGE = 64, 63
SKETCH_BITS = 1024


def similar_fingerprints(hashes: np.ndarray) -> list[int]:
    """Fingerprints of a set of shingles by their hashes, each from another scattering of the bits."""
    made = []
    for turn in powers(0x9E3779B97F4A7C15, FINGERPRINTS):
        ones = np.zeros(64, np.int64)
        for low in range(0, len(hashes), 1 << 16):
            turned = mix(hashes[low : low + (1 << 16)] ^ turn).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(turned, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        made.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]))
    return made


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """For each of ``SKETCH_BITS`` cells whether an odd number of the hashes fall on it, as numbers of 64 bits.

    The bits in which the sketches of two sets differ are at most as many as the hashes that only one of them has.
    """
    cells = np.bincount((hashes % SKETCH_BITS).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits((cells & 1).astype(np.uint8), bitorder="little").view("<i8")


def _signed(words: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sketches = [], []
            offsets, data = text_bytes(batch.column(1)) if batch.num_rows else (np.zeros(1, np.int64), b"")
            for s, e in zip(offsets, offsets[1:]):
                runs = set(shingles(data[s:e].tobytes(), words))
                hashes = np.array([xxhash.xxh64_intdigest(run, SEED) for run in runs], "<u8")
                rows.append([len(runs), int(mix(hashes).sum(dtype=np.uint64).view(np.int64)), *similar_fingerprints(hashes)])
                sketches.append(odd_sketch(hashes))
            columns = np.array(rows, np.int64).reshape(len(rows), 2 + FINGERPRINTS).T
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    *(pa.array(np.ascontiguousarray(c)) for c in columns),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                ["id", "digest", "size", "sum", *(f"fp{k}" for k in range(FINGERPRINTS)), "sketch"],
            )

    return made


def _similar_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key for all pairs of near codewords of two segments of the first column, beside all columns."""
    for batch in batches:
        columns = [column.to_numpy() for column in batch.columns]
        for low in range(0, batch.num_rows, 256):
            part = [column[low : low + 256] for column in columns]
            found = [codewords(part[0] >> shift & (1 << width) - 1) for shift, width in SEGMENTS]
            keys, valid = [], []
            for at, (left, right) in enumerate(PAIRS):
                key = (found[left][:, :, None] << 12 | found[right][:, None, :]) | at << 24
                keys.append(key.reshape(len(part[0]), -1))
                valid.append(((found[left] >= 0)[:, :, None] & (found[right] >= 0)[:, None, :]).reshape(len(part[0]), -1))
            near = np.concatenate(valid, axis=1)
            owner = np.nonzero(near)[0]
            made = [np.concatenate(keys, axis=1)[near].astype(np.int32), *(column[owner] for column in part)]
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in made], ["key", *batch.schema.names])


# Of keys with at most this many prints only the prints are kept that are near another one of the key. Prints fall on keys
# by chance in proportion to their number, some 20 on each of 2**24 in three tables at 12 million prints.
SMALL_KEY = 40
# Keys of the fingerprints are told apart by the bits above these.
KEY_BITS = 26
TURNED = ("fp", "beside", "third", "fourth")  # the fingerprints of a print, from the one by which it is filed


def _near(columns: list[str], one: Callable[[str], Column], other: Callable[[str], Column]) -> Column:
    """Whether two prints differ in few bits, and may be alike by ``size``, ``alone`` and ``sketch``, if those are among ``columns``.

    ``alone`` is how many shingles of a text no other one has of those where it is known; so many fewer can be in common.
    Of a pair that is alike the sketches differ in no more bits than the shingles that one of both has.
    """
    bits = [F.bit_count(one(c).bitwiseXOR(other(c))) for c in TURNED if c in columns]
    near = bits[0] + bits[1] <= SIMILAR_BITS_OF_TWO
    if len(bits) > 2:
        small = F.least(one("size"), other("size")) < LARGE_SET
        most = F.when(small, SIMILAR_BITS).otherwise(SIMILAR_BITS_OF_LARGE)
        near = near & (sum(bits[1:], bits[0]) <= most)
    if "size" in columns:
        near = near & (F.least(one("size"), other("size")) >= SIMILARITY * F.greatest(one("size"), other("size")))
    if "alone" in columns:
        common = F.least(one("size") - one("alone"), other("size") - other("alone"))
        enough = common >= SIMILARITY * (one("size") + other("size") - common)
        near = near & (enough | one("alone").isNull() | other("alone").isNull())
    if "sketch" in columns:
        words = [F.bit_count(F.get(one("sketch"), at).bitwiseXOR(F.get(other("sketch"), at))) for at in range(SKETCH_BITS // 64)]
        both = one("size") + other("size")
        common = (both - sum(words[1:], words[0])) / 2
        near = near & (common >= SIMILARITY * (both - common))
    return near


def _near_rows(names: list[str], one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """``_near`` of rows side by side, by their columns ``names``."""
    bits = [np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int16) for name, a, b in zip(names, one, other) if name in TURNED]
    near = bits[0] + bits[1] <= SIMILAR_BITS_OF_TWO
    if "size" in names:
        a, b = (columns[names.index("size")] for columns in (one, other))
        less, more = np.minimum(a, b), np.maximum(a, b)
        near &= less >= SIMILARITY * more
        if len(bits) > 2:
            near &= sum(bits[1:], bits[0]) <= np.where(less < LARGE_SET, SIMILAR_BITS, SIMILAR_BITS_OF_LARGE)
    return near


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of key and print those that ``_shared_keys`` keeps, with the first print of their key.

    A row is settled when ``SMALL_KEY`` rows after it are known, so a key of any length passes in pieces.
    """
    columns, near, first, before = None, None, None, 0  # rows not yet settled, and the key that begins ahead of them
    for batch in chain(batches, [None]):
        if batch is not None:
            names = batch.schema.names[1:]
            added = [column.to_numpy() for column in batch.columns]
            columns = added if columns is None else [np.concatenate(both) for both in zip(columns, added)]
            near = np.append(np.zeros(0, bool) if near is None else near, np.zeros(batch.num_rows, bool))
        size = 0 if columns is None else len(near)
        done = size if batch is None else size - SMALL_KEY
        if done <= 0:
            continue
        key, prints = columns[0], columns[1:]
        for far in range(1, min(SMALL_KEY, size)):
            at = np.flatnonzero(key[far:] == key[:-far])
            if not len(at):
                break
            at = at[~(near[at] & near[at + far])]
            at = at[_near_rows(names, [c[at] for c in prints], [c[at + far] for c in prints])]
            near[at] = near[at + far] = True
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        lengths = np.diff(np.append(starts, size))
        total, place = np.repeat(lengths, lengths), np.arange(size) - np.repeat(starts, lengths)
        begin = np.arange(size) - place
        if first is not None and first[0] == key[0]:
            total[: lengths[0]] += before
            place[: lengths[0]] += before
        else:
            first = None
        kept = np.flatnonzero((total > 1) & (near | (total > SMALL_KEY)) & (np.arange(size) < done))
        firsts = [column[begin[kept]] for column in prints]
        if first is not None:
            for column, value in zip(firsts, first[1:]):
                column[kept < lengths[0]] = value
        if len(kept):
            mine = [column[kept] for column in prints]
            tied = (place[kept] > 0) & _near_rows(names, mine, firsts)
            made = [key[kept], *mine, *firsts, tied, near[kept] | tied]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column) for column in made], ["key", *names, *(f"first_{name}" for name in names), "tied", "met"]
            )
        if done < size:
            before = int(place[done])
            if not before:
                first = None
            elif first is None or begin[done]:
                first = [column[begin[done]] for column in columns]
            columns, near = [column[done:] for column in columns], near[done:]


def _shared_keys(prints: DataFrame) -> DataFrame:
    """The keys of ``prints`` (fp, beside and more of ``TURNED``, size, one) that several have, each with the least print of the key.

    Most keys are shared by chance, by few and unlike prints. A print of such a key that is in no pair is left out; of keys with
    more than ``SMALL_KEY`` prints all stay. ``tied`` says whether a print and the least one are another and near, and ``met``
    whether it is known to be near any.
    """
    columns = prints.columns
    numbers = ", ".join(f"{c} bigint" for c in columns)
    keys = prints.mapInArrow(trimmed(_similar_keys), f"key int, {numbers}")
    # Keys go by their first codeword: those of one print that have it in common follow each other, so that they compress.
    dealt = keys.repartition(F.shiftright("key", 12)).sortWithinPartitions("key", *columns)
    firsts = [F.col(f"first_{c}").alias(c) for c in columns]
    schema = f"key int, {numbers}, " + ", ".join(f"first_{c} bigint" for c in columns) + ", tied boolean, met boolean"
    held = dealt.mapInArrow(trimmed(_held), schema)
    least = [F.col("first_fp").alias("least"), F.col("first_beside").alias("least2")]
    return held.select("key", *columns, *least, F.struct(*firsts).alias("first"), "tied", "met")


def _pairs_with_least(shared: DataFrame) -> DataFrame:
    """(a, b) of each print and one that is near: of the least prints of its keys the least of each
    fingerprint, so no more pairs than prints for each."""
    return shared.where("tied").groupBy("one", F.shiftright("key", KEY_BITS)).agg(F.min("first").alias("first")).select(F.col("one").alias("a"), F.col("first.one").alias("b"))


def _turned(prints: DataFrame, names: list[str], at: int) -> DataFrame:
    turned = [*names[at:], *names[:at]]
    return prints.withColumnsRenamed(dict(zip(turned, TURNED))).select(*TURNED, *(c for c in prints.columns if c not in names))


def _turned_by_key(keys: DataFrame, names: list[str]) -> DataFrame:
    """Keys beside the fingerprints ``names`` of their prints, from the one by which each key was made."""
    at = F.shiftright("key", KEY_BITS)
    every = F.array(*names)
    turned = [F.get(every, (at + k) % len(names)).alias(name) for k, name in enumerate(TURNED)]
    return keys.select("key", *turned, *(c for c in keys.columns if c not in ("key", *names)))


def _mixed(keys: DataFrame) -> DataFrame:
    """The rows of those keys that prints of several components ``top`` share; ``main`` are those of its most frequent component."""
    same = Window.partitionBy("key")
    counted = keys.withColumn("n", F.count("*").over(Window.partitionBy("key", "top")))
    counted = counted.withColumns({"most": F.max(F.struct("n", "top")).over(same), "low": F.min("top").over(same), "high": F.max("top").over(same)})
    mixed = counted.where("low <> high").withColumn("main", F.col("top") == F.col("most.top"))
    return mixed.drop("n", "most", "low", "high")


def _pairs_with_centre(keys: DataFrame) -> DataFrame:
    """(a, b) of each print and one that is near and of another component: of the prints with the smallest part of shingles
    alone in each of its keys the first of each fingerprint, so no more pairs than prints for each."""
    columns = [c for c in keys.columns if c not in ("key", "main")]
    part = F.coalesce(F.col("alone") / F.col("size"), F.lit(1.0)).alias("part")
    held = keys.withColumn("first", F.min(F.struct(part, *columns)).over(Window.partitionBy("key")))
    held = held.where((F.col("first.top") != F.col("top")) & _near(columns, F.col, F.col("first").getField))
    return held.groupBy("one", F.shiftright("key", KEY_BITS)).agg(F.min("first").alias("first")).select(F.col("one").alias("a"), F.col("first.one").alias("b"))


def _pairs_apart(keys: DataFrame) -> DataFrame:
    """(a, b) of all prints that share a key and are near, but those of one component.

    In each key the prints of its most frequent component are held against the others alone.
    """
    left, right = keys.where("NOT main").alias("l"), keys.alias("r")
    near = _near(keys.columns, lambda c: F.col(f"l.{c}"), lambda c: F.col(f"r.{c}"))
    once = F.col("r.main") | (F.col("l.one") < F.col("r.one"))
    met = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.top") != F.col("r.top")) & once & near)
    return met.select(F.col("l.one").alias("a"), F.col("r.one").alias("b"))


def _pairs(found: list[DataFrame]) -> DataFrame:
    """(a, b) with a > b of all of several lists, each once."""
    every = [one.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct() for one in found]
    return stage(reduce(DataFrame.unionByName, every).distinct(), "similar-pairs")


def _topped(prints: DataFrame, links: DataFrame) -> DataFrame:
    """The prints, each with the component ``top`` that links of their texts make."""
    roots = components(links).select(F.col("node").alias("one"), F.col("root").alias("top"))
    return stage(prints.join(roots, "one", "left").withColumn("top", F.coalesce("top", "one")), "joined-prints")


def _similar_links(
    prints: DataFrame, same: DataFrame, names: list[str], nodes: DataFrame, rows: DataFrame, signed: DataFrame
) -> DataFrame:
    """(a, b) of texts with enough shingles in common, which join all that candidates join.

    ``prints`` are the distinct sets of shingles, by the least text ``one`` of each, and ``same`` are the other texts of a set with
    that one. Candidates are prints that share a key of one of their fingerprints and are near. First each print is held against
    the least print of its keys alone, then, by what is not joined, against the print of its keys with the fewest
    shingles alone, so a group of near copies makes pairs in proportion to its size; what is still apart then is held against all.
    In these two passes the sketches of all shingles, from ``signed``, leave out nearly all pairs that are near by their
    fingerprints and not alike, so texts of one origin that were changed too much make no pairs with each other.
    """
    shared = []
    for at, name in enumerate(names):  # one at a time, as every print has many keys
        kept = _shared_keys(_turned(prints, names, at)).withColumn("key", F.col("key") + F.lit(at << KEY_BITS))
        shared.append(stage(kept.select("key", "one", "tied", "met", F.when(F.col("tied"), F.col("first")).alias("first")), f"shared-keys-{name}"))
    shared = reduce(DataFrame.unionByName, shared)
    pairs = _pairs([_pairs_with_least(shared), same])
    links = _alike(pairs, nodes, rows)
    joined = _topped(prints, links)
    apart = stage(_mixed(shared.select("key", "one", "met").join(joined.select("one", "top"), "one")).select("key", "one", "met"), "keys-apart")
    known = _runs(apart.where("met").select(F.col("one").alias("node")), nodes, rows)
    single = known.select("node", F.explode("runs").alias("run")).groupBy("run").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    single = single.where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    alone = known.select("node").join(single, "node", "left").select(F.col("node").alias("one"), F.coalesce("alone", F.lit(0)).alias("alone"))
    sketches = _sketches(apart.select(F.col("one").alias("node")), nodes, signed).withColumnRenamed("node", "one")
    facts = stage(sketches.join(alone, "one", "left"), "facts")

    def open_keys(tops: DataFrame) -> DataFrame:
        mixed = _mixed(apart.select("key", "one").join(tops.select("one", "top"), "one"))
        return stage(_turned_by_key(mixed.join(tops.drop("top").join(facts, "one"), "one"), names), "keys-open")

    links = links.unionByName(_alike(_pairs([_pairs_with_centre(open_keys(joined))]), nodes, rows))
    return links.unionByName(_alike(_pairs([_pairs_apart(open_keys(_topped(prints, links)))]), nodes, rows))


def _shingle_hashes(words: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                runs = set(shingles((batch.column(1)[at].as_py() or "").encode(), words))
                hashes = np.array([xxhash.xxh64_intdigest(run, SEED) for run in runs], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 1), pa.array([np.unique(hashes)], pa.list_(pa.int64()))], ["digest", "runs"]
                )

    return made


def _runs(ends: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, runs) of the texts ``node`` of ``ends``: the hashes of their shingles."""
    wanted = stage(ends.distinct().join(nodes.select("node", "digest", "first.id"), "node"), "similar-texts")
    texts = may_match(rows.select("id", "text", "digest"), ["digest"], wanted, ["digest"])
    chosen = texts.join(wanted.select("digest", F.col("id").alias("i")), "digest").where(F.col("id").eqNullSafe(F.col("i")))
    runs = chosen.select("digest", "text").mapInArrow(trimmed(_shingle_hashes(SIMILAR_WORDS)), "digest string, runs array<bigint>")
    return stage(runs.dropDuplicates(["digest"]).join(wanted.select("digest", "node"), "digest").select("node", "runs"), "shingles")


def _sketches(ends: DataFrame, nodes: DataFrame, signed: DataFrame) -> DataFrame:
    """(node, sketch) of the texts ``node`` of ``ends``."""
    wanted = stage(ends.distinct().join(nodes.select("node", "digest", "first.id"), "node"), "sketched-texts")
    known = may_match(signed.select("id", "sketch", "digest"), ["digest"], wanted, ["digest"])
    chosen = known.join(wanted.select("node", "digest", F.col("id").alias("i")), "digest").where(F.col("id").eqNullSafe(F.col("i")))
    return chosen.select("node", "sketch").dropDuplicates(["node"])


def _alike(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts, of ``rows``, have enough shingles in common."""
    runs = _runs(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, rows)
    left, right = (runs.select(F.col("node").alias(n), F.col("runs").alias(f"runs_{n}")) for n in ("a", "b"))
    shared = F.size(F.array_intersect("runs_a", "runs_b"))
    enough = shared >= SIMILARITY * (F.size("runs_a") + F.size("runs_b") - shared)
    return stage(pairs.join(left, "a").join(right, "b").where(enough).select("a", "b"), "similar-links")


def similar_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, kept, least, repeats) of every text that has copies or near copies; the digest is the MD5 of the text.

    Texts are linked if the Jaccard similarity of their sets of five-word shingles is at least 0.8; texts without a word are
    copies of each other. ``kept`` says whether the text stays for its group, ``least`` is the id of the row that
    stays then, and ``repeats`` says how often that row is there. Candidates meet in a pair of near
    codewords of one of four fingerprints, which misses few pairs even at the bound; each is verified on the whole texts.
    Two passes join most of each group through few of its texts; the last makes the pairs that they left apart.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.md5(F.coalesce(text_col, F.lit(""))).alias("digest")
    )
    names = [f"fp{k}" for k in range(FINGERPRINTS)]
    schema = f"id {kind}, digest string, size bigint, sum bigint, " + ", ".join(f"{name} bigint" for name in names)
    schema += ", sketch array<bigint>"
    signed = stage(rows.select("id", "text", "digest").mapInArrow(trimmed(_signed(SIMILAR_WORDS)), schema), "signatures")
    # Texts without a word are one node, whatever their white space.
    signed = signed.withColumn("digest", F.when(F.col("size") == 0, "").otherwise(F.col("digest")))
    alike = ["size", "sum", *names]
    counted = signed.groupBy("digest", "id", *alike).agg(F.count("*").alias("repeats"))
    nodes = stage(
        counted.groupBy("digest", *alike)
        .agg(F.min(F.struct(F.col("id").isNull(), "id", "repeats")).alias("first"), F.sum("repeats").alias("rows"))
        .withColumn("node", F.monotonically_increasing_id()),
        "texts",
    )
    # Texts with the same shingles are one print, by the least of them.
    worded = nodes.where("size > 0").select("node", *alike)
    prints = stage(worded.groupBy(*alike).agg(F.min("node").alias("one"), F.count("*").alias("n")), "prints")
    same = worded.join(prints.where("n > 1"), alike).where("node <> one").select(F.col("node").alias("a"), F.col("one").alias("b"))
    links = _similar_links(prints.select(*names, "size", "one"), same, names, nodes, rows, signed)
    roots = components(links).withColumnRenamed("root", "top")
    rooted = nodes.join(roots, "node", "left").where("top IS NOT NULL OR rows > 1").withColumn("top", F.coalesce("top", "node"))
    best = rooted.groupBy("top").agg(F.min(F.struct("first", "node")).alias("best"))
    return rooted.join(best, "top").select(
        "digest",
        (F.col("node") == F.col("best.node")).alias("kept"),
        F.col("first.id").alias("least"),
        F.col("first.repeats").alias("repeats"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of copies and near copies: that of the least id; NULL ids come last."""
    mark, digest, kept, least, repeats = (fresh(docs, n) for n in ("mark", "group_digest", "group_kept", "group_least", "group_repeats"))
    with passing(docs.sparkSession) as tables:
        groups = stage(similar_groups(docs, id_col, text_col), "groups").toDF(digest, kept, least, repeats)
        tables.pop()  # the groups stay
    no_word = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    marked = docs.withColumn(mark, F.when(no_word, "").otherwise(F.md5(text_col)))
    joined = attach(marked, [mark], groups, [digest])
    stays = F.col(digest).isNull() | (F.col(kept) & F.col(id_col).eqNullSafe(F.col(least)))
    joined = joined.where(stays)
    once = joined.where(F.coalesce(F.col(repeats), F.lit(1)) == 1)
    again = joined.where(F.col(repeats) > 1).dropDuplicates([mark])
    return once.unionByName(again).select(*docs.columns)
