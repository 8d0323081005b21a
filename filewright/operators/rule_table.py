"""Classification rules as a table of any length.

The rules of ``functions.rules`` are one condition each on every text. Here texts and rules meet on a piece of
three to eight signs first: each alternative of a pattern has a run of plain signs that every match contains, and of
the longest pieces of that run the one that the fewest rules ask for. A bit table of all these pieces leaves of a text only the
pieces that some rule asks for, so few others are shuffled. A text is held only against the rules whose piece
it has, and the first of those that match, by precedence, is its rule. An alternative without three plain signs in a row has to be tried on
every text; such alternatives are conditions on the texts, as there.

Rules: of equal precedence the least pattern comes first. Patterns are matched as by ``functions.rules``, whatever the
case, on the file name and on the head of the text apart. NULL names and texts match nothing, and a rule without a pattern never does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.functions.rules import RULE_HEAD
from filewright.functions.text import literal
from filewright.sources.tables import materialize

RULES = "precedence BIGINT, pattern STRING, category_l1 STRING, category_l2 STRING, confidence DOUBLE, reason STRING"
PIECE, LONGEST = 3, 8
# The bit table has at least 32 bits a piece, while that is not above its greatest size of 8 MiB.
PIECE_BITS, LEAST_BITS, MOST_BITS = 32, 16, 26
CHUNK_BYTES = 1 << 20
_REPEATS = "?*{"


def alternatives(pattern: str) -> list[tuple[str, str | None]]:
    """(alternative, the longest run of plain signs in each of its matches, if it is long enough)."""
    made, start, at, runs, run = [], 0, 0, [], ""

    def close(end: int) -> None:
        longest = max([*runs, run], key=len)
        made.append((pattern[start:end], longest if len(longest) >= PIECE else None))

    while at < len(pattern):
        sign, width, plain = pattern[at], 1, None
        if sign == "\\" and at + 1 < len(pattern):
            width = 2
            following = pattern[at + 1]
            if following == "Q":
                return [(pattern, None)]
            if following == "b":
                at += 2
                continue  # a boundary takes no sign
            plain = None if following.isalnum() else following
        elif sign in "([":
            width = _closing(pattern, at) + 1 - at
        elif sign == "|":
            close(at)
            start, at, runs, run = at + 1, at + 1, [], ""
            continue
        elif sign not in ".^$?*+{}":
            plain = sign
        follow = pattern[at + width : at + width + 1]
        if plain is not None and plain.isascii() and follow not in tuple(_REPEATS):
            run += plain.lower()
            if follow == "+":
                runs, run = [*runs, run], ""
        elif sign not in "?*+{}":
            runs, run = [*runs, run], ""
        if sign == "{":
            width = max(pattern.find("}", at), at) + 1 - at
        at += width
    close(len(pattern))
    return made


def _closing(pattern: str, at: int) -> int:
    """Where the group or class that begins at a place ends."""
    depth, inside = 0, False
    while at < len(pattern):
        sign = pattern[at]
        if sign == "\\":
            at += 1
        elif inside:
            inside = sign != "]" or pattern[at - 1] == "["
        elif sign == "[":
            inside = True
        elif sign == "(":
            depth += 1
        elif sign == ")":
            depth -= 1
        if depth == 0 and not inside:
            return at
        at += 1
    return len(pattern) - 1


def _pieces(run: str) -> list[int]:
    """The pieces of a run of plain signs, of up to eight bytes each, as numbers."""
    signs = run.encode()
    length = min(len(signs), LONGEST)
    found = (int.from_bytes(signs[at : at + length], "little", signed=length == LONGEST) for at in range(len(signs) - length + 1))
    return list(dict.fromkeys(found))


def _split(rules: DataFrame) -> DataFrame:
    """(precedence, pattern, alternative, needed, pieces) of every alternative."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (p, t, alternative, needed, None if needed is None else _pieces(needed))
                for p, t in zip(batch["precedence"], batch["pattern"])
                for alternative, needed in alternatives(t)
            ]
            yield pd.DataFrame(rows, columns=["precedence", "pattern", "alternative", "needed", "pieces"])

    schema = "precedence BIGINT, pattern STRING, alternative STRING, needed STRING, pieces ARRAY<BIGINT>"
    return rules.where("precedence IS NOT NULL AND pattern IS NOT NULL").select("precedence", "pattern").mapInPandas(split, schema)


def _rarest(split: DataFrame) -> DataFrame:
    """Each alternative with the piece of its run that the fewest alternatives have."""
    every = split.where("needed IS NOT NULL").withColumn("piece", F.explode("pieces")).drop("pieces")
    asked = every.groupBy("piece").agg(F.count("*").alias("asked"))
    keys = ["precedence", "pattern", "alternative", "needed"]
    return every.join(asked, "piece").groupBy(*keys).agg(F.min_by("piece", F.struct("asked", "piece")).alias("piece"))


def _cells(pieces: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each piece (unsigned 64-bit numbers) in a table of 2**bits bits."""
    mixed = (pieces ^ (pieces >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(31)
    return (mixed & np.uint64((1 << bits) - 1)).astype(np.int64), (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _bit_table(pieces: DataFrame, bits: int) -> np.ndarray:
    """A table of 2**bits bits that has both places of every piece set."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.concatenate(_cells(batch.column(0).to_numpy().view(np.uint64), bits))
            words = np.left_shift(np.int64(1), cells & 63)
            yield pa.RecordBatch.from_arrays([pa.array(cells >> 6), pa.array(words)], ["at", "bits"])

    found = pieces.mapInArrow(placed, "at BIGINT, bits BIGINT").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[found["at"].to_numpy()] = found["bits"].to_numpy()
    return table.view(np.uint8)


def _asked(texts: DataFrame, lengths: list[int], bits: int, table: np.ndarray) -> DataFrame:
    """(id, piece) of the pieces of each text that may be in the table."""

    def in_table(cell: np.ndarray) -> np.ndarray:
        return table[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 > 0

    def chunk(data: np.ndarray, left: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.append(data, np.zeros(LONGEST, np.uint8)).astype(np.uint64)
        pieces, found = np.zeros(len(data), np.uint64), []
        for length in range(1, LONGEST + 1):
            pieces |= padded[length - 1 : length - 1 + len(data)] << np.uint64(8 * (length - 1))
            if length in lengths:
                whole = np.flatnonzero(left >= length)
                first, second = _cells(pieces[whole], bits)
                near = in_table(first)
                near[near] = in_table(second[near])
                found.append((owner[whole[near]], pieces[whole[near]]))
        owners, kept = (np.concatenate(column) for column in zip(*found))
        order = np.lexsort((kept, owners))
        owners, kept = owners[order], kept[order]
        new = np.append(True, (owners[1:] != owners[:-1]) | (kept[1:] != kept[:-1]))[: len(kept)]
        return owners[new], kept[new].view(np.int64)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = batch.column(1)
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(fields).to_numpy(zero_copy_only=False))
            values = fields.flatten().cast(pa.large_binary())
            if not len(values) or not lengths:
                continue
            _, ends, data = values.buffers()
            ends = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1]
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            first = 0
            while first < len(values):
                last = int(np.searchsorted(ends, ends[first] + CHUNK_BYTES, "right")) - 1
                last = min(max(last, first + 1), len(values))
                size = np.diff(ends[first : last + 1])
                left = np.repeat(ends[first + 1 : last + 1], size) - np.arange(ends[first], ends[last])
                owners, pieces = chunk(data[ends[first] : ends[last]], left, np.repeat(owner[first:last], size))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners)), pa.array(pieces)], ["id", "piece"])
                first = last

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "fields").mapInArrow(scanned, f"id {kind}, piece BIGINT")


def _folded(text: str) -> Column:
    # Two letters equal an ASCII letter when case is ignored, yet are lower case themselves.
    return F.replace(F.replace(F.lower(text), F.lit("ı"), F.lit("i")), F.lit("ſ"), F.lit("s"))


def _matches(alternative: str | Column) -> Column:
    """Whether one of ``fields`` has a match."""
    pattern = F.concat(F.lit("(?iU)"), alternative)
    return F.exists("fields", lambda field: F.regexp_like(field, pattern))


def classify(
    documents: DataFrame, rules: DataFrame, id_column: str = "document_id", filename: str = "filename", text: str = "text"
) -> DataFrame:
    """(id, precedence, pattern, category_l1, category_l2, confidence, reason) of every document that a rule matches."""
    split = materialize(_split(rules))
    texts = documents.select(F.col(id_column).alias("id"), F.array_compact(F.array(filename, F.left(F.col(text), F.lit(RULE_HEAD)))).alias("raw"))
    folded = F.transform("raw", lambda field: F.replace(F.replace(F.lower(field), F.lit("ı"), F.lit("i")), F.lit("ſ"), F.lit("s")))
    texts = texts.select("id", folded.alias("fields"))

    rarest = materialize(_rarest(split))
    known = rarest.agg(F.count_distinct("piece").alias("pieces"), F.collect_set(F.least(F.length("needed"), F.lit(LONGEST))).alias("lengths"))
    count, lengths = known.first()
    bits = min(max((PIECE_BITS * count).bit_length(), LEAST_BITS), MOST_BITS)
    asked = _asked(texts, lengths, bits, _bit_table(rarest.select("piece").distinct(), bits))
    # An alternative that is its own run needs no expression; what is the same as the pattern is not carried along.
    slim = rarest.select(
        *("piece", "precedence", "pattern"),
        F.when(F.lower("alternative") != F.col("needed"), F.col("alternative")).alias("alternative"),
        F.when(F.col("needed") != F.col("pattern"), F.col("needed")).alias("needed"),
    )
    met = asked.join(slim, "piece").select("id", "precedence", "pattern", "alternative", "needed")
    needed = F.coalesce("needed", "pattern")
    held = met.join(texts, "id").where(F.exists("fields", lambda field: F.contains(field, needed)))
    found = held.where(F.col("alternative").isNull() | _matches(F.col("alternative"))).select("id", "precedence", "pattern")

    # Settled by conditions, one for each: there are as many as the table has of this kind.
    open_rules = [(row.precedence, row.pattern, row.alternative) for row in split.where("needed IS NULL").collect()]
    if open_rules:
        kind = "struct<precedence:bigint,pattern:string>"
        cases = [
            F.when(_matches(F.lit(alternative)), F.expr(f"named_struct('precedence', {precedence}L, 'pattern', {literal(pattern)})"))
            for precedence, pattern, alternative in open_rules
        ]
        least = F.array_min(F.array(*[case.cast(kind) for case in cases]))
        tried = texts.select("id", least.alias("rule")).where("rule IS NOT NULL")
        found = found.unionByName(tried.select("id", "rule.precedence", "rule.pattern"))
    first = found.groupBy("id").agg(F.min(F.struct("precedence", "pattern")).alias("rule"))
    return first.select("id", "rule.precedence", "rule.pattern").join(rules.dropDuplicates(["precedence", "pattern"]), ["precedence", "pattern"])
