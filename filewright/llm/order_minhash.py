"""Document fingerprints by Order MinHash: signatures that follow the edit distance of texts.

A text is a sequence of k-mers, here of pieces of words. Equal k-mers are told apart by numbering their
occurrences, the numbered k-mers are put in a pseudo-random order, and the least few of them, taken in the
order in which the text has them, are hashed to one number. Texts that hold the same k-mers in another order
or another number of times get different numbers, which plain MinHash would not tell apart.

The pseudo-random orders of a fingerprint are rotations of one order: the j-th starts at the j-th of equally
spaced places of the circle of hash values. So one sort serves all of them, and each is a min-wise order by
itself. All of it is column expressions, with the sorts on arrays of plain numbers inside a row: no k-mer is
ever shuffled, and a row needs memory for its own text only.

Texts: NULL is empty. White space separates pieces and is no part of any. A text of fewer pieces than a k-mer
is one k-mer, one of fewer k-mers than a tuple gives shorter tuples, and one without any has the fingerprint of
the empty tuple, so texts without pieces are alike. Equal texts have equal fingerprints.

Documents: any type of id that can be sorted. NULL ids come first, rows of one id are in the order of a digest
of their texts, and repeated rows follow each other. Further columns are ignored, whatever their names; an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = r"[^\x20\x09-\x0D]{1,32}"
GRAM = 2  # pieces in a k-mer
TUPLE = 2  # k-mers in a tuple
SIGNATURES = 64
PART_BYTES = 1 << 27  # of text in a range of neighbouring documents, by which a longer table gets more ranges

PLACE_BITS = 28  # more than the elements an array can have
PLACE = (1 << PLACE_BITS) - 1
HASH = ((1 << 63) - 1) ^ PLACE


def _same_gram(left: Column, right: Column) -> Column:
    return F.shiftright(left, PLACE_BITS) == F.shiftright(right, PLACE_BITS)


def _numbered(ordered: Column, value: Column, at: Column) -> Column:
    """The k-mer at ``at`` with how many equal ones come before it; equal ones are neighbours, so steps are halved."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(PLACE_BITS - 1))])

    def longer(back: Column, step: Column) -> Column:
        reached = at - back - step
        fits = (reached >= 0) & _same_gram(F.get(ordered, F.greatest(reached, F.lit(0))), value)
        return F.when(fits, back + step).otherwise(back)

    occurrence = F.aggregate(steps, F.lit(0), longer)
    hashed = F.xxhash64(F.shiftright(value, PLACE_BITS), occurrence).bitwiseAND(F.lit(HASH))
    repeated = (at > 0) & _same_gram(F.get(ordered, F.greatest(at - 1, F.lit(0))), value)
    return F.when(repeated, hashed.bitwiseOR(value.bitwiseAND(F.lit(PLACE)))).otherwise(value)


def _tuple_hash(placed: Column, circle: Column, first: Column) -> Column:
    """Hash of the k-mers from ``first`` on in the circle, in the order of the text."""
    places = [F.get(circle, first + taken).bitwiseAND(F.lit(PLACE)) for taken in range(TUPLE)]
    # With one k-mer in the text the places are equal, with none they are NULL.
    if TUPLE == 2:
        in_text = [F.least(*places), F.greatest(*places)]
    else:
        in_order = F.sort_array(F.array(*places))
        in_text = [F.get(in_order, F.lit(taken)) for taken in range(TUPLE)]
    grams = [F.shiftright(F.get(placed, (place - 1).cast("int")), PLACE_BITS) for place in in_text]
    return F.shiftrightunsigned(F.xxhash64(*grams), 32)


def with_sketch(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with ``name``, an array of ``SIGNATURES`` numbers of 32 bits. Names that begin with ``name`` are taken.

    Each step is a projection that uses the one before more than once, so the optimizer keeps them apart and
    every array is made once a row.
    """
    kept = rows.columns
    pieces, placed, grouped, ordered, marked = (f"{name}_{part}" for part in ("pieces", "placed", "grouped", "ordered", "marked"))
    rows = rows.withColumn(pieces, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0)))
    count = F.greatest(F.size(pieces) - (GRAM - 1), F.least(F.size(pieces), F.lit(1)))

    def gram(piece: Column, at: Column) -> Column:
        hashed = F.xxhash64(piece, *[F.get(F.col(pieces), at + step) for step in range(1, GRAM)])
        # Hash in the high bits, place in the text from 1 in the low ones: arrays of numbers sort fast.
        return hashed.bitwiseAND(F.lit(HASH)).bitwiseOR((at + 1).cast("long"))

    rows = rows.withColumn(placed, F.transform(F.slice(pieces, F.lit(1), count), gram)).drop(pieces)
    rows = rows.withColumn(grouped, F.sort_array(placed))
    numbered = F.transform(grouped, lambda value, at: _numbered(F.col(grouped), value, at))
    rows = rows.withColumn(ordered, F.sort_array(numbered)).drop(grouped)
    turns = F.array(*[F.lit(turn * ((1 << 63) // SIGNATURES) & HASH) for turn in range(SIGNATURES)])
    rows = rows.withColumn(marked, F.sort_array(F.concat(F.col(ordered), turns)))
    starts = F.filter(
        F.transform(marked, lambda value, at: F.when(value.bitwiseAND(F.lit(PLACE)) == 0, at).otherwise(F.lit(-1))),
        lambda at: at >= 0,
    )
    # The circle goes on for a tuple and for the marks at its end; a text of few k-mers goes round often.
    circle = F.flatten(F.array_repeat(F.col(ordered), F.ceil(F.lit(TUPLE) / F.greatest(F.size(ordered), F.lit(1))).cast("int") + 1))
    rows = rows.select(*kept, placed, circle.alias(ordered), starts.alias(marked))
    sketch = F.transform(marked, lambda start, turn: _tuple_hash(F.col(placed), F.col(ordered), start - turn))
    return rows.withColumn(name, sketch).select(*kept, name)


def fingerprint(sketch: str | Column) -> Column:
    """A sketch as a string of its numbers."""
    return F.array_join(F.col(sketch).cast("array<string>"), " ")


def likeness(left: str, right: str) -> Column:
    """The share of equal signatures, which estimates how much of their order two texts share."""
    equal = F.zip_with(left, right, lambda one, other: (one == other).cast("int"))
    return F.aggregate(equal, F.lit(0), lambda total, value: total + value) / F.lit(float(SIGNATURES))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text, sketch) of every row of ``docs``."""
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    return with_sketch(texts, "text", "sketch")


def _cuts(keys: DataFrame, parts: int) -> list:
    """The least key of each range partition of ``keys`` that has rows, in order: at most ``parts`` values."""
    ranged = keys.repartitionByRange(parts, F.col("key").asc_nulls_first())
    least = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key"))
    return [row.key for row in least.orderBy("part").collect()]


def with_next(rows: DataFrame, order: list[str], follow: list[str], size: str | None = None) -> DataFrame:
    """``rows`` with the columns ``next_*`` of the row that follows in ``order``, that of the last being the first row.

    Only the columns of ``order`` are sorted over all tasks, for the cuts between ranges of about
    ``PART_BYTES`` by the column ``size``. The rows go through one shuffle, to their range, and the first of
    each range also to the end of the one before; within a range a window looks ahead.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if size is not None:
        parts = max(parts, (rows.agg(F.sum(size)).first()[0] or 0) // PART_BYTES)
    key = F.struct(*order)
    cuts = _cuts(rows.select(key.alias("key")), parts)
    if not cuts:
        return rows.select("*", *[F.col(name).alias(f"next_{name}") for name in follow])
    kind = rows.select(key.alias("key")).schema["key"].dataType
    bounds = F.array(*[F.struct(*[F.lit(cut[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields]) for cut in cuts])
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(len(cuts).bit_length()))])

    def farther(at: Column, step: Column) -> Column:
        fits = (at + step < len(cuts)) & (F.get(bounds, F.least(at + step, F.lit(len(cuts) - 1))) <= key)
        return F.when(fits, at + step).otherwise(at)

    part = F.aggregate(steps, F.lit(0), farther)
    before = F.pmod(F.col("part") + len(cuts) - 1, F.lit(len(cuts))).cast("int")
    own = F.struct(F.col("part"), F.lit(False).alias("copy"))
    copy = F.struct(before.alias("part"), F.lit(True).alias("copy"))
    first = F.get(bounds, F.col("part")) == key
    dealt = rows.withColumn("part", part).withColumn("goes", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))))
    window = Window.partitionBy("goes.part").orderBy("goes.copy", *[F.col(name).asc_nulls_first() for name in order])
    ahead = dealt.select("*", F.lead(F.struct(*follow)).over(window).alias("ahead"))
    names = [F.col(f"ahead.{name}").alias(f"next_{name}") for name in follow]
    return ahead.where("NOT goes.copy").select(*rows.columns, *names)


def halves_swapped(text: str, following: str) -> Column:
    """``text`` with its last half of code points, rounded down, replaced by as many of the first of ``following``."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.left(F.col(text), F.char_length(text) - half), F.left(F.col(following), half))


def edited(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text, sketch, edited_text, edited_sketch, next_sketch): each text beside an edited one and the next one."""
    rows = fingerprints(docs, id_column, text_column)
    rows = rows.withColumn("digest", F.xxhash64("text")).withColumn("size", F.octet_length("text").cast("bigint"))
    rows = with_next(rows, ["id", "digest"], ["text", "sketch"], "size")
    rows = rows.select("id", "text", "sketch", halves_swapped("text", "next_text").alias("edited_text"), "next_sketch")
    return with_sketch(rows, "edited_text", "edited_sketch")


def digest(rows: DataFrame) -> DataFrame:
    """Lengths, checksums, fingerprints and likeness of the rows of ``edited``."""
    return rows.select(
        "id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        fingerprint("sketch").alias("fingerprint"),
        fingerprint("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )
