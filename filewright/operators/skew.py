"""Exact joins and ranks that stay even when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filewright.sources.tables import materialize

# Salts over which rows without a key are spread. They meet nothing on the other side.
_KEYLESS_SALTS = 1 << 20


def has_room(rows: DataFrame, hot_rows: int) -> bool:
    """Whether so few rows are there that no key can be hot. Costs a count, so use it on stored rows."""
    return rows.count() <= hot_rows


def attach(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], *, size: str, spread_by: str, hot_rows: int
) -> DataFrame:
    """Left join ``rows`` to ``facts``, which has one row per key.

    ``facts[size]`` says how many rows share the key. A key with more than
    ``hot_rows`` of them gets one salt per ``hot_rows``, on both sides. The list
    of such keys is at most total rows / ``hot_rows`` long, so it is broadcast.
    Rows whose key is NULL match nothing and are spread as well. With no more
    than ``hot_rows`` rows in all, this is a plain join.
    """
    keys = list(keys)
    if has_room(rows, hot_rows):
        return rows.join(facts, keys, "left")
    salts = F.ceil(F.col(size) / hot_rows).cast("int")
    hot = facts.where(F.col(size) > hot_rows).select(*keys, salts.alias("salts"))
    spread = F.xxhash64(spread_by)
    has_key = F.lit(True)
    for key in keys:
        has_key = has_key & F.col(key).isNotNull()
    salt = F.when(has_key, F.pmod(spread, F.coalesce("salts", F.lit(1)))).otherwise(
        F.pmod(spread, F.lit(_KEYLESS_SALTS))
    )
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", salt.cast("int")).drop("salts")
    right = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return left.join(right, [*keys, "salt"], "left").drop("salt")


def _position(cuts: str, value: str) -> Column:
    """How many of the sorted cuts are not above the value, by binary search."""
    steps = ", ".join(str(1 << power) for power in range(20, -1, -1))
    return F.expr(f"""CASE WHEN {cuts} IS NULL THEN 0 ELSE aggregate(array({steps}), 0,
        (at, step) -> CASE WHEN coalesce(get({cuts}, at + step - 1) <= {value}, false) THEN at + step ELSE at END) END""")


def rank_within(rows: DataFrame, keys: Sequence[str], order: str, name: str, hot_rows: int) -> DataFrame:
    """Number the rows of each key from 0 in the order of a column that is unique within it.

    While no key has more than ``hot_rows`` rows this is one window. Larger
    groups are cut at values drawn from the group itself, four per ``hot_rows``
    on average. Each piece is ranked alone and shifted by the pieces before it.
    ``rows`` is read several times, so it should be a stored table.
    """
    keys = list(keys)
    window = Window.partitionBy(*keys).orderBy(order)
    plain = rows.withColumn(name, (F.row_number().over(window) - 1).cast("bigint"))
    if has_room(rows, hot_rows):
        return plain
    hot = rows.groupBy(*keys).agg(F.count("*").alias("size")).where(F.col("size") > hot_rows).select(*keys)
    hot = materialize(hot)
    if hot.isEmpty():
        return plain

    drawn = F.pmod(F.xxhash64(order), F.lit(hot_rows)) < 4
    # About 4 x total rows / hot_rows values in all, hence safe to broadcast.
    cuts = (
        rows.join(F.broadcast(hot), keys, "left_semi")
        .where(drawn)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set(order)).alias("cuts"))
    )
    cuts = materialize(cuts)
    placed = rows.join(F.broadcast(cuts), keys, "left").withColumn("piece", _position("cuts", order))
    pieces = placed.where(F.col("cuts").isNotNull()).groupBy(*keys, "piece").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = pieces.select(*keys, "piece", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("shift"))
    in_piece = Window.partitionBy(*keys, "piece").orderBy(order)
    return (
        placed.join(F.broadcast(shifts), [*keys, "piece"], "left")
        .withColumn(name, F.row_number().over(in_piece) - 1 + F.coalesce("shift", F.lit(0)))
        .drop("cuts", "piece", "shift")
    )


def latest_by(rows: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """The last row of each key, combined before the shuffle."""
    last = F.max_by(F.struct(*columns), order).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*")

