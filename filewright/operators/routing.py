"""Destination folders and names that do not collide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filewright.functions.paths import with_number
from filewright.operators.names import Names, intervals, numbered, placed_names, skipped, taken_numbers
from filewright.operators.skew import attach, has_room, rank_within
from filewright.settings import DUPLICATES, FAILED_EXTRACTION, NEEDS_REVIEW, Settings
from filewright.sources.tables import materialize


def technical_folder(category_l1: str, category_l2: str, needs_review: str, has_text: str) -> Column:
    """The folder of a document that gets no category folder, else NULL. Takes SQL expressions."""
    return F.expr(f"""CASE
        WHEN {category_l1} = '{DUPLICATES}' THEN '{DUPLICATES}'
        WHEN {needs_review} THEN '{NEEDS_REVIEW}'
        WHEN NOT {has_text} THEN '{FAILED_EXTRACTION}'
        WHEN coalesce({category_l1}, '') = '' OR coalesce({category_l2}, '') = '' THEN '{NEEDS_REVIEW}' END""")


def destination_folder(technical: Column, category_l1: Column, category_l2: Column) -> Column:
    return F.coalesce(technical, F.concat_ws("/", category_l1, category_l2))


def _reserved(names: DataFrame, existing: DataFrame) -> DataFrame:
    """Numbers that may not be given out: ``folder, filename, number``."""
    return taken_numbers(existing).unionByName(numbered(names)).distinct()


def _starts(marks: DataFrame, groups: DataFrame, keys: list[str], span: int) -> DataFrame:
    """For each piece of a line, the sum of all marks in earlier pieces, as a mark before its first place."""
    totals = marks.groupBy(*keys, "piece").agg(F.sum("passed").alias("passed"))
    last = groups.select(*keys, F.floor((F.col("wanted") - 1) / span).alias("last"))
    pieces = last.join(totals.select(*keys).distinct(), keys, "left_semi").select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("last"))).alias("piece")
    )
    earlier = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("passed").over(earlier), F.lit(0))
    return (
        pieces.join(totals, [*keys, "piece"], "left")
        .select(*keys, "piece", F.lit(-1).cast("bigint").alias("at"), before.alias("passed"))
        .where(F.col("passed") > 0)
    )


def _gaps_beside(groups: DataFrame, existing: DataFrame, settings: Settings) -> DataFrame:
    """``folder, filename, wanted, at, passed`` from every name that is there."""
    keys, span = ["folder", "filename"], settings.hot_rows
    # A name may have as many reserved numbers as requests, so they are joined
    # and ranked with the same splitting.
    reserved = materialize(_reserved(groups.select(*keys), placed_names(existing, settings)))
    sizes = reserved.groupBy(*keys).agg(F.count("*").alias("size"))
    kept = attach(reserved, groups.join(sizes, keys), keys, size="size", spread_by="number", hot_rows=span)
    kept = materialize(kept.where(F.col("wanted").isNotNull()))
    counted = rank_within(kept, keys, "number", "j", span)
    slack = (F.col("number") - F.col("j")).alias("at")
    gaps = counted.select(*keys, "wanted", slack).where(F.col("at") < F.col("wanted"))
    return gaps.groupBy(*keys, "at").agg(F.count("*").alias("passed"))


def _gaps_beside_intervals(groups: DataFrame, names: Names) -> DataFrame:
    """The same from the stored intervals of the wanted names and the names that are asked for."""
    keys = ["folder", "filename"]
    asked = intervals(numbered(groups.select(*keys)))
    marks = skipped(asked.unionByName(names.taken(groups.select(*keys))))
    return marks.join(groups, keys).where(F.col("at") < F.col("wanted")).select(*keys, "at", "passed")


def unique_names(requests: DataFrame, existing: DataFrame | Names, settings: Settings) -> DataFrame:
    """Add ``unique_name``: the wanted name, or the first free ``stem_N.ext``.

    Names are given in path order within ``folder, filename``. Taken are the
    ``destination_path`` values of ``existing``, or what stored names say of them, and every name another document
    asks for as such.

    The request of rank r gets the r-th number that is not reserved. With the
    reserved numbers of a name sorted as t0 < t1 < ..., that is r plus the count
    of reserved numbers with t_j - j <= r. Both sides are laid along one line
    and the count is a running sum over pieces of that line, so neither a name
    wanted by millions nor a long list of reserved numbers meets in one task.
    """
    keys, span = ["folder", "filename"], settings.hot_rows
    ranked = rank_within(requests, keys, "source_path", "rank", span)
    groups = requests.groupBy(*keys).agg(F.count("*").alias("wanted"))
    if isinstance(existing, Names):
        gaps = _gaps_beside_intervals(groups, existing)
    else:
        gaps = _gaps_beside(groups, existing, settings)

    piece = F.floor(F.col("at") / span).alias("piece")
    asked = ranked.withColumn("at", F.col("rank")).withColumn("piece", piece)
    marks = gaps.select(*keys, piece, "at", "passed")
    if not has_room(requests, span):
        marks = marks.unionByName(_starts(marks, groups, keys, span))
    both = asked.unionByName(marks, allowMissingColumns=True)
    # At the same place a mark comes before a request.
    along = Window.partitionBy(*keys, "piece").orderBy("at", F.col("rank").isNotNull())
    passed = F.coalesce(F.sum("passed").over(along.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return (
        both.withColumn("number", F.col("rank") + passed)
        .where(F.col("rank").isNotNull())
        .withColumn("unique_name", with_number(F.col("filename"), F.col("number")))
        .drop("rank", "at", "piece", "passed", "number")
    )


def destination_path(folder: Column, unique_name: Column, settings: Settings) -> Column:
    return F.concat_ws("/", F.lit(settings.organized_dir.rstrip("/")), folder, unique_name)
