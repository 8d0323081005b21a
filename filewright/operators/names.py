"""Taken file names as intervals of numbers, kept from run to run.

``report.txt`` takes number 0 of the name ``report.txt``, and ``report_7.txt`` its number 7. What a run takes
of a name is kept as runs of successive numbers, from first to last, a partition for each run, bucketed by
name. So a name that was given out a million times is one row, the free numbers are the gaps
between rows, and a run reads the intervals of the names it wants instead of every name in the ledger. After an undo
the run's intervals are made anew from what is left of it, and its names are free again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filewright.functions.paths import folder_of, name_of, stem_of, suffix_of
from filewright.operators.ledger import committed
from filewright.settings import Settings
from filewright.sources.bucketed import Bucketed
from filewright.sources.tables import materialize

TAKEN = "name_key STRING, folder STRING, filename STRING, first BIGINT, last BIGINT, run_id STRING"
# Fixed value: a name that already ends in the number of another name.
NUMBERED_STEM = r"(?s)^(.+)_([1-9][0-9]*)$"
# Numbers are cut into stretches, so the numbers of one name are not ordered in one task.
STRETCH = 1 << 16


def placed_names(events: DataFrame, settings: Settings, *also: str) -> DataFrame:
    """``folder, filename`` of destinations below the organised root."""
    root = settings.organized_dir.rstrip("/") + "/"
    return events.where(F.col("destination_path").startswith(root)).select(
        *also,
        F.substring(folder_of(F.col("destination_path")), len(root) + 1, 1 << 30).alias("folder"),
        name_of(F.col("destination_path")).alias("filename"),
    )


def numbered(names: DataFrame) -> DataFrame:
    """The numbers that names like ``stem_7.ext`` take of ``stem.ext``, as ``filename, number``."""
    stem, suffix = stem_of(F.col("filename")), suffix_of(F.col("filename"))
    number = F.regexp_extract(stem, NUMBERED_STEM, 2).try_cast("bigint")
    named = names.where(stem.rlike(NUMBERED_STEM) & number.isNotNull())
    return named.withColumns({"filename": F.concat(F.regexp_extract(stem, NUMBERED_STEM, 1), suffix), "number": number})


def taken_numbers(placed: DataFrame) -> DataFrame:
    """All numbers that file names take: of themselves 0, and what their own number takes of another name."""
    return placed.withColumn("number", F.lit(0).cast("bigint")).unionByName(numbered(placed))


def intervals(numbers: DataFrame, *keys: str) -> DataFrame:
    """``first, last`` of each run of successive numbers of a name, at most ``STRETCH`` long."""
    columns = [*keys, "folder", "filename"]
    stretch = F.floor(F.col("number") / STRETCH).alias("stretch")
    single = numbers.select(*columns, "number", stretch).distinct()
    place = F.row_number().over(Window.partitionBy(*columns, "stretch").orderBy("number"))
    runs = single.withColumn("run", F.col("number") - place).groupBy(*columns, "stretch", "run")
    return runs.agg(F.min("number").alias("first"), F.max("number").alias("last")).select(*columns, "first", "last")


def united(parts: DataFrame) -> DataFrame:
    """The intervals of each name with those that touch or overlap made one."""
    order = Window.partitionBy("folder", "filename").orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("first") > before + 1, F.lit(True)).cast("int")
    grouped = parts.withColumn("begins", begins).withColumn("part", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("folder", "filename", "part").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("part")


def skipped(parts: DataFrame) -> DataFrame:
    """``folder, filename, at, passed``: requests from rank ``at`` on pass over ``passed`` taken numbers.

    With united intervals in order, the free numbers before an interval are its first number less the lengths of
    the intervals before it.
    """
    length = F.col("last") - F.col("first") + 1
    earlier = Window.partitionBy("folder", "filename").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("first") - F.coalesce(F.sum(length).over(earlier), F.lit(0))
    return united(parts).select("folder", "filename", at.alias("at"), length.alias("passed"))


def _key() -> Column:
    return F.md5(F.concat_ws("/", "folder", "filename"))


@dataclass(frozen=True)
class Names:
    """Stored intervals below one folder."""

    folder: str
    buckets: int = 64

    @property
    def table(self) -> Bucketed:
        return Bucketed(f"{self.folder}/names", TAKEN, key="name_key", buckets=self.buckets)

    def record(self, events: DataFrame, settings: Settings) -> None:
        """Take in the events of one or more whole runs, in place of what is there of them, again after an undo."""
        placed = placed_names(committed(events), settings, "run_id")
        rows = materialize(intervals(taken_numbers(placed), "run_id").withColumn("name_key", _key()))
        gone = events.select("run_id").distinct().join(rows.select("run_id").distinct(), "run_id", "left_anti")
        for row in gone.collect():  # runs, not files
            self.table.drop_run(events.sparkSession, row.run_id)
        self.table.replace(rows)

    def forget(self, spark: SparkSession, run_id: str) -> None:
        self.table.drop_run(spark, run_id)

    def taken(self, wanted: DataFrame) -> DataFrame:
        """``folder, filename, first, last`` of the names ``wanted`` (folder, filename), each of which is there once."""
        keys = wanted.select(_key().alias("name_key")).repartition(self.buckets, "name_key")
        rows = self.table.open(wanted.sparkSession).join(keys, "name_key", "left_semi")
        return rows.select("folder", "filename", "first", "last")
