"""Counts per category that are kept current from run to run.

Every run leaves a partial state for each category it filed into: how many files, the first time, and a sketch
of the distinct contents. Counts are summed, times take the least, and sketches are united, so the current
counters are the merged states of all runs and the ledger is not scanned. A state belongs to its run: a run that is
delivered again takes the place of itself, and after an undo the state of that run alone is made anew from the rows of
that run, which also sets back what sums and sketches could not take back.

Rows without a run, and categories of a run of which nothing is left, count for nothing. A NULL category is a category.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.operators.ledger import committed
from filewright.operators.taxonomy import categories, folder_pairs
from filewright.settings import Settings
from filewright.sources.tables import load_table, materialize, replace_partitions

FOLDERS = ("category_l1", "category_l2")


@dataclass(frozen=True)
class Counters:
    """Stored states by ``keys``, a partition for each run, below one folder."""

    folder: str
    keys: tuple[str, ...] = FOLDERS

    @property
    def schema(self) -> str:
        names = "".join(f"{key} STRING, " for key in self.keys)
        return f"{names}files BIGINT, first_at TIMESTAMP, contents BINARY, run_id STRING"

    def state(self, rows: DataFrame) -> DataFrame:
        """Partial states of the rows of whole runs: ``run_id``, the keys, ``at`` and ``content``."""
        return rows.where("run_id IS NOT NULL").groupBy("run_id", *self.keys).agg(
            F.count("*").alias("files"), F.min("at").alias("first_at"), F.hll_sketch_agg("content").alias("contents")
        )

    def record(self, rows: DataFrame, runs: DataFrame) -> None:
        """Take in all rows of the ``runs`` (run_id), in place of what is there of them; a run may have no rows left."""
        made = materialize(self.state(rows.join(runs.select("run_id").distinct(), "run_id", "left_semi")))
        gone = runs.select("run_id").distinct().join(made.select("run_id").distinct(), "run_id", "left_anti")
        nothing = gone.withColumn("files", F.lit(0).cast("bigint"))
        replace_partitions(made.unionByName(nothing, allowMissingColumns=True), self.folder, "run_id")

    def stored(self, spark: SparkSession) -> DataFrame:
        return load_table(spark, self.folder, self.schema)

    def merged(self, states: DataFrame) -> DataFrame:
        """One state for each category that has files. States may be merged in any order and grouping."""
        return states.where("files > 0").groupBy(*self.keys).agg(
            F.sum("files").alias("files"), F.min("first_at").alias("first_at"), F.hll_union_agg("contents").alias("contents")
        )

    def current(self, spark: SparkSession) -> DataFrame:
        """The categories in use, with ``files``, ``first_at`` and an estimate of the distinct ``contents``."""
        merged = self.merged(self.stored(spark))
        return merged.withColumn("contents", F.hll_sketch_estimate("contents"))


def filed_rows(events: DataFrame, settings: Settings) -> DataFrame:
    """What the counters of folders take from the events of whole runs, undone ones included."""
    placed = folder_pairs(committed(events), settings)
    return placed.select("run_id", *FOLDERS, F.col("created_at").alias("at"), F.col("file_hash").alias("content"))


def record_events(counters: Counters, events: DataFrame, settings: Settings) -> None:
    """Take in the events of one or more whole runs, again after an undo."""
    counters.record(filed_rows(events, settings), events.select("run_id"))


def current_taxonomy(counters: Counters, spark: SparkSession, settings: Settings) -> DataFrame:
    """The categories in use, as ``taxonomy.scan_taxonomy`` reads them from the whole ledger."""
    return categories(counters.merged(counters.stored(spark)).select(*FOLDERS), settings)


def moved_rows(movements: DataFrame, run_id: str) -> DataFrame:
    """What counters by ``category`` take from one run of the single-level history."""
    done = movements.where(F.col("new_path").isNotNull())
    return done.select(
        F.lit(run_id).alias("run_id"), "category", F.col("processed_date").alias("at"), F.col("file_hash").alias("content")
    )
