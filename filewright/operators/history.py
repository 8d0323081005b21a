"""What earlier runs filed, kept so that a lookup neither shuffles nor reads all of it.

The ledger has a row for every file, copies included. For lookups each run leaves one row for each distinct
content: its latest committed filing. These rows are stored bucketed by content hash, a partition for each run, so a small
run joins them bucket by bucket and only its own hashes are shuffled.

Beside them each run leaves bitmaps of the hashes it has: the first digits of a hash are a position in a
row of 2**24 bits, kept in pieces of 32,768 bits. A lookup intersects them with the bitmaps of the hashes it
wants and reads the partitions of those runs alone that share a bit. A shared bit may come from another
content, so the join that follows stays exact; no shared bit means no match.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.operators.ledger import committed
from filewright.operators.skew import latest_by
from filewright.sources.bucketed import Bucketed
from filewright.sources.tables import load_table, materialize, replace_partitions

FILINGS = "file_hash STRING, created_at TIMESTAMP, event_id BIGINT, filename STRING, category_l2 STRING, run_id STRING"
INDEX = "piece BIGINT, bitmap BINARY, run_id STRING"
DIGITS = 6  # hexadecimal digits of a hash that give its position


def filings(events: DataFrame) -> DataFrame:
    """The latest committed filing of each content in each run of ``events``.

    What was undone is told by run and document, so the events of a run are enough to make its rows again.
    """
    rows = committed(events).where(F.col("file_hash").isNotNull())
    columns = ["created_at", "event_id", "filename", "category_l2"]
    return latest_by(rows, ["run_id", "file_hash"], F.struct("created_at", "event_id"), columns)


def latest_filings(rows: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(file_hash, filed) of the latest of ``filings`` rows, as ``contents.filed_contents`` has it.

    Grouping and joins are on the hash alone, so rows that are bucketed by it stay where they are.
    """
    if wanted is not None:
        rows = rows.join(wanted, "file_hash", "left_semi")
    last = F.max_by(F.struct("filename", "category_l2"), F.struct("created_at", "run_id", "event_id"))
    return rows.groupBy("file_hash").agg(last.alias("filed"))


def _positions(hashes: DataFrame) -> DataFrame:
    position = F.conv(F.left(F.col("file_hash"), F.lit(DIGITS)), 16, 10).cast("bigint")
    return hashes.withColumn("piece", F.bitmap_bucket_number(position)).withColumn("bit", F.bitmap_bit_position(position))


def hash_bitmaps(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, piece, bitmap) of the content hashes of ``rows``; pieces without a hash are left out."""
    placed = _positions(rows.where(F.col("file_hash").isNotNull()))
    return placed.groupBy(*keys, "piece").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def shared_bits(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(run_id, shared): how many positions the hashes ``wanted`` have in common with each run of the index.

    The wanted bitmaps are at most 2**24 bits in all, 2 MiB, and are broadcast.
    """
    own = hash_bitmaps(wanted).withColumnRenamed("bitmap", "wanted")
    met = index.join(F.broadcast(own), "piece").select("run_id", "piece", F.explode(F.array("bitmap", "wanted")).alias("bits"))
    both = met.groupBy("run_id", "piece").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
    shared = both.groupBy("run_id").agg(F.sum("n").alias("shared"))
    runs = index.select("run_id").distinct()
    return runs.join(shared, "run_id", "left").select("run_id", F.coalesce("shared", F.lit(0)).alias("shared"))


@dataclass(frozen=True)
class History:
    """Stored filings and their index, below one folder."""

    folder: str
    buckets: int = 64

    @property
    def table(self) -> Bucketed:
        return Bucketed(f"{self.folder}/filings", FILINGS, buckets=self.buckets)

    def record(self, events: DataFrame) -> None:
        """Take in the events of one or more whole runs, in place of what is there of them.

        After an undo the run is recorded again with its undone events; a run of which nothing is left is forgotten.
        """
        rows = materialize(filings(events))
        left = rows.select("run_id").distinct()
        gone = events.select("run_id").distinct().join(left, "run_id", "left_anti")
        for row in gone.collect():  # runs, not files
            self.table.drop_run(events.sparkSession, row.run_id)
        self.table.replace(rows)
        # A run of which nothing is left has an index without bits.
        nothing = gone.select(F.lit(-1).cast("bigint").alias("piece"), F.lit(b"").alias("bitmap"), "run_id")
        bitmaps = hash_bitmaps(rows, "run_id").select("piece", "bitmap", "run_id").unionByName(nothing)
        replace_partitions(bitmaps, f"{self.folder}/index", "run_id")

    def index(self, spark: SparkSession) -> DataFrame:
        return load_table(spark, f"{self.folder}/index", INDEX)

    def runs_to_read(self, wanted: DataFrame) -> DataFrame:
        """(run_id, shared, read) of every run in the index: only runs that share a position are read."""
        shared = shared_bits(self.index(wanted.sparkSession), wanted)
        return shared.withColumn("read", F.col("shared") > 0)

    def filed(self, wanted: DataFrame, runs: Sequence[str] | None = None) -> DataFrame:
        """(file_hash, filed) of the contents ``wanted`` (file_hash), each of which is there once.

        ``runs`` names the partitions to read; without it they are chosen by the index.
        """
        if runs is None:
            runs = [row.run_id for row in self.runs_to_read(wanted).where("read").select("run_id").collect()]
        rows = self.table.open(wanted.sparkSession).where(F.col("run_id").isin(*runs))
        # Dealt like the buckets, or Spark may rather deal both sides anew for more partitions.
        return latest_filings(rows, wanted.select("file_hash").repartition(self.buckets, "file_hash"))
