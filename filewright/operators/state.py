"""What a run needs of all runs before it, without a look at the ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.operators.counters import FOLDERS, Counters, current_taxonomy, record_events
from filewright.operators.history import History
from filewright.operators.names import Names
from filewright.settings import Settings


@dataclass(frozen=True)
class State:
    """Filed contents, taken names and category counters, stored below one folder."""

    folder: str
    buckets: int = 64

    @property
    def history(self) -> History:
        return History(f"{self.folder}/history", self.buckets)

    @property
    def names(self) -> Names:
        return Names(self.folder, self.buckets)

    @property
    def counters(self) -> Counters:
        return Counters(f"{self.folder}/counters", FOLDERS)

    def record(self, events: DataFrame, settings: Settings) -> None:
        """Take in the events of one or more whole runs, in place of what is there of them."""
        self.history.record(events)
        self.names.record(events, settings)
        record_events(self.counters, events, settings)

    def forget(self, spark: SparkSession, run_id: str) -> None:
        """As if a run had not been, for one that is delivered again."""
        self.history.table.drop_run(spark, run_id)
        self.names.forget(spark, run_id)
        run = spark.range(1).select(F.lit(run_id).alias("run_id"))
        self.counters.record(run.withColumns({**{key: F.lit("") for key in FOLDERS}, "at": F.current_timestamp(), "content": F.lit("")}).limit(0), run)

    def taxonomy(self, spark: SparkSession, settings: Settings) -> DataFrame:
        return current_taxonomy(self.counters, spark, settings)
