"""Stored tables that are bucketed and sorted by a key, so that joins on it do not shuffle them.

Bucketing is known to the catalog only. The files lie below a path of their own, and a session that
does not know the table yet is told of it again, with the partitions that are there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Bucketed:
    """A parquet table at ``path``: ``schema`` with a last column that names the run, in ``buckets`` by ``key``."""

    path: str
    schema: str
    key: str = "file_hash"
    run: str = "run_id"
    buckets: int = 64

    @property
    def name(self) -> str:
        """The same for the same path, so sessions need not agree on names."""
        return "filewright_" + hashlib.md5(f"{self.path} {self.buckets}".encode()).hexdigest()

    def open(self, spark: SparkSession) -> DataFrame:
        """The table, empty if nothing was written yet."""
        self._known(spark)
        return spark.table(self.name)

    def _known(self, spark: SparkSession) -> None:
        if spark.catalog.tableExists(self.name):
            return
        spark.sql(
            f"CREATE TABLE {self.name} ({self.schema}) USING parquet PARTITIONED BY ({self.run})"
            f" CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        if has_files(spark, self.path):
            spark.catalog.recoverPartitions(self.name)

    def replace(self, rows: DataFrame) -> None:
        """Write the runs present in ``rows`` in place of earlier copies of them, one file for each bucket."""
        spark = rows.sparkSession
        columns = self.open(spark).columns
        with _setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            dealt = rows.select(*columns).repartition(self.buckets, self.key)
            dealt.write.insertInto(self.name, overwrite=True)

    def drop_run(self, spark: SparkSession, run_id: str) -> None:
        """Forget a run, if it is there; its files go with it."""
        self._known(spark)
        part = f"{self.run} = {_quoted(run_id)}"
        if spark.table(self.name).where(part).select(self.key).limit(1).isEmpty():
            return
        kinds = [(name, kind) for name, kind in spark.table(self.name).dtypes if name != self.run]
        nothing = ", ".join(f"CAST(NULL AS {kind}) AS {name}" for name, kind in kinds)
        spark.sql(f"INSERT OVERWRITE {self.name} PARTITION ({part}) SELECT {nothing} WHERE false")


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)
