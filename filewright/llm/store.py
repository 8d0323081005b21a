"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a folder below the warehouse, or in a local session,
    where driver and executors are one process, a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return tempfile.mkdtemp(prefix="filewright-llm-")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/filewright-llm"


# What goes in an Arrow batch: texts are long, and some partitions hold the longest of them together. And what was shuffled
# for a table is removed as soon as the table is written, as nothing reads it again.
WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """What ``stage`` writes in this context is removed at its end; a path taken from the list stays.

    The rows that are wanted must be stored in a table that stays, so that nothing reads the others again.
    """
    paths: list[str] = []
    before = _PASSING.set(paths)
    try:
        yield paths
    finally:
        _PASSING.reset(before)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage(rows: DataFrame, name: str) -> DataFrame:
    """Write rows once and read them back: a lost executor then costs a re-read of files."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    passing_paths = _PASSING.get()
    if passing_paths is not None:
        passing_paths.append(path)
    before = {setting: spark.conf.get(setting, None) for setting in WRITING}
    for setting, value in WRITING.items():
        spark.conf.set(setting, value)
    try:
        rows.write.parquet(path)
    finally:
        for setting, value in before.items():
            if value is None:
                spark.conf.unset(setting)
            else:
                spark.conf.set(setting, value)
    return spark.read.schema(rows.schema).parquet(path)


def fresh(rows: DataFrame, name: str) -> str:
    """A column name that no column of ``rows`` has, whatever its case."""
    taken = {column.lower() for column in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


FILTER_CELLS = 1 << 20


def _cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(F.pmod(F.xxhash64(*keys), F.lit(FILTER_CELLS)).alias("cell")).distinct()


def may_match(rows: DataFrame, keys: list[str], facts: DataFrame, fact_keys: list[str], how: str = "left_semi") -> DataFrame:
    """Rows whose key may be one of ``facts``, or with ``left_anti`` those whose key is certainly none.

    What is broadcast is a set of at most 2**20 numbers, whatever the size of ``facts``. It only saves wide
    rows the way through a shuffle; the join that follows is exact.
    """
    cell = fresh(rows, "cell")
    cells = F.broadcast(_cells(facts, fact_keys).withColumnRenamed("cell", cell))
    return rows.withColumn(cell, F.pmod(F.xxhash64(*keys), F.lit(FILTER_CELLS))).join(cells, cell, how).drop(cell)


def attach(rows: DataFrame, keys: list[str], facts: DataFrame, fact_keys: list[str]) -> DataFrame:
    """Left join of wide rows to facts, NULL keys matching NULL keys; only rows that may match are shuffled.

    The columns of ``facts`` must not be among those of ``rows``, and ``rows`` should be cheap to read twice.
    """
    near = may_match(rows, keys, facts, fact_keys)
    same = F.lit(True)
    for key, fact_key in zip(keys, fact_keys):
        same = same & near[key].eqNullSafe(facts[fact_key])
    far = may_match(rows, keys, facts, fact_keys, "left_anti")
    empty = [F.lit(None).cast(field.dataType).alias(field.name) for field in facts.schema]
    return near.join(facts, same, "left").unionByName(far.select("*", *empty))
