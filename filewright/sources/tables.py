"""Stored tables: load, append, and cut long lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def load_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The parquet table at a path, or an empty one of the same schema."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_table(spark, schema)


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, in a form from which the optimizer drops the joins that cannot match."""
    columns = [f"cast(NULL AS {kind}) AS {name}" for name, kind in _parts(schema)]
    return spark.sql(f"SELECT {', '.join(columns)} WHERE false")


def _parts(schema: str) -> list[list[str]]:
    return [column.split(" ", 1) for column in schema.split(", ")]


def append_rows(rows: DataFrame, path: str, *partition_by: str) -> None:
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_partitions(rows: DataFrame, path: str, *partition_by: str) -> None:
    """Write the partitions present in ``rows``, replacing earlier copies of them."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def work_folder(named: str | None, warehouse: str, master: str) -> str:
    """The folder named, else one below the warehouse; in a local session a temporary one.

    Without a named folder a cluster whose warehouse is on a local disk has no place that all executors share.
    """
    if named:
        return named
    if master == "local" or master.startswith("local["):
        return tempfile.mkdtemp(prefix="filewright-")
    if warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/filewright"


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return work_folder(named, spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master)


def materialize(rows: DataFrame) -> DataFrame:
    """Write rows to the shared folder once and read them back from there.

    Later steps then prune columns and know sizes, and a lost executor costs a
    re-read of a file, not a recomputation. All tables of an application are below one folder.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/filewright/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
