"""Labelled decisions to score against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.schemas import LABELS


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped and a broken one fails the job."""
    return spark.read.schema(LABELS).option("mode", "FAILFAST").json(path)


def locate_labels(labels: DataFrame, base: str, files: DataFrame) -> DataFrame:
    """Resolve relative paths against a folder and mark labels without a file."""
    relative = F.regexp_replace(F.col("source_path"), r"^(\./)+", "")
    path = F.when(F.col("source_path").startswith("/"), F.col("source_path")).otherwise(
        F.concat(F.lit(base.rstrip("/") + "/"), relative)
    )
    present = files.select("source_path").distinct().withColumn("found", F.lit(True))
    return (
        labels.withColumn("source_path", path)
        .join(present, "source_path", "left")
        .withColumn("missing", F.col("found").isNull())
        .drop("found")
    )
