"""The single-level history of earlier generations and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.functions.paths import name_of

# Fixed value: the category under which errors are kept.
ERROR_CATEGORY = "ERROR"


def movement_rows(outcomes: DataFrame) -> DataFrame:
    """One history row per file: where it went, or what went wrong.

    Needs ``source_path, new_path, category, file_hash, file_size, cached,
    processing_time_seconds, error_message``. A row without a new path keeps
    only the path, the name, the category and the message.
    """
    done = F.col("new_path").isNotNull()
    only_done = ("file_hash", "file_size", "processing_time_seconds")
    return outcomes.select(
        F.col("source_path").alias("original_path"),
        name_of(F.col("source_path")).alias("original_filename"),
        "new_path",
        name_of(F.col("new_path")).alias("new_filename"),
        F.when(done, F.col("category")).otherwise(F.coalesce("category", F.lit(ERROR_CATEGORY))).alias("category"),
        *[F.when(done, F.col(name)).alias(name) for name in only_done],
        (done & F.coalesce("cached", F.lit(False))).alias("cached"),
        F.when(~done, F.col("error_message")).alias("error_message"),
    )


def _done(movements: DataFrame) -> DataFrame:
    return movements.where(F.col("new_path").isNotNull())


def by_category(movements: DataFrame) -> DataFrame:
    """Movements per category, most first."""
    counted = _done(movements).groupBy("category").agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), "category")


def overall(movements: DataFrame) -> DataFrame:
    """Totals, cache-hit rate in percent and mean time, as one row."""
    done = F.col("new_path").isNotNull()
    hits, total = F.count_if(done & F.col("cached")), F.count_if(done)
    return movements.agg(
        total.alias("total_processed"),
        F.when(total > 0, hits / total * 100.0).otherwise(0.0).alias("cache_hit_rate"),
        F.avg("processing_time_seconds").alias("avg_processing_time"),
        F.count_if(~done).alias("total_failed"),
        (F.coalesce(F.sum("processing_time_seconds"), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))).alias(
            "seconds_per_file"
        ),
    )


def category_counts(movements: DataFrame) -> DataFrame:
    """Every category ever logged for a moved file, its file count and first date."""
    done = F.col("new_path").isNotNull()
    counted = movements.groupBy("category").agg(
        F.count_if(done).alias("file_count"), F.min(F.when(done, F.col("processed_date"))).alias("created_date")
    )
    return counted.where(F.col("file_count") > 0).withColumnRenamed("category", "category_name")


def file_history(movements: DataFrame, filename: str | None = None) -> DataFrame:
    """Rows of one file under its old or new name, or the newest 100 rows."""
    newest = (F.desc("processed_date"), F.desc("id"))
    if filename:
        named = (F.col("original_filename") == filename) | (F.col("new_filename") == filename)
        return movements.where(named).orderBy(*newest)
    return movements.orderBy(*newest).limit(100)
