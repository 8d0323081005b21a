"""Single-level organising of the earlier generations: one category per file, optional renaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.functions.paths import sanitize_category, sanitize_filename, suffix_of
from filewright.functions.responses import answered_text, parse_answer, with_fields
from filewright.operators.decisions import attach_raw_answer
from filewright.operators.routing import destination_path, unique_names
from filewright.operators.skew import attach, latest_by
from filewright.settings import Settings
from filewright.sources.tables import materialize

# Fixed value: the message kept for files without usable text.
NO_CONTENT = "Empty content or unsupported file type"


def _answers(rows: DataFrame, responses: DataFrame, stage: str) -> DataFrame:
    """Category and new name each model answer proposes, NULL where it is unusable."""
    found = attach_raw_answer(rows, responses, stage).withColumn("payload", parse_answer("raw"))
    proposed = with_fields(found, ("category", "new_filename")).select(
        *rows.columns,
        answered_text("category").alias("proposed"),
        answered_text("new_filename").alias("new_filename"),
    )
    category = F.when(F.col("proposed").isNotNull(), sanitize_category(F.col("proposed")))
    return proposed.withColumn("category", category).drop("proposed")


def organize_single_level(
    files: DataFrame, cache: DataFrame, responses: DataFrame, existing: DataFrame, settings: Settings, stage: str
) -> DataFrame:
    """Plan a single-level run; the result fits ``movements.movement_rows``.

    The cache (``file_hash, category, cached_at``) is keyed by content alone.
    Within the run the first copy of a content that gets a category fills the
    cache for the copies after it in path order.
    """
    rows = files.select(
        "document_id",
        "source_path",
        "filename",
        "file_hash",
        "file_size",
        (F.coalesce("extracted_text", F.lit("")) != "").alias("has_text"),
    )
    answered = materialize(_answers(rows, responses, stage).withColumnRenamed("category", "own"))
    own = F.when(F.col("has_text"), F.col("own"))
    contents = (
        answered.where(F.col("file_hash").isNotNull())
        .groupBy("file_hash")
        .agg(
            F.count("*").alias("copies"),
            F.min(F.when(own.isNotNull(), F.struct("source_path", own.alias("category")))).alias("first"),
        )
        .join(
            latest_by(cache, ["file_hash"], F.col("cached_at"), ["category"]).withColumnRenamed("category", "known"),
            "file_hash",
            "left",
        )
    )
    joined = attach(
        answered, contents, ["file_hash"], size="copies", spread_by="document_id", hot_rows=settings.hot_rows
    )
    after_first = F.coalesce(F.col("source_path") > F.col("first.source_path"), F.lit(False))
    category = F.coalesce("known", F.when(after_first, F.col("first.category")).otherwise(own))
    message = F.when(~F.col("has_text"), NO_CONTENT).otherwise(
        F.concat(F.lit("AI classification failed for "), F.col("filename"))
    )
    decided = joined.select(
        "document_id",
        "source_path",
        "filename",
        "file_hash",
        "file_size",
        category.alias("category"),
        (F.col("known").isNotNull() | after_first).alias("cached"),
        F.when(category.isNull(), message).alias("error_message"),
    )
    decided = materialize(decided)
    moving = decided.where(F.col("category").isNotNull()).select(
        "document_id", "source_path", "filename", sanitize_category(F.col("category")).alias("folder")
    )
    named = unique_names(materialize(moving), existing, settings).select(
        "document_id", destination_path(F.col("folder"), F.col("unique_name"), settings).alias("new_path")
    )
    return decided.join(named, "document_id", "left").withColumn(
        "processing_time_seconds", F.lit(None).cast("double")
    )


def rename_plan(
    files: DataFrame, responses: DataFrame, existing: DataFrame, settings: Settings, stage: str, processed_dir: str
) -> DataFrame:
    """Copies under a proposed name, with the original moved aside.

    Only files with text and with both a category and a name proposed are planned.
    """
    rows = files.where(F.coalesce("extracted_text", F.lit("")) != "").select("document_id", "source_path", "filename")
    answered = _answers(rows, responses, stage).where(F.col("category").isNotNull() & F.col("new_filename").isNotNull())
    wanted = answered.select(
        "document_id",
        "source_path",
        F.col("filename").alias("original_filename"),
        F.col("category").alias("folder"),
        sanitize_filename(F.col("new_filename"), suffix_of(F.col("filename"))).alias("filename"),
    )
    wanted = materialize(wanted)
    aside = wanted.select("document_id", "source_path", F.col("original_filename").alias("filename"), F.lit("").alias("folder"))
    moved = unique_names(aside, existing.where(F.lit(False)), settings).select("document_id", F.col("unique_name").alias("aside"))
    named = unique_names(wanted, existing, settings).join(moved, "document_id")
    return named.select(
        "document_id",
        "source_path",
        F.col("folder").alias("category"),
        destination_path(F.col("folder"), F.col("unique_name"), settings).alias("new_path"),
        F.col("unique_name").alias("new_filename"),
        F.concat_ws("/", F.lit(processed_dir), "aside").alias("processed_path"),
    )
