"""Run metrics, document reports and preparation counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.settings import DUPLICATES


def run_metrics(plan: DataFrame) -> DataFrame:
    """Counters per run. Duplicates and review documents count as processed."""
    return plan.groupBy("run_id").agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("status").isin("moved", "planned")).alias("processed_files"),
        F.count_if(F.col("status") == "failed").alias("failed_files"),
        F.count_if(F.coalesce("needs_review", F.lit(False))).alias("review_files"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
    )


def metrics_of_run(plan: DataFrame, run_id: str) -> DataFrame:
    """Metrics as one row, also for a run without files."""
    run = plan.sparkSession.range(1).select(F.lit(run_id).alias("run_id"))
    counters = ("total_files", "processed_files", "failed_files", "review_files")
    found = run_metrics(plan)
    return run.join(found, "run_id", "left").select(
        "run_id",
        *[F.coalesce(name, F.lit(0)).alias(name) for name in counters],
        F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"),
    )


def document_report(plan: DataFrame) -> DataFrame:
    """What a user sees of each document, by file name."""
    source = F.when(F.col("category_l1") == DUPLICATES, "duplicate").otherwise(
        F.coalesce("decision_source", F.lit("unknown"))
    )
    return plan.select(
        "document_id",
        "filename",
        "source_path",
        "status",
        source.alias("decision_source"),
        "category_l1",
        "category_l2",
        "confidence",
        "needs_review",
        "reason",
        "destination_path",
        "mime_type",
        "document_type",
        "cached",
        "ocr_used",
        "conversion_used",
        "errors",
    ).orderBy(F.lower("filename"), "source_path")


def extraction_success(candidates: DataFrame, precomputed: DataFrame) -> DataFrame:
    """How many files a batch extractor was given, and how many texts came back."""
    texts = precomputed.where(F.col("text") != "").select("source_path", F.lit(True).alias("made"))
    return candidates.join(texts, "source_path", "left").agg(
        F.count("*").alias("candidates"), F.count("made").alias("with_text")
    )
