"""The append-only ledger of runs and file events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.functions.paths import folder_of, name_of, restored_name
from filewright.operators.skew import latest_by, rank_within
from filewright.settings import Run

UNDONE = "undone"


def committed(events: DataFrame) -> DataFrame:
    """Events that really placed a file and were not undone later."""
    placed = events.where(
        F.col("destination_path").isNotNull() & ~F.col("dry_run") & (F.col("status") != UNDONE)
    )
    undone = events.where(F.col("status") == UNDONE).select("run_id", "document_id")
    return placed.join(undone, ["run_id", "document_id"], "left_anti")


def event_rows(plan: DataFrame, run: Run, first_id: int, hot_rows: int) -> DataFrame:
    """One ledger row per planned document, numbered in path order."""
    paths = plan.select("document_id", "source_path", F.lit(1).alias("one"))
    places = rank_within(paths, ["one"], "source_path", "place", hot_rows).select("document_id", "place")
    numbered = plan.join(places, "document_id")
    message = F.when(F.size("errors") > 0, F.concat_ws("\n", "errors"))
    return numbered.select(
        (F.col("place") + first_id).alias("event_id"),
        "run_id",
        "document_id",
        "source_path",
        "destination_path",
        "filename",
        "status",
        "category_l1",
        "category_l2",
        "confidence",
        "reason",
        "needs_review",
        "file_hash",
        "prompt_version",
        "understanding_model",
        "classification_model",
        "ocr_used",
        "conversion_used",
        F.lit(run.dry_run).alias("dry_run"),
        message.alias("error_message"),
        F.lit(run.started_at).alias("created_at"),
    )


def opened(run_ids: DataFrame) -> DataFrame:
    """First record of a run, from ``run_id, started_at, dry_run``."""
    return run_ids.select(
        "run_id",
        F.lit(0).alias("seq"),
        "started_at",
        F.lit(None).cast("timestamp").alias("completed_at"),
        "dry_run",
        *[F.lit(0).cast("bigint").alias(n) for n in ("total_files", "processed_files", "failed_files", "review_files")],
        F.lit(0.0).alias("avg_confidence"),
    )


def closed(metrics: DataFrame) -> DataFrame:
    """Last record of a run, from its metrics and ``started_at, completed_at``."""
    return metrics.select(
        "run_id",
        F.lit(1).alias("seq"),
        "started_at",
        "completed_at",
        "dry_run",
        "total_files",
        "processed_files",
        "failed_files",
        "review_files",
        "avg_confidence",
    )


def current_runs(records: DataFrame) -> DataFrame:
    """The last record of each run."""
    rest = [name for name in records.columns if name not in ("run_id", "seq")]
    return latest_by(records, ["run_id"], F.col("seq"), rest)


def latest_run(runs: DataFrame, events: DataFrame | None = None, include_dry_run: bool = False) -> DataFrame:
    """The run started last, as one row; none if there is no run.

    With ``events`` given, runs that were undone are passed over.
    """
    rows = runs if include_dry_run else runs.where(~F.col("dry_run"))
    if events is not None:
        undone = events.where(F.col("status") == UNDONE).select("run_id").distinct()
        rows = rows.join(undone, "run_id", "left_anti")
    return rows.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def run_documents(events: DataFrame, run_id: str) -> DataFrame:
    """The committed documents of a run, newest first."""
    return committed(events.where(F.col("run_id") == run_id)).orderBy(F.desc("event_id"))


def undo_plan(
    events: DataFrame, runs: DataFrame, occupied: DataFrame, present: DataFrame | None = None
) -> DataFrame:
    """Where to move the documents of the latest real run back to.

    A source path found in ``occupied`` (``path``) is restored under another
    name. With ``present`` (``path``) given, documents whose destination is
    gone are left out. The latest run is a single row, hence broadcast.
    """
    last = latest_run(runs, events).select("run_id")
    rows = committed(events).join(F.broadcast(last), "run_id", "left_semi")
    if present is not None:
        rows = rows.join(present.select(F.col("path").alias("destination_path")), "destination_path", "left_semi")
    taken = occupied.select(F.col("path").alias("source_path"), F.lit(True).alias("taken")).distinct()
    renamed = F.concat_ws("/", folder_of(F.col("source_path")), restored_name(name_of(F.col("source_path"))))
    back = F.when(F.col("taken"), renamed).otherwise(F.col("source_path"))
    return rows.join(taken, "source_path", "left").withColumn("restore_path", back).drop("taken")


def undone_events(plan: DataFrame, undone_at) -> DataFrame:
    """Events to append once a plan has been carried out, so that it is not undone twice."""
    return (
        plan.withColumn("source_path", F.col("restore_path"))
        .withColumn("destination_path", F.lit(None).cast("string"))
        .withColumn("status", F.lit(UNDONE))
        .withColumn("created_at", F.lit(undone_at))
        .drop("restore_path")
    )
