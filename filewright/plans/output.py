"""Writing documents into the folder tree a plan asks for."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.functions.paths import folder_of
from filewright.settings import Run, Settings


def organized_rows(plan: DataFrame, documents: DataFrame, settings: Settings) -> DataFrame:
    """The documents a plan moves, with the folder levels they go to."""
    root = settings.organized_dir.rstrip("/") + "/"
    folder = folder_of(F.col("destination_path"))
    levels = F.split(F.substring(folder, len(root) + 1, 1 << 30), "/")
    placed = plan.where(F.col("destination_path").isNotNull()).select(
        "document_id",
        "destination_path",
        F.get(levels, 0).alias("folder_l1"),
        F.get(levels, 1).alias("folder_l2"),
    )
    return documents.join(placed, "document_id")


def write_organized(plan: DataFrame, documents: DataFrame, path: str, run: Run, settings: Settings) -> None:
    """Write documents as parquet under ``run_id=…/folder_l1=…/folder_l2=…``.

    Only what the same run wrote before is replaced; other runs stay.

    Rows are brought together by folder first, so that each folder gets few
    files. The rebalance hint splits a folder that would be too much for one
    task.
    """
    rows = organized_rows(plan, documents, settings)
    rows = rows.hint("rebalance", "folder_l1", "folder_l2")
    rows.write.mode("overwrite").partitionBy("folder_l1", "folder_l2").parquet(f"{path}/run_id={quote(run.run_id, safe='')}")
