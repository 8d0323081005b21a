"""New rows for the extraction cache."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.functions.text import quality_score
from filewright.operators.contents import distinct_contents, look_up
from filewright.plans.organize import Tables
from filewright.settings import Run, Settings
from filewright.sources.labels import locate_labels
from filewright.sources.tables import materialize


def new_extractions(
    files: DataFrame, extractions: DataFrame, run: Run, settings: Settings, precomputed: DataFrame | None = None
) -> DataFrame:
    """Cache rows to append: one per content that has no cached text under the current model.

    Which files to read is settled on hashes and ids; only the chosen ones are
    joined to their text. Precomputed text is kept in place of the file's own. Contents
    without any text are left out, so that a text made later is not kept away.
    """
    narrow = files.select("source_path", "document_id", "filename", "file_hash", F.col("extracted_text").isNotNull().alias("read"))
    if precomputed is not None:
        ready = precomputed.where(F.col("text") != "").select("source_path", F.lit(True).alias("ready"))
        narrow = narrow.join(ready, "source_path", "left").withColumn("read", F.col("read") | F.coalesce("ready", F.lit(False)))
    narrow = narrow.where("read")
    cached = extractions.where(F.col("ocr_model") == settings.ocr_key).select("file_hash")
    wanted = distinct_contents(narrow).join(cached, "file_hash", "left_anti")
    chosen = files.join(wanted.select(F.col("first_copy.document_id").alias("document_id")), "document_id", "left_semi")
    if precomputed is not None:
        made = precomputed.where(F.col("text") != "")
        chosen = chosen.join(made, "source_path", "left").withColumns(
            {
                "extracted_text": F.coalesce("text", "extracted_text"),
                "metadata": F.when(
                    F.col("text").isNotNull(), F.create_map(F.lit("odl_batch"), F.lit("true"))
                ).otherwise(F.col("metadata")),
            }
        )
    return chosen.select(
        "file_hash",
        F.lit(settings.ocr_key).alias("ocr_model"),
        "extracted_text",
        "metadata",
        quality_score("extracted_text").alias("extraction_quality"),
        "ocr_used",
        "conversion_used",
        F.lit(run.started_at).alias("cached_at"),
    )


class Warmed(NamedTuple):
    """``rows`` to append to the extraction cache, and the ``missing`` labels, for which there is no file."""

    rows: DataFrame
    missing: DataFrame


def warm_extractions(labels: DataFrame, files: DataFrame, tables: Tables, run: Run, settings: Settings, base: str = "/") -> Warmed:
    """Cache rows for the files of a label set, to be written ahead of a benchmark.

    Relative paths of labels are meant from the folder ``base``. As in a run, contents that were filed
    before or have a cached decision are passed over, and precomputed text is taken before the file's own.
    """
    located = locate_labels(labels, base, files)
    wanted = located.where(~F.col("missing")).select("source_path").distinct()
    labelled = files.join(wanted, "source_path", "left_semi")
    narrow = materialize(labelled.select("source_path", "document_id", "filename", "file_hash"))
    known = look_up(narrow, settings, events=tables.events, decisions=tables.decisions, history=tables.history)
    undecided = known.where(F.col("filed").isNull() & F.col("decision").isNull()).select("document_id")
    chosen = labelled.join(undecided, "document_id", "left_semi")
    rows = new_extractions(chosen, tables.extractions, run, settings, tables.precomputed)
    return Warmed(rows, located.where("missing").drop("missing"))
