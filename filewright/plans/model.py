"""Asking a model, from inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.functions.prompts import classification_prompt, taxonomy_text, understanding_prompt
from filewright.operators.decisions import understanding_fallback
from filewright.schemas import RESPONSES
from filewright.settings import Settings

Infer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def build_prompts(documents: DataFrame, taxonomy: DataFrame, settings: Settings) -> DataFrame:
    """Both prompts of each document, from ``document_id, source_path, filename, extracted_text, facts``.

    The taxonomy is a single value that goes into every prompt; a column ``files`` says how much each folder holds.
    """
    line = taxonomy_text(taxonomy, settings.prompt_folders).scalar()
    text, name, path = F.col("extracted_text"), F.col("filename"), F.col("source_path")
    rows = documents.withColumn("reading", understanding_fallback("facts"))
    return rows.select(
        "document_id",
        understanding_prompt(name, path, text, settings).alias("understand_prompt"),
        classification_prompt(line, name, path, F.col("reading"), text, settings).alias("classify_prompt"),
    )


def with_model(prompts: DataFrame, infer: Infer) -> DataFrame:
    """Model answers to ``document_id, stage, prompt``, in the shape of the responses table.

    ``infer`` gets batches of prompts within a task and yields batches with
    ``document_id, stage, raw``.
    """
    return prompts.select("document_id", "stage", "prompt").mapInPandas(infer, RESPONSES)
