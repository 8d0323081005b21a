"""File rows from a folder of binaries.

Text-like files are decoded by column expressions. What no built-in expression
opens, such as mail, office files and PDFs, gets its text from the precomputed table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.sources.inbox import content_hash, decode_texts, dispatch, envelopes

# Fixed value: the error of a file that could not be opened.
UNREADABLE = "File could not be read"


def files_from_binary(files: DataFrame, run_id: str | Column) -> DataFrame:
    """File rows from ``source_path, file_size, content``; a row without content keeps an error."""
    rows = dispatch(envelopes(files, run_id)).withColumn("file_hash", content_hash(F.col("content")))
    is_text = F.col("extractor_name") == "text"
    read = decode_texts(rows.withColumn("content", F.when(is_text, F.col("content"))))
    about = F.create_map(
        F.lit("encoding"),
        F.when(is_text, F.col("encoding")),
        F.lit("mime_type"),
        F.col("mime_type"),
        F.lit("filename"),
        F.col("filename"),
    )
    unread = F.array_append("errors", F.lit(UNREADABLE))
    return read.select(
        "run_id",
        "document_id",
        "source_path",
        "filename",
        "extension",
        "mime_type",
        "file_hash",
        "file_size",
        "extracted_text",
        F.map_filter(about, lambda _, value: value.isNotNull()).alias("metadata"),
        F.lit(False).alias("ocr_used"),
        F.lit(False).alias("conversion_used"),
        F.when(F.col("file_hash").isNull(), unread).otherwise(F.col("errors")).alias("errors"),
    )
