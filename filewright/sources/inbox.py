"""From stored files or table rows to the file rows a run starts with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.functions.paths import extension_of, name_of
from filewright.functions.text import decode_text, quality_score, strip
from filewright.sources.filetypes import EXTERNAL_EXTRACTORS, extractor_name, mime_type, unsupported_error
from filewright.sources.inbox_source import Inbox

def scan_inbox(spark: SparkSession, folder: str, only_filename: str | None = None, slices: int | None = None) -> DataFrame:
    """Plain files directly inside a folder but dot-files, whatever their names; none if it is missing.

    The folder is walked and read by ``slices`` tasks. A file that cannot be read is a row without content.
    """
    spark.dataSource.register(Inbox)
    count = slices or 4 * spark.sparkContext.defaultParallelism
    kept = spark.read.format("inbox").option("slices", str(count)).load(folder)
    if only_filename is not None:
        kept = kept.where(name_of(F.col("source_path")) == only_filename)
    return kept.select("source_path", "file_size", "content")


def inbox_stream(spark: SparkSession, folder: str, slices: int | None = None, settle: float = 1.0) -> DataFrame:
    """The files of a folder as they arrive, with the columns of ``scan_inbox``.

    Its offsets are arrival times and are kept in the checkpoint of the query, so a restarted query goes on
    after the last file. A file is given once it is ``settle`` seconds old.
    """
    spark.dataSource.register(Inbox)
    count = slices or 4 * spark.sparkContext.defaultParallelism
    reader = spark.readStream.format("inbox").option("slices", str(count)).option("settle", str(settle))
    return reader.load(folder).select("source_path", "file_size", "content")


def first_files(files: DataFrame, limit: int) -> DataFrame:
    """The first files in path order; only paths are sorted."""
    first = files.select("source_path").orderBy("source_path").limit(limit)
    return files.join(first, "source_path", "left_semi")


def document_id(run_id: Column, source_path: Column) -> Column:
    """The same for the same file in the same run, so reruns agree."""
    return F.sha2(F.concat_ws("|", run_id, source_path), 256)


def envelopes(files: DataFrame, run_id: str | Column) -> DataFrame:
    """Add identity and name columns to rows that have a ``source_path``."""
    run = F.lit(run_id) if isinstance(run_id, str) else run_id
    return (
        files.withColumn("run_id", run)
        .withColumn("document_id", document_id(F.col("run_id"), F.col("source_path")))
        .withColumn("filename", name_of(F.col("source_path")))
        .withColumn("extension", extension_of(F.col("filename")))
        .withColumn("mime_type", mime_type(F.col("filename")))
    )


def content_hash(content: Column) -> Column:
    """MD5 of the bytes; NULL stays NULL."""
    return F.md5(content)


def decode_texts(files: DataFrame, content: str = "content") -> DataFrame:
    """Text-family extraction: decoded, stripped, with the encoding that worked."""
    raw = F.col(content)
    encoding = F.when(F.is_valid_utf8(raw.cast("string")), "utf-8").otherwise("latin-1")
    text = strip(decode_text(raw))
    return (
        files.withColumn("encoding", encoding)
        .withColumn("extracted_text", F.nullif(text, F.lit("")))
        .withColumn("extraction_quality", quality_score("extracted_text"))
    )


def dispatch(rows: DataFrame) -> DataFrame:
    """Choose the extractor of each row and note the types nothing can read."""
    extractor = extractor_name(F.col("extension"))
    no_error = F.array().cast("array<string>")
    missing = F.concat(F.upper(extractor), F.lit(" text must be precomputed"))
    return rows.withColumn("extractor_name", extractor).withColumn(
        "errors",
        F.when(F.col("extractor_name") == "unsupported", F.array(unsupported_error(F.col("extension"))))
        .when(F.col("extractor_name").isin(*EXTERNAL_EXTRACTORS), F.array(missing))
        .otherwise(no_error),
    )


def files_from_texts(rows: DataFrame, run_id: str | Column, text: str = "text") -> DataFrame:
    """File rows from a table whose text column is the content of text-like files.

    The text of any other type is not readable here, as it would not be in a folder.
    """
    content = F.encode(F.col(text), "UTF-8")
    readable = F.when(F.col("extractor_name") == "text", F.nullif(strip(F.col(text)), F.lit("")))
    about = F.map_filter(
        F.create_map(
            F.lit("encoding"),
            F.when(F.col("extractor_name") == "text", "utf-8"),
            F.lit("mime_type"),
            F.col("mime_type"),
            F.lit("filename"),
            F.col("filename"),
        ),
        lambda _, value: value.isNotNull(),
    )
    return dispatch(envelopes(rows, run_id)).select(
        "run_id",
        "document_id",
        "source_path",
        "filename",
        "extension",
        "mime_type",
        content_hash(content).alias("file_hash"),
        F.octet_length(F.col(text)).cast("bigint").alias("file_size"),
        readable.alias("extracted_text"),
        about.alias("metadata"),
        F.lit(False).alias("ocr_used"),
        F.lit(False).alias("conversion_used"),
        "errors",
    )
