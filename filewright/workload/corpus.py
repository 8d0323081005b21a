"""An inbox and its surroundings, derived by Spark from the given tables.

Every table below is a projection of ``documents``, ``labels``, ``events`` or
``pages``, so it grows with them. Ledger, caches and answers are stored tables
wherever a run takes place, so they are stored here too, once per session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.functions.paths import suffix_of, with_number
from filewright.functions.rules import rule_for_name, rule_for_text, rule_verdict
from filewright.functions.text import quality_score, strip
from filewright.operators.routing import destination_folder, destination_path, technical_folder
from filewright.operators.ledger import closed, opened, undone_events
from filewright.plans.organize import Organized, Tables, organize, organize_each
from filewright.settings import Run, Settings
from filewright.sources.inbox import files_from_texts
from filewright.sources.tables import materialize

STEMS = ("invoice", "resume", "slide_deck", "notes", "report", "boleto", "cv", "helper.py-memo", "scan", "curriculum")
EXTENSIONS = (".txt", ".md", ".csv", ".html", ".pdf", ".xyz")
HISTORY_SOURCES = ("src0", "src1", "src2", "src3", "src4")
HISTORY = Run("run-1", datetime(2024, 1, 1))
CURRENT = Run("run-2", datetime(2024, 2, 1))
LATER = Run("run-3", datetime(2024, 3, 1))

SETTINGS = Settings(
    aliases={"invoices": "Invoices"},
    level1_aliases={"financeiro": "Finance", "financial": "Finance"},
    level2_aliases={"receipt": "Invoices", "resumes": "Resumes"},
)

STRICT = Settings(review_confidence=0.9)

# Model answers. The expressions are plain enough to mean the same in any SQL.
ANSWER_LEVEL1 = (
    "CASE floor(doc_id / 10) % 5 WHEN 0 THEN 'financeiro' WHEN 1 THEN 'FINANCE' WHEN 2 THEN 'knowledge'"
    " WHEN 3 THEN 'Research: Notes' ELSE 'Data/Science' END"
)
ANSWER_LEVEL2 = (
    "CASE floor(doc_id / 50) % 4 WHEN 0 THEN 'receipt' WHEN 1 THEN 'invoices'"
    " WHEN 2 THEN '  Field   notes ' ELSE 'presentations' END"
)


def _classification(flag: str) -> str:
    parts = (
        """'{"category_l1": "'""",
        ANSWER_LEVEL1,
        """'", "category_l2": "'""",
        ANSWER_LEVEL2,
        """'", "confidence": 0.'""",
        "lpad(cast(doc_id % 100 as string), 2, '0')",
        """', "reason": "Answer '""",
        "cast(doc_id as string)",
        f"""'", "needs_review": {flag}}}'""",
    )
    return f"concat({', '.join(parts)})"


def _understanding(keywords: str) -> str:
    return (
        """concat('{"summary": "About ', cast(doc_id as string), '", "keywords": """
        + keywords
        + """, "language": "', lang, '", "document_type": "', CASE doc_id % 3 WHEN 0 THEN 'letter' ELSE 'report' END,"""
        """ '", "content_signals": ["s', cast(doc_id % 5 as string), '"]}')"""
    )


def _dressed(kind: str, body: str, other4: str, other6: str) -> str:
    return f"""CASE {kind}
        WHEN 0 THEN {body}
        WHEN 1 THEN concat('```json', chr(10), {body}, chr(10), '```')
        WHEN 2 THEN concat('Here it is: ', {body}, ' Done.')
        WHEN 3 THEN left({body}, length({body}) - 10)
        WHEN 4 THEN {other4}
        WHEN 5 THEN ''
        ELSE '{other6}' END"""


UNDERSTAND_RAW = _dressed(
    "floor(doc_id / 7) % 7",
    _understanding('["a1", "a2", "a3", "a4", "a5", "a6", "a7", "a8", "a9"]'),
    _understanding("null"),
    "[]",
)
RENAME_RAW = _dressed(
    "doc_id % 7",
    f"""concat('{{"category": "', {ANSWER_LEVEL1}, '", "new_filename": "', source, '/', lang, ': draft.txt"}}')""",
    f"""concat('{{"category": 7, "new_filename": "', source, '"}}')""",
    '{"category": ""}',
)
CLASSIFY_RAW = _dressed("doc_id % 7", _classification("false"), _classification('"False"'), "[1, 2]")


# Tables of long texts and the column to spread them by when they come in one piece.
_TEXTS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in _TEXTS:
        return rows
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, _TEXTS[name])


_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Write what ``build`` makes on first use, and read it from then on."""

    @wraps(build)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
        if key not in _stored:
            _stored[key] = materialize(build(spark, sf_dir))
        return _stored[key]

    return read


def pick(choices: Sequence[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (index + 1).cast("int"))


def seconds_after(day: str) -> Column:
    """A distinct time for each document."""
    return F.timestamp_seconds(F.unix_timestamp(F.lit(day).cast("timestamp")) + F.col("doc_id"))


def is_history() -> Column:
    return F.col("source").isin(*HISTORY_SOURCES)


def named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the path they arrived under and the run they came in."""
    doc = F.col("doc_id")
    stem, extension = pick(STEMS, doc % 10), pick(EXTENSIONS, F.floor(doc / 10) % 6)
    name = F.concat(stem, F.lit("_"), (doc % 50).cast("string"), extension)
    path = F.concat(F.lit("/inbox/"), doc.cast("string"), F.lit("/"), name)
    run = F.when(is_history(), HISTORY.run_id).otherwise(CURRENT.run_id)
    return table(spark, sf_dir, "documents").withColumn("source_path", path).withColumn("run_id", run)


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named documents with the id their file row gets."""
    ids = F.sha2(F.concat_ws("|", "run_id", "source_path"), 256)
    name = F.substring_index("source_path", "/", -1)
    rows = named_documents(spark, sf_dir).withColumn("document_id", ids).withColumn("filename", name)
    return rows.withColumn("file_hash", F.md5(F.encode("text", "UTF-8")))


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file row."""
    return files_from_texts(named_documents(spark, sf_dir), F.col("run_id"))


def current_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inbox of the current run: all that the earlier run has not filed."""
    return files_from_texts(named_documents(spark, sf_dir).where(~is_history()), F.col("run_id"))


@stored
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of the earlier run, filed by rules alone.

    A file name comes back every 300 documents, so the number of that round
    keeps the destinations apart.
    """
    rows = identified(spark, sf_dir).where(is_history())
    index = F.least(rule_for_name("filename", SETTINGS.rules), rule_for_text("text", SETTINGS.rules))
    verdict = F.col("verdict")
    review = verdict.isNull()
    technical = technical_folder("verdict.category_l1", "verdict.category_l2", "verdict IS NULL", "true")
    folder = destination_folder(technical, verdict["category_l1"], verdict["category_l2"])
    name = with_number(F.col("filename"), F.floor(F.col("doc_id") / 300))
    return rows.withColumn("rule", index).withColumn("verdict", rule_verdict("rule", SETTINGS.rules)).select(
        F.col("doc_id").alias("event_id"),
        "run_id",
        "document_id",
        "source_path",
        destination_path(folder, name, SETTINGS).alias("destination_path"),
        "filename",
        F.lit("moved").alias("status"),
        verdict["category_l1"].alias("category_l1"),
        verdict["category_l2"].alias("category_l2"),
        F.coalesce(verdict["confidence"], F.lit(0.0)).alias("confidence"),
        verdict["reason"].alias("reason"),
        review.alias("needs_review"),
        "file_hash",
        F.lit(SETTINGS.prompt_version).alias("prompt_version"),
        F.lit(None).cast("string").alias("understanding_model"),
        F.lit(None).cast("string").alias("classification_model"),
        F.lit(False).alias("ocr_used"),
        F.lit(False).alias("conversion_used"),
        F.lit(HISTORY.dry_run).alias("dry_run"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(HISTORY.started_at).alias("created_at"),
    )


@stored
def several_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier filings dealt over five runs; of one run every other file is undone, of the last all."""
    number = F.col("event_id") % 5
    started = F.timestamp_seconds(F.unix_timestamp(F.lit(HISTORY.started_at)) + number * 86400)
    run = F.concat(F.lit("run-"), number.cast("string"))
    placed = events(spark, sf_dir).withColumns({"run_id": run, "created_at": started})
    gone = ((number == 3) & (F.floor(F.col("event_id") / 5) % 2 == 0)) | (number == 4)
    return placed.unionByName(undone_events(placed.where(gone).withColumn("restore_path", F.col("source_path")), LATER.started_at))


@stored
def precomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch extractor made of the PDFs: nothing for two of the languages."""
    pdfs = identified(spark, sf_dir).where(suffix_of(F.col("filename")) == ".pdf")
    return pdfs.select("source_path", F.when(F.col("lang").isin("en", "fr"), F.col("text")).otherwise("").alias("text"))


@stored
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached decisions on the labelled documents; low quality ones under an older prompt."""
    labels = table(spark, sf_dir, "labels")
    rows = identified(spark, sf_dir).join(labels, "doc_id")
    return rows.select(
        "file_hash",
        F.when(F.col("quality") == 1, SETTINGS.prompt_version).otherwise("v2").alias("prompt_version"),
        F.lit(SETTINGS.understanding_model).alias("understanding_model"),
        F.lit(SETTINGS.classification_model).alias("classification_model"),
        F.concat(F.lit("Cached "), F.col("doc_id").cast("string")).alias("summary"),
        F.array("lang", "source").alias("keywords"),
        F.col("lang").alias("language"),
        F.lit("report").alias("document_type"),
        F.expr(ANSWER_LEVEL1).alias("category_l1"),
        F.expr(ANSWER_LEVEL2).alias("category_l2"),
        (F.col("doc_id") % 100 / 100).alias("confidence"),
        F.lit("Cached answer").alias("reason"),
        (F.col("toxic") == 1).alias("needs_review"),
        seconds_after("2024-01-10").alias("cached_at"),
    )


@stored
def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached texts of the documents that are not English; only German under the current model."""
    rows = identified(spark, sf_dir).where(F.col("lang") != "en")
    return rows.select(
        "file_hash",
        F.when(F.col("lang") == "de", SETTINGS.ocr_key).otherwise("none").alias("ocr_model"),
        strip(F.col("text")).alias("extracted_text"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
        quality_score("text").alias("extraction_quality"),
        (suffix_of(F.col("filename")) == ".pdf").alias("ocr_used"),
        F.lit(False).alias("conversion_used"),
        seconds_after("2024-01-11").alias("cached_at"),
    )


@stored
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model answers for each stage of every document, in all shapes models give."""
    rows = identified(spark, sf_dir)
    stages = {"understand": UNDERSTAND_RAW, "classify": CLASSIFY_RAW, "rename": RENAME_RAW}
    answers = [F.struct(F.lit(stage).alias("stage"), F.expr(raw).alias("raw")) for stage, raw in stages.items()]
    return rows.select("document_id", F.inline(F.array(*answers)))


@stored
def benchmark_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expectations for the labelled documents, with NULL where none is stated."""
    rows = identified(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(
        "source_path",
        F.when(F.col("toxic") == 1, "Finance").alias("expected_category_l1"),
        F.lit(None).cast("string").alias("expected_category_l2"),
        (F.col("quality") == 0).alias("expected_needs_review"),
    )


@stored
def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of single-level filings, one per event."""
    done = F.col("event_type") != "error"
    name = F.concat(F.lit("file_"), F.col("user_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("/inbox/"), name).alias("original_path"),
        name.alias("original_filename"),
        F.when(done, F.concat_ws("/", F.lit("/organized"), "event_type", name)).alias("new_path"),
        F.when(done, name).alias("new_filename"),
        F.col("event_type").alias("category"),
        F.col("ts").cast("timestamp").alias("processed_date"),
        F.md5(F.encode("props", "UTF-8")).alias("file_hash"),
        F.octet_length("props").cast("bigint").alias("file_size"),
        F.lit(None).cast("string").alias("extraction_method"),
        (F.col("user_id") % 2 == 0).alias("cached"),
        F.col("value").alias("processing_time_seconds"),
        F.when(~done, "Move failed").alias("error_message"),
    )


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(
        events=events(spark, sf_dir),
        decisions=decisions(spark, sf_dir),
        extractions=extractions(spark, sf_dir),
        precomputed=precomputed(spark, sf_dir),
        responses=responses(spark, sf_dir),
    )


@stored
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records, one run per document source; the last one but one is still open."""
    number = F.substring("source", 4, 10).cast("int")
    runs = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("lang") == "en").alias("processed_files"),
        F.count_if(F.col("lang") == "de").alias("failed_files"),
        F.count_if(F.col("lang") == "fr").alias("review_files"),
        (F.sum("n_chars") / F.count("*")).alias("avg_confidence"),
    )
    runs = runs.select(
        F.col("source").alias("run_id"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-03-01").cast("timestamp")) + number).alias("started_at"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-03-02").cast("timestamp")) + number).alias("completed_at"),
        (F.col("source") == "src19").alias("dry_run"),
        *("total_files", "processed_files", "failed_files", "review_files", "avg_confidence"),
    )
    return opened(runs).unionByName(closed(runs.where(F.col("run_id") != "src18")))


@stored
def history_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs behind the ledger: the earlier one, and a dry run of the current inbox."""
    started = F.when(F.col("run_id") == HISTORY.run_id, F.lit(HISTORY.started_at)).otherwise(F.lit(CURRENT.started_at))
    runs = named_documents(spark, sf_dir).select("run_id").distinct()
    return runs.select("run_id", started.alias("started_at"), (F.col("run_id") == CURRENT.run_id).alias("dry_run"))


@stored
def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored plan of the current run, for the reports drawn from it."""
    return organized(spark, sf_dir).plan


def configured_plans(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The plan of the current run, and under another configuration: a higher threshold and no aliases."""
    configs = {"default": SETTINGS, "strict": STRICT}
    done = organize_each(current_files(spark, sf_dir), tables(spark, sf_dir), CURRENT, configs)
    return {name: one.plan for name, one in done.items()}


def inbox_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files under names that file readers pass over, dot-files and plain names."""
    number = F.col("doc_id").cast("string")
    name = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("_plan-"), number, F.lit(".txt")))
        .when(F.col("doc_id") % 4 == 1, F.concat(number, F.lit("._COPYING_")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit(".hidden-"), number, F.lit(".txt")))
        .otherwise(F.concat(F.lit("doc-"), number, F.lit(".md")))
    )
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), content.alias("content"))


def write_files(files: DataFrame, folder: str) -> None:
    """Each row of ``name, content`` as a plain file in a folder, written by the tasks."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        target = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
        store, root = fs.FileSystem.from_uri(target if "://" in target else target.replace("file:", "file://", 1))
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(*(column.to_pylist() for column in batch.columns)):
                with store.open_output_stream(f"{root}/{name}") as file:
                    file.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    files.select("name", "content").mapInArrow(write, "files bigint").agg(F.sum("files")).collect()


def organized(spark: SparkSession, sf_dir: str) -> Organized:
    return organize(current_files(spark, sf_dir), tables(spark, sf_dir), CURRENT, SETTINGS)


def stored_run(spark: SparkSession, sf_dir: str) -> Organized:
    return Organized(plan(spark, sf_dir), CURRENT, SETTINGS)
