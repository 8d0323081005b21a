"""Facts about distinct contents: copies, earlier filings, cached decisions and texts.

All lookups by content hash are made once per distinct hash, where no key can
be hot, and only their result is joined back to the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.functions.text import guess_language, quality_score, summary, top_keywords
from filewright.functions.rules import rule_for_text
from filewright.operators.history import History
from filewright.operators.ledger import committed
from filewright.operators.skew import attach, latest_by
from filewright.settings import Settings

DECISION_FIELDS = (
    "summary",
    "keywords",
    "language",
    "document_type",
    "category_l1",
    "category_l2",
    "confidence",
    "reason",
    "needs_review",
)


def text_facts(text: str, settings: Settings) -> Column:
    """All that later steps need of a text column, so that the text itself stays behind."""
    return F.struct(
        F.expr(f"coalesce({text}, '') != '' AS has_text"),
        quality_score(text).alias("quality"),
        rule_for_text(text, settings.rules).alias("rule"),
        summary(text).alias("summary"),
        guess_language(text).alias("language"),
        top_keywords(text, settings.stop_words).alias("keywords"),
    )


def distinct_contents(files: DataFrame) -> DataFrame:
    """One row per content hash: number of copies, and the first of them in path order."""
    first = F.min(F.struct("source_path", "document_id", "filename"))
    return (
        files.where(F.col("file_hash").isNotNull())
        .groupBy("file_hash")
        .agg(F.count("*").alias("copies"), first.alias("first_copy"))
    )


def filed_contents(events: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The latest committed filing of each content, or of the contents ``wanted`` (``file_hash``)."""
    rows = committed(events).where(F.col("file_hash").isNotNull())
    if wanted is not None:
        rows = rows.join(wanted, "file_hash", "left_semi")
    order = F.struct("created_at", "run_id", "event_id")
    filed = latest_by(rows, ["file_hash"], order, ["filename", "category_l2"])
    return filed.select("file_hash", F.struct("filename", "category_l2").alias("filed"))


def current_decisions(cache: DataFrame, settings: Settings) -> DataFrame:
    """The latest cached decision of each content for this prompt and these models."""
    rows = cache.where(
        (F.col("prompt_version") == settings.prompt_version)
        & (F.col("understanding_model") == settings.understanding_model)
        & (F.col("classification_model") == settings.classification_model)
        & F.col("file_hash").isNotNull()
    )
    last = latest_by(rows, ["file_hash"], F.struct("cached_at", *DECISION_FIELDS), DECISION_FIELDS)
    return last.select("file_hash", F.struct(*DECISION_FIELDS).alias("decision"))


def current_extractions(cache: DataFrame, settings: Settings) -> DataFrame:
    """The latest cached text of each content, reduced to its facts before the shuffle."""
    wanted = cache.where((F.col("ocr_model") == settings.ocr_key) & F.col("file_hash").isNotNull())
    rows = wanted.select(
        "file_hash",
        F.struct("cached_at", F.xxhash64("extracted_text"), "ocr_used", "conversion_used").alias("order"),
        text_facts("extracted_text", settings)
        .withField("quality", F.col("extraction_quality"))
        .alias("facts"),
        "metadata",
        "ocr_used",
        "conversion_used",
    )
    columns = ["facts", "metadata", "ocr_used", "conversion_used"]
    last = latest_by(rows, ["file_hash"], F.col("order"), columns)
    return last.select("file_hash", F.struct(*columns).alias("extraction"))


def merged_decisions(cache: DataFrame) -> DataFrame:
    """The decision cache as it stands: the last write of each key wins."""
    keys = ["file_hash", "prompt_version", "understanding_model", "classification_model"]
    return latest_by(cache, keys, F.struct("cached_at", *DECISION_FIELDS), [*DECISION_FIELDS, "cached_at"])


def merged_extractions(cache: DataFrame) -> DataFrame:
    keys = ["file_hash", "ocr_model"]
    columns = ["extracted_text", "metadata", "extraction_quality", "ocr_used", "conversion_used", "cached_at"]
    order = F.struct("cached_at", F.xxhash64("extracted_text"), "ocr_used", "conversion_used")
    return latest_by(cache, keys, order, columns)


def look_up(
    files: DataFrame,
    settings: Settings,
    *,
    events: DataFrame | None = None,
    decisions: DataFrame | None = None,
    extractions: DataFrame | None = None,
    history: History | None = None,
) -> DataFrame:
    """Add ``copies``, ``first_copy`` and one struct per table given, NULL without a match.

    ``files`` is read twice, for its distinct contents and for the join. With a ``history`` the earlier
    filings come from there and ``events`` are not read.
    """
    facts = distinct_contents(files)
    wanted = facts.select("file_hash")
    if history is not None:
        facts = facts.join(history.filed(wanted), "file_hash", "left")
    elif events is not None:
        # Undone rows are told by run and document, so the hashes restrict only what they are taken from.
        facts = facts.join(filed_contents(events, wanted), "file_hash", "left")
    if decisions is not None:
        known = decisions.join(wanted, "file_hash", "left_semi")
        facts = facts.join(current_decisions(known, settings), "file_hash", "left")
    if extractions is not None:
        known = extractions.join(wanted, "file_hash", "left_semi")
        facts = facts.join(current_extractions(known, settings), "file_hash", "left")
    return attach(
        files, facts, ["file_hash"], size="copies", spread_by="document_id", hot_rows=settings.hot_rows
    )


def is_later_copy() -> Column:
    """True for each file that is not the first of its content in this run."""
    return F.coalesce(F.col("first_copy.document_id") != F.col("document_id"), F.lit(False))


def extraction_candidates(files: DataFrame, decisions: DataFrame, settings: Settings) -> DataFrame:
    """Files whose text must be made by a batch extractor: PDFs without a cached decision."""
    pdfs = files.where(F.col("extension") == ".pdf")
    return look_up(pdfs, settings, decisions=decisions).where(F.col("decision").isNull())

