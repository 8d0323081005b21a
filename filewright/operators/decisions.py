"""Understanding, classification and review of documents, as column logic.

Rows carry text facts and, where there is one, a typed model answer. Nothing
here reads the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.functions.responses import parse_answer, typed_classification, typed_understanding
from filewright.functions.rules import rule_verdict
from filewright.functions.text import literal
from filewright.operators.skew import latest_by
from filewright.settings import DUPLICATES, Settings

# Texts that end up in decisions.
BELOW_THRESHOLD = "Below review threshold"
NO_TEXT = "Extraction produced no usable text"
FALLBACK_REASON = "Fallback heuristic classification"
FALLBACK_TYPE = "document"
KNOWN_DUPLICATE = "KnownDuplicate"

def typed_answers(responses: DataFrame, settings: Settings) -> DataFrame:
    """One row per document with its typed answers; raw texts are not shuffled."""
    wanted = responses.where(F.col("stage").isin("understand", "classify"))
    order = answer_order(responses).alias("order")
    parsed = wanted.select("document_id", "stage", order, parse_answer("raw").alias("payload"))
    typed = typed_classification(typed_understanding(parsed), settings.parse_bool_strings)

    def last(stage: str, answer: str) -> Column:
        return F.max_by(F.when(F.col("stage") == stage, F.col(answer)), F.when(F.col("stage") == stage, F.col("order"))).alias(answer)

    return typed.groupBy("document_id").agg(last("understand", "understood"), last("classify", "classified"))


def answer_order(responses: DataFrame) -> Column:
    """By which the last of several answers is known: their time where it is kept, then the answer itself."""
    times = ["answered_at"] if "answered_at" in responses.columns else []
    return F.struct(*times, "raw")


def attach_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    return rows.join(answers, "document_id", "left")


def attach_raw_answer(rows: DataFrame, responses: DataFrame, stage: str) -> DataFrame:
    """The raw answer of one stage beside each document."""
    wanted = responses.where(F.col("stage") == stage)
    last = latest_by(wanted, ["document_id"], answer_order(responses), ["raw"])
    return rows.join(last, "document_id", "left")


def understanding_fallback(facts: str = "facts") -> Column:
    """What can be said about a text without a model, from its facts."""
    return F.expr(f"""struct({facts}.summary AS summary, {facts}.keywords AS keywords, {facts}.language AS language,
        '{FALLBACK_TYPE}' AS document_type, slice({facts}.keywords, 1, 5) AS content_signals)""")


def classification_fallback(reading: str, settings: Settings) -> Column:
    """A general category named after the document type, with low confidence."""
    confidence = f"CASE WHEN coalesce({reading}.summary, '') != '' THEN 0.4D ELSE 0.2D END"
    return F.expr(f"""struct('General' AS category_l1,
        coalesce(nullif({reading}.document_type, ''), 'Unsorted') AS category_l2,
        {confidence} AS confidence, '{FALLBACK_REASON}' AS reason,
        {confidence} < {settings.review_confidence}D AS needs_review)""")


def gated_reason(confidence: str, reason: str, settings: Settings) -> str:
    """SQL: the reason, with a note where confidence is below the threshold."""
    noted = f"coalesce(concat(nullif({reason}, ''), ' | '), '') || '{BELOW_THRESHOLD}'"
    return f"CASE WHEN {confidence} < {settings.review_confidence}D THEN {noted} ELSE {reason} END"


def gated_review(confidence: str, needs_review: str, settings: Settings) -> str:
    """SQL: the review flag, set where confidence is below the threshold."""
    return f"({confidence} < {settings.review_confidence}D OR {needs_review})"


def duplicate_category(category_l2: str) -> str:
    return f"coalesce(nullif({category_l2}, ''), '{KNOWN_DUPLICATE}')"


def choose_text(rows: DataFrame) -> DataFrame:
    """Precomputed text wins over cached text, and that over the file's own text."""
    source = """CASE WHEN precomputed IS NOT NULL THEN 'opendataloader'
        WHEN extraction IS NOT NULL THEN 'extraction_cache' ELSE 'extractor' END"""
    kept = [n for n in rows.columns if n not in _CHOSEN]
    return rows.withColumn("text_source", F.expr(source)).selectExpr(
        *kept,
        "text_source",
        "CASE text_source WHEN 'opendataloader' THEN precomputed"
        " WHEN 'extractor' THEN facts ELSE extraction.facts END AS facts",
        "CASE text_source WHEN 'opendataloader' THEN map('odl_batch', 'true')"
        " WHEN 'extractor' THEN metadata ELSE extraction.metadata END AS metadata",
        *[
            f"coalesce(CASE text_source WHEN 'extractor' THEN {flag}"
            f" WHEN 'extraction_cache' THEN extraction.{flag} END, false) AS {flag}"
            for flag in ("ocr_used", "conversion_used")
        ],
        "CASE text_source WHEN 'extractor' THEN errors ELSE cast(array() AS array<string>) END AS errors",
    )


_CHOSEN = ("precomputed", "extraction", "facts", "metadata", "ocr_used", "conversion_used", "errors")


def needs_model() -> Column:
    """True for documents that no earlier step has decided."""
    return F.expr("filed IS NULL AND decision IS NULL AND (text_source != 'extractor' OR facts.has_text)")


def _by_path(**known: str) -> str:
    """SQL: a value per way of deciding, NULL for the ways not named."""
    return "CASE path " + " ".join(f"WHEN '{path}' THEN {sql}" for path, sql in known.items()) + " END"


def decide(rows: DataFrame, settings: Settings) -> DataFrame:
    """Decide every document, without regard to other documents of the run.

    Needs ``filed, decision, text_source, facts, name_rule, understood,
    classified``. The column ``path`` says how a document was decided:
    ``duplicate``, ``cache``, ``no_text``, ``unread`` (unusable understanding
    answer), ``unsorted`` (unusable classification answer) or ``sorted``.
    """
    answer = """struct(understood.summary AS summary, understood.keywords AS keywords,
        understood.language AS language, understood.document_type AS document_type,
        understood.content_signals AS content_signals)"""
    answered, classified = "understood.state <=> 'object'", "classified.state <=> 'object'"
    rows = rows.withColumns(
        {
            "reading": F.when(F.expr(answered), F.expr(answer)).otherwise(understanding_fallback()),
            "rule": rule_verdict("least(name_rule, facts.rule)", settings.rules),
        }
    )
    path = """CASE WHEN filed IS NOT NULL THEN 'duplicate'
        WHEN decision IS NOT NULL THEN 'cache'
        WHEN text_source = 'extractor' AND NOT facts.has_text THEN 'no_text'
        WHEN understood.state <=> 'invalid' THEN 'unread'
        WHEN rule IS NULL AND classified.state <=> 'invalid' THEN 'unsorted'
        ELSE 'sorted' END"""
    verdict = "struct({0}.category_l1, {0}.category_l2, {0}.confidence, {0}.reason, {1} AS needs_review)"
    rows = rows.withColumns(
        {
            "path": F.expr(path),
            "verdict": F.when(F.expr("rule IS NOT NULL"), F.expr(verdict.format("rule", "false")))
            .when(F.expr(classified), F.expr(verdict.format("classified", "classified.needs_review")))
            .otherwise(classification_fallback("reading", settings)),
        }
    )
    nothing = "cast(array() AS array<string>)"
    read_text = {"unsorted": "reading.{0}", "sorted": "reading.{0}", "cache": "decision.{0}"}
    values = {
        "state": _by_path(
            duplicate="'duplicate'",
            cache="'classified'",
            no_text="'review'",
            unread="'failed'",
            unsorted="'failed'",
            sorted="'classified'",
        ),
        "decision_source": "coalesce("
        + _by_path(duplicate="'duplicate'", cache="'cache'", sorted="'llm'")
        + ", text_source)",
        "routable": f"coalesce({_by_path(cache=str(not settings.strict_cache_routing), sorted='facts.has_text')}, false)",
        **{
            name: _by_path(**{path: sql.format(name) for path, sql in read_text.items()})
            for name in ("summary", "language", "document_type")
        },
        "keywords": f"coalesce({_by_path(**{path: sql.format('keywords') for path, sql in read_text.items()})}, {nothing})",
        "content_signals": "coalesce("
        + _by_path(sorted="reading.content_signals", unsorted="reading.content_signals")
        + f", {nothing})",
        "raw_category_l1": _by_path(
            duplicate=f"'{DUPLICATES}'", cache="decision.category_l1", sorted="verdict.category_l1"
        ),
        "raw_category_l2": _by_path(
            duplicate=duplicate_category("filed.category_l2"),
            cache="decision.category_l2",
            sorted="verdict.category_l2",
        ),
        "confidence": "coalesce("
        + _by_path(duplicate="1D", cache="decision.confidence", sorted="verdict.confidence")
        + ", 0D)",
        "reason": _by_path(
            duplicate="concat('Duplicate of ', filed.filename)",
            cache="decision.reason",
            no_text=f"'{NO_TEXT}'",
            sorted=gated_reason("verdict.confidence", "verdict.reason", settings),
        ),
        "needs_review": "coalesce("
        + _by_path(
            cache="decision.needs_review",
            no_text="true",
            sorted=gated_review("verdict.confidence", "verdict.needs_review", settings),
        )
        + ", false)",
        "cached": "path = 'cache'",
        "understanding_model": f"CASE WHEN path IN ('sorted', 'unsorted') AND {answered}"
        f" THEN {literal(settings.understanding_model)} END",
        "classification_model": f"CASE WHEN path = 'sorted' AND rule IS NULL AND {classified}"
        f" THEN {literal(settings.classification_model)} END",
        "prompt_version": f"CASE WHEN path IN ('sorted', 'unsorted') THEN {literal(settings.prompt_version)} END",
        "errors": "CASE path WHEN 'unread' THEN array_append(errors, 'Unusable understanding answer')"
        " WHEN 'unsorted' THEN array_append(errors, 'Unusable classification answer') ELSE errors END",
    }
    used = {"filed", "decision", "understood", "classified", "reading", "verdict", "rule", "errors"}
    kept = [name for name in rows.columns if name not in used]
    return rows.selectExpr(*kept, *[f"{sql} AS {name}" for name, sql in values.items()])
