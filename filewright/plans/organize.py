"""One run over the inbox: from file rows to a plan, ledger rows and metrics."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from filewright import schemas
from filewright.functions.rules import rule_for_name
from filewright.operators.contents import is_later_copy, look_up, text_facts
from filewright.operators.decisions import (
    attach_answers,
    choose_text,
    decide,
    duplicate_category,
    needs_model,
    typed_answers,
)
from filewright.operators.history import History
from filewright.operators.ledger import closed, committed, event_rows, opened
from filewright.operators.metrics import document_report, metrics_of_run
from filewright.operators.names import Names
from filewright.operators.routing import destination_folder, destination_path, technical_folder, unique_names
from filewright.operators.skew import attach
from filewright.operators.taxonomy import align, normalized_pair, scan_taxonomy
from filewright.settings import DUPLICATES, Run, Settings
from filewright.sources.inbox import document_id
from filewright.sources.tables import empty_table, materialize


PLAN = (
    *("run_id", "document_id", "source_path", "filename", "extension", "mime_type", "file_hash", "file_size"),
    *("metadata", "ocr_used", "conversion_used", "summary", "keywords", "language", "document_type"),
    *("raw_category_l1", "raw_category_l2", "category_l1", "category_l2", "confidence", "reason", "needs_review"),
    *("destination_path", "status", "decision_source", "cached", "errors"),
    *("understanding_model", "classification_model", "prompt_version"),
)


@dataclass(frozen=True)
class Tables:
    """What a run knows from before. ``taxonomy`` defaults to the folders the events use, ``history`` and ``names`` to the events."""

    events: DataFrame
    decisions: DataFrame
    extractions: DataFrame
    precomputed: DataFrame
    responses: DataFrame
    taxonomy: DataFrame | None = None
    history: History | None = None
    names: Names | None = None

    @staticmethod
    def empty(spark: SparkSession, **given: DataFrame | History | Names) -> Tables:
        names = {
            "events": schemas.EVENTS,
            "decisions": schemas.DECISIONS,
            "extractions": schemas.EXTRACTIONS,
            "precomputed": schemas.PRECOMPUTED,
            "responses": schemas.RESPONSES,
        }
        made = {name: empty_table(spark, schema) for name, schema in names.items() if name not in given}
        return Tables(**made, **given)


@dataclass(frozen=True)
class Organized:
    plan: DataFrame
    run: Run
    settings: Settings
    observed: Mapping[str, Observation] = field(default_factory=dict)

    def stage_metrics(self) -> DataFrame:
        """What went through each stored stage, counted while it was written: one row for each stage, in order."""
        rows = [(place, stage, *(seen.get[name] for name in COUNTED)) for place, (stage, seen) in enumerate(self.observed.items())]
        counts = ", ".join(f"{name} BIGINT" for name in COUNTED)
        return self.plan.sparkSession.createDataFrame(rows, f"place INT, stage STRING, {counts}").drop("place")

    def events(self, first_id: int = 1) -> DataFrame:
        return event_rows(self.plan, self.run, first_id, self.settings.hot_rows)

    def metrics(self) -> DataFrame:
        return metrics_of_run(self.plan, self.run.run_id)

    def report(self) -> DataFrame:
        return document_report(self.plan)

    def run_record(self, completed_at: datetime | None = None) -> DataFrame:
        """The record that opens the run, or with a time the one that closes it."""
        known = {"started_at": F.lit(self.run.started_at), "dry_run": F.lit(self.run.dry_run)}
        metrics = self.metrics().withColumns({**known, "completed_at": F.lit(completed_at).cast("timestamp")})
        return opened(metrics) if completed_at is None else closed(metrics)

    def new_decisions(self) -> DataFrame:
        """Decision-cache rows of the documents that were decided in this run."""
        made = self.plan.where(F.col("decided_here") & F.col("file_hash").isNotNull())
        return made.select(
            "file_hash",
            F.lit(self.settings.prompt_version).alias("prompt_version"),
            F.lit(self.settings.understanding_model).alias("understanding_model"),
            F.lit(self.settings.classification_model).alias("classification_model"),
            "summary",
            "keywords",
            "language",
            "document_type",
            F.col("raw_category_l1").alias("category_l1"),
            F.col("raw_category_l2").alias("category_l2"),
            "confidence",
            "reason",
            "needs_review",
            F.lit(self.run.started_at).alias("cached_at"),
        )


COUNTED = ("files", "duplicates", "cached", "review", "failed")


def _observed(rows: DataFrame, duplicate: Column, cached: Column, failed: Column) -> tuple[DataFrame, Observation]:
    """The same rows, counted as they pass."""
    seen = Observation()
    kinds = dict(zip(COUNTED[1:], (duplicate, cached, F.col("needs_review"), failed)))
    counts = [F.count_if(F.coalesce(kind, F.lit(False))).alias(name) for name, kind in kinds.items()]
    return rows.observe(seen, F.count(F.lit(1)).alias("files"), *counts), seen


def describe(files: DataFrame, settings: Settings) -> DataFrame:
    """File rows with their text replaced by its facts."""
    return (
        files.withColumn("facts", text_facts("extracted_text", settings))
        .withColumn("name_rule", rule_for_name("filename", settings.rules))
        .drop("extracted_text")
    )


def precomputed_facts(precomputed: DataFrame, run_id: str, settings: Settings) -> DataFrame:
    """Facts of the texts a batch extractor made, by document; empty texts do not count.

    Keyed by document like the model answers, so that one shuffle of the files serves both.
    """
    made = precomputed.where(F.col("text") != "")
    identity = document_id(F.lit(run_id), F.col("source_path")).alias("document_id")
    return made.select(identity, text_facts("text", settings).alias("precomputed"))


def prepare(described: DataFrame, tables: Tables, run_id: str, settings: Settings) -> DataFrame:
    """Look everything up and choose the text of each file."""
    found = look_up(
        described,
        settings,
        events=tables.events,
        decisions=tables.decisions,
        extractions=tables.extractions,
        history=tables.history,
    )
    return choose_text(found.join(precomputed_facts(tables.precomputed, run_id, settings), "document_id", "left"))


def model_workload(prepared: DataFrame) -> DataFrame:
    """Documents for which a model has to be asked: first copies no earlier step decides."""
    return prepared.where(needs_model() & ~is_later_copy())


def categorize(decided: DataFrame, taxonomy: DataFrame, settings: Settings) -> DataFrame:
    """Final categories: only documents bound for a category folder are normalised."""
    technical = technical_folder("raw_category_l1", "raw_category_l2", "needs_review", "routable")
    filed = (F.col("state") != "failed") & technical.isNull()
    level1, level2 = normalized_pair(F.col("raw_category_l1"), F.col("raw_category_l2"), settings)
    rows = decided.withColumn("filed", filed).withColumns(
        {"category_l1": F.when(F.col("filed"), level1), "category_l2": F.when(F.col("filed"), level2)}
    )
    return align(rows, taxonomy, settings).withColumns(
        {
            name: F.expr(f"CASE WHEN filed THEN {name} ELSE raw_{name} END")
            for name in ("category_l1", "category_l2")
        }
    )


def mark_copies(decided: DataFrame, settings: Settings) -> DataFrame:
    """Copies of a content follow the first one in path order that did not fail.

    A content filed by an earlier run keeps pointing at that filing.
    """
    several = F.coalesce((F.col("copies") > 1) & (F.col("state") != "duplicate"), F.lit(False))
    copies, others = decided.where(several), decided.where(~several)
    kept = F.min(F.struct("source_path", "filename", "category_l2"))
    firsts = (
        copies.where(F.col("state") != "failed")
        .groupBy("file_hash")
        .agg(kept.alias("kept"), F.max("copies").alias("group_size"))
        .selectExpr(
            "file_hash",
            "group_size",
            "kept.source_path AS first_path",
            "kept.filename AS first_filename",
            "kept.category_l2 AS first_category_l2",
        )
    )
    joined = attach(
        copies, firsts, ["file_hash"], size="group_size", spread_by="document_id", hot_rows=settings.hot_rows
    )
    nothing = "cast(array() AS array<string>)"
    category_l2 = duplicate_category("first_category_l2")
    values = {
        "state": "'duplicate'",
        "path": "'duplicate'",
        "decision_source": "'duplicate'",
        **{name: "NULL" for name in ("summary", "language", "document_type")},
        **{name: "NULL" for name in ("understanding_model", "classification_model", "prompt_version")},
        "keywords": nothing,
        "content_signals": nothing,
        "raw_category_l1": f"'{DUPLICATES}'",
        "raw_category_l2": category_l2,
        "category_l1": f"'{DUPLICATES}'",
        "category_l2": category_l2,
        "confidence": "1D",
        "reason": "concat('Duplicate of ', first_filename)",
        "needs_review": "false",
        "cached": "false",
        "errors": nothing,
    }
    chosen = [
        f"CASE WHEN source_path > first_path THEN {values[name]} ELSE {name} END AS {name}" if name in values else name
        for name in decided.columns
    ]
    return others.unionByName(joined.selectExpr(*chosen))


def route(rows: DataFrame, existing: DataFrame | Names, run: Run, settings: Settings) -> DataFrame:
    """Destination and final status. Failed documents stay where they are."""
    technical = technical_folder("category_l1", "category_l2", "needs_review", "routable")
    folder = destination_folder(technical, F.col("category_l1"), F.col("category_l2"))
    moving = rows.where(F.col("state") != "failed").select(
        "document_id", "source_path", "filename", folder.alias("folder")
    )
    named = unique_names(materialize(moving), existing, settings).select(
        "document_id", destination_path(F.col("folder"), F.col("unique_name"), settings).alias("destination_path")
    )
    done = "planned" if run.dry_run else "moved"
    final = F.when(F.col("state") == "failed", "failed").otherwise(done)
    return rows.join(named, "document_id", "left").withColumn("status", final)


# The settings by which rows are gathered; configurations that have them in common decide on the same rows.
GATHERED_BY = (
    *("rules", "stop_words", "prompt_version", "understanding_model", "classification_model"),
    *("ocr_model", "parse_bool_strings", "hot_rows"),
)


def gather(files: DataFrame, tables: Tables, run: Run, settings: Settings) -> DataFrame:
    """The files with all that is known of them before anything is decided."""
    described = materialize(describe(files, settings))
    prepared = prepare(described, tables, run.run_id, settings)
    answers = tables.responses.join(described.select("document_id"), "document_id", "left_semi")
    return attach_answers(prepared, typed_answers(answers, settings))


def settle(gathered: DataFrame, tables: Tables, run: Run, settings: Settings) -> Organized:
    """Decide on gathered files and give them their places."""
    decided = decide(gathered, settings)
    taxonomy = tables.taxonomy
    if taxonomy is None:
        taxonomy = materialize(scan_taxonomy(tables.events, settings))
    decided, seen = _observed(decided, F.col("path") == "duplicate", F.col("path") == "cache", F.col("state") == "failed")
    decided = materialize(decided)
    categorized = materialize(categorize(decided, taxonomy, settings))
    marked = mark_copies(categorized, settings)
    routed = route(marked, tables.names or committed(tables.events), run, settings)
    plan = routed.select(
        *PLAN, F.col("facts.quality").alias("extraction_quality"), (F.col("path") == "sorted").alias("decided_here")
    )
    plan, seen_plan = _observed(plan, F.col("category_l1") == DUPLICATES, F.col("cached"), F.col("status") == "failed")
    return Organized(materialize(plan), run, settings, {"decided": seen, "planned": seen_plan})


def organize(files: DataFrame, tables: Tables, run: Run, settings: Settings) -> Organized:
    """Plan a run. ``files`` has the columns of ``schemas.FILES`` and the run id of ``run``.

    Texts are read once and reduced to facts where they lie. What is shuffled
    is narrow, and is stored where a later step reads it more than once.
    """
    return settle(gather(files, tables, run, settings), tables, run, settings)


def organize_each(files: DataFrame, tables: Tables, run: Run, configs: Mapping[str, Settings]) -> dict[str, Organized]:
    """The same run under several configurations. Those that gather alike read texts, caches and answers once."""
    reads = {name: [getattr(settings, part) for part in GATHERED_BY] for name, settings in configs.items()}
    kept: list[tuple[list, DataFrame]] = []
    made = {}
    for name, settings in configs.items():
        rows = next((rows for read, rows in kept if read == reads[name]), None)
        if rows is None:
            rows = gather(files, tables, run, settings)
            if list(reads.values()).count(reads[name]) > 1:
                rows = materialize(rows)
                kept.append((reads[name], rows))
        made[name] = settle(rows, tables, run, settings)
    return made
