"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.functions import paths, prompts, text
from filewright.functions.responses import answered_text, parse_answer, typed_classification, typed_understanding, with_fields
from filewright.functions.rules import rule_for_name, rule_for_text, rule_verdict
from filewright.operators import contents, decisions, ledger, metrics, movements, routing, rule_table, scoring, taxonomy
from filewright.operators.counters import Counters, current_taxonomy, moved_rows, record_events
from filewright.operators.history import History
from filewright.operators.names import Names
from filewright.operators.state import State
from filewright.plans.benchmark import benchmark
from filewright.plans.model import build_prompts, with_model
from filewright.plans.organize import describe, model_workload, organize, precomputed_facts, prepare
from filewright.plans.output import write_organized
from filewright.plans.single_level import organize_single_level, rename_plan
from filewright.plans.warmup import warm_extractions
from filewright.sources.extraction import files_from_binary
from filewright.sources.inbox import decode_texts, dispatch, envelopes, files_from_texts, first_files, inbox_stream, scan_inbox
from filewright.sources.labels import load_labels
from filewright.sources.tables import materialize, shared_folder
from filewright.streaming.incremental import organize_stream
from filewright.workload import corpus
from filewright.workload.corpus import SETTINGS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register under the function's name; a last underscore only keeps it apart from an import."""
    QUERIES[build.__name__.rstrip("_")] = build
    return build


def joined(array: str) -> Column:
    return F.concat_ws(",", array).alias(array)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/filewright/{name}-{uuid.uuid4().hex}"


# Sources


@query
def ingest_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.all_files(spark, sf_dir)
    return files.select(
        "document_id", "run_id", "source_path", "filename", "extension", "mime_type", "file_size", "file_hash"
    )


@query
def inbox_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files under all kinds of names, read back with their contents."""
    folder = fresh_path(spark, "inbox")
    corpus.write_files(corpus.inbox_names(spark, sf_dir), folder)
    files = files_from_binary(scan_inbox(spark, folder), corpus.CURRENT.run_id)
    error = F.concat_ws("\n", "errors").alias("error")
    return files.select("filename", "extension", "file_size", "file_hash", "extracted_text", error)


@query
def inbox_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files in two lots, as a stream that is started again for the second."""
    folder = fresh_path(spark, "inbox")
    files = corpus.inbox_names(spark, sf_dir)

    def keep(rows: DataFrame, batch: int) -> None:
        made = rows.select(paths.name_of(F.col("source_path")).alias("filename"), "file_size", F.md5("content").alias("file_hash"))
        made.write.mode("overwrite").parquet(f"{folder}-batches/batch={batch}")

    for lot in range(2):
        corpus.write_files(files.where(F.floor(F.col("doc_id") / 4) % 2 == lot), folder)
        stream = inbox_stream(spark, folder, settle=0).writeStream.foreachBatch(keep)
        stream.option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}-batches").select("filename", "file_size", "file_hash", "batch")


@query
def ingest_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_files(corpus.named_documents(spark, sf_dir).select("doc_id", "source_path"), 100)


@query
def text_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored as Latin-1 where that holds them, else as UTF-8."""
    narrow = (F.col("lang") != "en") & F.col("text").rlike(r"^[\x00-\xff]*$")
    content = F.when(narrow, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    rows = corpus.table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    return decode_texts(rows).select("doc_id", "encoding", "extracted_text", "extraction_quality")


@query
def extraction_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dispatch(envelopes(corpus.named_documents(spark, sf_dir), F.col("run_id")))
    error = F.when(F.size("errors") > 0, F.concat_ws("\n", "errors"))
    return rows.select("document_id", "extension", "mime_type", "extractor_name", error.alias("error"))


@query
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query
def precomputed_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    run_id = corpus.CURRENT.run_id
    files = envelopes(corpus.named_documents(spark, sf_dir), run_id).select("document_id")
    made = precomputed_facts(corpus.precomputed(spark, sf_dir), run_id, SETTINGS)
    return files.join(made, "document_id", "left").select(
        "document_id",
        F.col("precomputed").isNotNull().alias("odl_batch"),
        F.col("precomputed.quality").alias("extraction_quality"),
        F.lit(False).alias("ocr_used"),
    )


@query
def extraction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.all_files(spark, sf_dir).select("document_id", "source_path", "filename", "extension", "file_hash")
    found = contents.extraction_candidates(files, corpus.decisions(spark, sf_dir), SETTINGS)
    return found.select("document_id", "source_path")


@query
def rows_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows; amounts are written with two decimals."""
    rows = corpus.table(spark, sf_dir, "lineitem")
    cells = [F.col(name).cast("decimal(18,2)") if kind == "double" else F.col(name) for name, kind in rows.dtypes]
    return rows.select("l_orderkey", "l_linenumber", text.rows_as_text(*cells).alias("line"))


@query
def benchmark_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "labels")
    corpus.benchmark_labels(spark, sf_dir).write.json(path)
    return load_labels(spark, path)


@query
def taxonomy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.scan_taxonomy(corpus.events(spark, sf_dir), SETTINGS)


# Sinks


@query
def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.stored_run(spark, sf_dir).events(first_id=1)


@query
def runs_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ledger.current_runs(corpus.run_records(spark, sf_dir))
    return runs.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query
def cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = contents.merged_decisions(corpus.decisions(spark, sf_dir))
    return merged.withColumn("keywords", joined("keywords"))


@query
def extraction_cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = contents.merged_extractions(corpus.extractions(spark, sf_dir))
    return merged.withColumn("metadata", F.col("metadata")["lang"])


@query
def document_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = corpus.stored_run(spark, sf_dir).report()
    return report.withColumn("errors", F.concat_ws("\n", "errors"))


@query
def organized_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "organized")
    """The tree after a run, another run of its duplicates alone, and the first run once more."""
    documents = corpus.current_files(spark, sf_dir).select("document_id", "extracted_text")
    plan = corpus.plan(spark, sf_dir)
    copies = plan.where(F.col("category_l1") == "_Duplicates")
    for rows, run in ((plan, corpus.CURRENT), (copies, corpus.LATER), (plan, corpus.CURRENT)):
        write_organized(rows, documents, path, run, SETTINGS)
    back = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path)
    return back.select("run_id", "document_id", "destination_path", "folder_l1", "folder_l2", "extracted_text")


@query
def movement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.movements(spark, sf_dir)
    outcomes = rows.withColumnRenamed("original_path", "source_path")
    made = movements.movement_rows(outcomes.drop("original_filename", "new_filename"))
    return made


# Projections and filters


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a verdict of their own, to be gated and routed."""
    return corpus.identified(spark, sf_dir).select(
        "document_id",
        "filename",
        F.when(F.col("source") == "src7", "_Duplicates")
        .when(F.col("source") == "src8", None)
        .otherwise(F.expr(corpus.ANSWER_LEVEL1))
        .alias("category_l1"),
        F.when(F.col("source") == "src9", "").otherwise(F.expr(corpus.ANSWER_LEVEL2)).alias("category_l2"),
        (F.col("doc_id") % 100 / 100).alias("confidence"),
        F.when(F.col("lang") == "fr", "").when(F.col("lang") == "en", "Because").alias("reason"),
        (F.col("source") == "src10").alias("needs_review"),
        (F.col("lang") != "de").alias("has_text"),
    )


@query
def route_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    technical = routing.technical_folder("category_l1", "category_l2", "needs_review", "has_text")
    folder = routing.destination_folder(technical, F.col("category_l1"), F.col("category_l2"))
    return scored(spark, sf_dir).select("document_id", folder.alias("folder"))


@query
def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(
        "document_id",
        "confidence",
        F.expr(decisions.gated_reason("confidence", "reason", SETTINGS)).alias("reason"),
        F.expr(decisions.gated_review("confidence", "needs_review", SETTINGS)).alias("needs_review"),
    )


def undecided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with nothing known from before."""
    files = corpus.all_files(spark, sf_dir)
    nothing = {
        "filed": "cast(NULL AS struct<filename:string,category_l2:string>)",
        "decision": "cast(NULL AS struct<summary:string,keywords:array<string>,language:string,document_type:string,"
        "category_l1:string,category_l2:string,confidence:double,reason:string,needs_review:boolean>)",
        "text_source": "'extractor'",
        "understood": "cast(NULL AS struct<state:string,summary:string,language:string,document_type:string,"
        "keywords:array<string>,content_signals:array<string>>)",
        "classified": "cast(NULL AS struct<state:string,category_l1:string,category_l2:string,reason:string,"
        "confidence:double,needs_review:boolean>)",
    }
    return describe(files, SETTINGS).selectExpr("*", *[f"{sql} AS {name}" for name, sql in nothing.items()])


@query
def extraction_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = decisions.decide(undecided(spark, sf_dir), SETTINGS)
    gated = decided.where(F.col("path") == "no_text")
    return gated.select("document_id", "state", "decision_source", "reason", "needs_review")


@query
def model_workload_(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = materialize(describe(corpus.current_files(spark, sf_dir), SETTINGS))
    prepared = prepare(files, corpus.tables(spark, sf_dir), corpus.CURRENT.run_id, SETTINGS)
    return model_workload(prepared).select("document_id", "text_source")


# Joins


def narrow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.all_files(spark, sf_dir)
    return materialize(files.select("document_id", "source_path", "filename", "file_hash"))


@query
def duplicate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contents.look_up(narrow_files(spark, sf_dir), SETTINGS, events=corpus.events(spark, sf_dir))
    hits = found.where(F.col("filed").isNotNull())
    return hits.select(
        "document_id",
        F.lit("_Duplicates").alias("category_l1"),
        F.expr(decisions.duplicate_category("filed.category_l2")).alias("category_l2"),
        F.concat(F.lit("Duplicate of "), "filed.filename").alias("reason"),
    )


def several_runs_history(spark: SparkSession, sf_dir: str) -> History:
    """Runs recorded as they came, and once more what was undone of two of them."""
    events = corpus.several_runs(spark, sf_dir)
    history = History(fresh_path(spark, "history"), buckets=16)
    history.record(events.where(F.col("status") != ledger.UNDONE))
    history.record(events.where(F.col("run_id").isin("run-3", "run-4")))
    return history


@query
def history_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files against the stored filings of several runs, some of them undone."""
    files = narrow_files(spark, sf_dir)
    found = contents.look_up(files, SETTINGS, history=several_runs_history(spark, sf_dir))
    hits = found.where(F.col("filed").isNotNull())
    reason = F.concat(F.lit("Duplicate of "), "filed.filename").alias("reason")
    return hits.select("document_id", F.expr(decisions.duplicate_category("filed.category_l2")).alias("category_l2"), reason)


@query
def history_runs_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which runs a lookup of a few contents reads, by the bitmaps of their hashes."""
    few = corpus.identified(spark, sf_dir).where((F.col("doc_id") % 3 == 0) & (F.col("source") == "src1"))
    return several_runs_history(spark, sf_dir).runs_to_read(few.select("file_hash"))


@query
def duplicates_in_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contents.look_up(narrow_files(spark, sf_dir), SETTINGS)
    copies = found.where(contents.is_later_copy())
    return copies.select("document_id", "copies", F.col("first_copy.source_path").alias("first_path"))


@query
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contents.look_up(narrow_files(spark, sf_dir), SETTINGS, decisions=corpus.decisions(spark, sf_dir))
    fields = [F.col(f"decision.{n}").alias(n) for n in contents.DECISION_FIELDS if n != "keywords"]
    keywords = F.concat_ws(",", "decision.keywords").alias("keywords")
    return found.where(F.col("decision").isNotNull()).select("document_id", *fields, keywords)


@query
def extraction_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contents.look_up(narrow_files(spark, sf_dir), SETTINGS, extractions=corpus.extractions(spark, sf_dir))
    return found.where(F.col("extraction").isNotNull()).select(
        "document_id",
        F.col("extraction.facts.quality").alias("extraction_quality"),
        F.col("extraction.facts.has_text").alias("has_text"),
        F.col("extraction.facts.summary").alias("summary"),
        F.col("extraction.ocr_used").alias("ocr_used"),
    )


@query
def taxonomy_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule categories in odd spellings, aligned with the folders in use."""
    verdict = rule_verdict("rule", SETTINGS.rules)
    rows = corpus.identified(spark, sf_dir).withColumn("rule", rule_for_name("filename", SETTINGS.rules))
    english = F.col("lang") == "en"
    rows = rows.select(
        "document_id",
        F.upper(verdict["category_l1"]).alias("category_l1"),
        F.when(english, F.lower(verdict["category_l2"])).otherwise(F.concat(F.lit("My "), verdict["category_l2"])).alias("category_l2"),
    ).where(F.col("category_l1").isNotNull())
    known = taxonomy.scan_taxonomy(corpus.events(spark, sf_dir), SETTINGS)
    return taxonomy.align(rows, known, SETTINGS).select("document_id", "category_l1", "category_l2")


@query
def taxonomy_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    level1, level2 = taxonomy.normalized_pair(F.col("category_l1"), F.col("category_l2"), SETTINGS)
    rows = scored(spark, sf_dir)
    return rows.select("document_id", level1.alias("category_l1"), level2.alias("category_l2"))


@query
def benchmark_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.benchmark_cases(corpus.benchmark_labels(spark, sf_dir), corpus.plan(spark, sf_dir))


@query
def benchmark_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = scoring.missing_labels(corpus.benchmark_labels(spark, sf_dir), corpus.plan(spark, sf_dir))
    return missing.select("source_path")


@query
def undo_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    occupied = corpus.named_documents(spark, sf_dir).where(F.col("lang") == "en").select(F.col("source_path").alias("path"))
    events, runs = corpus.events(spark, sf_dir), corpus.history_runs(spark, sf_dir)
    plan = ledger.undo_plan(events, runs, occupied)
    return plan.select("event_id", "run_id", "document_id", "destination_path", "restore_path")


@query
def responses_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.current_files(spark, sf_dir).select("document_id")
    return decisions.attach_raw_answer(files, corpus.responses(spark, sf_dir), "classify")


# Aggregates


@query
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.stored_run(spark, sf_dir).metrics()
    return found.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query
def stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What went through the stages of a run, counted on the way."""
    return corpus.organized(spark, sf_dir).stage_metrics()


@query
def benchmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.benchmark_report(benchmark_cases(spark, sf_dir))


@query
def benchmark_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = corpus.benchmark_labels(spark, sf_dir)
    plans = corpus.configured_plans(spark, sf_dir)
    return scoring.compare_reports({name: scoring.benchmark_cases(labels, plan) for name, plan in plans.items()})


@query
def stats_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movements.by_category(corpus.movements(spark, sf_dir))


@query
def stats_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = movements.overall(corpus.movements(spark, sf_dir))
    rounded = ("cache_hit_rate", "avg_processing_time", "seconds_per_file")
    return found.withColumns({name: F.round(name, 6) for name in rounded})


@query
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movements.category_counts(corpus.movements(spark, sf_dir))


@query
def category_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters after five lots of movements, one of them delivered twice and another partly taken back."""
    rows = corpus.movements(spark, sf_dir)
    counters = Counters(fresh_path(spark, "counters"), ("category",))
    left = ~((F.col("id") % 5 == 4) & (F.floor(F.col("id") / 5) % 2 == 0))
    for lot, kept in ((0, None), (1, None), (2, None), (3, None), (4, None), (2, None), (4, left)):
        run = spark.range(1).select(F.lit(f"lot-{lot}").alias("run_id"))
        part = rows.where(F.col("id") % 5 == lot)
        counters.record(moved_rows(part if kept is None else part.where(kept), f"lot-{lot}"), run)
    return counters.current(spark).select(F.col("category").alias("category_name"), F.col("files").alias("file_count"), F.col("first_at").alias("created_date"))


@query
def folder_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders in use after several runs and the undo of two of them."""
    events = corpus.several_runs(spark, sf_dir)
    counters = Counters(fresh_path(spark, "counters"))
    record_events(counters, events.where(F.col("status") != ledger.UNDONE), SETTINGS)
    record_events(counters, events.where(F.col("run_id").isin("run-3", "run-4")), SETTINGS)
    return counters.current(spark).drop("contents")


@query
def taxonomy_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taxonomy from the states of the runs instead of the ledger."""
    counters = Counters(fresh_path(spark, "counters"))
    record_events(counters, corpus.events(spark, sf_dir), SETTINGS)
    return current_taxonomy(counters, spark, SETTINGS)


@query
def file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = movements.file_history(corpus.movements(spark, sf_dir))
    return newest.select("id", "original_path", "new_path", "category", "processed_date", "cached")


@query
def keywords_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.top_keywords("text", SETTINGS.stop_words)
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", found).alias("keywords"))


@query
def taxonomy_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.taxonomy_index(taxonomy_scan(spark, sf_dir)).withColumn("category_l2", joined("category_l2"))


@query
def extraction_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.extraction_success(extraction_candidates(spark, sf_dir), corpus.precomputed(spark, sf_dir))


@query
def new_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.new_categories(corpus.plan(spark, sf_dir), taxonomy_scan(spark, sf_dir), SETTINGS)


# Ranks and limits


def destination_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = rule_verdict("rule", SETTINGS.rules)
    rows = corpus.identified(spark, sf_dir).withColumn("rule", rule_for_name("filename", SETTINGS.rules))
    folder = F.coalesce(F.concat_ws("/", verdict["category_l1"], verdict["category_l2"]), F.lit("_NeedsReview"))
    folder = F.when(F.col("rule").isNull(), "_NeedsReview").otherwise(folder)
    return rows.select("document_id", "source_path", "filename", folder.alias("folder"))


@query
def unique_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for all documents in the folders their names ask for, beside what is filed there."""
    requests = materialize(destination_requests(spark, sf_dir))
    named = routing.unique_names(requests, corpus.events(spark, sf_dir), SETTINGS)
    path = routing.destination_path(F.col("folder"), F.col("unique_name"), SETTINGS)
    return named.select("document_id", path.alias("destination_path"))


@query
def unique_destinations_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same names for three lots of documents in path order, from intervals kept after each; of the second lot a part is undone and named again."""
    wanted = materialize(destination_requests(spark, sf_dir))
    kept = Names(fresh_path(spark, "names"), buckets=16)
    kept.record(corpus.events(spark, sf_dir), SETTINGS)
    lot = F.when(F.col("source_path") < "/inbox/3", 0).when(F.col("source_path") < "/inbox/6", 1).otherwise(2)
    made = []
    for number, again in ((0, False), (1, True), (1, False), (2, False)):
        named = routing.unique_names(materialize(wanted.where(lot == number)), kept, SETTINGS)
        path = routing.destination_path(F.col("folder"), F.col("unique_name"), SETTINGS)
        named = materialize(named.select("document_id", path.alias("destination_path")))
        events = named.withColumns({"run_id": F.lit(f"lot-{number}"), "dry_run": F.lit(False), "status": F.lit("moved")})
        gone = events.withColumns({"destination_path": F.lit(None).cast("string"), "status": F.lit(ledger.UNDONE)})
        kept.record(events.unionByName(gone) if again else events, SETTINGS)
        made += [] if again else [named]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ledger.current_runs(corpus.run_records(spark, sf_dir))
    return ledger.latest_run(runs).select("run_id", "started_at")


@query
def run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.run_documents(corpus.events(spark, sf_dir), corpus.HISTORY.run_id)
    return found.select("event_id", "document_id", "source_path", "destination_path")


# Functions


@query
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.all_files(spark, sf_dir).select("document_id", "file_hash", "file_size")


@query
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.table(spark, sf_dir, "documents")
    return rows.select("doc_id", text.quality_score("text").alias("extraction_quality"))


@query
def smart_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.table(spark, sf_dir, "documents")
    return rows.select("doc_id", text.preview(F.col("text"), 501).alias("preview"))


@query
def legacy_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.col("text")
    return corpus.table(spark, sf_dir, "documents").select(
        "doc_id",
        text.preview_head_tail(whole).alias("head_tail"),
        text.preview_head_tail_collapsed(whole).alias("collapsed"),
        text.preview_two_thirds(whole, 1000).alias("two_thirds"),
    )


@query
def sanitize_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "pages").select(
        "page_id",
        paths.sanitize_component(F.col("url"), "General").alias("from_url"),
        paths.sanitize_category(F.col("html")).alias("from_html"),
    )


@query
def sanitize_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "pages").select(
        "page_id",
        paths.sanitize_filename(F.col("url"), F.lit(".html")).alias("from_url"),
        paths.sanitize_filename(F.col("html"), F.lit(".Html")).alias("from_html"),
    )


@query
def rule_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = SETTINGS.rules
    rows = corpus.identified(spark, sf_dir).withColumns(
        {"name_rule": rule_for_name("filename", rules), "text_rule": rule_for_text("text", rules)}
    )
    verdict = F.col("verdict")
    names = ("category_l1", "category_l2", "confidence", "reason")
    return rows.withColumn("verdict", rule_verdict("least(name_rule, text_rule)", rules)).select(
        "doc_id", *[verdict[name].alias(name) for name in names]
    )


def word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each long word at the head of a document; every eighth only where the word ends."""
    words = F.regexp_extract_all(F.lower(F.left("text", F.lit(1000))), F.lit("[a-z]{7,}"), F.lit(0))
    rows = corpus.table(spark, sf_dir, "documents").select(F.explode(words).alias("word")).distinct()
    digest = F.md5("word")
    bounded = F.left(digest, F.lit(1)).isin("0", "1")
    return rows.select(
        F.conv(F.left(digest, F.lit(15)), 16, 10).cast("bigint").alias("precedence"),
        F.when(bounded, F.concat("word", F.lit(r"\b"))).otherwise(F.col("word")).alias("pattern"),
        F.concat(F.lit("L"), F.substring(digest, 2, 1)).alias("category_l1"),
        F.concat(F.lit("M"), F.substring(digest, 3, 2)).alias("category_l2"),
        (F.length("word") / 100).alias("confidence"),
        F.concat(F.lit("Matched "), "word").alias("reason"),
    )


@query
def rule_table_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against thousands of rules at once."""
    rows = corpus.identified(spark, sf_dir)
    found = rule_table.classify(rows, materialize(word_rules(spark, sf_dir)), "doc_id")
    return found.select(F.col("id").alias("doc_id"), "category_l1", "category_l2", "confidence", "reason")


@query
def understand_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = contents.text_facts("text", SETTINGS).alias("facts")
    rows = corpus.table(spark, sf_dir, "documents").select("doc_id", facts)
    reading = rows.select("doc_id", decisions.understanding_fallback().alias("r")).select("doc_id", "r.*")
    return reading.withColumns({n: joined(n) for n in ("keywords", "content_signals")})


@query
def classify_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a summary from their text and the language as their type."""
    reading = F.struct(
        text.summary("text").alias("summary"), F.when(F.col("lang") != "de", F.col("lang")).alias("document_type")
    )
    rows = corpus.table(spark, sf_dir, "documents").select("doc_id", reading.alias("reading"))
    verdict = decisions.classification_fallback("reading", SETTINGS)
    return rows.select("doc_id", verdict.alias("v")).select("doc_id", "v.*")


def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.responses(spark, sf_dir)
    return rows.select("document_id", "stage", parse_answer("raw").alias("payload"))


@query
def parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found in each answer, and the single-level category it holds."""
    rows = with_fields(parsed_answers(spark, sf_dir), ("category",))
    kind = "CASE WHEN payload_type LIKE 'OBJECT%' THEN 'object' WHEN payload_type LIKE 'ARRAY%' THEN 'array' END"
    category = F.when(answered_text("category").isNotNull(), paths.sanitize_category(answered_text("category")))
    return rows.select("document_id", "stage", F.expr(kind).alias("kind"), category.alias("category"))


@query
def typed_understanding_(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed_answers(spark, sf_dir).where(F.col("stage") == "understand")
    typed = typed_understanding(rows).select("document_id", "understood.*")
    return typed.withColumns({n: joined(n) for n in ("keywords", "content_signals")})


@query
def typed_classification_(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed_answers(spark, sf_dir).where(F.col("stage") == "classify")
    return typed_classification(rows).select("document_id", "classified.*")


def all_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.identified(spark, sf_dir).withColumnRenamed("text", "extracted_text")
    rows = rows.withColumn("facts", contents.text_facts("extracted_text", SETTINGS))
    return build_prompts(rows, taxonomy.taxonomy_use(corpus.events(spark, sf_dir), SETTINGS), SETTINGS)


@query
def build_prompts_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_prompts(spark, sf_dir)


@query
def taxonomy_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taxonomy of the first words of documents, as prompts name it: the most used of far more folders."""
    words = F.regexp_extract_all(F.lower(F.left("text", F.lit(200))), F.lit("[a-z]{2,}"), F.lit(0))
    rows = corpus.table(spark, sf_dir, "documents").select(F.get(words, 0).alias("category_l1"), F.get(words, 1).alias("category_l2"))
    used = rows.where(F.col("category_l2").isNotNull()).groupBy("category_l1", "category_l2").agg(F.count("*").alias("files"))
    return prompts.taxonomy_text(used, 5)


@query
def prompt_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    length, excerpt = prompts.prompt_audit(F.col("understand_prompt"))
    rows = all_prompts(spark, sf_dir)
    return rows.select("document_id", length.alias("prompt_chars"), excerpt.alias("excerpt"))


# Flows


@query
def organize_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = corpus.organized(spark, sf_dir).plan
    return plan.select(
        *("document_id", "run_id", "source_path", "filename", "file_hash", "status", "decision_source"),
        *("category_l1", "category_l2", "confidence", "needs_review", "reason", "destination_path", "cached"),
        *("summary", "language", "document_type", "ocr_used", "extraction_quality"),
        *("understanding_model", "classification_model", "prompt_version"),
        F.concat_ws("\n", "errors").alias("errors"),
    )


@query
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current inbox planned only, and the ledger rows that say so."""
    run = corpus.CURRENT._replace(dry_run=True)
    done = organize(corpus.current_files(spark, sf_dir), corpus.tables(spark, sf_dir), run, SETTINGS)
    return done.events().select("event_id", "document_id", "destination_path", "status", "dry_run", "error_message")


@query
def decision_cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run adds to the decision cache: contents it decided itself, copies left out."""
    made = corpus.organized(spark, sf_dir).new_decisions()
    return made.select("file_hash", "category_l1", "category_l2", "confidence", "reason", "needs_review", "summary", "cached_at")


@query
def benchmark_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run over the labelled files, scored."""
    labels, files = corpus.benchmark_labels(spark, sf_dir), corpus.current_files(spark, sf_dir)
    return benchmark(labels, files, corpus.tables(spark, sf_dir), corpus.CURRENT, SETTINGS).cases


@query
def warm_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, files = corpus.benchmark_labels(spark, sf_dir), corpus.all_files(spark, sf_dir)
    made = warm_extractions(labels, files, corpus.tables(spark, sf_dir), corpus.CURRENT, SETTINGS).rows
    return made.select("file_hash", "ocr_model", "extracted_text", "extraction_quality", "cached_at")


@query
def warm_cache_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with paths from the folder of the label set, every fifth of them for a file that is not there."""
    labels = corpus.benchmark_labels(spark, sf_dir)
    inner = F.regexp_replace("source_path", "^/inbox/", "")
    number = F.split(inner, "/")[0].cast("bigint")
    relative = labels.withColumn("source_path", F.concat(F.when(number % 5 == 0, "gone/").otherwise("./"), inner))
    files = corpus.all_files(spark, sf_dir)
    warmed = warm_extractions(relative, files, corpus.tables(spark, sf_dir), corpus.CURRENT, SETTINGS, "/inbox")
    return warmed.missing.select("source_path", "expected_category_l1", "expected_needs_review")


def category_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.decisions(spark, sf_dir).where(F.col("needs_review"))
    return rows.select("file_hash", F.col("category_l1").alias("category"), "cached_at")


@query
def legacy_organize(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = organize_single_level(
        corpus.current_files(spark, sf_dir),
        category_cache(spark, sf_dir),
        corpus.responses(spark, sf_dir),
        corpus.events(spark, sf_dir),
        SETTINGS,
        "rename",
    )
    return movements.movement_rows(plan).drop("processing_time_seconds")


@query
def rename_plan_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename_plan(
        corpus.all_files(spark, sf_dir),
        corpus.responses(spark, sf_dir),
        corpus.events(spark, sf_dir),
        SETTINGS,
        "rename",
        "/inbox/_Processed",
    )


def _echo(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in for a model, which answers with the length of the prompt."""
    for batch in batches:
        raw = [f'{{"summary": "{len(prompt)} characters"}}' for prompt in batch["prompt"]]
        yield batch[["document_id", "stage"]].assign(raw=raw)


@query
def model_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.identified(spark, sf_dir)
    prompt = prompts.understanding_prompt(F.col("filename"), F.col("source_path"), F.col("text"), SETTINGS)
    return with_model(rows.select("document_id", F.lit("understand").alias("stage"), prompt.alias("prompt")), _echo)


def _arrived(rows: DataFrame, run_id: str) -> DataFrame:
    path = F.concat(F.lit("/inbox/"), F.col("doc_id").cast("string"), F.lit("/"), "source", F.lit(".txt"))
    return files_from_texts(rows.withColumn("source_path", path), run_id)


@query
def streaming_organize(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = corpus.table(spark, sf_dir, "documents").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents*.parquet")
    path = fresh_path(spark, "stream")
    started = organize_stream(
        arriving, f"{path}/ledger", f"{path}/checkpoint", _arrived, SETTINGS, datetime(2024, 4, 1), "arrivals", f"{path}/runs"
    )
    started.awaitTermination()
    events = spark.read.parquet(f"{path}/ledger")
    return events.select("event_id", "run_id", "source_path", "destination_path", "status", "category_l1", "category_l2", "reason")


@query
def streaming_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in two lots in path order, the second by a stream that was started again; no batch reads the ledger."""
    documents = corpus.table(spark, sf_dir, "documents")
    path = fresh_path(spark, "stream")
    early = F.left(F.col("doc_id").cast("string"), F.lit(1)) < "4"
    for lot in (early, ~early):
        documents.where(lot).write.mode("append").parquet(f"{path}/arrived")
        arriving = spark.readStream.schema(documents.schema).parquet(f"{path}/arrived")
        started = organize_stream(
            arriving, f"{path}/ledger", f"{path}/checkpoint", _arrived, SETTINGS, datetime(2024, 4, 1), "arrivals",
            state=State(f"{path}/state", buckets=8),
        )
        started.awaitTermination()
    events = spark.read.parquet(f"{path}/ledger")
    return events.select("run_id", "source_path", "destination_path", "status", "category_l1", "category_l2")
