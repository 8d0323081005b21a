from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from filewright import schemas
from filewright.operators import scoring
from filewright.operators.ledger import current_runs
from filewright.operators.state import State
from filewright.plans import organize as organize_module
from filewright.plans.benchmark import benchmark
from filewright.plans.organize import Tables, organize
from filewright.plans.output import write_organized
from filewright.plans.single_level import rename_plan
from filewright.plans.warmup import new_extractions
from filewright.settings import Run, Settings
from filewright.sources.inbox import files_from_texts
from filewright.streaming.incremental import batch_run, organize_batch
from filewright.workload import corpus
from filewright.workload.registered import QUERIES

RUN = Run("r1", datetime(2024, 5, 1))
SHOWN = ("document_id", "status", "category_l1", "category_l2", "reason", "destination_path", "confidence", "decision_source")


def shown(plan):
    return sorted(tuple(row) for row in plan.select(*SHOWN).collect())


def files_of(spark, *rows, run=RUN):
    frame = spark.createDataFrame([(f"/inbox/{name}", body) for name, body in rows], "source_path STRING, text STRING")
    return files_from_texts(frame, run.run_id)


def by_name(organized):
    return {row.filename: row for row in organized.plan.collect()}


def answers_of(spark, files, stage, raw):
    return files.select("document_id", F.lit(stage).alias("stage"), F.lit(raw).alias("raw"))


def test_ways_through_a_run(spark):
    files = files_of(
        spark,
        ("invoice.txt", "pay me"),
        ("note.txt", "hello there"),
        ("other.txt", "pay me"),
        ("page.html", ""),
        ("pic.xyz", "bits"),
    )
    done = organize(files, Tables.empty(spark), RUN, Settings())
    plan = by_name(done)
    assert plan["invoice.txt"].destination_path == "/organized/Finance/Invoices/invoice.txt"
    assert plan["note.txt"].reason == "Fallback heuristic classification | Below review threshold"
    assert plan["note.txt"].destination_path == "/organized/_NeedsReview/note.txt"
    assert plan["other.txt"].reason == "Duplicate of invoice.txt"
    assert plan["other.txt"].category_l2 == "Invoices"
    assert plan["page.html"].reason == "Extraction produced no usable text"
    assert plan["pic.xyz"].errors == ["Unsupported file type: .xyz"]
    metrics = done.metrics().first()
    assert (metrics.total_files, metrics.processed_files, metrics.review_files) == (5, 5, 3)
    records = done.run_record().unionByName(done.run_record(datetime(2024, 5, 2)))
    run = current_runs(records).first()
    assert (run.run_id, run.total_files, run.completed_at) == ("r1", 5, datetime(2024, 5, 2))
    events = done.events(first_id=10).orderBy("event_id").collect()
    assert [event.event_id for event in events] == [10, 11, 12, 13, 14]
    assert [row.filename for row in done.report().collect()] == sorted(plan)


def test_failed_documents_stay_and_do_not_lead_copies(spark):
    files = files_of(spark, ("a.txt", "same words"), ("b.txt", "same words"), ("c.txt", "same words"))
    bad = answers_of(spark, files.where(F.col("filename") == "a.txt"), "understand", "[1]")
    plan = by_name(organize(files, Tables.empty(spark, responses=bad), RUN, Settings()))
    assert (plan["a.txt"].status, plan["a.txt"].destination_path) == ("failed", None)
    assert plan["a.txt"].errors == ["Unusable understanding answer"]
    assert plan["b.txt"].category_l1 == "General"
    assert plan["c.txt"].reason == "Duplicate of b.txt"


def test_copies_add_nothing_to_the_decision_cache(spark):
    files = files_of(spark, ("invoice.txt", "pay me"), ("other.txt", "pay me"))
    made = organize(files, Tables.empty(spark), RUN, Settings()).new_decisions().collect()
    assert [(row.category_l1, row.category_l2) for row in made] == [("Finance", "Invoices")]


def test_names_of_undone_files_are_free_again(spark):
    first = organize(files_of(spark, ("invoice.txt", "one")), Tables.empty(spark), RUN, Settings())
    events = first.events()
    undone = events.withColumns({"status": F.lit("undone"), "destination_path": F.lit(None).cast("string")})
    later = Run("r2", datetime(2024, 6, 1))
    files = files_of(spark, ("invoice.txt", "two"), run=later)
    plan = by_name(organize(files, Tables.empty(spark, events=events.unionByName(undone)), later, Settings()))
    assert plan["invoice.txt"].destination_path == "/organized/Finance/Invoices/invoice.txt"


def test_the_last_answer_counts(spark):
    files = files_of(spark, ("x.txt", "words"))
    times = [(datetime(2024, 5, 2), "New"), (datetime(2024, 5, 1), "Zed")]
    rows = [
        (files.first().document_id, "classify", f'{{"category_l1": "{name}", "category_l2": "B", "confidence": 0.9}}', when)
        for when, name in times
    ]
    answers = spark.createDataFrame(rows, schemas.RESPONSES + ", answered_at TIMESTAMP")
    plan = by_name(organize(files, Tables.empty(spark, responses=answers), RUN, Settings()))
    assert plan["x.txt"].category_l1 == "New"


def test_runs_keep_apart_in_the_output_tree(spark, tmp_path):
    tree = str(tmp_path / "tree")
    for run_id, name in (("r1", "invoice.txt"), ("r2", "resume.txt"), ("r1", "invoice.txt")):
        run = RUN._replace(run_id=run_id)
        files = files_of(spark, (name, name), run=run)
        done = organize(files, Tables.empty(spark), run, Settings())
        write_organized(done.plan, files.select("document_id", "extracted_text"), tree, run, Settings())
    found = spark.read.parquet(tree).collect()
    assert sorted((row.run_id, row.folder_l1) for row in found) == [("r1", "Finance"), ("r2", "Career")]


def test_originals_of_one_name_are_moved_apart(spark):
    frame = spark.createDataFrame([("/in/1/a.txt", "x"), ("/in/2/a.txt", "y")], "source_path STRING, text STRING")
    files = files_from_texts(frame, "r1")
    answers = answers_of(spark, files, "rename", '{"category": "C", "new_filename": "n.txt"}')
    plan = rename_plan(files, answers, Tables.empty(spark).events, Settings(), "rename", "/done")
    assert sorted(row.processed_path for row in plan.collect()) == ["/done/a.txt", "/done/a_1.txt"]


def test_dry_run_only_plans(spark):
    files = files_of(spark, ("cv x.txt", "x"), run=RUN)
    plan = organize(files, Tables.empty(spark), RUN._replace(dry_run=True), Settings()).plan
    assert [row.status for row in plan.collect()] == ["planned"]


def test_second_run_finds_the_first(spark):
    settings = Settings()
    first = organize(files_of(spark, ("resume.txt", "me")), Tables.empty(spark), RUN, settings)
    later = Run("r2", datetime(2024, 6, 1))
    files = files_of(spark, ("again.txt", "me"), ("resume.txt", "other text"), run=later)
    plan = by_name(organize(files, Tables.empty(spark, events=first.events()), later, settings))
    assert plan["again.txt"].reason == "Duplicate of resume.txt"
    assert plan["resume.txt"].destination_path == "/organized/Career/Resumes/resume_1.txt"


def test_cached_decisions_keep_their_folder(spark):
    settings = Settings()
    files = files_of(spark, ("resume.txt", "me"))
    first = organize(files, Tables.empty(spark), RUN, settings)
    tables = Tables.empty(spark, decisions=first.new_decisions())
    plan = by_name(organize(files, tables, RUN, settings))
    assert (plan["resume.txt"].cached, plan["resume.txt"].decision_source) == (True, "cache")
    assert plan["resume.txt"].destination_path == "/organized/Career/Resumes/resume.txt"
    strict = by_name(organize(files, tables, RUN, replace(settings, strict_cache_routing=True)))
    assert strict["resume.txt"].destination_path == "/organized/_FailedExtraction/resume.txt"
    other = by_name(organize(files, tables, RUN, replace(settings, prompt_version="v4")))
    assert not other["resume.txt"].cached


def test_empty_cached_text_reaches_the_model(spark):
    files = files_of(spark, ("x.txt", "anything"))
    hashed = files.first().file_hash
    cache = spark.createDataFrame(
        [(hashed, "glm-ocr:q8_0", None, {}, 0.0, True, False, datetime(2024, 1, 1))], schemas.EXTRACTIONS
    )
    raw = '{"category_l1": "A", "category_l2": "B", "confidence": 0.9}'
    tables = Tables.empty(spark, extractions=cache, responses=answers_of(spark, files, "classify", raw))
    row = by_name(organize(files, tables, RUN, Settings()))["x.txt"]
    assert row.destination_path == "/organized/_FailedExtraction/x.txt"
    assert (row.decision_source, row.ocr_used, row.classification_model) == ("llm", True, "qwen3.5:4b")


def test_new_extractions(spark):
    files = files_of(spark, ("a.txt", "one"), ("b.txt", "one"), ("c.pdf", "two"), ("d.txt", "three"))
    ready = spark.createDataFrame([("/inbox/c.pdf", "read by a batch")], schemas.PRECOMPUTED)
    unread = files_of(spark, ("e.pdf", "no text here"))
    first = new_extractions(files.unionByName(unread), Tables.empty(spark).extractions, RUN, Settings(), ready)
    assert sorted(row.extracted_text for row in first.collect()) == ["one", "read by a batch", "three"]
    assert new_extractions(files, first, RUN, Settings(), ready).count() == 0


def test_benchmark(spark):
    files = files_of(spark, ("invoice.txt", "pay"), ("memo.txt", "hello"), ("extra.txt", "hey"))
    labels = spark.createDataFrame(
        [("/inbox/invoice.txt", "Finance", None, False), ("/inbox/memo.txt", "Work", None, None), ("/gone", None, None, None)],
        schemas.LABELS,
    )
    made = benchmark(labels, files, Tables.empty(spark), RUN, Settings())
    assert tuple(made.report.first()) == (3, 1, 2, 2, 1, 1)
    assert {row.status for row in made.cases.collect()} == {"planned", "missing"}


def test_files_without_hash_are_not_copies(spark):
    files = files_of(spark, ("a1.txt", "x"), ("a2.txt", "x")).withColumn("file_hash", F.lit(None).cast("string"))
    plan = by_name(organize(files, Tables.empty(spark), RUN, Settings()))
    assert {row.category_l1 for row in plan.values()} == {"General"}


@pytest.fixture(scope="module")
def plain_plan(spark, data):
    return shown(corpus.plan(spark, data))


def test_order_of_rows_does_not_matter(spark, data, plain_plan):
    files = corpus.current_files(spark, data).repartition(7, F.xxhash64("document_id", F.lit(3)))
    again = organize(files, corpus.tables(spark, data), corpus.CURRENT, corpus.SETTINGS)
    assert shown(again.plan) == plain_plan


def test_splitting_hot_keys_does_not_matter(spark, data, plain_plan):
    settings = replace(corpus.SETTINGS, hot_rows=3)
    again = organize(corpus.current_files(spark, data), corpus.tables(spark, data), corpus.CURRENT, settings)
    assert shown(again.plan) == plain_plan


def test_a_batch_can_be_delivered_twice(spark, tmp_path):
    ledger = str(tmp_path / "ledger")

    def to_files(rows, run_id):
        return files_from_texts(rows, run_id)

    first = spark.createDataFrame([("/in/a.txt", "one"), ("/in/b.txt", "two")], "source_path STRING, text STRING")
    second = spark.createDataFrame([("/in/c.txt", "one")], "source_path STRING, text STRING")
    runs = str(tmp_path / "runs")
    for rows, stream, batch in ((first, "a", 0), (second, "b", 0), (second, "b", 0)):
        organize_batch(rows, batch_run(stream, batch, RUN.started_at), ledger, to_files, Settings(), runs)
    events = spark.read.parquet(ledger).orderBy("event_id").collect()
    assert [(e.event_id, e.run_id, e.category_l1) for e in events] == [
        (1, "a-batch-0", "General"),
        (2, "a-batch-0", "General"),
        (3, "b-batch-0", "_Duplicates"),
    ]
    records = {row.run_id: row.total_files for row in current_runs(spark.read.parquet(runs)).collect()}
    assert records == {"a-batch-0": 2, "b-batch-0": 1}


def test_stages_are_counted_on_the_way(spark):
    files = files_of(spark, ("invoice.txt", "pay me"), ("other.txt", "pay me"), ("page.html", ""))
    done = organize(files, Tables.empty(spark), RUN, Settings())
    counted = {row.stage: tuple(row)[1:] for row in done.stage_metrics().collect()}
    assert counted == {"decided": (3, 0, 0, 2, 0), "planned": (3, 1, 0, 1, 0)}
    metrics = done.metrics().first()
    assert (metrics.total_files, metrics.review_files, metrics.failed_files) == (3, 1, 0)
    empty = organize(files.limit(0), Tables.empty(spark), RUN, Settings())
    assert [tuple(row)[1:] for row in empty.stage_metrics().collect()] == [(0,) * 5] * 2


def test_batches_with_a_state_equal_batches_with_the_ledger(spark, tmp_path):
    def to_files(rows, run_id):
        return files_from_texts(rows, run_id)

    lots = [
        [("/inbox/a/note.txt", "one"), ("/inbox/b/note.txt", "two"), ("/inbox/c/invoice.txt", "three")],
        [("/inbox/d/note.txt", "one"), ("/inbox/e/note.txt", "four"), ("/inbox/f/note_1.txt", "five")],
        [("/inbox/g/note.txt", "six"), ("/inbox/h/invoice.txt", "seven"), ("/inbox/i/x.txt", "two")],
    ]
    state = State(str(tmp_path / "state"), buckets=2)
    for number, lot in enumerate(lots):
        rows = spark.createDataFrame(lot, "source_path STRING, text STRING")
        run = batch_run("s", number, datetime(2024, 5, 1 + number))
        organize_batch(rows, run, str(tmp_path / "plain"), to_files, Settings())
        for _ in range(2 if number == 1 else 1):  # one batch is delivered twice
            organize_batch(rows, run, str(tmp_path / "kept"), to_files, Settings(), state=state, first_id=number * 1000 + 1)
    names = ("run_id", "source_path", "destination_path", "category_l1", "category_l2", "reason", "status")
    plain, kept = (sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / t)).select(*names).collect()) for t in ("plain", "kept"))
    assert kept == plain and len(kept) == 9
    assert sum("_Duplicates" in row[2] for row in kept) == 2
    ids = [row.event_id for row in spark.read.parquet(str(tmp_path / "kept")).collect()]
    assert len(set(ids)) == 9 and max(ids) == 2003


def test_configurations_that_gather_alike_read_texts_once(spark, data, monkeypatch):
    described = []
    plain = organize_module.describe
    monkeypatch.setattr(organize_module, "describe", lambda *given: described.append(given) or plain(*given))
    folder = f"{data}/."  # nothing is stored under this name yet
    got = {tuple(row) for row in QUERIES["benchmark_compare"](spark, folder).collect()}
    assert len(described) == 1
    tables, labels = corpus.tables(spark, folder), corpus.benchmark_labels(spark, folder)
    configs = {"default": corpus.SETTINGS, "strict": corpus.STRICT, "other": replace(corpus.STRICT, stop_words=("the",), parse_bool_strings=True)}
    each = organize_module.organize_each(corpus.current_files(spark, folder), tables, corpus.CURRENT, configs)
    assert len(described) == 3
    alone = {name: organize(corpus.current_files(spark, folder), tables, corpus.CURRENT, settings).plan for name, settings in configs.items()}
    for name, plan in alone.items():
        assert shown(each[name].plan) == shown(plan)
    cases = {name: scoring.benchmark_cases(labels, alone[name]) for name in ("default", "strict")}
    assert got == {tuple(row) for row in scoring.compare_reports(cases).collect()}
