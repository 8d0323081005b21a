from datetime import datetime

from filewright import schemas
from filewright.operators import contents, ledger, movements, scoring, taxonomy
from filewright.operators.metrics import metrics_of_run
from filewright.settings import Settings

DAY = datetime(2024, 1, 1)


def event(event_id, run_id, document_id, file_hash, destination="/organized/A/B/x", status="moved", dry_run=False, **more):
    row = dict.fromkeys(part.split()[0] for part in schemas.EVENTS.split(", "))
    row.update(
        event_id=event_id,
        run_id=run_id,
        document_id=document_id,
        source_path=f"/inbox/{document_id}.txt",
        destination_path=destination,
        filename=f"{document_id}.txt",
        status=status,
        category_l2="B",
        file_hash=file_hash,
        dry_run=dry_run,
        created_at=DAY,
    )
    row.update(more)
    return tuple(row.values())


def events_of(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.EVENTS)


def files_of(spark, *rows):
    return spark.createDataFrame(list(rows), "document_id STRING, source_path STRING, filename STRING, file_hash STRING")


def test_filed_contents(spark):
    events = events_of(
        spark,
        event(1, "r1", "a", "h1"),
        event(1, "r2", "b", "h1", category_l2=None, created_at=DAY.replace(day=2)),
        event(9, "r1", "z", "h1"),
        event(2, "r1", "c", "dry", dry_run=True),
        event(3, "r1", "d", "undone"),
        event(4, "r1", "d", "undone", destination=None, status="undone"),
        event(6, "r1", "e", None),
        event(7, "r1", "f", "failed", destination=None, status="failed"),
    )
    files = files_of(spark, *[(h or "none", f"/{h}", f"{h}", h) for h in ("h1", "dry", "undone", "failed", None)])
    found = contents.look_up(files, Settings(), events=events)
    hits = {row.document_id: row.filed for row in found.collect() if row.filed}
    assert list(hits) == ["h1"]
    assert (hits["h1"].filename, hits["h1"].category_l2) == ("b.txt", None)


def test_copies_in_a_run(spark):
    files = files_of(spark, *[(str(i), f"/{i}", str(i), "same") for i in range(3)], ("n1", "/n1", "n", None), ("n2", "/n2", "n", None))
    for hot_rows in (1, 1000):
        found = contents.look_up(files, Settings(hot_rows=hot_rows))
        later = {row.document_id for row in found.where(contents.is_later_copy()).collect()}
        assert later == {"1", "2"}
        assert found.count() == 5


def test_undo_passes_over_what_is_undone(spark):
    runs = spark.createDataFrame(
        [("r1", DAY, False), ("r2", DAY.replace(month=2), False), ("r3", DAY.replace(month=3), True)],
        "run_id STRING, started_at TIMESTAMP, dry_run BOOLEAN",
    )
    events = events_of(spark, event(1, "r1", "a", "h"), event(2, "r2", "b", "i"), event(3, "r3", "c", "j", dry_run=True))
    occupied = spark.createDataFrame([("/inbox/b.txt",)], "path STRING")
    plan = ledger.undo_plan(events, runs, occupied)
    assert [(row.document_id, row.restore_path) for row in plan.collect()] == [("b", "/inbox/b_restored.txt")]
    after = events.unionByName(ledger.undone_events(plan, DAY).select(events.columns))
    again = ledger.undo_plan(after, runs, occupied)
    assert [(row.document_id, row.restore_path) for row in again.collect()] == [("a", "/inbox/a.txt")]
    gone = spark.createDataFrame([], "path STRING")
    assert ledger.undo_plan(events, runs, occupied, present=gone).count() == 0
    assert ledger.latest_run(runs, include_dry_run=True).first().run_id == "r3"


def test_runs_show_their_last_record(spark):
    opened = ledger.opened(spark.createDataFrame([("a", DAY, False), ("b", DAY, False)], "run_id STRING, started_at TIMESTAMP, dry_run BOOLEAN"))
    closed = spark.createDataFrame([("a", 1, DAY, DAY, False, 3, 2, 1, 0, 0.5)], schemas.RUN_RECORDS)
    runs = {row.run_id: row for row in ledger.current_runs(opened.unionByName(closed)).collect()}
    assert (runs["a"].total_files, runs["a"].completed_at) == (3, DAY)
    assert (runs["b"].total_files, runs["b"].completed_at) == (0, None)


def cache_row(file_hash, when, **more):
    row = dict.fromkeys(part.split(" ")[0] for part in schemas.DECISIONS.split(", "))
    base = Settings()
    row.update(
        file_hash=file_hash,
        prompt_version=base.prompt_version,
        understanding_model=base.understanding_model,
        classification_model=base.classification_model,
        cached_at=DAY.replace(day=when),
    )
    row.update(more)
    return tuple(row.values())


def test_decision_cache_key_and_last_write(spark):
    cache = spark.createDataFrame(
        [
            cache_row("h", 1, category_l1="Old"),
            cache_row("h", 2, category_l1="New"),
            cache_row("p", 1, prompt_version="v2"),
            cache_row("m", 1, classification_model="other"),
        ],
        schemas.DECISIONS,
    )
    found = {row.file_hash: row.decision.category_l1 for row in contents.current_decisions(cache, Settings()).collect()}
    assert found == {"h": "New"}
    other = contents.current_decisions(cache, Settings(prompt_version="v2")).collect()
    assert [row.file_hash for row in other] == ["p"]
    assert contents.merged_decisions(cache).count() == 3


def test_aliases_and_alignment(spark):
    settings = Settings(aliases={"Bills": "Money"}, level1_aliases={"bills": "Never", "geld": "Finance"}, level2_aliases={"BILLS": "Never"})
    frame = spark.createDataFrame([("bills", "bills"), ("Geld", "x"), (None, ""), ("A/B", "c")], "a STRING, b STRING")
    level1, level2 = taxonomy.normalized_pair(frame.a, frame.b, settings)
    assert [tuple(row) for row in frame.select(level1, level2).collect()] == [
        ("Money", "Money"),
        ("Finance", "x"),
        ("General", "Unsorted"),
        ("AB", "c"),
    ]
    known = spark.createDataFrame([("Finance", "Bills"), ("finance", "x"), ("Work", None)], schemas.TAXONOMY)
    rows = spark.createDataFrame(
        [("1", "FINANCE", "bills"), ("2", "Other", "bills"), ("3", "work", "z"), ("4", None, "z")],
        "document_id STRING, category_l1 STRING, category_l2 STRING",
    )
    for hot_rows in (1, 1000):
        got = {r.document_id: (r.category_l1, r.category_l2) for r in taxonomy.align(rows, known, Settings(hot_rows=hot_rows)).collect()}
        assert got == {"1": ("Finance", "Bills"), "2": ("Other", "bills"), "3": ("Work", "z"), "4": (None, "z")}


def test_taxonomy_comes_from_committed_folders(spark):
    events = events_of(
        spark,
        event(1, "r", "a", "h", destination="/organized/Finance/Bills/a.txt"),
        event(2, "r", "b", "h", destination="/organized/_NeedsReview/b.txt"),
        event(3, "r", "c", "h", destination="/organized/_Ignored/X/c.txt"),
        event(4, "r", "d", "h", destination="/organized/Loose/d.txt"),
        event(5, "r", "e", "h", destination="/organized/Dry/Run/e.txt", dry_run=True),
    )
    found = taxonomy.scan_taxonomy(events, Settings())
    assert {tuple(row) for row in found.collect()} == {("Finance", "Bills"), ("Loose", None)}
    index = {row.category_l1: row.category_l2 for row in taxonomy.taxonomy_index(found).collect()}
    assert index == {"Finance": ["Bills"], "Loose": []}


def test_metrics_of_an_empty_run(spark):
    plan = spark.createDataFrame([], "run_id STRING, status STRING, needs_review BOOLEAN, confidence DOUBLE")
    row = metrics_of_run(plan, "r").first()
    assert (row.total_files, row.failed_files, row.avg_confidence) == (0, 0, 0.0)


def test_movement_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], schemas.MOVEMENTS)
    row = movements.overall(empty).first()
    assert (row.total_processed, row.cache_hit_rate, row.avg_processing_time, row.seconds_per_file) == (0, 0.0, None, 0.0)
    assert movements.file_history(empty, "x").count() == 0


# The recorded report: expected and actual level 1, level 2 and review flag of
# twelve cases. Fixed values.
RECORDED = [
    ("Personal", "Reference", True, "Art & Design", "Decorative Wall Hangings", False),
    ("Design", "Frameworks", False, "Design Thinking", "Design Research & Ideation", True),
    ("Business", "Playbooks", False, "Business Strategy", "Strategic Framework", True),
    ("Technology", "Artificial Intelligence", False, "Artificial Intelligence", "Small Language Models", True),
    ("Business", "Strategy", False, "Business Strategy", "Strategic Framework", False),
    ("Product Management", "Frameworks", False, "UX Research", "Feature Prioritization", False),
    ("Product Management", "Prompts", False, "Product Management", "AI Prompt Guidelines for Product Discovery", False),
    ("Technology", "Artificial Intelligence", False, "Artificial Intelligence", "Small Language Models", False),
    ("Technology", "Reports", False, None, None, None),
    ("Growth", "Models", False, "Text GenerationRepetition", "Instruction Following", False),
    ("Design", "UX", False, "UX Research", "Feature Prioritization", False),
    ("Technology", "Artificial Intelligence", False, "Business Strategy", "Strategic Framework", True),
]


def test_recorded_report(spark):
    labels = spark.createDataFrame([(f"/{i}", *row[:3]) for i, row in enumerate(RECORDED)], schemas.LABELS)
    made = [(f"/{i}", 1, *row[3:], "planned") for i, row in enumerate(RECORDED) if row[3]]
    shape = "source_path STRING, event_id INT, category_l1 STRING, category_l2 STRING, needs_review BOOLEAN, status STRING"
    results = spark.createDataFrame(made, shape)
    cases = scoring.benchmark_cases(labels, results)
    assert tuple(scoring.benchmark_report(cases).first()) == (12, 1, 0, 6, 0, 1)
    assert [row.source_path for row in scoring.missing_labels(labels, results).collect()] == ["/8"]


def test_wildcards_and_last_result(spark):
    labels = spark.createDataFrame([("/a", None, None, None), ("/b", "X", None, True)], schemas.LABELS)
    shape = "source_path STRING, event_id INT, category_l1 STRING, category_l2 STRING, needs_review BOOLEAN, status STRING"
    results = spark.createDataFrame([("/b", 1, "X", "Y", True, "moved"), ("/b", 2, "Z", "Y", True, "moved"), ("/a", 3, None, None, False, "failed")], shape)
    report = scoring.benchmark_report(scoring.benchmark_cases(labels, results)).first()
    assert tuple(report) == (2, 1, 2, 2, 1, 0)
