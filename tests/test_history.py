import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from filewright import schemas
from filewright.operators.contents import filed_contents
from filewright.operators.history import History, filings, hash_bitmaps, latest_filings, shared_bits
from filewright.sources.bucketed import Bucketed


def ledger(spark, rows):
    """Events from (run, number, hash, status)."""
    made = []
    for run, number, digest, status in rows:
        placed = f"/organized/A/B/{run}-{number}.txt" if status == "moved" else None
        made.append(
            (number, run, f"{run}-d{number}", f"/in/{number}.txt", placed, f"{run}-{number}.txt", status, "A", f"B{number % 3}",
             0.9, "r", False, digest, None, None, None, False, False, run.startswith("dry"), None, datetime(2024, 1, int(run[-1]) + 1))
        )
    return spark.createDataFrame(made, schemas.EVENTS)


def digest(number):
    return hashlib.md5(str(number).encode()).hexdigest()


@pytest.fixture(scope="module")
def events(spark):
    rows = [(f"run-{run}", n, digest(n % 40 + 17 * run), "moved") for run in range(5) for n in range(100)]
    rows += [("run-1", n, digest(n % 40 + 17), "undone") for n in range(0, 100, 2)]
    rows += [("run-2", n, digest(n % 40 + 34), "undone") for n in range(100)]
    rows += [("dry-3", n, digest(n), "moved") for n in range(60)] + [("run-4", 200, None, "moved"), ("run-4", 201, digest(999), "failed")]
    return ledger(spark, rows)


def lookup(rows):
    return {row.file_hash: (row.filed.filename, row.filed.category_l2) for row in rows.collect()}


def test_lookup_equals_the_ledger(spark, events, tmp_path):
    history = History(str(tmp_path), buckets=4)
    for run in [row.run_id for row in events.select("run_id").distinct().orderBy("run_id").collect()]:
        history.record(events.where(F.col("run_id") == run))
    wanted = events.select("file_hash").where("file_hash IS NOT NULL").distinct()
    assert lookup(history.filed(wanted)) == lookup(filed_contents(events))
    some = wanted.where(F.col("file_hash").isin(*[digest(n) for n in (0, 3, 18, 95, 999)]))
    assert lookup(history.filed(some)) == lookup(filed_contents(events, some)) != {}
    assert lookup(latest_filings(filings(events))) == lookup(filed_contents(events))


def test_a_run_recorded_again_takes_the_place_of_itself(spark, events, tmp_path):
    history = History(str(tmp_path), buckets=4)
    moved = events.where("status <> 'undone'")
    history.record(moved)
    before = history.table.open(spark).count()
    history.record(moved.where("run_id = 'run-1'"))
    assert history.table.open(spark).count() == before
    assert lookup(history.filed(moved.select("file_hash").distinct())) == lookup(filed_contents(moved))
    # An undo: the run is recorded with its undone events, and what is left of it stays.
    history.record(events.where("run_id IN ('run-1', 'run-2')"))
    wanted = events.select("file_hash").where("file_hash IS NOT NULL").distinct()
    assert lookup(history.filed(wanted)) == lookup(filed_contents(events))
    assert "run-2" not in {row.run_id for row in history.table.open(spark).select("run_id").distinct().collect()}


def test_another_session_finds_the_table(spark, events, tmp_path):
    history = History(str(tmp_path), buckets=4)
    history.record(events)
    expected = lookup(filed_contents(events))
    spark.sql(f"DROP TABLE {history.table.name}")
    wanted = events.select("file_hash").where("file_hash IS NOT NULL").distinct()
    assert lookup(history.filed(wanted)) == expected
    history.record(events.where("run_id = 'run-0'"))
    assert lookup(history.filed(wanted)) == expected


def exchanges_above(plan, scan):
    """Exchanges on the way from a scan line up to the root of a plan."""
    lines = plan.splitlines()
    at = next(k for k, line in enumerate(lines) if scan in line)
    depth, found = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789")), 0
    for line in reversed(lines[:at]):
        indent = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if indent < depth:
            depth = indent
            found += "Exchange" in line
    return found


def test_history_is_not_shuffled(spark, events, tmp_path):
    history = History(str(tmp_path), buckets=4)
    history.record(events)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = events.where("run_id = 'run-0'").select("file_hash").distinct()
        filed = history.filed(wanted, ["run-0", "run-1", "run-3"])
        assert len(lookup(filed)) == 40
        plan = filed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        scan = next(line.strip() for line in plan.splitlines() if "FileScan parquet" in line and "Bucketed: true" in line)
        assert "SortMergeJoin" in plan and exchanges_above(plan, scan) == 0
        plain = latest_filings(spark.read.parquet(f"{tmp_path}/filings"), wanted)
        lookup(plain)
        plan = plain._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        scan = next(line.strip() for line in plan.splitlines() if "FileScan parquet" in line and "filings" in line)
        assert exchanges_above(plan, scan) > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_runs_without_a_wanted_hash_are_not_read(spark, events, tmp_path):
    history = History(str(tmp_path), buckets=4)
    history.record(events)
    wanted = spark.createDataFrame([(digest(5),), (digest(20),), ("ffffff" + "0" * 26,)], "file_hash string")
    rows = {row.run_id: (row.shared, row["read"]) for row in history.runs_to_read(wanted).collect()}
    nothing = (0, False)  # also of runs that are undone or dry
    assert rows == {"run-0": (2, True), "run-1": (1, True), "run-2": nothing, "run-3": nothing, "run-4": nothing, "dry-3": nothing}
    # Leaving the others out changes nothing.
    every = list(rows)
    assert lookup(history.filed(wanted)) == lookup(history.filed(wanted, every))
    assert lookup(history.filed(wanted.limit(0))) == {} and lookup(History(str(tmp_path / "new")).filed(wanted)) == {}


def test_bitmaps_against_sets(spark):
    rows = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("file_hash"), (F.col("id") % 3).cast("string").alias("run_id"))
    wanted = spark.range(4000, 9000).select(F.md5(F.col("id").cast("string")).alias("file_hash"))
    places = {}
    for row in rows.collect():
        places.setdefault(row.run_id, set()).add(int(row.file_hash[:6], 16))
    asked = {int(row.file_hash[:6], 16) for row in wanted.collect()}
    index = hash_bitmaps(rows, "run_id")
    assert {row.run_id: row.shared for row in shared_bits(index, wanted).collect()} == {run: len(own & asked) for run, own in places.items()}
    assert index.select(F.max(F.octet_length("bitmap"))).first()[0] == 4096


def test_table_name_depends_on_path_and_buckets():
    assert Bucketed("/a", "x INT", buckets=4).name != Bucketed("/a", "x INT", buckets=8).name
