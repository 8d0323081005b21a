from pyspark.sql import functions as F

from filewright.operators.counters import Counters, current_taxonomy, filed_rows, moved_rows, record_events
from filewright.operators.movements import category_counts
from filewright.operators.taxonomy import scan_taxonomy
from filewright.workload import corpus
from filewright.workload.corpus import SETTINGS


def counted(rows):
    return {(row.category_l1, row.category_l2): (row.files, row.first_at, row.contents) for row in rows.collect()}


def recomputed(counters, events):
    rows = filed_rows(events, SETTINGS).withColumn("run_id", F.lit("all"))
    return counted(counters.state(rows).withColumn("contents", F.hll_sketch_estimate("contents")))


def test_counters_equal_a_recount_after_runs_undo_and_reruns(spark, data, tmp_path):
    events = corpus.several_runs(spark, data)
    moved = events.where("status <> 'undone'")
    counters = Counters(str(tmp_path / "state"))
    assert counted(counters.current(spark)) == {} and current_taxonomy(counters, spark, SETTINGS).count() == 0
    runs = sorted(row.run_id for row in moved.select("run_id").distinct().collect())
    assert len(runs) == 5
    seen = []
    for run in runs:
        record_events(counters, moved.where(F.col("run_id") == run), SETTINGS)
        seen.append(run)
        assert counted(counters.current(spark)) == recomputed(counters, moved.where(F.col("run_id").isin(*seen)))
    before = counted(counters.current(spark))
    record_events(counters, moved.where("run_id = 'run-2'"), SETTINGS)  # delivered again
    assert counted(counters.current(spark)) == before
    record_events(counters, events.where("run_id IN ('run-3', 'run-4')"), SETTINGS)  # half undone and all undone
    after = counted(counters.current(spark))
    assert after == recomputed(counters, events) != before
    assert sorted(current_taxonomy(counters, spark, SETTINGS).collect(), key=str) == sorted(scan_taxonomy(events, SETTINGS).collect(), key=str)
    record_events(counters, moved.where("run_id IN ('run-3', 'run-4')"), SETTINGS)  # filed once more
    assert counted(counters.current(spark)) == before


def test_states_merge_in_any_grouping(spark, tmp_path):
    counters = Counters(str(tmp_path / "state"), ("category",))
    rows = spark.range(60_000).selectExpr(
        "concat('run-', id % 7) AS run_id", "if(id % 11 = 0, NULL, concat('c', id % 3)) AS category",
        "timestamp_seconds(id) AS at", "md5(cast(id % 20000 AS string)) AS content",
    )
    states = counters.state(rows)
    whole = counters.merged(states)
    parts = [counters.merged(states.where(F.col("run_id").isin(*runs))) for runs in (("run-0",), ("run-1", "run-5"), ("run-2", "run-3", "run-4", "run-6"))]
    nested = counters.merged(parts[0].unionByName(parts[1])).unionByName(parts[2])
    shown = [sorted(t.withColumn("contents", F.hll_sketch_estimate("contents")).collect(), key=str) for t in (whole, counters.merged(nested))]
    assert shown[0] == shown[1] and len(shown[0]) == 4
    exact = {row.category: (row.n, row.d) for row in rows.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("content").alias("d")).collect()}
    for row in shown[0]:
        assert row.files == exact[row.category][0] and abs(row.contents - exact[row.category][1]) < 0.05 * exact[row.category][1]


def test_counters_of_the_single_level_history(spark, data, tmp_path):
    movements = corpus.movements(spark, data)
    counters = Counters(str(tmp_path / "state"), ("category",))
    for lot in range(3):
        run = f"lot-{lot}"
        counters.record(moved_rows(movements.where(F.col("id") % 3 == lot), run), spark.createDataFrame([(run,)], "run_id string"))
    got = {row.category: (row.files, row.first_at) for row in counters.current(spark).collect()}
    assert got == {row.category_name: (row.file_count, row.created_date) for row in category_counts(movements).collect()}
