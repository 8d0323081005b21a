import random
from collections import defaultdict

from filewright.operators.routing import unique_names
from filewright.operators.skew import attach, rank_within
from filewright.settings import Settings
from filewright.sources.tables import materialize


def test_attach_equals_a_plain_join(spark):
    rows = [(i, None if i % 5 == 0 else ("hot" if i % 3 else f"k{i % 7}")) for i in range(400)]
    left = spark.createDataFrame(rows, "id INT, key STRING")
    facts = spark.sql("SELECT 'hot' AS key, 250L AS n, 1 AS v UNION ALL SELECT 'k1', 10L, 2 UNION ALL SELECT 'k9', 1L, 3")
    for hot_rows in (3, 1000):
        got = attach(left, facts, ["key"], size="n", spread_by="id", hot_rows=hot_rows)
        assert got.count() == len(rows)
        values = {row.id: row.v for row in got.collect()}
        assert values == {i: {"hot": 1, "k1": 2}.get(key) for i, key in rows}


def test_rank_equals_sorting(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abc"), f"p{rng.randrange(10**9):09d}") for _ in range(3000)]
    frame = materialize(spark.createDataFrame(rows, "g STRING, p STRING"))
    expected = defaultdict(list)
    for group, path in rows:
        expected[group].append(path)
    expected = {(g, p): i for g, ps in expected.items() for i, p in enumerate(sorted(ps))}
    for hot_rows in (50, 700, 10_000):
        got = rank_within(frame, ["g"], "p", "rank", hot_rows).collect()
        assert {(row.g, row.p): row["rank"] for row in got} == expected
        assert len(got) == len(rows)


def names_one_by_one(wanted, existing):
    """Give names in path order, with every plainly wanted name kept for its own group."""
    taken = set(existing)
    plain = {(folder, name) for _, folder, name in wanted}
    given = {}
    for path, folder, name in sorted(wanted):
        stem, dot, ext = name.rpartition(".")
        stem, ext = (stem, dot + ext) if stem else (name, "")
        number, candidate = 0, name
        while (folder, candidate) in taken or (number > 0 and (folder, candidate) in plain):
            number += 1
            candidate = f"{stem}_{number}{ext}"
        taken.add((folder, candidate))
        given[path] = candidate
    return given


def names_in_spark(spark, wanted, existing, hot_rows):
    settings = Settings(hot_rows=hot_rows)
    requests = materialize(spark.createDataFrame(wanted, "source_path STRING, folder STRING, filename STRING"))
    placed = [(f"/organized/{folder}/{name}",) for folder, name in existing]
    events = spark.createDataFrame(placed, "destination_path STRING")
    got = unique_names(requests, events, settings).collect()
    assert len(got) == len(wanted)
    return {row.source_path: row.unique_name for row in got}


def test_names_by_hand(spark):
    wanted = [("/1", "F", "a.txt"), ("/2", "F", "a.txt"), ("/3", "F", "a_1.txt"), ("/4", "F", "b"), ("/5", "G", "a.txt"), ("/6", "F", "b")]
    existing = [("F", "b"), ("F", "b_2"), ("F", "b_01"), ("H", "a.txt")]
    got = names_in_spark(spark, wanted, existing, 1000)
    assert got == {"/1": "a.txt", "/2": "a_2.txt", "/3": "a_1.txt", "/4": "b_1", "/5": "a.txt", "/6": "b_3"}


def test_names_match_a_sequential_run(spark):
    rng = random.Random(11)
    names = ["a.txt", "a_1.txt", "a_2.txt", "a_3_1.txt", "a_3.txt", "b.md", "b_4.md", "c", "c_2"]
    weights = [12, 2, 1, 1, 1, 3, 1, 2, 1]
    picks = rng.choices(names, weights, k=160)
    wanted = [(f"/in/{i:04d}", rng.choice(["X", "X", "Y/Z"]), name) for i, name in enumerate(picks)]
    existing = [(f, f"{s}_{n}{e}") for f in ("X", "Y/Z") for s, e in (("a", ".txt"), ("c", "")) for n in rng.sample(range(1, 90), 35)]
    existing += [("X", "a.txt")]
    expected = names_one_by_one(wanted, existing)
    assert len({(folder, expected[path]) for path, folder, _ in wanted}) == len(wanted)
    for hot_rows in (5, 40, 100_000):
        assert names_in_spark(spark, wanted, existing, hot_rows) == expected
