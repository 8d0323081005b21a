import numpy as np
import pyarrow as pa
import pytest

from filewright.llm import crosspolytope


def brute(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(good))}
    for a, (_, x) in enumerate(good):
        for b, (_, y) in enumerate(good):
            if a != b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[a].add(b)
    made = []
    for a, (i, _) in enumerate(good):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        made.append((i, len(links[a]), min(good[b][0] for b in seen)))
    alone = [(i, 0, i) for i, v in rows if not (v and all(x is not None and np.isfinite(x) for x in v) and any(v))]
    return sorted(made + alone)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string, node string")
    return sorted(tuple(r) for r in crosspolytope.near_duplicates(docs).collect())


def test_recall_and_precision_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for group in range(60):
        base = rng.standard_normal(64)
        for _ in range(5):
            rows.append((len(rows), (base + rng.standard_normal(64) * 0.2).astype(np.float32).tolist(), group, "", ""))
    rows += [(len(rows) + k, rows[k][1], 0, "", "") for k in range(10)]
    rows += [(1000 + k, (np.array(rows[k][1]) * 3).astype(np.float32).tolist(), 0, "", "") for k in range(5)]
    wanted = brute([r[:2] for r in rows])
    got = run(spark, rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in wanted)
    assert there > 500
    assert 0.98 * there <= found <= there
    assert sum(a != b for a, b in zip(got, wanted)) <= 0.05 * len(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [2.0, 0.01, 0.0], None, [], [0.0, -0.0, 0.0], [nan, 1.0, 0.0], [inf, 1.0, 0.0], [None, 1.0, 0.0],
               [1.0, 0.0], [1.0], [-1.0], [0.0, 1.0, 0.0]]
    rows = [(k, v, k, "x", "y") for k, v in enumerate(vectors)]
    assert run(spark, rows) == brute([r[:2] for r in rows])
    assert run(spark, []) == []
    repeated = run(spark, [rows[0], rows[0], rows[12]])
    assert repeated == [(0, 1, 0), (0, 1, 0), (12, 0, 12)]


def test_rotations_keep_lengths_and_angles():
    rows = np.random.default_rng(2).standard_normal((20, 64))
    turned = crosspolytope.rotate(rows, (1, 2))
    assert np.allclose(turned @ turned.T, rows @ rows.T)
    assert (crosspolytope.axes(np.array([[0.1, -3.0, 2.0]]), 2) == [[3, 4]]).all()
    assert crosspolytope.sketch_bound(0.95) == pytest.approx(55, abs=3)


def keys_of(vectors):
    """(probe, key, number of the vector) of each row that vectors are hashed to."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(vectors)), pa.int64()), pa.array(vectors.tolist())], ["node", "vector"])
    made = crosspolytope._hashed(crosspolytope.TABLES, crosspolytope.HASHES, crosspolytope.PROBES)(iter([batch]))
    return [np.concatenate(columns) for columns in zip(*[[c.to_numpy(zero_copy_only=False) for c in part.columns[:3]] for part in made])]


def test_planted_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(12)
    for cosine in (0.95, 0.96, 0.97):
        left, right = (rng.standard_normal((1500, 64)) for _ in range(2))
        left /= np.linalg.norm(left, axis=1, keepdims=True)
        right -= (left * right).sum(axis=1, keepdims=True) * left
        right *= np.sqrt(1 - cosine**2) / np.linalg.norm(right, axis=1, keepdims=True)
        (_, sought, a), (probe, filed, b) = keys_of(left), keys_of(cosine * left + right)
        buckets = {(int(key), int(node)) for key, node, is_probe in zip(filed, b, probe) if not is_probe}
        met = {int(node) for key, node in zip(sought, a) if (int(key), int(node)) in buckets}
        assert len(met) >= 0.98 * len(left)  # in one direction; the join goes both ways


def test_unlike_vectors_seldom_meet():
    rng = np.random.default_rng(13)
    each = []
    for count in (2000, 8000):
        probe, key, _ = keys_of(rng.standard_normal((count, 64)))
        filed, found = np.unique(key[~probe], return_counts=True)
        at = np.minimum(np.searchsorted(filed, key), len(filed) - 1)
        met = np.where(filed[at] == key, found[at], 0).sum() - crosspolytope.TABLES * count  # not itself
        each.append(met / count)
    # Candidates a vector grow with the table, by a few hundredths for a thousand vectors.
    assert each[0] < 0.3 and each[1] < 1.2
