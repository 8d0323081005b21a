import hashlib
import random
from collections import defaultdict

from filewright.llm import sharding
from helpers_llm import ODD_TEXTS, no_documents, odd_documents


def brute(rows, limit):
    keyed = [(n, len((t or "").encode()), int(hashlib.md5(str("" if n is None else n).encode()).hexdigest()[:15], 16)) for n, t in rows]
    made = []
    for number, size, key in keyed:
        for depth in range(61):
            same = [s for _, s, k in keyed if k >> (60 - depth) == key >> (60 - depth)]
            if sum(same) <= limit or len(same) == 1:
                made.append((number, size, depth, f"{depth}-{key >> (60 - depth)}", sum(same), len(same)))
                break
    return sorted(made)


def run(docs, limit):
    return sorted((tuple(r) for r in sharding.shards(docs, limit=limit).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, "é" * rng.randint(0, 120)) for k in range(300)] + [(1000, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (100_000, 2000, 150):
        assert sorted(run(docs, limit)) == brute(rows, limit)


def test_rows_that_share_an_id_are_split_further(spark):
    rows = [(7, f"text {k} " + "x" * 90) for k in range(40)] + [(7, "same" * 20)] * 30 + [(8, "y")]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"), 300)
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, size, depth, shard, total, count in got:
        sizes[shard] += size
        assert total <= 300 or count == 1
    assert all(sizes[shard] == total for _, _, _, shard, total, _ in got)


def test_odd_rows(spark):
    got = run(odd_documents(spark), 1 << 20)
    assert len(got) == len(ODD_TEXTS)
    assert {r[3] for r in got} == {"0-0"}
    split = run(odd_documents(spark), 60)
    assert sorted(r[1] for r in split) == sorted(len((t or "").encode()) for _, t in ODD_TEXTS)
    assert all(r[4] <= 60 or r[5] == 1 for r in split)
    assert run(no_documents(spark), 10) == []
