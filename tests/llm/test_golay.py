import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash

from filewright.llm import golay, store
from filewright.llm.components import components
from filewright.llm.store import stage
from helpers_llm import ODD_TEXTS, no_documents, odd_documents, words_of


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(run.encode(), 42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_every_word_is_within_three_bits_of_its_codeword():
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    near = golay.codewords(words)
    encode = {int(golay.codewords(np.array([w]))[0, 0]): None for w in words[:5]}
    assert all(0 <= code < 1 << 12 for code in encode)
    for flip in range(23):  # the nearest codeword of a word is among those of every neighbour
        around = golay.codewords(words ^ (1 << flip))
        assert (around == near[:, :1]).any(axis=1).all()


def test_links_are_all_pairs_within_three_bits(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    values = set(seeds)
    for seed in seeds:
        for bits in (1, 2, 3, 4):
            values.add(seed ^ sum(1 << b for b in rng.sample(range(64), bits)))
    values = sorted(v - (1 << 64 if v >> 63 else 0) for v in values)
    got = {tuple(r) for r in golay.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in values for b in values if a > b and ((a ^ b) & mask).bit_count() <= 3}


def test_components_of_chains_stars_and_rings(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(7, k) for k in range(200, 260)]
    ring = [(300, 301), (301, 302), (302, 300), (302, 302)]
    got = dict(map(tuple, components(spark.createDataFrame(chain + star + ring, "a long, b long")).collect()))
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 7 for k in [7, *range(200, 260)]}, 300: 300, 301: 300, 302: 300}


def test_odd_rows(spark):
    got = golay.near_duplicates(odd_documents(spark)).collect()
    assert len(got) == len(ODD_TEXTS)
    by_id = {}
    for row in got:
        by_id.setdefault(row["id"], []).append(row)
    mask = (1 << 64) - 1
    for number, text in ODD_TEXTS:
        assert brute_fingerprint(text) in {row["fp"] & mask for row in by_id[number]}
    assert by_id[2][0]["component"] == 1
    assert by_id[3][0]["component"] == by_id[4][0]["component"] == by_id[5][0]["component"] == 3
    assert [row["component"] for row in by_id[9]] == [9, 9]
    assert golay.near_duplicates(no_documents(spark)).count() == 0


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(30):
        words = words_of(rng, 60)
        texts.append(" ".join(words))
        for _ in range(3):
            words[rng.randrange(60)] = "z"
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    got = {r["id"]: r["component"] for r in golay.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    assert got == brute_components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)


def test_one_of_each_keeps_the_least_id_of_copies_and_near_copies(spark):
    rng = random.Random(8)
    base = words_of(rng, 300)
    near = [*base[:150], "changed", *base[151:]]
    far = [w if k % 9 else "other" for k, w in enumerate(base)]
    rows = [(5, " ".join(base)), (2, " ".join(near)), (9, " ".join(base)), (1, " ".join(far)), (7, "short"), (7, "short"), (8, " "), (6, ""), (None, "alone")]
    docs = odd_documents(spark, rows)
    got = golay.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in got.collect()) == sorted(
        [(2, " ".join(near)), (1, " ".join(far)), (7, "short"), (6, ""), (0, "alone")]
    )
    assert golay.one_of_each(no_documents(spark)).count() == 0


def test_near_copies_are_found_down_to_the_bound(spark):
    rng = random.Random(13)

    def jaccard(one, other):
        one, other = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (one, other))
        return len(one & other) / len(one | other)

    rows, wanted = [], {}
    for number in range(400):
        base = words_of(rng, rng.randint(40, 250))
        copy = base
        low = rng.uniform(0.8, 0.95)
        while True:
            changed = list(copy)
            changed[rng.randrange(len(base))] = f"z{rng.random()}"
            if jaccard(base, changed) < low:
                break
            copy = changed
        rows += [(2 * number, " ".join(base)), (2 * number + 1, " ".join(copy))]
        if copy != base:
            wanted[2 * number + 1] = jaccard(base, copy)
    assert len(wanted) > 300 and sum(j < 0.87 for j in wanted.values()) > 100
    kept = {r["doc_id"] for r in golay.one_of_each(odd_documents(spark, rows)).collect()}
    assert {2 * number for number in range(400)} <= kept
    for low, high in ((0.8, 0.87), (0.87, 1)):
        near = [i for i, j in wanted.items() if low <= j < high]
        assert sum(i not in kept for i in near) >= 0.98 * len(near)


def test_a_group_of_near_copies_makes_pairs_in_proportion_to_its_size(spark, monkeypatch):
    rng = random.Random(31)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for number in range(400):
        words = list(base)
        for edit in range(number % 12):
            words[rng.randrange(150)] = f"e{number}x{edit}"
        texts.append(words)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    wanted = brute_components(range(400), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    made = []

    def counted(rows, name):
        rows = stage(rows, name)
        if name.startswith("similar-"):
            made.append(rows.count())
        return rows

    monkeypatch.setattr(golay, "stage", counted)
    rows = [(number, " ".join(words)) for number, words in enumerate(texts)]
    kept = {r["doc_id"] for r in golay.one_of_each(odd_documents(spark, rows)).collect()}
    assert 100 < sum(root == 0 for root in wanted.values()) < 400
    assert kept == set(wanted.values())
    assert max(made) <= 5 * 400


def test_sketches_differ_in_no_more_bits_than_sets_in_hashes():
    rng = np.random.default_rng(11)
    for common, one, other in ((0, 0, 0), (0, 1, 0), (90, 10, 9), (60, 30, 35), (3000, 200, 100), (0, 5000, 5000)):
        hashes = rng.integers(0, 1 << 64, common + one + other, dtype=np.uint64)
        left, right = golay.odd_sketch(hashes[: common + one]), golay.odd_sketch(np.delete(hashes, slice(common, common + one)))
        assert len(left) == golay.SKETCH_BITS // 64
        differ = int(np.bitwise_count((left ^ right).view(np.uint64)).sum())
        assert differ <= one + other
        assert one + other > 100 or differ >= 0.85 * (one + other)


def test_near_texts_that_are_not_alike_make_few_rows(spark, monkeypatch):
    rng = random.Random(41)
    base = [f"w{k}" for k in range(150)]
    # Texts of one origin, each with several of a few edits: near by their fingerprints, seldom alike, and few shingles alone.
    texts = []
    for _ in range(400):
        words = list(base)
        for at in rng.sample(range(0, 150, 5), rng.randint(4, 9)):
            words[at] = f"e{at}x{rng.randrange(2)}"
        texts.append(words)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    wanted = brute_components(range(400), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    made, apart = [], golay._pairs_apart

    def counted(keys):
        found = apart(keys)
        made.append(found.count())
        return found

    monkeypatch.setattr(golay, "_pairs_apart", counted)
    rows = [(number, " ".join(words)) for number, words in enumerate(texts)]
    kept = {r["doc_id"] for r in golay.one_of_each(odd_documents(spark, rows)).collect()}
    assert 20 < len(set(wanted.values())) < 380
    assert kept == set(wanted.values())
    assert max(made) <= 5 * 400


def test_keys_shared_by_chance_are_left_out_and_no_pair_is_lost(spark):
    rng = random.Random(21)
    prints = [(rng.getrandbits(64) - (1 << 63), rng.getrandbits(64) - (1 << 63)) for _ in range(600)]
    # Unlike prints that share a key, near ones, and one large group of which some are near.
    low = (1 << 43) - 1
    prints += [((fp & low) | rng.getrandbits(20) << 43, rng.getrandbits(62)) for fp, _ in prints[:200]]
    prints += [(fp ^ 1 << rng.randrange(63), beside ^ 1 << rng.randrange(63)) for fp, beside in prints[200:300]]
    prints += [((prints[0][0] & low) | rng.getrandbits(20) << 43, prints[0][1] ^ rng.getrandbits(rng.choice([4, 60]))) for _ in range(40)]
    frame = spark.createDataFrame(sorted(set(prints)), "fp long, beside long")
    every = {}
    for row in frame.mapInArrow(golay._similar_keys, "key int, fp bigint, beside bigint").collect():
        every.setdefault(row.key, []).append((row.fp, row.beside))

    def pairs(keys):
        return {
            (min(a, b), max(a, b))
            for held in keys.values()
            for a in held
            for b in held
            if a != b and sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b)) <= golay.SIMILAR_BITS_OF_TWO
        }

    kept, least = {}, set()
    for row in golay._shared_keys(frame).collect():
        kept.setdefault(row.key, []).append((row.fp, row.beside))
        least.add((row.least, row.least2) == min(every[row.key]))
    assert pairs(kept) == pairs(every) and len(pairs(every)) > 100 and least == {True}
    assert any(len(held) > golay.SMALL_KEY for held in every.values())
    shared = sum(len(held) for held in every.values() if len(held) > 1)
    assert sum(map(len, kept.values())) < shared - 1000


def test_keys_shared_by_chance_stay_few_as_prints_grow(spark):
    rng = random.Random(23)
    low = (1 << 43) - 1
    same = rng.getrandbits(43)
    # Thirty unlike prints that share the keys of two segments, and one that is near the first.
    prints = [(same | rng.getrandbits(20) << 43, *(rng.getrandbits(62) for _ in range(3)), 80, one) for one in range(30)]
    prints.append((prints[0][0] ^ 1 << 50, prints[0][1] ^ 1, *prints[0][2:5], 30))
    assert all(print_[0] & low == same for print_ in prints)
    frame = spark.createDataFrame(prints, "fp long, beside long, third long, fourth long, size long, one long")
    assert {row.one for row in golay._shared_keys(frame).collect()} == {0, 30}


def test_keys_pass_in_pieces_of_any_size():
    rng = random.Random(29)
    names = ["fp", "beside", "third", "fourth", "size", "one"]
    rows = []
    for key, count in enumerate([1, 3, 2, 39, 1, 40, 41, 5, 200, 1, 97]):
        centre = [rng.getrandbits(64) - (1 << 63) for _ in range(4)]
        for one in range(count):
            flips = [sum(1 << bit for bit in rng.sample(range(63), rng.choice([2, 4, 25]))) for _ in range(4)]
            rows.append((key, *(c ^ f for c, f in zip(centre, flips)), rng.choice([60, 64, 100]), 1000 * key + one))
    rows.sort()

    def near(a, b):
        bits = [((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a[1:5], b[1:5])]
        most = golay.SIMILAR_BITS if min(a[5], b[5]) < golay.LARGE_SET else golay.SIMILAR_BITS_OF_LARGE
        return sum(bits[:2]) <= golay.SIMILAR_BITS_OF_TWO and sum(bits) <= most and min(a[5], b[5]) >= 0.8 * max(a[5], b[5])

    wanted = {}
    for row in rows:
        held = [other for other in rows if other[0] == row[0]]
        if len(held) > golay.SMALL_KEY or any(near(row, other) for other in held if other != row):
            if len(held) > 1:
                wanted[row] = (held[0][1:], row != held[0] and near(row, held[0]))
    assert 200 < len(wanted) < len(rows)
    for step in (1, 7, 60, 1000):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows[at : at + step])], ["key", *names])
            for at in range(0, len(rows), step)
        ]
        got = [tuple(row.values()) for batch in golay._held(iter(batches)) for row in batch.to_pylist()]
        assert {row[:7]: (row[7:13], row[13]) for row in got} == wanted and len(got) == len(wanted)
        assert all(row[14] for row in got if row[13])
    assert list(golay._held(iter([]))) == []


def test_only_the_groups_stay_of_the_tables_of_near_copies(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "shared_folder", lambda _: str(tmp_path))
    rng = random.Random(37)
    base = words_of(rng, 60)
    rows = [(3, " ".join(base)), (1, " ".join([*base, "more"])), (2, "other")]
    got = golay.one_of_each(odd_documents(spark, rows))
    assert {r["doc_id"] for r in got.collect()} == {1, 2}
    assert [path.name.rsplit("-", 1)[0] for path in tmp_path.glob("llm/*")] == ["groups"]


def test_shuffles_of_a_stored_table_are_removed(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {str(file) for folder in folders for file in Path(folder).glob("*/shuffle_*.data")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    value, before = spark.conf.get(setting), files()
    made = stage(spark.range(0, 5000, 1, 4).repartition(3, "id").groupBy("id").count(), "shuffled")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(setting) == value
    assert made.count() == 5000
