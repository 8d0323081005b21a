import bisect
import random
import re

import xxhash

from filewright.llm import order_minhash as omh
from helpers_llm import ODD_TEXTS, no_documents, odd_documents


def number_hash(value, seed, size=8):
    return xxhash.xxh64_intdigest((value & (256**size - 1)).to_bytes(size, "little"), seed=seed)


def brute_sketch(text):
    pieces = re.findall(omh.PIECE, text or "")
    grams = []
    for at in range(max(len(pieces) - omh.GRAM + 1, min(len(pieces), 1))):
        hashed = 42
        for piece in pieces[at : at + omh.GRAM]:
            hashed = xxhash.xxh64_intdigest(piece.encode(), seed=hashed)
        grams.append((hashed & omh.HASH) >> omh.PLACE_BITS)
    seen, numbered = {}, []
    for place, gram in enumerate(grams, 1):
        count = seen[gram] = seen.get(gram, -1) + 1
        order = number_hash(count, number_hash(gram, 42), 4) & omh.HASH if count else gram << omh.PLACE_BITS
        numbered.append(order | place)
    numbered.sort()
    made = []
    for turn in range(omh.SIGNATURES):
        first = bisect.bisect_left(numbered, turn * ((1 << 63) // omh.SIGNATURES) & omh.HASH)
        picked = [numbered[(first + k) % len(numbered)] for k in range(omh.TUPLE)] if numbered else []
        hashed = 42
        for place in sorted(value & omh.PLACE for value in picked):
            hashed = number_hash(grams[place - 1], hashed)
        made.append(hashed >> 32)
    return made


def check(spark, docs, rows):
    got = sorted((tuple(row) for row in omh.edited(docs).drop("sketch", "edited_sketch", "next_sketch").collect()), key=str)
    texts = spark.createDataFrame(sorted({(row[1],) for row in got} | {(row[2],) for row in got}), "text string")
    sketches = {row.text: row.sketch for row in omh.with_sketch(texts, "text", "sketch").collect()}
    assert all(list(sketches[text]) == brute_sketch(text) for text in sketches)
    order = sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0))
    expected = []
    for at, (number, text) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        half = len(text) // 2
        expected.append((number, text, text[: len(text) - half] + after[:half]))
    return got, sorted(expected, key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "bb", "ccc", "longer-than-thirty-two-characters-for-sure", "日本語", "\U0001f600"]
    rows = [(k, rng.choice((" ", "\n", " \t")).join(rng.choices(words, k=rng.choice((0, 1, 2, 3, 30, 400))))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "x" * 1000), (103, "same " * 500), (None, "zz zz zz zz")]
    got, expected = check(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert got == expected


def test_odd_rows_and_empty_table(spark):
    rows = [row for row in ODD_TEXTS if row[0] not in (None, 9)]
    got, expected = check(spark, odd_documents(spark, rows), rows)
    assert got == expected
    # Repeated rows follow each other, rows of one id are in a fixed order.
    found = omh.digest(omh.edited(odd_documents(spark))).collect()
    assert len(found) == len(ODD_TEXTS)
    same = sorted((row.near_next, row.fingerprint) for row in found if row.id == 9)
    assert same[1][0] == 1.0 and same[0][1] == same[1][1]
    assert {row.near_edited for row in found if row.n_chars == 0} == {1.0}
    assert omh.edited(no_documents(spark)).collect() == []
    single = omh.digest(omh.edited(odd_documents(spark, [(1, "one two three four")]))).collect()
    assert [(row.id, row.near_next) for row in single] == [(1, 1.0)]


def test_order_and_occurrences_count(spark):
    words = [f"w{k}" for k in range(400)]
    shuffled = random.Random(1).sample(words, len(words))
    texts = [(1, " ".join(words)), (2, " ".join(words[:-40])), (3, " ".join(shuffled)), (4, " ".join(words * 2))]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    found = {row.id: set(enumerate(row.sketch)) for row in omh.fingerprints(table).collect()}
    shared = {k: len(found[1] & found[k]) / omh.SIGNATURES for k in found}
    assert shared[1] == 1.0 and shared[2] > 0.6 and shared[3] < 0.1 and 0 < shared[4] < 0.6


def test_next_over_many_partitions(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS id", "CAST(id AS string) AS text")
    found = {row.id: row.next_id for row in omh.with_next(rows, ["id"], ["id"]).collect()}
    assert found == {k: (k + 1) % 1000 for k in range(1000)}
