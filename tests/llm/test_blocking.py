import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from filewright.llm import blocking
from helpers_llm import ODD_TEXTS, no_documents, odd_documents, words_of


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, limit=50):
    counts = [(number, Counter(terms(text))) for number, text in docs]
    counts = [(number, found) for number, found in counts if found]
    total, length = len(counts), sum(found.total() for _, found in counts)
    df = Counter(term for _, found in counts for term in found)
    made = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for number, found in counts:
            size = 50 + (50 * found.total() * total) // length
            score = 0
            for term in set(terms(text)) & set(found):
                weight = math.floor(1000 * math.log((2 * total + 2) / (2 * df[term] + 1)))
                score += weight * ((1_000_000_000 * found[term]) // (1000 * found[term] + 20 * size))
            if score > 0:
                scored.append((-score, number is not None, number or 0))
        for rank, (score, known, number) in enumerate(sorted(scored)[:limit], 1):
            made.append((item, rank, number if known else None, -score))
    return sorted(made, key=str)


def run(docs, items, limit=50):
    return sorted((tuple(row) for row in blocking.rank(docs, items, limit).collect()), key=str)


def corpus(rng, count):
    common = words_of(rng, 40)
    topics = [[f"t{topic}x{k}" for k in range(25)] for topic in range(12)]
    docs = []
    for number in range(count):
        found = rng.choices(common, k=rng.randint(0, 60)) + rng.choices(rng.choice(topics), k=rng.randint(0, 12))
        rng.shuffle(found)
        docs.append((number, rng.choice((" ", ", ")).join(w.upper() if rng.random() < 0.1 else w for w in found)))
    docs += [(count + k, docs[5][1]) for k in range(count // 3)]
    items = [(k, " ".join(rng.choices(common, k=12) + rng.choices(rng.choice(topics), k=5))) for k in range(25)]
    return docs, items


@pytest.mark.parametrize("limit", (50, 3))
def test_against_brute_force(spark, monkeypatch, limit):
    docs, items = corpus(random.Random(4), 900)
    items += [(100, "none-of-these-words-anywhere"), (101, None), (102, ""), (103, items[0][1]), (0, items[0][1]), (1, "t1x1 t2x2")]
    monkeypatch.setattr(blocking, "SEGMENT_ROWS", 100)
    tables = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert run(*tables, limit) == brute(docs, items, limit)
    monkeypatch.setattr(blocking, "QUERY_TERMS", 60)  # several blocks of queries
    assert run(*tables, limit) == brute(docs, items, limit)


def test_blocks_are_skipped_by_exact_bounds():
    rng = random.Random(9)
    docs, items = corpus(rng, 3000)
    vocabulary = sorted({term for _, text in items for term in terms(text)})
    numbers = {term.encode(): k for k, term in enumerate(vocabulary)}
    asked = blocking.Queries([k for k, _ in items], [np.array(sorted({numbers[t.encode()] for t in terms(text)})) for _, text in items], numbers)
    rows, columns, counts = [], [], []
    for at, (_, text) in enumerate(docs):
        for term, count in sorted(Counter(terms(text)).items()):
            if term.encode() in numbers:
                rows.append(at), columns.append(numbers[term.encode()]), counts.append(count)
    scores = np.array(counts) * 1000
    ids = np.array([number for number, _ in docs])
    segment = blocking.Segment(ids, scores, np.array(columns), np.array(rows), asked.signs(), asked.partners())
    for column in range(len(segment.terms)):
        members, first, place, summaries = segment.blocks(column)
        assert sorted(members) == sorted(np.flatnonzero(segment.cells[:, column]))
        for at, part in enumerate(np.split(members, first[1:])):
            assert 0 < len(part) <= 2 * blocking.BLOCK_ROWS
            assert (summaries[at] == segment.cells[part].max(0)[place >= 0]).all()
    for query in asked.terms:
        hits = blocking.Hits(10)
        segment.search(query, hits)
        own = segment.cells[:, segment.column[query[segment.column[query] >= 0]]].sum(1)
        # A second search with the bar of the first opens fewer blocks and changes nothing.
        segment.search(query, again := blocking.Hits(10))
        order = np.lexsort((ids, -own))[:10]
        assert (hits.ids == ids[order]).all() and (hits.scores == own[order]).all() and (again.ids == hits.ids).all()
        before = segment.opened
        bar = blocking.Hits(10)
        bar.scores, bar.ids = hits.scores + 1, hits.ids
        segment.search(query, bar)
        assert segment.opened - before < len(segment.terms) * 10
    assert segment.skipped > 0


def test_odd_rows_and_empty_tables(spark):
    items = [(1, "the quick fox"), (1, "the quick fox"), (None, "42 a"), (2, None), (3, "日本語 GRÖSSE lorem")]
    table = spark.createDataFrame([(*row, "x", 1) for row in items], "item_id long, text string, id string, rank int")
    # Only A-Z are lowered, and an item without an id is an item.
    assert run(odd_documents(spark), table) == brute(ODD_TEXTS, items)
    assert run(no_documents(spark), table) == []
    assert run(odd_documents(spark), table.limit(0)) == []
    assert run(odd_documents(spark, [(1, None), (2, "")]), table) == []
    names = spark.createDataFrame([("b", "quick lazy"), ("a", "quick")], "item_id string, text string")
    assert run(odd_documents(spark), names) == brute(ODD_TEXTS, [("b", "quick lazy"), ("a", "quick")])
