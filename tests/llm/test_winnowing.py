import hashlib
import random
import re

from filewright.llm import winnowing
from helpers_llm import ODD_TEXTS, no_documents, odd_documents, words_of


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items):
    windows = {}
    for item, text in items:
        found = words(text)
        size = min(10, len(found))
        for k in range(len(found) - size + 1 if size else 0):
            windows.setdefault(tuple(found[k : k + size]), set()).add(str(item))
    made = []
    for number, text in docs:
        found = words(text)
        hit, named = set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(found) - size + 1):
                if tuple(found[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    named |= windows[tuple(found[k : k + size])]
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        made.append((number, len(found), len(hit), len(named), bool(hit), digest))
    return sorted(made, key=str)


def run(docs, items):
    columns = ("id", "n_words", "n_hit", "n_items", "contaminated", "items_sha256")
    found = winnowing.digest(winnowing.contamination(docs, items)).select(*columns)
    return sorted((tuple(row) for row in found.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    items = [(k, " ".join(words_of(rng, rng.choice((3, 9, 10, 11, 40))))) for k in range(30)]
    items += [(100, items[0][1]), (101, ""), (102, None), (103, "same same same same same same same same same same same")]
    docs = []
    for k in range(120):
        made = words_of(rng, rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1] or ""
            part = part.split()[: rng.choice((5, 10, 60))]
            at = rng.randint(0, len(made))
            made[at:at] = [w.upper() if rng.random() < 0.2 else w for w in part]
        docs.append((k, rng.choice((" ", ", ", "\n-")).join(made)))
    docs.append((500, "same " * 30))
    got = run(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got == brute(docs, items)
    assert sum(row[4] for row in got) > 20


def test_odd_rows_and_empty_tables(spark):
    items = [(1, ODD_TEXTS[0][1]), (1, ODD_TEXTS[0][1]), (2, "a"), (None, "42")]
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = [(1, "The quick brown fox jumps over the lazy dog near the old river bank today."), (2, "a")]
    got = run(odd_documents(spark), table)
    wanted = brute(ODD_TEXTS, [*expected])
    # An item without an id hits words but is not listed.
    assert [r for r in got if r[0] != 7] == [r for r in wanted if r[0] != 7]
    assert [r[1:5] for r in got if r[0] == 7] == [(4, 4, 0, True)]
    assert run(no_documents(spark), table) == []
    assert run(odd_documents(spark), table.limit(0)) == brute(ODD_TEXTS, [])
