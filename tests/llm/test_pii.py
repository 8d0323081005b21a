import random
import re

import pytest

from filewright.llm import pii
from helpers_llm import ODD_TEXTS, no_documents, odd_documents

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        value = int(c) * (1 + k % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text):
    made = []
    for kind, pattern in BASE.items():
        for found in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", found.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(part) <= 255 for part in found.group().split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                made.append((kind, found.start(), found.end()))
    return made


def run(docs):
    rows = pii.personal_data(docs).collect()
    return [(r["id"], [(s["kind"], s["start"], s["end"]) for s in r["base"]], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in rows]


FIXED = [
    "a@b.c%d@e.f.g", "x@y", "@a.b", "a@@b.c", "é.a@b.co\U0001f600 z@q.r", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 1.2.3", "4111 1111 1111 1111",
    "4111-1111-1111-1112", "4111  1111111111111", "+1 (017) 555-7713", "+12345678", "+1 2", "++49 30 1234567 ", "call +1.2.3.4.5.6.7.8.9.0",
    "12345678901234567890", "0000000000000000", "+1 4111111111111111",
]


def test_base_spans_against_brute_force(spark):
    rng = random.Random(7)
    texts = FIXED + ["".join(rng.choices("0123456789+. -()@aB%é,", k=rng.randint(0, 60))) for _ in range(1500)]
    rows = list(enumerate(texts))
    for number, base, spans in run(spark.createDataFrame(rows, "doc_id long, text string")):
        assert base == base_spans(texts[number]), texts[number]
        assert set(base) <= set(spans)


def test_long_runs_do_not_exhaust_the_stack(spark):
    rows = [(1, "1" * 200_000), (2, "a." * 100_000 + "@b" + ".c" * 100_000), (3, "1.2.3.4 " * 30_000), (4, "a@b." * 5000)]
    got = {number: base for number, base, _ in run(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[1] == []
    assert got[2] == [("email", 0, 400_002)]
    assert len(got[3]) == 30_000
    assert got[4] == base_spans(rows[3][1])


def test_odd_rows(spark):
    got = run(odd_documents(spark))
    assert sorted(str(n) for n, _, _ in got) == sorted(str(n) for n, _ in ODD_TEXTS)
    assert all(base == spans == [] for _, base, spans in got)
    assert run(no_documents(spark)) == []
    rows = [(1, "a@b.c"), (1, "a@b.c"), (None, "1.2.3.4")]
    assert sorted(map(str, run(odd_documents(spark, rows)))) == sorted(
        [str((1, [("email", 0, 5)], [("email", 0, 5)]))] * 2 + [str((None, [("ip", 0, 7)], [("ip", 0, 7)]))]
    )


def test_further_spans_and_masks(spark):
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(k, f'words token = "{secret}" and more words {k}') for k in range(20)]
    rows += [(100, "mail a@b.org or +1 (017) 555-7713, thanks"), (101, "4111 1111 1111 1112 is no card"), (102, None), (103, "clean words")]
    docs = odd_documents(spark, rows)
    got = {number: spans for number, _, spans in run(docs)}
    assert all(got[k] == [("secret", 15, 55)] for k in range(20))
    assert got[101] == []
    masked = pii.masked(docs)
    assert masked.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert texts[3] == 'words token = "<secret>" and more words 3'
    assert texts[100] == "mail <email> or <phone>, thanks"
    assert (texts[101], texts[102], texts[103]) == (rows[21][1], None, "clean words")


def test_plan_runs_no_python(spark):
    docs = odd_documents(spark, [(1, "a@b.c")])
    for frame in (pii.personal_data(docs), pii.masked(docs)):
        assert "Python" not in frame._jdf.queryExecution().toString() and "Arrow" not in frame._jdf.queryExecution().toString()


def test_reliabilities_of_labelers(spark):
    votes = [dict(kind="card", format=1, checksum=1, gazetteer=0, context=1, edges=0)] * 60
    votes += [dict(kind="card", format=-1, checksum=-1, gazetteer=0, context=0, edges=0)] * 120
    votes += [dict(kind="card", format=1, checksum=-1, gazetteer=0, context=0, edges=-1)] * 10
    row = pii.reliabilities(spark.createDataFrame(votes)).collect()[0]
    assert row["chance"] == pytest.approx(60 / 190, abs=0.08)
    found = dict(zip(pii.LABELERS, row["reliable"]))
    assert found["checksum"] > found["format"] > 0.8


def test_a_long_secret_is_taken_whole(spark):
    secret = "".join(random.Random(4).choices("abcdefghijkLMNOPQRSTUV/+-", k=1000))
    rows = [(k, f"words token={secret} and more words {k}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(spans == [("secret", 12, 1012)] for _, _, spans in run(docs))
    assert {r["text"] for r in pii.masked(docs).collect()} == {f"words token=<secret> and more words {k}" for k in range(20)}
