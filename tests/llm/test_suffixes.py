import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from filewright.llm import suffixes
from helpers_llm import ODD_TEXTS, no_documents, odd_documents


def brute(rows, length=suffixes.LENGTH):
    raw = [(number, (text or "").encode()) for number, text in rows]
    counts = Counter(data[k : k + length] for _, data in raw for k in range(len(data) - length + 1))
    made = []
    for number, data in raw:
        covered = np.zeros(len(data) + 1, int)
        for k in range(len(data) - length + 1):
            if counts[data[k : k + length]] > 1:
                covered[k] += 1
                covered[k + length] -= 1
        gone = np.cumsum(covered)[:-1] > 0
        left = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        made.append((number, len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(made, key=str)


def run(docs):
    return sorted((tuple(r) for r in suffixes.remove_repeats(docs).collect()), key=str)


def texts_with_repeats(seed):
    rng = random.Random(seed)
    noise = lambda size: "".join(rng.choices("abcdef ghié", k=size))
    shared = [noise(size) for size in (399, 400, 401, 450, 900)]
    texts = [noise(rng.choice((0, 10, 399, 700))) for _ in range(20)]
    for k in range(60):
        part = rng.choice(shared)
        cut = rng.randint(0, 60)
        texts.append(noise(rng.randint(0, 300)) + part[cut:] + noise(rng.randint(0, 300)))
    texts += [texts[25], texts[25], "x" * 900, "ab" * 500, noise(3000) * 2]
    return list(enumerate(texts))


def test_against_brute_force(spark):
    rows = texts_with_repeats(1)
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_anchors_spread_over_shards_and_texts_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SPLIT_SEGMENTS", 3)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 4000)
    monkeypatch.setattr(suffixes, "MERGE_ROWS", 500)
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 1500)
    rows = texts_with_repeats(2)
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(spark):
    short = [(n, t if t is None or len(t) < 5000 else t[:5000]) for n, t in ODD_TEXTS]
    assert run(odd_documents(spark, short)) == brute(short)
    assert run(no_documents(spark)) == []
    rows = [(1, "q" * 399), (1, "q" * 399), (None, "w" * 400), (None, "w" * 400)]
    assert run(odd_documents(spark, rows)) == brute(rows)


@pytest.mark.parametrize("length", [8, 20, 400])
def test_suffix_array_and_common_prefixes(length):
    rng = random.Random(length)
    text = "".join(rng.choices("ab", k=300)) * 4 + "".join(rng.choices("abc", k=200))
    data = np.frombuffer(text.encode(), np.uint8)
    order, rank = suffixes.refine(data, length)
    padded = text + "\0" * length
    assert [padded[i : i + length] for i in order] == sorted(padded[i : i + length] for i in range(len(text)))
    prefix = suffixes.common_prefixes(data, order, rank, length)
    for at in range(1, len(order)):
        a, b = text[order[at - 1] :][:length], text[order[at] :][:length]
        if rank[order[at - 1]] == rank[order[at]]:
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert prefix[at] == same
        else:
            assert prefix[at] == 0
            assert padded[order[at - 1] :][:length] != padded[order[at] :][:length]
