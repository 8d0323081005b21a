import hashlib
import itertools
import random
import re
import zlib

import pytest

from filewright.llm import repair

VISIBLE = r"[^\x20\x09-\x0D]"
FORM = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, made = set(), []
    for _, role, text in rows:
        visible = re.findall(VISIBLE, text)
        if not visible:
            made.append("blank")
        elif (role, text) in seen:
            made.append("duplicate")
        else:
            made.append("" if visible[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return made


def all_edits(rows, marks):
    """Every edit script with up to two insertions in a place: (cost, audit, repaired messages)."""
    inserts = [p for n in range(3) for p in itertools.product(("user", "assistant"), repeat=n)]
    choices = []
    for (_, role, text), mark in zip(rows, marks):
        own = [(4, "D", [])]
        if mark not in ("blank", "duplicate"):
            more = 3 * (mark == "truncated")
            own += [(more, "K", [(role, text)]), (3 + more, "R", [("user", text)]), (3 + more, "R", [("assistant", text)])]
        choices.append([(3 * len(p) + c, "I" * len(p) + e, [(r, "") for r in p] + m) for p in inserts for c, e, m in own])
    choices.append([(3 * len(p), "I" * len(p), [(r, "") for r in p]) for p in inserts])
    partial = {(): (0, "", [])}
    for options in choices:
        grown = {}
        for cost, audit, made in partial.values():
            for more, letters, messages in options:
                state = "".join(role[:1] or "-" for role, _ in made + messages)
                # What can follow depends on the last two initials and whether there are any.
                if not re.fullmatch(r"s?(ua)*u?", state):
                    continue
                key = (state[-1:], len(state) > 0)
                grown.setdefault(key, []).append((cost + more, audit + letters, made + messages))
        partial = {(key, k): best for key, found in grown.items() for k, best in enumerate(sorted(found)[:40])}
    whole = [one for one in partial.values() if FORM.fullmatch("".join(role[:1] or "-" for role, _ in one[2]))]
    return min(whole, key=lambda one: one[:2])


def brute(messages):
    made = []
    groups = {}
    for conv, turn, role, text in messages:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, rows in groups.items():
        rows.sort(key=lambda row: (row[0] is not None, row[0] or 0))
        marks = faults(rows)
        turns = [row[0] for row in rows if row[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        roles = [row[1][:1] for row in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        cost, audit, fixed = all_edits(rows, marks)
        digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in fixed).encode()).hexdigest()
        counts = [marks.count(kind) for kind in ("blank", "duplicate", "truncated")]
        made.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(made, key=str)


def conversations(rng, count, longest):
    texts = ["Yes.", "No!", "Well?", "cut off", "", " \n", "Fine. ", "ends with a dash -", "日本語。"]
    made = []
    for conv in range(count):
        turns = sorted(rng.sample(range(longest * 2), rng.randint(1, longest)))
        for turn in turns:
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None))
            text = rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}."
            made.append((conv, turn, role, rng.choice((text, text, text, None))))
    return made


def table(spark, rows, key="long"):
    return spark.createDataFrame(rows, f"conv_id {key}, turn int, role string, text string, conv string")


def run(spark, rows, key="long"):
    return sorted((tuple(row) for row in repair.summary(table(spark, [(*row, "x") for row in rows], key)).collect()), key=str)


def test_against_every_edit_script(spark):
    rows = conversations(random.Random(5), 60, 5)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("block_rows", (1, 3))
def test_blocks_do_not_change_the_result(spark, monkeypatch, block_rows):
    rows = conversations(random.Random(6), 40, 6)
    whole = run(spark, rows)
    monkeypatch.setattr(repair, "BLOCK_ROWS", block_rows)
    assert run(spark, rows) == whole == brute(rows)


def test_grammar_keeps_sequences_and_shares_rules():
    rng = random.Random(7)
    texts = ["".join(rng.choices("suaxSUAXD", k=rng.randint(1, 80))) for _ in range(60)] + ["ua" * 300, "ua" * 301, "u" * 77]
    rules, sequences = repair.re_pair(texts)

    def expanded(value):
        if value < len(repair.SYMBOLS):
            return repair.SYMBOLS[value]
        left, right = rules[value - len(repair.SYMBOLS)]
        return expanded(left) + expanded(right)

    assert ["".join(map(expanded, sequence)) for sequence in sequences] == texts
    assert len(sequences[-3]) < 20 and sum(map(len, sequences)) < sum(map(len, texts)) / 2
    pairs = [pair for sequence in sequences for pair in zip(sequence, sequence[1:])]
    assert max(pairs.count(pair) for pair in set(pairs)) <= 2  # at most overlapping ones are left
    step_by_step = []
    for text in texts:
        whole = repair.symbol_matrix(text[0])
        for symbol in text[1:]:
            whole = repair.product(whole, repair.symbol_matrix(symbol))
        step_by_step.append({key: (cost, "".join(repair._leaves(rope))) for key, (cost, rope) in whole.items()})
    solved = [{key: (cost, "".join(repair._leaves(rope))) for key, (cost, rope) in m.items()} for m in repair.solved(texts)]
    assert solved == step_by_step


def test_one_long_conversation(spark):
    rng = random.Random(8)
    rows = [(1, k, rng.choice(("user", "assistant")), f"t{k}.") for k in range(20_000)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    got = run(spark, rows)
    assert got[1][1:8] == (0, 0, 0, 0, 0, 0, "KK")
    best = {0: (0, "")}
    for _, _, role, _ in rows[:20_000]:
        grown = {}
        for state, (cost, audit) in best.items():
            for (first, last), (more, rope) in repair.symbol_matrix(role[0]).items():
                if first == state:
                    grown[last] = min(grown.get(last, (1 << 60, "")), (cost + more, audit + "".join(repair._leaves(rope))))
        best = grown
    cost, audit = min((cost + 3 * len(repair.CLOSING[state]), audit + repair.CLOSING[state]) for state, (cost, audit) in best.items())
    assert got[0][6:8] == (cost, audit)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None),
        (None, 4, "user", "x."),
        (3, None, "user", "x."),
        (3, None, "user", "x."),
        (4, 1, "user", "same."),
        (4, 1, "user", "same."),
        (4, 1, "user", "same."),
        (5, 1, "u", "long. " * 300_000),
        (6, 2, "user", "x."),
        (6, 9, "assistant", "y."),
    ]
    got = {row[0]: row[1:] for row in run(spark, rows)}
    assert got[None][:6] == (0, 1, 0, 0, 1, 7) and got[None][6] == "DKI"
    assert got[3][:6] == (0, 0, 1, 0, 1, 7)
    assert got[4][:5] == (0, 0, 2, 0, 2) and got[4][5] == 11
    assert got[5][5:7] == (3, "KI") and got[6][0] == 6
    assert got[5][7] == hashlib.sha256(("u:" + "long. " * 300_000 + "\nassistant:").encode()).hexdigest()
    text_keys = {row[0]: row[1:] for row in run(spark, [(str(a), b, c, d) for a, b, c, d in rows if a], "string")}
    assert {str(k): v for k, v in got.items() if k} == text_keys
    empty = table(spark, [])
    assert repair.summary(empty).collect() == [] and repair.damage_summary(empty).collect() == []
    assert repair.repaired(empty).collect() == []


def test_repaired_messages(spark):
    rows = [(1, 0, "assistant", "b."), (1, 1, "tool", "c."), (1, 2, "assistant", "d")]
    got = repair.repaired(table(spark, [(*row, "x") for row in rows])).orderBy("number").collect()
    assert [(row.edit, row.role, row.text) for row in got] == [("I", "user", ""), ("K", "assistant", "b."), ("R", "user", "c."), ("K", "assistant", "d")]


def test_damage(spark, data):
    messages = spark.read.parquet(f"{data}/conversations.parquet")
    planted = []
    for row in messages.collect():
        fault = zlib.crc32(f"{row.conv_id}:{row.turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", row.text) if fault == 2 else row.text
        planted += [(row.conv_id, row.turn, "user" if fault == 4 else row.role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    got = sorted(map(tuple, repair.damaged(messages).collect()))
    assert got == sorted(planted)
    # A conversation that loses all its messages stays, with zeros.
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    found = repair.damage_summary(table(spark, [(lost, 0, "user", "x.", "")])).collect()
    assert [tuple(row) for row in found] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
