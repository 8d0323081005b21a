import random
import time
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from filewright.llm import bpe, packing, store
from helpers_llm import ODD_TEXTS, no_documents, odd_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def encode(texts):
    raw = [text.encode() for text in texts]
    offsets = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    ids, counts = bpe.Encoder(PATH).encode(offsets, np.frombuffer(b"".join(raw), np.uint8))
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


def test_encoder_equals_the_library():
    rng = random.Random(4)
    signs = "aAbBzZéÉñßÀ×÷'’ stmdrevl09.,!<|>\n\t\r ́Σœ日  \x1c\x0b"
    texts = ["don't", "'some", "--'s", "I'LL we'Ve it's'", "'", "<|endoftext|> a", "ÀB ß", "aaaa bbbbbbb", "l'll'd'"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    library = Tokenizer.from_file(PATH)
    assert encode(texts) == [library.encode(text, add_special_tokens=False).ids for text in texts]


def test_long_runs_take_time_in_proportion():
    library = Tokenizer.from_file(PATH)
    for text in ("a" * 1_000_000, "=" * 1_000_000, "é" * 200_000, "x1" * 200_000):
        begin = time.perf_counter()
        assert encode([text]) == [library.encode(text, add_special_tokens=False).ids]
        assert time.perf_counter() - begin < 10  # twice the time of the library, on a busy machine


def test_known_pieces_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 5)
    shared, library = bpe.encoder(PATH), Tokenizer.from_file(PATH)
    assert shared is bpe.encoder(PATH)
    for text in ("one two three four five six seven", "one two", "eight nine one", ""):
        raw = text.encode()
        ids, counts = shared.encode(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]


def test_another_tokenizer_goes_through_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = bpe.Encoder(path)
    raw = "Hello  there\n".encode()
    ids, counts = encoder.encode(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
    assert not encoder.plain
    assert ids.tolist() == Tokenizer.from_file(path).encode("Hello  there\n", add_special_tokens=False).ids


def test_curve_visits_every_cell_once_by_single_steps():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = packing.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check(rows, texts, sequence):
    library = Tokenizer.from_file(PATH)
    whole = {}
    for number, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        whole.setdefault(number, []).append(ids)
    ends = {}
    for row in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert row["offset"] == ends.get(row["sequence_id"], 0)
        ends[row["sequence_id"]] = row["offset"] + row["length"]
        assert row["doc_tokens"] in {len(ids) for ids in whole[row["id"]]}
        parts = {zlib.crc32(np.array(ids[row["start"] : row["start"] + row["length"]], "<u4").tobytes()) for ids in whole[row["id"]]}
        assert row["ids_crc32"] in parts
    total = sum(len(ids) for many in whole.values() for ids in many)
    assert sum(ends.values()) == total
    assert sorted(ends) == list(range(len(ends)))
    assert all(end == sequence for number, end in ends.items() if number < len(ends) - 1)


def test_every_token_is_in_one_piece(spark):
    rows = packing.pack(odd_documents(spark), PATH).collect()
    check(rows, ODD_TEXTS, packing.SEQUENCE)
    rows = packing.pack(odd_documents(spark), PATH, sequence=16, with_tokens=True).collect()
    check(rows, ODD_TEXTS, 16)
    assert all(len(row["ids"]) == row["length"] for row in rows)
    assert packing.pack(no_documents(spark), PATH).count() == 0


def test_neighbours_on_the_curve_are_alike(spark):
    rng = random.Random(6)
    pools = ["apple pear plum cherry lemon".split(), "engine wheel brake road fuel".split()]
    texts = [(k, " ".join(rng.choices(pools[k % 2], k=200))) for k in range(80)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), PATH).where("start = 0").collect()
    order = [row["id"] % 2 for row in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))]
    assert sum(a != b for a, b in zip(order, order[1:])) < 20


def test_known_pieces_are_not_looked_up_again(monkeypatch):
    library, learned = Tokenizer.from_file(PATH), []
    learn = bpe.Encoder._learn
    monkeypatch.setattr(bpe.Encoder, "_learn", lambda self, distinct, *rest: learned.append(len(distinct)) or learn(self, distinct, *rest))
    made, text = bpe.Encoder(PATH), "one two three, don't stop: one 22"
    raw = np.frombuffer(text.encode(), np.uint8)
    for _ in range(3):
        ids, counts = made.encode(np.array([0, len(raw)]), raw)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]
    assert learned == [9]


def test_pieces_that_share_a_slot(monkeypatch):
    monkeypatch.setattr(bpe, "SLOT_BITS", 3)
    monkeypatch.setattr(bpe, "KEPT_POWERS", 16)
    rng, library, made = random.Random(5), Tokenizer.from_file(PATH), bpe.Encoder(PATH)
    for _ in range(20):
        texts = ["".join(rng.choice("abcdé 'st1.") for _ in range(rng.randint(0, 60))) for _ in range(5)]
        raw = [text.encode() for text in texts]
        ids, counts = made.encode(np.append(0, np.cumsum([len(r) for r in raw])), np.frombuffer(b"".join(raw), np.uint8))
        assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_the_tokens_are_removed_when_they_are_in_order(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "shared_folder", lambda _: str(tmp_path))
    check(packing.pack(odd_documents(spark), PATH).collect(), ODD_TEXTS, packing.SEQUENCE)
    assert [path.name.rsplit("-", 1)[0] for path in tmp_path.glob("llm/*")] == ["curve-order"]
