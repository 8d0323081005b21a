import random

from filewright.llm import language
from helpers_llm import ODD_TEXTS, no_documents, odd_documents

STEMS = {
    "aa": "the and ing tion ough ight".split(),
    "bb": "der und sch keit ung lich".split(),
    "cc": "ción que los mente para ñan".split(),
}


def sample(count, seed):
    rng = random.Random(seed)
    rows = []
    for number in range(count):
        lang = rng.choice(list(STEMS))
        words = ["".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        rows.append((number, " ".join(words), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = sample(300, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["id"]: r for r in language.languages(docs).collect()}
    held = [(got[number]["lang_pred"], lang) for number, _, lang in rows if got[number]["held_out"]]
    assert 60 < len(held) < 140
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = sample(200, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    base = {r["id"]: (r["lang_pred"], r["score"]) for r in language.languages(docs).collect()}
    held = {r["id"] for r in language.languages(docs).where("held_out").collect()}
    wrong = spark.createDataFrame([(n, t, "zz" if n in held else g) for n, t, g in rows], docs.schema)
    assert {r["id"]: (r["lang_pred"], r["score"]) for r in language.languages(wrong).collect()} == base


def test_odd_rows(spark):
    got = language.languages(odd_documents(spark)).collect()
    assert len(got) == len(ODD_TEXTS)
    by_id = {r["id"]: r for r in got}
    for number in (3, 4, 5, 7):
        assert (by_id[number]["lang_pred"], by_id[number]["score"], by_id[number]["rejected"]) == ("und", 0.0, True)
    assert by_id[8]["lang_pred"] == "en"
    assert by_id[None]["held_out"]
    assert language.languages(no_documents(spark)).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in language.languages(docs).collect()] == [("und", 0.0, True)]


def test_text_unlike_all_others_is_rejected(spark):
    rows = [*sample(200, 3), (1000, "Ωμέγα κόσμος λόγος πόλις " * 20, None)]
    got = {r["id"]: r for r in language.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1000]["rejected"]
    assert sum(r["rejected"] for r in got.values()) < 20
