import random

from filewright.llm import toxicity
from helpers_llm import ODD_TEXTS, no_documents, odd_documents, words_of

SEEDS = ("zorgul", "plimf")


def corpus(count, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for number in range(count):
        words = words_of(rng, rng.randint(20, 120), "bcdeioamn", 6)
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(SEEDS) + rng.choice(("", "en", "ast", "iko"))
        docs.append((number, " ".join(words) + "."))
        labels.append((number, toxic))
    return docs, labels


def run(spark, docs, labels):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    return {r["id"]: r for r in toxicity.toxicity(frame, known).collect()}


def test_held_out_accuracy(spark):
    docs, labels = corpus(600, 1)
    got = run(spark, docs, labels)
    held = [(got[number]["predicted"], toxic) for number, toxic in labels if got[number]["held_out"]]
    assert len(held) > 80
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = corpus(300, 2)
    got = run(spark, docs, labels)
    turned = [(n, 1 - t if got[n]["held_out"] else t) for n, t in labels]
    assert {n: r["score"] for n, r in run(spark, docs, turned).items()} == {n: r["score"] for n, r in got.items()}


def test_near_copies_teach_their_words_once(spark):
    docs, labels = corpus(300, 3)
    rng = random.Random(4)
    words = words_of(rng, 200, "qwxyzo", 8)
    for k in range(120):
        words[rng.randrange(200)] = "changed"
        docs.append((5000 + k, " ".join(words)))
        labels.append((5000 + k, 1))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.train(toxicity.training_texts(frame, known)).lexicon
    assert any(key.startswith("zorg") for key in lexicon)
    assert not any(key[:-1] in words for key in lexicon)


def test_transducer_tells_plain_negated_and_reported_clauses():
    grammar = toxicity.Grammar({"zorg*": (toxicity.INSULT, 4.0), "kill$": (toxicity.THREAT, 2.0)})
    names = toxicity.FEATURES

    def features(text):
        return {n: v for n, v in zip(names, grammar.features(text)) if v and n != "bias"}

    assert features("A zorgling came. A zorg left.").keys() == {"weight", "clauses"}
    assert "clauses" not in features("he is not a zorg") and features("he is not a zorg")["negated"] > 0
    assert features("they said: a zorg").get("reported") is None
    assert features("she said this zorg came")["reported"] > 0
    assert features("you zorg")["aimed"] > 0
    assert features("i will kill you")["threats"] > 0
    assert features("azorg killing nothing") == {}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (None, 1), (77, 1), (8, None), (9, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(ODD_TEXTS)
    assert all(r["predicted"] == 0 for r in got)
    assert toxicity.toxicity(docs, labels.limit(0)).count() == len(ODD_TEXTS)
    assert toxicity.toxicity(no_documents(spark), labels).count() == 0
    known = odd_documents(spark, [(1, "you idiot"), (2, "")])
    assert {r["id"]: r["predicted"] for r in toxicity.toxicity(known, labels.limit(0)).collect()} == {1: 1, 2: 0}
