import random

from pyspark.sql import functions as F

from filewright.functions.rules import rule_for_name, rule_for_text
from filewright.operators import rule_table
from filewright.settings import DEFAULT_RULES, Rule


def table(spark, rules):
    return spark.createDataFrame([(place, *rule) for place, rule in enumerate(rules)], rule_table.RULES)


def both(spark, rows, rules):
    documents = spark.createDataFrame(rows, "document_id long, filename string, text string").cache()
    found = {row.id: row.precedence for row in rule_table.classify(documents, table(spark, rules)).collect()}
    chain = F.least(rule_for_name("filename", rules), rule_for_text("text", rules))
    expected = {row.document_id: row.rule for row in documents.select("document_id", chain.alias("rule")).collect()}
    return found, {number: rule for number, rule in expected.items() if rule is not None}


def test_needed_runs():
    needed = {
        r"invoice|receipt|nota fiscal": ["invoice", "receipt", "nota fiscal"],
        r"cv\b": [None],
        r"\.py\b|def |class ": [".py", "def ", "class "],
        r"colou?r": ["colo"],
        r"ab*cde": ["cde"],
        r"(foo|bar)baz": ["baz"],
        r"[a|b]cde|xyz": ["cde", "xyz"],
        r"a{2}bcd{3}": [None],
        r"Straße": ["stra"],
        r"x+yz": [None],
        r"abc+d": ["abc"],
        r"a\d\dbcd": ["bcd"],
        r"\Qa|b\E": [None],
        r"^start.*end$": ["start"],
        "": [None],
    }
    for pattern, expected in needed.items():
        assert [run for _, run in rule_table.alternatives(pattern)] == expected, pattern


def test_default_rules(spark):
    rows = [
        (1, "INVOICE_7.txt", "x"),
        (2, "a.txt", "my curriculum and a receipt"),
        (3, "main.py", ""),
        (4, "main.pyc", "nothing"),
        (5, None, None),
        (6, "cv.txt", ""),
        (7, "x", "İnvoice bıll reſume"),
        (8, "x", "y" * 996 + "deck"),
        (9, "x", "y" * 997 + "deck"),
        (10, "", "class "),
    ]
    found, expected = both(spark, rows, DEFAULT_RULES)
    assert found == expected and len(found) > 5


def test_many_rules_against_the_chain(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcde", k=rng.randint(2, 6))) for _ in range(300)]
    forms = ["{}", r"{}\b", r"\b{}", "{}|{}", "{}.{}", "{}[xyz]?{}", "({}|{})", "{}?", "^{}", "{}{{1,2}}"]
    patterns = [rng.choice(forms).format(rng.choice(words), rng.choice(words)) for _ in range(150)]
    rules = [Rule(pattern, f"L{k}", "M", 0.5, "r") for k, pattern in enumerate(patterns)]
    rows = [(k, f"{rng.choice(words)}.txt", " ".join(rng.choices(words, k=rng.randint(0, 12))).upper()) for k in range(200)]
    found, expected = both(spark, rows, rules)
    assert found == expected and 100 < len(found)


def test_verdicts_ties_and_empty_tables(spark):
    rules = table(spark, [Rule("alpha", "A", "a", 0.9, "first")])
    twice = rules.unionByName(rules).unionByName(spark.createDataFrame([(0, "alp", "B", "b", 0.1, "same place"), (None, "alpha", "C", "c", 0.1, ""), (0, None, "D", "d", 0.1, "")], rule_table.RULES))
    documents = spark.createDataFrame([(1, "ALPHA", None, 1), (2, "beta", "", 2)], "document_id long, filename string, text string, precedence int")
    assert [(row.id, row.category_l1, row.reason) for row in rule_table.classify(documents, twice).collect()] == [(1, "B", "same place")]
    assert rule_table.classify(documents.limit(0), rules).collect() == [] and rule_table.classify(documents, rules.limit(0)).collect() == []


def test_texts_leave_only_the_pieces_that_rules_ask_for(spark):
    runs = ["exclamation", "alphabet", "gammas", "xyz"]
    pieces = sorted({piece for run in runs for piece in rule_table._pieces(run)})
    table = rule_table._bit_table(spark.createDataFrame([(piece,) for piece in pieces], "piece long"), 16)
    filler = "".join(chr(ord("a") + (k * k + k // 7) % 23) for k in range(1000))
    rows = [(k, ["name.txt", f"{filler}{k}"]) for k in range(200)]
    rows += [(1000, ["ab", "c"]), (1001, ["gammas", "äöü xyz xyz"]), (1002, []), (1003, ["an exclamatio", "exclamation", "alphabe", "t"])]
    texts = spark.createDataFrame(rows, "id long, fields array<string>")
    asked = rule_table._asked(texts, [3, 6, 8], 16, table).collect()
    of = {k: {row.piece for row in asked if row.id == k and row.piece in pieces} for k in range(1000, 1004)}
    assert of[1001] == set(rule_table._pieces("gammas") + rule_table._pieces("xyz"))
    assert of[1003] == set(rule_table._pieces("exclamation")) and not of[1000] and not of[1002]
    # Each of the 200 texts has some 500 different pieces of three signs alone.
    assert len(asked) == len({(row.id, row.piece) for row in asked}) < 400


def test_runs_beyond_a_piece_and_long_fields(spark):
    rules = [Rule(run, f"L{k}", "M", 0.5, "r") for k, run in enumerate(["alphabetical", "alphabetica", "ALPHABET", r"alphabets\b", "alphabex"])]
    rows = [
        (1, "x", "Alphabetical order"),
        (2, "a" * (rule_table.CHUNK_BYTES + 5) + "lphabetica", "alphabe"),
        (3, "alphabe", "t"),
        (4, "ſtrange alphabetſ", "alphabetsx"),
        (5, None, "ALPHABEX"),
    ]
    found, expected = both(spark, rows, rules)
    assert found == expected == {1: 0, 2: 1, 4: 2, 5: 4}
