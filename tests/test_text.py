import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from filewright.functions import paths, text
from filewright.functions.rules import rule_for_name, rule_for_text
from filewright.settings import DEFAULT_RULES, STOP_WORDS


def apply(spark, values, build):
    """Values of an expression over a one-column frame ``t``, in order."""
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "i INT, t STRING").select("i", build.alias("r"))
    return [row.r for row in frame.orderBy("i").collect()]


def test_quality_steps(spark):
    sizes = {49: 0.15, 50: 0.35, 249: 0.35, 250: 0.6, 999: 0.6, 1000: 0.8, 3999: 0.8, 4000: 0.95}
    values = [None, "", " ", *["x" * n for n in sizes], "  " + "x" * 49 + "\n\xa0"]
    assert apply(spark, values, text.quality_score("t")) == [0.0, 0.0, 0.15, *sizes.values(), 0.15]


def test_preview_limits(spark):
    mark = text.SKIPPED
    got = apply(spark, ["abcde", "abcdef", " a\t\nb ", None, "0123456789"], text.preview(F.col("t"), 5))
    assert got == ["abcde", "abc" + mark + "ef", "a b", "", "012" + mark + "89"]


def test_previews_of_earlier_generations(spark):
    long = "a" * 14_500 + " \n" + "b" * 6_000
    plain, collapsed = (
        apply(spark, [long], build(F.col("t")))[0]
        for build in (text.preview_head_tail, text.preview_head_tail_collapsed)
    )
    assert plain == "a" * 14_500 + text.SKIPPED_LINE + "b" * 5_000
    assert collapsed == " ".join(plain.split())
    assert apply(spark, ["abcdefg"], text.preview_two_thirds(F.col("t"), 6)) == ["abcd ... [CONTENT SKIPPED] ... fg"]


def test_summary_and_language(spark):
    values = ["  x ", "y" * 240, "z" * 241, "   ", None]
    assert apply(spark, values, text.summary("t")) == ["x", "y" * 240, "z" * 240 + "...", None, None]
    assert apply(spark, ["Um documento", "documents", "épara", "PARA mim"], text.guess_language("t")) == [
        "pt-BR",
        "en",
        "en",
        "pt-BR",
    ]


def keywords_by_hand(value):
    found = Counter(w for w in re.findall(r"[A-Za-z][A-Za-z0-9_-]{3,}", value.lower()) if w not in STOP_WORDS)
    return [w for w, _ in sorted(found.items(), key=lambda p: (-p[1], p[0]))[:8]]


def test_keywords_by_hand(spark):
    values = ["zeta zeta beta beta alpha", "this that with", "", "a bb ccc", " ".join(STOP_WORDS * 3) + " word"]
    assert apply(spark, values, text.top_keywords("t", STOP_WORDS)) == [keywords_by_hand(v) for v in values]
    assert apply(spark, [None], text.top_keywords("t", STOP_WORDS)) == [[]]


def test_keywords_on_whole_documents(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet")
    for row in rows.select("text", text.top_keywords("text", STOP_WORDS).alias("k")).collect():
        assert row.k == keywords_by_hand(row.text)


def test_sanitize(spark):
    values = ['<>:"/\\|?*', "x" * 101, "a  \t b", "a\x01b", None, "  "]
    got = apply(spark, values, paths.sanitize_component(F.col("t"), "General"))
    assert got == ["General", "x" * 100, "a b", "ab", "General", "General"]


@pytest.mark.parametrize(
    ("name", "ext", "expected"),
    [
        ("a/b\\c", ".txt", "a-b-c.txt"),
        ("report.PDF", ".pdf", "report.PDF"),
        ("report.doc", ".pdf", "report.pdf"),
        (None, ".txt", "file.txt"),
        ("", ".txt", "file.txt"),
        ('q?"*', ".md", "q.md"),
        (".hidden", ".md", ".hidden.md"),
        ("x" * 300, ".md", "x" * 200),
    ],
)
def test_sanitize_filename(spark, name, ext, expected):
    assert apply(spark, [name], paths.sanitize_filename(F.col("t"), F.lit(ext))) == [expected]


def test_path_parts(spark):
    values = ["a.tar.GZ", ".bashrc", "a.", "noext", "..a"]
    assert apply(spark, values, paths.extension_of(F.col("t"))) == [".gz", "", "", "", ".a"]
    assert apply(spark, ["a.txt", "b"], paths.restored_name(F.col("t"))) == ["a_restored.txt", "b_restored"]


def test_rules(spark):
    names = ["INVOICE deck", "my cv.pdf", "cvs.txt", "cv_7.txt", "x.py", "x.pyc", "plain"]
    assert apply(spark, names, rule_for_name("t", DEFAULT_RULES)) == [0, 1, None, None, 3, None, None]
    texts = ["." * 994 + "slide", "." * 996 + "slide", "Billions", "cv"]
    assert apply(spark, texts, rule_for_text("t", DEFAULT_RULES)) == [2, None, 0, 1]


def test_rows_as_text(spark):
    frame = spark.createDataFrame([("a ", 1, None), ("", None, None)], "x STRING, y INT, z STRING")
    made = frame.select(text.rows_as_text(*map(F.col, "xyz")).alias("r")).collect()
    assert [row.r for row in made] == ["a | 1", None]
