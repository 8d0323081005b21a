import json

from filewright.functions.responses import parse_answer, typed_classification, typed_understanding
from filewright.operators.decisions import attach_raw_answer


def typed(spark, raws, build, **options):
    frame = spark.createDataFrame(list(enumerate(raws)), "i INT, raw STRING")
    rows = build(frame.select("i", parse_answer("raw").alias("payload")), **options).orderBy("i").collect()
    return [row[-1] for row in rows]


def test_shapes_of_answers(spark):
    body = '{"category_l1": "A", "category_l2": "B", "confidence": 1.7, "reason": "r", "needs_review": false}'
    raws = [body, f"```json\n{body}\n```", f"Sure: {body} bye", body[:-5], "", "[1, 2]", "[]", "{}", "null", "7", "0", '"x"']
    states = [t.state for t in typed(spark, raws, typed_classification)]
    assert states == ["object"] * 3 + ["empty", "empty", "invalid", "empty", "empty", "empty", "invalid", "empty", "invalid"]
    first = typed(spark, raws[:1], typed_classification)[0]
    assert (first.category_l1, first.category_l2, first.confidence, first.needs_review) == ("A", "B", 1.7, False)


def test_classification_fields(spark):
    cases = [
        ({"confidence": "high"}, "invalid", None, None),
        ({"confidence": " 0.8 "}, "object", 0.8, False),
        ({"confidence": None}, "object", 0.0, False),
        ({"confidence": True, "needs_review": "False"}, "object", 1.0, True),
        ({"confidence": [1]}, "invalid", None, None),
        ({"confidence": [], "needs_review": ""}, "object", 0.0, False),
        ({"category_l1": 5}, "invalid", None, None),
        ({"category_l1": None, "needs_review": [0]}, "object", 0.0, True),
        ({"needs_review": 0, "reason": "x"}, "object", 0.0, False),
    ]
    got = typed(spark, [json.dumps(case[0]) for case in cases], typed_classification)
    assert [(t.state, t.confidence, t.needs_review) for t in got] == [case[1:] for case in cases]


def test_bool_strings_can_be_read(spark):
    raws = [json.dumps({"needs_review": value}) for value in ("False", "no", "maybe")]
    got = typed(spark, raws, typed_classification, parse_bool_strings=True)
    assert [t.needs_review for t in got] == [False, False, True]


def test_understanding_fields(spark):
    cases = [
        ({"keywords": [str(i) for i in range(9)]}, "object", [str(i) for i in range(8)]),
        ({"keywords": None}, "invalid", None),
        ({"keywords": "abc"}, "object", ["a", "b", "c"]),
        ({"keywords": {"x": 1, "y": 2}}, "object", ["x", "y"]),
        ({"keywords": [1, True, None, "s"]}, "object", ["1", "True", "None", "s"]),
        ({"summary": "only"}, "object", []),
        ({"summary": 3}, "invalid", None),
        ({"keywords": 4}, "invalid", None),
    ]
    got = typed(spark, [json.dumps(case[0]) for case in cases], typed_understanding)
    assert [(t.state, t.keywords) for t in got] == [case[1:] for case in cases]


def test_raw_answers_are_attached_by_stage(spark):
    documents = spark.createDataFrame([("a",), ("b",)], "document_id STRING")
    answers = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2")], "document_id STRING, stage STRING, raw STRING")
    got = {row.document_id: row.raw for row in attach_raw_answer(documents, answers, "x").collect()}
    assert got == {"a": "1", "b": None}
