"""Rows that every operator has to take: NULLs, empty and long texts, ties, repeated rows and columns with clashing names."""

from pyspark.sql import types as T

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor " * 3000

ODD_TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today."),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today."),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "a"),
    (7, "42 42 42 42"),
    (8, LONG),
    (9, "Größe ÉTÉ niño 日本語 \U0001f600 x́"),
    (9, "Größe ÉTÉ niño 日本語 \U0001f600 x́"),
    (None, "no id here but words enough to count as a text of ten words"),
    (None, None),
]

CLASHING = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("FP", T.StringType()),
        T.StructField("cell", T.IntegerType()),
        T.StructField("score", T.StringType()),
        T.StructField("mark", T.StringType()),
        T.StructField("text_digest", T.StringType()),
    ]
)


def odd_documents(spark, texts=ODD_TEXTS):
    rows = [(i, t, "en", "x", None, "y", 1, "z", "m", "d") for i, t in texts]
    return spark.createDataFrame(rows, CLASHING)


def no_documents(spark):
    return spark.createDataFrame([], CLASHING)


def words_of(rng, count, letters="abcdefgh", size=4):
    return ["".join(rng.choices(letters, k=rng.randint(1, size))) for _ in range(count)]
