from filewright.functions.prompts import taxonomy_text


def line(spark, rows, limit, schema="category_l1 string, category_l2 string, files long"):
    return taxonomy_text(spark.createDataFrame(rows, schema), limit).first().taxonomy


def test_most_used_folders_are_named_and_the_rest_counted(spark):
    rows = [("Rare", f"s{k}", 1) for k in range(9)] + [("Often", "z", 50), ("Often", "a", 1), ("Often", None, 5), ("Alone", None, 20)]
    assert line(spark, rows, 100) == "Alone; Often: a, z; Rare: s0, s1, s2, s3, s4, s5, s6, s7, s8"
    # A folder with many files comes before one with many subfolders.
    assert line(spark, rows, 2) == "Alone; Often: a, z; and 1 more"
    assert line(spark, rows, 1) == "Often: z, and 1 more; and 2 more"
    assert line(spark, rows[:9], 3) == "Rare: s0, s1, s2, and 6 more"


def test_taxonomy_without_counts_or_rows(spark):
    pairs = [("A", "x"), ("A", "y"), ("B", "x"), ("A", "y")]
    assert line(spark, pairs, 9, "category_l1 string, category_l2 string") == "A: x, y; B: x"
    assert line(spark, [], 9) == ""
