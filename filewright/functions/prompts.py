"""Texts sent to a model, rendered as columns for the rows that need one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filewright.functions.text import excerpt, preview
from filewright.settings import Settings

UNDERSTAND = """Describe this file.
Name: "%s"
Location: "%s"
Excerpt: "%s"

Answer with one JSON object that has the keys summary, keywords, language, document_type and content_signals.
"""

CLASSIFY = """Sort this file into a broad category (category_l1) and a narrow one (category_l2).
Judge by what the file says. Take a category already in use only when it clearly fits; otherwise name a better one.

In use: %s
Name: "%s"
Location: "%s"
Summary: "%s"
Keywords: [%s]
Kind: "%s"
Language: "%s"
Excerpt: "%s"

Answer with one JSON object that has the keys category_l1, category_l2, confidence, reason and needs_review.
"""


def _fill(template: str, *values: Column) -> Column:
    return F.format_string(template, *[F.coalesce(value, F.lit("")) for value in values])


def understanding_prompt(filename: Column, path: Column, text: Column, settings: Settings) -> Column:
    return _fill(UNDERSTAND, filename, path, preview(text, settings.max_content_length))


def classification_prompt(
    taxonomy: Column, filename: Column, path: Column, reading: Column, text: Column, settings: Settings
) -> Column:
    return _fill(
        CLASSIFY,
        taxonomy,
        filename,
        path,
        reading["summary"],
        F.concat_ws(", ", reading["keywords"]),
        reading["document_type"],
        reading["language"],
        preview(text, settings.max_content_length),
    )


def taxonomy_text(taxonomy: DataFrame, limit: int) -> DataFrame:
    """The taxonomy as one line of text, ``a: b, c; d: e``, in one row.

    Models may invent categories without end, and the line goes into every prompt. So it names the ``limit``
    categories that hold the most files, by a column ``files`` if there is one, and of each the ``limit``
    subcategories that do; how many it leaves out is said beside them. Names are in order.
    """
    files = F.sum("files" if "files" in taxonomy.columns else F.lit(1)).alias("files")
    pairs = taxonomy.groupBy("category_l1", "category_l2").agg(files)
    place = F.row_number().over(Window.partitionBy("category_l1").orderBy(F.desc("files"), "category_l2"))
    named = pairs.where("category_l2 IS NOT NULL").withColumn("place", place).where(F.col("place") <= limit)
    subs = named.groupBy("category_l1").agg(F.sort_array(F.collect_list("category_l2")).alias("subs"))
    whole = pairs.groupBy("category_l1").agg(F.sum("files").alias("files"), F.count("category_l2").alias("held"))
    largest = whole.orderBy(F.desc("files"), "category_l1").limit(limit).join(subs, "category_l1", "left")
    more = F.col("held") - F.coalesce(F.size("subs"), F.lit(0))
    listed = F.concat_ws(", ", "subs", F.when(more > 0, F.format_string("and %d more", more)))
    entries = largest.select(F.concat_ws(": ", "category_l1", F.nullif(listed, F.lit(""))).alias("entry"))
    line = F.concat_ws("; ", F.sort_array(F.collect_list("entry")))
    left = whole.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("left"))
    counted = entries.agg(line.alias("line")).crossJoin(left)  # one row each
    return counted.select(F.concat_ws("; ", "line", F.when(F.col("left") > 0, F.format_string("and %d more", "left"))).alias("taxonomy"))


def prompt_audit(prompt: Column, limit: int = 500) -> tuple[Column, Column]:
    """Length and short excerpt of a prompt, for a log."""
    return F.length(prompt).cast("bigint"), excerpt(prompt, limit)
