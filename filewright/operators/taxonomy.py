"""The two-level taxonomy: snapshot, aliases, alignment."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.functions.paths import sanitize_component
from filewright.operators.ledger import committed
from filewright.operators.skew import attach
from filewright.settings import Settings
from filewright.sources.tables import materialize


def _excluded(settings: Settings) -> list[str]:
    return [*settings.ignore_dirs, *settings.technical_folders]


def folder_pairs(destinations: DataFrame, settings: Settings) -> DataFrame:
    """Rows with a ``destination_path`` in a folder below the organised root, with that folder as ``category_l1, category_l2``."""
    root = settings.organized_dir.rstrip("/") + "/"
    parts = F.split(F.substring(F.col("destination_path"), len(root) + 1, 1 << 30), "/")
    below = destinations.where(F.col("destination_path").startswith(root) & (F.size(parts) >= 2))
    return below.withColumns({"category_l1": F.get(parts, 0), "category_l2": F.when(F.size(parts) >= 3, F.get(parts, 1))})


def folders_in_use(destinations: DataFrame, settings: Settings) -> DataFrame:
    """Folder pairs below the organised root, from a ``destination_path`` column."""
    return folder_pairs(destinations, settings).select("category_l1", "category_l2").distinct()


def categories(folders: DataFrame, settings: Settings) -> DataFrame:
    """Folder pairs without the technical and ignored ones."""
    return folders.where(~F.col("category_l1").isin(*_excluded(settings)))


def scan_taxonomy(events: DataFrame, settings: Settings) -> DataFrame:
    """The categories that hold committed files, technical and ignored folders left out."""
    return categories(folders_in_use(committed(events), settings), settings)


def taxonomy_use(events: DataFrame, settings: Settings) -> DataFrame:
    """The categories that hold committed files, and how many ``files`` each holds."""
    placed = categories(folder_pairs(committed(events), settings), settings)
    return placed.groupBy("category_l1", "category_l2").agg(F.count("*").alias("files"))


def taxonomy_index(taxonomy: DataFrame) -> DataFrame:
    """Each first level with its sorted second levels."""
    pairs = taxonomy.distinct()
    return pairs.groupBy("category_l1").agg(F.sort_array(F.collect_list("category_l2")).alias("category_l2"))


def new_categories(decided: DataFrame, taxonomy: DataFrame, settings: Settings) -> DataFrame:
    """First-level categories of a run that did not exist before it."""
    used = decided.where(F.col("category_l1").isNotNull()).select("category_l1").distinct()
    known = taxonomy.select("category_l1").distinct()
    return used.where(~F.col("category_l1").isin(*_excluded(settings))).join(known, "category_l1", "left_anti")


def resolve_alias(name: Column, *scopes: Mapping[str, str]) -> Column:
    """The canonical name from the first scope that knows the name, else the name."""
    found = []
    for scope in scopes:
        if scope:
            pairs = [F.lit(part) for key, value in scope.items() for part in (key.lower(), value)]
            found.append(F.try_element_at(F.create_map(*pairs), F.lower(name)))
    return F.coalesce(*found, name)


def normalized_pair(category_l1: Column, category_l2: Column, settings: Settings) -> tuple[Column, Column]:
    """Both levels sanitised, then replaced by their aliases."""
    pair = []
    for value, default, own in (
        (category_l1, settings.level1_default, settings.level1_aliases),
        (category_l2, settings.level2_default, settings.level2_aliases),
    ):
        filled = F.coalesce(F.nullif(value, F.lit("")), F.lit(default))
        pair.append(resolve_alias(sanitize_component(filled, default), settings.aliases, own))
    return pair[0], pair[1]


def align_pairs(pairs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Give distinct pairs the spelling of the taxonomy where they differ only in case.

    The second level is looked up only inside a first level that was found.
    Among several spellings the smallest is taken.
    """
    first = taxonomy.groupBy(F.lower("category_l1").alias("key_l1")).agg(F.min("category_l1").alias("known_l1"))
    second = (
        taxonomy.where(F.col("category_l2").isNotNull())
        .groupBy(F.col("category_l1").alias("known_l1"), F.lower("category_l2").alias("key_l2"))
        .agg(F.min("category_l2").alias("known_l2"))
    )
    keyed = pairs.withColumn("key_l1", F.lower("category_l1")).withColumn("key_l2", F.lower("category_l2"))
    return (
        keyed.join(first, "key_l1", "left")
        .join(second, ["known_l1", "key_l2"], "left")
        .withColumn("aligned_l1", F.coalesce("known_l1", "category_l1"))
        .withColumn("aligned_l2", F.coalesce("known_l2", "category_l2"))
        .drop("key_l1", "key_l2", "known_l1", "known_l2")
    )


def align(rows: DataFrame, taxonomy: DataFrame, settings: Settings, spread_by: str = "document_id") -> DataFrame:
    """Align ``category_l1, category_l2`` of many rows through their distinct pairs.

    The aligned pairs are stored, so that Spark knows their size. It broadcasts
    them while they are few, and else joins them by shuffle, large pairs split.
    """
    pairs = (
        rows.where(F.col("category_l1").isNotNull() & F.col("category_l2").isNotNull())
        .groupBy("category_l1", "category_l2")
        .agg(F.count("*").alias("pair_rows"))
    )
    aligned = materialize(align_pairs(pairs, taxonomy))
    joined = attach(
        rows,
        aligned,
        ["category_l1", "category_l2"],
        size="pair_rows",
        spread_by=spread_by,
        hot_rows=settings.hot_rows,
    )
    return (
        joined.withColumn("category_l1", F.coalesce("aligned_l1", "category_l1"))
        .withColumn("category_l2", F.coalesce("aligned_l2", "category_l2"))
        .drop("aligned_l1", "aligned_l2", "pair_rows")
    )
