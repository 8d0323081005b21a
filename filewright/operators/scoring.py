"""Decisions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.operators.skew import latest_by

_ACTUAL = ("category_l1", "category_l2", "needs_review", "status")


def last_results(results: DataFrame) -> DataFrame:
    """The last result of each path, by ``event_id`` where results have one."""
    order = F.col("event_id") if "event_id" in results.columns else F.struct("run_id", "document_id")
    return latest_by(results, ["source_path"], order, _ACTUAL)


def benchmark_cases(labels: DataFrame, results: DataFrame) -> DataFrame:
    """Each label beside what was decided; ``missing`` where nothing was."""
    actual = last_results(results).select(
        "source_path",
        F.lit(True).alias("found"),
        F.col("category_l1").alias("actual_category_l1"),
        F.col("category_l2").alias("actual_category_l2"),
        F.col("needs_review").alias("actual_needs_review"),
        "status",
    )
    status = F.when(F.col("found"), F.col("status")).otherwise("missing")
    return labels.join(actual, "source_path", "left").withColumn("status", status).drop("found")


def missing_labels(labels: DataFrame, results: DataFrame) -> DataFrame:
    return labels.join(results.select("source_path").distinct(), "source_path", "left_anti")


def _matches(name: str) -> Column:
    """An expectation that is not stated matches anything; a missing case matches nothing."""
    expected, actual = F.col(f"expected_{name}"), F.col(f"actual_{name}")
    return (F.col("status") != "missing") & (expected.isNull() | F.coalesce(expected == actual, F.lit(False)))


def benchmark_report(cases: DataFrame, *by: str) -> DataFrame:
    """Counters over all cases, or per value of ``by``."""
    level1, level2, review = _matches("category_l1"), _matches("category_l2"), _matches("needs_review")
    return cases.groupBy(*by).agg(
        F.count("*").alias("total_cases"),
        F.count_if(level1).alias("matched_level1"),
        F.count_if(level2).alias("matched_level2"),
        F.count_if(review).alias("matched_review_flag"),
        F.count_if(level1 & level2 & review).alias("full_matches"),
        F.count_if(F.col("status") == "missing").alias("failures"),
    )


def compare_reports(cases_by_config: dict[str, DataFrame]) -> DataFrame:
    """One report row per configuration."""
    combined = None
    for config, cases in cases_by_config.items():
        named = cases.withColumn("config", F.lit(config))
        combined = named if combined is None else combined.unionByName(named)
    return benchmark_report(combined, "config")
