"""A dry run over labelled files, scored against the labels."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from filewright.operators.scoring import benchmark_cases, benchmark_report
from filewright.plans.organize import Organized, Tables, organize
from filewright.settings import Run, Settings
from filewright.sources.inbox import first_files


class Benchmark(NamedTuple):
    cases: DataFrame
    report: DataFrame
    done: Organized


def benchmark(
    labels: DataFrame, files: DataFrame, tables: Tables, run: Run, settings: Settings, limit: int | None = None
) -> Benchmark:
    """Labels without a file stay in the cases, as missing. With a limit, only the first labels in path order are used."""
    if limit is not None:
        labels = first_files(labels, limit)
    labelled = files.join(labels.select("source_path").distinct(), "source_path", "left_semi")
    done = organize(labelled, tables, run._replace(dry_run=True), settings)
    cases = benchmark_cases(labels, done.plan)
    return Benchmark(cases, benchmark_report(cases), done)
