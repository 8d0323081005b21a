"""Organising documents as they arrive."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filewright import schemas
from filewright.operators.state import State
from filewright.plans.organize import Tables, organize
from filewright.settings import Run, Settings
from filewright.sources.tables import load_table, materialize, replace_partitions

EVENTS_A_BATCH = 1 << 40


def batch_run(stream: str, batch_id: int, started_at: datetime) -> Run:
    """The run of one batch. Streams that share a ledger need names of their own."""
    return Run(f"{stream}-batch-{batch_id}", started_at)


def organize_batch(
    rows: DataFrame,
    run: Run,
    ledger: str,
    to_files: Callable[[DataFrame, str], DataFrame],
    settings: Settings,
    runs: str | None = None,
    state: State | None = None,
    first_id: int | None = None,
    **known: DataFrame,
) -> None:
    """Organise one batch and put its events into the ledger, and its records into the table at ``runs``.

    The partition of the run is replaced, so a batch that is delivered again
    leaves the ledger as it was. With a ``state`` and the ``first_id`` of its events the batch does not read the ledger
    but the stored state of the batches before it, and then its own part of the ledger back into the state.
    """
    spark = rows.sparkSession
    if state is not None:
        state.forget(spark, run.run_id)
        stored = {"history": state.history, "names": state.names, "taxonomy": materialize(state.taxonomy(spark, settings))}
        tables = Tables.empty(spark, **stored, **known)
    else:
        events = load_table(spark, ledger, schemas.EVENTS).where(F.col("run_id") != run.run_id)
        tables = Tables.empty(spark, events=events, **known)
        if first_id is None:
            first_id = events.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0] + 1
    done = organize(to_files(rows, run.run_id), tables, run, settings)
    replace_partitions(done.events(first_id or 1), ledger, "run_id")
    if state is not None:
        state.record(load_table(spark, ledger, schemas.EVENTS).where(F.col("run_id") == run.run_id), settings)
    if runs is not None:
        replace_partitions(done.run_record().unionByName(done.run_record(run.started_at)), runs, "run_id")


def organize_stream(
    arriving: DataFrame,
    ledger: str,
    checkpoint: str,
    to_files: Callable[[DataFrame, str], DataFrame],
    settings: Settings,
    started_at: datetime,
    stream: str,
    runs: str | None = None,
    state: State | None = None,
    **known: DataFrame,
) -> StreamingQuery:
    """Start a query that organises all that has arrived, batch by batch, and then stops.

    ``stream`` names the query in its run ids. It belongs to the checkpoint: with a new checkpoint,
    batches are numbered from the start again, so it takes a new name.

    ``to_files`` turns arrived rows and a run id into file rows. What is known from before is
    the ledger, or with a ``state`` what that keeps of it, so no watermark is needed; the time of a batch then
    does not grow with the ledger. Events are numbered from ``EVENTS_A_BATCH`` times the batch on.
    """

    def handle(rows: DataFrame, batch_id: int) -> None:
        first_id = batch_id * EVENTS_A_BATCH + 1 if state is not None else None
        run = batch_run(stream, batch_id, started_at)
        organize_batch(rows, run, ledger, to_files, settings, runs, state, first_id, **known)

    return (
        arriving.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
