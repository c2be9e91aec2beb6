"""Incremental jobs as streams."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from postwatch.operators.publish import OfferTable
from postwatch.operators.state import SeenLog
from postwatch.plans.daily import daily_run


def stream_new_postings(
    postings: DataFrame,
    employers: DataFrame,
    seen: SeenLog,
    offers: OfferTable,
    checkpoint: str,
    run_date_of: Callable[[DataFrame, int], dt.date],
    **params,
) -> StreamingQuery:
    """Each micro-batch of the landing stream is one run: split, score, publish, remember.

    The batch id is the run number.  A batch that is tried again reads the state as it stood
    before it and overwrites its own output folders, so results are exactly-once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        daily_run(batch, employers, seen, offers, batch_id, run_date_of(batch, batch_id), **params)

    return (
        postings.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
