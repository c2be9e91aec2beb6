"""Seen state kept by a stream: one value per fingerprint in the state store."""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from postwatch.operators.state import SIGHTINGS
from postwatch.schema import SEEN_ATTRIBUTES, names

FOLDED = SIGHTINGS + ", seqs ARRAY<BIGINT>"
STATE_NAME = "seen"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = ("first_run BIGINT, first_seq BIGINT, first_seen DATE, last_run BIGINT, last_seen DATE, "
         + ", ".join(f"{name} STRING" for name in SEEN_ATTRIBUTES))
FLAGS = "fingerprint STRING, run BIGINT, seqs ARRAY<BIGINT>, is_known BOOLEAN"
SIGHTING_FIELDS, STATE_FIELDS, FLAG_FIELDS = names(SIGHTINGS), names(STATE), names(FLAGS)

# The processor is unpickled by a Python worker that Spark starts for the state operator, whose
# path need not hold this package: its code travels with it, and it uses only this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fold_locally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sightings of one fingerprint and run within an Arrow batch as one row, with the numbers of
    all of them, so that a fingerprint with most of the postings is a few rows for the state."""
    for batch in batches:
        if len(batch) == 0:
            continue
        ordered = batch.sort_values(["first_run", "first_seq"], kind="stable")
        groups = ordered.groupby(["fingerprint", "first_run"], sort=False, dropna=False)
        first = ordered[~ordered.duplicated(["fingerprint", "first_run"])].copy()
        first["seqs"] = [list(x) for x in groups["first_seq"].agg(list)]
        yield first[[*SIGHTING_FIELDS, "seqs"]]


class SeenProcessor(StatefulProcessor):
    """Flags each posting by the state before its run, and folds its run into the state: the first
    writer's date and attributes stay, the last run sets last_seen."""

    def __init__(self, ttl: dt.timedelta | None = None):
        self.ttl = int(ttl.total_seconds() * 1000) if ttl else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState(STATE_NAME, STATE, self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame],
                        timerValues: Any) -> Iterator[pd.DataFrame]:
        fields = STATE_FIELDS
        state = dict(zip(fields, self.seen.get())) if self.seen.exists() else None
        # The batch as it came: every posting is held against the state before its own run.
        held = sorted((r for batch in rows for r in batch.to_dict("records")),
                      key=lambda r: (r["first_run"], r["first_seq"]))
        out = []
        for row in held:
            known = state is not None and state["first_run"] < row["first_run"]
            out.append((key[0], row["first_run"], row["seqs"], known))
            state = merge(state, {name: row[name] for name in fields})
        self.seen.update(tuple(plain(state[name]) for name in fields))
        yield pd.DataFrame(out, columns=FLAG_FIELDS)

    def close(self) -> None:
        pass


def merge(state: dict | None, row: dict) -> dict:
    if state is None:
        return row
    kept = dict(state)
    if (row["first_run"], row["first_seq"]) < (state["first_run"], state["first_seq"]):
        kept |= {name: row[name] for name in ("first_run", "first_seq", "first_seen",
                                               *SEEN_ATTRIBUTES)}
    if row["last_run"] >= state["last_run"]:
        kept |= {name: row[name] for name in ("last_run", "last_seen")}
    return kept


def plain(value: Any) -> Any:
    """A pandas value as the state store takes it."""
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    if isinstance(value, pd.Timestamp):
        return value.date()
    return value.item() if hasattr(value, "item") else value


def flag_stream(sightings: DataFrame, ttl: dt.timedelta | None = None) -> DataFrame:
    """A stream of sightings -> fingerprint, run, ingest_seq, is_known, one row per posting.

    A posting is known when its fingerprint was seen in an earlier run, so twins of one run are both
    new, in one micro-batch or in several.  With a ttl a fingerprint that no run showed for so long
    is forgotten.  Null fingerprints are one key."""
    folded = sightings.select(names(SIGHTINGS)).mapInPandas(fold_locally, FOLDED)
    flagged = folded.groupBy("fingerprint").transformWithStateInPandas(
        SeenProcessor(ttl), outputStructType=FLAGS, outputMode="Append",
        timeMode="ProcessingTime" if ttl else "None")
    return flagged.select("fingerprint", "run", F.explode("seqs").alias("ingest_seq"), "is_known")


def stream_seen_state(sightings: DataFrame, output: str, checkpoint: str,
                      ttl: dt.timedelta | None = None) -> StreamingQuery:
    """Keep the seen state of a stream of sightings in the state store under `checkpoint`, and write
    each posting's flag to `output`, one folder a micro-batch, which a batch that is tried again
    writes anew."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    # With a ttl Spark would run empty batches for ever, to forget: values are forgotten when a
    # batch with rows comes instead.  The setting is taken over when the query starts.
    # Keyed state of transformWithState lives only in RocksDB, whatever store the session has.
    conf = sightings.sparkSession.conf
    before, store = conf.get(EMPTY_BATCHES, "true"), conf.get(PROVIDER, None)
    conf.set(EMPTY_BATCHES, "false" if ttl else before)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return (
            flag_stream(sightings, ttl).writeStream.outputMode("append").foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(EMPTY_BATCHES, before)
        if store is None:
            conf.unset(PROVIDER)
        else:
            conf.set(PROVIDER, store)


def read_streamed_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as the last finished micro-batch left it, read from the state store: one row per
    fingerprint, whatever the number of micro-batches."""
    stored = (spark.read.format("statestore").option("path", checkpoint)
              .option("stateVarName", STATE_NAME).load())
    return stored.select("key.fingerprint", "value.*").select(names(SIGHTINGS))


def read_flags(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(
        "fingerprint STRING, run BIGINT, ingest_seq BIGINT, is_known BOOLEAN").parquet(output)
