"""Cross-run memory: which fingerprints were seen, first and last when."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postwatch.operators.membership import maybe_in, membership, merged
from postwatch.operators.skew import salted_join
from postwatch.schema import SEEN, SEEN_ATTRIBUTES, names

# One shape for a run's sightings and for the folded state, so folding is associative: runs can
# be combined on the map side, compacted and replayed in any grouping.
SIGHTINGS = """
    fingerprint STRING, first_run BIGINT, first_seq BIGINT, first_seen DATE,
    last_run BIGINT, last_seen DATE, source STRING, url STRING, title STRING, company STRING"""


def flag_known(batch: DataFrame, seen: DataFrame, spread_by: str = "ingest_seq",
               filter_of_seen: DataFrame | None = None) -> DataFrame:
    """Add is_known: the fingerprint is in seen, as seen stood before this batch.  Two postings
    of one batch with the same fingerprint are therefore both new.

    filter_of_seen: a membership filter of seen (SeenLog.seen_filter).  Postings that are not in it
    are new and are not shuffled; the others are joined, so the result is the same."""
    known = seen.select("fingerprint").distinct().withColumn("is_known", F.lit(True))
    asked = batch if filter_of_seen is None else maybe_in(batch, ["fingerprint"], filter_of_seen)
    flagged = salted_join(
        asked, known, ["fingerprint"], "left", F.col(spread_by)
    ).withColumn("is_known", F.coalesce("is_known", F.lit(False)))
    if filter_of_seen is None:
        return flagged
    rest = maybe_in(batch, ["fingerprint"], filter_of_seen, inside=False)
    return flagged.unionByName(rest.withColumn("is_known", F.lit(False)))


def split_new_known(batch: DataFrame, seen: DataFrame,
                    spread_by: str = "ingest_seq") -> tuple[DataFrame, DataFrame]:
    """(new, known) postings: left anti and left semi join on the fingerprint."""
    keys = seen.select("fingerprint").distinct()
    return tuple(
        salted_join(batch, keys, ["fingerprint"], how, F.col(spread_by))
        for how in ("left_anti", "left_semi")
    )


def sightings(batch: DataFrame, run_seq: Column, run_date: Column) -> DataFrame:
    """Postings as sightings of their run."""
    return batch.select(
        "fingerprint",
        run_seq.cast("bigint").alias("first_run"),
        F.col("ingest_seq").alias("first_seq"),
        run_date.alias("first_seen"),
        run_seq.cast("bigint").alias("last_run"),
        run_date.alias("last_seen"),
        *SEEN_ATTRIBUTES,
    )


def fold_sightings(df: DataFrame, latest_date: bool = False) -> DataFrame:
    """One row per fingerprint: the first writer's date and attributes, the last run's date.

    The last run sets last_seen even when its date is older; latest_date=True takes the greatest
    date instead.  Partial aggregation leaves one row per key and task, so hot keys are harmless."""
    first = F.min_by(
        F.struct("first_run", "first_seq", "first_seen", *SEEN_ATTRIBUTES),
        F.struct("first_run", "first_seq"),
    ).alias("first")
    last_seen = F.max("last_seen") if latest_date else F.max_by("last_seen", "last_run")
    return (
        df.groupBy("fingerprint")
        .agg(first, F.max("last_run").alias("last_run"), last_seen.alias("last_seen"))
        .select("fingerprint", "first.*", "last_run", "last_seen")
        .select(names(SIGHTINGS))
    )


def as_seen(folded: DataFrame) -> DataFrame:
    """The public columns of the state."""
    return folded.select(names(SEEN))


def merge_seen(state: DataFrame, batch: DataFrame, run_seq: int, run_date: dt.date,
               latest_date: bool = False) -> DataFrame:
    """Upsert a run into the folded state: unknown fingerprints are inserted, known ones only
    get a new last_seen.  Union and one aggregation; neither side is shuffled twice."""
    rows = sightings(batch, F.lit(run_seq), F.lit(run_date))
    return fold_sightings(state.unionByName(rows), latest_date)


def new_known_by_run(batches: DataFrame, run: str = "run_date") -> DataFrame:
    """Per run: postings collected, new (fingerprint in no earlier run) and already seen.

    Aggregated to (run, fingerprint) first, so a fingerprint has one row per run in the window."""
    per_run = batches.groupBy(run, "fingerprint").agg(F.count(F.lit(1)).alias("_n"))
    first_run = F.min(run).over(Window.partitionBy("fingerprint"))
    new = F.when(F.col(run) == first_run, F.col("_n")).otherwise(0)
    return (
        per_run.withColumn("_new", new).groupBy(run)
        .agg(F.sum("_n").alias("collected"), F.sum("_new").alias("new"))
        .withColumn("already_seen", F.col("collected") - F.col("new"))
    )


class SeenLog:
    """Seen state on a shared file system, with no table format that can MERGE.

    log/run_seq=N/    sightings of run N, overwritten whole, so a retried run leaves one copy
    filter/run_seq=N/ membership filter of run N's fingerprints, of bounded size
    state/upto=N/     folded state of all runs up to N
    commits/          one row per finished compaction; readers only trust those

    Runs append narrow deltas instead of rewriting the state; compact() folds them at leisure.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def append(self, batch: DataFrame, run_seq: int, run_date: dt.date, part: str = "new") -> None:
        """Record a run's postings.  part tells apart several writes of one run."""
        rows = fold_sightings(sightings(batch, F.lit(run_seq), F.lit(run_date)))
        rows.write.mode("overwrite").parquet(f"{self.root}/log/run_seq={run_seq}/part={part}")
        log = self.spark.read.schema(SIGHTINGS).parquet(
            f"{self.root}/log/run_seq={run_seq}/part={part}")
        membership(log, ["fingerprint"]).write.mode("overwrite").parquet(
            f"{self.root}/filter/run_seq={run_seq}/part={part}")

    def seen_filter(self, before: int) -> DataFrame:
        """One filter of all fingerprints seen before a run, from those of the runs."""
        stored = self._read("filter", "_word INT, _bits BIGINT, run_seq BIGINT, part STRING")
        return merged(stored.filter(F.col("run_seq") < before).select("_word", "_bits"))

    def compact(self, upto: int) -> None:
        folded = self.folded(upto + 1)
        folded.write.mode("overwrite").parquet(f"{self.root}/state/upto={upto}")
        self.spark.createDataFrame([(upto,)], "upto bigint").write.mode("append").parquet(
            f"{self.root}/commits"
        )

    def _rows(self, before: int) -> DataFrame:
        """Rows that fold to the state as it stood before a run."""
        base = self._read("commits", "upto bigint")
        upto = base.filter(F.col("upto") < before).agg(F.max("upto")).first()[0]
        low = -1 if upto is None else upto
        log = self._read("log", SIGHTINGS + ", run_seq BIGINT, part STRING")
        log = log.filter((F.col("run_seq") > low) & (F.col("run_seq") < before))
        rows = log.select(names(SIGHTINGS))
        if upto is None:
            return rows
        state = self.spark.read.schema(SIGHTINGS).parquet(f"{self.root}/state/upto={upto}")
        return state.unionByName(rows)

    def _read(self, name: str, ddl: str) -> DataFrame:
        try:
            return self.spark.read.schema(ddl).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], ddl)

    def keys(self, before: int) -> DataFrame:
        """Fingerprints seen before a run; no need to fold for that."""
        return self._rows(before).select("fingerprint")

    def folded(self, before: int) -> DataFrame:
        return fold_sightings(self._rows(before))

    def read(self, before: int = 1 << 62) -> DataFrame:
        """The state: fingerprint, first_seen, last_seen and the first writer's attributes."""
        return as_seen(self.folded(before))
