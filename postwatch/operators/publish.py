"""Published tables: offers, employer status, status counts, source status."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.functions.labels import age_label, salary_label, source_label
from postwatch.functions.text import clean_employer, normalize, or_default
from postwatch.operators.dedup import greedy_or_dedup
from postwatch.operators.match import match_employer
from postwatch.operators.score import rank_key
from postwatch.operators.skew import dealt, salted_join
from postwatch.operators.stats import status_counts
from postwatch.plans import defaults
from postwatch.session import materialize

OFFER_COLUMNS = [
    "found_on", "employer", "title", "location", "contract", "salary", "age", "url", "source",
    "reason", "status", "compat",
]
OFFERS_DDL = ", ".join(f"{c} {'double' if c == 'compat' else 'string'}" for c in OFFER_COLUMNS)

# Fixed values of the tracker.
SPOTTED = "Offre repérée"
OPEN_STATUSES = ["", "a cibler"]
NEXT_ACTION = "Analyser l'offre + postuler"


def _day(day: dt.date) -> Column:
    return F.lit(day.strftime("%d/%m/%Y"))


def offer_columns(run_date: dt.date) -> list[Column]:
    """The twelve published columns of a scored posting."""
    c = F.col
    tiered = F.format_string("%s (P%d)", "company", "employer_tier")
    cells = [
        _day(run_date),
        F.when(c("employer_tier").isNotNull(), tiered).otherwise(c("company")),
        c("title"),
        or_default(c("location"), "n.c."),
        or_default(c("contract_type"), "n.c."),
        salary_label(c("salary_min"), c("salary_max")),
        age_label(c("posted_at"), F.lit(run_date)),
        c("url"),
        source_label(c("source"), c("company")),
        c("match_reason"),
        F.lit("Nouvelle"),
        F.bround("score", 0) / 100,
    ]
    return [cell.alias(name) for cell, name in zip(cells, OFFER_COLUMNS)]


def offer_rows(scored: DataFrame, run_date: dt.date) -> DataFrame:
    return scored.select(offer_columns(run_date))


TRACKER_DDL = "row_id bigint, employer string, status string, last_action string, next_action string"
SOURCES_DDL = "ord int, label string, n string, ok_label string, last_ok string"


def pair_columns(company: Column, title: Column) -> dict[str, Column]:
    """Second publication key: cleaned employer and normalized title."""
    return {"_employer": clean_employer(company), "_title": normalize(title)}


def not_yet_published(retained: DataFrame, offers: DataFrame,
                      spread_by: str = "ingest_seq") -> DataFrame:
    """Postings with neither their url nor their (employer, title) pair in the offers table.
    Two anti joins: a single OR condition would compare all pairs.  Runs a job: the keys of both
    are written once."""
    pairs = offers.select(
        *[c.alias(n) for n, c in pair_columns(offers.employer, offers.title).items()]
    ).distinct()
    urls = offers.select(F.trim("url").alias("url")).filter("url != ''").distinct()
    spread, pair = F.col(spread_by), ["_employer", "_title"]
    named = retained.withColumns(pair_columns(retained.company, retained.title))
    used = materialize(dealt(named, ["url", *pair], spread), "publish-parts")
    fresh = salted_join(named, urls, ["url"], "left_anti", spread,
                        used=used.select("url", "_part").distinct())
    return salted_join(fresh, pairs, pair, "left_anti", spread,
                       used=used.select(*pair, "_part").distinct()).select(retained.columns)


def select_offers(retained: DataFrame, offers: DataFrame) -> DataFrame:
    """Postings to publish, best first wins: not in the table yet, nor twice in the batch.
    Runs jobs (greedy rounds)."""
    fresh = not_yet_published(retained, offers)
    keyed = fresh.withColumns(
        {**pair_columns(fresh.company, fresh.title), "_rank": rank_key()}
    )
    return greedy_or_dedup(
        keyed, "url", ["_employer", "_title"], "_rank"
    ).select(retained.columns)


class OfferTable:
    """Append-only offers on a shared file system, one folder per run, overwritten on retry."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def read(self, before: int = 1 << 62) -> DataFrame:
        ddl = OFFERS_DDL + ", run_seq bigint"
        try:
            rows = self.spark.read.schema(ddl).parquet(self.root)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = self.spark.createDataFrame([], ddl)
        return rows.filter(F.col("run_seq") < before)

    def append(self, retained: DataFrame, run_seq: int, run_date: dt.date) -> DataFrame:
        """Publish what earlier runs did not; a retry of the run sees the same earlier runs and
        replaces its own folder.  Returns the rows of this run as written."""
        chosen = select_offers(retained, self.read(before=run_seq))
        offer_rows(chosen, run_date).write.mode("overwrite").parquet(
            f"{self.root}/run_seq={run_seq}"
        )
        return self.read().filter(F.col("run_seq") == run_seq)


class StatusTables:
    """Status tables on a shared file system: a snapshot per run and table, overwritten on retry.

    A run's snapshots count once its commit is written, after all of them; until then, readers see
    those of the last committed run, so a run that fails between two writes changes nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def last_run(self, before: int = 1 << 62) -> int | None:
        try:
            commits = self.spark.read.schema("run_seq bigint").parquet(f"{self.root}/commits")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None
        return commits.filter(F.col("run_seq") < before).agg(F.max("run_seq")).first()[0]

    def read(self, name: str, ddl: str, before: int = 1 << 62) -> DataFrame:
        """The table as the last committed run before `before` left it; empty if none did."""
        run = self.last_run(before)
        if run is None:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(f"{self.root}/{name}/run_seq={run}")

    def write(self, name: str, df: DataFrame, run_seq: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/run_seq={run_seq}")

    def commit(self, run_seq: int) -> None:
        self.spark.range(1).select(F.lit(run_seq).cast("long").alias("run_seq")).write.mode(
            "overwrite").parquet(f"{self.root}/commits/of={run_seq}")

    def update(self, retained: DataFrame, employers: DataFrame, stats: DataFrame, run_seq: int,
               run_date: dt.date) -> None:
        """Write the three tables of a run from those of the run before: employers with their
        status, the counts of statuses, and the state of the sources."""
        tracker = self.read("employers", TRACKER_DDL, run_seq)
        updated = update_employer_status(tracker, touched_employers(retained), employers, run_date)
        self.write("employers", updated.drop("changed"), run_seq)
        written = self.spark.read.schema(TRACKER_DDL).parquet(
            f"{self.root}/employers/run_seq={run_seq}")
        self.write("counts", status_counts(written), run_seq)
        self.write("sources", source_status(
            self.read("sources", SOURCES_DDL, run_seq), stats, run_date), run_seq)


def touched_employers(retained: DataFrame) -> DataFrame:
    """Names of the listed employers with a retained posting."""
    return retained.filter("employer_tier is not null").select("employer").distinct()


def update_employer_status(tracker: DataFrame, touched: DataFrame, employers: DataFrame,
                           run_date: dt.date) -> DataFrame:
    """Tracker (row_id, employer, status, last_action, next_action) with the touched employers'
    blank or first status moved on, and a column changed.  Later statuses stay as they are."""
    matched = match_employer(
        tracker.withColumnRenamed("employer", "tracked"), employers, "tracked", "row_id",
    )
    flagged = salted_join(
        matched, touched.select("employer", F.lit(True).alias("_touched")), ["employer"], "left",
        F.col("row_id"),
    )
    status = F.coalesce(normalize(F.col("status")), F.lit(""))
    changed = F.coalesce("_touched", F.lit(False)) & status.isin(OPEN_STATUSES)
    spotted = F.lit(run_date.strftime("Offre détectée le %d/%m/%Y"))
    return flagged.withColumn("changed", changed).select(
        "row_id",
        F.col("tracked").alias("employer"),
        F.when(F.col("changed"), SPOTTED).otherwise(F.col("status")).alias("status"),
        F.when(F.col("changed"), spotted).otherwise(F.col("last_action")).alias("last_action"),
        F.when(F.col("changed"), NEXT_ACTION).otherwise(F.col("next_action"))
        .alias("next_action"),
        "changed",
    )


def source_status(previous: DataFrame, stats: DataFrame, run_date: dt.date,
                  labels: dict[str, str] = defaults.LOGICAL_SOURCE_LABELS) -> DataFrame:
    """(ord, label, n, ok_label, last_ok) in fixed order.  Sources of this run get their count
    and state, and a new last_ok only when fine; the others keep their row."""
    spark = previous.sparkSession
    dim = spark.createDataFrame(
        [(i, source, label) for i, (source, label) in enumerate(labels.items())],
        "ord int, source string, label string",
    )
    run = stats.select("source", F.col("n").alias("_n"), "ok")
    old = previous.select("label", F.col("n").alias("_old_n"), "ok_label", "last_ok")
    ran = F.col("ok").isNotNull()
    # The first date of a source nobody has run yet is a dash.
    last_ok = F.coalesce("last_ok", F.lit("—"))
    return dim.join(old, "label", "left").join(run, "source", "left").select(
        "ord", "label",
        F.when(ran, F.col("_n").cast("string")).otherwise(F.coalesce("_old_n", F.lit("")))
        .alias("n"),
        F.when(ran, F.when(F.col("ok"), "OK").otherwise("NOK"))
        .otherwise(F.coalesce("ok_label", F.lit(""))).alias("ok_label"),
        F.when(F.col("ok"), _day(run_date)).otherwise(last_ok).alias("last_ok"),
    )
