"""Counts per source, funnel, enrichment and zone rates, the daily report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.functions.labels import logical_source
from postwatch.functions.text import normalize, normalize_py
from postwatch.operators.filters import check_sources
from postwatch.operators.score import top
from postwatch.plans import defaults


def source_stats(df: DataFrame, selected: list[str] = defaults.LOGICAL_SOURCES,
                 errored: list[str] = (),
                 known: list[str] = defaults.LOGICAL_SOURCES) -> DataFrame:
    """(ord, source, n, ok) per selected logical source, zero for silent ones.  Counts postings
    after the contract filter."""
    check_sources(selected, known)
    dim = df.sparkSession.createDataFrame(
        [(i, s, s not in errored) for i, s in enumerate(selected)],
        "ord int, source string, ok boolean",
    )
    counts = df.groupBy(logical_source(F.col("source")).alias("source")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return dim.join(counts, "source", "left").select(
        "ord", "source", F.coalesce("n", F.lit(0)).alias("n"), "ok"
    )


def funnel(flagged: DataFrame) -> DataFrame:
    """One row of totals over postings with the flags is_known, is_retained and is_appended."""
    return flagged.agg(
        F.count(F.lit(1)).alias("collected"),
        F.count_if("is_known").alias("already_seen"),
        F.count_if(~F.col("is_known")).alias("new"),
        F.count_if("is_retained").alias("retained"),
        F.count_if("is_appended").alias("appended"),
    )


def count_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def merge_rows(*rows: DataFrame) -> DataFrame:
    """One-row tables with different columns side by side, by union instead of a join."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])


def enrichment_rate(candidates: DataFrame, description: str = "description") -> DataFrame:
    return candidates.agg(
        F.count(description).alias("enriched"), F.count(F.lit(1)).alias("candidates")
    )


def zone_rate(df: DataFrame, in_zone: Column, by: str = "employer") -> DataFrame:
    return df.groupBy(by).agg(
        F.count_if(in_zone).alias("in_zone"), F.count(F.lit(1)).alias("scanned")
    )


def status_counts(tracker: DataFrame, labels: list[str] = defaults.TRACKER_STATUSES,
                  total_label: str = "Total cibles") -> DataFrame:
    """(ord, label, n) of tracker rows with an employer, per label, zero-filled, and the total."""
    named = tracker.filter(F.trim("employer") != "")
    counts = named.groupBy(
        F.coalesce(normalize(F.col("status")), F.lit("")).alias("status_norm")
    ).agg(F.count(F.lit(1)).alias("n"))
    dim = tracker.sparkSession.createDataFrame(
        [(i, label, normalize_py(label)) for i, label in enumerate(labels)],
        "ord int, label string, status_norm string",
    )
    by_label = dim.join(counts, "status_norm", "left").select(
        "ord", "label", F.coalesce("n", F.lit(0)).alias("n")
    )
    # The total adds up the counts, so the tracker is aggregated once.
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.lit(len(labels)).alias("ord"), F.lit(total_label).alias("label"), "n"
    )
    return by_label.unionByName(total)


def sample_head(df: DataFrame, n: int = 3, chars: int = 150) -> DataFrame:
    """First n postings by arrival, long descriptions cut for display."""
    text = F.col("description")
    cut = F.when(text != "", F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)
    return df.withColumn("description", cut).orderBy("ingest_seq").limit(n)


def daily_report(totals: DataFrame, retained: DataFrame, k: int = 3,
                 alerts: list[str] = ()) -> DataFrame:
    """The funnel row with the best k postings as lines, the number of others and the alerts."""
    line = F.format_string(
        "[%5.1f] %s — %s (%s) | hard %.0f · titre %.0f · soft %.0f · loc %.0f · tier %.0f → %s | %s",
        "score", "title", "company",
        F.when(F.col("location") != "", F.col("location")).otherwise("lieu n.c."),
        *[F.bround(F.col(c).cast("double"), 0) for c in ("hard_skills", "title_match", "soft_skills",
                                             "location_score", "tier_score")],
        "match_reason", "url",
    )
    best = (
        top(retained, k)  # k rows at most
        .select(F.struct(-F.col("score"), F.col("ingest_seq"), line.alias("line")).alias("r"))
        .agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]).alias("top"))
    )
    return merge_rows(totals, best).withColumn(
        "others", F.greatest(F.lit(0), F.col("retained") - k)
    ).withColumn("alerts", F.array(*map(F.lit, alerts)).cast("array<string>"))
