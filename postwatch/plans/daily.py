"""The whole daily run: filter, split, enrich, score, publish, remember, report."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwatch.functions.text import fingerprint
from postwatch.operators.filters import exclude_contracts, lacks_description
from postwatch.operators.publish import OfferTable, StatusTables, touched_employers
from postwatch.operators.score import retain, score_postings
from postwatch.operators.state import SeenLog, flag_known
from postwatch.operators.stats import count_rows, daily_report, merge_rows, source_stats
from postwatch.plans import defaults
from postwatch.session import materialize
from postwatch.sources.pages import enrich_descriptions


@dataclass
class DailyRun:
    retained: DataFrame
    published: DataFrame | None
    touched: DataFrame
    stats: DataFrame
    report: DataFrame


def daily_run(
    postings: DataFrame,
    employers: DataFrame,
    seen: SeenLog,
    offers: OfferTable,
    run_seq: int,
    run_date: dt.date,
    page_texts: DataFrame | None = None,
    targets: list[str] = defaults.TARGET_TITLES,
    min_score: float = defaults.MIN_SCORE,
    min_score_tier1: float = defaults.MIN_SCORE_TIER1,
    sources: list[str] = defaults.LOGICAL_SOURCES,
    errored: list[str] | dict[str, str] = (),
    dry_run: bool = False,
    status: StatusTables | None = None,
    publication_may_fail: bool = False,
    **scoring,
) -> DailyRun:
    """Run once over collected postings.  Only numbers travel to the driver.

    Two-phase: known postings are remembered at once, new ones only after they were published,
    so a failed publication loses nothing.  All reads look at runs before this one and all
    writes replace this run's folders, so a run can be repeated any number of times.

    errored: sources that could not be collected, with the messages if a dict.  They and, with
    publication_may_fail, a failed publication are alerts in the report; the new postings of such a
    run are not remembered.  status: the status tables, which are brought up to date and committed
    as the last write of the run."""
    messages = errored if isinstance(errored, dict) else dict.fromkeys(errored, "")
    alerts = [f"{source} : collecte échouée — {text}" for source, text in messages.items()]
    kept = exclude_contracts(postings)
    kept = kept.withColumn("fingerprint", fingerprint(kept.company, kept.title))
    # Written once: everything below reads it several times.
    flagged = materialize(flag_known(kept, seen.keys(before=run_seq),
                                     filter_of_seen=seen.seen_filter(before=run_seq)), "flagged")
    known, new = flagged.filter("is_known"), flagged.filter("not is_known")
    if not dry_run:
        seen.append(known, run_seq, run_date, "known")

    if page_texts is not None:
        lacking = lacks_description(F.col("source"), F.col("description"))
        new_full = enrich_descriptions(new.filter(lacking), page_texts).unionByName(
            new.filter(~lacking)
        )
    else:
        new_full = new
    scored = score_postings(new_full, employers, targets, **scoring)
    retained = materialize(retain(scored, min_score, min_score_tier1), "retained")

    stats = source_stats(flagged, sources, list(errored))
    published = None
    if not dry_run:
        try:
            published = offers.append(retained, run_seq, run_date)
            if status is not None:
                status.update(retained, employers, stats, run_seq, run_date)
        except Exception as error:
            if not publication_may_fail:
                raise
            published = None
            alerts.append(f"Publication échouée — {error} (nouveautés non retenues)")
        else:
            seen.append(new, run_seq, run_date, "new")
            if status is not None:
                status.commit(run_seq)

    known_flag = F.col("is_known")
    totals = [
        flagged.agg(
            F.count(F.lit(1)).alias("collected"),
            F.count_if(known_flag).alias("already_seen"),
            F.count_if(~known_flag).alias("new"),
        ),
        count_rows(retained, "retained"),
    ]
    if published is not None:
        totals.append(count_rows(published, "appended"))
    return DailyRun(
        retained=retained,
        published=published,
        touched=touched_employers(retained),
        stats=stats,
        report=daily_report(merge_rows(*totals), retained, alerts=alerts),
    )
