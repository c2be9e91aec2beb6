"""Row filters over postings."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.functions.labels import logical_source
from postwatch.functions.places import contains_any, in_radius, in_zone
from postwatch.functions.text import strip
from postwatch.plans import defaults


def is_excluded_contract(
    contract: Column,
    title: Column,
    vocabulary: list[str] = defaults.EXCLUDED_CONTRACTS,
    title_pattern: str = defaults.EXCLUDED_TITLE,
) -> Column:
    """The contract, or one of its words, is in the vocabulary, or the title names one.
    A missing contract or title says nothing."""
    low = F.lower(strip(F.coalesce(contract, F.lit(""))))
    words = F.array_append(F.split(low, r"(?U)[\s\x1c-\x1f]+"), low)
    listed = F.arrays_overlap(words, F.array(*map(F.lit, vocabulary)))
    return listed | F.coalesce(title, F.lit("")).rlike("(?iuU)" + title_pattern)


def exclude_contracts(df: DataFrame, vocabulary: list[str] = defaults.EXCLUDED_CONTRACTS,
                      title_pattern: str = defaults.EXCLUDED_TITLE) -> DataFrame:
    return df.filter(
        ~is_excluded_contract(df.contract_type, df.title, vocabulary, title_pattern)
    )


def zone_filter(df: DataFrame, mode: str, **params) -> DataFrame:
    """mode 'radius': columns localisable, latitude, longitude, location;
    mode 'place': columns city, postcode, remote."""
    if mode == "radius":
        return df.filter(
            in_radius(df.localisable, df.latitude, df.longitude, df.location, **params)
        )
    if mode == "place":
        return df.filter(in_zone(df.city, df.postcode, df.remote, **params))
    raise ValueError(f"unknown zone mode: {mode}")


def recency_filter(df: DataFrame, now: dt.datetime, *, days: int | None = None,
                   hours: int | None = None, column: str = "posted_at") -> DataFrame:
    """Rows dated in the last days or hours before now.  The bound is a literal, so it reaches
    the scan as a pushed filter and prunes partitions of `column`."""
    since = now - dt.timedelta(days=days or 0, hours=hours or 0)
    kind = dict(df.dtypes)[column]
    low = F.lit(since.date() if kind == "date" else since)
    high = F.lit(now.date() if kind == "date" else now)
    return df.filter((F.col(column) >= low) & (F.col(column) <= high))


def search_filter(df: DataFrame, keywords: list[str] = (), columns: tuple[str, ...] = ("title",),
                  isin: dict[str, list] | None = None) -> DataFrame:
    """Rows with any keyword in any of the columns (lower case), and each listed column in its
    list of allowed values."""
    for column, values in (isin or {}).items():
        df = df.filter(F.col(column).isin(values))
    if keywords:
        hits = [contains_any(F.lower(c), [k.lower() for k in keywords]) for c in columns]
        df = df.filter(reduce(or_, hits))
    return df


def select_sources(df: DataFrame, names: list[str],
                   known: list[str] = defaults.LOGICAL_SOURCES) -> DataFrame:
    """Rows of the chosen logical sources; an unknown name is an error."""
    check_sources(names, known)
    return df.filter(logical_source(df.source).isin(names))


def check_sources(names: list[str], known: list[str] = defaults.LOGICAL_SOURCES) -> None:
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown source: {', '.join(unknown)} (known: {', '.join(known)})")


def needs_enrichment(df: DataFrame) -> DataFrame:
    """Career-site postings without a description."""
    return df.filter(lacks_description(df.source, df.description))


def lacks_description(source: Column, description: Column) -> Column:
    return (source == "careers_site") & (F.coalesce(description, F.lit("")) == "")


def passes_threshold(score: Column, tier: Column, min_score: float = defaults.MIN_SCORE,
                     min_score_tier1: float = defaults.MIN_SCORE_TIER1) -> Column:
    """Tier 1 has a floor of its own; everybody else, tier unknown included, the general one."""
    return score >= F.when(tier == 1, min_score_tier1).otherwise(min_score)
