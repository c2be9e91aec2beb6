"""Dispatch of landed payloads to mappers, and the union of all sources."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.functions.labels import url_host
from postwatch.functions.order import source_order
from postwatch.operators.dedup import keep_first
from postwatch.operators.filters import check_sources
from postwatch.plans import defaults
from postwatch.session import materialize, scratch_path
from postwatch.sources import pages, payloads

log = logging.getLogger(__name__)
NO_MAPPER = "none"

Mapper = Callable[[DataFrame], DataFrame]


def _flat(df: DataFrame) -> DataFrame:
    return pages.flat_pages(df.withColumnsRenamed({"careers_url": "url", "body": "html"}))


def _listing(options: pages.Listing) -> Mapper:
    return lambda df: pages.harvest_links(_flat(df), options)


def _cards(marker: str, place: str) -> Mapper:
    return lambda df: pages.harvest_containers(_flat(df), marker, place)


def _json(mapper: Mapper) -> Mapper:
    return lambda df: payloads.accepted(mapper(df))


BY_ATS: dict[str, Mapper] = {
    "smartrecruiters": _json(payloads.map_ats_smartrecruiters),
    "teamtailor": _json(payloads.map_ats_teamtailor),
    "greenhouse": _json(payloads.map_ats_greenhouse),
    "lever": _json(payloads.map_ats_lever),
    "cegid": _listing(pages.TILES),
    "ssr": _listing(pages.GENERIC),
    "blocks": _listing(pages.BLOCKS),
    "cards": _cards(defaults.CARD_MARKER, defaults.CARD_PLACE),
}


def dispatch_key(ats: Column, careers_url: Column, by_domain: dict[str, str],
                 known: list[str] = tuple(BY_ATS)) -> Column:
    """Mapper name of a landed page: the employer's ats when known, else by domain, else null."""
    host = url_host(careers_url)
    key = F.when(ats.isin(list(known)), ats)
    for domain, name in by_domain.items():
        key = key.when(host == domain, name)
    return key


def dispatch_career_pages(landed: DataFrame, by_domain: dict[str, str] | None = None,
                          mappers: dict[str, Mapper] = BY_ATS) -> tuple[DataFrame, DataFrame]:
    """(postings, skipped pages) of landed career pages: page_seq, employer, careers_url, ats,
    link_pattern, body.  A url found through several employers stays with the first.  by_domain:
    mapper by host where the ats is not known; the usual hosts unless given.

    Writes the pages once, in a folder per mapper, so that each mapper reads its own pages only
    instead of every mapper reading all of them.  Runs one job."""
    domains = defaults.CAREER_DOMAINS if by_domain is None else by_domain
    key = dispatch_key(landed.ats, landed.careers_url, domains, list(mappers))
    keyed = landed.withColumn("_mapper", F.coalesce(key, F.lit(NO_MAPPER)))
    path = scratch_path(landed.sparkSession, "bronze")
    keyed.write.partitionBy("_mapper").parquet(path)
    split = landed.sparkSession.read.schema(keyed.schema).parquet(path)
    parts = [
        mapper(split.filter(F.col("_mapper") == name).drop("_mapper", "ats"))
        for name, mapper in mappers.items()
    ]
    skipped = split.filter(F.col("_mapper") == NO_MAPPER).drop("_mapper")
    return keep_first(reduce(DataFrame.unionByName, parts), ["url"]), skipped


def union_sources(sources: dict[str, DataFrame | Callable[[], DataFrame]],
                  order: list[str] = defaults.LOGICAL_SOURCES,
                  isolate: bool = False) -> tuple[DataFrame | None, dict[str, str]]:
    """(postings of all sources in the fixed order, errors by source).

    ingest_seq gets the source's rank on top, so it orders the union.  With isolate=True each
    source is written out on its own first: one that fails is reported and left out, the others
    go on.  (Spark is lazy: without that a bad source would only fail the whole job later.)"""
    check_sources(list(sources), order)
    done, errors = [], {}
    for rank, name in enumerate(order):
        if name not in sources:
            continue
        try:
            source = sources[name]
            df = source() if callable(source) else source
            df = df.withColumn("ingest_seq", source_order(rank, F.col("ingest_seq")))
            done.append(materialize(df, f"silver-{name}") if isolate else df)
        except Exception as error:  # noqa: BLE001 - any failure of one source is reported
            if not isolate:
                raise
            log.warning("source %s failed: %s", name, error)
            errors[name] = str(error)
    return (reduce(DataFrame.unionByName, done) if done else None), errors
