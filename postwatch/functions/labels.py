"""Texts shown to people: salary, age, source, contract, reason, titles from URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postwatch.plans import defaults


def salary_label(low: Column, high: Column) -> Column:
    """'40–50 k€', '40 k€+' or 'n.c.'; zero counts as unknown."""
    return (
        F.when((low != 0) & (high != 0), F.format_string("%d–%d k€", low, high))
        .when(low != 0, F.format_string("%d k€+", low))
        .otherwise("n.c.")
    )


def age_label(posted_at: Column, today: Column) -> Column:
    days = F.greatest(F.lit(0), F.datediff(today, posted_at))
    return (
        F.when(posted_at.isNull(), "récent")
        .when(days <= 1, "1 jour")
        .otherwise(F.format_string("%d jours", days))
    )


def source_label(source: Column, company: Column) -> Column:
    label = F.when(source == "careers_site", F.concat(F.lit("Site officiel "), company))
    for name, (_, text) in defaults.SOURCES.items():
        if text:
            label = label.when(source == name, text)
    return label.otherwise(source)


def logical_source(source: Column) -> Column:
    """All job boards are one logical source; unknown names stay as they are."""
    label = F.when(source.startswith("jobspy"), "jobspy")
    for name, (logical, _) in defaults.SOURCES.items():
        if logical != "jobspy":
            label = label.when(source == name, logical)
    return label.otherwise(source)


def canonical_contract(job_type: Column) -> Column:
    """Job-board employment type to contract, in this priority; anything else is unknown."""
    low = F.lower(job_type)
    return (
        F.when(low.contains("internship"), "Stage")
        .when(low.contains("temporary"), "Intérim")
        .when(low.contains("contract"), "Freelance")
    )


def match_reason(tier: Column, location: Column, location_score: Column, title_match: Column,
                 hard_skills: Column) -> Column:
    """Why a posting was kept, in one line.  An empty place keeps its comma, as published."""
    parts = F.array_compact(
        F.array(
            F.when(tier.isNotNull(), F.format_string("P%d cible", tier)),
            F.when(location_score >= 90, F.trim(F.split(location, ",")[0])),
            F.when(title_match == 100, "titre exact").when(hard_skills >= 50, "skills forts"),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("hors-liste à valider")


def url_path(url: Column) -> Column:
    """Percent-decoded path of a URL."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def title_from_slug(url: Column) -> Column:
    """Title out of the last path segment: extension and up to two leading hex or digit runs
    dropped (short words of a-f letters go too), separators to spaces, first letter raised."""
    segment = F.element_at(F.split(F.regexp_replace(url_path(url), "/+$", ""), "/"), -1)
    segment = F.regexp_replace(segment, r"\.(html?|aspx)$", "")
    segment = F.regexp_replace(segment, r"(?U)^([\da-f]{2,}-){1,2}", "")
    title = F.trim(F.translate(segment, "-_", "  "))
    return F.concat(F.upper(F.substring(title, 1, 1)), F.substring(title, 2, 1 << 30))
