"""Dates out of text.  ANSI mode is on by default, so every parse is a try_ one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as the pages print them, in order.
FRENCH_MONTHS = [
    "janvier", "février", "mars", "avril", "mai", "juin",
    "juillet", "août", "septembre", "octobre", "novembre", "décembre",
]


def _try_date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return text.try_cast("date")


def iso_date(col: Column) -> Column:
    """Date in the first ten characters, null unless it is yyyy-mm-dd."""
    head = F.substring(col.cast("string"), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def french_date(col: Column) -> Column:
    """First 'd month yyyy' of the text; an unknown month or a bad day gives null, not a retry."""
    first = F.regexp_extract(
        F.lower(col), r"(?U)(\d{1,2}[\s\x1c-\x1f]+[a-zûé]+[\s\x1c-\x1f]+\d{4})", 1
    )
    parts = F.split(first, r"(?U)[\s\x1c-\x1f]+")
    month = F.array_position(F.array(*map(F.lit, FRENCH_MONTHS)), F.get(parts, F.lit(1)))
    return F.when(
        month > 0, _try_date(F.get(parts, F.lit(2)), month.cast("string"), F.get(parts, F.lit(0)))
    )


def slash_date(col: Column) -> Column:
    """First dd/mm/yyyy of the text, null when it is no date."""
    first = F.regexp_extract(col, r"(?U)\b(\d{2}/\d{2}/\d{4})\b", 1)
    parts = F.split(first, "/")
    return F.when(
        F.length(first) > 0, _try_date(parts[2], F.get(parts, F.lit(1)), parts[0])
    )


def epoch_ms_date(col: Column) -> Column:
    """Date of an epoch in milliseconds (session time zone); missing counts as zero."""
    millis = F.coalesce(col.cast("string"), F.lit("0")).try_cast("bigint")
    return F.to_date(F.timestamp_millis(millis))
