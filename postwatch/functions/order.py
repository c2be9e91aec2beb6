"""One collection order for all sources: source rank, landed page, place in the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places in a page, and pages of a source with their places; a source's rank comes on top.
ITEM_BITS = 20
SOURCE_BITS = 60
SOURCES = 1 << (63 - SOURCE_BITS)


def page_order(page_seq: Column, pos: Column) -> Column:
    """Order number of an item of a page, the same for every kind of page.  A page number or place
    that does not fit is an error, since it would run into another page's or source's numbers."""
    fits = page_seq.between(0, (1 << (SOURCE_BITS - ITEM_BITS)) - 1) & pos.between(
        0, (1 << ITEM_BITS) - 1)
    number = page_seq.cast("bigint") * (1 << ITEM_BITS) + pos
    return F.when(fits, number).when(
        page_seq.isNotNull() & pos.isNotNull(),
        F.raise_error(F.format_string("page %s, place %s: out of order numbers",
                                      page_seq.cast("string"), pos.cast("string"))).cast("bigint"))


def source_order(rank: int, number: Column) -> Column:
    """Order number of a row over all sources.  A number that does not fit is an error."""
    if not 0 <= rank < SOURCES:
        raise ValueError(f"source rank {rank} is not below {SOURCES}")
    fits = number.between(0, (1 << SOURCE_BITS) - 1)
    return F.when(fits, F.lit(rank << SOURCE_BITS) + number).when(
        number.isNotNull(), F.raise_error(F.format_string(
            "order number %s does not fit", number.cast("string"))).cast("bigint"))
