"""Joins of a large table whose key may be very unevenly spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts over which the rows of one key are dealt.
PARTS = 1024


def _part(spread_by: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(spread_by), F.lit(parts)).cast("int").alias("_part")


def dealt(facts: DataFrame, keys: list[str], spread_by: Column, parts: int = PARTS) -> DataFrame:
    """(keys, _part): the parts in which each key has facts.  A key has at most `parts` rows here,
    whatever the number of its facts.  Written once, it serves several joins of the same facts."""
    return facts.select(*keys, _part(spread_by, parts)).distinct()


def salted_join(
    facts: DataFrame,
    other: DataFrame,
    keys: list[str],
    how: str,
    spread_by: Column,
    parts: int = PARTS,
    used: DataFrame | None = None,
) -> DataFrame:
    """facts join other on keys, with the rows of each key dealt over `parts` by spread_by, an
    expression over facts that varies within a key.  Same result as a plain equi-join.

    how: inner, left, left_semi or left_anti.  Rows of `other` are copied only to the parts in
    which their key has facts, so a rare key costs one copy and a common one at most `parts`.
    Null keys, which match nothing, are dealt like any other.  One plan at every size: there is no
    list of hot keys and no threshold.  used: dealt() of the same facts, keys, spread_by and parts,
    as a written table, when facts is a costly step; without it facts is evaluated twice."""
    if used is None:
        used = dealt(facts, keys, spread_by, parts)
    placed = used.join(other, keys)
    return facts.select("*", _part(spread_by, parts)).join(
        placed, [*keys, "_part"], how).drop("_part")
