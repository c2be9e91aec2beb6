"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.operators.membership import maybe_in, membership
from postwatch.operators.skew import PARTS, salted_join
from postwatch.session import materialize

#: The ASCII white space that separates words, as the text of a character class.
BLANKS = " \t\n\x0b\x0c\r"
#: Column that names rows inside operators; their inputs may have one of that name too.
ROW = "_row_number"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def spread_join(facts: DataFrame, dim: DataFrame, keys: list[str], by: list[str],
                how: str = "inner", parts: int = PARTS) -> DataFrame:
    """facts joined to dim (one row a key) when one key may hold most of the facts, which are dealt
    over parts by the columns `by`.  facts is evaluated twice: give a written table."""
    return salted_join(facts, dim, keys, how, F.struct(*by), parts)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name like `name` that docs does not have."""
    while name in docs.columns:
        name = "_" + name
    return name


def content_key(*columns: Column | str) -> Column:
    """128 bits of hashes of a row's contents, in hex.  Rows with all columns equal share it, and
    what holds for one of them holds for the others; nothing has to be written to name a row."""
    return F.concat(*[F.lpad(F.hex(h), 16, "0")
                      for h in (F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns))])


def without(docs: DataFrame, key: str, dropped: DataFrame, name: str,
            once: DataFrame | None = None) -> DataFrame:
    """Rows of docs whose `key` is not in dropped, and only one row for each key in once (tables
    with the column key), without that column.  Rows that are certainly in neither, by a filter of
    bounded size, are not shuffled."""
    special = dropped.select(key) if once is None else dropped.select(key).unionByName(
        once.select(key))
    found = materialize(membership(special, [key]), f"{name}-filter")
    kept = maybe_in(docs, [key], found).join(dropped.select(key).distinct(), key, "left_anti")
    if once is not None:
        kept = kept.dropDuplicates([key])
    return maybe_in(docs, [key], found, inside=False).unionByName(kept).drop(key)


__all__ = ["BLANKS", "PARTS", "ROW", "content_key", "fresh", "materialize", "spread_join", "table",
           "text_or_empty", "without"]
