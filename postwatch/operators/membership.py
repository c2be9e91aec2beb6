"""Membership filter: a Bloom filter kept as a table of words, tested by a broadcast join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of a filter, and so the most rows that a test broadcasts (some 16 MB), whatever the
#: number of keys.  Good for about six keys a word; with more it lets more rows through.
WORDS = 1 << 20
BITS = 3


def _place(keys: list[str], words: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(words)).cast("int")


def _mask(keys: list[str]) -> Column:
    """BITS bits of one word, from another hash of the keys."""
    code = F.xxhash64(F.lit(1), *keys)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"),
                            F.shiftright(code, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
            for i in range(BITS)]
    return reduce(Column.bitwiseOR, bits)


def membership(table: DataFrame, keys: list[str], words: int = WORDS) -> DataFrame:
    """The filter of the keys in table: rows (_word, _bits), at most `words`, whatever the number of
    keys.  Combined before its shuffle; tables of words of several filters combine in the same way,
    see merged."""
    return table.select(_place(keys, words).alias("_word"), _mask(keys).alias("_bits")).groupBy(
        "_word").agg(F.bit_or("_bits").alias("_bits"))


def merged(*filters: DataFrame) -> DataFrame:
    """The filter of all keys of several filters of one size."""
    return reduce(DataFrame.unionByName, filters).groupBy("_word").agg(
        F.bit_or("_bits").alias("_bits"))


def maybe_in(df: DataFrame, keys: list[str], found: DataFrame, words: int = WORDS,
             inside: bool = True) -> DataFrame:
    """Rows of df whose keys may be in the filter (all that are, and a few others), or with
    inside=False those that are certainly not in it.  df is not shuffled: the filter is broadcast,
    and its size is bounded by `words`.  Keys are hashed as columns of the same names and types."""
    word, bits, mask = (_fresh(df, name) for name in ("_word", "_bits", "_mask"))
    test = df.withColumns({word: _place(keys, words), mask: _mask(keys)})
    got = test.join(F.broadcast(found.toDF(word, bits)), word, "left")
    held = F.coalesce(F.col(bits).bitwiseAND(F.col(mask)) == F.col(mask), F.lit(False))
    return got.where(held if inside else ~held).select(df.columns)


def _fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    while name in df.columns:
        name = "_" + name
    return name
