"""Weighted vocabulary scores over texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAP = 100
_LITERAL_WORDS = re.compile(r"^\\b([^\W_]+(?: [^\W_]+)*)\\b$")
_PHRASE = re.compile(r"^\\b(\w+(?: \w+)*)\\b$")


def _present(low: Column, pattern: str) -> Column:
    """Pattern found at least once.  For plain words a substring search goes first: it rules
    most texts out at a fraction of the cost of the regex."""
    hit = low.rlike("(?U)" + pattern)
    words = _LITERAL_WORDS.match(pattern)
    return (low.contains(words[1]) & hit) if words else hit


def lexicon_score(text: Column, lexicon: dict[str, int], cap: int = CAP) -> Column:
    """Sum of the weights of the patterns present in the lower-cased text (accents kept),
    capped.  Presence, not count.  One term a pattern: for lexicons of some dozens of patterns; see
    score_lexicon for large ones."""
    low = F.lower(text)
    total = F.lit(0)
    for pattern, weight in lexicon.items():
        total = total + F.when(_present(low, pattern), weight).otherwise(0)
    return F.least(F.lit(cap), total)


def spaced_words(low: Column) -> Column:
    """The words of a lower-cased text, each with the space behind it if one space alone stands
    between it and the next word."""
    return F.regexp_extract_all(low, F.lit(r"(?U)\w+(?: (?=\w))?"), F.lit(0))


def word_runs(words: Column, lengths: list[int]) -> Column:
    """The distinct runs of so many spaced_words, with one space between words; null stands for
    runs with other separators."""
    def runs(n: int) -> Column:
        if n == 1:
            return F.transform(words, lambda w: F.rtrim(w))

        def run(w: Column, i: Column) -> Column:
            some = [w, *[F.get(words, i + k) for k in range(1, n)]]
            spaced = F.endswith(some[0], F.lit(" "))
            for one in some[1:-1]:
                spaced = spaced & F.endswith(one, F.lit(" "))
            return F.when(spaced, F.concat(*some[:-1], F.rtrim(some[-1])))

        return F.transform(words, run)

    return F.array_distinct(F.concat(*[runs(n) for n in lengths]))


def score_lexicon(df: DataFrame, text: str, lexicon: dict[str, int], out: str, key: str,
                  cap: int = CAP) -> DataFrame:
    """Add the score, for lexicons of any size; key must identify the row.

    Patterns that are a word or a phrase of words are looked up: the runs of one, two, ... words of
    a text meet them by equality, so their number does not matter and none is a regex.  Only
    patterns that are more than words are terms of a projection."""
    phrases = {m[1]: w for p, w in lexicon.items() if (m := _PHRASE.match(p))}
    other = {p: w for p, w in lexicon.items() if not _PHRASE.match(p)}
    spark = df.sparkSession
    weights = spark.createDataFrame(list(phrases.items()), "_run string, _weight int")
    lengths = sorted({p.count(" ") + 1 for p in phrases}) or [1]
    # A text's runs stand next to each other, so the partial sums leave one row per text and only
    # (key, sum) is shuffled.  The lexicon is a driver-side dict: bounded, broadcast.
    hits = (
        df.select(key, spaced_words(F.lower(text)).alias("_words"))
        .select(key, F.explode(word_runs(F.col("_words"), lengths)).alias("_run"))
        .join(F.broadcast(weights), "_run")
        .groupBy(key).agg(F.sum("_weight").alias("_hits"))
    )
    rest = lexicon_score(F.col(text), other, 1 << 30)
    return (
        df.join(hits, key, "left")
        .withColumn(out, F.least(F.lit(cap), (F.coalesce("_hits", F.lit(0)) + rest)).cast("int"))
        .drop("_hits")
    )
