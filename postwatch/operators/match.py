"""Matching of companies to an employer dimension, and of titles to target titles."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch.functions.numbers import round_exact
from postwatch.functions.places import contains_any
from postwatch.functions.text import normalize, normalize_py
from postwatch.operators.skew import dealt, salted_join
from postwatch.plans import defaults
from postwatch.session import materialize


#: Tokens of the longest phrase in the index.
PHRASE = 16


def _tokens(name: Column) -> Column:
    """Alphanumeric runs, and other characters one by one, each with the space before it."""
    return F.regexp_extract_all(name, F.lit(" ?(?:[a-z0-9]+|[^a-z0-9 ])"), F.lit(0))


def _phrases(tokens: Column, longest: int = PHRASE) -> Column:
    """Every part of a normalized name, given as _tokens, of at most `longest` tokens that stands in
    it at word boundaries.  A name that occurs at word boundaries in another has all its phrases
    there.  tokens should be a column: it is read many times."""

    def of(i: Column, n: Column) -> Column:
        first, before, after = (F.get(tokens, x) for x in (i, i - 1, i + n))
        opens = F.coalesce(first.startswith(" ") | ~before.rlike("[a-z0-9]$"), F.lit(True))
        closes = F.coalesce(~after.rlike("^[a-z0-9]"), F.lit(True))
        return F.when(opens & closes, F.ltrim(F.array_join(F.slice(tokens, i + 1, n), "")))

    size = F.size(tokens)
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(
        F.array().cast("array<int>"))
    every = F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(longest), size - i)), lambda n: of(i, n))))
    return F.array_distinct(F.filter(every, lambda p: p.isNotNull()))


def _word_match(needle: Column, text: Column) -> Column:
    """needle occurs in text with no ASCII letter or digit on either side."""
    quoted = F.regexp_replace(needle, r"([^\p{IsAlphabetic}0-9 ])", r"\\$1")
    return text.contains(needle) & F.regexp_like(
        text, F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])"))
    )


def employer_needles(employers: DataFrame) -> DataFrame:
    """Normalized names and aliases, one row each."""
    names = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return (
        employers.select("ord", "name", "tier", F.explode(names).alias("_raw"))
        .select("ord", "name", "tier", normalize(F.col("_raw")).alias("needle")).distinct()
    )


def phrase_index(names: DataFrame) -> DataFrame:
    """(phrase, and the columns of names): an inverted index of names (name, ...)."""
    cut = names.withColumn("_tokens", _tokens(F.col("name")))
    return cut.select("*", F.explode(_phrases(F.col("_tokens"))).alias("phrase")).drop("_tokens")


def _keys_of_long(index: DataFrame) -> DataFrame:
    """(name, phrase) of the names with more than PHRASE tokens: the phrase that the fewest names
    hold, of those the longest."""
    counts = index.groupBy("phrase").agg(F.count(F.lit(1)).alias("_n"))
    long = index.filter("long").select("name", "phrase")
    rarest = F.min_by("phrase", F.struct("_n", (-F.length("phrase")).alias("_l"), "phrase"))
    return salted_join(long, counts, ["phrase"], "inner", F.col("name")).groupBy("name").agg(
        rarest.alias("phrase"))


def _long_matches(names: DataFrame, index: DataFrame) -> DataFrame:
    """(name, m): companies with an employer's name of more than PHRASE tokens in them, or that are
    such a name in an employer's."""
    keyed = materialize(names.join(_keys_of_long(index), "name"), "match-long")
    inside, around = index.filter("company"), index.filter("m is not null")
    text = F.col("_text")
    needles = salted_join(
        inside.select(F.col("name").alias("_text"), "phrase"),
        keyed.filter("m is not null").select("name", "phrase", "m"), ["phrase"], "inner", text,
    ).filter(_word_match(F.col("name"), text)).select(text.alias("name"), "m")
    companies = salted_join(
        around.select(F.col("name").alias("_text"), "phrase", "m"),
        keyed.filter("company").select("name", "phrase"), ["phrase"], "inner", text,
    ).filter(_word_match(F.col("name"), text)).select("name", "m")
    return needles.unionByName(companies)


def employer_lookup(companies: DataFrame, employers: DataFrame) -> DataFrame:
    """(company_norm, employer, employer_tier) for the normalized companies that match, as a written
    table.

    A company matches an employer when one of the employer's names stands in it at word
    boundaries, or the other way round; the lowest ord wins.  All names of both sides are written
    once, and once more as an index of their phrases.  A name of at most PHRASE tokens is a phrase
    itself: it is found by equality, so common words bring nobody together.  Longer names meet on
    their rarest phrase and are compared.  A phrase that many companies hold is dealt over parts; of
    the employers with one phrase the first is chosen before the shuffle.  Runs jobs."""
    needles = employer_needles(employers).groupBy(F.col("needle").alias("name")).agg(
        F.min(F.struct("ord", F.col("name").alias("employer"), "tier")).alias("m"))
    wanted = companies.select(F.col("company_norm").alias("name"), F.lit(True).alias("company"))
    names = wanted.distinct().join(needles, "name", "full").filter("name <> ''").select(
        "name", F.coalesce("company", F.lit(False)).alias("company"), "m",
        (F.size(_tokens(F.col("name"))) > PHRASE).alias("long"))
    names = materialize(names, "match-names")  # '' has no token: no match
    index = materialize(phrase_index(names), "match-index")
    inside, around = index.filter("company"), index.filter("m is not null")

    short = names.filter("not long")
    # One row a phrase on the right; distinct names on the left, which a skew join deals out.
    within = inside.select("name", "phrase").join(
        short.filter("m is not null").select(F.col("name").alias("phrase"), "m"),
        "phrase").select("name", "m")
    holding = around.groupBy("phrase").agg(F.min("m").alias("m")).join(
        short.filter("company").select(F.col("name").alias("phrase")), "phrase").select(
        F.col("phrase").alias("name"), "m")

    found = within.unionByName(holding)
    if not names.filter("long").isEmpty():
        found = found.unionByName(_long_matches(names, index))
    return materialize(found.groupBy("name").agg(F.min("m").alias("m")).select(
        F.col("name").alias("company_norm"), F.col("m.employer").alias("employer"),
        F.col("m.tier").alias("employer_tier")), "match-found")


def match_employer(df: DataFrame, employers: DataFrame, company: str = "company",
                   spread_by: str = "ingest_seq") -> DataFrame:
    """Add employer and employer_tier (null when off the list).  Matching runs once per distinct
    company; one company may have most of the postings, so the way back is salted.  Runs jobs."""
    named = df.withColumn("company_norm", normalize(F.col(company)))
    used = materialize(dealt(named, ["company_norm"], F.col(spread_by)), "match-parts")
    return salted_join(
        named, employer_lookup(used, employers), ["company_norm"], "left", F.col(spread_by),
        used=used,
    ).drop("company_norm")


def tier_score(tier: Column, scores: dict[int, int] = defaults.TIER_SCORES,
               off_list: int = defaults.OFF_LIST_SCORE) -> Column:
    score = F.lit(off_list)
    for value, points in scores.items():
        score = F.when(tier == value, points).otherwise(score)
    return score


def matched_characters(title: str, target: str) -> int:
    """Characters in the matching blocks of Ratcliff and Obershelp: the longest common part, of
    equal ones the first in the title and then in the target, and the same left and right of it."""
    a, b = (np.array([ord(c) for c in text], "int64") for text in (title, target))
    total, open_parts = 0, [(0, len(a), 0, len(b))]
    while open_parts:
        a_from, a_to, b_from, b_to = open_parts.pop()
        part, best, ends = b[b_from:b_to], 0, (0, 0)
        runs = np.zeros(b_to - b_from + 1, "int64")  # length of the common part that ends here
        for i in range(a_from, a_to):
            runs[1:] = np.where(part == a[i], runs[:-1] + 1, 0)
            longest = int(runs.max())
            if longest > best:
                best, ends = longest, (i + 1, b_from + int(runs.argmax()))
        if best:
            total += best
            open_parts += [(a_from, ends[0] - best, b_from, ends[1] - best),
                           (ends[0], a_to, ends[1], b_to)]
    return total


@F.pandas_udf(T.DoubleType())
def similarity(titles: pd.Series, targets: pd.Series) -> pd.Series:
    """Twice the matched characters by those of both."""
    return pd.Series([2.0 * matched_characters(a, b) / (len(a) + len(b)) if a or b else 1.0
                      for a, b in zip(titles, targets)], dtype="float64")


def most_similarity(title: Column, targets: list[str]) -> Column:
    """Per target (most, target): the similarity if all characters that the two share, each as often
    as the rarer side has it, were matched.  No pair is more similar than that."""
    rows = F.array(*[F.struct(
        F.lit(t).alias("target"), F.lit(len(t)).alias("size"),
        F.array(*[F.struct(F.lit(c).alias("c"), F.lit(n).alias("n"))
                  for c, n in sorted(Counter(t).items())]).alias("chars")) for t in targets])
    held = lambda x: F.length(title) - F.length(F.replace(title, x["c"], F.lit("")))
    shared = lambda t: F.aggregate(
        t["chars"], F.lit(0), lambda total, x: total + F.least(x["n"], held(x)))
    return F.transform(rows, lambda t: F.struct(
        (2.0 * shared(t) / (F.length(title) + t["size"])).alias("most"),
        t["target"].alias("target")))


def clean_targets(targets: list[str]) -> list[str]:
    """Normalized targets.  One that normalizes to nothing would match every title: dropped."""
    return sorted({t for t in map(normalize_py, targets) if t})


def fuzzy_pairs(titles: DataFrame, targets: list[str]) -> DataFrame:
    """(title_norm, first, others) per title: its similarity to the target that shares the most
    characters with it, and the targets that may be more similar still."""
    bounded = titles.withColumn("_all", most_similarity(F.col("title_norm"), targets)).withColumn(
        "_top", F.array_max("_all"))
    return bounded.withColumn("first", similarity("title_norm", "_top.target")).select(
        "title_norm", "first", F.transform(
            F.filter("_all", lambda t: (t["most"] > F.col("first"))
                     & (t["target"] != F.col("_top.target"))),
            lambda t: t["target"]).alias("others"))


def fuzzy_lookup(named: DataFrame, targets: list[str]) -> DataFrame:
    """(title_norm, fuzzy) per distinct title_norm that contains no target: its best similarity to a
    target, times 100, to one decimal.

    Pairs of a title and a target are bounded by the characters they share, in expressions.  The
    pair of the highest bound is compared first; only pairs whose bound is above that are rows
    of the second comparison.  A title stays in its partition through both."""
    wanted = clean_targets(targets)
    misses = named.select("title_norm").filter(~contains_any(F.col("title_norm"), wanted))
    # Titles are short and their comparison is not: keep as many tasks as there are shuffle
    # partitions, where AQE would pack millions of titles into one by their size.
    tasks = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt_titles = misses.distinct().repartition(tasks, "title_norm")
    if not wanted:
        return dealt_titles.withColumn("fuzzy", F.lit(0.0))
    pairs = fuzzy_pairs(dealt_titles, wanted).select(
        "title_norm", "first", F.explode_outer("others").alias("target"))
    compared = pairs.withColumn("_ratio", F.greatest("first", F.when(
        F.col("target").isNotNull(), similarity("title_norm", F.coalesce("target", F.lit(""))))))
    return compared.groupBy("title_norm").agg(
        round_exact(F.max("_ratio") * 100, 1).alias("fuzzy"))


def title_lookup(titles: DataFrame, targets: list[str]) -> DataFrame:
    """(title_norm, title_match) per distinct title: 100 when it contains a target, else the best
    similarity.  Only the titles without a target reach Python."""
    hit = contains_any(F.col("title_norm"), clean_targets(targets))
    exact = titles.select("title_norm").filter(hit).distinct()
    return exact.withColumn("title_match", F.lit(100.0)).unionByName(
        fuzzy_lookup(titles, targets).withColumnRenamed("fuzzy", "title_match")
    )


def match_titles(df: DataFrame, targets: list[str], title: str = "title",
                 spread_by: str = "ingest_seq") -> DataFrame:
    """Add title_match.  Only titles without a target are looked up, once per distinct title;
    the others find nothing there and get 100."""
    named = df.withColumn("title_norm", normalize(F.col(title)))
    return (
        salted_join(named, fuzzy_lookup(named, targets), ["title_norm"], "left",
                    F.col(spread_by))
        .withColumn("title_match", F.coalesce("fuzzy", F.lit(100.0)))
        .drop("fuzzy", "title_norm")
    )
