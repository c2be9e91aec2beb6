"""Sub-scores, weighted blend, thresholds and ranking."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.functions.labels import match_reason
from postwatch.functions.numbers import round_exact
from postwatch.functions.places import location_score
from postwatch.functions.text import normalize
from postwatch.operators.filters import passes_threshold
from postwatch.operators.lexicon import lexicon_score
from postwatch.operators.match import employer_lookup, fuzzy_lookup, tier_score
from postwatch.operators.skew import dealt, salted_join
from postwatch.plans import defaults
from postwatch.session import materialize


def blend(weights: dict[str, float] = defaults.WEIGHTS) -> Column:
    """Weighted sum of the named columns in the order given, rounded to one decimal.

    Doubles on purpose: same sum and same rounding as the published scores, ties included."""
    terms = [F.lit(w) * F.col(name).cast("double") for name, w in weights.items()]
    return round_exact(reduce(add, terms), 1)


def score_location(df: DataFrame, **params) -> DataFrame:
    """Add location_score from location, remote_pct and source."""
    placed = df.withColumn("_place", F.coalesce(normalize(F.col("location")), F.lit("")))
    score = location_score(F.col("_place"), F.col("remote_pct"), F.col("source"), **params)
    return placed.withColumn("location_score", score).drop("_place")


def score_postings(
    df: DataFrame,
    employers: DataFrame,
    targets: list[str] = defaults.TARGET_TITLES,
    hard: dict[str, int] = defaults.HARD_SKILLS,
    soft: dict[str, int] = defaults.SOFT_SKILLS,
    weights: dict[str, float] = defaults.WEIGHTS,
    **location_params,
) -> DataFrame:
    """Add the five sub-scores, score, employer, employer_tier and match_reason.

    The vocabulary and place scores are a projection on the scan side; only the employer and the
    fuzzy title lookups shuffle, and they work on distinct values."""
    text = F.concat(F.col("title"), F.lit("\n"), F.coalesce("description", F.lit("")))
    named = df.withColumns({
        "company_norm": normalize(F.col("company")), "title_norm": normalize(F.col("title"))
    })
    scored = score_location(named, **location_params).withColumns(
        {"hard_skills": lexicon_score(text, hard), "soft_skills": lexicon_score(text, soft)}
    )
    # The keys of both lookups are written once, so neither repeats the other's join or the scans.
    spread = F.col("ingest_seq")
    used = materialize(dealt(named, ["company_norm", "title_norm"], spread), "score-parts")
    scored = salted_join(
        scored, employer_lookup(used, employers), ["company_norm"], "left", spread,
        used=used.select("company_norm", "_part").distinct(),
    )
    scored = salted_join(
        scored, fuzzy_lookup(used, targets), ["title_norm"], "left", spread,
        used=used.select("title_norm", "_part").distinct(),
    )
    scored = scored.withColumns({
        "title_match": F.coalesce("fuzzy", F.lit(100.0)),
        "tier_score": tier_score(F.col("employer_tier")),
    }).drop("fuzzy", "company_norm", "title_norm")
    return scored.withColumns({
        "score": blend(weights),
        "match_reason": match_reason(
            F.col("employer_tier"), F.col("location"), F.col("location_score"),
            F.col("title_match"), F.col("hard_skills"),
        ),
    })


def retain(scored: DataFrame, min_score: float = defaults.MIN_SCORE,
           min_score_tier1: float = defaults.MIN_SCORE_TIER1) -> DataFrame:
    return scored.filter(
        passes_threshold(F.col("score"), F.col("employer_tier"), min_score, min_score_tier1)
    )


def rank(df: DataFrame) -> DataFrame:
    """Best first; equal scores keep their collection order."""
    return df.orderBy(F.desc("score"), F.asc("ingest_seq"))


def top(df: DataFrame, k: int = 3) -> DataFrame:
    return rank(df).limit(k)


def rank_key() -> Column:
    """Unique value that sorts like rank()."""
    return F.struct((-F.col("score")).alias("worse"), "ingest_seq")
