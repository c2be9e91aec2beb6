"""Quality rules: per-text counts and the frequency of lines across the documents of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.llm.common import (
    BLANKS,
    ROW,
    content_key,
    fresh,
    materialize,
    spread_join,
    table,
    text_or_empty,
    without,
)

MIN_WORDS = 10
MAX_REPEATED = 20  # percent of words in repeated windows
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: A line found in more documents of one host than this is removed.
LINE_LIMIT = 100
#: A document is depleted when less than this share of its characters is left.
MIN_LEFT = 0.2


def _let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def _chars(text: Column) -> Column:
    return F.length(F.translate(text, BLANKS, "")).cast("long")


def _repeated(words: Column) -> Column:
    """Number of words that stand in a window of WINDOW words found twice or more."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")) \
            .otherwise(_let(placed, lambda s: _let(_twins(s), _union)))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(_let(windows, covered))


def _twins(placed: Column) -> Column:
    """Sorted places of the windows whose neighbour in hash order has the same hash."""
    same = F.filter(placed, lambda x, i: (x["h"] == F.get(placed, i - 1)["h"])
                    | (x["h"] == F.get(placed, i + 1)["h"]))
    return F.array_sort(F.transform(same, lambda x: x["i"]))


def _union(starts: Column) -> Column:
    """Words in the union of the windows that start at these places."""
    steps = F.transform(starts, lambda x, i: F.least(
        F.coalesce(F.get(starts, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)


def line_key(host: Column, line: Column) -> Column:
    """Hash of a host and a line in lower case without white space; null is a host of its own."""
    return F.xxhash64(host.isNull(), host, F.lower(F.translate(line, BLANKS, "")))


def base_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
               host: str = "source", row: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, the counts of the base rules, base_failed, and `lines`, an
    array of (key, chars) of its lines that hold a word."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       (F.col(row) if row else F.lit(None).cast("int")).alias(ROW),
                       text_or_empty(text).alias("_text"), F.col(host).alias("_host"))
    parts = rows.select(
        "doc_id", ROW, "_text", "_host",
        F.filter(F.split("_text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda s: F.translate(s, BLANKS, "") != "")
        .alias("_lines"))
    text = F.col("_text")
    counted = parts.select(
        "doc_id", ROW, F.size("_words").cast("long").alias("n_words"),
        _chars(text).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("_words")).alias("n_repeat_words"),
        F.transform("_lines", lambda s: F.struct(
            line_key(F.col("_host"), s).alias("key"), _chars(s).alias("chars"))).alias("lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def frequent_lines(lines: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """Keys of lines (key, whole) in more than `limit` different documents; one count per
    (key, whole), combined before its shuffle, then one per key."""
    return (lines.groupBy("key", "whole").agg(F.lit(1).alias("_one")).groupBy("key")
            .agg(F.count("*").alias("documents")).where(F.col("documents") > limit))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  host: str = "source", limit: int = LINE_LIMIT,
                  min_left: float = MIN_LEFT, row: str | None = None) -> DataFrame:
    """One row per row of docs: the base counts, base_failed, removed_chars and kept, and the column
    `row` if one is named.

    Lines are hashed per host.  Lines in more than `limit` different documents of their host are
    removed.  Only documents that are the same as a whole (equal lines in the same order) count
    once, so that a text with many copies is left to the dedup stages.  A document that keeps less
    than `min_left` of its characters is depleted and rejected, as is one that fails a base rule.

    A null text counts as empty and fails; a null host is a host; a null doc_id is reported as null;
    repeated rows are documents of their own.  Other columns are ignored; no rows give no rows.
    """
    base = base_rules(docs, doc_id, text, host, row).withColumn(
        "uid", F.monotonically_increasing_id())
    base = materialize(base, "quality-base")
    lines = base.select("uid", F.explode("lines").alias("line"),
                        F.xxhash64("lines.key").alias("whole")).select(
        "uid", "line.key", "line.chars", "whole")
    frequent = frequent_lines(lines, limit).select("key")
    removed = spread_join(lines.select("uid", "key", "chars"), frequent, ["key"], ["uid"]).groupBy(
        "uid").agg(F.sum("chars").alias("removed_chars"))
    out = base.drop("lines").join(removed, "uid", "left").withColumn(
        "removed_chars", F.coalesce("removed_chars", F.lit(0).cast("long")))
    left = F.col("word_chars") - F.col("removed_chars")
    kept = ~F.col("base_failed") & (left >= min_left * F.col("word_chars"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", kept.alias("kept"), "removed_chars",
                      *([F.col(ROW).alias(row)] if row else []))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of docs that the rules keep, each judged for itself, also without a doc_id; repeated
    rows stay or go together.  A null text fails.  All columns stay as they are; no rows give no
    rows."""
    row = fresh(docs, ROW)
    keyed = docs.withColumn(row, content_key(*docs.columns))
    rejected = quality_rules(keyed, row=row).where("NOT kept").select(row)
    return without(keyed, row, materialize(rejected, "quality-rejected"), "quality")
