"""Exact deduplication with salted combining and full comparison of contents."""

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
from postwatch.operators.membership import maybe_in, membership

#: Parts over which the copies of one text are merged before they meet.
SALTS = 256


def squeezed(text: str) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(text_or_empty(text), BLANKS, "")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 digest: Column | None = None, salts: int = SALTS,
                 row: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest, and `row` if given.

    Texts are equal when they are identical after white space is deleted.  Of equal texts the one
    with the most code points stays, then the smallest doc_id.  Digests are counted first; a digest
    of one row is a group of one.  The texts of the others are combined within each input partition
    (partial aggregation), then over partitions that share a salt, then over salts; each time the
    grouping key holds the digest and the whole text, so a collision of digests never merges two
    texts.

    A null text counts as empty.  A null doc_id loses against any other; rows that share a doc_id
    and a text are kept or dropped together, unless `row` names a column that tells them apart: then
    the largest in it stays.  Other columns are ignored.  No rows give no rows.
    `digest` replaces SHA-256 over the column `_norm`, for tests.
    """
    number = F.col(row) if row else F.lit(0)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), squeezed(text).alias("_norm"),
                       F.length(text_or_empty(text)).alias("_n"), number.alias(ROW))
    rows = rows.withColumn("digest", F.sha2("_norm", 256) if digest is None else digest)
    members = materialize(rows.select("doc_id", "digest", ROW), "exact-members")
    repeated = members.groupBy("digest").agg(F.count("*").alias("_rows")).where("_rows > 1")
    found = materialize(membership(repeated, ["digest"]), "exact-filter")
    alone = maybe_in(members, ["digest"], found, inside=False).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "digest", ROW)

    best = F.max(F.struct("_n", (-F.col("doc_id")).alias("_neg"),
                          F.col(ROW).alias("_row"))).alias("_best")
    rows = maybe_in(rows, ["digest"], found)
    local = (rows.withColumn("_salt", F.spark_partition_id() % salts)
             .groupBy("digest", "_norm", "_salt").agg(best, F.count("*").alias("group_size")))
    merged = local.groupBy("digest", "_norm").agg(
        F.max("_best").alias("_best"), F.sum("group_size").alias("group_size"))
    # A digest of one text names it; of a digest shared by several texts the text goes along.
    texts = merged.groupBy("digest").agg(
        F.count("*").alias("_texts"), F.max("_best").alias("_best"),
        F.sum("group_size").alias("group_size"))
    out = alone.unionByName(_membership(maybe_in(members, ["digest"], found), rows, merged, texts))
    return out.withColumnRenamed(ROW, row) if row else out.drop(ROW)


def _membership(members: DataFrame, rows: DataFrame, merged: DataFrame,
                texts: DataFrame) -> DataFrame:
    keep = [(-F.col("_best._neg")).alias("keep_id"), F.col("_best._row").alias("_keep_row")]
    texts = materialize(texts, "exact-digests")
    out = spread_join(members, texts.where("_texts = 1").select("digest", *keep, "group_size"),
                      ["digest"], ["doc_id", ROW])
    shared = texts.where("_texts > 1").select("digest")
    if not shared.isEmpty():
        # Different texts with one digest: settled on the whole text.
        again = rows.join(shared, "digest", "left_semi").select(
            "doc_id", "digest", "_norm", ROW)
        winners = merged.join(shared, "digest", "left_semi").select(
            "digest", "_norm", *keep, "group_size")
        out = out.unionByName(
            spread_join(again, winners, ["digest", "_norm"], ["doc_id", ROW]).drop("_norm"))
    return out.select("doc_id", "keep_id", "group_size",
                      (F.col("doc_id").eqNullSafe(F.col("keep_id"))
                       & (F.col(ROW) == F.col("_keep_row"))).alias("kept"), "digest", ROW)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents", "doc_id", "text"))
    return groups.withColumnRenamed("digest", "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of equal texts, chosen as exact_groups does; of rows with
    equal length and doc_id, or none, the largest in a hash of all columns, of rows that are the
    same in all columns any one.  Empty and null texts are one group.  All columns stay as they
    are; no rows give no rows."""
    row = fresh(docs, ROW)
    keyed = docs.withColumn(row, content_key(*docs.columns))
    groups = materialize(exact_groups(keyed, row=row).select(row, "kept"), "exact-groups")
    again = groups.where("kept").groupBy(row).agg(F.count("*").alias("_n")).where("_n > 1")
    return without(keyed, row, groups.where("NOT kept"), "exact", again)


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) = doc_id AS kept,
       h AS text_sha256
FROM t
"""
