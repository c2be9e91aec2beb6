"""Audit of how filters interact, by contractions of contingency tensors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.llm.common import materialize, spread_join, table, text_or_empty

NAMES = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT = 65
MAX_CAPITALS = 5
SYMBOLS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: How an axis of a tensor is contracted: rows that pass, that fail, or all of them.
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
STEPS = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def code(fails: Sequence[Column]) -> Column:
    """Place of a row in the flattened tensor: one bit a filter, the first filter the highest."""
    place = F.lit(0)
    for failed in fails:
        place = place * 2 + failed.cast("int")
    return place


def selections(names: str = NAMES) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) of every permutation of the filters, and per kind of count one selection
    (filters x 2) for each of them."""
    steps, chosen = [], {"kept": [], "removed": [], "fails": [], "alone": []}
    for order in permutations(range(len(names))):
        for step, at in enumerate(order):
            steps.append(("".join(names[i] for i in order), step + 1))
            before = [PASS if i in order[:step] else ALL for i in range(len(names))]
            for kind, others, own in (("kept", before, PASS), ("removed", before, FAIL),
                                      ("fails", [ALL] * len(names), FAIL),
                                      ("alone", [PASS] * len(names), FAIL)):
                chosen[kind].append([own if i == at else o for i, o in enumerate(others)])
    return steps, {kind: np.array(c, "int64") for kind, c in chosen.items()}


def contract(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """tensor (parts, 2, 2, ...) and selections (s, axes, 2) -> counts (parts, s)."""
    axes = chosen.shape[1]
    operands: list = [tensor, [0, *range(2, axes + 2)]]
    for axis in range(axes):
        operands += [chosen[:, axis], [1, axis + 2]]
    return np.einsum(*operands, [0, 1], optimize=True)


def audit_tensors(total: np.ndarray, good: np.ndarray, toxic: np.ndarray,
                  names: str = NAMES) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """Counts of every order and step, (parts, steps) each, from tensors (parts, 2, 2, ...)."""
    steps, chosen = selections(names)
    out = {kind: contract(total, chosen[kind]) for kind in ("kept", "removed")}
    out["redundant"] = contract(total, chosen["fails"]) - out["removed"]
    out["unique_fails"] = contract(total, chosen["alone"])
    out["good_lost"] = contract(good, chosen["removed"])
    out["toxic_lost"] = contract(toxic, chosen["removed"])
    own = np.array([names.index(order[step - 1]) for order, step in steps])
    of_filter = np.stack([out["removed"][:, own == i].sum(axis=1) for i in range(len(names))], 1)
    out["shapley"] = of_filter[:, own]
    return steps, out


def _audited(names: str):
    def audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape = (2,) * len(names)
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at:at + 256]
                tensors = np.zeros((3, len(some), 2 ** len(names)), "int64")
                for i, cells in enumerate(some["cells"]):
                    for cell in cells:
                        tensors[:, i, cell["code"]] = cell["n"], cell["good"], cell["toxic"]
                steps, out = audit_tensors(*tensors.reshape(3, len(some), *shape), names)
                yield pd.DataFrame({
                    "part": np.repeat(some["part"].to_numpy(), len(steps)),
                    "filter_order": [order for order, _ in steps] * len(some),
                    "step": np.array([step for _, step in steps] * len(some), "int32"),
                    **{name: out[name].ravel() for name in COUNTS}})

    return audit


def interactions(flagged: DataFrame, names: str = NAMES) -> DataFrame:
    """flagged (part string, code int, good boolean, toxic boolean; one row a document) -> one row
    per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley.

    Documents become one 2 x 2 x ... tensor of counts per part, combined before its shuffle; each
    count of each step contracts the tensor with pass, fail or all along every axis.  A part's
    tensor has 2 ^ filters cells whatever its rows, and parts are dealt over the cluster.
    """
    count = F.count_if
    cells = flagged.groupBy("part", "code").agg(
        F.count("*").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))
    tensors = cells.groupBy("part").agg(
        F.collect_list(F.struct("code", "n", "good", "toxic")).alias("cells"))
    return tensors.mapInPandas(_audited(names), STEPS)


def text_filters(text: Column) -> list[Column]:
    """Whether a text fails A (few words), B (few distinct words), C (capitals), D (symbols)."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return [F.size(words) < MIN_WORDS,
            100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
            100 * capitals.cast("long") > MAX_CAPITALS * F.length(text),
            F.regexp_like(text, F.lit(SYMBOLS))]


def flagged_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id",
                      text: str = "text", part: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, part, code (failures of A to E as bits), good, toxic.

    A null text counts as empty, a null part as the empty string.  E fails where any row of a
    smaller doc_id has the same text (by SHA-256): rows of one doc_id do not fail each other, a
    null doc_id is larger than any other.  A document is good or toxic if any row of `labels` with
    its doc_id says so; null and unlabelled are neither.  Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       text_or_empty(text).alias("_text"))
    rows = materialize(rows.select(
        F.monotonically_increasing_id().alias("_uid"), "doc_id", "part",
        code(text_filters(F.col("_text"))).alias("code"),
        F.unhex(F.sha2("_text", 256)).alias("digest")), "audit-documents")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("_first"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copied = spread_join(rows, firsts, ["digest"], ["_uid"]).select(
        "_uid", "doc_id", "part",
        code_with(F.col("code"), F.coalesce(F.col("doc_id") > F.col("_first"),
                                            F.col("_first").isNotNull())).alias("code"))
    marked = spread_join(rows.select("_uid", "doc_id"), marks, ["doc_id"], ["_uid"])
    no = F.lit(False)
    return copied.join(marked.select("_uid", "good", "toxic"), "_uid", "left").select(
        "doc_id", "part", "code", F.coalesce("good", no).alias("good"),
        F.coalesce("toxic", no).alias("toxic"))


def code_with(place: Column, failed: Column) -> Column:
    return place * 2 + failed.cast("int")


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 part: str = "source") -> DataFrame:
    """The five text filters audited in all 120 orders; see flagged_documents for nulls and ties.
    A part gives 600 rows; no documents give no rows."""
    return interactions(flagged_documents(docs, labels, doc_id, text, part))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents", "doc_id", "text", "source"),
                        table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')
           AS words
  FROM documents),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         {'A': len(words) < 50,
          'B': 100 * len(list_distinct(words)) < 65 * len(words),
          'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'),
          'E': doc_id > min(doc_id) OVER (PARTITION BY t)} AS f
  FROM texts LEFT JOIN marks USING (doc_id)),
cells AS (
  SELECT part, f, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic
  FROM flags GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, s FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INT AS s)),
placed AS (
  SELECT part, o, s, n, good, toxic,
         list_transform(string_split(o, ''), lambda x: CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B
           WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS fails
  FROM cells, steps),
counted AS (
  SELECT part, o, s, o[s] AS x,
         sum(CASE WHEN NOT list_bool_or(fails[1:s]) THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN fails[s] AND NOT coalesce(list_bool_or(fails[1:s - 1]), false)
             THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails[s] AND coalesce(list_bool_or(fails[1:s - 1]), false)
             THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails[s] AND len(list_filter(fails, lambda y: y)) = 1
             THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails[s] AND NOT coalesce(list_bool_or(fails[1:s - 1]), false)
             THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN fails[s] AND NOT coalesce(list_bool_or(fails[1:s - 1]), false)
             THEN toxic ELSE 0 END) AS toxic_lost
  FROM placed GROUP BY ALL)
SELECT part, o AS filter_order, s AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counted
"""
