"""SimHash near-duplicates, found with tables of distances to pivot fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch.llm.common import (
    ROW,
    content_key,
    fresh,
    materialize,
    spread_join,
    table,
    without,
)
from postwatch.operators.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
#: Blocks of the fingerprint.  Two fingerprints at MAX_BITS agree on at least BLOCKS - MAX_BITS
#: whole blocks, so they meet under one of the keys made of that many blocks (35 keys of 27 bits).
BLOCKS = 7
#: Reference fingerprints of the distance tables: mixed multiples of an odd constant.
PIVOTS = 32
#: Fingerprints of one key that a task compares; larger keys are cut in chunks that meet in pairs.
CHUNK = 20_000
#: Hashes that are counted at a time.
COUNT_ROWS = 65_536


def pivots(count: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 42) for i in range(count)],
                    "uint64")


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of 4-word shingles, repeats counted; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z fold, only ASCII blanks split
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(SHINGLE_WORDS))) if len(words) >= SHINGLE_WORDS \
        else [words]
    hashes = (xxhash.xxh64_intdigest(b" ".join(run), 42) for run in runs)
    total, ones = max(1, len(words) - SHINGLE_WORDS + 1), np.zeros(64, "int64")
    for at in range(0, total, COUNT_ROWS):
        block = np.fromiter(hashes, "<u8", min(COUNT_ROWS, total - at))
        bits = np.unpackbits(block.view("u1").reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype="int64")
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(x) for x in texts], dtype="int64")


def block_masks(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[int]:
    """Signed masks of every choice of blocks - max_bits blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near(codes: np.ndarray, far: np.ndarray, one: int, rest: np.ndarray) -> np.ndarray:
    """Those of the rows `rest` at MAX_BITS or fewer from row `one`: by the largest difference of
    pivot distances first (triangle inequality), and of the survivors by comparing all bits."""
    for some in (slice(0, 4), slice(4, None)):
        gap = np.abs(far[rest, some] - far[one, some]).max(axis=1)
        rest = rest[gap <= MAX_BITS]
    return rest[np.bitwise_count(codes[rest] ^ codes[one]) <= MAX_BITS]


def bucket_links(codes: np.ndarray, far: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spanning links of the fingerprints of one bucket: no link is lost, and fingerprints that a
    search has reached are not compared with each other again."""
    left = np.argsort(far[:, 0], kind="stable")
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            one = reached.pop()
            keys = far[left, 0]
            lo, hi = np.searchsorted(keys, [far[one, 0] - MAX_BITS, far[one, 0] + MAX_BITS + 1])
            found = near(codes, far, one, left[lo:hi])
            if len(found):
                yield from ((one, other) for other in found)
                reached.extend(found)
                left = left[~np.isin(left, found)]


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of the buckets in a partition that is sorted by bucket."""
    points, kept = pivots(), None
    for batch in batches:
        rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
        names = rows[["key", "a", "b"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(axis=1)])
        kept = rows.iloc[starts[-1]:]  # its bucket may go on
        yield _runs(rows["fp"].to_numpy()[:starts[-1]], starts, points)
    if kept is not None and len(kept):
        yield _runs(kept["fp"].to_numpy(), np.array([0, len(kept)]), points)


def _runs(fps: np.ndarray, starts: np.ndarray, points: np.ndarray) -> pd.DataFrame:
    codes = fps.view("uint64")
    far = np.bitwise_count(codes[:, None] ^ points[None, :]).astype("int8")
    u, v = [], []
    sizes = np.diff(starts)
    twos = starts[:-1][sizes == 2]
    twos = twos[np.abs(far[twos] - far[twos + 1]).max(axis=1, initial=0) <= MAX_BITS]
    twos = twos[np.bitwise_count(codes[twos] ^ codes[twos + 1]) <= MAX_BITS]
    u.extend(twos)
    v.extend(twos + 1)
    for at in np.flatnonzero(sizes > 2):
        lo, hi = starts[at], starts[at + 1]
        for a, b in bucket_links(codes[lo:hi], far[lo:hi]):
            u.append(lo + a)
            v.append(lo + b)
    return pd.DataFrame({"u": fps[np.array(u, "int64")], "v": fps[np.array(v, "int64")]})


def near_links(fps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """fps (distinct fp) -> links u, v that connect all fingerprints at MAX_BITS or fewer bits.

    A key of more than `chunk` fingerprints is cut in chunks by a hash, and a task gets two chunks.
    """
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m)))
                     for i, m in enumerate(block_masks())])
    sized = fps.select("fp", F.explode(keys).alias("key")).selectExpr(
        "fp", "key", "count(*) OVER (PARTITION BY key) AS n").where("n > 1")
    parts = sized.withColumn("k", F.expr(f"cast(ceil(n / {chunk}) as int)")).withColumn(
        "c", F.expr("cast(pmod(xxhash64(fp), k) as int)"))
    pairs = parts.select("key", "fp", "c", F.expr("explode(sequence(0, k - 1))").alias("d")).select(
        "key", "fp", F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"))
    order = ["key", "a", "b"]
    return (pairs.repartition(*order).sortWithinPartitions(*order)
            .mapInPandas(_verified, "u long, v long"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                row: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long), component_id, and with `row`, a column of
    row numbers, that column and kept: true for one row of each component, of smallest doc_id and
    then number.

    component_id is the smallest doc_id that can be reached over fingerprints at MAX_BITS or fewer
    differing bits.  Equal fingerprints are one node; nodes meet by blocks, pairs are discarded by
    pivot distances and verified, and links become components.  A null, empty or blank text has
    fingerprint 0 and links like any other.  A null doc_id is reported but never a component's
    name, unless all of the component are null.  No rows give no rows.
    """
    number = F.col(row) if row else F.lit(0)
    rows = materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                                   fingerprints(text).alias("fp"), number.alias(ROW)), "simhash")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", ROW)).alias("rep")
    fps = materialize(rows.groupBy("fp").agg(least), "simhash-distinct")
    found = components(near_links(fps.select("fp")))
    named = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("component"))
    names = named.groupBy("component").agg(F.min("rep").alias("_first"))
    ids = spread_join(materialize(named, "simhash-named"), names, ["component"], ["fp"])
    out = spread_join(rows, ids.select("fp", "_first"), ["fp"], ["doc_id", ROW]).select(
        "doc_id", "fp", F.col("_first.doc_id").alias("component_id"), F.col(ROW),
        (F.col(ROW) == F.col("_first")[ROW]).alias("kept"))
    return out.withColumnRenamed(ROW, row) if row else out.drop(ROW, "kept")


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents", "doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: of smallest doc_id (null last), of equal ids the smallest
    in a hash of all columns, of rows that are the same in all columns any one.  Null, empty and
    blank texts have fingerprint 0 and are one component.  All columns stay as they are; no rows
    give no rows."""
    row = fresh(docs, ROW)
    keyed = docs.withColumn(row, content_key(*docs.columns))
    groups = materialize(near_groups(keyed, row=row).select(row, "kept"), "simhash-groups")
    again = groups.where("kept").groupBy(row).agg(F.count("*").alias("_n")).where("_n > 1")
    return without(keyed, row, groups.where("NOT kept"), "simhash", again)
