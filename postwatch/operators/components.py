"""Connected components of a link table, without leaving the executors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwatch.operators.skew import salted_join
from postwatch.session import materialize

#: Links that a task joins before it emits their trees; bounds the task's memory.
FOREST_LINKS = 200_000


def union_find(u: Iterable[int], v: Iterable[int]) -> tuple[list[int], list[int]]:
    """Nodes that are not the smallest of their tree, and that smallest node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for a, b in zip(u, v):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    return nodes, [root(x) for x in nodes]


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), FOREST_LINKS):
            part = batch.iloc[at:at + FOREST_LINKS]
            nodes, roots = union_find(part["u"].tolist(), part["v"].tolist())
            yield pd.DataFrame({"u": np.array(nodes, "int64"), "v": np.array(roots, "int64")})


def components(links: DataFrame) -> DataFrame:
    """links (u long, v long, in any direction, repeats and loops allowed) -> node, component, the
    smallest node that can be reached; one row per linked node that is not itself the smallest.

    Each task first replaces its links by trees (union-find).  Then large and small stars take
    turns (Kiveris et al., SoCC 2014) until nothing changes: the number of rounds grows with the
    logarithm of the longest chain, and each half round is one minimum per node, combined before
    its shuffle, and one join whose hot nodes are dealt over parts.
    """
    links = links.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    trees = links.distinct().mapInPandas(_forests, "u long, v long")
    state = materialize(trees.distinct(), "stars")
    seen = _signature(state)
    while seen[0]:
        state = materialize(_small_star(materialize(_large_star(state), "stars")), "stars")
        now = _signature(state)
        if now == seen:
            break
        seen = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _signature(state: DataFrame) -> tuple:
    code = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(state.agg(F.count("*"), F.sum(code)).first())


def _large_star(state: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbourhood.  u > v."""
    both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.where("v > u")
    return salted_join(larger, least, ["u"], "inner", F.col("v")).select(
        F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(state: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    least = state.groupBy("u").agg(F.min("v").alias("m"))
    moved = salted_join(state, least, ["u"], "inner", F.col("v")).where("v <> m").select(
        F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(moved).distinct()
