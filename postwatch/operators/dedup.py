"""First-arrival dedup, the two-key greedy dedup and row caps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwatch.operators.skew import salted_join
from postwatch.session import discard, materialize


def keep_first(df: DataFrame, keys: list[str], order: str = "ingest_seq") -> DataFrame:
    """One row per key: the first by `order`, which must be unique within a key.

    row_number() = 1 plans as a WindowGroupLimit in front of the exchange: each task sends at
    most one row per key, however many rows the key has."""
    window = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def row_cap(
    df: DataFrame, keys: list[str], caps: dict[str, int] | int, order: list[Column],
    spread_by: str = "ingest_seq", salts: int = 64,
) -> DataFrame:
    """At most n rows per key, by `order`.  caps: one n for all, or n per value of the only key
    (values not named are not capped).

    Two levels, so that a key with most of the rows is never ranked in one task: the first n of
    every salted part first, then the first n of those."""
    if isinstance(caps, dict):
        cap = F.lit(None).cast("int")
        for value, n in caps.items():
            cap = F.when(F.col(keys[0]) == value, n).otherwise(cap)
        kept = df.withColumn("_cap", cap)
        uncapped, kept = kept.filter("_cap is null"), kept.filter("_cap is not null")
        top = max(caps.values())
    else:
        uncapped, kept, top = None, df.withColumn("_cap", F.lit(caps)), caps
    # The salt is a function of the row, so that a retried task deals the same parts.
    kept = kept.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    for part in ([*keys, "_salt"], keys):
        window = Window.partitionBy(*part).orderBy(*order)
        kept = kept.withColumn("_rn", F.row_number().over(window)).filter(
            (F.col("_rn") <= F.col("_cap")) & (F.col("_rn") <= top)
        ).drop("_rn")
    kept = kept.drop("_salt")
    return (kept if uncapped is None else kept.unionByName(uncapped)).drop("_cap")


def _digest(columns: list[Column]) -> Column:
    """128 bits for the values of a key; null is a value like any other."""
    named = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)])
    return F.unhex(F.md5(F.to_json(named, {"ignoreNullFields": "false"})))


def _places(open_rows: DataFrame, key: str) -> DataFrame:
    """(_row, _before): the first row of each key, with no row before it, and the second, with the
    first before it.  At most two rows per key leave a task."""
    window = Window.partitionBy(key).orderBy("_order")
    top = open_rows.select(key, "_order", "_row").withColumn(
        "_rn", F.row_number().over(window)).filter("_rn <= 2")
    pair = top.groupBy(key).agg(F.min_by("_row", "_rn").alias("a"), F.max_by("_row", "_rn").alias("b"))
    none = F.lit(None).cast("long")
    both = F.array(F.struct(F.col("a").alias("_row"), none.alias("_before")),
                   F.struct(F.col("b").alias("_row"), F.col("a").alias("_before")))
    return pair.select(F.inline(F.when(F.col("a") == F.col("b"), F.slice(both, 1, 1)).otherwise(both)))


def _settled(open_rows: DataFrame) -> tuple[DataFrame, int]:
    """(_row) of open rows that are accepted for certain, and the number of pointer jumps.

    A row that no other open row precedes in either group is accepted.  A row that one other row
    precedes is accepted just when that one is rejected, so such rows form chains; every jump
    doubles the length of the chain that a row has behind it."""
    second = _places(open_rows, "_k2").withColumnRenamed("_before", "_other")
    placed = _places(open_rows, "_k1").join(second, "_row").filter(
        "_before is null or _other is null")
    first = F.coalesce("_before", "_other")
    chain = placed.select("_row", F.coalesce(first, F.col("_row")).alias("_to"),
                          first.isNotNull().alias("_odd"), first.isNull().alias("_ends"))
    jumps, moved = 0, True
    chain = materialize(chain, "greedy-chain")
    while moved:
        behind = chain.select(F.col("_row").alias("_to"), F.col("_to").alias("_next"),
                              F.col("_odd").alias("_o"), F.col("_ends").alias("_e"))
        before, chain = chain, materialize(
            chain.join(behind, "_to", "left").select(
                "_row", F.coalesce("_next", "_to").alias("_to"),
                (F.col("_odd") != (F.coalesce("_o", F.lit(False)))).alias("_odd"),
                F.coalesce("_e", F.lit(False)).alias("_ends"),
                (F.coalesce("_next", "_to") != F.col("_to")).alias("_moved")), "greedy-chain")
        moved = not chain.filter("_moved").isEmpty()
        discard(before)
        jumps += 1
    return chain.filter("_ends and not _odd").select("_row"), jumps


def greedy_or_dedup(
    df: DataFrame, key1: str, key2: list[str], order: str = "ingest_seq",
) -> DataFrame:
    """Rows that a sequential pass by `order` would accept when it takes a row only if neither
    its key1 nor its key2 was accepted before.  A null key is a value like any other.

    Rounds (after Blelloch, Fineman, Shun, SPAA 2012): the first open row of both its groups cannot
    be beaten and is accepted; chains of rows that wait for one other row each are settled in the
    same round by pointer jumping; then all rows that share a key with an accepted one go.  Every
    round accepts the first open row at least, so it ends: for orders that do not depend on the keys
    after some log(n) rounds, for a chain in order after one round of log(n) jumps.  One path at all
    sizes; no task gets a group or component.  `order` must be unique and not null.  Runs jobs."""
    named = df.select(_digest([F.col(key1)]).alias("_k1"),
                      _digest([F.col(k) for k in key2]).alias("_k2"), F.col(order).alias("_order"))
    # Rows with both keys equal: only the first can win.  Combines on the map side.
    rows = materialize(named.groupBy("_k1", "_k2").agg(F.min("_order").alias("_order")).withColumn(
        "_row", F.monotonically_increasing_id()), "greedy-rows")
    open_rows, won = rows, []
    while True:
        settled, _ = _settled(open_rows)
        winners = materialize(open_rows.join(settled, "_row", "left_semi"), "greedy-won")
        won.append(winners)
        left = open_rows
        for key in ("_k1", "_k2"):
            left = salted_join(left, winners.select(key), [key], "left_anti", F.col("_row"))
        open_rows = materialize(left, "greedy-open")
        if open_rows.isEmpty():
            break
    accepted = reduce(DataFrame.unionByName, won).select(F.col("_order").alias(order))
    return df.join(accepted, order, "left_semi").select(df.columns)
