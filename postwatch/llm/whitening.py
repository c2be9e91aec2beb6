"""Whitening of embeddings with a covariance weighted by how often each vector occurs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.llm.common import materialize, spread_join, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Eigenvalues under this share of the largest are noise of the sums, not variance.
LEAST_SHARE = 1e-12
LONGS = 1 << 62
WHITENED = "x array<bigint>, weight bigint, deviation decimal(38,0), whitened array<double>"
COLUMNS = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, "
           "explained double, identity_error double")


@dataclass(frozen=True)
class Fit:
    """n vectors of sum `sums`, and the columns that project a centred vector on components of
    variance one.  All of a size that only the dimension sets."""

    n: int
    sums: list[int]
    projection: np.ndarray
    explained: list[float]

    @property
    def middle(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean, as whole part and rest, so that centring whole numbers loses nothing."""
        whole = np.array([s // self.n for s in self.sums], "int64")
        return whole, np.array([s % self.n for s in self.sums], "float64") / self.n


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _columns(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    return matrix(batch.column(name)), batch.column("weight").to_numpy(zero_copy_only=False)


def _summed(name: str):
    """One row per task and dimension: the exact weighted sum of whole numbers."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch) == 0:
                continue
            x, weight = _columns(batch, name)
            small = float(np.abs(x).max(initial=0)) * float(weight.sum()) < LONGS
            part = weight @ x if small else weight.astype(object) @ x.astype(object)
            total = [a + int(b) for a, b in zip(total or [0] * x.shape[1], part)]
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total, pa.decimal128(38, 0))],
                ["dim", "total"])

    return sums


def _scattered(name: str, centre: Callable[[np.ndarray], np.ndarray]):
    """One row per task and cell of the upper triangle: weighted products of centred vectors."""
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch) == 0:
                continue
            x, weight = _columns(batch, name)
            away = centre(x)
            part = (away * weight[:, None]).T @ away
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype("int32")), pa.array(j.astype("int32")), pa.array(total[i, j])],
                ["i", "j", "value"])

    return products


def covariance(vectors: DataFrame, name: str, dims: int, n: int,
               centre: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Covariance (divisor n) of the column `name`, each row `weight` times.  Tasks multiply, Spark
    adds; the driver gets dims * (dims + 1) / 2 numbers."""
    cells = vectors.select(name, "weight").mapInArrow(
        _scattered(name, centre), "i int, j int, value double")
    found = np.zeros((dims, dims))
    for row in cells.groupBy("i", "j").agg(F.sum("value").alias("v")).collect():
        found[row["i"], row["j"]] = found[row["j"], row["i"]] = row["v"] / n
    return found


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of distinct (x array<bigint>, weight), a written table; None without vectors."""
    size = distinct.agg(F.sum("weight").alias("n"), F.min(F.size("x")).alias("least"),
                        F.max(F.size("x")).alias("most")).first()
    if not size["n"]:
        return None
    if size["least"] != size["most"]:
        raise ValueError(f"vectors of {size['least']} to {size['most']} entries in one table")
    n, dims = int(size["n"]), size["most"]
    sums = [0] * dims
    for row in distinct.mapInArrow(_summed("x"), "dim int, total decimal(38,0)").groupBy(
            "dim").agg(F.sum("total").alias("s")).collect():
        sums[row["dim"]] = int(row["s"])
    whole, rest = Fit(n, sums, np.empty(0), []).middle
    found = covariance(distinct, "x", dims, n, lambda x: (x - whole) - rest)
    values, vectors = np.linalg.eigh(found)
    order = [i for i in np.argsort(-values, kind="stable")
             if values[i] > LEAST_SHARE * max(values[-1], 0)][:components]
    axes = vectors[:, order]
    if order:
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(len(order))])
    return Fit(n, sums, axes / np.sqrt(values[order]),
               (values[order] / values.clip(0).sum()).tolist())


def _whitened(model: Fit):
    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, rest = model.middle
        left = np.array([s % model.n for s in model.sums], "int64")
        for batch in batches:
            if len(batch) == 0:
                continue
            x = matrix(batch.column("x"))
            far = float(np.abs(x - whole).max(initial=0) + 1) * model.n
            kind = "int64" if far * far * max(1, x.shape[1]) < LONGS else object
            gap = model.n * (x - whole).astype(kind) - left.astype(kind)
            squares = [int(v) for v in (gap * gap).sum(axis=1)]
            out = ((x - whole) - rest) @ model.projection
            values = pa.array(out.ravel())
            offsets = pa.array(np.arange(len(x) + 1, dtype="int32") * out.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("x"), batch.column("weight"),
                 pa.array(squares, pa.decimal128(38, 0)),
                 pa.ListArray.from_arrays(offsets, values)],
                ["x", "weight", "deviation", "whitened"])

    return whiten


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
           components: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """One row per row of vectors and component: vec_id, component (from 1), n, deviation,
    whitened, explained, identity_error.

    Entries become whole numbers x = floor(64 c) + 1000000.  Equal x vectors are grouped; the fit
    counts each as often as it occurs (weights="counts") or once ("one").  Each distinct vector is
    whitened once and joined back to its rows; a vector that many rows share is dealt over parts.

    Rows whose vector is null or holds null, NaN or infinite entries are dropped.  A null vec_id is
    reported as null, repeated rows are rows of their own, other columns are ignored.  Directions
    without variance are no components, so a single vector, or none, gives no rows.  Components of
    equal variance come in any order, the same for all rows.  Vectors of different lengths are an
    error.  Runs jobs.
    """
    if weights not in ("counts", "one"):
        raise ValueError(f"weights: counts or one, not {weights!r}")
    entries = F.col(embedding).cast("array<double>")
    finite = F.forall(entries, lambda c: F.coalesce(
        ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(embedding).isNotNull() & finite).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(entries, lambda c: F.floor(SCALE * c) + F.lit(SHIFT).cast("long")).alias("x"))
    rows = materialize(rows.select(
        "vec_id", "x", F.xxhash64("x").alias("_key"),
        F.monotonically_increasing_id().alias("_uid")), "whitening-rows")
    weight = F.count("*") if weights == "counts" else F.lit(1).cast("long")
    distinct = materialize(rows.groupBy("x").agg(weight.alias("weight")), "whitening-distinct")
    model = fit(distinct, components)
    if model is None or not model.explained:
        return vectors.sparkSession.createDataFrame([], COLUMNS)
    done = materialize(distinct.mapInArrow(_whitened(model), WHITENED), "whitening-done")
    error = identity_error(done, model)
    # Hashes only deal the rows: a row takes the values of the vector that equals its own.
    found = spread_join(
        rows, done.select(F.xxhash64("x").alias("_key"), F.col("x").alias("_x"), "deviation",
                          "whitened"), ["_key"], ["_uid"]).where("x = _x")
    explained = F.array(*map(F.lit, model.explained))
    return found.select(
        "vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
        "deviation", "whitened", F.get(explained, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"))


def identity_error(done: DataFrame, model: Fit) -> float:
    """Largest difference of the whitened vectors' covariance from the identity, measured on all
    of them around their own mean."""
    size = len(model.explained)
    sums = done.select("weight", F.posexplode("whitened").alias("at", "y")).groupBy("at").agg(
        F.sum(F.col("weight") * F.col("y")).alias("s")).collect()
    mean = np.zeros(size)
    for row in sums:
        mean[row["at"]] = row["s"] / model.n
    found = covariance(done, "whitened", size, model.n, lambda y: y - mean)
    return float(np.abs(found - np.eye(size)).max())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
