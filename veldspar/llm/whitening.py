"""Embedding whitening: TSQR of the centred vectors, then one-sided Jacobi rotations of R's columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .common import common_dimension, discard, keep, table, whole

SCALE, COMPONENTS = 256, 4
#: Factors that one task stacks; the tree of factors has as many levels as that needs.
FAN_IN = 16
LONG = (1 << 63) - 1


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, directions) of a square matrix: plane rotations until its columns are orthogonal to rounding.

    Each step of a sweep rotates disjoint pairs of columns, paired as in a round robin, all at
    once. The columns' lengths are the singular values, the rotations multiplied together the
    right singular vectors; both by falling length, ties in the order of the columns.
    """
    a, d = r.astype(float).copy(), r.shape[1]
    v = np.eye(d)
    circle = list(range(d + d % 2))
    for _ in range(sweeps):
        moved = False
        for _ in range(max(1, len(circle) - 1)):
            pairs = [(x, y) for x, y in zip(circle[: len(circle) // 2], circle[::-1], strict=False) if x < d and y < d]
            circle = [circle[0], circle[-1], *circle[1:-1]] if circle else circle
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(xy) > np.finfo(float).eps * np.sqrt(xx * yy)
            if not turn.any():
                continue
            moved = True
            p, q, xx, yy, xy = p[turn], q[turn], xx[turn], yy[turn], xy[turn]
            zeta = (yy - xx) / (2 * xy)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (a, v):
                left, right = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
        if not moved:
            break
    lengths = np.sqrt((a * a).sum(0))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n of integer rows: n*x - S exactly where longs hold it, then one division."""
    if n * max(-int(x.min(initial=0)), int(x.max(initial=0))) + max(map(abs, sums), default=0) <= LONG:
        return (x * n - np.array(sums, np.int64)) / n
    return ((x.astype(object) * n - np.array(sums, object)) / n).astype(float)


def deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n*x - S)^2 over a row, exact; null where a long doesn't hold it."""
    apart = n * max(-int(x.min(initial=0)), int(x.max(initial=0))) + max(map(abs, sums), default=0)
    if apart * apart * max(1, x.shape[1]) <= LONG:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    found = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1).tolist()
    return [v if v <= LONG else None for v in found]


def _rows(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)


def tsqr(distinct: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows' QR decomposition: each partition compresses its batches to one small factor, a tree of tasks stacks FAN_IN factors at a time.

    One factor comes to the driver, dimension squared, whatever the number of rows.
    """
    d = len(sums)

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for b in batches:
            r = np.linalg.qr(np.concatenate([r, centred(_rows(b, d), n, sums)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["r"])

    def stacked(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, d))
        for own in sorted(part["r"], key=lambda v: v.tolist()):  # one result whatever the order of rows
            r = np.linalg.qr(np.concatenate([r, own.reshape(-1, d)]), mode="r")
        return pd.DataFrame({"at": [key[0]], "r": [r.ravel()]})

    parts = max(1, distinct.rdd.getNumPartitions())
    tree = distinct.select("x").mapInArrow(factors, "r array<double>").select(F.spark_partition_id().alias("at"), "r")
    while parts > 1:
        tree = tree.withColumn("at", F.floor(F.col("at") / FAN_IN).cast("int")).groupBy("at").applyInPandas(stacked, "at int, r array<double>")
        parts = -(-parts // FAN_IN)
    found = [np.array(r.r, float).reshape(-1, d) for r in tree.collect()]  # one row
    return np.linalg.qr(np.concatenate([np.zeros((d, d)), *found]), mode="r")


@dataclass
class Whitening:
    """What was learnt from the distinct vectors: their number, sums, components (columns), standard deviations and shares of the variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def white(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components, each over its standard deviation; nan where that is zero."""
        flat = np.where(self.deviations > 0, self.deviations, np.nan)
        return centred(x, self.n, self.sums) @ self.components / flat


def learn(distinct: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """From a table of distinct integer vectors ``x``. A direction in which they vary by rounding alone has standard deviation 0."""
    got = distinct.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i].cast("decimal(38,0)")).cast("decimal(38,0)").alias(f"s{i}") for i in range(dim)]).first()
    n, sums = got.n, [int(got[f"s{i}"] or 0) for i in range(dim)]
    if not n:
        return Whitening(0, sums, np.zeros((dim, 0)), np.zeros(0), np.zeros(0))
    lengths, turns = jacobi(tsqr(distinct, n, sums))
    lengths[lengths <= lengths.max(initial=0) * dim * np.finfo(float).eps] = 0
    k, trace = min(components, dim), float((lengths**2).sum())
    return Whitening(n, sums, turns[:, :k], (lengths / np.sqrt(n))[:k], (lengths**2 / trace)[:k] if trace else np.zeros(k))


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over components that vary; measured on the rows, centred first. Null without such a component."""
    on = np.flatnonzero(model.deviations > 0)
    if not len(on):
        return None
    k, d = len(on), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = model.white(_rows(b, d))[:, on]
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(k)], names=[f"w{i}" for i in range(k)])

    w = distinct.select("x").mapInArrow(run, ", ".join(f"w{i} double" for i in range(k)))
    means = w.agg(*[F.avg(f"w{i}") for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    entries = w.agg(*[F.avg((F.col(f"w{i}") - F.lit(means[i])) * (F.col(f"w{j}") - F.lit(means[j]))) for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(entries, pairs, strict=True))


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Whitening]:
    """((vec_id, component, n, deviation, whitened, explained, identity_error), model): for each kept row one row for each component, from 1.

    A component c of a vector counts as floor(scale * c). Means, components and standard deviations are
    those of the distinct vectors, of which copies count once; every row is then projected.

    Left out are null vectors and those that hold a null or non-finite entry, also vectors of
    another dimension than most. There are at most as many components as dimensions. Repeated
    rows and rows with a null id give their rows. A component without variance (all vectors
    equal, fewer vectors than components) has ``whitened`` null and ``explained`` 0; equal variances keep
    the order of their columns. Empty tables give empty results. Integers stop at the ends
    of a long; a deviation that doesn't fit a long is null. Other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vector_col), scale).alias("x")).where("x is not null")
    dim = common_dimension(own)
    rows = own.where(F.size("x") == dim) if dim else own.limit(0)
    distinct = keep(rows.select("x").distinct())
    model = learn(distinct, dim, components)
    error = identity_error(distinct, model)
    discard(distinct)
    k = model.components.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b, dim)
            white = model.white(x)
            ids, m = b.column("vec_id"), len(x)
            again = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [ids.take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(deviation(x, model.n, model.sums), pa.int64()).take(again), pa.array(white.ravel(), from_pandas=True), pa.array(np.tile(model.explained, m))],
                names=["vec_id", "component", "deviation", "whitened", "explained"],
            )

    out = rows.mapInArrow(run, "vec_id long, component int, deviation long, whitened double, explained double")
    return out.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error")), model


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``: four components."""
    return whiten(table(spark, sf_dir, "embeddings"))[0]
