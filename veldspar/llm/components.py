"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import cut

EDGE = "a bigint, b bigint, moved boolean"


def _star(batches: Iterator[pa.RecordBatch], large: bool) -> Iterator[pa.RecordBatch]:
    """Rows (v, n, moved) sorted by v, then n: the neighbours of each vertex, the smallest first, as a stream.

    Large star: larger neighbours of v move under the smallest of v and its neighbours. Small
    star: v and its neighbours, all smaller, move under the smallest of them. A vertex of
    many neighbours is never held, and repeated rows are dropped unless they moved.
    """
    last_v = last_n = low = None
    for batch in batches:
        v, n, moved = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(v):
            continue
        new = np.r_[v[0] != last_v, v[1:] != v[:-1]]
        again = ~new & np.r_[n[0] == last_n, n[1:] == n[:-1]] & ~moved
        firsts = np.where(new, n, 0)
        group = np.cumsum(new)
        lows = np.r_[0 if low is None else low, firsts[new]]
        m = lows[group]
        last_v, last_n, low = v[-1], n[-1], m[-1]
        if large:
            m = np.minimum(m, v)
            out = (n > v) & ~again
            a, b, flag = n[out], m[out], (moved | (m != v))[out]
        else:
            first = n == m
            own, rest = first & ~again, ~first & ~again
            a, b, flag = np.r_[v[own], n[rest]], np.r_[m[own], m[rest]], np.r_[moved[own], np.ones(rest.sum(), bool)]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(flag)], names=["a", "b", "moved"])


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, root) for every vertex on a link: root is the smallest id of its component.

    ``edges`` has long columns a, b. Self links and nulls are ignored; repeated links count
    once. Each round takes two shuffles and is kept in the shared folder; nothing of it
    reaches the driver but whether anything moved.
    """
    ship(edges.sparkSession)
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    for _ in range(rounds):
        ways = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("n")), F.struct(F.col("b").alias("v"), F.col("a").alias("n")))).alias("w")
        both = e.select(ways).select("w.v", "w.n", F.lit(False).alias("moved"))
        large = both.repartition("v").sortWithinPartitions("v", "n").mapInArrow(lambda it: _star(it, True), EDGE)
        small = large.repartition("a").sortWithinPartitions("a", "b").mapInArrow(lambda it: _star(it, False), EDGE)
        e = cut(small)
        if e.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
