"""Links between sets whose Jaccard similarity is high: MinHash bands find them, whole signatures rule out chance."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import cut

_RNG = random.Random(11)
MULTIPLY = [_RNG.getrandbits(64) | 1 for _ in range(128)]
FLIP = [_RNG.getrandbits(64) for _ in range(128)]


def signatures(h: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """(groups, n) of 16 bits each: minima of n hash functions over consecutive non-empty groups of 64-bit hashes."""
    starts = np.cumsum(sizes) - sizes
    out, v = np.empty((len(sizes), n), np.uint16), np.empty_like(h)
    for k in range(n):
        np.bitwise_xor(h, np.uint64(FLIP[k]), out=v)
        v *= np.uint64(MULTIPLY[k])
        low = np.minimum.reduceat(v, starts) >> np.uint64(16)
        out[:, k] = (low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return out


def least_agreement(n: int, similarity: float) -> int:
    """Places of n in which the signatures of sets of that similarity agree but for four standard deviations."""
    return max(1, math.floor(n * similarity - 4 * math.sqrt(n * similarity * (1 - similarity))))


def _deal(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """(id, sig) to (key, id, sig) for each band of ``rows`` places; sig keeps a byte of each place."""
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            own = b.column(1).slice(at, 4096).to_pylist()
            if not own:
                continue
            ids = b.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(own), np.uint16).reshape(len(own), -1)
            short = pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())
            for k in range(sig.shape[1] // rows):
                key = np.full(len(own), k + 1, np.uint64)
                for j in range(k * rows, (k + 1) * rows):
                    key = (key ^ sig[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids, pa.int64()), short], names=["key", "id", "sig"])


def _forest(ids: np.ndarray, sig: np.ndarray, need: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links inside one bucket, breadth first."""
    out, rest = [], np.arange(len(ids))
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            i = frontier.pop()
            near = (sig[rest] == sig[i]).sum(1) >= need
            if near.any():
                hit = rest[near]
                out.append((np.full(len(hit), ids[i]), ids[hit]))
                frontier += hit.tolist()
                rest = rest[~near]
    return out


def _search(batches: Iterator[pa.RecordBatch], need: int, cap: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, sig) sorted by key: links (a, b), and members (key, a, sig) of buckets above ``cap``."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the bucket that may go on
    spilling = None

    def out(key, a, b, sig):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sig, pa.binary())], names=["key", "a", "b", "sig"])

    def found(key, ids, sig):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        two = starts[sizes == 2]
        two = two[(sig[two] == sig[two + 1]).sum(1) >= need]
        edges = [(ids[two], ids[two + 1])]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            edges += _forest(ids[s : s + n], sig[s : s + n], need)
        a, b = (np.concatenate([e[i] for e in edges]) for i in (0, 1))
        if len(a):
            yield out([None] * len(a), a, b, [None] * len(a))

    def passed(key, ids, sig):
        return out(key, ids, [None] * len(key), [x.tobytes() for x in sig])

    for b in batches:
        if not b.num_rows:
            continue
        key, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(key), -1)
        if spilling is not None:
            n = int(np.argmin(np.r_[key == spilling, False]))
            if n:
                yield passed(key[:n], ids[:n], sig[:n])
                key, ids, sig = key[n:], ids[n:], sig[n:]
            if not len(key):
                continue
            spilling = None
        held.append((key, ids, sig))
        if key[0] == key[-1] == held[0][0][0] and (cap is None or sum(len(x[0]) for x in held) <= cap):
            continue
        key, ids, sig = (np.concatenate([x[i] for x in held]) for i in range(3))
        last = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
        starts = np.flatnonzero(np.r_[True, key[:last][1:] != key[:last][:-1]]) if last else np.empty(0, int)
        if last:
            sizes = np.diff(np.r_[starts, last])
            over = np.repeat(sizes > cap, sizes) if cap is not None else np.zeros(last, bool)
            if over.any():
                yield passed(*(x[:last][over] for x in (key, ids, sig)))
            if not over.all():
                yield from found(*(x[:last][~over] for x in (key, ids, sig)))
        held = [(key[last:], ids[last:], sig[last:])]
        if cap is not None and len(key) - last > cap:
            yield passed(*held[0])
            spilling, held = key[last], []
    if held:
        yield from found(*(np.concatenate([x[i] for x in held]) for i in range(3)))


def links(sets: DataFrame, rows: int, need: int, cap: int = 4096) -> DataFrame:
    """(a, b): links of ids whose signatures share a band of ``rows`` places and agree in ``need`` places or more.

    ``sets`` has distinct ids in a long column ``id`` and signatures as binary ``sig``. Each
    bucket of a band yields a spanning forest of its links, never all pairs. A bucket above
    ``cap`` is split in blocks that are searched pair by pair in tasks of their own: none of
    its links is lost.
    """
    ship(sets.sparkSession)
    schema = "key bigint, a bigint, b bigint, sig binary"
    dealt = sets.select("id", "sig").mapInArrow(lambda it: _deal(it, rows), "key bigint, id bigint, sig binary")
    result = cut(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _search(it, need, cap), schema))
    near = result.where("key is null").select("a", "b")
    over = result.where("key is not null").select("key", F.col("a").alias("id"), "sig")
    sizes = cut(over.groupBy("key").agg(F.ceil(F.count("*") * 2 / cap).cast("int").alias("blocks")))
    if sizes.isEmpty():
        return near.distinct()
    part = over.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    part = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = part.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "id", "sig")
    more = part.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _search(it, need, None), schema)
    return near.unionByName(cut(more).select("a", "b")).distinct()
