"""Links between 64-bit fingerprints that differ in few bits, exactly and without pairs of all.

A scheme is a set of bit masks such that two fingerprints within the radius agree on
all bits of some mask. Fingerprints are dealt by (mask, masked value); inside such a
bucket only a spanning forest of the links is emitted, never all pairs. A bucket above
``cap`` is not searched: its members go on to a finer round, whose masks cover the bits
that the bucket leaves open, and so on until the buckets are small.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import cut

FULL = (1 << 64) - 1
MIX = np.uint64(0x9E3779B97F4A7C15)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash of consecutive groups of hashes: bits set in over half of a group.

    Eight counters of a byte are added at once in a 64-bit word; groups above 255 are summed in parts.
    """
    parts = -(-sizes // 255)
    first = np.cumsum(parts) - parts
    size = np.full(parts.sum(), 255)
    size[first + parts - 1] = sizes - 255 * (parts - 1)
    starts = np.cumsum(size) - size
    count = np.empty((len(size), 8, 8), np.uint8)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), starts)
        count[:, :, k] = lanes.view(np.uint8).reshape(-1, 8)
    total = count.reshape(-1, 64)
    if len(size) > len(sizes):
        total = np.add.reduceat(total.astype(np.int64), first, axis=0)
    return np.packbits(2 * total.astype(np.int64) > sizes[:, None], axis=1, bitorder="little").view(np.int64)[:, 0]


def covering_masks(radius: int, free: int = FULL, seed: int = 7) -> list[int]:
    """Covering LSH: 2^(radius+1)-1 masks over the bits of ``free``.

    Each free bit gets a random non-zero vector of radius+1 bits; mask v holds the bits
    whose vector has odd inner product with v. At most ``radius`` differing bits give at
    most ``radius`` linear equations, which some v other than zero solves, so that mask
    misses all of them: no pair within the radius is lost.
    """
    rng = random.Random(seed)
    bits = [i for i in range(64) if free >> i & 1]
    order = [1 + i % ((1 << (radius + 1)) - 1) for i in range(len(bits))]
    rng.shuffle(order)
    return [sum(1 << b for b, vec in zip(bits, order, strict=True) if (vec & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def block_masks(radius: int, free: int = FULL) -> list[int]:
    """Pigeonhole: radius+1 blocks of the free bits, one of which holds no difference."""
    bits = [i for i in range(64) if free >> i & 1]
    n = min(radius + 1, max(1, len(bits)))
    return [sum(1 << b for b in bits[k::n]) for k in range(n)]


def _forest(fp: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Spanning forest of the links inside one bucket: breadth first, distances in blocks."""
    left, right = [], []
    rest = np.arange(len(fp))
    if len(fp) <= 512:
        i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius, 1))
        if len(i) <= len(fp):  # sparse: the links themselves
            return ([i], [j]) if len(i) else ([], [])
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            grown = []
            for at in range(0, len(frontier), 64):
                part = frontier[at : at + 64]
                near = np.bitwise_count(fp[part][:, None] ^ fp[rest][None, :]) <= radius
                hit = near.any(0)
                if hit.any():
                    left.append(part[near[:, hit].argmax(0)])
                    right.append(rest[hit])
                    grown.append(rest[hit])
                    rest = rest[~hit]
                    if not len(rest):
                        break
            frontier = np.concatenate(grown) if grown else rest[:0]
    return left, right


def _small(fp: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside consecutive buckets of up to SMALL members, all buckets at once; a forest where they are dense."""
    of = np.repeat(np.arange(len(starts)), sizes)
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    own, left, right = fp[at].view(np.uint64), [], []
    for k in range(1, sizes.max()):
        hit = np.flatnonzero((of[k:] == of[:-k]) & (np.bitwise_count(own[k:] ^ own[:-k]) <= radius))
        left.append(hit)
        right.append(hit + k)
    i, j = np.concatenate(left), np.concatenate(right)
    dense = np.bincount(of[i], minlength=len(starts)) > sizes
    keep = ~dense[of[i]]
    yield fp[at[i[keep]]], fp[at[j[keep]]]
    for n in np.flatnonzero(dense):
        group = np.sort(fp[starts[n] : starts[n] + sizes[n]])
        for x, y in zip(*_forest(group.view(np.uint64), radius), strict=True):
            yield group[x], group[y]


SMALL = 64
LINK = pa.schema([("level", pa.int32()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _search(batches: Iterator[pa.RecordBatch], radius: int, cap: int) -> Iterator[pa.RecordBatch]:
    """Rows (level, key, fp) sorted by key: links as level -1, members of oversized buckets as they came."""
    carry: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    spilling = None  # the bucket whose rows pass on unread

    def out(level, key, a, b):
        return pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=LINK)

    def links(level, key, fp, edges):
        starts = np.flatnonzero(np.r_[True, (level[1:] != level[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[starts, len(key)])
        two = starts[sizes == 2]
        two = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius]
        edges.append((fp[two], fp[two + 1]))
        small = (sizes > 2) & (sizes <= SMALL)
        if small.any():
            edges.extend(_small(fp, starts[small], sizes[small], radius))
        for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            own = np.sort(fp[s : s + n])  # the same first member, and so the same links, in every bucket of like fingerprints
            for x, y in zip(*_forest(own.view(np.uint64), radius), strict=True):
                edges.append((own[x], own[y]))

    def flush(level, key, fp):
        edges: list = []
        links(level, key, fp, edges)
        a, b = (np.concatenate([e[i] for e in edges]) for i in (0, 1))
        if len(a):
            yield out(np.full(len(a), -1), np.zeros(len(a), np.int64), a, b)

    for batch in batches:
        level, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(level):
            continue
        if spilling is not None:
            n = int(np.argmin(np.r_[(level == spilling[0]) & (key == spilling[1]), False]))
            if n:
                yield out(level[:n], key[:n], fp[:n], fp[:n])
                level, key, fp = level[n:], key[n:], fp[n:]
            if not len(level):
                continue
            spilling = None
        if carry is not None:
            level, key, fp = (np.concatenate(x) for x in zip(carry, (level, key, fp), strict=True))
            carry = None
        last = int(np.flatnonzero(np.r_[True, (level[1:] != level[:-1]) | (key[1:] != key[:-1])])[-1])
        done = (level[:last], key[:last], fp[:last])
        if last:
            yield from flush(*done)
        if len(level) - last > cap:
            spilling = (level[last], key[last])
            yield out(level[last:], key[last:], fp[last:], fp[last:])
        else:
            carry = (level[last:], key[last:], fp[last:])
    if carry is not None:
        yield from flush(*carry)


def links(fps: DataFrame, radius: int, masks: list[int], cap: int = 8192) -> DataFrame:
    """(a, b): links whose connected components are those of all links within ``radius``.

    ``fps`` has distinct non-null fingerprints in a long column ``fp``. Every bucket of at
    most ``cap`` members yields a spanning forest; larger ones are dealt again by masks over
    the bits that their mask leaves open, until nothing is left over.
    """
    ship(fps.sparkSession)
    found = None
    level_masks = dict(enumerate(masks))
    rows = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"), F.col("fp")) for i, m in level_masks.items()])).alias("r")).select("r.*")
    bucket = F.xxhash64("level", "key").alias("key")  # one column, which sorts fastest
    while True:
        dealt = rows.select("level", bucket, "fp").repartition("key").sortWithinPartitions("key")
        result = cut(dealt.mapInArrow(lambda it: _search(it, radius, cap), "level int, key bigint, a bigint, b bigint"))
        edges = result.where("level = -1").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        over = result.where("level >= 0").select("level", "key", F.col("a").alias("fp"))
        used = [r.level for r in over.select("level").distinct().collect()]  # at most one for each mask
        if not used:
            return found.distinct()
        finer: dict[int, tuple[int, int]] = {}
        n = max(level_masks) + 1
        for lv in used:
            held = level_masks[lv]
            for m in block_masks(radius, FULL & ~held):
                finer[n] = (lv, held | m)
                n += 1
        parts = {lv: [(i, m) for i, (p, m) in finer.items() if p == lv] for lv in used}
        # a bucket whose open bits are used up holds one fingerprint and can't be above cap
        choice = F.create_map(*[x for lv, ms in parts.items() for x in (F.lit(lv), F.array(*[F.struct(F.lit(i).alias("i"), F.lit(signed(m)).alias("m")) for i, m in ms]))])
        rows = over.select("fp", F.explode(choice[F.col("level")]).alias("c")).select(F.col("c.i").alias("level"), F.col("fp").bitwiseAND(F.col("c.m")).alias("key"), "fp")
        level_masks = {i: m for i, (_, m) in finer.items()}


def bucket_links(rows: DataFrame, radius: int, cap: int = 4096) -> DataFrame:
    """(a, b): links within ``radius`` of fingerprints that share a bucket; ``rows`` has longs key and fp.

    Each bucket yields a spanning forest of its links. A bucket above ``cap`` is split in blocks
    that are searched pair by pair in tasks of their own, so none of its links is lost.
    """
    ship(rows.sparkSession)
    schema = "level int, key bigint, a bigint, b bigint"
    search = lambda df, most: cut(df.repartition("key").sortWithinPartitions("key").select(F.lit(0).alias("level"), "key", "fp").mapInArrow(lambda it: _search(it, radius, most), schema))
    result = search(rows.select("key", "fp"), cap)
    near = result.where("level = -1").select("a", "b")
    over = result.where("level = 0").select("key", F.col("a").alias("fp"))
    sizes = cut(over.groupBy("key").agg(F.ceil(F.count("*") * 2 / cap).cast("int").alias("blocks")))
    if not sizes.isEmpty():
        part = over.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        part = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        part = part.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "fp")
        near = near.unionByName(search(part, FULL).where("level = -1").select("a", "b"))
    return near.where("a <> b").distinct()
