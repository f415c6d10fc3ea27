"""Approximate nearest neighbours by multi-index hashing of learnt rotated binary codes."""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import combinations
from math import ceil, comb, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .common import cut, table

#: Bounds of what is learnt from, and of one task: vectors fitted on, indexed at once, queries at once.
SAMPLE, INDEX_ROWS, QUERY_ROWS = 8192, 4096, 2048
ROTATIONS, SUBSTRING = 2, 8
#: Bits of an indexed substring, and the probes of a table and query up to which the tables are probed.
INDEXED, PROBES = 16, 150
#: Queries whose true neighbours set the radius, and the share of them that must keep so large a share of their neighbours.
TRIED, MOST, EACH = 512, 0.95, 0.9


@dataclass
class Codes:
    """Centre, rotations (dimension x bits), the Hamming radius that is searched, and what queries are measured from (None: the centre)."""

    centre: np.ndarray
    turns: np.ndarray
    radius: int
    origin: np.ndarray | None = None

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Substrings of SUBSTRING bits, as bytes: rows x tables."""
        bits = (x - self.centre) @ self.turns > 0
        return np.packbits(bits, axis=1)  # SUBSTRING is 8

    def ask(self, x: np.ndarray) -> np.ndarray:
        """The same of queries. A shift of all rows leaves the order of inner products alone, a shift of the query doesn't."""
        return self.encode(x if self.origin is None else x - self.origin + self.centre)


def fit(x: np.ndarray, k: int, recall: float, rotations: int = ROTATIONS, rounds: int = 30, seed: int = 3) -> Codes:
    """Iterative quantisation: rotations of the principal axes that move codes closest to the vectors.

    The radius is the smallest at which the sample's own k nearest vectors, by inner
    product, are within it with probability ``recall``. Neighbours in a sample lie further
    away than those among all rows, so the radius errs on the wide side.
    """
    d = x.shape[1] if x.ndim == 2 and x.size else 1
    if len(x) < 2:
        return Codes(np.zeros(d), np.zeros((d, SUBSTRING)), SUBSTRING)
    centre = x.mean(0)
    y = x - centre
    _, axes = np.linalg.eigh(y.T @ y)
    bits = -(-d // SUBSTRING) * SUBSTRING
    rng = np.random.default_rng(seed)
    turns = []
    for _ in range(rotations):
        r, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
        v = np.zeros((len(y), bits))
        v[:, :d] = y @ axes
        for _ in range(rounds):
            b = np.where(v @ r > 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(b.T @ v)
            r = (u @ w).T
        turns.append((np.pad(axes, ((0, 0), (0, bits - d))) @ r))
    codes = Codes(centre, np.concatenate(turns, axis=1), 0)
    own = codes.encode(x)
    some = rng.choice(len(x), min(len(x), 512), replace=False)
    scores = x[some] @ x.T
    scores[np.arange(len(some)), some] = -np.inf
    near = np.argpartition(-scores, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
    apart = np.bitwise_count(own[some][:, None, :] ^ own[near]).sum(2)
    codes.radius = int(np.quantile(apart, recall, method="higher"))
    return codes


def long_words(code: np.ndarray) -> np.ndarray:
    """Codes as words of 64 bits."""
    return np.ascontiguousarray(np.pad(code, ((0, 0), (0, -code.shape[1] % 8)))).view(np.int64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each code of one block from each of another; both as words."""
    apart = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        apart += np.bitwise_count((a[:, None, w] ^ b[None, :, w]).view(np.uint64))  # of signed words it counts those of the absolute value
    return apart


def search(codes: Codes, queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) positions: the k rows of largest inner product, with ties, among all within the radius, block against block."""
    q, r = long_words(codes.ask(queries)), long_words(codes.encode(rows))
    size = np.linalg.norm(rows, axis=1) * 4 * rows.shape[1] * np.finfo(float).eps
    left, right = [], []
    for at in range(0, len(q), 128):
        part = queries[at : at + 128]
        hit = hamming(q[at : at + 128], r) <= codes.radius
        if len(rows) > k:
            score = np.where(hit, part @ rows.T, -np.inf)
            slack = np.linalg.norm(part, axis=1)[:, None] * size  # of rounding; ties at the edge are settled by the caller
            edge = np.partition(score - slack, len(rows) - k, axis=1)[:, len(rows) - k]
            hit &= ~(score + slack < edge[:, None])
        i, j = np.nonzero(hit)
        left.append(i + at)
        right.append(j)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def bounds(queries: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of queries i and rows j, less and more what rounding can make of them."""
    score = np.empty(len(i))
    for at in range(0, len(i), 4096):
        part = slice(at, at + 4096)
        score[part] = np.einsum("nd,nd->n", queries[i[part]], rows[j[part]])
    slack = np.linalg.norm(queries, axis=1)[i] * np.linalg.norm(rows, axis=1)[j] * 4 * rows.shape[1] * np.finfo(float).eps
    return np.nan_to_num(score - slack, nan=-np.inf, posinf=np.inf, neginf=-np.inf), score + slack


def radius_of(apart: list[list[int]], recall: float) -> int:
    """The smallest radius that holds so large a share of all neighbours, given their distances for each query, and for MOST queries the share EACH.

    Both shares are raised by two standard errors of so many queries: of few, all neighbours are held.
    """
    sure = lambda p: min(1.0, p + 2 * sqrt(p * (1 - p) / len(apart)))
    every = np.quantile(np.concatenate(apart), sure(recall), method="higher")
    most = np.quantile([sorted(x)[ceil(EACH * len(x)) - 1] for x in apart], sure(MOST), method="higher")
    return int(max(every, most))


def probes(radius: int, tables: int) -> list[int]:
    """Pigeonhole: of so many substrings, one of a code within the radius differs in at most radius // tables bits; the masks of these."""
    return [sum(1 << b for b in bits) for n in range(min(radius // tables, INDEXED) + 1) for bits in combinations(range(INDEXED), n)]


def n_probes(radius: int, tables: int) -> int:
    return sum(comb(INDEXED, n) for n in range(min(radius // tables, INDEXED) + 1))


def probed(codes: Codes, queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, uid): all codes within the radius, by substring tables joined on equality.

    Every code is entered in one table for each of its substrings; a query looks up the
    substrings that differ from its own in few enough bits. Work and shuffled rows are in
    proportion to what the probes return.
    """
    tables = -(-codes.turns.shape[1] // INDEXED)

    @F.pandas_udf("array<bigint>")
    def encode(v: pd.Series) -> pd.Series:
        return pd.Series(list(long_words(codes.encode(np.stack(v.to_numpy())))))

    @F.pandas_udf("array<bigint>")
    def ask(v: pd.Series) -> pd.Series:
        return pd.Series(list(long_words(codes.ask(np.stack(v.to_numpy())))))

    def keys(code: Column) -> Column:
        return F.array(*[F.shiftrightunsigned(F.get(code, F.lit(t * INDEXED // 64)), t * INDEXED % 64).bitwiseAND(F.lit((1 << INDEXED) - 1)) + (t << INDEXED) for t in range(tables)])

    masks = F.array(*[F.lit(m).cast("long") for m in probes(codes.radius, tables)])
    entered = index.select("uid", encode("v").alias("code")).select("uid", "code", F.explode(keys(F.col("code"))).alias("key"))
    asked = queries.select("query_id", ask("v").alias("own")).select("query_id", "own", F.explode(keys(F.col("own"))).alias("k"), masks.alias("m"))
    asked = asked.select("query_id", "own", "k", F.explode("m").alias("m")).select("query_id", "own", F.col("k").bitwiseXOR(F.col("m")).alias("key"))
    apart = F.aggregate(F.zip_with("own", "code", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return asked.join(entered, "key").where(apart <= codes.radius).select("query_id", "uid").distinct()


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.97, sample: int = SAMPLE, index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, by inner product.

    ``vectors`` has vec_id and embedding. Vectors that are null, empty, all zero or hold a
    null or non-finite component take no part, nor do rows with a null id or vectors of
    another dimension than most. Equal vectors are indexed once, with the k+1 smallest of
    their ids: no more of them can be among a query's k nearest, ties going to smaller ids.
    A repeated id counts once, with the least of its vectors.

    The radius is learnt from the true neighbours, among all rows, of TRIED queries drawn by a
    hash of their ids (of all queries, if they are fewer), see ``radius_of``: rows that are few
    but long, or queries unlike the rows, are no less found. All codes within it are reranked. Where the radius leaves few enough
    probes they are looked up in the tables (``probed``); where it is so wide that probes
    would return most rows, codes are measured block against block, each pair of blocks one
    group, which returns the same rows. Queries that this leaves with fewer than k rows are
    measured against all rows. Memory is bounded, and a hot vector, indexed once, makes no
    hot group.
    """
    ship(vectors.sparkSession)
    e = F.col("embedding")
    clean = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: x.cast("double")).alias("v"), is_query.alias("q"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    clean = cut(clean.where(fine).groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q")))
    sizes = clean.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("q").alias("asked")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim, n, asked = (sizes[0].d, sizes[0].n, sizes[0].asked) if sizes else (1, 0, 0)
    clean = clean.where(F.size("v") == dim)
    # the k+1 smallest ids of each vector, with sorted arrays kept short while they are merged
    salted = clean.groupBy("v", F.pmod("vec_id", F.lit(64)).alias("salt")).agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    unique = salted.groupBy("v").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    unique = cut(unique.withColumn("uid", F.col("ids")[0]))
    some = unique.orderBy(F.xxhash64("uid"), "uid").limit(sample).select("v").toPandas()
    codes = replace(fit(np.array(some["v"].tolist(), float).reshape(-1, dim), k, recall), origin=np.zeros(dim))
    queries = clean.where("q").select(F.col("vec_id").alias("query_id"), "v")
    blocks = max(1, -(-n // index_rows))

    def scanned(codes: Codes, queries: DataFrame, asked: int) -> DataFrame:
        sets = max(1, -(-asked // (query_rows * 4)))
        # keys of one type on both sides: an int and a long of equal value are dealt to different tasks
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = queries.withColumn("set", dealt("query_id", sets)).withColumn("block", every(blocks)).select("set", "block", "query_id", "v")
        right = unique.withColumn("block", dealt("uid", blocks)).withColumn("set", every(sets)).select("set", "block", "uid", "v")

        def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(r):
                return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "uid": pd.Series(dtype="int64"), "low": pd.Series(dtype="float64"), "high": pd.Series(dtype="float64")})
            x, rows = np.stack(q["v"].to_numpy()), np.stack(r["v"].to_numpy())
            found = [search(codes, x[at : at + query_rows], rows, k + 1) for at in range(0, len(x), query_rows)]
            i = np.concatenate([a + at for (a, _), at in zip(found, range(0, len(x), query_rows), strict=True)])
            j = np.concatenate([b for _, b in found])
            low, high = bounds(x, rows, i, j)
            return pd.DataFrame({"query_id": q["query_id"].to_numpy()[i], "uid": r["uid"].to_numpy()[j], "low": low, "high": high})

        met = left.groupBy("set", "block").cogroup(right.groupBy("set", "block")).applyInPandas(run, "query_id bigint, uid bigint, low double, high double")
        # of all blocks of a query, the k+1 best and what rounding leaves open
        met = met.groupBy("query_id").agg(F.collect_list(F.struct("uid", "low", "high")).alias("c"))
        edge = F.coalesce(F.get(F.sort_array(F.col("c.low"), False), F.lit(k)), F.lit(float("-inf")))
        return met.select("query_id", "c", edge.alias("edge")).select("query_id", F.explode(F.filter("c", lambda x: ~(x.high < F.col("edge")))).alias("x")).select("query_id", "x.uid")

    def ranked(pairs: DataFrame) -> DataFrame:
        ids = pairs.join(unique.select("uid", "ids", F.col("v").alias("rv")), "uid").join(queries.select("query_id", F.col("v").alias("qv")), "query_id")
        scored = ids.select("query_id", inner_product(F.col("qv"), F.col("rv")).alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        return scored.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))), 1, k).alias("best"))

    everything = replace(codes, radius=codes.turns.shape[1])

    @F.pandas_udf("int")
    def bits_apart(q: pd.Series, r: pd.Series) -> pd.Series:
        a, b = codes.ask(np.stack(q.to_numpy())), codes.encode(np.stack(r.to_numpy()))
        return pd.Series(np.bitwise_count(a ^ b).sum(1).astype(np.int32))

    if n > 1 and asked:
        tried = cut(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(TRIED))
        true = ranked(scanned(everything, tried, TRIED)).select("query_id", F.explode("best.vec_id").alias("vec_id"))
        pairs = true.join(clean.select("vec_id", F.col("v").alias("rv")), "vec_id").join(tried.withColumnRenamed("v", "qv"), "query_id")
        apart = pairs.select("query_id", bits_apart("qv", "rv").alias("apart")).groupBy("query_id").agg(F.collect_list("apart").alias("apart")).collect()  # TRIED x k numbers
        codes = replace(codes, radius=radius_of([r.apart for r in apart], recall))
    few = n_probes(codes.radius, -(-codes.turns.shape[1] // INDEXED)) <= PROBES
    best = cut(ranked(probed(codes, queries, unique) if few else scanned(codes, queries, asked)))
    full = best.where(F.size("best") >= min(k, n - 1))
    rest = cut(queries.join(full.select("query_id"), "query_id", "left_anti"))
    if n > 1 and not rest.isEmpty():
        full = full.unionByName(ranked(scanned(everything, rest, rest.count())))
    found = full.select("query_id", F.posexplode("best").alias("rank", "b"))
    return found.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``: the 20 nearest of every row whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
