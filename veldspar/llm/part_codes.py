"""Vector code compression: a codebook for each part of a vector, by weighted Lloyd rounds over distinct integer parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .common import common_dimension, discard, keep, table, whole

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: A part that more than one in so many rows share is joined by broadcast: at most HEAVY of them at a position.
HEAVY = 1000
#: Sums for so many distinct labels are broadcast; more are joined by shuffle, in SALTS shares of a label.
LABELS, SALTS = 1_000_000, 32
#: Up to here squared distances of a part of 1024 components fit a long.
EXACT = 1 << 25
LONG = (1 << 63) - 1


def assign(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, squared distance) of integer rows: the nearest entry, ties to the lower index. Exact, in Python's integers where longs are too short."""
    if len(parts) and len(book) and max(-int(parts.min(initial=0)), int(parts.max(initial=0)), -int(book.min(initial=0)), int(book.max(initial=0))) >= EXACT:
        parts, book = parts.astype(object), book.astype(object)
    best = ((parts - book[0]) ** 2).sum(1)
    code = np.zeros(len(parts), np.int64)
    for k in range(1, len(book)):
        apart = ((parts - book[k]) ** 2).sum(1)
        nearer = (apart < best).astype(bool)
        code[nearer], best[nearer] = k, apart[nearer]
    return code, best


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pos, parts and n of a batch of distinct parts."""
    n = batch.num_rows
    return batch.column("pos").to_numpy(), batch.column("part").flatten().to_numpy(zero_copy_only=False).reshape(n, -1), batch.column("n").to_numpy()


def lloyd(distinct: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (part x entry x component) after ``rounds``. A round reads the distinct parts once; only sums for each entry are shuffled and sent to the driver."""
    for _ in range(rounds):
        now = books

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, weight = np.zeros(now.shape, object), np.zeros(now.shape[:2], object)
            for b in batches:
                pos, parts, n = _columns(b)
                for p in np.unique(pos):
                    own, w = parts[pos == p], n[pos == p]
                    code, _ = assign(own, now[p])
                    # halves of numbers, so that sums of a batch stay within longs; only ``total`` needs more
                    high, low = own >> 20, own & ((1 << 20) - 1)
                    for k in np.unique(code):
                        mine, times = code == k, w[code == k]
                        weight[p, k] += int(times.sum())
                        safe = int(times.sum()) < 1 << 22 and int(np.abs(high).max(initial=0)) < 1 << 40
                        if safe:
                            total[p, k] += ((times @ high[mine]).astype(object) << 20) + (times @ low[mine]).astype(object)
                        else:
                            total[p, k] += times.astype(object) @ own[mine].astype(object)
            rows = [(int(p), int(k), int(weight[p, k]), [Decimal(int(x)) for x in total[p, k]]) for p, k in zip(*np.nonzero(weight), strict=True)]
            pos, code, n, s = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int32()), pa.array(code, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.decimal128(38)))], names=["pos", "code", "n", "total"])

        each = distinct.mapInArrow(sums, "pos int, code int, n bigint, total array<decimal(38,0)>")
        at = [F.sum(F.col("total")[i]).cast("decimal(38,0)").alias(f"t{i}") for i in range(books.shape[2])]
        books = books.copy()
        for r in each.groupBy("pos", "code").agg(F.sum("n").alias("n"), *at).collect():  # at most parts x entries rows
            books[r.pos, r.code] = [int(r[f"t{i}"]) // r.n for i in range(books.shape[2])]
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, codes, code, error, label_error, codebooks_sha256), codebooks): one row for each kept row.

    A component x counts as floor(scale * x). Equal integer parts at a position are one weighted row;
    Lloyd rounds run over those, and codes and errors are joined back to the vectors. Codebooks
    start from the vectors of the smallest ids (of equal ids, the smaller vector), at most
    ``entries``; an entry that nothing is nearest to stays. Entry means are floors of exact quotients.

    Left out are null vectors and those that hold a null or non-finite component; also vectors of
    another dimension than most, and where that isn't a multiple of ``parts`` all. Rows with a
    null id come last in the order of ids, repeated rows count as often as they stand there,
    null labels are one label. Empty tables give empty results and codebooks without entries.
    Integers stop at the ends of a long; an error that doesn't fit a long is null. Other columns
    of ``vectors``, whatever their names, are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index takes one byte")
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), whole(F.col(vector_col), scale).alias("x")).where("x is not null")
    dim = common_dimension(own)
    width = dim // parts if dim % parts == 0 else 0
    # written, so that a row's number stays
    rows = keep((own.where(F.size("x") == dim) if width else own.limit(0)).withColumn("row", F.monotonically_increasing_id()))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    if not len(first):
        empty = spark.createDataFrame([], "vec_id long, codes array<int>, code string, error long, label_error long, codebooks_sha256 string")
        return empty, books
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("x", p * width + 1, width))
    each = rows.select("row", F.posexplode(cut).alias("pos", "part"))
    distinct = keep(each.groupBy("pos", "part").agg(F.count("*").alias("n")))
    books = lloyd(distinct, books, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, own, _ = _columns(b)
            code, error = np.zeros(len(pos), np.int32), np.zeros(len(pos), object)
            for p in np.unique(pos):
                at = pos == p
                code[at], error[at] = assign(own[at], books[p])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code), pa.array([Decimal(int(e)) for e in error], pa.decimal128(38))], names=["pos", "part", "n", "code", "error"])

    codes = distinct.mapInArrow(coded, "pos int, part array<bigint>, n bigint, code int, error decimal(38,0)")
    heavy = F.col("n") * HEAVY > rows.count()
    hot = F.broadcast(codes.where(heavy).drop("n"))  # at most parts x HEAVY rows
    light = codes.where(~heavy).drop("n")
    joined = each.join(hot, ["pos", "part"]).unionByName(each.join(hot, ["pos", "part"], "left_anti").join(light, ["pos", "part"])).select("row", "pos", "code", "error")
    got = joined.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "code")))["code"].alias("codes"), F.sum("error").alias("error"))
    hexed = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    done = keep(rows.select("row", "vec_id", "label").join(got, "row").select("vec_id", "label", "codes", hexed.alias("code"), "error"))
    discard(distinct)
    discard(rows)
    long = lambda c: F.when(c <= LONG, c).cast("long")
    by_label = done.groupBy("label").agg(F.sum("error").cast("decimal(38,0)").alias("_sum"))
    n_labels = by_label.count()
    if n_labels <= LABELS:
        out = done.join(F.broadcast(by_label.withColumnRenamed("label", "_label")), F.col("label").eqNullSafe(F.col("_label")))
    else:
        salted = done.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
        shares = by_label.select(F.col("label").alias("_label"), "_sum", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_share"))
        out = salted.join(shares, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_share")))
    return out.select("vec_id", "codes", "code", long(F.col("error")).alias("error"), long(F.col("_sum")).alias("label_error"), F.lit(digest).alias("codebooks_sha256")), books


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``: 8 parts, 16 entries, 6 rounds."""
    return compress(table(spark, sf_dir, "embeddings"))[0].drop("codes")
