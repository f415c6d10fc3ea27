"""Helpers that every operator of this subpackage uses.

Tables come in as DataFrames; extra columns are ignored by name, so a table may
carry columns that clash with the working columns made here.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only with a local master, as in tests, a
    temporary folder stands in where that is unset; a cluster without it is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="veldspar-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, kept in the shared folder: lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """As ``cut``, but a Parquet table: smaller, and later steps read the columns they need. For wide or long tables."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(kept: DataFrame) -> None:
    """Deletes a table that ``keep`` wrote and that nothing reads any more."""
    spark = kept.sparkSession
    for folder in {f.rpartition("/")[0] for f in kept.inputFiles()}:
        if folder.rpartition("/")[2].startswith("table-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as longs; null for a vector that is null or holds a null or non-finite component."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))))


def common_dimension(vectors: DataFrame, column: str = "x") -> int:
    """The dimension that most rows have, the smaller of equals; 0 without rows."""
    most = vectors.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return most.d if most else 0


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character untouched."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    """Number of words, without building them; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True where labels must not be learnt from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def running_start(df: DataFrame, group: list[str], size: str, order: list[Column], out: str, buckets: int = 256) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the rows of the group that come before.

    Rows of a group are spread over hash buckets of their order columns, so a group
    with a third of all rows is summed by many tasks; only one sum for each group and
    bucket is ordered in one place. Order: bucket, then ``order``.
    """
    from pyspark.sql import Window

    bucket = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sums = bucket.groupBy(*group, "_bucket").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    same = F.col("_bucket") == F.col("_b")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = bucket.withColumn("_within", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return summed.join(base, same).withColumn(out, F.col("_base") + F.col("_within")).drop("_bucket", "_within", "_b", "_base", *[f"_g_{g}" for g in group])
