"""The corpus pipeline: five stages over documents, each written and read again.

Every stage takes the documents that its predecessor kept. A row that a stage doesn't
reject keeps all its columns; the last stage adds old_shard, shard and slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.llm import decontaminate, mixing, near_copies, quality, sharding
from veldspar.llm.common import cut, shared_dir, table

SHINGLE, SIMILARITY = 5, 0.8
OLD_SHARDS, SHARDS = 16, 24


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score is below the threshold go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that of the smallest id, rows without an id last."""
    found = near_copies.near_copies(docs, SHINGLE, SIMILARITY)
    rows = found.groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("n")).withColumn("rank", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    first = rows.groupBy("group").agg(F.min("rank").alias("first"))
    away = rows.join(first, "group").withColumn("stays", F.col("rank").eqNullSafe(F.col("first"))).where(~F.col("stays") | (F.col("n") > 1))
    away = cut(away.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("stays").alias("_stays")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    kept = docs.join(away, same, "left_anti")
    # of repeated rows of one id and text one stays
    again = docs.join(away.where("_stays"), same)
    again = again.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.xxhash64(*docs.columns)))).where("_nth = 1")
    return kept.unionByName(again.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    gone = found.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.xxhash64("text") == F.col("_hash")), "left_anti")


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number: 0, 1 or 2 times."""
    taken = mixing.mix(docs).where("taken > 0")
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "text_crc32").orderBy(F.col("taken").desc()))
    copies = taken.withColumn("_nth", nth).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_crc32").alias("_crc"), "_nth", F.round(F.col("taken") / F.col("size")).cast("int").alias("_copies")).where("_copies > 0")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    own = docs.withColumn("_crc32", crc).withColumn("_row", F.row_number().over(Window.partitionBy("doc_id", "source", "_crc32").orderBy(F.lit(1))))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_crc32") == F.col("_crc")) & (F.col("_row") == F.col("_nth"))
    kept = own.join(copies, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return kept.select(*docs.columns)


def resharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """From 16 shards by a hash of the id to 24 of equal bytes; adds old_shard, shard and slot."""
    placed = sharding.reshard(docs, SHARDS, sharding.hashed_shard(F.col("doc_id"), OLD_SHARDS), OLD_SHARDS)
    return sharding.attach(docs, placed)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("sharding", resharding),
]
#: SimHash, classifier training and flows are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
    return docs
