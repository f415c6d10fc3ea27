"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Native throughout: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SHINGLE, RADIUS, SIMILARITY = 5, 11, 0.8
#: Shingles of the benchmark that are broadcast at once; a larger benchmark is taken in several slices.
SLICE = 2_000_000
#: SimHash of an array ``s`` of longs: bit b is 1 if over half of them have it.
SIMHASH = """aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(
  CAST(2 * aggregate(s, 0, (n, h) -> n + CAST(shiftrightunsigned(h, b) & 1L AS INT)) > size(s) AS BIGINT), b))"""


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null and blank texts give an empty array."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def shingles(words: Column, n: int) -> Column:
    """Hashes of the runs of n words, repeats included; fewer words: of the whole sequence.

    ``words`` must be a column of its own, not an expression, or each run builds it again.
    """
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
    of = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(of)


def _blocks(fp: Column, radius: int) -> Column:
    """(block, value) of the radius+1 blocks, one of which two fingerprints within the radius share."""
    n = radius + 1
    edges = [64 * k // n for k in range(n + 1)]
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value")) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])


def leaks(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, similarity: float = SIMILARITY, slice_: int = SLICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, start, n_shingles, similarity): the best window of each document and item.

    A window has as many shingles as an item. Windows start where a shared shingle lines
    document and item up: a window that shares none has similarity 0.
    Each distinct window gets a SimHash; windows and items of one size meet on radius+1
    blocks of its bits, which finds every pair within ``radius``; beside them they meet on the
    item's rarest shingles, as many as weigh more than 1 - ``similarity`` of it. A pair that
    shares none of these can't be similar enough, so none is lost. Pairs are kept if their
    weighted Jaccard similarity over shingles with repeats is at least ``similarity``, a
    shingle weighing 1 over the number of items it is in.

    Items without words match nothing, items shorter than a shingle match whole texts of
    exactly those words. Null and blank texts have no window. A text is told by its id and
    hash, so repeated rows give one result, and rows with a null id are reported with it.
    An empty table on either side gives an empty result.
    """
    own = items.select("item_id", plain_words(F.col("text")).alias("words")).where("size(words) > 0").select("item_id", shingles(F.col("words"), shingle).alias("s"))
    # repeated items count once; one id with several texts is several variants
    own = own.distinct().withColumn("variant", F.xxhash64("item_id", "s"))
    own = cut(own.withColumn("n", F.size("s")).withColumn("fp", F.expr(SIMHASH)))
    exploded = own.select("item_id", "n", F.posexplode("s").alias("j", "h"))
    known = cut(exploded.groupBy("h").agg(F.collect_set(F.struct("j", "n")).alias("at"), F.countDistinct("item_id").alias("df")))
    text = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), plain_words(F.col(text_col)).alias("words"))
    text = text.select("doc_id", "text_hash", shingles(F.col("words"), shingle).alias("sh"))
    # outer: else a filter on the array's size is inferred and pushed below, where it builds the words again for each run
    each = text.select("doc_id", "text_hash", "sh", F.posexplode_outer("sh").alias("p", "h"))
    slices = max(1, -(-known.count() // slice_))
    windows = None
    for k in range(slices):
        part = known.where(F.pmod("h", F.lit(slices)) == k).select("h", "at")
        hits = each.join(F.broadcast(part), "h")  # at most SLICE shingles
        placed = hits.select("doc_id", "text_hash", "sh", "p", F.explode("at").alias("o"))
        placed = placed.withColumn("start", F.greatest(F.least(F.col("p") - F.col("o.j"), F.size("sh") - F.col("o.n")), F.lit(0)))
        found = placed.select("doc_id", "text_hash", "start", F.col("o.n").alias("n"), F.slice("sh", F.col("start") + 1, F.col("o.n")).alias("s"))
        found = found.groupBy("doc_id", "text_hash", "start", "n").agg(F.first("s").alias("s"))
        windows = found if windows is None else windows.unionByName(found)
    if slices > 1:
        windows = windows.groupBy("doc_id", "text_hash", "start", "n").agg(F.first("s").alias("s"))
    # windows of the same shingles are searched once, however many documents share the passage
    windows = cut(windows.withColumn("w", F.xxhash64("s", "n")))
    unique = cut(windows.groupBy("w", "n").agg(F.first("s").alias("s")).withColumn("fp", F.expr(SIMHASH)))
    left = unique.select("w", "n", "fp", F.explode(_blocks(F.col("fp"), radius)).alias("b")).select("w", "n", "fp", "b.*")
    right = own.select("variant", "n", F.col("fp").alias("item_fp"), F.explode(_blocks(F.col("fp"), radius)).alias("b")).select("variant", "n", "item_fp", "b.*")
    near = left.join(right, ["n", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("w", "variant")
    # an item's rarest shingles: without one of them more than 1 - similarity of its weight is missed
    heavy = own.select("variant", "n", F.explode("s").alias("h")).groupBy("variant", "n", "h").agg(F.count("*").alias("c")).join(known.select("h", "df"), "h").withColumn("weight", F.col("c") / F.col("df"))
    before = Window.partitionBy("variant").orderBy("df", "h").rowsBetween(Window.unboundedPreceding, -1)
    heavy = heavy.withColumn("ahead", F.coalesce(F.sum("weight").over(before), F.lit(0.0))).withColumn("whole", F.sum("weight").over(Window.partitionBy("variant")))
    heavy = heavy.where(F.col("ahead") <= (1 - similarity) * F.col("whole") + 1e-9).select("variant", "n", "h")
    shared = unique.select("w", "n", F.explode(F.array_distinct("s")).alias("h")).join(heavy, ["n", "h"]).select("w", "variant")
    near = near.unionByName(shared).distinct()
    # exact similarity, shingle by shingle
    a = near.join(unique.select("w", "s"), "w").select("w", "variant", F.explode("s").alias("h"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = near.join(own.select("variant", "s"), "variant").select("w", "variant", F.explode("s").alias("h"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    counts = a.unionByName(b).groupBy("w", "variant", "h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    weighed = counts.join(known.select("h", "df"), "h", "left").withColumn("weight", 1 / F.coalesce("df", F.lit(1)))
    scored = weighed.groupBy("w", "variant").agg((F.sum(F.col("weight") * F.least("a", "b")) / F.sum(F.col("weight") * F.greatest("a", "b"))).alias("similarity")).where(F.col("similarity") >= similarity)
    scored = scored.join(own.select("variant", "item_id"), "variant").drop("variant")
    best = windows.select("doc_id", "text_hash", "start", "n", "w").join(scored, "w").groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("m"))
    return best.select("doc_id", "text_hash", "item_id", (-F.col("m.back")).alias("start"), F.col("m.n").alias("n_shingles"), "m.similarity")


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``: five words, radius 11, similarity 0.8."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.col("n_shingles").cast("long").alias("n_shingles"), "similarity")
