"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, n_words, running_start, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: 1/phi as a 40-bit fraction: slot i of the schedule is the point frac(i / phi).
GOLDEN_BITS = 40
GOLDEN = round((1 << GOLDEN_BITS) * (5**0.5 - 1) / 2)
#: Slots of a schedule; a documented bound, whatever the size of the input.
SLOTS = 1 << 17


def water_fill(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Targets of ``share`` times all sizes by weight; a target stops at ``most`` times its size, the excess is dealt again."""
    left, open_, targets = share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0], [0.0] * len(sizes)
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = most * sizes[i]
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def targets_of(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): one row for each source.

    Sources in code point order, null last, weigh ``weights`` in turn. Water filling ends
    after at most as many rounds as there are distinct ratios of size to weight, so it is
    done in one ordered pass: sources in the order of size/weight fill up first.
    """
    k = len(weights)
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sums.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % k + 1).cast("int")))
    # a source is full if what is left for it, given all tighter sources are full, reaches its cap
    tight = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    after = tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = weighed.withColumn("left", F.lit(share) * F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumn("w_left", F.sum("w").over(after))
    # the level at which the others fill: that of the first source which doesn't reach its cap
    level = level.withColumn("at", F.col("left") / F.col("w_left")).withColumn("full", F.col("at") * F.col("w") >= F.lit(most) * F.col("source_size"))
    common = F.max(F.when(~F.col("full"), F.col("at"))).over(everything)  # it only falls after that source
    return level.withColumn("common", common).select("source", "source_size", F.when(F.col("full"), F.lit(most) * F.col("source_size")).otherwise(F.col("common") * F.col("w")).cast("double").alias("target"))


def schedule(spark: SparkSession, targets: DataFrame, block: int, n: int) -> DataFrame:
    """(source, rank, slot): which source each slot takes a block from, and how many it took before.

    Point frac(i/phi) of slot i falls into the cumulative weights, a source's weight being
    its target. A source gets the slots that its whole passes and the rest of its target
    need: later points of it are left out, and what the points leave short follows after the last of them.
    """
    whole = F.round("target").cast("long")
    # every whole pass over a source ends with a block that may be short
    passes, rest, size = F.floor(whole / F.col("source_size")).cast("long"), whole % F.col("source_size"), F.col("source_size")
    spans = targets.where("target > 0").withColumn("need", (passes * F.ceil(size / block) + F.ceil(rest / block)).cast("long"))
    order = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(F.lit(0))
    spans = spans.withColumn("high", F.sum("target").over(order) / F.sum("target").over(total)).withColumn("low", F.col("high") - F.col("target") / F.sum("target").over(total))
    cells = 1024
    # slots and spans meet on cells of the unit interval, not pair by pair
    point = (F.col("i") * F.lit(GOLDEN)).bitwiseAND(F.lit((1 << GOLDEN_BITS) - 1)) / F.lit(float(1 << GOLDEN_BITS))
    points = spark.range(n).withColumnRenamed("id", "i").withColumn("u", point).withColumn("cell", F.floor(F.col("u") * cells).cast("int"))
    spread = spans.withColumn("cell", F.explode(F.sequence(F.greatest(F.floor(F.col("low") * cells), F.lit(0)).cast("int"), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)).cast("int"))))
    drawn = points.join(spread, "cell").where("u >= low and u < high")
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("i")) - 1).where("rank < need").select("source", F.col("rank").cast("long").alias("rank"), F.col("i").alias("slot"))
    got = ranked.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("got"))
    short = spans.join(got, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    rest = short.select("source", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank")).select("source", "rank", (F.col("rank") + n).alias("slot"))
    return ranked.unionByName(rest)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, slots: int = SLOTS, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, text_crc32): one row for each row of ``docs``.

    Documents of a source are shuffled by a hash, laid end to end and cut into blocks of
    equally many words; slot r of a source takes block r, and starts again when all are
    taken. ``taken`` is the number of words of the document that slots take, repeats
    counted; the last slot of a source takes only what its target still lacks.

    Null and blank texts have size 0 and nothing of them is taken. A null source is a
    source like any other, the last. Ties and repeated rows keep their rows, laid one after
    the other. Where all sizes are 0, all targets are 0.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (n_words(F.col(text_col)) if size is None else size.cast("long")).alias("size"), F.xxhash64(F.col(id_col), F.lit(17)).alias("shuffle"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("tie"))
    rows = cut(rows)
    targets = cut(targets_of(rows, weights, share, most))
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    block = max(1, int(total / slots))
    plan = schedule(spark, targets, block, min(slots, int(total) + 1))
    placed = running_start(rows, ["source"], "size", [F.col("shuffle"), F.col("doc_id"), F.col("tie")], "start")
    sizes = targets.withColumnRenamed("source", "_s")
    placed = cut(placed.join(sizes, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "shuffle").withColumn("row", F.monotonically_increasing_id()))
    # slots by block: whole takes, and the words of the last take of a source
    span = sizes.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    slot = plan.join(span, F.col("source").eqNullSafe(F.col("_s"))).withColumn("block", F.col("rank") % F.col("blocks")).withColumn("pass", F.floor(F.col("rank") / F.col("blocks")))
    began = F.col("pass") * F.col("source_size") + F.col("block") * block
    slot = slot.withColumn("upto", F.least(F.lit(block).cast("double"), F.round("target") - began)).where("upto > 0")
    uses = slot.groupBy(F.col("source").alias("_s"), F.col("block").alias("_b")).agg(F.collect_list(F.col("upto").cast("long")).alias("upto"))  # at most ``most`` takes of a block
    pieces = placed.where("size > 0").select("row", "source", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    lo = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    took = F.aggregate("upto", F.lit(0).cast("long"), lambda acc, u: acc + F.greatest(F.least(u, hi) - lo, F.lit(0)).cast("long"))
    taken = pieces.join(uses, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).groupBy("row").agg(F.sum(took).alias("taken"))
    return placed.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("tie").alias("text_crc32"))


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: weights 5, 2, 1 in turn, 150% of all words."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
