"""Resharding by minimum-cost flow: equal bytes in every shard, fewest bytes moved."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, running_start, table

OVERHEAD = 8
#: A document above 1/GRAIN of a shard is placed by itself; there are fewer than shards * GRAIN of them.
GRAIN = 64


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost=lambda i, j: int(i != j)) -> list[list[int]]:
    """Bytes to send from old shard i to new shard j: all supply, within capacity, at least cost.

    Successive shortest paths (Bellman-Ford by queue) on a graph whose size depends on the
    numbers of shards alone. Needs sum(capacity) >= sum(supply).
    """
    s, t = len(supply), len(capacity)
    source, sink, n = s + t, s + t + 1, s + t + 2
    room = [[0] * n for _ in range(n)]
    price = [[0] * n for _ in range(n)]
    near: list[list[int]] = [[] for _ in range(n)]

    def arc(u: int, v: int, cap: int, c: int) -> None:
        room[u][v], price[u][v], price[v][u] = cap, c, -c
        near[u].append(v)
        near[v].append(u)

    for i, x in enumerate(supply):
        arc(source, i, x, 0)
        for j in range(t):
            arc(i, s + j, x, cost(i, j))
    for j, x in enumerate(capacity):
        arc(s + j, sink, x, 0)
    while True:
        best: list[float] = [float("inf")] * n
        back = [-1] * n
        best[source], queue, inside = 0, deque([source]), [False] * n
        while queue:
            u = queue.popleft()
            inside[u] = False
            for v in near[u]:
                if room[u][v] > 0 and best[u] + price[u][v] < best[v]:
                    best[v], back[v] = best[u] + price[u][v], u
                    if not inside[v]:
                        queue.append(v)
                        inside[v] = True
        if best[sink] == float("inf"):
            return [[room[s + j][i] for j in range(t)] for i in range(s)]
        path, v = [], sink
        while v != source:
            path.append((back[v], v))
            v = back[v]
        most = min(room[u][v] for u, v in path)
        for u, v in path:
            room[u][v] -= most
            room[v][u] += most


def level_capacities(fixed: Sequence[int], small: int) -> list[int]:
    """Capacities that lift ``fixed`` sizes to one level with ``small`` bytes more; above the level: none."""
    n, order = len(fixed), sorted(fixed)
    level = 0
    for k in range(1, n + 1):
        level = (small + sum(order[:k])) // k
        if k == n or level <= order[k]:
            break
    room = [max(0, level - f) for f in fixed]
    open_ = [j for j in range(n) if fixed[j] <= level]
    for x in range(small - sum(room)):  # fewer than n bytes are left by the division
        room[open_[x % len(open_)]] += 1
    return room


def place_large(large: Sequence[tuple[int, int, int]], shards: int, total: int) -> dict[int, int]:
    """(row, size, old shard) of the large documents, largest first: stay where there is room, else go where most is free."""
    used, out = [0] * shards, {}
    for row, size, old in sorted(large, key=lambda x: (-x[1], x[0])):
        stays = old is not None and old < shards and (used[old] + size) * shards <= total
        j = old if stays else min(range(shards), key=lambda k: (used[k], k))
        used[j] += size
        out[row] = j
    return out


def reshard(docs: DataFrame, shards: int, old: Column, old_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot): one row for each row of ``docs``.

    ``old`` gives the shard a row is in now (0 to old_shards-1). Sizes are UTF-8 bytes plus
    8; new capacities are equal. Bytes that a flow sends from old to new shard are taken as
    one interval of the old shard's documents in hash order; a document goes where the
    middle of its bytes lies. Documents above 1/64 of a shard, fewer than 64 for each shard,
    are placed one by one before. Slots number a shard's rows from 0 without gaps.

    Null texts count no bytes and have the crc32 of no bytes, 0. Repeated rows and null ids
    are placed like others. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), old.cast("int").alias("old_shard"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large_rows = rows.where(F.col("size") * F.lit(shards * GRAIN) > F.lit(total))
    large = place_large([tuple(r) for r in large_rows.select("row", "size", "old_shard").collect()], shards, total)  # fewer than shards * GRAIN
    fixed = [0] * shards
    sums = [0] * old_shards
    for r in large_rows.select("row", "size").collect():
        fixed[large[r.row]] += r.size
    small = rows.where(F.col("size") * F.lit(shards * GRAIN) <= F.lit(total))
    for r in small.groupBy("old_shard").agg(F.sum("size").alias("size")).collect():  # one for each old shard
        sums[r.old_shard] = r.size
    sent = min_cost_flow(sums, level_capacities(fixed, sum(sums)))
    cuts = []
    for i, to in enumerate(sent):
        upto, own = 0, []
        for j in sorted(range(shards), key=lambda j: (j != i, j)):  # what stays comes first
            if to[j]:
                upto += to[j]
                own.append((upto, j))
        cuts.append((i, own or [(0, i % shards)]))
    spark = docs.sparkSession
    bounds = spark.createDataFrame(cuts, "old_shard int, cuts array<struct<upto: bigint, shard: int>>")
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("row")]
    placed = running_start(small, ["old_shard"], "size", order, "start").join(F.broadcast(bounds), "old_shard")  # one row for each old shard
    middle = F.col("start") + F.col("size") / 2
    inside = F.filter("cuts", lambda c: c["upto"] > middle)
    placed = placed.withColumn("shard", F.coalesce(F.get(inside, F.lit(0)), F.element_at("cuts", -1))["shard"])
    fixed_df = spark.createDataFrame(sorted(large.items()), "row bigint, shard int")
    kept = ["doc_id", "size", "text_crc32", "old_shard", "row", "shard"]
    both = placed.select(kept).unionByName(rows.join(F.broadcast(fixed_df), "row").select(kept))  # fewer than shards * GRAIN
    numbered = running_start(both.withColumn("one", F.lit(1).cast("long")), ["shard"], "one", order, "slot")
    return numbered.select("doc_id", "size", "text_crc32", "old_shard", "shard", F.col("slot").cast("long").alias("slot"), "row")


def hashed_shard(doc_id: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(shards)).cast("int")


def attach(docs: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the columns old_shard, shard and slot of ``placed``; texts are shuffled once.

    Rows are matched by id and crc32 of the text (null: none); among equal ones by number, so
    repeated rows get slots of their own and a null id is an id like any other. Columns of
    these names that ``docs`` has already are replaced. An empty table gives an empty result.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("old_shard", "shard", "slot")])
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    left = docs.withColumns({"_crc": crc, "_key": F.col(id_col)})
    left = left.withColumn("_nth", F.row_number().over(Window.partitionBy("_key", "_crc").orderBy(F.lit(1))))
    right = placed.select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_c"), "old_shard", "shard", "slot", F.row_number().over(Window.partitionBy("doc_id", "text_crc32").orderBy("slot", "shard")).alias("_n"))
    same = F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_crc") == F.col("_c")) & (F.col("_nth") == F.col("_n"))
    return left.join(right, same).drop("_crc", "_key", "_nth", "_id", "_c", "_n")


def rewrite_affected(docs: DataFrame, placed: DataFrame, old_path: str, new_path: str, rows_per_file: int = 100_000) -> DataFrame:
    """Writes the shards that gain or lose a document under ``new_path``; returns (shard, path) of all.

    A shard whose documents all stay keeps its files under ``old_path``.
    """
    touched = placed.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    full = attach(docs, placed).drop("old_shard").join(F.broadcast(touched), "shard", "left_semi")  # at most one row for each shard
    full = full.withColumn("_file", F.floor(F.col("slot") / rows_per_file)).repartition("shard", "_file")
    full.sortWithinPartitions("shard", "slot").drop("_file", "slot").write.mode("overwrite").partitionBy("shard").parquet(new_path)
    known = placed.select("shard").distinct().join(F.broadcast(touched.withColumn("_new", F.lit(True))), "shard", "left")
    return known.select("shard", F.concat(F.when(F.col("_new"), F.lit(new_path)).otherwise(F.lit(old_path)), F.lit("/shard="), F.col("shard")).alias("path"))


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: from 16 shards by a hash of the id to 24 of equal bytes."""
    docs = table(spark, sf_dir, "documents")
    placed = reshard(docs, 24, hashed_shard(F.col("doc_id"), 16), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
