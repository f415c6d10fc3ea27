"""Conversations: views for rewriting, history blocks, prompts, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_prompt(turns: DataFrame) -> DataFrame:
    """(conv_id, prompt, turn): the last user turn with text."""
    user = turns.where((F.col("role") == "user") & (F.trim("text") != ""))
    return user.groupBy("conv_id").agg(F.max_by("text", "turn").alias("prompt"), F.max("turn").alias("turn"))


def view(turns: DataFrame, last: int = 3, user_chars: int = 1200, assistant_chars: int = 600) -> DataFrame:
    """(conv_id, turn, role, text): the last turns before the latest user turn, cut by role; no system or blank turns."""
    ends = turns.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("_end"))
    own = turns.join(ends, "conv_id").where((F.col("turn") < F.col("_end")) & F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    kept = own.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 2 * last)
    bare = F.regexp_replace("text", r"(?s)\n+Sources:\n.*$", "")
    return kept.select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.substring(bare, 1, user_chars)).otherwise(F.substring(bare, 1, assistant_chars)).alias("text"))


def history(turns: DataFrame, each: int = 400, most: int = 2000) -> DataFrame:
    """(conv_id, n_turns, block): user turns, each cut, as long as the whole fits."""
    user = turns.where((F.col("role") == "user") & (F.trim("text") != "")).select("conv_id", "turn", F.substring("text", 1, each).alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    fits = user.withColumn("_used", F.sum(F.length("text") + 1).over(w)).where(F.col("_used") <= most)
    g = fits.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_t"))
    return g.select("conv_id", "n_turns", F.array_join(F.transform("_t", lambda x: x["text"]), "\n").alias("block"))


def sources(citations: DataFrame, within: str, rank: str, path: str) -> DataFrame:
    """(within, n_sources, block): numbered base names, each once, in order of first appearance."""
    from ..functions.text import basename

    named = citations.select(within, rank, basename(F.col(path)).alias("_name"))
    first = named.groupBy(within, "_name").agg(F.min(rank).alias("_r"))
    n = F.row_number().over(Window.partitionBy(within).orderBy("_r", "_name"))
    lined = first.select(within, n.alias("_n"), F.concat(F.lit("["), n, F.lit("] "), F.col("_name")).alias("_line"))
    g = lined.groupBy(within).agg(F.count("*").alias("n_sources"), F.sort_array(F.collect_list(F.struct("_n", "_line"))).alias("_l"))
    return g.select(within, "n_sources", F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias("block"))
