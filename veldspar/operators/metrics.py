"""Retrieval and answer-quality metrics as aggregates; None is not measured and never becomes 0."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, ship


def ranking(units: DataFrame, probe: str, rank: str, grade: str, k: int = 5) -> DataFrame:
    """Per probe: first_hit_rank, mrr, hit_at_k, ndcg, average_precision.

    Ranks are 1-based and without gaps. The ideal order is that of the grades returned.
    """
    gain = F.pow(F.lit(2.0), F.greatest(F.col(grade), F.lit(0))) - 1
    by_rank = Window.partitionBy(probe).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    ideal = Window.partitionBy(probe).orderBy(gain.desc(), rank)
    hit = F.col(grade) > 0
    w = units.withColumn("_gain", gain).withColumn("_hits", F.sum(hit.cast("int")).over(by_rank)).withColumn("_ideal", F.row_number().over(ideal))
    inside = lambda pos: pos <= k
    g = w.groupBy(probe).agg(
        F.min(F.when(hit, F.col(rank))).alias("first_hit_rank"),
        F.sum(F.when(inside(F.col(rank)), F.col("_gain") / F.log2(F.col(rank) + 1)).otherwise(0.0)).alias("_dcg"),
        F.sum(F.when(inside(F.col("_ideal")), F.col("_gain") / F.log2(F.col("_ideal") + 1)).otherwise(0.0)).alias("_idcg"),
        F.avg(F.when(hit, F.col("_hits") / F.col(rank))).alias("_ap"),
    )
    return g.select(
        probe, F.col("first_hit_rank").cast("long").alias("first_hit_rank"), F.round(F.coalesce(1 / F.col("first_hit_rank"), F.lit(0.0)), 4).alias("mrr"),
        F.coalesce((F.col("first_hit_rank") <= k).cast("long"), F.lit(0)).alias("hit_at_k"),
        F.round(F.when(F.col("_idcg") > 0, F.col("_dcg") / F.col("_idcg")).otherwise(0.0), 4).alias("ndcg"), F.round(F.coalesce("_ap", F.lit(0.0)), 4).alias("average_precision"),
    )


def recall(hits: DataFrame, probe: str, grade: str, found: str) -> DataFrame:
    """Per probe: share of gold quotes found, and of grade mass; null where there is none."""
    mass = F.greatest(F.col(grade), F.lit(0))
    return hits.groupBy(probe).agg(
        F.round(F.avg(F.col(found).cast("int")), 4).alias("evidence_recall"),
        F.round(F.sum(F.when(F.col(found), mass).otherwise(0)) / F.nullif(F.sum(mass), F.lit(0)), 4).alias("graded_recall"),
    )


def at_ranks(df: DataFrame, group: str | None, value: str, ranks: dict[str, Callable[[Column], Column]], buckets: int = 256) -> DataFrame:
    """Per group: n, and for each name the value at a 0-based rank, a function of n that is held inside 0 and n - 1.

    Equal values are counted; running sums of the counts go through ranges of the value, so
    one group of all rows is summed by many tasks. ``group`` None takes all rows as one. A
    group without values has n 0 and nulls.
    """
    own = df.select((F.lit(0) if group is None else F.col(group)).alias("_g"), F.col(value).alias("_v"))
    counts = cut(own.groupBy("_g", "_v").agg(F.count("_v").alias("_c")))  # once, for the edges and the sums
    edges = counts.agg(F.percentile_approx("_v", [i / buckets for i in range(1, buckets)])).first()[0] or []
    bucket = F.lit(0)
    if edges:
        bucket = F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]), lambda e: e < F.col("_v")))
    counts = counts.withColumn("_b", F.when(F.col("_v").isNull(), -1).otherwise(bucket))
    sums = counts.groupBy("_g", "_b").agg(F.sum("_c").alias("_s"))
    by = Window.partitionBy("_g").orderBy("_b")
    sums = sums.select(F.col("_g").alias("_sg"), F.col("_b").alias("_sb"), F.coalesce(F.sum("_s").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_s").over(Window.partitionBy("_g")).alias("n"))
    within = F.coalesce(F.sum("_c").over(Window.partitionBy("_g", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("_within", within).join(sums, F.col("_g").eqNullSafe(F.col("_sg")) & (F.col("_b") == F.col("_sb"))).withColumn("_start", F.col("_base") + F.col("_within"))
    n = F.col("n")
    found = []
    for name, rank in ranks.items():
        at = F.greatest(F.least(rank(n).cast("long"), n - 1), F.lit(0))
        found.append(F.max(F.when((F.col("_start") <= at) & (at < F.col("_start") + F.col("_c")), F.col("_v"))).alias(name))
    return placed.groupBy(F.col("_g").alias(group or "_all")).agg(F.max("n").alias("n"), *found)


def percentiles(df: DataFrame, group: str, value: str, p: float = 0.95) -> DataFrame:
    """The five index rules in use, side by side, on the sorted values of each group."""
    gate = lambda n: F.floor(F.lit(p) * n)
    g = at_ranks(df, group, value, {
        "p_chunk": lambda n: F.bround(F.lit(p) * (n - 1), 0), "p_loop": lambda n: F.greatest(F.bround(F.lit(p) * n, 0), F.lit(1)) - 1,
        "p_gate": gate, "p_scorer": gate, "_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2),
    })
    return g.select(group, F.col("n").cast("long").alias("n"), "p_chunk", "p_loop", "p_gate", "p_scorer", ((F.col("_low") + F.col("_high")) / 2).alias("median"))


def rate(condition: Column) -> Column:
    """Percentage of rows, one decimal; null over no rows."""
    return F.round(100.0 * F.count_if(condition) / F.nullif(F.count("*"), F.lit(0)), 1)


def verdict_rates(verdicts: DataFrame, by: str, verdict: str = "verdict", excluded: tuple[str, ...] = ("excluded", "unknown")) -> DataFrame:
    """Per slice: counts and rates of graded verdicts; excluded ones are in no percentage."""
    v = F.col(verdict)
    graded = verdicts.where(~v.isin(*excluded))
    return graded.groupBy(by).agg(
        F.count("*").alias("n"), rate(v == "correct").alias("correct_pct"), rate(v.isin("correct", "partial")).alias("ok_pct"),
        rate(v == "hallucination").alias("hallucination_pct"), rate(v == "refusal").alias("refusal_pct"),
    )


def success(rates: DataFrame) -> DataFrame:
    """Adds ``success``: ok >= 90, hallucinations < 5, refusals >= 80; null fails."""
    ok = (F.col("ok_pct") >= 90) & (F.col("hallucination_pct") < 5) & (F.col("refusal_pct") >= 80)
    return rates.withColumn("success", F.coalesce(ok, F.lit(False)))


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: number of pairs, of keys in one arm only, and the mean difference b - a over pairs."""
    x, y = a.select(key, F.col(value).alias("_a"), F.lit(1).alias("_ia")), b.select(key, F.col(value).alias("_b"), F.lit(1).alias("_ib"))
    j = x.join(y, key, "full_outer")
    both = F.col("_ia").isNotNull() & F.col("_ib").isNotNull()
    return j.agg(F.count_if(both).alias("n"), F.count_if(F.col("_ib").isNull()).alias("only_in_a"), F.count_if(F.col("_ia").isNull()).alias("only_in_b"), F.round(F.avg(F.when(both, F.col("_b") - F.col("_a"))), 4).alias("difference"))


def bootstrap(pairs: DataFrame, group: list[str], samples: int = 2000, seed: int = 0, confidence: float = 0.95, size: int = 20_000) -> DataFrame:
    """Per group of (a, b) pairs: mean difference, its bootstrap interval, and whether it leaves 0 out.

    Pairs are dealt by a hash of their id into parts of about ``size``. How many of a replicate's
    draws fall to each part is multinomial and drawn alike in every task; each part draws its own
    pairs with replacement, and the sums of the parts make the replicate. The generator is NumPy's.
    """
    ship(pairs.sparkSession)
    own = pairs.select(*group, "id", "a", "b")
    parts = min(4096, -(-own.count() // size) or 1)
    dealt = own.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("_gh", F.xxhash64(*group))
    sizes = dealt.groupBy("_gh", "_part").agg(F.count("*").alias("_m")).groupBy("_gh").agg(F.sort_array(F.collect_list(F.struct("_part", "_m"))).alias("_sizes"))
    sizes = sizes.select(F.col("_gh"), F.col("_sizes._part").alias("_parts"), F.col("_sizes._m").alias("_ms"))
    types = dict(pairs.dtypes)
    keys = ", ".join(f"{g} {types[g]}" for g in group)

    def run(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[*group, "_gh", "_k", "_sum", "_n"])
        gh, part, ms = int(pdf["_gh"].iloc[0]), int(pdf["_part"].iloc[0]), np.asarray(told["_ms"].iloc[0])
        d = pdf.sort_values(["id", "a", "b"])
        d = (d["b"] - d["a"]).to_numpy(float)
        share = np.random.default_rng([seed, gh & (1 << 64) - 1]).multinomial(ms.sum(), ms / ms.sum(), samples)[:, list(told["_parts"].iloc[0]).index(part)]
        rng = np.random.default_rng([seed, gh & (1 << 64) - 1, part + 1])
        sums = [d.sum(), *(d[rng.integers(0, len(d), int(k))].sum() for k in share)]
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] * (samples + 1) for g in group}, "_gh": gh, "_k": range(-1, samples), "_sum": sums, "_n": int(ms.sum())})

    told = sizes.select(F.col("_gh").alias("_tg"), F.explode("_parts").alias("_tp"), F.col("_parts").alias("_parts"), "_ms")
    sums = dealt.groupBy("_gh", "_part").cogroup(told.groupBy("_tg", "_tp")).applyInPandas(run, f"{keys}, _gh long, _k int, _sum double, _n long")
    means = sums.groupBy("_gh", *group, "_k").agg(F.round(F.sum("_sum") / F.max("_n"), 4).alias("_mean"), F.max("_n").alias("_n"))
    tail = (1 - confidence) / 2
    drawn = F.sort_array(F.collect_list(F.when(F.col("_k") >= 0, F.col("_mean"))))  # as many as samples
    found = means.groupBy("_gh", *group).agg(F.max("_n").alias("n"), F.max(F.when(F.col("_k") < 0, F.col("_mean"))).alias("difference"), drawn.alias("_drawn"))
    found = found.select(*group, "n", "difference", F.get("_drawn", F.lit(int(tail * samples))).alias("low"), F.get("_drawn", F.lit(min(int((1 - tail) * samples), samples - 1))).alias("high"))
    return found.withColumn("resolved", (F.col("low") > 0) | (F.col("high") < 0))


def ab_gate(arms: DataFrame, min_lift: float = 8.0, max_latency: float = 20.0, max_failures: float = 10.0, least: int = 12) -> DataFrame:
    """One row: quality lift and p95 increase of candidate over baseline, in percent, and the verdict.

    ``arms`` has id, baseline and candidate scores and latencies, and failed.
    """
    p95 = lambda c, name: at_ranks(arms, None, c, {name: lambda n: F.floor(F.lit(0.95) * n)}).select(name)
    g = arms.agg(
        F.count("*").alias("n"), F.avg("baseline_score").alias("_b"), F.avg("candidate_score").alias("_c"), rate(F.col("failed")).alias("failure_pct"),
    )
    g = g.join(p95("baseline_ms", "_bp"), F.lit(True), "left").join(p95("candidate_ms", "_cp"), F.lit(True), "left")  # one row each
    g = g.withColumn("lift_pct", F.round(100 * (F.col("_c") - F.col("_b")) / F.nullif(F.col("_b"), F.lit(0.0)), 2)).withColumn("p95_increase_pct", F.round(100 * (F.col("_cp") - F.col("_bp")) / F.nullif(F.col("_bp"), F.lit(0.0)), 2))
    said = F.when(F.col("n") < least, "insufficient").when(F.col("failure_pct") > max_failures, "fail_parse").when(F.col("lift_pct") < min_lift, "fail_quality").when(F.col("p95_increase_pct") > max_latency, "fail_latency").otherwise("pass")
    return g.select("n", "lift_pct", "p95_increase_pct", "failure_pct", said.alias("verdict"))


def gate_state(asked: Column, supported: Column) -> Column:
    return F.when(~asked, "not_asked").when(supported.isNull(), "unchecked").when(supported, "supported").otherwise("refused")
