"""Retrieval post-processing: dedupe, tenant scope, rerank order, budgets, ownership, vector top-k."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_path, normal_quote
from ..runtime import ship


#: Fixed value: by what a citation may name a row, best first.
NAMES = ("submitted_source", "path", "filename", "original_filename")


def first_occurrences(citations: DataFrame, order: list[str], path: str, content: str, within: list[str]) -> DataFrame:
    """Ranked citations without repeats: first by normalised path, then by trimmed content; blank ones are never a repeat."""
    named = citations.withColumn("_path", normal_path(F.col(path))).withColumn("_content", F.nullif(F.trim(content), F.lit("")))
    once = named
    for c in ("_path", "_content"):
        nth = F.row_number().over(Window.partitionBy(*within, c).orderBy(*order))
        once = once.withColumn("_n", nth).where((F.col("_n") == 1) | F.col(c).isNull())
    return once.drop("_path", "_content", "_n")


def owners_by_name(references: DataFrame, registry: DataFrame) -> DataFrame:
    """Per path: companies, hashes, and whether it is ambiguous (several hashes and several companies).

    A path names a row by one of NAMES, the best first; a path that names none is matched by its base name. Rows
    of one hash share their owners, unless the path is ambiguous, which then has no company.
    ``registry`` has path, sha256, company, and may lack the other names. All joins are on equal keys.
    """
    from ..functions.text import basename

    names = [n for n in NAMES if n in registry.columns]
    short = [F.col(n) if n != "path" else basename(F.col("path")) for n in names]
    vias = [n if n != "path" else "basename" for n in names]

    def named(values: list[Column], said: list[str]) -> DataFrame:
        ways = F.array(*[F.struct(F.lit(NAMES.index(n)).alias("way"), F.lit(v).alias("via"), c.alias("name")) for n, v, c in zip(names, said, values, strict=True)])
        return registry.select("sha256", "company", F.explode(ways).alias("w")).select("w.*", "sha256", "company").where("name is not null")

    paths = references.select("path").where("path is not null").distinct()
    exact = paths.join(named([F.col(n) for n in names], names), F.col("path") == F.col("name")).drop("name")
    left = paths.join(exact, "path", "left_anti")
    matched = exact.unionByName(left.join(named(short, vias), basename(F.col("path")) == F.col("name")).drop("name"))
    known = F.when(F.col("sha256") != "pending", F.col("sha256"))
    decided = matched.groupBy("path").agg(F.min(F.struct("way", "via"))["via"].alias("via"), F.countDistinct(known).alias("n_hashes"), F.countDistinct("company").alias("n_companies"))
    wide = matched.select("path", known.alias("sha256")).distinct().join(registry.select("sha256", "company").distinct(), "sha256").select("path", "company")
    owners = matched.select("path", "company").unionByName(wide).groupBy("path").agg(F.sort_array(F.collect_set("company")).alias("_all"))
    ambiguous = (F.col("n_hashes") > 1) & (F.col("n_companies") > 1)
    own = decided.join(owners, "path").withColumn("ambiguous", ambiguous)
    return own.withColumn("companies", F.when(F.col("ambiguous"), F.array().cast("array<string>")).otherwise(F.col("_all"))).drop("_all")


def scope(references: DataFrame, owners: DataFrame, allowed: Column) -> DataFrame:
    """Adds ``scope``: kept, other, unattributable or ambiguous, by the owners of each path."""
    j = references.join(owners.select("path", "companies", "ambiguous"), "path", "left")
    said = (
        F.when(F.col("ambiguous"), "ambiguous")
        .when(F.col("companies").isNull() | (F.size("companies") == 0), "unattributable")
        .when(F.arrays_overlap("companies", allowed), "kept")
        .otherwise("other")
    )
    return j.withColumn("scope", said)


def rerank(citations: DataFrame, scores: DataFrame, key: list[str], within: list[str], prefix: int | None = None) -> DataFrame:
    """New positions: scored first by score, then the unscored in their old order; beyond ``prefix`` nothing moves."""
    j = citations.join(scores, [*within, *key], "left")
    head = F.lit(0) if prefix is None else F.when(F.col("rank") <= prefix, 0).otherwise(1)
    score = F.col("score") if prefix is None else F.when(F.col("rank") <= prefix, F.col("score"))
    w = Window.partitionBy(*within).orderBy(head, score.desc_nulls_last(), "rank", *key)
    return j.withColumn("new_rank", F.row_number().over(w))


#: Fixed value: what stands at the end of a block that was cut.
CUT = "[... material cut here by the gateway context cap ...]"


def cut_block(block: Column, most: int) -> Column:
    """A block cut to ``most`` characters at the end of a line after its first, with a mark."""
    head = F.substring(block, 1, max(0, most - len(CUT) - 1))
    last = F.length(head) - F.instr(F.reverse(head), "\n")
    # the first line names the source and never stands alone
    whole = F.when((F.instr(head, "\n") > 0) & (last >= F.instr(block, "\n")), head.substr(F.lit(1), last)).otherwise(head)
    return F.substring(F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("\n" + CUT)), 1, most)


def fill(blocks: DataFrame, size: Column, most: int, within: list[str], order: list[str], text: str | None = None) -> DataFrame:
    """The ranked prefix that fits: the first block that doesn't closes the fill.

    With ``text``, a top block that alone exceeds ``most`` is kept, cut to it.
    """
    w = Window.partitionBy(*within).orderBy(*order)
    filled = blocks.withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if text is None:
        return filled.where(F.col("used") <= most)
    filled = filled.withColumn("_n", F.row_number().over(w)).where((F.col("used") <= most) | (F.col("_n") == 1))
    shown = F.when(F.col("used") > most, cut_block(F.col(text), most)).otherwise(F.col(text))
    return filled.withColumn(text, shown).withColumn("used", F.when(F.col("used") > most, F.length(text).cast("long")).otherwise(F.col("used"))).drop("_n")


def top_k(df: DataFrame, within: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps only k of each group before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col(rank) <= k)


#: Tokens of all probes that are broadcast at most.
PROBE_TOKENS = 1_000_000


def jaccard_top_k(docs: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(probe_id, doc_id, score, rank): by token sets, meeting on shared tokens only.

    ``docs`` (doc_id, tokens) and ``probes`` (probe_id, tokens) hold distinct tokens. Probes of up
    to PROBE_TOKENS tokens are broadcast: matches are then counted within a document's own
    task before anything is shuffled, and a frequent token makes no hot group. More of them
    meet the documents by a shuffle on the token.
    """
    a = docs.select("doc_id", F.size("tokens").alias("na"), F.explode("tokens").alias("t"))
    b = probes.select("probe_id", F.size("tokens").alias("nb"), F.explode("tokens").alias("t"))
    b = F.broadcast(b) if probes.agg(F.sum(F.size("tokens"))).first()[0] in range(PROBE_TOKENS + 1) else b
    both = a.join(b, "t").groupBy("probe_id", "doc_id", "na", "nb").agg(F.count("*").alias("n"))
    scored = both.select("probe_id", "doc_id", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("score"))
    return top_k(scored, ["probe_id"], [F.col("score").desc(), F.col("doc_id")], k)


#: Far above the error of a matrix product, so that no row of the first k is lost before scores are told exactly.
SLACK = 1e-9


def _cosines(v: np.ndarray, m: np.ndarray, vv: float, mm: np.ndarray) -> np.ndarray:
    """Cosines of ``v`` with the rows of ``m``, summed from the first component to the last, so that equal vectors have equal scores wherever they stand; ``vv`` and ``mm`` are the squared lengths."""
    den = np.sqrt(vv * mm)
    s = np.divide(np.cumsum(m * v, axis=1)[:, -1], den, out=np.zeros_like(den), where=den > 0)
    return np.clip(s, -1.0, 1.0)


def cosine_top_k(vectors: DataFrame, is_query: Column, k: int, block: int = 16384) -> DataFrame:
    """(query_id, vec_id, score, rank): the query rows against all others, block by block.

    Each pair of a query block and a row block is one group of bounded size that returns its
    own top k; ties go to the smaller id. A matrix product finds what may be among the first k, their
    scores are then summed in one order. Vectors with components that aren't finite take no part.
    """
    ship(vectors.sparkSession)
    clean = vectors.where("embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), is_query.alias("q"))
    n, asked = clean.agg(F.count("*"), F.count_if("q")).first()
    rows_n, sets = max(1, -(-n // block)), max(1, -(-asked // (4 * block)))
    # both sides keyed by the same types: an int and a long of one value hash to different tasks
    dealt = lambda c, of: F.pmod(c, F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = clean.where("q").select("vec_id", "v", dealt(F.xxhash64("vec_id"), sets).alias("s"), every(rows_n).alias("b"))
    right = clean.select("vec_id", "v", dealt(F.xxhash64("vec_id", F.lit(1)), rows_n).alias("b"), every(sets).alias("s"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            x, y = np.stack(a["v"].to_numpy()).astype(float), np.stack(b["v"].to_numpy()).astype(float)
            xx, yy = (np.cumsum(m * m, axis=1)[:, -1] for m in (x, y))
            ids = b["vec_id"].to_numpy()
            for at in range(0, len(x), 256):
                den = np.sqrt(xx[at : at + 256, None] * yy[None, :])
                s = np.divide(x[at : at + 256] @ y.T, den, out=np.zeros_like(den), where=den > 0)
                s[~np.isfinite(s) | ~np.isfinite(den)] = -np.inf
                for i, row in enumerate(s):
                    row[ids == a["vec_id"].iloc[at + i]] = -np.inf
                    least = np.partition(row, len(row) - k)[len(row) - k] - SLACK if len(row) > k else -np.inf
                    best = np.flatnonzero((row >= least) & np.isfinite(row))
                    score = _cosines(x[at + i], y[best], xx[at + i], yy[best])
                    first = np.lexsort((ids[best], -score))[:k]
                    out.append(pd.DataFrame({"query_id": a["vec_id"].iloc[at + i], "vec_id": ids[best[first]], "score": score[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInPandas(run, "query_id bigint, vec_id bigint, score double")
    return top_k(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)


#: Grades of a quote; whatever else stands there means the answer itself.
GRADES = (0, 1, 2)


def credit(units: DataFrame, quotes: DataFrame) -> DataFrame:
    """(probe, quote_id, grade, rank): each quote at the first unit that holds it; rank is null where none does.

    ``units`` has (probe, rank, text), ``quotes`` (probe, quote_id, quote, grade). White space, case and quote
    marks at the ends don't count. Blank quotes are dropped, and of a probe's equal quotes the first by quote_id
    counts; grades other than 0, 1 and 2 mean 2. Quotes meet the units of their own probe only.
    """
    q = quotes.withColumn("_q", normal_quote(F.coalesce("quote", F.lit("")))).where("_q <> ''")
    first = F.row_number().over(Window.partitionBy("probe", "_q").orderBy("quote_id"))
    grade = F.when(F.col("grade").isin(*GRADES), F.col("grade")).otherwise(GRADES[-1]).cast("int")
    q = q.withColumn("_n", first).where("_n = 1").select("probe", "quote_id", grade.alias("grade"), "_q")
    j = q.join(units.select("probe", "rank", normal_quote(F.col("text")).alias("_t")), "probe", "left")
    return j.groupBy("probe", "quote_id", "grade").agg(F.min(F.when(F.contains("_t", "_q"), F.col("rank"))).alias("rank"))


def unit_grades(credited: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """(probe, rank, grade): the grade of a unit is the best of the quotes credited to it; with ``units``, 0 for those without one."""
    best = credited.where("rank is not null").groupBy("probe", "rank").agg(F.max("grade").alias("grade"))
    return best if units is None else units.select("probe", "rank").join(best, ["probe", "rank"], "left").select("probe", "rank", F.coalesce("grade", F.lit(0)).alias("grade"))


def _anchor(needle: Column) -> Column:
    """What a text that holds the needle must have: its longest inner word (which is whole there too), or its first three characters."""
    words = F.split(needle, " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.aggregate(inner, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    return F.when(longest != "", F.concat(F.lit("w"), longest)).otherwise(F.concat(F.lit("c"), F.substring(needle, 1, 3)))


#: Anchors that are broadcast at most; more meet the texts by a shuffle.
ANCHORS = 1_000_000


def contained(texts: DataFrame, needles: DataFrame, keys: list[str], text: str = "t") -> DataFrame:
    """(probe, *keys): which texts hold which needles (probe, needle), both normalised, as substrings.

    Texts and needles meet on one anchor of the needle, a word or three characters, and are then
    compared; texts are never paired with needles that share no anchor. Needles of one or two characters
    meet on themselves.
    """
    n = needles.where("needle <> ''").distinct().withColumn("a", _anchor(F.col("needle")))
    sizes = n.agg(F.count("*"), F.min(F.when(F.col("a").startswith("c"), F.length("a") - 1)), F.max(F.when(F.col("a").startswith("c"), F.length("a") - 1))).first()

    def runs(size: int) -> Column:
        at = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1)))
        return F.coalesce(F.transform(at, lambda i: F.concat(F.lit("c"), F.substring(F.col(text), i, F.lit(size)))), F.array().cast("array<string>"))

    grams = F.concat(F.array().cast("array<string>"), *[runs(size) for size in range(sizes[1] or 4, (sizes[2] or 3) + 1)])
    words = F.transform(F.split(text, " "), lambda w: F.concat(F.lit("w"), w))
    n = F.broadcast(n) if sizes[0] <= ANCHORS else n
    met = texts.select(*keys, text, F.explode(F.array_distinct(F.concat(words, grams))).alias("a")).join(n, "a")
    return met.where(F.contains(text, "needle")).select("probe", *keys).distinct()


def quote_places(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """(probe, doc, index, seam): every chunk that holds one of a probe's quotes, or, for a probe without such, the left chunk of every seam that its longest quote runs over.

    ``chunks`` has (doc, index, text), ``gold`` (probe, quote). A seam joins two chunks of one document whose indexes follow each other; of quotes of
    equal length the first by its words is taken.
    """
    needles = gold.select("probe", normal_quote(F.coalesce("quote", F.lit(""))).alias("needle")).where("needle <> ''").distinct()
    plain = chunks.select("doc", "index", normal_quote(F.col("text")).alias("t"))
    whole = contained(plain, needles, ["doc", "index"]).withColumn("seam", F.lit(False))
    longest = needles.groupBy("probe").agg(F.min_by("needle", F.struct(-F.length("needle"), "needle")).alias("needle")).join(whole.select("probe").distinct(), "probe", "left_anti")
    w = Window.partitionBy("doc").orderBy("index")
    both = plain.withColumns({"_next": F.lead("t").over(w), "_follows": F.lead("index").over(w) == F.col("index") + 1}).where("_follows").select("doc", "index", F.concat_ws(" ", "t", "_next").alias("t"))
    return whole.unionByName(contained(both, longest, ["doc", "index"]).withColumn("seam", F.lit(True)))


def rank_probes(places: DataFrame, ranking: DataFrame, chunks: DataFrame, gold: DataFrame, budgets: Sequence[int] = (), sources: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """One row a probe: rank, located, quote_in_seam, in_source, lost_text, row_intact, within_<budget>.

    ``ranking`` has (probe, doc, index, rank), ``chunks`` (doc, index, text, tokens). A quote is reached at its best ranked chunk, or behind
    all that are ranked if none of its chunks is; a seam at the later of its two chunks, and only if both are ranked. ``within_T`` says whether the rank
    is in the longest prefix of the ranking of at most T tokens. With ``sources`` (text): whether a whole text has the quote, and whether the chunks
    lost it. With ``rows`` (probe, row_key, row_value): whether one chunk has both; null without a key of 2 characters and a value.
    """
    order = ranking.groupBy("probe").agg(F.count("*").alias("n"))
    at = ranking.select("probe", "doc", "index", F.col("rank").alias("r"))
    right = at.select("probe", "doc", (F.col("index") - 1).alias("index"), F.col("r").alias("r2"))
    met = places.join(at, ["probe", "doc", "index"], "left").join(right, ["probe", "doc", "index"], "left")
    met = met.groupBy("probe").agg(F.min("seam").alias("quote_in_seam"), F.min(F.when(~F.col("seam"), F.col("r"))).alias("single"), F.min(F.when(F.col("seam") & F.col("r").isNotNull() & F.col("r2").isNotNull(), F.greatest("r", "r2"))).alias("pair"))
    own = gold.select("probe").distinct().join(order, "probe", "left").join(met, "probe", "left")
    rank = F.when(F.col("quote_in_seam"), F.col("pair")).when(F.col("quote_in_seam").isNotNull(), F.coalesce("single", F.coalesce("n", F.lit(0)) + 1))
    out = own.select("probe", rank.cast("long").alias("rank"), F.col("quote_in_seam").isNotNull().alias("located"), F.coalesce("quote_in_seam", F.lit(False)).alias("quote_in_seam"))
    if sources is not None:
        needles = gold.select("probe", normal_quote(F.coalesce("quote", F.lit(""))).alias("needle"))
        there = contained(sources.select(normal_quote(F.col("text")).alias("t")), needles, []).select("probe", F.lit(True).alias("in_source"))
        out = out.join(there, "probe", "left").withColumn("in_source", F.coalesce("in_source", F.lit(False))).withColumn("lost_text", F.col("in_source") & ~F.col("located"))
    if rows is not None:
        plain = chunks.select("doc", "index", normal_quote(F.col("text")).alias("t"))
        keyed = rows.select("probe", normal_quote("row_key").alias("k"), normal_quote("row_value").alias("v")).where("length(k) >= 2 and length(v) >= 1")
        has_key = contained(plain, keyed.select("probe", F.col("k").alias("needle")), ["doc", "index", "t"])
        intact = has_key.join(keyed, "probe").where(F.contains("t", "v")).select("probe").distinct().withColumn("_hit", F.lit(True))
        out = out.join(keyed.select("probe").distinct().join(intact, "probe", "left").select("probe", F.coalesce("_hit", F.lit(False)).alias("row_intact")), "probe", "left")
    if budgets:
        run = F.sum("tokens").over(Window.partitionBy("probe").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
        used = ranking.join(chunks.select("doc", "index", "tokens"), ["doc", "index"]).withColumn("used", run)
        taken = used.groupBy("probe").agg(*[F.count_if(F.col("used") <= t).alias(f"_taken_{t}") for t in budgets])
        out = out.join(taken, "probe", "left").withColumns({f"within_{t}": F.coalesce(F.col("rank") <= F.col(f"_taken_{t}"), F.lit(False)) for t in budgets}).drop(*[f"_taken_{t}" for t in budgets])
    return out


def recall_report(ranked: DataFrame, ks: Sequence[int], budgets: Sequence[int] = (), by: Sequence[str] = ()) -> DataFrame:
    """Over all probes, or for each value of ``by``: n, seam_quotes, percentages of what is cut by a boundary, located, lost, kept in one row, found by each k and token budget, and the mean reciprocal rank."""
    share = lambda hit, of=F.count("*"): F.round(100.0 * F.count_if(hit) / of, 2)
    parts = [F.count("*").alias("n"), F.count_if("quote_in_seam").alias("seam_quotes"), share(F.col("quote_in_seam")).alias("cut_by_boundary_pct"), F.count_if("located").alias("located_n"), share(F.col("located")).alias("located_pct")]
    if "lost_text" in ranked.columns:
        parts.append(F.count_if("lost_text").alias("lost_text_n"))
    if "row_intact" in ranked.columns:
        parts += [F.count("row_intact").alias("row_intact_n"), share(F.col("row_intact"), F.nullif(F.count("row_intact"), F.lit(0))).alias("row_intact_pct")]
    parts += [share(F.coalesce(F.col("rank") <= k, F.lit(False))).alias(f"recall_{k}") for k in ks] + [share(F.col(f"within_{t}")).alias(f"recall_{t}_tokens") for t in budgets]
    parts += [F.round(F.sum(F.coalesce(1 / F.col("rank"), F.lit(0.0))) / F.count("*"), 4).alias("mrr"), share(F.col("rank").isNotNull()).alias("found_at_all")]
    return ranked.groupBy(*by).agg(*parts)
