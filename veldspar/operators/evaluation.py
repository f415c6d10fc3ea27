"""Evaluation and serving data: predicates, gold evidence, drift, crosstabs, fusion, polls, response shapes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship

#: HTTP codes and exceptions worth another try, error codes that are not, answers that say nothing.
TRANSIENT = (408, 429, 500, 502, 503, 504)
TRANSIENT_EXCEPTIONS = ("ConnectError", "ConnectTimeout", "PoolTimeout", "ReadError", "ReadTimeout", "RemoteProtocolError", "RequestError", "TimeoutException", "WriteError", "WriteTimeout")
FINAL_CODES = ("decode_failed", "lightrag_processing_failed", "submit_terminal_failed", "track_status_failed")
WEAK = ("not enough information", "do not have enough information")


def is_transient(code: Column, exception: Column | None = None) -> Column:
    """Worth another try, by HTTP code or by the exception's class name."""
    said = F.coalesce(code.isin(*TRANSIENT), F.lit(False))
    return said if exception is None else said | F.coalesce(exception.isin(*TRANSIENT_EXCEPTIONS), F.lit(False))


def is_retryable(error_code: Column) -> Column:
    """A failure with a code that isn't final."""
    return F.coalesce((error_code != "") & ~error_code.isin(*FINAL_CODES), F.lit(False))


def is_weak(answer: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    return reduce(lambda a, b: a | b, (low.contains(phrase) for phrase in WEAK))


def rewrite_reason(question: Column, keywords: Sequence[str], weak: Column, least_words: int = 20) -> Column:
    """Why a question is asked in several forms, the first that holds: long_query, transcript_keyword, weak_signal; else none."""
    low = F.lower(F.coalesce(question, F.lit("")))
    said = reduce(lambda a, b: a | b, (low.contains(k) for k in keywords), F.lit(False))
    words = F.regexp_count(low, F.lit(r"\S+"))
    return F.when(words == 0, "none").when(words >= least_words, "long_query").when(said, "transcript_keyword").when(weak, "weak_signal").otherwise("none")


def rewrite_problem(original: Column, text: Column, most: int = 600) -> Column:
    """Why a rewrite is refused: empty, same, too_long, blown_up, tool_call; null if it may be used."""
    squeeze = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "empty")
        .when(squeeze(text) == squeeze(original), "same")
        .when(F.length(text) > most, "too_long")
        .when(F.length(text) > 4 * F.length(original) + 200, "blown_up")
        .when(F.trim(text).rlike(r'^\{.*"(?:tool|function|arguments|name)"'), "tool_call")
    )


#: The answer that says nothing was found, how an answer opens that should have been a question, marks of sources and of reasoning, labels and quotes around a rewrite, keys of a call.
NO_CONTEXT = "Sorry, I'm not able to provide an answer to that question.[no-context]"
ANSWER_LIKE = ("answer", "sure", "i'm sorry", "i am sorry", "i cannot", "i can't", "here is", "here are", "the answer", "sorry")
SOURCE_MARKS = ("\n\n---\n\n**Sources**\n\n", "**Sources**")
REASONING = ("<think>", "</think>")
LABEL = r"(?i)^\s*(?:rewritten|standalone|revised|reformulated)\s+question\s*:\s*"
FENCE = r"(?s)```(?:\w+)?\s*(.*?)```"
QUOTES = "\"'“”‘’「」『』"
CALL_KEYS = ("name", "arguments", "function")


def is_canned(answer: Column) -> Column:
    """Whether an answer is, or holds, the canned one that says there was no context."""
    return F.coalesce(F.contains(answer, F.lit(NO_CONTEXT)), F.lit(False))


def checked_rewrite(original: Column, text: Column, last_assistant: Column | None = None, most: int = 600, factor: int = 4, slack: int = 200) -> Column:
    """struct<text, source, reason, ratio>: what becomes of a model's rewrite of a question.

    Complete reasoning is taken out, then a fence, a label and quotes around the question. Rejected, for the first reason that fits: reasoning_markers, empty, multi_line, too_long,
    answer_like, sources_marker, tool_call_shape, identical_to_last_assistant; the original stands then. Else unchanged or rewritten, with the ratio of lengths.
    """
    squeeze = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "(?s)" + REASONING[0] + ".*?" + REASONING[1], "")
    marked = reduce(lambda a, b: a | b, (F.contains(bare, F.lit(m)) for m in REASONING))
    open_ = F.when(bare.rlike(FENCE), F.regexp_extract(bare, FENCE, 1)).otherwise(bare)
    plain = strip(F.regexp_replace(strip(F.regexp_replace(strip(open_), LABEL, "")), f"^[{QUOTES}]+|[{QUOTES}]+$", ""))
    lines = F.filter(F.split(plain, r"\r\n|[\n\r]"), lambda x: F.trim(x) != "")
    one = strip(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))
    own = F.length(strip(F.coalesce(original, F.lit(""))))
    shaped = one.rlike(r"^[\[{]")
    called = shaped & ((F.try_parse_json(one).isNull() & one.startswith("[tool_call")) | (F.try_parse_json(one).isNotNull() & one.rlike('"(?:' + "|".join(CALL_KEYS) + r')"\s*:')))
    reasons = [
        (marked, "reasoning_markers"), (plain == "", "empty"), (F.size(lines) != 1, "multi_line"), ((F.length(one) > most) | (F.length(one) > factor * own + slack), "too_long"), (F.lower(one).rlike("^(?:" + "|".join(ANSWER_LIKE) + ")"), "answer_like"),
        (reduce(lambda a, b: a | b, (F.contains(one, F.lit(m)) for m in SOURCE_MARKS)), "sources_marker"), (called, "tool_call_shape"),
    ]
    if last_assistant is not None:
        reasons.append((F.coalesce((last_assistant != "") & (squeeze(one) == squeeze(last_assistant)), F.lit(False)), "identical_to_last_assistant"))
    reason = F.lit(None).cast("string")
    for fits, name in reversed(reasons):
        reason = F.when(fits, name).otherwise(reason)
    fine = reason.isNull()
    source = F.when(~fine, "rejected").when(squeeze(one) == squeeze(F.coalesce(original, F.lit(""))), "unchanged").otherwise("rewritten")
    return F.struct(F.when(fine, one).otherwise(original).alias("text"), source.alias("source"), reason.alias("reason"), F.when(fine, F.round(F.length(one) / F.greatest(own, F.lit(1)), 3)).alias("ratio"))


def size_request(largest: Column, safety: float = 1.2, margin: int = 64, ceiling: int = 8192, floor: int = 64) -> Column:
    """Chunk size to ask for, from the largest piece: with safety and margin, between floor and ceiling."""
    return F.least(F.greatest(F.ceil(largest * safety) + margin, F.lit(floor)), F.lit(ceiling)).cast("long")


def alias_map(raw: Column) -> Column:
    """``a=b,c;d=e`` to a map of name to list of aliases; blanks fall away."""
    pairs = F.filter(F.transform(F.split(raw, ";"), lambda x: F.trim(x)), lambda p: p.contains("="))
    name = lambda p: F.trim(F.substring_index(p, "=", 1))
    names = F.transform(pairs, lambda p: F.struct(name(p).alias("key"), F.filter(F.transform(F.split(F.substring_index(p, "=", -1), ","), lambda x: F.trim(x)), lambda x: x != "").alias("value")))
    return F.map_from_entries(F.filter(names, lambda e: (e["key"] != "") & (F.size(e["value"]) > 0)))


def merged_warnings(old: Column, changes: Column) -> Column:
    """Map of warnings after changes; a null value takes its key out."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(changes, k))
    return F.map_concat(kept, F.map_filter(changes, lambda k, v: v.isNotNull()))


def content_shapes(citations: DataFrame, content: str, items: str) -> DataFrame:
    """One row: how many citations hold a string, a list, only blanks, or nothing."""
    filled = F.exists(F.coalesce(F.col(items), F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    text = F.col(content).isNotNull() & (F.trim(content) != "")
    any_ = F.col(content).isNotNull() | F.col(items).isNotNull()
    return citations.agg(F.count_if(text).alias("string"), F.count_if(~F.coalesce(text, F.lit(False)) & filled).alias("list"), F.count_if(any_ & ~F.coalesce(text, F.lit(False)) & ~filled).alias("empty"), F.count_if(~any_).alias("absent"))


def character_census(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(character, n): every character of every text; counted inside each task first."""
    return docs.select(F.explode(F.split(text_col, "")).alias("character")).where("character <> ''").groupBy("character").agg(F.count("*").alias("n"))


def duplication(docs: DataFrame, company: str = "source", text_col: str = "text") -> DataFrame:
    """One row: texts, distinct texts, and how many of these are shared across and repeated within companies."""
    each = docs.groupBy(F.sha2(text_col, 256).alias("h"), F.col(company).alias("c")).agg(F.count("*").alias("n"))
    text = each.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("companies"), F.max("n").alias("most"))
    return text.agg(F.sum("n").alias("texts"), F.count("*").alias("distinct_texts"), F.count_if(F.col("companies") > 1).alias("across"), F.count_if(F.col("most") > 1).alias("within"))


def gold_evidence(probes: DataFrame, quotes: str, grades: str, least: int = 4) -> DataFrame:
    """(id, pos, quote, grade): quotes long enough, each with its grade; a missing grade is 2."""
    own = probes.select("id", F.posexplode_outer(quotes).alias("pos", "quote"), F.col(grades).alias("_g")).where(F.length(F.trim("quote")) >= least)
    return own.select("id", "pos", F.trim("quote").alias("quote"), F.coalesce(F.get("_g", F.col("pos")), F.lit(2)).alias("grade"))


def changed_rows(baseline: DataFrame, candidate: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, change): rows added, removed, or with another fingerprint of ``fields``; nulls equal nulls."""
    finger = lambda df, n: df.select(key, F.struct(*fields).alias(n), F.lit(True).alias(f"{n}_in"))
    j = finger(baseline, "a").join(finger(candidate, "b"), key, "full_outer")
    said = F.when(F.col("a_in").isNull(), "added").when(F.col("b_in").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return j.select(key, said.alias("change")).where("change is not null")


def crosstab(df: DataFrame, row: Column, column: Column, values: Sequence[str]) -> DataFrame:
    return df.select(row.alias("row"), column.alias("col")).groupBy("row").pivot("col", list(values)).count().na.fill(0, list(values))


def best_arm(arms: DataFrame) -> DataFrame:
    """The arm of the highest share correct, ties to the lower p95, then by name."""
    return arms.orderBy(F.col("correct_pct").desc_nulls_last(), "p95_ms", "arm").limit(1)


def sampled(key: Column, draw: Column, fraction: float) -> Column:
    """True for a share of rows that a hash decides, the same on every run."""
    return F.pmod(F.xxhash64(key, draw), F.lit(1_000_000)) < int(fraction * 1_000_000)


def poll_action(statuses: DataFrame) -> DataFrame:
    """(track_id, next_status): what the statuses reported for a track make of its row."""
    s = F.upper("status")
    g = statuses.groupBy("track_id").agg(F.count("status").alias("n"), F.count_if(s == "FAILED").alias("failed"), F.count_if(s == "PROCESSED").alias("done"))
    said = F.when(F.col("n") == 0, "submitted").when(F.col("failed") > 0, "failed").when(F.col("done") > 0, "ingested").otherwise("processing")
    return g.select("track_id", said.alias("next_status"))


def fuse(graph: DataFrame, vector: DataFrame) -> DataFrame:
    """(query_id, kind, key): graph items with a source that the vector items lack, then the vector items."""
    seen = vector.groupBy("query_id").agg(F.collect_set("key").alias("_seen"))
    new = graph.join(seen, "query_id", "left").where(F.size(F.array_except("provenance", F.coalesce("_seen", F.array().cast("array<string>")))) > 0)
    return new.select("query_id", F.lit("graph").alias("kind"), "key").unionByName(vector.select("query_id", F.lit("vector").alias("kind"), "key").distinct())


def chat_completion(answers: DataFrame, model: str) -> DataFrame:
    """(id, body): an answer as a chat completion in JSON."""
    message = F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason"))
    return answers.select("id", F.to_json(F.struct(F.concat(F.lit("chatcmpl-"), F.col("id").cast("string")).alias("id"), F.lit("chat.completion").alias("object"), F.lit(model).alias("model"), F.array(choice).alias("choices"))).alias("body"))


def stream_text(lines: DataFrame) -> DataFrame:
    """(id, text, n_parts): the ``response`` parts of JSON lines (id, pos, line) put together; broken lines count for nothing."""
    part = F.get_json_object("line", "$.response")
    own = lines.select("id", "pos", part.alias("part")).where("part is not null")
    g = own.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "part"))).alias("p"))
    return g.select("id", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("text"), F.size("p").cast("long").alias("n_parts"))


def topic_groups(depths: DataFrame, within: str, order: str, depth: str = "depth", threshold: float = 0.3) -> DataFrame:
    """(within, order, topic): cuts after the deepest valleys first, never two next to each other; one document to a group."""
    ship(depths.sparkSession)
    kinds = dict(depths.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        cuts: set[int] = set()
        for i in sorted(pdf.index, key=lambda i: (-pdf[depth][i], i)):
            if pdf[depth][i] >= threshold and i - 1 not in cuts and i + 1 not in cuts:
                cuts.add(i)
        topic, out = 0, []
        for i in pdf.index:
            out.append(topic)
            topic += i in cuts
        return pd.DataFrame({within: pdf[within], order: pdf[order], "topic": out})

    return depths.groupBy(within).applyInPandas(run, f"{within} {kinds[within]}, {order} {kinds[order]}, topic long")


def word_pieces(word: str, vocabulary: frozenset[str] | set[str], unknown: str = "[UNK]", longest: int = 100) -> list[str]:
    """Greedy longest match: the first piece as it is, later ones with ##; unknown if some part has no piece."""
    if len(word) > longest:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
        if end is None:
            return [unknown]
        out.append(("##" if at else "") + word[at:end])
        at = end
    return out


def scope_round(references: DataFrame, narrow: int, wide: int) -> DataFrame:
    """(query_id, round, kept): the wider retrieval only where it keeps strictly more."""
    g = references.groupBy("query_id").agg(F.count_if(F.col("kept") & (F.col("rank") <= narrow)).alias("n"), F.count_if(F.col("kept") & (F.col("rank") <= wide)).alias("w"))
    return g.select("query_id", F.when(F.col("w") > F.col("n"), "wide").otherwise("narrow").alias("round"), F.greatest("n", "w").alias("kept"))


def best_location(locations: DataFrame) -> DataFrame:
    """(probe_id, rank): the best rank of any place of a quote; a seam counts at the later of its two chunks."""
    at = F.when(F.col("second_rank").isNotNull(), F.greatest("first_rank", "second_rank")).otherwise(F.col("first_rank"))
    return locations.groupBy("probe_id").agg(F.min(at).alias("rank"))


def positional_diff(left: DataFrame, right: DataFrame, within: str, index: str, value: str) -> DataFrame:
    """(within, same, changed, only_left, only_right) of two chunkings, piece by piece."""
    j = left.select(within, index, F.col(value).alias("a")).join(right.select(within, index, F.col(value).alias("b")), [within, index], "full_outer")
    return j.groupBy(within).agg(F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"))


def speakers(turns: DataFrame) -> DataFrame:
    """(conv_id, role, n, chars, share): who says how much of a conversation."""
    w = Window.partitionBy("conv_id")
    g = turns.groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return g.withColumn("share", F.round(F.col("chars") / F.greatest(F.sum("chars").over(w), F.lit(1)), 6))
