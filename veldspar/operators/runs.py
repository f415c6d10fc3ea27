"""Runs of probes: joins that refuse to guess, enrichment of citations, near misses, means over draws, integrity rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename
from .retrieval import contained

#: How a citation can name a row, best first; what a citation takes over from its row; verdicts that count.
VIAS = ("submitted_source", "path", "filename", "original_filename", "basename")
ENRICHED = ("document_id", "path", "company", "company_source", "company_source_detail", "source_type", "query_ready", "readiness_reason")
VERDICTS = ("correct", "partial", "wrong", "hallucinated", "refused_ok", "refused_wrong")
UNANSWERABLE = "(?i)(not in the documents|not available|not mentioned|unanswerable|no answer)"
#: Fixed values of probe sets.
TYPES = ("single-fact", "multi-fact", "follow-up", "combine", "unanswerable")
SHAPES = ("fact", "synthesis", "table", "pdf", "docx", "pptx", "deep-turn", "unanswerable", "near-miss")
UNANSWERABLE_SHAPES = ("unanswerable", "near-miss")
PROBE_ID = r"^[a-z]{2,4}\d{2,3}$"
MOST_EVIDENCE = 300
DIFFICULTIES = ("easy", "medium", "hard")
KEY_FIELDS = ("id", "source_doc", "evidence", "expected_answer", "key_phrases", "location", "difficulty", "shape", "type")
NOT_THERE = "not in the documents"


def primary_rows(matches: DataFrame, within: Sequence[str], allowed: Column) -> DataFrame:
    """One row of ``matches`` (via, company, path, ...) for each citation: the best way of naming, then allowed companies, then by company and path."""
    way = reduce(lambda acc, v: F.when(F.col("via") == v, VIAS.index(v)).otherwise(acc), VIAS, F.lit(len(VIAS)))
    ours = F.when(F.coalesce(F.array_contains(allowed, F.col("company")), F.lit(False)), 0).otherwise(1)
    rank = F.struct(way.alias("way"), ours.alias("ours"), F.coalesce("company", F.lit("")).alias("c"), F.coalesce("path", F.lit("")).alias("p"))
    rest = [c for c in matches.columns if c not in within]
    # the minimum is kept in each task, so that a citation of many rows is no hot group
    best = matches.groupBy(*within).agg(F.min(F.struct(rank.alias("rank"), F.struct(*rest).alias("row"))).alias("b"))
    return best.select(*within, "b.row.*")


def enrich(citations: DataFrame, primary: DataFrame, key: Sequence[str], path: str = "path") -> DataFrame:
    """Citations with the columns ENRICHED of their row; a citation keeps its own path, one without a row gets nulls."""
    own = primary.select(*key, *[F.col(c).alias(f"_{c}") for c in ENRICHED])
    j = citations.join(own, list(key), "left")
    added = {c: F.col(f"_{c}") for c in ENRICHED if c != "path"} | {"path": F.coalesce(F.nullif(F.trim(path), F.lit("")), "_path")}
    return j.withColumns(added).drop(*[f"_{c}" for c in ENRICHED])


def join_log(results: DataFrame, log: DataFrame, probes: DataFrame) -> DataFrame:
    """(result_id, probe_id, line_id, problem): each result with its log line, or why it has none.

    ``results`` (result_id, probe_id, request_id, question) meet ``log`` (line_id, request_id, query) on the
    request; without one on the question, if neither side repeats it. Nothing is guessed: a key that
    several lines share is a problem. Only counts by key are joined, so a key of many rows makes no pairs.
    """
    line = lambda key, n: log.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(n)).agg(F.min("line_id").alias(f"{n}_line"), F.count("*").alias(f"{n}_n"))
    asked = results.where("question is not null").groupBy(F.col("question").alias("_asked")).agg(F.count("*").alias("asked_n"))
    known = probes.select(F.col("probe_id").alias("_probe")).distinct().withColumn("known", F.lit(True))
    j = results.join(known, F.col("probe_id") == F.col("_probe"), "left").join(asked, F.col("question") == F.col("_asked"), "left")
    j = j.join(line("request_id", "r"), F.col("request_id") == F.col("r"), "left").join(line("query", "q"), F.col("question") == F.col("q"), "left")
    by_request = F.col("request_id").isNotNull()
    problem = (
        F.when(F.col("known").isNull(), "no_probe")
        .when(by_request, F.when(F.col("r_n") > 1, "request_repeats").when(F.col("r_n").isNull(), "no_line"))
        .when(F.col("question").isNull(), "no_key")
        .when(F.col("asked_n") > 1, "question_repeats")
        .when(F.col("q_n") > 1, "several_lines")
        .when(F.col("q_n").isNull(), "no_line")
    )
    found = F.when(by_request, F.col("r_line")).otherwise(F.col("q_line"))
    return j.withColumn("problem", problem).select("result_id", "probe_id", F.when(F.col("problem").isNull(), found).alias("line_id"), "problem")


def join_manifest(results: DataFrame, probes: DataFrame) -> DataFrame:
    """(result_id, probe_id, problem): by company and question, or by a question that only one probe asks if the result names no company.

    ``results`` has (result_id, company, question), ``probes`` (probe_id, company, question).
    """
    both = probes.groupBy(F.col("company").alias("_c"), F.col("question").alias("_q")).agg(F.min("probe_id").alias("exact"))
    alone = probes.groupBy(F.col("question").alias("_only")).agg(F.min("probe_id").alias("single"), F.count("*").alias("n"))
    j = results.join(both, (F.col("company") == F.col("_c")) & (F.col("question") == F.col("_q")), "left").join(alone, F.col("question") == F.col("_only"), "left")
    named = F.col("company").isNotNull()
    probe = F.when(named, F.col("exact")).when(F.col("n") == 1, F.col("single"))
    problem = F.when(F.col("question").isNull(), "no_question").when(probe.isNull(), F.when(named, "no_probe").when(F.col("n") > 1, "several_probes").otherwise("no_probe"))
    return j.select("result_id", probe.alias("probe_id"), problem.alias("problem"))


def near_misses(asked: DataFrame, pool: DataFrame) -> DataFrame:
    """(code, same_first_segment, same_company_code, shares_a_subtoken): how many other codes of the pool are lookalikes.

    ``asked`` has (code, company_code), ``pool`` (code). A lookalike starts with the same segment,
    with the company's code and a hyphen, or holds the code. The pool is counted by segment, prefix and
    substring before it is joined, so that no pairs are formed; codes are short.
    """
    codes = pool.where("code is not null").select("code").distinct()
    first = codes.groupBy(F.substring_index("code", "-", 1).alias("_first")).agg(F.count("*").alias("n_first"))
    parts = F.split("code", "-")
    prefix = codes.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "-"))).alias("_prefix"))
    prefix = prefix.groupBy("_prefix").agg(F.count("*").alias("n_prefix"))
    sizes = asked.select(F.length("code").alias("_n")).where("_n > 0").distinct()  # one row for each length of a code
    inside = codes.join(F.broadcast(sizes), F.length("code") >= F.col("_n")).select("code", F.explode(F.sequence(F.lit(1), F.length("code") - F.col("_n") + 1)).alias("_at"), "_n")
    inside = inside.select("code", F.substring("code", F.col("_at"), F.col("_n")).alias("_part")).distinct().groupBy("_part").agg(F.count("*").alias("n_part"))
    own = codes.select(F.col("code").alias("_own")).withColumn("listed", F.lit(1))
    j = asked.where("code is not null").select("code", "company_code").distinct().join(own, F.col("code") == F.col("_own"), "left")
    j = j.join(first, F.substring_index("code", "-", 1) == F.col("_first"), "left").join(prefix, F.col("company_code") == F.col("_prefix"), "left").join(inside, F.col("code") == F.col("_part"), "left")
    others = lambda n, counts: (F.coalesce(n, F.lit(0)) - F.when(counts, F.coalesce("listed", F.lit(0))).otherwise(0)).cast("long")
    mine = F.coalesce(F.startswith("code", F.concat("company_code", F.lit("-"))), F.lit(False))
    return j.select("code", others(F.col("n_first"), F.lit(True)).alias("same_first_segment"), others(F.col("n_prefix"), mine).alias("same_company_code"), others(F.col("n_part"), F.lit(True)).alias("shares_a_subtoken"))


def probe_means(rows: DataFrame) -> DataFrame:
    """(id, score, draws): 1 for correct, 0.5 for partial, else 0, averaged over the draws of a probe; verdicts that say nothing are left out."""
    score = F.when(F.col("verdict") == "correct", 1.0).when(F.col("verdict") == "partial", 0.5).otherwise(0.0)
    return rows.where(F.col("verdict").isin(*VERDICTS)).groupBy("id").agg(F.avg(score).alias("score"), F.count("*").alias("draws"))


def is_unanswerable(expected: Column) -> Column:
    """Whether the expected answer is blank or says that there is none."""
    return (F.trim(F.coalesce(expected, F.lit(""))) == "") | F.coalesce(expected.rlike(UNANSWERABLE), F.lit(False))


def plain(text: Column) -> Column:
    """Lower case, white space as one space, trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def in_context(probes: DataFrame, quotes: DataFrame, units: DataFrame) -> DataFrame:
    """(probe, said): hit, miss, or na where a probe has no quote. Units (probe, rank, text) are joined first, so a quote may run over seams."""
    whole = units.groupBy("probe").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("u"))  # one answer's context
    whole = whole.select("probe", plain(F.array_join(F.transform("u", lambda x: x["text"]), " \n ")).alias("hay"))
    q = quotes.where(F.trim("quote") != "").select("probe", plain(F.col("quote")).alias("needle"))
    held = q.join(whole, "probe", "left").groupBy("probe").agg(F.max(F.coalesce(F.contains("hay", "needle"), F.lit(False))).alias("held"))
    return probes.select("probe").join(held, "probe", "left").select("probe", F.when(F.col("held").isNull(), "na").when(F.col("held"), "hit").otherwise("miss").alias("said"))


def merge_answers(questions: DataFrame, answers: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Questions with ``fields`` of the answer of their id where it has them; a question without an answer stays as it is."""
    own = answers.groupBy(F.col("id").alias("_id")).agg(F.min(F.struct(*fields)).alias("_a"))
    j = questions.join(own, F.col("id") == F.col("_id"), "left")
    got = {f: F.coalesce(F.col(f"_a.{f}"), F.col(f)) if f in questions.columns else F.col(f"_a.{f}") for f in fields}
    return j.withColumns(got).drop("_id", "_a")


def question_problems(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, problem): one row for each broken rule of questions (id, question, source_doc, type, shape, absent_terms).

    Where they are among the columns: history (array) belongs to follow-ups and to no others, evidence and expected_answer stay empty in a question file.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    names = sources.select(F.col("name").alias("_name")).distinct().withColumn("_there", F.lit(True))
    ids = questions.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_n"))
    j = questions.join(names, basename(F.col("source_doc")) == F.col("_name"), "left").join(ids, F.col("id") == F.col("_id"), "left")
    none = F.col("shape").isin(*UNANSWERABLE_SHAPES)
    rules = {f"{c}_missing": blank(c) for c in ("id", "question", "source_doc", "type", "shape")} | {
        "id_pattern": ~F.col("id").rlike(PROBE_ID), "id_repeats": F.col("_n") > 1, "type_unknown": ~F.col("type").isin(*TYPES), "shape_unknown": ~F.col("shape").isin(*SHAPES),
        "type_of_unanswerable": none & (F.col("type") != "unanswerable"), "absent_terms": none & ~F.coalesce(F.size("absent_terms").between(3, 6), F.lit(False)), "source_missing": F.col("_there").isNull(),
    }
    if "history" in questions.columns:
        told, follows = F.coalesce(F.size("history"), F.lit(0)) > 0, F.coalesce(F.col("type") == "follow-up", F.lit(False))
        rules |= {"history_missing": follows & ~told, "history_unasked": ~follows & told}
    rules |= {f"{c}_given": ~blank(c) for c in ("evidence", "expected_answer") if c in questions.columns}
    broken = F.array_compact(F.array(*[F.when(F.coalesce(broke, F.lit(False)), name) for name, broke in rules.items()]))
    return j.select("id", F.explode(broken).alias("problem"))


def answer_problems(answers: DataFrame, questions: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, problem): one row for each broken rule of answers (id, source_doc, evidence, key_phrases, start, end), and one for each question without an answer.

    Evidence stands in its source word for word and in its span, key phrases in the evidence; every question has its answer. With a column ``shape``, rows of
    UNANSWERABLE_SHAPES have no evidence, an expected answer that says so, and a distinctive phrase and absent terms that no source at all holds; an absent
    term is told by its place and a hash. Further columns of KEY_FIELDS are judged where they are there: a field may not be null, a difficulty is a known one.
    """
    text = sources.groupBy(F.col("name").alias("_name")).agg(F.min("text").alias("_text"))
    asked = questions.groupBy(F.col("id").alias("_q")).agg(F.min("source_doc").alias("_doc"))
    ids = answers.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_n"))
    j = answers.withColumn("_row", F.monotonically_increasing_id()).join(text, basename(F.col("source_doc")) == F.col("_name"), "left").join(asked, F.col("id") == F.col("_q"), "left").join(ids, F.col("id") == F.col("_id"), "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    has = lambda c: c in answers.columns
    none = F.coalesce(F.col("shape").isin(*UNANSWERABLE_SHAPES), F.lit(False)) if has("shape") else F.lit(False)
    said, there = plain(F.col("evidence")), F.col("_text").isNotNull()
    given = ~none & there & ~blank("evidence")
    span = F.substring("_text", F.col("start") + 1, F.col("end") - F.col("start"))
    placed = F.coalesce((F.col("start") >= 0) & (F.col("end") > F.col("start")), F.lit(False))
    rules = {f"{c}_missing": F.col(c).isNull() for c in KEY_FIELDS if has(c) and c not in ("evidence", "key_phrases")} | {
        "id_repeats": F.col("_n") > 1, "no_question": F.col("_q").isNull(), "source_differs": ~F.col("source_doc").eqNullSafe(F.col("_doc")) & F.col("_q").isNotNull(), "source_missing": ~there,
        "evidence_missing": there & ~none & ~given, "evidence_long": given & (F.length("evidence") > MOST_EVIDENCE), "evidence_not_in_source": given & ~F.contains(plain(F.col("_text")), said),
        "key_phrases": given & (F.coalesce(F.size("key_phrases"), F.lit(0)) < 1), "phrase_not_in_evidence": given & F.exists("key_phrases", lambda p: ~F.contains(said, plain(p))),
        "no_span": given & ~placed, "span_past_end": given & placed & (F.col("end") > F.length("_text")), "span_differs": given & placed & (F.col("end") <= F.length("_text")) & (plain(span) != "") & (plain(span) != said),
        "evidence_of_unanswerable": there & none & ~blank("evidence"),
    }
    if has("difficulty"):
        rules["difficulty_unknown"] = F.col("difficulty").isNotNull() & ~F.col("difficulty").isin(*DIFFICULTIES)
    if has("expected_answer"):
        rules |= {"expected_answer_blank": given & blank("expected_answer"), "expected_answer_unsaid": there & none & ~F.coalesce(F.contains("expected_answer", F.lit(NOT_THERE)), F.lit(False))}
    if has("distinctive_phrase"):
        rules["distinctive_phrase_missing"] = there & none & blank("distinctive_phrase")
    if has("absent_terms"):
        rules["absent_term_blank"] = there & none & F.exists("absent_terms", lambda t: F.coalesce(F.trim(t), F.lit("")) == "")
    broken = F.array_compact(F.array(*[F.when(F.coalesce(broke, F.lit(False)), name) for name, broke in rules.items()]))
    found = j.select("id", F.explode(broken).alias("problem"))
    # phrases that no source may hold: each meets the sources' words on an anchor, not text by text
    phrases = [(F.array(F.struct(F.lit("distinctive_phrase_in_source").alias("problem"), F.col("distinctive_phrase").alias("needle"))) if has("distinctive_phrase") else None), (
        F.transform("absent_terms", lambda t, i: F.struct(F.concat(F.lit("absent_term_in_source #"), (i + 1).cast("string"), F.lit(" "), F.substring(F.sha2(plain(t), 256), 1, 8)).alias("problem"), t.alias("needle"))) if has("absent_terms") else None)]
    named = [F.coalesce(p, F.array().cast("array<struct<problem:string,needle:string>>")) for p in phrases if p is not None]
    if named:
        n = j.where(there & none).select("id", F.explode(F.concat(*named)).alias("p")).select("id", "p.problem", plain(F.col("p.needle")).alias("needle")).where("needle <> ''")
        held = contained(sources.select(plain(F.coalesce("text", F.lit(""))).alias("t")), n.select(F.struct("id", "problem").alias("probe"), "needle"), [])
        found = found.unionByName(held.select("probe.id", "probe.problem"))
    unanswered = questions.select("id").distinct().join(answers.select("id").distinct(), "id", "left_anti").select("id", F.lit("no_answer").alias("problem"))
    return found.unionByName(unanswered)


def separation(probes: DataFrame, ranked: DataFrame, chunk_codes: DataFrame, k: int = 16) -> DataFrame:
    """One row for each shape: does a score tell answerable probes from others, or does the code?

    ``probes`` has (probe, shape, code), ``ranked`` (probe, chunk, rank, score), as far as it goes, ``chunk_codes`` (chunk, code), the planted codes of each chunk. Columns: probes,
    code_in_top_k, other planted codes in the top k (lookalikes_min, _max), the best score (min, median: the upper of two, max; 0 without a chunk), rank of the first chunk that has the code (min, max) and with_code_chunk.
    """
    top = ranked.where(F.col("rank") <= k)
    best = top.groupBy("probe").agg(F.max("score").alias("best"))
    own = probes.select("probe", "code").join(ranked.select("probe", "chunk", "rank"), "probe").join(chunk_codes.distinct(), ["chunk", "code"]).groupBy("probe").agg(F.min("rank").alias("first"))
    others = top.select("probe", "chunk").join(chunk_codes.withColumnRenamed("code", "other"), "chunk").join(probes.select("probe", "code"), "probe").where("other <> code").groupBy("probe").agg(F.countDistinct("other").alias("others"))
    j = probes.select("probe", "shape").join(best, "probe", "left").join(own, "probe", "left").join(others, "probe", "left").withColumns({"best": F.coalesce("best", F.lit(0.0)), "others": F.coalesce("others", F.lit(0).cast("long"))})
    at = Window.partitionBy("shape").orderBy("best", "probe")
    j = j.withColumns({"_n": F.row_number().over(at) - 1, "_of": F.count("*").over(Window.partitionBy("shape"))})
    g = j.groupBy("shape").agg(
        F.count("*").alias("probes"), F.count_if(F.col("first") <= k).alias("code_in_top_k"), F.min("others").alias("lookalikes_min"), F.max("others").alias("lookalikes_max"), F.round(F.min("best"), 4).alias("best_min"),
        F.round(F.max(F.when(F.col("_n") == F.floor(F.col("_of") / 2), F.col("best"))), 4).alias("best_median"), F.round(F.max("best"), 4).alias("best_max"), F.min("first").alias("rank_min"), F.max("first").alias("rank_max"), F.count("first").alias("with_code_chunk"),
    )
    return g


def survival(codes: DataFrame, docs: DataFrame, cleaned: Column, pieces: DataFrame) -> DataFrame:
    """One row: codes (doc_id, code), and how many are not in the text, lost by cleaning it, lost by cutting it into pieces (doc_id, body)."""
    held = codes.join(pieces, "doc_id").where(F.contains("body", "code")).select("doc_id", "code").distinct().withColumn("kept", F.lit(True))
    j = codes.join(docs.select("doc_id", F.col("text").alias("_raw"), cleaned.alias("_clean")), "doc_id", "left").join(held, ["doc_id", "code"], "left")
    raw, clean = F.coalesce(F.contains("_raw", "code"), F.lit(False)), F.coalesce(F.contains("_clean", "code"), F.lit(False))
    return j.agg(F.count("*").alias("total"), F.count_if(~raw).alias("missing_in_raw"), F.count_if(raw & ~clean).alias("lost_to_cleaning"), F.count_if(raw & clean & F.col("kept").isNull()).alias("lost_to_pieces"))


def improves(base: Column, graph: Column) -> Column:
    """Whether the terms that graph evidence covers hold one that the base evidence lacks."""
    return F.size(F.array_except(F.coalesce(graph, F.array().cast("array<string>")), F.coalesce(base, F.array().cast("array<string>")))) > 0
