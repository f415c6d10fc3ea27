"""Probe manifests, run exports and logs as rows, with every problem kept as a row instead of stopping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups of probes in a manifest and their shapes, names a field may have, labels and what they stand for, fields of a log.
BUCKETS = {"scoped": "scoped", "cross_company": "cross-company", "unanswerable": "unanswerable"}
ALIASES = {
    "question": ("question", "query", "prompt"),
    "label": ("label", "verdict", "grade", "judgement", "judgment"),
    "company": ("company", "company_scope", "scope"),
    "request_id": ("request_id", "requestid", "trace_id", "correlation_id"),
    "draw": ("draw", "attempt", "repeat", "iteration"),
}
LABEL_ROLES = {"correct": "accepted", "partial": "accepted", "wrong": "accepted", "refused": "refused", "refused_ok": "refused", "refused_wrong": "refused", "hallucinated": "hallucinated", "timeout": "not_an_answer", "error": "not_an_answer"}
LOG_FIELDS = ("grounding_checked", "grounding_verdict", "grounding_asked", "grounding_unsupported", "grounding_evidence_pass", "grounding_references_without_content", "grounding_supported", "grounding_asked_unsupported")
PROBLEM = "source string, where string, problem string"


def objects(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((source, line, v), problems): JSON objects of lines (source, line, text); blank lines count for nothing."""
    said = lines.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select("source", "line", F.try_parse_json("text").alias("v"))
    is_object = F.try_variant_get("v", "$", "map<string,variant>").isNotNull()
    problem = F.when(F.col("v").isNull(), "not JSON").otherwise(F.concat(F.lit("JSON "), F.lower(F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)), F.lit(", expected object")))
    where = F.concat(F.lit("line "), F.col("line").cast("string"))
    return said.where(is_object), said.where(~is_object).select("source", where.alias("where"), problem.alias("problem"))


def field(v: Column, name: str, kind: str = "string") -> Column:
    """A field of an object, null unless it is of that kind; strings stay strings, numbers don't become such."""
    raw = F.try_variant_get(v, f"$.{name}", "variant")
    if kind == "string":
        return F.when(F.schema_of_variant(raw) == "STRING", raw.cast("string"))
    return F.try_variant_get(v, f"$.{name}", kind)


def resolved(v: Column, name: str, aliases: Mapping[str, Sequence[str]] = ALIASES) -> Column:
    """The value under the first of its names that the object has, even if null; as VARIANT."""
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    return reduce(lambda rest, n: F.when(F.map_contains_key(fields, n), fields[n]).otherwise(rest), reversed(aliases[name]), F.lit(None).cast("variant"))


def manifests(files: DataFrame, buckets: Mapping[str, str] = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """((company, question, shape, probe_entries, total_entries), problems) of manifests (source, text), each a JSON object.

    A probe is known by its company and words. Words may be repeated within a shape, which counts;
    the same words in another shape contradict the first by source, group and position, and are a problem.
    Further problems: no JSON, no company, no probes, unknown groups, groups that aren't lists, rows that aren't
    objects, that have no question, or whose shape isn't their group's. What can be read beside a problem is read.
    """
    m = files.select("source", F.try_parse_json("text").alias("v"))
    company = field(F.col("v"), "company")
    block = F.try_variant_get("v", "$.probes", "map<string,variant>")
    m = m.withColumns({"company": company, "block": block})
    whole = F.when(F.col("v").isNull(), "manifest is not valid JSON").when(F.coalesce(F.col("company") == "", F.lit(True)), "manifest has no 'company' string").when(F.col("block").isNull(), "manifest has no 'probes' object")
    m = m.withColumn("bad", whole)
    problems = m.where("bad is not null").select("source", F.lit("").alias("where"), F.col("bad").alias("problem"))
    fine = m.where("bad is null")
    unknown = F.array_sort(F.array_except(F.map_keys("block"), F.array(*[F.lit(b) for b in buckets])))
    problems = problems.unionByName(fine.select("source", F.lit("probes").alias("where"), F.explode(unknown).alias("u")).select("source", "where", F.concat(F.lit("unrecognised probe shape key "), F.col("u")).alias("problem")))
    each = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(b).alias("bucket"), F.lit(s).alias("shape"), F.col("block")[b].alias("list")) for i, (b, s) in enumerate(buckets.items())])
    groups = fine.select("source", "company", F.explode(each).alias("g")).select("source", "company", "g.*").where("list is not null").withColumn("rows", F.try_variant_get("list", "$", "array<variant>"))
    where = F.concat(F.lit("probes."), F.col("bucket"))
    problems = problems.unionByName(groups.where("rows is null").select("source", where.alias("where"), F.lit("not a list").alias("problem")))
    rows = groups.where("rows is not null").select("source", "company", "order", "bucket", "shape", F.posexplode("rows").alias("i", "r"))
    question, declared = field(F.col("r"), "question"), field(F.col("r"), "shape")
    wrong = (
        F.when(F.try_variant_get("r", "$", "map<string,variant>").isNull(), "not an object").when(F.coalesce(F.trim(question) == "", F.lit(True)), "no 'question' string")
        .when(~declared.eqNullSafe(F.col("shape")), F.concat(F.lit("shape does not match its group, expected "), F.col("shape")))
    )
    spot = F.concat(F.lit("probes."), F.col("bucket"), F.lit("["), F.col("i").cast("string"), F.lit("]"))
    rows = rows.withColumns({"question": question, "wrong": wrong, "spot": spot})
    problems = problems.unionByName(rows.where("wrong is not null").select("source", F.col("spot").alias("where"), F.col("wrong").alias("problem")))
    good = rows.where("wrong is null").select("company", "question", "shape", "source", "spot", F.struct("source", "order", "i").alias("at"))
    first = good.groupBy("company", "question").agg(F.min_by("shape", "at").alias("first_shape"))
    judged = good.join(first, ["company", "question"])
    crossed = judged.where("shape <> first_shape").select("source", F.col("spot").alias("where"), F.concat(F.lit("the same question text also appears as shape "), F.col("first_shape")).alias("problem"))
    kept = judged.where("shape = first_shape").groupBy("company", "question", "shape").agg(F.count("*").alias("probe_entries"))
    total = kept.agg(F.sum("probe_entries").alias("total_entries"))
    return kept.join(F.broadcast(total)), problems.unionByName(crossed)  # one row


def exports(lines: DataFrame, roles: Mapping[str, str] = LABEL_ROLES) -> tuple[DataFrame, DataFrame]:
    """((source, line, question, label, role, company, request_id, draw), problems) of a run's rows under any of their known names.

    A row without a question or label, or with an unknown label, is a problem and stays with what it has.
    """
    rows, problems = objects(lines)
    v = F.col("v")
    text = lambda c: F.when(F.schema_of_variant(c) == "STRING", c.cast("string"))
    r = rows.withColumns({n: resolved(v, n) for n in ALIASES})
    there = lambda n: F.col(n).isNotNull() & (F.schema_of_variant(n) != "VOID")
    label = F.lower(F.trim(text(F.col("label"))))
    role = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])[label]
    r = r.withColumns({"_label": label, "role": role})
    checks = F.array_compact(F.array(
        F.when(~there("question"), "no 'question' field"), F.when(~there("label"), "no 'label' field"),
        F.when(there("label") & F.col("_label").isNull(), "label is not a string"), F.when(F.col("_label").isNotNull() & F.col("role").isNull(), F.concat(F.lit("unrecognised label "), F.col("_label"))),
    ))
    where = F.concat(F.lit("line "), F.col("line").cast("string"))
    found = r.select("source", where.alias("where"), F.explode(checks).alias("problem"))
    out = r.select("source", "line", text(F.col("question")).alias("question"), F.col("_label").alias("label"), "role", text(F.col("company")).alias("company"), text(F.col("request_id")).alias("request_id"), F.to_json("draw").alias("draw"))
    return out, problems.unionByName(found)


def query_logs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((source, line, request_id, checked, v), problems): lines of a query log.

    A line that carries the nested form is refused, as is one without a request id; one without the newer fields is kept and told.
    """
    rows, problems = objects(lines)
    fields = F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))
    nested = F.array_contains(fields, "grounding") & ~F.arrays_overlap(fields, F.array(*[F.lit(f) for f in LOG_FIELDS]))
    r = rows.withColumns({"request_id": field(F.col("v"), "request_id"), "checked": field(F.col("v"), "grounding_checked", "boolean"), "_nested": nested, "_new": F.array_contains(fields, "grounding_checked")})
    refused = F.when(F.col("_nested"), "carries a nested 'grounding' object, not the log's fields").when(F.coalesce(F.col("request_id") == "", F.lit(True)), "query-log line without 'request_id'")
    told = F.coalesce(refused, F.when(~F.col("_new"), "no 'grounding_checked' field"))
    where = F.concat(F.lit("line "), F.col("line").cast("string"))
    return r.where(refused.isNull()).select("source", "line", "request_id", "checked", "v"), problems.unionByName(r.where(told.isNotNull()).select("source", where.alias("where"), told.alias("problem")))


def twice(rows: DataFrame, key: str) -> DataFrame:
    """(source, where, problem): rows whose id stands in more than one place; the first by source keeps it."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("source", "line"))
    return rows.where(F.col(key).isNotNull()).withColumn("_n", nth).where("_n > 1").select("source", F.concat(F.lit("line "), F.col("line").cast("string")).alias("where"), F.concat(F.lit("id "), F.col(key).cast("string"), F.lit(" appears more than once")).alias("problem"))
