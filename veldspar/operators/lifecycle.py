"""Commands on registry rows: reindexing, skip and duplicate marks, attribution. Each returns the rows to write."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename

#: Fixed value: statuses whose content is on its way or stored already; a skip rule leaves such rows alone.
IN_FLIGHT = ("submitted", "processing", "ingested")


def reindex_block(force: bool = False) -> Column:
    """Why a row (status, validation_state, query_ready) isn't sent again; null if nothing stands against it."""
    if force:
        return F.lit(None).cast("string")
    status, state = F.col("status"), F.col("validation_state")
    return (
        F.when(F.col("query_ready"), "ingested")
        .when(status.isin("submitted", "processing"), "processing_upstream")
        .when((status == "rejected") | (state == "reject"), "validation_rejected")
        .when(state == "auto_split", "split_required")
    )


def reindex(docs: DataFrame, force: bool = False) -> DataFrame:
    """``docs`` with outcome (queued or blocked), reason and previous_status; queued rows start again as pending.

    A queued row loses its track and readiness, and its error code says who asked.
    """
    judged = docs.withColumn("reason", reindex_block(force))
    free = F.col("reason").isNull()
    return judged.withColumns({
        "outcome": F.when(free, "queued").otherwise("blocked"), "previous_status": F.col("status"), "status": F.when(free, "pending").otherwise(F.col("status")),
        "error_code": F.when(free, "reindex_requested").otherwise(F.col("error_code")), "query_ready": F.when(free, False).otherwise(F.col("query_ready")),
        "track_id": F.when(~free, F.col("track_id")), "retry_count": F.when(free, 0).otherwise(F.col("retry_count")),
    })


#: Why a row isn't sent again, in words.
BLOCKED = {
    "ingested": "Document is already query-ready; use force=true to resubmit intentionally",
    "processing_upstream": "Document is already in the upstream ingestion workflow; use force=true to replace that submission",
    "validation_rejected": "Document is validation-rejected; use force=true to send it back through worker validation",
    "split_required": "Document is blocked for manual splitting; use force=true only if you want the worker to re-evaluate the same file",
}
REQUESTED = "Operator requested reindex; worker will resubmit through normal flow"
SELECTORS = ("document_id", "path", "status", "validation_state", "company", "source_type")


def marked_for_reindex(warnings: Column, force: bool, scope: str, status: Column, state: Column) -> Column:
    """A row's JSON notes with the marker of a reindex in them: what is there already stays, notes that aren't JSON are kept under legacy_warning."""
    empty = F.expr("cast(map() as map<string,variant>)")
    fields = lambda v: F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), empty)
    text = lambda c: c.cast("variant")
    raw = F.coalesce(F.nullif(F.trim(warnings), F.lit("")), F.lit("{}"))
    parsed = F.try_parse_json(raw)
    notes = F.when(parsed.isNull(), F.create_map(F.lit("legacy_warning"), text(warnings))).otherwise(fields(parsed))
    asked = {"requested_from_status": text(status), "requested_from_validation_state": text(state)}
    ours = {"reindex_requested": text(F.lit(True)), "reindex_force": text(F.lit(force)), **asked}
    keep = lambda m, names: F.map_filter(m, lambda k, v: ~k.isin(*names))
    named = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v)])
    worker = F.map_concat(keep(fields(F.element_at(notes, "worker")), list(ours)), named(ours))
    told = named({"force": text(F.lit(force)), "scope": F.parse_json(F.lit(scope)), **asked})
    whole = F.map_concat(keep(notes, ["worker", "reindex"]), named({"worker": F.to_variant_object(worker), "reindex": F.to_variant_object(told)}))
    return F.to_json(F.to_variant_object(whole))


def request_reindex(docs: DataFrame, force: bool = False, **wanted) -> DataFrame:
    """Rows that the selectors (SELECTORS) choose, judged by ``reindex``, with error_stage, error_message, error_detail, message and warnings_json.

    Queued rows carry the marker that ``reindex_requested`` reads, and who asked for what; blocked rows keep what they had and say in
    ``message`` why. At least one selector is needed. ``docs`` has SELECTORS, error_code, query_ready, track_id, retry_count and warnings_json.
    """
    chosen = {k: v for k, v in wanted.items() if v is not None}
    if not chosen or set(chosen) - set(SELECTORS):
        raise ValueError(f"reindexing needs one of {', '.join(SELECTORS)} at least, and no other")
    scope = json.dumps(chosen, sort_keys=True, default=str)
    fits = reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in chosen.items()))
    j = reindex(docs.where(fits).withColumn("_state", F.col("validation_state")), force)
    free = F.col("outcome") == "queued"
    message = F.create_map(*[F.lit(x) for kv in BLOCKED.items() for x in kv])[F.col("reason")]
    kept = lambda c, new: F.when(free, new).otherwise(F.col(c) if c in docs.columns else F.lit(None).cast("string"))
    return j.withColumns({
        "message": message, "error_stage": kept("error_stage", F.lit("reindex")), "error_message": kept("error_message", F.lit(REQUESTED)), "error_detail": kept("error_detail", F.lit(json.dumps({"force": force, "scope": chosen}, sort_keys=True, default=str))),
        "warnings_json": kept("warnings_json", marked_for_reindex(F.col("warnings_json"), force, scope, F.col("previous_status"), F.col("_state"))),
    }).drop("_state")


def reindex_requested(docs: DataFrame, warnings: str = "warnings_json") -> Column:
    """Whether the marker of a reindex stands in the row's JSON notes; broken notes have none."""
    return F.coalesce(F.get_json_object(warnings, "$.worker.reindex_requested") == "true", F.lit(False))


def skipped_by_name(files: DataFrame, registry: DataFrame, names: Sequence[str]) -> DataFrame:
    """(path, sha256, status, error_code, error_detail): files (path, sha256) whose base name a rule excludes.

    Rows in flight or stored are left alone, and so are those that carry the mark already: a second
    run returns nothing. Base names are compared whole, without case.
    """
    own = F.lower(basename(F.col("path")))
    hit = files.where(own.isin(*[n.lower() for n in names])).select("path", "sha256", F.concat(F.lit("skipped by basename rule: "), own).alias("detail"))
    known = registry.select("path", F.col("status").alias("_s"), F.col("error_code").alias("_e"), F.col("error_detail").alias("_d"))
    settled = (F.col("_s") == "skipped") & (F.col("_e") == "skipped_by_name") & F.col("_d").eqNullSafe(F.col("detail"))
    todo = hit.join(known, "path", "left").where(~F.coalesce(settled | F.col("_s").isin(*IN_FLIGHT), F.lit(False)))
    return todo.select("path", "sha256", F.lit("skipped").alias("status"), F.lit("skipped_by_name").alias("error_code"), F.col("detail").alias("error_detail"))


def duplicate_marks(registry: DataFrame, picks: DataFrame) -> DataFrame:
    """(document_id, status, error_code, error_detail): rows that ``picks`` (document_id, duplicate_of, match_count) calls copies.

    Rows marked so already aren't written again.
    """
    detail = F.concat(F.lit("Duplicate content matches "), F.col("duplicate_of").cast("string"), F.lit(" among "), F.col("match_count").cast("string"), F.lit(" active SHA matches"))
    told = picks.where("duplicate_of is not null").select("document_id", detail.alias("detail"))
    same = (F.col("status") == "skipped") & (F.col("error_code") == "duplicate_content") & (F.col("error_detail") == F.col("detail"))
    todo = registry.join(told, "document_id").where(~F.coalesce(same, F.lit(False)))
    return todo.select("document_id", F.lit("skipped").alias("status"), F.lit("duplicate_content").alias("error_code"), F.col("detail").alias("error_detail"))


def attribution_changes(registry: DataFrame, found: DataFrame, fields: Sequence[str] = ("company", "company_source", "company_source_detail")) -> DataFrame:
    """(path, *fields): rows whose attribution differs from that ``found`` at their path; nulls equal nulls."""
    j = registry.select("path", F.struct(*fields).alias("_old")).join(found.select("path", F.struct(*fields).alias("_new")), "path")
    return j.where(~F.col("_old").eqNullSafe(F.col("_new"))).select("path", "_new.*")
