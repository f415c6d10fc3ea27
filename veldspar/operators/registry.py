"""Document registry: verdicts, guarded lifecycle, duplicates, supersession, rollups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The lifecycle and its legal moves, file classes, thresholds.
STATUSES = ("pending", "validating", "accepted", "submitted", "processing", "ingested", "failed", "rejected", "superseded", "skipped")
MOVES = {
    "pending": ("validating", "accepted", "submitted", "processing", "failed", "rejected", "superseded", "skipped"),
    "validating": ("pending", "accepted", "submitted", "processing", "failed", "rejected", "superseded", "skipped"),
    "accepted": ("pending", "validating", "submitted", "processing", "failed", "rejected", "superseded", "skipped"),
    "submitted": ("pending", "validating", "accepted", "processing", "ingested", "failed", "rejected", "superseded", "skipped"),
    "processing": ("pending", "validating", "accepted", "submitted", "ingested", "failed", "rejected", "superseded", "skipped"),
    "ingested": ("pending", "validating", "accepted", "submitted", "rejected", "superseded", "skipped"),
    "failed": ("pending", "validating", "accepted", "submitted", "processing", "ingested", "rejected", "superseded", "skipped"),
    "rejected": ("pending", "validating", "accepted", "submitted", "superseded", "skipped"),
    "superseded": ("pending", "validating", "accepted", "submitted", "skipped"),
    "skipped": ("pending", "validating", "accepted", "submitted"),
}
ACTIVE = ("accepted", "submitted", "processing", "ingested")
DUPLICATE_RANK = ("ingested", "processing", "submitted", "accepted")
TEXT_LIKE = ("txt", "md", "html", "htm", "json", "csv")
OFFICE = ("pdf", "docx", "pptx", "xlsx")
SIDECARS = (".ds_store", "thumbs.db", "desktop.ini", ".localized", "icon\r")
SPLIT_FROM, WARN_FROM = 500_000, 100_000


def transitions(spark) -> DataFrame:
    """(from_status, to_status): all legal moves, staying put included; at most a hundred rows."""
    rows = [(a, b) for a, to in MOVES.items() for b in (a, *to)]
    return spark.createDataFrame(rows, "from_status string, to_status string")


def is_legal(from_status: Column, to_status: Column) -> Column:
    """A missing or unknown source may move to any known status; an unknown target is refused."""
    known = to_status.isin(*STATUSES)
    allowed = reduce(lambda acc, a: F.when(from_status == a, to_status.isin(a, *MOVES[a])).otherwise(acc), STATUSES, F.lit(True))
    return F.coalesce(known & F.when(from_status.isNull(), True).otherwise(allowed), F.lit(False))


def is_sidecar(name: Column) -> Column:
    return F.lower(name).isin(*SIDECARS) | name.startswith("._")


def file_class(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"[^./\\]\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin(*TEXT_LIKE), "text_like").when(ext.isin(*OFFICE), "binary_office").otherwise("unsupported")


def verdict(name: Column, size: Column, duplicate: Column | None = None) -> Column:
    """struct<verdict, error_code, file_class>: the first rule that applies.

    With ``duplicate`` a duplicate is told before sizes are looked at.
    """
    kind = file_class(name)
    text = kind == "text_like"
    rules = [(is_sidecar(name), "reject", "metadata_sidecar_file"), (kind == "unsupported", "reject", "unsupported_extension"), (size == 0, "reject", "empty_file")]
    if duplicate is not None:
        rules.append((F.coalesce(duplicate, F.lit(False)), "reject", "duplicate_content"))
    rules += [(text & (size >= SPLIT_FROM), "auto_split", "large_text_file"), (text & (size >= WARN_FROM), "warn", "large_text_file")]
    said, code = F.lit("accept"), F.lit(None).cast("string")
    for when, v, c in reversed(rules):
        said, code = F.when(when, v).otherwise(said), F.when(when, c).otherwise(code)
    return F.struct(said.alias("verdict"), code.alias("error_code"), F.when(is_sidecar(name), "unsupported").otherwise(kind).alias("file_class"))


def company_of(explicit: Column, relative_path: Column) -> Column:
    """The explicit company, else the first folder of a path that has one; trimmed, blank is none."""
    folder = F.when(F.instr(relative_path, "/") > 0, F.split(relative_path, "/")[0])
    clean = lambda c: F.when(F.trim(c) == "", None).otherwise(F.trim(c))
    return F.coalesce(clean(explicit), clean(folder))


def with_supersession(docs: DataFrame) -> DataFrame:
    """Adds ``superseded``: an active row names this one in supersedes_document_id."""
    by = docs.where(F.col("status").isin(*ACTIVE) & F.col("supersedes_document_id").isNotNull()).select(F.col("supersedes_document_id").alias("document_id"), F.lit(True).alias("superseded")).distinct()
    return docs.join(by, "document_id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))


def readiness(status: Column, validation: Column, error_code: Column, superseded: Column) -> Column:
    """struct<query_ready, readiness_reason>, the first reason that applies."""
    validation = F.coalesce(validation, F.lit("not_run"))
    reason = (
        F.when((status == "superseded") | superseded, "superseded")
        .when((validation == "reject") | (status == "rejected"), "validation_rejected")
        .when(validation == "auto_split", "split_required")
        .when((status == "skipped") & F.coalesce(error_code == "duplicate_content", F.lit(False)), "duplicate_content")
        .when(status == "skipped", "skipped")
        .when(status == "ingested", "ingested")
        .when(status.isin("submitted", "processing"), "processing_upstream")
        .when(status == "failed", "upstream_failed")
        .when(status.isin("pending", "validating") & (validation == "not_run"), "pending_validation")
        .when(status.isin("pending", "accepted", "validating"), "awaiting_submit")
        .otherwise("pending_validation")
    )
    return F.struct((reason == "ingested").alias("query_ready"), reason.alias("readiness_reason"))


def summary(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, value, n): counts of each column by itself, nulls skipped; one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return docs.select(F.explode(pairs).alias("p")).where("p.value is not null").groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def name_collisions(docs: DataFrame, name: str = "filename") -> DataFrame:
    """(name, rows, companies, hashes, kind) for names in more than one row."""
    g = docs.groupBy(name).agg(F.count("*").alias("n_rows"), F.countDistinct("company").alias("companies"), F.countDistinct("sha256").alias("hashes")).where("n_rows > 1")
    kind = F.when(F.col("companies") == 0, "unattributed").when(F.col("companies") == 1, "multi_row").when(F.col("hashes") == 1, "shared_identical").otherwise("ambiguous")
    return g.withColumn("kind", kind)


def pick_duplicates(docs: DataFrame, by_company: bool = False, seekers: DataFrame | None = None) -> DataFrame:
    """(document_id, duplicate_of, match_count): for each row, the active row of equal hash that stands for it.

    Best status first, then updated_at, path and id. A row is never its own duplicate, and
    rows already marked as duplicates don't stand for others. With ``by_company`` a row with
    a company is matched inside it only; one without sees all. Only the two best candidates
    of a hash (or hash and company) travel to its rows, so large groups aren't paired.
    Other rows may ask: ``seekers`` with document_id, path, company, sha256, and the status and
    error_code that their own row of ``docs`` has, if it holds the same hash.
    """
    rows = docs if seekers is None else seekers
    order = F.struct(reduce(lambda acc, x: F.when(F.col("status") == x[1], x[0]).otherwise(acc), enumerate(DUPLICATE_RANK), F.lit(99)).alias("r"), F.col("updated_at").alias("u"), F.col("path").alias("p"), F.col("document_id").alias("d"))
    able = docs.where(F.col("status").isin(*ACTIVE) & ~F.coalesce(F.col("error_code") == "duplicate_content", F.lit(False)) & F.col("sha256").isNotNull())
    able = able.select("sha256", "company", order.alias("o"))

    def best(keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("o")
        top = able.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy(*keys).agg(F.sort_array(F.collect_list("o")).alias("tops"))
        return top.join(able.groupBy(*keys).agg(F.count("*").alias("all_n"), F.max("o.r").alias("_")).drop("_"), keys)

    def matched(rows: DataFrame, keys: list[str]) -> DataFrame:
        own = rows.join(best(keys), keys)
        is_own = F.col("status").isin(*ACTIVE) & ~F.coalesce(F.col("error_code") == "duplicate_content", F.lit(False))
        found = F.get(F.filter("tops", lambda t: t["p"] != F.col("path")), F.lit(0))
        return own.select("document_id", found["d"].alias("duplicate_of"), (F.col("all_n") - is_own.cast("int")).cast("long").alias("match_count")).where("duplicate_of is not null")

    if not by_company:
        return matched(rows, ["sha256"])
    return matched(rows.where("company is not null"), ["sha256", "company"]).unionByName(matched(rows.where("company is null"), ["sha256"]))


def guarded_upsert(registry: DataFrame, incoming: DataFrame, key: str = "path", keep: Sequence[str] = ("document_id", "created_at", "retry_count"), prefer_old: Sequence[str] = ("submitted_source",)) -> DataFrame:
    """Registry after an upsert on ``key``: illegal status moves leave the old row as it was.

    Columns in ``keep`` keep the old value, those in ``prefer_old`` too unless it is null. Of
    incoming rows of one key the last by updated_at counts, then by the rest of the row.
    """
    last = [F.col("updated_at").desc_nulls_last()] if "updated_at" in incoming.columns else []
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*last, *[F.col(c).desc_nulls_last() for c in registry.columns if c not in (key, "updated_at")]))
    incoming = incoming.where(F.col(key).isNotNull()).withColumn("_nth", nth).where("_nth = 1")
    new = incoming.select(*[F.col(c).alias(f"_new_{c}") for c in registry.columns])
    joined = registry.withColumn("_old", F.lit(True)).join(new, F.col(key) == F.col(f"_new_{key}"), "full_outer")
    hit = F.col(f"_new_{key}").isNotNull() & is_legal(F.col("status"), F.col("_new_status"))
    out = []
    for c in registry.columns:
        old, value = F.col(c), F.col(f"_new_{c}")
        updated = old if c in keep or c == key else F.coalesce(old, value) if c in prefer_old else value
        out.append(F.when(F.col("_old").isNull(), value).when(hit, updated).otherwise(old).alias(c))
    legal_insert = F.col("_old").isNotNull() | F.col("_new_status").isin(*STATUSES)
    return joined.where(legal_insert).select(*out)


def compare_and_set(registry: DataFrame, updates: DataFrame, key: str = "path") -> DataFrame:
    """Registry after updates (key, expect_track_id, expect_status, status, retry_step).

    An update applies only if the row still has the expected track id (nulls match nulls)
    and, where given, the expected status, and the move is legal.
    """
    u = updates.select(*[F.col(c).alias(f"_u_{c}") for c in updates.columns])
    j = registry.join(u, F.col(key) == F.col(f"_u_{key}"), "left")
    same = F.col(f"_u_{key}").isNotNull() & F.col("track_id").eqNullSafe(F.col("_u_expect_track_id")) & (F.col("_u_expect_status").isNull() | F.col("_u_expect_status").eqNullSafe(F.col("status")))
    applies = same & is_legal(F.col("status"), F.col("_u_status"))
    changed = {"status": F.when(applies, F.col("_u_status")).otherwise(F.col("status")), "retry_count": F.col("retry_count") + F.when(applies, F.coalesce("_u_retry_step", F.lit(0))).otherwise(0)}
    return j.select(*[changed.get(c, F.col(c)).alias(c) for c in registry.columns], applies.alias("applied"))


def select_for_reindex(docs: DataFrame, **wanted) -> DataFrame:
    """Rows that match every selector given; newest first."""
    keep = reduce(lambda acc, kv: acc & (F.col(kv[0]) == kv[1]), ((k, v) for k, v in wanted.items() if v is not None), F.lit(True))
    return docs.where(keep).orderBy(F.col("updated_at").desc(), "document_id")
