"""Registry operators over ``orders``, whose rows stand for registry rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import registry as R


def _pick(values: tuple, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


VALIDATION = ("not_run", "accept", "auto_split", "reject")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    company = F.when(c % 5 == 0, None).otherwise(F.concat(F.lit("company"), (c % 5).cast("string")))
    return o.select(
        k.alias("document_id"), F.concat(F.lit("c"), (c % 4).cast("string"), F.lit("/d"), k.cast("string"), F.lit(".txt")).alias("path"),
        F.concat(F.lit("n"), (k % 500).cast("string")).alias("filename"), company.alias("company"), F.concat(F.lit("h"), (c % 997).cast("string")).alias("sha256"),
        _pick(R.STATUSES, k % 10).alias("status"), _pick(VALIDATION, F.floor(k / 10) % 4).alias("validation_state"),
        F.when(k % 3 == 0, "duplicate_content").alias("error_code"), F.when(k % 17 == 0, k - 1).alias("supersedes_document_id"),
        F.col("o_orderdate").alias("updated_at"), F.when(c % 3 == 0, None).otherwise(F.concat(F.lit("t"), (c % 11).cast("string"))).alias("track_id"), (k % 4).cast("int").alias("retry_count"),
        F.col("o_orderpriority").alias("priority"),
    )


REG = """reg AS (
  SELECT o_orderkey AS document_id, 'c' || CAST(o_custkey % 4 AS VARCHAR) || '/d' || CAST(o_orderkey AS VARCHAR) || '.txt' AS path,
    'n' || CAST(o_orderkey % 500 AS VARCHAR) AS filename, CASE WHEN o_custkey % 5 <> 0 THEN 'company' || CAST(o_custkey % 5 AS VARCHAR) END AS company,
    'h' || CAST(o_custkey % 997 AS VARCHAR) AS sha256,
    (['pending','validating','accepted','submitted','processing','ingested','failed','rejected','superseded','skipped'])[o_orderkey % 10 + 1] AS status,
    (['not_run','accept','auto_split','reject'])[CAST(floor(o_orderkey / 10) AS BIGINT) % 4 + 1] AS validation_state,
    CASE WHEN o_orderkey % 3 = 0 THEN 'duplicate_content' END AS error_code, CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey - 1 END AS supersedes_document_id,
    o_orderdate AS updated_at, CASE WHEN o_custkey % 3 <> 0 THEN 't' || CAST(o_custkey % 11 AS VARCHAR) END AS track_id, CAST(o_orderkey % 4 AS INTEGER) AS retry_count,
    o_orderpriority AS priority FROM orders)"""
ACTIVE = "('accepted','submitted','processing','ingested')"


def _moves_values() -> str:
    return ", ".join(f"('{a}','{b}')" for a, to in R.MOVES.items() for b in (a, *to))


MOVES = f"moves(from_status, to_status) AS (VALUES {_moves_values()})"
LEGAL = "({to} IN ('" + "','".join(R.STATUSES) + "') AND ({frm} IS NULL OR {frm} NOT IN ('" + "','".join(R.STATUSES) + "') OR EXISTS (SELECT 1 FROM moves m WHERE m.from_status = {frm} AND m.to_status = {to})))"


def file_class_verdict(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ext = _pick((".txt", ".PDF", ".exe", ".md", "", ".docx", ".DS_Store"), F.col("doc_id") % 7)
    name = F.concat(F.when(F.col("doc_id") % 11 == 0, "._").otherwise(""), F.lit("f"), F.col("doc_id").cast("string"), ext)
    size = F.when(F.col("doc_id") % 13 == 0, F.lit(0).cast("long")).otherwise(F.col("n_chars") * 60)
    v = R.verdict(name, size, F.col("doc_id") % 19 == 0)
    return d.select("doc_id", name.alias("name"), size.alias("byte_size"), v.alias("v")).select("doc_id", "name", "byte_size", "v.verdict", "v.error_code", "v.file_class")


FILE_CLASS = """
WITH f AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '._' ELSE '' END || 'f' || CAST(doc_id AS VARCHAR) || (['.txt','.PDF','.exe','.md','','.docx','.DS_Store'])[doc_id % 7 + 1] AS name,
  CASE WHEN doc_id % 13 = 0 THEN 0 ELSE n_chars * 60 END AS byte_size, doc_id % 19 = 0 AS dup FROM documents),
c AS (SELECT *, CASE WHEN starts_with(name, '._') THEN 'unsupported' WHEN doc_id % 7 IN (0, 3) THEN 'text_like' WHEN doc_id % 7 IN (1, 5) THEN 'binary_office' ELSE 'unsupported' END AS file_class FROM f)
SELECT doc_id, name, byte_size, file_class,
  CASE WHEN starts_with(name, '._') OR file_class = 'unsupported' OR byte_size = 0 OR dup THEN 'reject' WHEN file_class = 'text_like' AND byte_size >= 500000 THEN 'auto_split'
    WHEN file_class = 'text_like' AND byte_size >= 100000 THEN 'warn' ELSE 'accept' END AS verdict,
  CASE WHEN starts_with(name, '._') THEN 'metadata_sidecar_file' WHEN file_class = 'unsupported' THEN 'unsupported_extension' WHEN byte_size = 0 THEN 'empty_file' WHEN dup THEN 'duplicate_content'
    WHEN file_class = 'text_like' AND byte_size >= 100000 THEN 'large_text_file' END AS error_code
FROM c"""


def readiness_case(spark, sf_dir):
    d = R.with_supersession(registry(spark, sf_dir))
    r = R.readiness(F.col("status"), F.col("validation_state"), F.col("error_code"), F.col("superseded"))
    return d.select("document_id", "superseded", r.alias("r")).select("document_id", "superseded", "r.query_ready", "r.readiness_reason")


READINESS = f"""
WITH {REG}, s AS (SELECT r.*, r.document_id IN (SELECT supersedes_document_id FROM reg WHERE status IN {ACTIVE} AND supersedes_document_id IS NOT NULL) AS superseded FROM reg r),
q AS (SELECT document_id, superseded, CASE WHEN status = 'superseded' OR superseded THEN 'superseded' WHEN validation_state = 'reject' OR status = 'rejected' THEN 'validation_rejected'
  WHEN validation_state = 'auto_split' THEN 'split_required' WHEN status = 'skipped' AND error_code = 'duplicate_content' THEN 'duplicate_content' WHEN status = 'skipped' THEN 'skipped'
  WHEN status = 'ingested' THEN 'ingested' WHEN status IN ('submitted','processing') THEN 'processing_upstream' WHEN status = 'failed' THEN 'upstream_failed'
  WHEN status IN ('pending','validating') AND validation_state = 'not_run' THEN 'pending_validation' ELSE 'awaiting_submit' END AS readiness_reason FROM s)
SELECT document_id, superseded, readiness_reason = 'ingested' AS query_ready, readiness_reason FROM q"""


def supersession(spark, sf_dir):
    return R.with_supersession(registry(spark, sf_dir)).where("superseded").select("document_id", "path", "status")


SUPERSESSION = f"WITH {REG} SELECT document_id, path, status FROM reg WHERE document_id IN (SELECT supersedes_document_id FROM reg WHERE status IN {ACTIVE})"


def registry_summary(spark, sf_dir):
    return R.summary(registry(spark, sf_dir), ["status", "validation_state", "company", "error_code", "priority"])


SUMMARY = f"WITH {REG} " + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS n FROM reg WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("status", "validation_state", "company", "error_code", "priority"))


def distinct_companies(spark, sf_dir):
    return registry(spark, sf_dir).select("company").where("company is not null and trim(company) <> ''").distinct().orderBy("company")


COMPANIES = f"WITH {REG} SELECT DISTINCT company FROM reg WHERE company IS NOT NULL"


def name_collision_audit(spark, sf_dir):
    return R.name_collisions(registry(spark, sf_dir))


COLLISIONS = f"""
WITH {REG}, g AS (SELECT filename, count(*) AS n_rows, count(DISTINCT company) AS companies, count(DISTINCT sha256) AS hashes FROM reg GROUP BY filename HAVING count(*) > 1)
SELECT *, CASE WHEN companies = 0 THEN 'unattributed' WHEN companies = 1 THEN 'multi_row' WHEN hashes = 1 THEN 'shared_identical' ELSE 'ambiguous' END AS kind FROM g"""


def dedupe_pick(spark, sf_dir):
    return R.pick_duplicates(registry(spark, sf_dir))


_RANKED = """able AS (SELECT *, CASE status WHEN 'ingested' THEN 0 WHEN 'processing' THEN 1 WHEN 'submitted' THEN 2 ELSE 3 END AS r FROM reg WHERE status IN ('accepted','submitted','processing','ingested') AND error_code IS NULL)"""
_MATCH = """SELECT d.document_id, a.document_id AS duplicate_of, count(*) OVER (PARTITION BY d.document_id) AS match_count,
  row_number() OVER (PARTITION BY d.document_id ORDER BY a.r, a.updated_at, a.path, a.document_id) AS k FROM reg d JOIN able a ON a.sha256 = d.sha256 AND a.path <> d.path"""
DEDUPE = f"WITH {REG}, {_RANKED}, m AS ({_MATCH}) SELECT document_id, duplicate_of, match_count FROM m WHERE k = 1"


def dedupe_pick_scoped(spark, sf_dir):
    return R.pick_duplicates(registry(spark, sf_dir), by_company=True)


DEDUPE_SCOPED = f"WITH {REG}, {_RANKED}, m AS ({_MATCH} AND (d.company IS NULL OR a.company = d.company)) SELECT document_id, duplicate_of, match_count FROM m WHERE k = 1"


def latest_by_hash(spark, sf_dir):
    d = registry(spark, sf_dir)
    return d.groupBy("sha256").agg(F.max_by("document_id", F.struct("updated_at", "document_id")).alias("document_id"), F.count("*").alias("n"))


LATEST = f"WITH {REG} SELECT sha256, arg_max(document_id, (updated_at, document_id)) AS document_id, count(*) AS n FROM reg GROUP BY sha256"


def legal_transitions(spark, sf_dir):
    d = registry(spark, sf_dir)
    to = _pick((*R.STATUSES, "bogus"), (F.col("document_id") * 7) % 11)
    frm = F.when(F.col("document_id") % 23 == 0, None).when(F.col("document_id") % 29 == 0, "legacy").otherwise(F.col("status"))
    e = d.select(frm.alias("from_status"), to.alias("to_status"))
    return e.withColumn("legal", R.is_legal(F.col("from_status"), F.col("to_status"))).groupBy("from_status", "to_status", "legal").agg(F.count("*").alias("n"))


TRANSITIONS = f"""
WITH {REG}, {MOVES}, e AS (SELECT CASE WHEN document_id % 23 = 0 THEN NULL WHEN document_id % 29 = 0 THEN 'legacy' ELSE status END AS from_status,
  (['pending','validating','accepted','submitted','processing','ingested','failed','rejected','superseded','skipped','bogus'])[(document_id * 7) % 11 + 1] AS to_status FROM reg),
p AS (SELECT from_status, to_status, count(*) AS n FROM e GROUP BY ALL)
SELECT p.from_status, p.to_status, p.n, {LEGAL.format(frm="p.from_status", to="p.to_status")} AS legal FROM p"""


def _incoming(spark, sf_dir):
    d = registry(spark, sf_dir)
    k = F.col("document_id")
    new_path = F.when(k % 5 == 0, F.concat(F.lit("new/"), F.col("path"))).otherwise(F.col("path"))
    return d.where(k % 2 == 0).withColumns({"path": new_path, "status": _pick(R.STATUSES, (k * 3) % 10), "document_id": k + 100_000_000, "sha256": F.concat(F.col("sha256"), F.lit("x"))})


def guarded_upsert(spark, sf_dir):
    cols = ["path", "document_id", "status", "sha256", "retry_count"]
    out = R.guarded_upsert(registry(spark, sf_dir).select(cols), _incoming(spark, sf_dir).select(cols), keep=("document_id", "retry_count"))
    return out.select(cols)


UPSERT = f"""
WITH {REG}, {MOVES}, inc AS (SELECT CASE WHEN document_id % 5 = 0 THEN 'new/' || path ELSE path END AS path, document_id + 100000000 AS document_id,
  (['pending','validating','accepted','submitted','processing','ingested','failed','rejected','superseded','skipped'])[(document_id * 3) % 10 + 1] AS status, sha256 || 'x' AS sha256, retry_count FROM reg WHERE document_id % 2 = 0),
hit AS (SELECT r.path, i.status AS new_status, i.sha256 AS new_sha FROM reg r JOIN inc i USING (path) WHERE {LEGAL.format(frm="r.status", to="i.status")})
SELECT r.path, r.document_id, coalesce(h.new_status, r.status) AS status, coalesce(h.new_sha, r.sha256) AS sha256, r.retry_count FROM reg r LEFT JOIN hit h USING (path)
UNION ALL SELECT path, document_id, status, sha256, retry_count FROM inc WHERE path NOT IN (SELECT path FROM reg)"""


def cas_update(spark, sf_dir):
    d = registry(spark, sf_dir)
    k = F.col("document_id")
    u = d.where(k % 3 > 0).select("path", F.when(k % 7 == 0, "stale").otherwise(F.col("track_id")).alias("expect_track_id"), F.when(k % 4 == 0, "processing").alias("expect_status"), _pick(R.STATUSES, (k * 3) % 10).alias("status"), (k % 2).cast("int").alias("retry_step"))
    return R.compare_and_set(d, u).select("document_id", "status", "retry_count", "applied")


CAS = f"""
WITH {REG}, {MOVES}, u AS (SELECT path, CASE WHEN document_id % 7 = 0 THEN 'stale' ELSE track_id END AS et, CASE WHEN document_id % 4 = 0 THEN 'processing' END AS es,
  (['pending','validating','accepted','submitted','processing','ingested','failed','rejected','superseded','skipped'])[(document_id * 3) % 10 + 1] AS st, CAST(document_id % 2 AS INTEGER) AS step FROM reg WHERE document_id % 3 > 0),
j AS (SELECT r.*, u.st, u.step, u.path IS NOT NULL AND r.track_id IS NOT DISTINCT FROM u.et AND (u.es IS NULL OR u.es = r.status) AS same FROM reg r LEFT JOIN u USING (path)),
a AS (SELECT *, same AND {LEGAL.format(frm="j.status", to="j.st")} AS applied FROM j)
SELECT document_id, CASE WHEN applied THEN st ELSE status END AS status, retry_count + CASE WHEN applied THEN step ELSE 0 END AS retry_count, applied FROM a"""


def file_sightings(spark, sf_dir):
    """Batch form of the per-file decision: each event is a sighting of its user's file."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("event_type").over(w)
    return e.select("event_id", F.when(before.isNull(), "new").when(before == F.col("event_type"), "unchanged").otherwise("changed").alias("action"))


SIGHTINGS = """SELECT event_id, CASE WHEN lag(event_type) OVER w IS NULL THEN 'new' WHEN lag(event_type) OVER w = event_type THEN 'unchanged' ELSE 'changed' END AS action
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""

QUERIES = {
    "file_class_verdict": file_class_verdict, "readiness_case": readiness_case, "supersession": supersession, "registry_summary": registry_summary,
    "distinct_companies": distinct_companies, "name_collision_audit": name_collision_audit, "dedupe_pick": dedupe_pick, "dedupe_pick_scoped": dedupe_pick_scoped,
    "latest_by_hash": latest_by_hash, "legal_transitions": legal_transitions, "guarded_upsert": guarded_upsert, "cas_update": cas_update, "file_sightings": file_sightings,
}
ORACLE = {
    "file_class_verdict": FILE_CLASS, "readiness_case": READINESS, "supersession": SUPERSESSION, "registry_summary": SUMMARY, "distinct_companies": COMPANIES,
    "name_collision_audit": COLLISIONS, "dedupe_pick": DEDUPE, "dedupe_pick_scoped": DEDUPE_SCOPED, "latest_by_hash": LATEST, "legal_transitions": TRANSITIONS,
    "guarded_upsert": UPSERT, "cas_update": CAS, "file_sightings": SIGHTINGS,
}
