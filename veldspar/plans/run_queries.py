"""Lifecycle commands and run operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking
from ..operators import evaluation as E
from ..operators import lifecycle as L
from ..operators import retrieval as V
from ..operators import runs as N
from .registry_queries import REG, registry
from .retrieval_queries import _CHUNKS, CITE, _t, citations


def _rows(spark, sf_dir):
    ready = (F.col("status") == "ingested") & F.col("error_code").isNull()
    return registry(spark, sf_dir).withColumns({"query_ready": ready, "error_detail": F.lit(None).cast("string")})


def reindex_command(spark, sf_dir):
    r = L.reindex(_rows(spark, sf_dir).where("company is not null"))
    return r.select("document_id", "outcome", "reason", "previous_status", "status", "error_code", "retry_count", "track_id")


REINDEX = f"""WITH {REG}, r AS (SELECT *, CASE WHEN status = 'ingested' AND error_code IS NULL THEN 'ingested' WHEN status IN ('submitted', 'processing') THEN 'processing_upstream'
  WHEN status = 'rejected' OR validation_state = 'reject' THEN 'validation_rejected' WHEN validation_state = 'auto_split' THEN 'split_required' END AS reason FROM reg WHERE company IS NOT NULL)
SELECT document_id, CASE WHEN reason IS NULL THEN 'queued' ELSE 'blocked' END AS outcome, reason, status AS previous_status, CASE WHEN reason IS NULL THEN 'pending' ELSE status END AS status,
  CASE WHEN reason IS NULL THEN 'reindex_requested' ELSE error_code END AS error_code, CASE WHEN reason IS NULL THEN 0 ELSE retry_count END AS retry_count, CASE WHEN reason IS NOT NULL THEN track_id END AS track_id FROM r"""


def skip_marks(spark, sf_dir):
    r = _rows(spark, sf_dir)
    files = r.select(F.when(F.col("document_id") % 4 == 0, F.concat("path", F.lit("/Manifest.json"))).otherwise(F.col("path")).alias("path"), "sha256")
    known = r.withColumn("path", F.when(F.col("document_id") % 8 == 0, F.concat("path", F.lit("/Manifest.json"))).otherwise(F.col("path")))
    return L.skipped_by_name(files, known, ["manifest.json"])


SKIPS = f"""WITH {REG} SELECT path || '/Manifest.json' AS path, sha256, 'skipped' AS status, 'skipped_by_name' AS error_code, 'skipped by basename rule: manifest.json' AS error_detail
FROM reg WHERE document_id % 4 = 0 AND (document_id % 8 <> 0 OR status NOT IN ('submitted', 'processing', 'ingested'))"""


def duplicate_marks(spark, sf_dir):
    r = _rows(spark, sf_dir)
    told = F.when(F.col("document_id") % 5 == 0, F.col("document_id") + 1)
    picks = r.select("document_id", told.alias("duplicate_of"), F.lit(2).alias("match_count"))
    seen = r.withColumn("error_detail", F.concat(F.lit("Duplicate content matches "), told.cast("string"), F.lit(" among 2 active SHA matches")))
    return L.duplicate_marks(seen, picks)


MARKS = f"""WITH {REG} SELECT document_id, 'skipped' AS status, 'duplicate_content' AS error_code, 'Duplicate content matches ' || CAST(document_id + 1 AS VARCHAR) || ' among 2 active SHA matches' AS error_detail
FROM reg WHERE document_id % 5 = 0 AND NOT (status = 'skipped' AND coalesce(error_code, '') = 'duplicate_content')"""


def attribution_changes(spark, sf_dir):
    r = registry(spark, sf_dir)
    found = r.where("document_id % 2 = 0").select("path", F.when(F.col("document_id") % 6 == 0, F.lit("moved")).otherwise(F.col("company")).alias("company"))
    return L.attribution_changes(r, found, ["company"])


ATTRIBUTION = f"WITH {REG} SELECT path, 'moved' AS company FROM reg WHERE document_id % 6 = 0"


def _matches(spark, sf_dir):
    r = registry(spark, sf_dir)
    via = F.element_at(F.array(*[F.lit(v) for v in N.VIAS]), (F.col("document_id") % 3 + 2).cast("int"))
    return r.select(F.col("filename").alias("cited"), via.alias("via"), "document_id", "path", "company", F.lit("folder").alias("company_source"), F.lit(None).cast("string").alias("company_source_detail"), F.lit("filesystem").alias("source_type"), (F.col("status") == "ingested").alias("query_ready"), F.col("status").alias("readiness_reason"))


def enriched_citations(spark, sf_dir):
    first = N.primary_rows(_matches(spark, sf_dir), ["cited"], F.array(F.lit("company2"), F.lit("company3")))
    cite = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("n"), (F.col("p_partkey") % 600).cast("string")).alias("cited"), F.when(F.col("p_partkey") % 2 == 0, "own").alias("path"))
    return N.enrich(cite, first, ["cited"])


ENRICHED = f"""WITH {REG}, m AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY document_id % 3, CASE WHEN company IN ('company2', 'company3') THEN 0 ELSE 1 END, coalesce(company, ''), path) AS n FROM reg)
SELECT p_partkey, 'n' || CAST(p_partkey % 600 AS VARCHAR) AS cited, CASE WHEN p_partkey % 2 = 0 THEN 'own' ELSE m.path END AS path, document_id, company, CASE WHEN document_id IS NOT NULL THEN 'folder' END AS company_source,
  CAST(NULL AS VARCHAR) AS company_source_detail, CASE WHEN document_id IS NOT NULL THEN 'filesystem' END AS source_type, status = 'ingested' AS query_ready, status AS readiness_reason
FROM part LEFT JOIN m ON m.filename = 'n' || CAST(p_partkey % 600 AS VARCHAR) AND n = 1"""


def name_owners(spark, sf_dir):
    k = F.col("document_id")
    r = registry(spark, sf_dir).where("document_id % 3 = 0")
    named = r.withColumns({"submitted_source": F.when(k % 9 == 0, F.concat(F.lit("s"), (k % 70).cast("string"))), "original_filename": F.concat(F.lit("o"), (k % 80).cast("string")), "sha256": F.when(k % 10 == 0, "pending").otherwise(F.col("sha256"))})
    i = F.col("p_partkey") % 100
    cited = F.concat(F.when(i % 4 == 0, "dir/n").when(i % 4 == 1, "o").when(i % 4 == 2, "s").otherwise("n"), i.cast("string"))
    own = V.owners_by_name(_t(spark, sf_dir, "part").select(cited.alias("path")), named)
    return own.select("path", "via", "n_hashes", "n_companies", "ambiguous", F.array_join("companies", ",").alias("companies"))


NAME_OWNERS = f"""WITH {REG}, r AS (SELECT filename, company, CASE WHEN document_id % 9 = 0 THEN 's' || CAST(document_id % 70 AS VARCHAR) END AS submitted, 'o' || CAST(document_id % 80 AS VARCHAR) AS original, CASE WHEN document_id % 10 = 0 THEN 'pending' ELSE sha256 END AS sha256 FROM reg WHERE document_id % 3 = 0),
names AS (SELECT 0 AS way, 'submitted_source' AS via, submitted AS name, sha256, company FROM r WHERE submitted IS NOT NULL UNION ALL SELECT 2, 'filename', filename, sha256, company FROM r UNION ALL SELECT 3, 'original_filename', original, sha256, company FROM r),
paths AS (SELECT DISTINCT CASE i % 4 WHEN 0 THEN 'dir/n' WHEN 1 THEN 'o' WHEN 2 THEN 's' ELSE 'n' END || CAST(i AS VARCHAR) AS path FROM (SELECT p_partkey % 100 AS i FROM part)),
m AS (SELECT path, n.* FROM paths JOIN names n ON n.name = replace(path, 'dir/', '')),
d AS (SELECT path, arg_min(via, way) AS via, count(DISTINCT sha256) FILTER (WHERE sha256 <> 'pending') AS n_hashes, count(DISTINCT company) AS n_companies FROM m GROUP BY path),
w AS (SELECT path, company FROM m UNION SELECT m.path, r.company FROM m JOIN r ON r.sha256 = m.sha256 WHERE m.sha256 <> 'pending'),
c AS (SELECT path, coalesce(string_agg(DISTINCT company, ',' ORDER BY company), '') AS companies FROM w GROUP BY path)
SELECT path, via, n_hashes, n_companies, n_hashes > 1 AND n_companies > 1 AS ambiguous, CASE WHEN n_hashes > 1 AND n_companies > 1 THEN '' ELSE companies END AS companies FROM d JOIN c USING (path)"""


def run_log_join(spark, sf_dir):
    o, k, c = _t(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    results = o.select(k.alias("result_id"), (c % 90).alias("probe_id"), F.when(k % 3 == 0, k % 1000).alias("request_id"), F.concat(F.lit("q"), (k % 4000).cast("string")).alias("question"))
    log = o.where("o_orderkey % 2 = 1").select(k.alias("line_id"), F.when(k % 7 != 0, k % 1500).alias("request_id"), F.concat(F.lit("q"), (k % 5000).cast("string")).alias("query"))
    return N.join_log(results, log, o.select((c % 80).alias("probe_id")))


LOG_JOIN = """WITH r AS (SELECT o_orderkey AS result_id, o_custkey % 90 AS probe_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 1000 END AS request_id, 'q' || CAST(o_orderkey % 4000 AS VARCHAR) AS question FROM orders),
l AS (SELECT o_orderkey AS line_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 1500 END AS request_id, 'q' || CAST(o_orderkey % 5000 AS VARCHAR) AS query FROM orders WHERE o_orderkey % 2 = 1),
a AS (SELECT r.*, (SELECT count(*) FROM l WHERE l.request_id = r.request_id) AS rn, (SELECT min(line_id) FROM l WHERE l.request_id = r.request_id) AS rl, (SELECT count(*) FROM l WHERE l.query = r.question) AS qn,
  (SELECT min(line_id) FROM l WHERE l.query = r.question) AS ql, count(*) OVER (PARTITION BY question) AS asked FROM r),
p AS (SELECT *, CASE WHEN probe_id NOT IN (SELECT o_custkey % 80 FROM orders) THEN 'no_probe' WHEN request_id IS NOT NULL THEN CASE WHEN rn > 1 THEN 'request_repeats' WHEN rn = 0 THEN 'no_line' END
  WHEN asked > 1 THEN 'question_repeats' WHEN qn > 1 THEN 'several_lines' WHEN qn = 0 THEN 'no_line' END AS problem FROM a)
SELECT result_id, probe_id, CASE WHEN problem IS NULL THEN CASE WHEN request_id IS NOT NULL THEN rl ELSE ql END END AS line_id, problem FROM p"""


def run_manifest_join(spark, sf_dir):
    o, k = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    company, question = F.concat(F.lit("co"), (k % 3).cast("string")), F.concat(F.lit("q"), (F.col("o_custkey") % 700).cast("string"))
    probes = o.where("o_orderkey % 11 = 0").select(company.alias("company"), question.alias("question")).distinct().withColumn("probe_id", F.concat_ws(":", "company", "question"))
    return N.join_manifest(o.select(k.alias("result_id"), F.when(k % 2 == 0, company).alias("company"), question.alias("question")), probes)


MANIFEST_JOIN = """WITH p AS (SELECT DISTINCT 'co' || CAST(o_orderkey % 3 AS VARCHAR) AS company, 'q' || CAST(o_custkey % 700 AS VARCHAR) AS question FROM orders WHERE o_orderkey % 11 = 0),
r AS (SELECT o_orderkey AS result_id, CASE WHEN o_orderkey % 2 = 0 THEN 'co' || CAST(o_orderkey % 3 AS VARCHAR) END AS company, 'q' || CAST(o_custkey % 700 AS VARCHAR) AS question FROM orders),
s AS (SELECT question, min(company) AS company, count(*) AS n FROM p GROUP BY question),
j AS (SELECT r.result_id, r.company AS named, coalesce(s.n, 0) AS n, CASE WHEN r.company IS NOT NULL THEN p.company || ':' || p.question WHEN s.n = 1 THEN s.company || ':' || s.question END AS probe_id
  FROM r LEFT JOIN p ON p.company = r.company AND p.question = r.question LEFT JOIN s ON s.question = r.question)
SELECT result_id, probe_id, CASE WHEN probe_id IS NULL THEN CASE WHEN named IS NULL AND n > 1 THEN 'several_probes' ELSE 'no_probe' END END AS problem FROM j"""


def near_miss_codes(spark, sf_dir):
    c, k = _t(spark, sf_dir, "customer"), F.col("c_custkey")
    company = F.concat(F.lit("N"), (k % 9).cast("string"), F.lit("-"), (k % 4).cast("string"))
    code = F.concat(company, F.lit("-"), (k % 130).cast("string"))
    return N.near_misses(c.select(code.alias("code"), company.alias("company_code")), c.where("c_custkey % 3 <> 0").select(code.alias("code")))


NEAR = """WITH c AS (SELECT c_custkey AS k, 'N' || CAST(c_custkey % 9 AS VARCHAR) || '-' || CAST(c_custkey % 4 AS VARCHAR) AS company FROM customer), a AS (SELECT DISTINCT company || '-' || CAST(k % 130 AS VARCHAR) AS code, company FROM c),
p AS (SELECT DISTINCT company || '-' || CAST(k % 130 AS VARCHAR) AS other FROM c WHERE k % 3 <> 0)
SELECT code, count(*) FILTER (WHERE other <> code AND split_part(other, '-', 1) = split_part(code, '-', 1)) AS same_first_segment, count(*) FILTER (WHERE other <> code AND starts_with(other, company || '-')) AS same_company_code,
  count(*) FILTER (WHERE other <> code AND contains(other, code)) AS shares_a_subtoken FROM a LEFT JOIN p ON true GROUP BY code"""


def probe_means(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    verdict = F.element_at(F.array(*[F.lit(v) for v in (*N.VERDICTS, "judge_error", "no_answer")]), (F.col("event_id") % 8 + 1).cast("int"))
    return N.probe_means(e.select(F.floor(F.col("event_id") / 5).alias("id"), verdict.alias("verdict")))


MEANS = """SELECT CAST(floor(event_id / 5) AS BIGINT) AS id, avg(CASE event_id % 8 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END) AS score, count(*) AS draws FROM events WHERE event_id % 8 < 6 GROUP BY 1"""


def context_hits(spark, sf_dir):
    units = citations(spark, sf_dir).where("content is not null").select(F.col("query_id").alias("probe"), "rank", F.col("content").alias("text"))
    o, k = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    quotes = o.where("o_orderkey % 3 <> 0").select(k.alias("probe"), F.concat(F.lit("TEXT  "), (k % 9 + 1).cast("string")).alias("quote"))
    return N.in_context(o.select(k.alias("probe")), quotes, units)


HITS = f"""WITH {CITE}, u AS (SELECT query_id, string_agg(content, ' ' ORDER BY rank) AS hay FROM cite WHERE content IS NOT NULL GROUP BY query_id)
SELECT o_orderkey AS probe, CASE WHEN o_orderkey % 3 = 0 THEN 'na' WHEN coalesce(contains(hay, 'text ' || CAST(o_orderkey % 9 + 1 AS VARCHAR)), false) THEN 'hit' ELSE 'miss' END AS said FROM orders LEFT JOIN u ON query_id = o_orderkey"""


def question_problems(spark, sf_dir):
    b = _t(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    q = b.select(F.concat(F.when(i % 5 == 0, "X").otherwise("qa"), F.lpad((i % 60).cast("string"), 2, "0")).alias("id"), F.when(i % 4 != 0, F.col("text")).alias("question"), F.concat(F.lit("d/s"), (i % 7).cast("string")).alias("source_doc"),
                 F.when(i % 3 == 0, "guess").otherwise("single-fact").alias("type"), F.when(i % 2 == 0, "near-miss").otherwise("fact").alias("shape"), F.when(i % 6 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("absent_terms"))
    sources = b.where("item_id % 7 < 5").select(F.concat(F.lit("s"), (i % 7).cast("string")).alias("name"))
    return N.question_problems(q, sources).groupBy("id", "problem").agg(F.count("*").alias("n"))


PROBLEMS = """WITH q AS (SELECT item_id AS i, CASE WHEN item_id % 5 = 0 THEN 'X' ELSE 'qa' END || lpad(CAST(item_id % 60 AS VARCHAR), 2, '0') AS id, text FROM benchmark), c AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM q), there AS (SELECT DISTINCT item_id % 7 AS s FROM benchmark WHERE item_id % 7 < 5),
p AS (SELECT id, 'question_missing' AS problem FROM c WHERE i % 4 = 0 OR trim(text) = '' UNION ALL SELECT id, 'id_pattern' FROM c WHERE i % 5 = 0 UNION ALL SELECT id, 'id_repeats' FROM c WHERE n > 1 UNION ALL SELECT id, 'type_unknown' FROM c WHERE i % 3 = 0
  UNION ALL SELECT id, 'type_of_unanswerable' FROM c WHERE i % 2 = 0 UNION ALL SELECT id, 'absent_terms' FROM c WHERE i % 2 = 0 AND i % 6 <> 0 UNION ALL SELECT id, 'source_missing' FROM c WHERE i % 7 NOT IN (SELECT s FROM there))
SELECT id, problem, count(*) AS n FROM p GROUP BY ALL"""


def identifier_survival(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    codes = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "absent-code").otherwise(F.regexp_extract("text", r"[A-Za-z]{4,}", 0)).alias("code"))
    pieces = chunking.fixed_chunks(d, 50, 10).select("doc_id", "body")
    return N.survival(codes, d, F.lower("text"), pieces)


SURVIVAL = f"""WITH {_CHUNKS}, k AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'absent-code' ELSE regexp_extract(text, '[A-Za-z]{{4,}}') END AS code FROM documents),
f AS (SELECT *, contains(text, code) AS raw, contains(lower(text), code) AS clean, EXISTS (SELECT 1 FROM ch WHERE ch.doc_id = k.doc_id AND contains(array_to_string(p, ' '), code)) AS kept FROM k)
SELECT count(*) AS total, count(*) FILTER (WHERE NOT raw) AS missing_in_raw, count(*) FILTER (WHERE raw AND NOT clean) AS lost_to_cleaning, count(*) FILTER (WHERE raw AND clean AND NOT kept) AS lost_to_pieces FROM f"""


def recursive_chunks(spark, sf_dir):
    return chunking.recursive_chunks(_t(spark, sf_dir, "documents"), 60, 12)


def reindex_requests(spark, sf_dir):
    """An operator asks for one company's rows again; some carry notes already, some notes that aren't JSON."""
    k = F.col("document_id")
    notes = F.when(k % 4 == 0, F.concat(F.lit('{"keep": "k'), k.cast("string"), F.lit('", "worker": {"tries": 2, "reindex_force": true}}'))).when(k % 4 == 1, "old note")
    r = L.request_reindex(_rows(spark, sf_dir).withColumns({"source_type": F.lit("upload"), "warnings_json": notes}), company="company1")
    said = lambda path: F.get_json_object("warnings_json", path)
    return r.select("document_id", "outcome", "message", "status", "error_stage", "error_message", F.get_json_object("error_detail", "$.scope.company").alias("asked_company"), said("$.keep").alias("keep"), said("$.legacy_warning").alias("legacy"), said("$.worker.tries").alias("tries"),
                    said("$.worker.reindex_requested").alias("requested"), said("$.worker.reindex_force").alias("force"), said("$.reindex.requested_from_status").alias("was"), L.reindex_requested(r).alias("marked"))


REINDEX_REQUESTS = f"""WITH {REG}, r AS (SELECT *, CASE WHEN status = 'ingested' AND error_code IS NULL THEN 'Document is already query-ready; use force=true to resubmit intentionally' WHEN status IN ('submitted', 'processing') THEN 'Document is already in the upstream ingestion workflow; use force=true to replace that submission'
  WHEN status = 'rejected' OR validation_state = 'reject' THEN 'Document is validation-rejected; use force=true to send it back through worker validation' WHEN validation_state = 'auto_split' THEN 'Document is blocked for manual splitting; use force=true only if you want the worker to re-evaluate the same file' END AS message, document_id % 4 AS m FROM reg WHERE company = 'company1'),
q AS (SELECT *, message IS NULL AS free FROM r)
SELECT document_id, CASE WHEN free THEN 'queued' ELSE 'blocked' END AS outcome, message, CASE WHEN free THEN 'pending' ELSE status END AS status, CASE WHEN free THEN 'reindex' END AS error_stage, CASE WHEN free THEN '{L.REQUESTED}' END AS error_message, CASE WHEN free THEN 'company1' END AS asked_company,
  CASE WHEN m = 0 THEN 'k' || document_id END AS keep, CASE WHEN free AND m = 1 THEN 'old note' END AS legacy, CASE WHEN m = 0 THEN '2' END AS tries, CASE WHEN free THEN 'true' END AS requested, CASE WHEN free THEN 'false' WHEN m = 0 THEN 'true' END AS force, CASE WHEN free THEN status END AS was, free AS marked FROM q"""


def rewrite_checks(spark, sf_dir):
    """What conversations say, as rewrites in many dresses of a question of 60 characters."""
    c = _t(spark, sf_dir, "conversations")
    t = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    n = (F.col("conv_id") * 3 + F.col("turn")) % 10
    head, q = F.substring(t, 1, 40), F.substring(t, 1, 60)
    forms = [F.upper(F.lit(" what? ")), F.concat(F.lit("<think>so</think>Rewritten question: “What of "), head, F.lit("?”")), F.concat(F.lit("<think>"), head), F.concat(F.lit("What\nof "), head), F.concat(F.lit("Here is "), head), F.concat(F.lit("What of "), t, t, F.lit("?")),
             F.concat(F.lit("```\nWhat of "), F.length(t).cast("string"), F.lit("?\n```")), F.lit('{"function": "x"}'), F.lit(" \"\" "), F.lit("So it was  Said")]
    text = F.element_at(F.array(*forms), (n + 1).cast("int"))
    r = E.checked_rewrite(F.when(n == 0, F.lit("What?")).otherwise(q), text, F.lit("so it was said"))
    return c.select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.source", "r.reason", F.length("r.text").alias("n_chars"))


REWRITE_CHECKS = r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t, (conv_id * 3 + turn) % 10 AS n FROM conversations),
d AS (SELECT *, length(trim(substr(t, 1, 60))) AS own, 2 * length(t) + 9 AS whole, length(substr(t, 1, 60)) AS q, length(trim(substr(t, 1, 40))) AS h FROM c),
s AS (SELECT *, CASE n WHEN 2 THEN 'reasoning_markers' WHEN 3 THEN CASE WHEN trim('of ' || substr(t, 1, 40)) <> '' THEN 'multi_line' END WHEN 4 THEN 'answer_like' WHEN 5 THEN CASE WHEN whole > 600 OR whole > 4 * own + 200 THEN 'too_long' END WHEN 7 THEN 'tool_call_shape' WHEN 8 THEN 'empty' WHEN 9 THEN 'identical_to_last_assistant' END AS reason FROM d)
SELECT conv_id, turn, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN n = 0 THEN 'unchanged' ELSE 'rewritten' END AS source, reason, CAST(CASE WHEN n = 0 THEN 5 WHEN reason IS NOT NULL THEN q WHEN n = 1 THEN length(substr(t, 1, 40)) + 9 WHEN n = 5 THEN whole ELSE length('What of ' || length(t) || '?') END AS INTEGER) AS n_chars FROM s"""


def retrieval_separation(spark, sf_dir):
    """Runs of ten vectors as what a probe retrieved, labels as scores; chunks hold two codes each."""
    e = _t(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    ranked = e.select(F.floor(i / 10).cast("long").alias("probe"), (i % 50).alias("chunk"), (i % 10 + 1).alias("rank"), (F.col("label") / 10).alias("score"))
    codes = ranked.select("chunk", F.explode(F.array(F.concat(F.lit("C-"), (F.col("chunk") % 7).cast("string")), F.concat(F.lit("C-"), (F.col("chunk") % 11).cast("string")))).alias("code")).distinct()
    probes = ranked.select("probe").distinct().select("probe", F.when(F.col("probe") % 3 == 0, "unanswerable").otherwise("scoped").alias("shape"), F.concat(F.lit("C-"), (F.col("probe") % 13).cast("string")).alias("code"))
    return N.separation(probes, ranked, codes, 5)


SEPARATION = """WITH r AS (SELECT vec_id // 10 AS probe, vec_id % 50 AS chunk, vec_id % 10 + 1 AS rank, label / 10 AS score FROM embeddings), c AS (SELECT DISTINCT chunk, 'C-' || chunk % 7 AS code FROM r UNION SELECT DISTINCT chunk, 'C-' || chunk % 11 FROM r),
p AS (SELECT DISTINCT probe, CASE WHEN probe % 3 = 0 THEN 'unanswerable' ELSE 'scoped' END AS shape, 'C-' || probe % 13 AS code FROM r), b AS (SELECT probe, max(score) AS best FROM r WHERE rank <= 5 GROUP BY probe),
f AS (SELECT p.probe, min(rank) AS first_ FROM p JOIN r USING (probe) JOIN c ON c.chunk = r.chunk AND c.code = p.code GROUP BY p.probe), o AS (SELECT p.probe, count(DISTINCT c.code) AS others FROM p JOIN r USING (probe) JOIN c ON c.chunk = r.chunk AND c.code <> p.code WHERE rank <= 5 GROUP BY p.probe),
j AS (SELECT shape, coalesce(best, 0) AS best, first_, coalesce(others, 0) AS others, row_number() OVER (PARTITION BY shape ORDER BY coalesce(best, 0), probe) - 1 AS n, count(*) OVER (PARTITION BY shape) AS of_ FROM p LEFT JOIN b USING (probe) LEFT JOIN f USING (probe) LEFT JOIN o USING (probe))
SELECT shape, count(*) AS probes, count(*) FILTER (WHERE first_ <= 5) AS code_in_top_k, min(others) AS lookalikes_min, max(others) AS lookalikes_max, round(min(best), 4) AS best_min, round(max(best) FILTER (WHERE n = of_ // 2), 4) AS best_median, round(max(best), 4) AS best_max,
  min(first_) AS rank_min, max(first_) AS rank_max, count(first_) AS with_code_chunk FROM j GROUP BY shape"""

QUERIES = {
    "reindex_command": reindex_command, "skip_marks": skip_marks, "duplicate_marks": duplicate_marks, "attribution_changes": attribution_changes, "enriched_citations": enriched_citations, "name_owners": name_owners, "run_log_join": run_log_join,
    "run_manifest_join": run_manifest_join, "near_miss_codes": near_miss_codes, "probe_means": probe_means, "context_hits": context_hits, "question_problems": question_problems, "identifier_survival": identifier_survival, "recursive_chunks": recursive_chunks,
    "reindex_requests": reindex_requests, "rewrite_checks": rewrite_checks, "retrieval_separation": retrieval_separation,
}
ORACLE = {
    "reindex_command": REINDEX, "skip_marks": SKIPS, "duplicate_marks": MARKS, "attribution_changes": ATTRIBUTION, "enriched_citations": ENRICHED, "name_owners": NAME_OWNERS, "run_log_join": LOG_JOIN,
    "run_manifest_join": MANIFEST_JOIN, "near_miss_codes": NEAR, "probe_means": MEANS, "context_hits": HITS, "question_problems": PROBLEMS,
    "reindex_requests": REINDEX_REQUESTS, "rewrite_checks": REWRITE_CHECKS, "identifier_survival": SURVIVAL, "retrieval_separation": SEPARATION,
}
