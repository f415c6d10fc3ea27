"""Scalar text functions, chunking, conversations, graph and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rows as P
from ..functions import text as X
from ..operators import chunking, conversation, graph
from ..streaming import events as S
from .retrieval_queries import CITE, _CHUNKS, citations


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_scalars(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    t = F.col("text")
    return d.select(
        "doc_id", X.match_key(t).alias("match_key"), X.over_count(t).alias("over_count"), X.short_hash(t).alias("short_hash"),
        X.cap_with_marker(t, 200, " [cut]").alias("capped"), X.head_and_tail(t, 120, " ... ").alias("head_tail"), F.size(X.query_terms(t)).cast("long").alias("n_terms"),
    )


SCALARS = r"""SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS match_key,
  CAST(greatest(ceil(length(text) / 3.6), len(regexp_extract_all(text, '\S+')), 1) AS BIGINT) AS over_count, substr(sha256(text), 1, 16) AS short_hash,
  CASE WHEN length(text) > 200 THEN rtrim(substr(text, 1, 200), ' ') || ' [cut]' ELSE text END AS capped,
  CASE WHEN length(text) > 120 THEN left(text, 28) || ' ... ' || right(text, 87) ELSE text END AS head_tail,
  CAST(least(6, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 3)))) AS BIGINT) AS n_terms FROM documents"""


def paths(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    raw = F.concat(F.lit("Root\\a/./B/../"), F.regexp_replace("url", r"^https?://", ""))
    return p.select("page_id", X.normal_path(raw).alias("path"), X.basename(raw).alias("name"), X.slug(raw).alias("slug"), X.url_quote(X.squeeze(F.col("html"))).alias("quoted"))


def pii_counts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", X.pii_counts(F.col("text")).alias("c"))
    return d.select("doc_id", "c.*")


PII = r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails, len(regexp_extract_all(text, '\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}')) AS phones,
  len(regexp_extract_all(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}')) AS ssns, len(regexp_extract_all(text, '(?:[0-9]{4}[ -]?){3}[0-9]{4}')) AS cards, len(regexp_extract_all(text, '(?:[0-9]{1,3}\.){3}[0-9]{1,3}')) AS ips FROM documents"""


def anonymize(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", P.anonymized(F.col("text")).alias("text"))


def sanitize(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", P.sanitized(F.col("html")).alias("text"))


def identifier_support(spark, sf_dir):
    """Is what a conversation asks for by identifier in the replies? Part brands stand for identifiers."""
    p = _t(spark, sf_dir, "part")
    code = F.concat(F.lit("PX-"), F.col("p_size").cast("string"), F.lit("-"), F.regexp_replace("p_brand", "[^0-9]", ""))
    q = F.when(F.col("p_partkey") % 4 == 0, F.lit("what is it?")).otherwise(F.concat(F.lit("what of "), code, F.lit("?")))
    a = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("see "), code, F.lit("-X9"))).otherwise(F.lit("none"))
    e = F.when(F.col("p_partkey") % 7 == 0, F.lit(" ")).when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("part "), code, F.lit(" here"))).otherwise(F.lit("other text"))
    s = p.select("p_partkey", X.support(q, a, e).alias("s"), X.hard_refusal(q, e).alias("refuse"))
    return s.select("p_partkey", "s.verdict", "s.supported", F.array_join("s.unsupported", ",").alias("unsupported"), "refuse")


SUPPORT = """WITH b AS (SELECT p_partkey, p_partkey % 4 <> 0 AS asks, p_partkey % 5 = 0 AS asserts, p_partkey % 7 = 0 AS blank, p_partkey % 3 = 0 AND p_partkey % 7 <> 0 AS knows,
  'PX-' || CAST(p_size AS VARCHAR) || '-' || regexp_replace(p_brand, '[^0-9]', '', 'g') AS code FROM part)
SELECT p_partkey, CASE WHEN blank THEN 'no_evidence' WHEN asks AND NOT knows THEN 'no_support_for_asked_identifier' WHEN asserts THEN 'unsupported_identifiers_in_answer' WHEN NOT asks THEN 'no_identifier_in_question' ELSE 'supported' END AS verdict,
  CASE WHEN asks OR asserts THEN NOT ((asks AND NOT knows) OR asserts) END AS supported,
  CASE WHEN asks AND NOT knows THEN code WHEN asserts THEN code || '-X9' ELSE '' END AS unsupported, asks AND NOT knows AS refuse FROM b"""


def keyword_fallback(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", P.keyword_list(F.col("text")).alias("k")).select("conv_id", "turn", F.array_join("k.high", "|").alias("high"), F.array_join("k.low", "|").alias("low"))


def companies_detected(spark, sf_dir):
    names = ["src1", "src11", "the", "and the"]
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(P.companies_in(F.col("text"), names), ",").alias("companies"))


def log_json(spark, sf_dir):
    """JSON salvaged from log lines that hold it between other text."""
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", P.salvaged_json(F.concat(F.lit("note {broken "), F.col("props"), F.lit(" end"))).alias("json"))


LOG_JSON = "SELECT event_id, props AS json FROM events"


def line_kinds(spark, sf_dir):
    lines = chunking.lines(_t(spark, sf_dir, "documents"))
    return lines.select(chunking.line_kind(F.col("line")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


KINDS = r"""WITH l AS (SELECT trim(unnest(string_split(text, chr(10)))) AS t FROM documents), k AS (SELECT CASE WHEN t = '' THEN 'blank'
  WHEN regexp_matches(t, '^#{1,6} +[^ ]') THEN 'heading' WHEN regexp_matches(t, '^[|]?( *:?-{3,}:? *[|])+ *(:?-{3,}:?)? *$') THEN 'table_separator'
  WHEN regexp_matches(t, '^[|].*[|]$') OR len(regexp_extract_all(t, ' [|] ')) >= 2 THEN 'table'
  WHEN regexp_matches(t, '^([-*•+]|[0-9]{1,3}[.)]) +[^ ]') AND NOT regexp_matches(t, '^[0-9]+([.][0-9]+)+ ') THEN 'bullet'
  WHEN regexp_matches(t, '^(?:[Pp]age )?[0-9]{1,4}(?: of [0-9]{1,4})?$') THEN 'page_mark'
  WHEN regexp_matches(t, '^[0-9]+([.][0-9]+)+ +[A-Z]') AND length(t) <= 90 AND NOT regexp_matches(t, '[.!?]$') THEN 'heading'
  WHEN upper(t) = t AND lower(t) <> t AND length(t) <= 80 AND NOT regexp_matches(t, '[.!?;:,]$') AND len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) <= 10 THEN 'heading' ELSE 'text' END AS kind FROM l)
SELECT kind, count(*) AS n FROM k GROUP BY kind"""


def running_lines(spark, sf_dir):
    return chunking.running_lines(_t(spark, sf_dir, "documents"), 2)


RUNNING = r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
SELECT doc_id, line, count(*) AS n FROM l WHERE length(line) > 0 AND length(line) <= 90 AND len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) <= 12 AND NOT regexp_matches(line, '[.!?]$') GROUP BY ALL HAVING count(*) >= 2"""


def fixed_token_chunks(spark, sf_dir):
    c = chunking.fixed_chunks(_t(spark, sf_dir, "documents"), 50, 10)
    return c.select("doc_id", "chunk", "n_tokens", F.md5(F.col("body").cast("binary")).alias("body_md5"))


CHUNKS = f"WITH {_CHUNKS} SELECT doc_id, chunk, CAST(len(p) AS BIGINT) AS n_tokens, md5(array_to_string(p, ' ')) AS body_md5 FROM ch"


def chunk_statistics(spark, sf_dir):
    c = chunking.fixed_chunks(_t(spark, sf_dir, "documents"), 50, 10).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    return c.agg(F.count("*").alias("docs"), F.sum("n").alias("chunks"), F.sum("tokens").alias("tokens"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


STATISTICS = f"WITH {_CHUNKS}, g AS (SELECT doc_id, count(*) AS n, sum(len(p)) AS t FROM ch GROUP BY doc_id) SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS chunks, CAST(sum(t) AS BIGINT) AS tokens, max(n) AS most, round(avg(n), 6) AS mean FROM g"


def word_coverage(spark, sf_dir):
    """Words of documents that their lines of 40 characters and more don't have."""
    d = _t(spark, sf_dir, "documents")
    words = lambda df, c: df.select("doc_id", F.explode(F.regexp_extract_all(F.col(c), F.lit(chunking.WORD), F.lit(0))).alias("w"))
    kept = chunking.lines(d).where(F.length("line") >= 40)
    return chunking.coverage(words(d, "text"), words(kept, "line"))


COVERAGE = r"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
g AS (SELECT doc_id, unnest(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l WHERE length(line) >= 40),
n AS (SELECT doc_id, w, sum(a) AS a, sum(b) AS b FROM (SELECT doc_id, w, 1 AS a, 0 AS b FROM e UNION ALL SELECT doc_id, w, 0, 1 FROM g) GROUP BY ALL)
SELECT doc_id, CAST(sum(a) AS BIGINT) AS expected, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS missing, round(100.0 * (sum(a) - sum(greatest(a - b, 0))) / greatest(sum(a), 1), 2) AS covered_pct FROM n GROUP BY doc_id"""


def structure_chunks(spark, sf_dir):
    c = chunking.structure_chunks(_t(spark, sf_dir, "documents"))
    return c.select("doc_id", "part", "parts", "header", "body", "n_tokens")


def transcript_prep(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    named = c.withColumn("line", F.concat(F.initcap("role"), F.lit(": "), F.regexp_replace("text", "\n", " ")))
    docs = named.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("text"))
    t = chunking.transcript(docs, id_col="conv_id")
    return t.select("conv_id", "is_transcript", F.size("turns").cast("long").alias("n_turns"))


def texttiling_depth(spark, sf_dir):
    """Depth of similarity valleys over neighbouring embeddings, in runs of ten."""
    e = _t(spark, sf_dir, "embeddings")
    g = F.floor(F.col("vec_id") / 10).cast("long")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    sims = e.join(nxt, "vec_id").where(F.col("vec_id") % 10 < 9).select(g.alias("run"), "vec_id", F.round(X.cosine(F.col("embedding"), F.col("next")), 6).alias("sim"))
    return chunking.topic_depths(sims, ["run"], "vec_id", "sim").select("run", "vec_id", "sim", F.round("depth", 6).alias("depth"))


TILING = """WITH s AS (SELECT CAST(floor(a.vec_id / 10) AS BIGINT) AS run, a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 10 < 9),
w AS (SELECT *, lag(sim) OVER o AS p, lead(sim) OVER o AS n, max(sim) OVER (PARTITION BY run ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l,
  max(sim) OVER (PARTITION BY run ORDER BY vec_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS r FROM s WINDOW o AS (PARTITION BY run ORDER BY vec_id))
SELECT run, vec_id, sim, round(CASE WHEN coalesce(p, 2) >= sim AND coalesce(n, 2) >= sim THEN greatest(coalesce(l, sim) - sim, 0) + greatest(coalesce(r, sim) - sim, 0) ELSE 0 END, 6) AS depth FROM w"""


def conversation_view(spark, sf_dir):
    return conversation.view(_t(spark, sf_dir, "conversations"))


VIEW = r"""WITH e AS (SELECT conv_id, max(turn) AS e FROM conversations WHERE role = 'user' GROUP BY conv_id), o AS (SELECT c.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n
  FROM conversations c JOIN e USING (conv_id) WHERE turn < e AND role IN ('user', 'assistant') AND trim(text) <> '')
SELECT conv_id, turn, role, substr(regexp_replace(text, '(?s)\n+Sources:\n.*$', ''), 1, CASE WHEN role = 'user' THEN 1200 ELSE 600 END) AS text FROM o WHERE n <= 6"""


def history_block(spark, sf_dir):
    return conversation.history(_t(spark, sf_dir, "conversations"))


HISTORY = """WITH u AS (SELECT conv_id, turn, substr(text, 1, 400) AS t FROM conversations WHERE role = 'user' AND trim(text) <> ''),
f AS (SELECT *, sum(length(t) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM u)
SELECT conv_id, count(*) AS n_turns, string_agg(t, chr(10) ORDER BY turn, t) AS block FROM f WHERE used <= 2000 GROUP BY conv_id"""


def latest_prompt(spark, sf_dir):
    return conversation.latest_prompt(_t(spark, sf_dir, "conversations"))


PROMPT = "SELECT conv_id, arg_max(text, turn) AS prompt, max(turn) AS turn FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id"


def sources_block(spark, sf_dir):
    return conversation.sources(citations(spark, sf_dir), "query_id", "rank", "path")


SOURCES = f"""WITH {CITE}, f AS (SELECT query_id, split_part(path, '/', 2) AS name, min(rank) AS r FROM cite GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r, name) AS n FROM f)
SELECT query_id, count(*) AS n_sources, string_agg('[' || CAST(n AS VARCHAR) || '] ' || name, chr(10) ORDER BY n) AS block FROM n GROUP BY query_id"""


def _edges(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return li.select((F.col("l_partkey") % 400).alias("source"), (F.col("l_suppkey") % 97 + 1000).alias("target")).distinct()


def two_hop_neighbors(spark, sf_dir):
    seeds = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("seed"))
    return graph.expand(_edges(spark, sf_dir), seeds, budget=40)


HOPS = """WITH e AS (SELECT DISTINCT l_partkey % 400 AS s, l_suppkey % 97 + 1000 AS t FROM lineitem), b AS (SELECT s, t FROM e UNION SELECT t, s FROM e),
h1 AS (SELECT CAST(n_nationkey AS BIGINT) AS seed, 1 AS hop, s AS source, t AS target FROM nation JOIN b ON s = n_nationkey),
f AS (SELECT seed, target FROM (SELECT seed, target, row_number() OVER (PARTITION BY seed ORDER BY target) AS n FROM (SELECT DISTINCT seed, target FROM h1)) WHERE n <= 5),
h2 AS (SELECT seed, 2 AS hop, s AS source, t AS target FROM f JOIN b ON s = f.target WHERE t <> seed),
a AS (SELECT seed, source, target, min(hop) AS hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, source, target) AS n FROM a) SELECT seed, CAST(hop AS BIGINT) AS hop, source, target FROM r WHERE n <= 40"""


def seed_labels(spark, sf_dir):
    return graph.seed_labels(_t(spark, sf_dir, "part").select(F.col("p_name").alias("label")), F.lit("which small widget beats the blue gear and ring"), 10)


LABELS = """WITH t AS (SELECT DISTINCT p_name AS label FROM part), q AS (SELECT ['which','small','widget','beats','blue','gear'] AS terms),
s AS (SELECT label, CAST(len(list_distinct(list_filter(regexp_extract_all(lower(label), '[a-z0-9]+'), lambda x: list_contains(terms, x)))) AS BIGINT) AS overlap FROM t, q)
SELECT label, overlap FROM s WHERE overlap > 0 ORDER BY overlap DESC, length(label), label LIMIT 10"""


def event_windows(spark, sf_dir):
    return S.tumbling(_t(spark, sf_dir, "events"), "1 hour").select("start", "event_type", "n", F.round("total", 6).alias("total"))


WINDOWS = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"


def event_sessions(spark, sf_dir):
    return S.sessions(_t(spark, sf_dir, "events")).select("user_id", "start", "n")


SESSIONS = """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""


def log_sessions(spark, sf_dir):
    return S.log_blocks(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type = 'purchase'")


BLOCKS = """WITH b AS (SELECT *, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block FROM events)
SELECT user_id, block, count(*) AS n, min(ts) AS start, max(ts) AS end, bool_or(event_type = 'purchase') AS closed FROM b GROUP BY user_id, block"""


def query_log_rollup(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") > 50).alias("high"))


ROLLUP = "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY event_type"

QUERIES = {
    "text_scalars": text_scalars, "paths": paths, "pii_counts": pii_counts, "anonymize": anonymize, "sanitize": sanitize, "identifier_support": identifier_support,
    "keyword_fallback": keyword_fallback, "companies_detected": companies_detected, "log_json": log_json, "line_kinds": line_kinds, "running_lines": running_lines,
    "fixed_token_chunks": fixed_token_chunks, "chunk_statistics": chunk_statistics, "word_coverage": word_coverage, "structure_chunks": structure_chunks, "transcript_prep": transcript_prep,
    "texttiling_depth": texttiling_depth, "conversation_view": conversation_view, "history_block": history_block, "latest_prompt": latest_prompt, "sources_block": sources_block,
    "two_hop_neighbors": two_hop_neighbors, "seed_labels": seed_labels, "event_windows": event_windows, "event_sessions": event_sessions, "log_sessions": log_sessions, "query_log_rollup": query_log_rollup,
}
ORACLE = {
    "text_scalars": SCALARS, "pii_counts": PII, "identifier_support": SUPPORT, "line_kinds": KINDS, "running_lines": RUNNING, "fixed_token_chunks": CHUNKS, "chunk_statistics": STATISTICS,
    "word_coverage": COVERAGE, "texttiling_depth": TILING, "conversation_view": VIEW, "history_block": HISTORY, "latest_prompt": PROMPT, "sources_block": SOURCES, "two_hop_neighbors": HOPS,
    "seed_labels": LABELS, "event_windows": WINDOWS, "event_sessions": SESSIONS, "log_json": LOG_JSON, "log_sessions": BLOCKS, "query_log_rollup": ROLLUP,
}
