"""Evaluation and serving operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking
from ..operators import evaluation as E
from .retrieval_queries import CITE, _t, citations
from .text_queries import texttiling_depth


def character_census(spark, sf_dir):
    return E.character_census(_t(spark, sf_dir, "documents"))


CENSUS = "WITH c AS (SELECT unnest(string_split(text, '')) AS character FROM documents) SELECT character, count(*) AS n FROM c WHERE character <> '' GROUP BY character"


def duplication(spark, sf_dir):
    return E.duplication(_t(spark, sf_dir, "documents"))


DUPLICATION = """WITH e AS (SELECT text, source, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT text, sum(n) AS n, count(*) AS companies, max(n) AS most FROM e GROUP BY text)
SELECT CAST(sum(n) AS BIGINT) AS texts, count(*) AS distinct_texts, count(*) FILTER (WHERE companies > 1) AS across, count(*) FILTER (WHERE most > 1) AS within FROM t"""


def rewrite_triggers(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").where("role = 'user'")
    answer = F.when(F.col("turn") % 4 == 0, "I do not have enough information.").otherwise("Sorry, I don't know.")
    reason = E.rewrite_reason(F.col("text"), ["workshop", "the ", "transcript"], E.is_weak(answer), 40)
    return c.select("conv_id", "turn", reason.alias("reason"), E.rewrite_problem(F.col("text"), F.substring("text", 1, 700)).alias("problem"))


TRIGGERS = r"""SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'none' WHEN len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) >= 40 THEN 'long_query' WHEN contains(lower(text), 'the ') OR contains(lower(text), 'transcript') OR contains(lower(text), 'workshop') THEN 'transcript_keyword' WHEN turn % 4 = 0 THEN 'weak_signal' ELSE 'none' END AS reason,
  CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) <= 700 THEN 'same' ELSE 'too_long' END AS problem FROM conversations WHERE role = 'user'"""


def content_shape_census(spark, sf_dir):
    c = citations(spark, sf_dir)
    items = F.when(F.col("rank") % 5 == 0, F.array(F.lit(" "), F.lit("x"))).when(F.col("rank") % 5 == 1, F.array(F.lit(" ")))
    return E.content_shapes(c.withColumn("content", F.when(F.col("rank") % 3 == 0, F.col("content"))).withColumn("items", items), "content", "items")


SHAPES = f"""WITH {CITE}, x AS (SELECT CASE WHEN rank % 3 = 0 THEN content END AS c, rank % 5 = 0 AS filled, rank % 5 IN (0, 1) AS has FROM cite)
SELECT count(*) FILTER (WHERE c IS NOT NULL) AS string, count(*) FILTER (WHERE c IS NULL AND filled) AS list, count(*) FILTER (WHERE c IS NULL AND has AND NOT filled) AS empty, count(*) FILTER (WHERE c IS NULL AND NOT has) AS absent FROM x"""


def chunk_sizes(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.max("n_chars").alias("largest")).select("source", E.size_request(F.col("largest") / 40).alias("size"), E.is_transient((F.col("largest") % 600).cast("int")).alias("transient"))


SIZES = "SELECT source, CAST(least(greatest(ceil(max(n_chars) / 40 * 1.2) + 64, 64), 8192) AS BIGINT) AS size, max(n_chars) % 600 IN (408, 429, 500, 502, 503, 504) AS transient FROM documents GROUP BY source"


def gold_quotes(spark, sf_dir):
    b = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.split("text", r"[.]").alias("q"), F.array(F.lit(1), F.lit(0)).alias("g"))
    return E.gold_evidence(b, "q", "g").select("id", F.col("pos").cast("long").alias("pos"), "quote", F.col("grade").cast("long").alias("grade"))


GOLD = """WITH s AS (SELECT item_id AS id, string_split(text, '.') AS q, unnest(range(0, len(string_split(text, '.')))) AS pos FROM benchmark)
SELECT id, pos, trim(q[pos + 1], ' ') AS quote, CAST(CASE pos WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS BIGINT) AS grade FROM s WHERE length(trim(q[pos + 1], ' ')) >= 4"""


def run_drift(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    a = o.where("o_orderkey % 7 <> 0").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    b = o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority")
    return E.changed_rows(a, b, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


DRIFT = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'added' WHEN o_orderkey % 5 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders
WHERE (o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0) OR (o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0) OR (o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 11 = 0)"""


def gate_crosstab(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return E.crosstab(o, F.col("o_orderpriority"), F.col("o_orderstatus"), ["F", "O", "P"])


CROSSTAB = """SELECT o_orderpriority AS row, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_orderpriority"""


def poll_actions(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", None).when(F.col("event_type") == "click", "processed").otherwise("PROCESSING")
    return E.poll_action(e.select(F.floor(F.col("event_id") / 3).alias("track_id"), status.alias("status")))


POLLS = """WITH s AS (SELECT CAST(floor(event_id / 3) AS BIGINT) AS track_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN NULL WHEN 'click' THEN 'PROCESSED' ELSE 'PROCESSING' END AS s FROM events)
SELECT track_id, CASE WHEN count(s) = 0 THEN 'submitted' WHEN count(*) FILTER (WHERE s = 'FAILED') > 0 THEN 'failed' WHEN count(*) FILTER (WHERE s = 'PROCESSED') > 0 THEN 'ingested' ELSE 'processing' END AS next_status FROM s GROUP BY track_id"""


def evidence_fusion(spark, sf_dir):
    c = citations(spark, sf_dir)
    vector = c.where("rank <= 2").select("query_id", F.col("path").alias("key"))
    graph = c.where("rank > 2").select("query_id", F.concat(F.lit("g"), F.col("rank").cast("string")).alias("key"), F.array("path").alias("provenance"))
    return E.fuse(graph, vector)


FUSION = f"""WITH {CITE}, v AS (SELECT DISTINCT query_id, path FROM cite WHERE rank <= 2) SELECT query_id, 'graph' AS kind, 'g' || CAST(rank AS VARCHAR) AS key FROM cite c
WHERE rank > 2 AND NOT EXISTS (SELECT 1 FROM v WHERE v.query_id = c.query_id AND v.path = c.path) UNION ALL SELECT query_id, 'vector', path FROM v"""


def stream_answers(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    line = F.when(F.col("turn") % 4 == 3, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("role").alias("response"))))
    return E.stream_text(c.select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), line.alias("line")))


STREAM = "SELECT conv_id AS id, string_agg(role, '' ORDER BY turn) AS text, count(*) AS n_parts FROM conversations WHERE turn % 4 <> 3 GROUP BY conv_id"


def topic_segments(spark, sf_dir):
    return E.topic_groups(texttiling_depth(spark, sf_dir), "run", "vec_id").groupBy("run").agg(F.max("topic").alias("cuts"))


def scope_widening(spark, sf_dir):
    c = citations(spark, sf_dir).withColumn("kept", F.col("content").isNotNull() & (F.col("price") > 30000))
    return E.scope_round(c, 2, 5)


WIDENING = f"""WITH {CITE}, g AS (SELECT query_id, count(*) FILTER (WHERE content IS NOT NULL AND price > 30000 AND rank <= 2) AS n, count(*) FILTER (WHERE content IS NOT NULL AND price > 30000 AND rank <= 5) AS w FROM cite GROUP BY query_id)
SELECT query_id, CASE WHEN w > n THEN 'wide' ELSE 'narrow' END AS round, greatest(n, w) AS kept FROM g"""


def quote_locations(spark, sf_dir):
    c = citations(spark, sf_dir)
    places = c.select(F.col("query_id").alias("probe_id"), F.col("rank").alias("first_rank"), F.when(F.col("score") > 0.5, F.col("rank") + 2).alias("second_rank"))
    return E.best_location(places)


LOCATIONS = f"WITH {CITE} SELECT query_id AS probe_id, min(CASE WHEN score > 0.5 THEN rank + 2 ELSE rank END) AS rank FROM cite GROUP BY query_id"


def chunking_diff(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    a = chunking.fixed_chunks(d, 50, 10)
    b = chunking.fixed_chunks(d.withColumn("text", F.regexp_replace("text", "^[^ ]+ ", "")), 50, 10)
    return E.positional_diff(a, b, "doc_id", "chunk", "body")


DIFF = r"""WITH d AS (SELECT doc_id, 0 AS side, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents UNION ALL SELECT doc_id, 1, regexp_extract_all(regexp_replace(text, '^[^ ]+ ', ''), '[^\x20\x09-\x0D]+') FROM documents),
s AS (SELECT doc_id, side, w, unnest(range(0, len(w), 40)) AS i FROM d), c AS (SELECT doc_id, side, i // 40 AS chunk, array_to_string(w[i + 1 : i + 50], ' ') AS body FROM s WHERE i = 0 OR i + 10 < len(w)),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.body AS a, b.body AS b FROM (SELECT * FROM c WHERE side = 0) a FULL JOIN (SELECT * FROM c WHERE side = 1) b USING (doc_id, chunk))
SELECT doc_id, count(*) FILTER (WHERE a = b) AS same, count(*) FILTER (WHERE a <> b) AS changed, count(*) FILTER (WHERE b IS NULL) AS only_left, count(*) FILTER (WHERE a IS NULL) AS only_right FROM j GROUP BY doc_id"""


def speaker_shares(spark, sf_dir):
    return E.speakers(_t(spark, sf_dir, "conversations"))


SPEAKERS = """WITH g AS (SELECT conv_id, role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY ALL)
SELECT conv_id, role, n, chars, round(chars / greatest(sum(chars) OVER (PARTITION BY conv_id), 1), 6) AS share FROM g"""


def chat_bodies(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").where("role = 'assistant'")
    return E.chat_completion(c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("answer")), "veldspar")


BODIES = """SELECT conv_id || '-' || turn AS id, '{"id":"chatcmpl-' || conv_id || '-' || turn || '","object":"chat.completion","model":"veldspar","choices":[{"index":0,"message":{"role":"assistant","content":' || to_json(text) || '},"finish_reason":"stop"}]}' AS body FROM conversations WHERE role = 'assistant'"""


def second_judge_sample(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(E.sampled(F.col("doc_id"), F.lit(1), 0.2)).alias("sampled"), F.count("*").alias("n"))


QUERIES = {
    "character_census": character_census, "duplication": duplication, "rewrite_triggers": rewrite_triggers, "content_shape_census": content_shape_census, "chunk_sizes": chunk_sizes, "gold_quotes": gold_quotes,
    "run_drift": run_drift, "gate_crosstab": gate_crosstab, "poll_actions": poll_actions, "evidence_fusion": evidence_fusion, "stream_answers": stream_answers, "topic_segments": topic_segments,
    "scope_widening": scope_widening, "quote_locations": quote_locations, "chunking_diff": chunking_diff, "speaker_shares": speaker_shares, "chat_bodies": chat_bodies, "second_judge_sample": second_judge_sample,
}
ORACLE = {
    "character_census": CENSUS, "duplication": DUPLICATION, "rewrite_triggers": TRIGGERS, "content_shape_census": SHAPES, "chunk_sizes": SIZES, "gold_quotes": GOLD, "run_drift": DRIFT, "gate_crosstab": CROSSTAB,
    "poll_actions": POLLS, "evidence_fusion": FUSION, "stream_answers": STREAM, "scope_widening": WIDENING, "quote_locations": LOCATIONS, "speaker_shares": SPEAKERS, "chunking_diff": DIFF, "chat_bodies": BODIES,
}
