"""Retrieval post-processing, ranking metrics and gates over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, metrics
from ..operators import retrieval as V


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(x):
    return x.cast("string")


def citations(spark, sf_dir):
    """``lineitem`` rows as citations: an order asks, its lines are ranked citations."""
    li = _t(spark, sf_dir, "lineitem")
    p, s, k = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    return li.select(
        k.alias("query_id"), F.row_number().over(Window.partitionBy(k).orderBy("l_linenumber", p, s, "l_extendedprice", "l_quantity")).cast("long").alias("rank"), F.concat(F.lit("dir"), _text(s % 5), F.lit("/p"), _text(p % 40), F.lit(".md")).alias("path"),
        F.when(s % 7 == 0, None).otherwise(F.concat(F.lit("text "), _text(p % 90))).alias("content"), F.when(F.col("l_quantity") > 10, F.col("l_quantity") / 50).alias("score"),
        F.col("l_extendedprice").alias("price"),
    )


CITE = """cite AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rank, 'dir' || CAST(l_suppkey % 5 AS VARCHAR) || '/p' || CAST(l_partkey % 40 AS VARCHAR) || '.md' AS path,
  CASE WHEN l_suppkey % 7 <> 0 THEN 'text ' || CAST(l_partkey % 90 AS VARCHAR) END AS content, CASE WHEN l_quantity > 10 THEN l_quantity / 50 END AS score, l_extendedprice AS price FROM lineitem)"""


def owners_table(spark, sf_dir):
    """``part`` rows as a registry: some paths have two files, of one company or of several."""
    p = _t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    path = F.concat(F.lit("dir"), _text(k % 4), F.lit("/p"), _text(k % 37), F.lit(".md"))
    return p.select(path.alias("path"), F.when(k % 6 == 0, None).otherwise(F.concat(F.lit("co"), _text(F.floor(k / 148) % 3))).alias("company"), F.concat(F.lit("h"), _text(k % 148)).alias("sha256"))


OWN = """own AS (SELECT 'dir' || CAST(p_partkey % 4 AS VARCHAR) || '/p' || CAST(p_partkey % 37 AS VARCHAR) || '.md' AS path,
  CASE WHEN p_partkey % 6 <> 0 THEN 'co' || CAST(CAST(floor(p_partkey / 148) AS BIGINT) % 3 AS VARCHAR) END AS company, 'h' || CAST(p_partkey % 148 AS VARCHAR) AS sha256 FROM part)"""


def citation_dedupe(spark, sf_dir):
    return V.first_occurrences(citations(spark, sf_dir), ["rank"], "path", "content", ["query_id"]).select("query_id", "rank", "path", "content")


DEDUPE = f"""WITH {CITE}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY rank) AS n FROM cite),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY rank) AS m FROM a WHERE n = 1)
SELECT query_id, rank, path, content FROM b WHERE m = 1 OR content IS NULL"""


def citation_owners(spark, sf_dir):
    o = V.owners_by_name(citations(spark, sf_dir), owners_table(spark, sf_dir))
    return o.select("path", "via", F.array_join("companies", ",").alias("companies"), "n_hashes", "ambiguous")


_OWNERS = f"""{CITE}, {OWN}, paths AS (SELECT DISTINCT path FROM cite),
exact AS (SELECT DISTINCT p.path, o.sha256, o.company, 'path' AS via FROM paths p JOIN own o USING (path)),
named AS (SELECT DISTINCT p.path, o.sha256, o.company, 'basename' AS via FROM paths p JOIN own o ON split_part(p.path, '/', 2) = split_part(o.path, '/', 2) WHERE p.path NOT IN (SELECT path FROM exact)),
met AS (SELECT * FROM exact UNION ALL SELECT * FROM named), judged AS (SELECT path, min(via) AS via, count(DISTINCT sha256) AS n_hashes, count(DISTINCT company) AS n_companies FROM met GROUP BY path),
wide AS (SELECT path, company FROM met UNION SELECT m.path, o.company FROM met m JOIN own o USING (sha256)), all_ AS (SELECT path, coalesce(string_agg(DISTINCT company, ',' ORDER BY company), '') AS companies FROM wide GROUP BY path),
owners AS (SELECT path, via, CASE WHEN n_hashes > 1 AND n_companies > 1 THEN '' ELSE companies END AS companies, n_hashes, n_companies FROM judged JOIN all_ USING (path))"""
OWNERS = f"WITH {_OWNERS} SELECT path, via, companies, n_hashes, n_hashes > 1 AND n_companies > 1 AS ambiguous FROM owners"


def scope_filter(spark, sf_dir):
    c = citations(spark, sf_dir)
    allowed = F.array(F.concat(F.lit("co"), _text(F.col("query_id") % 3)))
    s = V.scope(c, V.owners_by_name(c, owners_table(spark, sf_dir)), allowed)
    return s.groupBy("query_id", "scope").agg(F.count("*").alias("n"))


SCOPE = f"""WITH {_OWNERS}, j AS (SELECT c.query_id, CASE WHEN n_hashes > 1 AND n_companies > 1 THEN 'ambiguous' WHEN o.path IS NULL OR o.companies = '' THEN 'unattributable'
  WHEN list_contains(string_split(o.companies, ','), 'co' || CAST(c.query_id % 3 AS VARCHAR)) THEN 'kept' ELSE 'other' END AS scope FROM cite c LEFT JOIN owners o USING (path))
SELECT query_id, scope, count(*) AS n FROM j GROUP BY ALL"""


def rerank_order(spark, sf_dir):
    c = citations(spark, sf_dir)
    s = c.where("score is not null").select("query_id", "rank", F.round("price", 2).alias("score"))
    return V.rerank(c.drop("score"), s, ["rank"], ["query_id"]).select("query_id", "rank", F.col("new_rank").cast("long").alias("new_rank"))


RERANK = f"""WITH {CITE} SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN score IS NOT NULL THEN round(price, 2) END DESC NULLS LAST, rank) AS new_rank FROM cite"""


def rerank_prefix(spark, sf_dir):
    c = citations(spark, sf_dir)
    s = c.where("score is not null").select("query_id", "rank", F.round("price", 2).alias("score"))
    return V.rerank(c.drop("score"), s, ["rank"], ["query_id"], prefix=3).select("query_id", "rank", F.col("new_rank").cast("long").alias("new_rank"))


RERANK_PREFIX = f"""WITH {CITE} SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 3 THEN 0 ELSE 1 END,
  CASE WHEN rank <= 3 AND score IS NOT NULL THEN round(price, 2) END DESC NULLS LAST, rank) AS new_rank FROM cite"""


def citation_top_k(spark, sf_dir):
    return V.top_k(citations(spark, sf_dir), ["query_id"], [F.col("score").desc_nulls_last(), F.col("rank")], 2, "place").select("query_id", "rank", F.col("place").cast("long").alias("place"))


TOP_K = f"WITH {CITE}, r AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, rank) AS place FROM cite) SELECT * FROM r WHERE place <= 2"


def context_budget(spark, sf_dir):
    """Turns of a conversation as ranked blocks, filled up to 400 characters; a longer first one is cut."""
    c = _t(spark, sf_dir, "conversations").withColumn("block", F.concat(F.lit("Source: "), F.col("role"), F.lit("\n"), F.col("text")))
    return V.fill(c, F.length("block"), 400, ["conv_id"], ["turn"], "block").select("conv_id", "turn", "block", "used")


BUDGET = f"""WITH b AS (SELECT conv_id, turn, 'Source: ' || role || chr(10) || text AS block FROM conversations),
r AS (SELECT *, CAST(sum(length(block)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, substr(block, 1, {400 - len(V.CUT) - 1}) AS head FROM b),
k AS (SELECT *, length(head) - instr(reverse(head), chr(10)) AS last FROM r WHERE used <= 400 OR n = 1),
s AS (SELECT conv_id, turn, used, CASE WHEN used > 400 THEN substr(regexp_replace(CASE WHEN instr(head, chr(10)) > 0 AND last >= instr(block, chr(10)) THEN substr(head, 1, last) ELSE head END, '\\s+$', '') || chr(10) || '{V.CUT}', 1, 400) ELSE block END AS block FROM k)
SELECT conv_id, turn, block, CASE WHEN used > 400 THEN length(block) ELSE used END AS used FROM s"""


def _quotes(spark, sf_dir):
    """(units, quotes): a conversation's turns as units; pieces of them as quotes, in quote marks, repeated, blank, badly graded, and from another conversation."""
    c = _t(spark, sf_dir, "conversations").where("text is not null")
    n = F.col("turn")
    own = c.where("turn % 2 = 1").select(F.col("conv_id").alias("probe"), n.alias("quote_id"), F.concat(F.lit(" “"), F.translate(F.substring("text", 5, 30), "aeiou", "AEIOU"), F.lit("” ")).alias("quote"), F.when(n % 3 == 0, None).otherwise(n % 7).cast("int").alias("grade"))
    again = own.select("probe", (F.col("quote_id") + 1000).alias("quote_id"), "quote", F.lit(0).alias("grade"))
    blank = c.where("turn = 0").select(F.col("conv_id").alias("probe"), F.lit(4000).cast("long").alias("quote_id"), F.lit(" '' ").alias("quote"), F.lit(1).alias("grade"))
    other = c.where("turn = 0").select((F.col("conv_id") + 1).alias("probe"), F.lit(5000).cast("long").alias("quote_id"), F.substring("text", 1, 60).alias("quote"), F.lit(1).alias("grade"))
    units = c.select(F.col("conv_id").alias("probe"), (F.col("turn") + 1).alias("rank"), "text")
    return units, own.unionByName(again).unionByName(blank).unionByName(other)


def quote_credit(spark, sf_dir):
    return V.credit(*_quotes(spark, sf_dir))


def unit_grades(spark, sf_dir):
    units, quotes = _quotes(spark, sf_dir)
    return V.unit_grades(V.credit(units, quotes), units)


_PLAIN = r"""regexp_replace(lower(trim(regexp_replace({0}, '\s+', ' ', 'g'))), '^["''“”‘’` ]+|["''“”‘’` ]+$', '', 'g')"""
_CREDIT = rf"""WITH c AS (SELECT * FROM conversations WHERE text IS NOT NULL), own AS (SELECT conv_id AS probe, turn AS quote_id, substr(text, 5, 30) AS quote, CASE WHEN turn % 3 > 0 THEN turn % 7 END AS grade FROM c WHERE turn % 2 = 1),
q AS (SELECT * FROM own UNION ALL SELECT conv_id + 1, 5000, substr(text, 1, 60), 1 FROM c WHERE turn = 0),
p AS (SELECT probe, quote_id, CAST(CASE WHEN grade IN (0, 1, 2) THEN grade ELSE 2 END AS INTEGER) AS grade, {_PLAIN.format("quote")} AS p FROM q),
d AS (SELECT * FROM p WHERE p <> '' QUALIFY row_number() OVER (PARTITION BY probe, p ORDER BY quote_id) = 1), u AS (SELECT conv_id AS probe, turn + 1 AS rank, {_PLAIN.format("text")} AS t FROM c),
credited AS (SELECT d.probe, quote_id, grade, min(rank) FILTER (WHERE contains(t, p)) AS rank FROM d LEFT JOIN u ON d.probe = u.probe GROUP BY ALL)"""
CREDIT = f"{_CREDIT} SELECT probe, quote_id, rank, grade FROM credited"
UNIT_GRADES = f"{_CREDIT} SELECT probe, rank, coalesce(max(grade), 0) AS grade FROM u LEFT JOIN credited USING (probe, rank) GROUP BY ALL"


def _ranked(spark, sf_dir):
    """Passages of benchmark items sought in chunks of documents; each item ranks the chunks of one document in twenty by a fixed mixing of numbers."""
    d = _t(spark, sf_dir, "documents")
    chunks = chunking.fixed_chunks(d, 30, 5).select(F.col("doc_id").alias("doc"), F.col("chunk").alias("index"), F.col("body").alias("text"), F.col("n_tokens").alias("tokens"))
    b = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("probe"), F.regexp_extract_all("text", F.lit(chunking.WORD), F.lit(0)).alias("w"))
    gold = b.select("probe", F.explode(F.array(F.array_join(F.slice("w", 3, 9), " "), F.array_join(F.slice("w", 12, 12), "  "), F.lit(" "))).alias("quote"))
    rows = b.where("probe % 3 > 0").select("probe", F.when(F.col("probe") % 3 == 1, F.get("w", F.lit(3))).alias("row_key"), F.get("w", F.lit(5)).alias("row_value"))
    mixed = (F.col("doc") * 31 + F.col("index") * 17 + F.col("probe") * 7) % 1009
    met = chunks.join(b.select("probe"), F.col("doc") % 20 == F.col("probe") % 20)
    ranking = V.top_k(met.select("probe", "doc", "index", mixed.alias("m")), ["probe"], [F.col("m"), F.col("doc"), F.col("index")], 400)
    return V.rank_probes(V.quote_places(chunks, gold), ranking, chunks, gold, [500, 5000], d, rows)


def ranked_probes(spark, sf_dir):
    return _ranked(spark, sf_dir)


def retrieval_report(spark, sf_dir):
    """By thirds of the items."""
    return V.recall_report(_ranked(spark, sf_dir).withColumn("third", F.col("probe") % 3), [5, 100], [500, 5000], ["third"])


_RANKED = rf"""WITH w AS (SELECT doc_id AS doc, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents), s AS (SELECT doc, w, unnest(range(0, len(w), 25)) AS i FROM w),
ch AS (SELECT doc, CAST(i // 25 AS BIGINT) AS index, w[i + 1 : i + 30] AS p FROM s WHERE i = 0 OR i + 5 < len(w)), c AS (SELECT doc, index, len(p) AS tokens, {_PLAIN.format("array_to_string(p, ' ')")} AS t FROM ch),
b AS (SELECT item_id AS probe, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark),
g AS (SELECT probe, {_PLAIN.format("q")} AS q FROM (SELECT probe, unnest([array_to_string(w[3:11], ' '), array_to_string(w[12:23], '  ')]) AS q FROM b)), n AS (SELECT DISTINCT probe, q FROM g WHERE q <> ''),
k AS (SELECT probe, doc, index, tokens, row_number() OVER (PARTITION BY probe ORDER BY (doc * 31 + index * 17 + probe * 7) % 1009, doc, index) AS rank FROM c JOIN b ON doc % 20 = probe % 20 QUALIFY rank <= 400),
o AS (SELECT probe, count(*) AS n FROM k GROUP BY probe), whole AS (SELECT DISTINCT probe, doc, index FROM n JOIN c ON contains(t, q)),
two AS (SELECT doc, index, t || ' ' || lead(t) OVER (PARTITION BY doc ORDER BY index) AS t FROM c), long AS (SELECT probe, arg_min(q, (-length(q), q)) AS q FROM n WHERE probe NOT IN (SELECT probe FROM whole) GROUP BY probe),
seams AS (SELECT DISTINCT probe, doc, index FROM long JOIN two ON contains(t, q)),
r AS (SELECT w.probe, coalesce(min(k.rank), max(coalesce(n, 0)) + 1) AS rank, false AS seam FROM whole w LEFT JOIN k USING (probe, doc, index) LEFT JOIN o ON o.probe = w.probe GROUP BY w.probe
  UNION ALL SELECT s.probe, min(greatest(a.rank, z.rank)) FILTER (WHERE a.rank IS NOT NULL AND z.rank IS NOT NULL), true FROM seams s LEFT JOIN k a USING (probe, doc, index) LEFT JOIN k z ON z.probe = s.probe AND z.doc = s.doc AND z.index = s.index + 1 GROUP BY s.probe),
src AS (SELECT DISTINCT probe FROM n JOIN (SELECT {_PLAIN.format("text")} AS t FROM documents) ON contains(t, q)),
keyed AS (SELECT probe, {_PLAIN.format("w[4]")} AS a, {_PLAIN.format("w[6]")} AS z FROM b WHERE probe % 3 = 1), fine AS (SELECT * FROM keyed WHERE length(a) >= 2 AND length(z) >= 1), intact AS (SELECT DISTINCT probe FROM fine JOIN c ON contains(t, a) AND contains(t, z)),
run AS (SELECT probe, sum(tokens) OVER (PARTITION BY probe ORDER BY rank) AS used FROM k), taken AS (SELECT probe, count(*) FILTER (WHERE used <= 500) AS a, count(*) FILTER (WHERE used <= 5000) AS z FROM run GROUP BY probe),
ranked AS (SELECT b.probe, r.rank, r.probe IS NOT NULL AS located, coalesce(seam, false) AS quote_in_seam, b.probe IN (SELECT probe FROM src) AS in_source, b.probe IN (SELECT probe FROM src) AND r.probe IS NULL AS lost_text,
  CASE WHEN b.probe IN (SELECT probe FROM fine) THEN b.probe IN (SELECT probe FROM intact) END AS row_intact, coalesce(r.rank <= taken.a, false) AS within_500, coalesce(r.rank <= taken.z, false) AS within_5000 FROM b LEFT JOIN r USING (probe) LEFT JOIN taken USING (probe))"""
RANKED = f"{_RANKED} SELECT * FROM ranked"
REPORT = f"""{_RANKED} SELECT probe % 3 AS third, count(*) AS n, count(*) FILTER (WHERE quote_in_seam) AS seam_quotes, round(100.0 * count(*) FILTER (WHERE quote_in_seam) / count(*), 2) AS cut_by_boundary_pct, count(*) FILTER (WHERE located) AS located_n,
  round(100.0 * count(*) FILTER (WHERE located) / count(*), 2) AS located_pct, count(*) FILTER (WHERE lost_text) AS lost_text_n, count(row_intact) AS row_intact_n, round(100.0 * count(*) FILTER (WHERE row_intact) / nullif(count(row_intact), 0), 2) AS row_intact_pct,
  round(100.0 * count(*) FILTER (WHERE rank <= 5) / count(*), 2) AS recall_5, round(100.0 * count(*) FILTER (WHERE rank <= 100) / count(*), 2) AS recall_100, round(100.0 * count(*) FILTER (WHERE within_500) / count(*), 2) AS recall_500_tokens,
  round(100.0 * count(*) FILTER (WHERE within_5000) / count(*), 2) AS recall_5000_tokens, round(sum(coalesce(1 / rank, 0)) / count(*), 4) AS mrr, round(100.0 * count(rank) / count(*), 2) AS found_at_all FROM ranked GROUP BY ALL"""


def token_budget_recall(spark, sf_dir):
    """Share of a conversation's turns within 300 words."""
    c = _t(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.regexp_count("text", F.lit(chunking.WORD))).over(w)
    return c.withColumn("u", used).groupBy("conv_id").agg(F.count_if(F.col("u") <= 300).alias("fits"), F.count("*").alias("turns"), F.round(F.count_if(F.col("u") <= 300) / F.count("*"), 4).alias("recall"))


TOKENS = r"""WITH r AS (SELECT conv_id, sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM conversations)
SELECT conv_id, count(*) FILTER (WHERE u <= 300) AS fits, count(*) AS turns, round(count(*) FILTER (WHERE u <= 300) / count(*), 4) AS recall FROM r GROUP BY conv_id"""


def cosine_topk(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    found = V.cosine_top_k(e, F.col("vec_id") % 20 == 0, 10)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


COSINE = """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score
  FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""


def jaccard_topk(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", X.token_set(F.col("text")).alias("tokens"))
    b = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("probe_id"), X.token_set(F.col("text")).alias("tokens"))
    return V.jaccard_top_k(d, b, 5).select("probe_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


JACCARD = """WITH a AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents), an AS (SELECT doc_id, count(*) AS na FROM a GROUP BY doc_id),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark), bn AS (SELECT item_id, count(*) AS nb FROM b GROUP BY item_id),
m AS (SELECT item_id, doc_id, count(*) AS n FROM a JOIN b USING (t) GROUP BY ALL), s AS (SELECT item_id AS probe_id, doc_id, n / (na + nb - n) AS score FROM m JOIN an USING (doc_id) JOIN bn USING (item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT probe_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""


def scoped_context(spark, sf_dir):
    """A question to its context: chunks ranked by token overlap, kept to the asking tenant, filled to a budget.

    Every benchmark item asks, as the tenant ``src<item_id mod 20>``; chunks of 50 words.
    """
    d = _t(spark, sf_dir, "documents").select(F.struct("doc_id", "source").alias("id"), "text")
    chunks = chunking.fixed_chunks(d, 50, 10, id_col="id").select("id.*", "chunk", "body")
    tokens = chunks.select("doc_id", "chunk", "source", F.length("body").alias("chars"), X.token_set(F.col("body")).alias("tokens"))
    a = tokens.select("doc_id", "chunk", "source", "chars", F.size("tokens").alias("na"), F.explode("tokens").alias("t"))
    items = _t(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), _text(F.col("item_id") % 20)).alias("source"), X.token_set(F.col("text")).alias("tokens"))
    b = items.select("item_id", "source", F.size("tokens").alias("nb"), F.explode("tokens").alias("t"))
    # few enough questions meet a chunk's tokens in its own task
    b = F.broadcast(b) if (items.agg(F.sum(F.size("tokens"))).first()[0] or 0) <= V.PROBE_TOKENS else b
    both = a.join(b, ["source", "t"]).groupBy("item_id", "doc_id", "chunk", "chars", "na", "nb").agg(F.count("*").alias("n"))
    scored = both.select("item_id", "doc_id", "chunk", "chars", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("score"))
    best = V.top_k(scored, ["item_id"], [F.col("score").desc(), F.col("doc_id"), F.col("chunk")], 12)
    return V.fill(best, F.col("chars"), 3000, ["item_id"], ["rank"]).select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", "chunk", F.round("score", 6).alias("score"), "used")


_CHUNKS = r"""w AS (SELECT doc_id, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT doc_id, source, w, unnest(range(0, len(w), 40)) AS s FROM w), ch AS (SELECT doc_id, source, CAST(s // 40 AS BIGINT) AS chunk, w[s + 1 : s + 50] AS p FROM c WHERE s = 0 OR s + 10 < len(w))"""
CONTEXT = f"""WITH {_CHUNKS}, body AS (SELECT doc_id, source, chunk, array_to_string(p, ' ') AS body FROM ch),
a AS (SELECT DISTINCT doc_id, chunk, source, length(body) AS chars, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS t FROM body), an AS (SELECT doc_id, chunk, count(*) AS na FROM a GROUP BY ALL),
b AS (SELECT DISTINCT item_id, 'src' || CAST(item_id % 20 AS VARCHAR) AS source, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark), bn AS (SELECT item_id, count(*) AS nb FROM b GROUP BY ALL),
m AS (SELECT item_id, doc_id, chunk, chars, count(*) AS n FROM a JOIN b USING (source, t) GROUP BY ALL),
s AS (SELECT item_id, doc_id, chunk, chars, n / (na + nb - n) AS score FROM m JOIN an USING (doc_id, chunk) JOIN bn USING (item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk) AS rank FROM s),
f AS (SELECT *, CAST(sum(chars) OVER (PARTITION BY item_id ORDER BY rank) AS BIGINT) AS used FROM r WHERE rank <= 12)
SELECT item_id, rank, doc_id, chunk, round(score, 6) AS score, used FROM f WHERE used <= 3000"""


def ngram_leakage(spark, sf_dir):
    """(item_id, n_docs): documents that share a four-word run with an item; runs are hashed and met by equality."""

    def runs(df, key):
        w = df.select(key, F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
        at = F.when(F.size("w") >= 4, F.sequence(F.lit(0), F.size("w") - 4)).otherwise(F.array().cast("array<int>"))
        return w.select(key, F.explode_outer(F.transform(at, lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(4)]))).alias("h")).where("h is not null")

    items = runs(_t(spark, sf_dir, "benchmark"), "item_id").distinct()
    return runs(_t(spark, sf_dir, "documents"), "doc_id").join(items, "h").select("item_id", "doc_id").distinct().groupBy("item_id").agg(F.count("*").alias("n_docs"))


LEAKAGE = """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), ds AS (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM ds), b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS i FROM b), bg AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 3], ' ') AS g FROM bs)
SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM dg JOIN bg USING (g) GROUP BY item_id"""


def _units(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 10).cast("long").alias("probe_id"), (F.col("vec_id") % 10 + 1).cast("long").alias("rank"), F.greatest(F.col("label") % 4 - 1, F.lit(0)).alias("grade"))


_UNITS = "u AS (SELECT CAST(floor(vec_id / 10) AS BIGINT) AS probe_id, CAST(vec_id % 10 + 1 AS BIGINT) AS rank, greatest(label % 4 - 1, 0) AS grade FROM embeddings)"


def ranking_metrics(spark, sf_dir):
    return metrics.ranking(_units(spark, sf_dir), "probe_id", "rank", "grade")


RANKING = f"""WITH {_UNITS}, x AS (SELECT *, power(2, grade) - 1 AS gain, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY probe_id ORDER BY rank) AS hits,
  row_number() OVER (PARTITION BY probe_id ORDER BY power(2, grade) - 1 DESC, rank) AS ideal FROM u),
g AS (SELECT probe_id, min(CASE WHEN grade > 0 THEN rank END) AS first_hit_rank, sum(CASE WHEN rank <= 5 THEN gain / log2(rank + 1) ELSE 0 END) AS dcg,
  sum(CASE WHEN ideal <= 5 THEN gain / log2(ideal + 1) ELSE 0 END) AS idcg, avg(CASE WHEN grade > 0 THEN hits / rank END) AS ap FROM x GROUP BY probe_id)
SELECT probe_id, first_hit_rank, round(coalesce(1 / first_hit_rank, 0.0), 4) AS mrr, CAST(coalesce(first_hit_rank <= 5, false) AS BIGINT) AS hit_at_k,
  round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END, 4) AS ndcg, round(coalesce(ap, 0.0), 4) AS average_precision FROM g"""


def graded_recall(spark, sf_dir):
    u = _units(spark, sf_dir).withColumn("found", F.col("rank") % 3 != 0)
    return metrics.recall(u, "probe_id", "grade", "found")


RECALL = f"""WITH {_UNITS} SELECT probe_id, round(avg(CASE WHEN rank % 3 <> 0 THEN 1 ELSE 0 END), 4) AS evidence_recall,
  round(sum(CASE WHEN rank % 3 <> 0 THEN grade ELSE 0 END) / nullif(sum(grade), 0), 4) AS graded_recall FROM u GROUP BY probe_id"""


def percentile_rules(spark, sf_dir):
    return metrics.percentiles(_t(spark, sf_dir, "events"), "event_type", "value")


PERCENTILES = """WITH g AS (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, n, v[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1] AS p_chunk, v[greatest(CAST(round_even(0.95 * n, 0) AS BIGINT), 1)] AS p_loop,
  v[least(CAST(floor(0.95 * n) AS BIGINT), n - 1) + 1] AS p_gate, v[least(CAST(floor(0.95 * n) AS BIGINT), n - 1) + 1] AS p_scorer,
  (v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2 AS median FROM g"""


def verdict_rates(spark, sf_dir):
    lab = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    v = F.when(F.col("doc_id") % 31 == 0, "excluded").when(F.col("toxic") == 1, "hallucination").when(F.col("quality") == 0, "refusal").when(F.col("doc_id") % 3 == 0, "partial").otherwise("correct")
    return metrics.success(metrics.verdict_rates(lab.withColumn("verdict", v), "lang"))


VERDICTS = """WITH v AS (SELECT lang, CASE WHEN doc_id % 31 = 0 THEN 'excluded' WHEN toxic = 1 THEN 'hallucination' WHEN quality = 0 THEN 'refusal' WHEN doc_id % 3 = 0 THEN 'partial' ELSE 'correct' END AS v
  FROM labels JOIN documents USING (doc_id)), r AS (SELECT lang, count(*) AS n, round(100.0 * count(*) FILTER (WHERE v = 'correct') / count(*), 1) AS correct_pct,
  round(100.0 * count(*) FILTER (WHERE v IN ('correct', 'partial')) / count(*), 1) AS ok_pct, round(100.0 * count(*) FILTER (WHERE v = 'hallucination') / count(*), 1) AS hallucination_pct,
  round(100.0 * count(*) FILTER (WHERE v = 'refusal') / count(*), 1) AS refusal_pct FROM v WHERE v <> 'excluded' GROUP BY lang)
SELECT *, coalesce(ok_pct >= 90 AND hallucination_pct < 5 AND refusal_pct >= 80, false) AS success FROM r"""


def ab_gate(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    arms = o.select(k.alias("id"), (k % 5).cast("double").alias("baseline_score"), ((k % 5) * 1.1).alias("candidate_score"), F.col("o_totalprice").alias("baseline_ms"), (F.col("o_totalprice") * 1.05).alias("candidate_ms"), (k % 40 == 0).alias("failed"))
    return metrics.ab_gate(arms)


AB = """WITH a AS (SELECT CAST(o_orderkey % 5 AS DOUBLE) AS b, (o_orderkey % 5) * 1.1 AS c, o_totalprice AS bm, o_totalprice * 1.05 AS cm, o_orderkey % 40 = 0 AS f FROM orders),
g AS (SELECT count(*) AS n, avg(b) AS mb, avg(c) AS mc, list_sort(list(bm))[least(CAST(floor(0.95 * count(*)) AS BIGINT), count(*) - 1) + 1] AS bp,
  list_sort(list(cm))[least(CAST(floor(0.95 * count(*)) AS BIGINT), count(*) - 1) + 1] AS cp, round(100.0 * count(*) FILTER (WHERE f) / count(*), 1) AS failure_pct FROM a),
h AS (SELECT n, round(100 * (mc - mb) / mb, 2) AS lift_pct, round(100 * (cp - bp) / bp, 2) AS p95_increase_pct, failure_pct FROM g)
SELECT *, CASE WHEN n < 12 THEN 'insufficient' WHEN failure_pct > 10 THEN 'fail_parse' WHEN lift_pct < 8 THEN 'fail_quality' WHEN p95_increase_pct > 20 THEN 'fail_latency' ELSE 'pass' END AS verdict FROM h"""


def paired_arms(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    a = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    b = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") + F.col("o_custkey") % 9).alias("v"))
    return metrics.paired(a, b, "id", "v")


PAIRED = """SELECT count(*) FILTER (WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0) AS n, count(*) FILTER (WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 = 0) AS only_in_a,
  count(*) FILTER (WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0) AS only_in_b, round(avg(CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 THEN o_custkey % 9 END), 4) AS difference FROM orders"""


def paired_bootstrap(spark, sf_dir):
    lab = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    pairs = lab.select("lang", F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("a"), F.col("quality").cast("double").alias("b"))
    return metrics.bootstrap(pairs, ["lang"])


QUERIES = {
    "scoped_context": scoped_context, "citation_dedupe": citation_dedupe, "citation_owners": citation_owners, "scope_filter": scope_filter, "rerank_order": rerank_order,
    "rerank_prefix": rerank_prefix, "citation_top_k": citation_top_k, "context_budget": context_budget, "quote_credit": quote_credit, "unit_grades": unit_grades, "ranked_probes": ranked_probes, "retrieval_report": retrieval_report, "token_budget_recall": token_budget_recall, "cosine_topk": cosine_topk,
    "jaccard_topk": jaccard_topk, "ngram_leakage": ngram_leakage, "ranking_metrics": ranking_metrics, "graded_recall": graded_recall, "percentile_rules": percentile_rules,
    "verdict_rates": verdict_rates, "ab_gate": ab_gate, "paired_arms": paired_arms, "paired_bootstrap": paired_bootstrap,
}
ORACLE = {
    "scoped_context": CONTEXT, "citation_dedupe": DEDUPE, "citation_owners": OWNERS, "scope_filter": SCOPE, "rerank_order": RERANK, "rerank_prefix": RERANK_PREFIX, "citation_top_k": TOP_K,
    "context_budget": BUDGET, "quote_credit": CREDIT, "unit_grades": UNIT_GRADES, "ranked_probes": RANKED, "retrieval_report": REPORT, "token_budget_recall": TOKENS, "cosine_topk": COSINE, "jaccard_topk": JACCARD, "ngram_leakage": LEAKAGE, "ranking_metrics": RANKING, "graded_recall": RECALL,
    "percentile_rules": PERCENTILES, "verdict_rates": VERDICTS, "ab_gate": AB, "paired_arms": PAIRED,
}
