"""JSON walks, bounded subgraphs and shared runs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, graph, jsontree, probes, structure
from .retrieval_queries import CITE, _t, citations


def _s(c):
    return c.cast("string")


def payloads(spark, sf_dir):
    """An answer in JSON for each event: references with text in lists and nested sources; every eleventh is cut off."""
    e = _t(spark, sf_dir, "events")
    i, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")
    said = F.concat(
        F.lit('{"query": "q'), _s(u), F.lit('", "data": {"references": [{"file_path": " d'), _s(i % 7), F.lit(' ", "content": ["'), t, F.lit('", "t'), _s(i % 5), F.lit('"]}, {"path": "d'), _s(i % 3),
        F.lit('", "content": "", "nested": {"source": ["x"], "source_id": "s'), _s(u % 4), F.lit('"}}], "mode": ["'), t, F.lit('", {"text": "'), t, F.lit('"}], "props": '), F.col("props"), F.lit('}, "score": 0.5, "id": '), _s(i), F.lit(', "ok": true, "none": null}'),
    )
    return e.select("event_id", F.when(i % 11 == 0, F.substring(said, 1, 40)).when(i % 23 == 0, F.concat(F.lit("["), said, F.lit(", 1]"))).otherwise(said).alias("payload"))


_PAYLOADS = """p AS (SELECT event_id, CASE WHEN event_id % 23 = 0 THEN '[' || j || ', 1]' ELSE j END AS payload FROM (SELECT event_id, '{"query": "q' || user_id || '", "data": {"references": [{"file_path": " d' || (event_id % 7) || ' ", "content": ["' || event_type || '", "t' || (event_id % 5)
  || '"]}, {"path": "d' || (event_id % 3) || '", "content": "", "nested": {"source": ["x"], "source_id": "s' || (user_id % 4) || '"}}], "mode": ["' || event_type || '", {"text": "' || event_type || '"}], "props": ' || props || '}, "score": 0.5, "id": ' || event_id || ', "ok": true, "none": null}' AS j FROM events WHERE event_id % 11 <> 0)),
n AS (SELECT p.event_id, t.id, t.type, t.key, t.fullkey, t.value ->> '$' AS text, t.value FROM p, json_tree(p.payload) t)"""


def _nodes(spark, sf_dir, depth=8):
    return jsontree.nodes(payloads(spark, sf_dir), "event_id", "payload", depth)


def json_shapes(spark, sf_dir):
    return jsontree.shapes(_nodes(spark, sf_dir, 5))


JSON_SHAPES = f"""WITH {_PAYLOADS}, d AS (SELECT *, regexp_replace(regexp_replace(fullkey, '\\[\\d+\\]', '[]', 'g'), '^\\$\\.?', '') AS path, len(regexp_extract_all(fullkey, '\\.|\\[')) AS depth FROM n),
s AS (SELECT CASE WHEN path = '' THEN '<root>' ELSE path END AS path, CASE WHEN depth = 5 THEN 'max_depth' WHEN type = 'VARCHAR' THEN 'str(len=' || length(text) || ' sha256=' || substr(sha256(text), 1, 12) || ')' WHEN type = 'ARRAY' THEN 'list(n=' || json_array_length(value) || ')'
  WHEN type = 'OBJECT' THEN 'dict(keys=' || len(json_keys(value)) || ')' WHEN type = 'BOOLEAN' THEN 'bool' WHEN type = 'NULL' THEN 'null' WHEN type = 'DOUBLE' THEN 'float' ELSE 'int' END AS shape FROM d WHERE depth <= 5)
SELECT path, shape, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT '<root>', 'broken', count(*) FROM events WHERE event_id % 11 = 0"""


def context_units(spark, sf_dir):
    return jsontree.strings(_nodes(spark, sf_dir), "event_id", skip=F.lit("t3"))


CONTEXT_UNITS = f"""WITH {_PAYLOADS} SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY id) AS rank, text FROM n
WHERE type = 'VARCHAR' AND text NOT IN ('', 't3') AND regexp_extract(fullkey, '([a-z_]+)(\\[\\d+\\])*$', 1) NOT IN ('query', 'mode', 'message', 'model')"""


def payload_sources(spark, sf_dir):
    return jsontree.provenance(_nodes(spark, sf_dir), "event_id")


PAYLOAD_SOURCES = f"""WITH {_PAYLOADS}, f AS (SELECT event_id, trim(text) AS source, min(id) AS place FROM n WHERE type = 'VARCHAR' AND trim(text) <> '' AND regexp_matches(fullkey, '\\.(source_id|file_path|source|path)$') GROUP BY ALL)
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY place) AS rank, source FROM f"""


def relations(spark, sf_dir):
    """Parts and suppliers as entities: two can have several relations, some of which differ in case alone."""
    li = _t(spark, sf_dir, "lineitem")
    p, s = F.col("l_partkey") % 300, F.col("l_suppkey") % 70
    rel = F.when(F.col("l_linenumber") % 3 == 0, "Supplies").when(F.col("l_linenumber") % 3 == 1, "supplies").otherwise("stores")
    return li.select(F.concat(F.lit("s"), _s(s)).alias("source"), rel.alias("relation"), F.concat(F.lit("p"), _s(p)).alias("target"), F.concat(F.lit("d"), _s((p + s) % 9), F.lit(".md")).alias("file_path")).distinct()


_RELATIONS = """r AS (SELECT DISTINCT 's' || (l_suppkey % 70) AS source, CASE l_linenumber % 3 WHEN 0 THEN 'Supplies' WHEN 1 THEN 'supplies' ELSE 'stores' END AS relation, 'p' || (l_partkey % 300) AS target, 'd' || ((l_partkey % 300 + l_suppkey % 70) % 9) || '.md' AS file_path FROM lineitem),
e AS (SELECT a, b, lower(relation) AS relation, min(relation) AS first_ FROM (SELECT source AS a, target AS b, relation FROM r UNION ALL SELECT target, source, relation FROM r) GROUP BY ALL),
k0 AS (SELECT 'p' || n_nationkey AS seed, 'p' || n_nationkey AS node, 0 AS depth, 1 AS place FROM nation),
l1 AS (SELECT seed, b AS node, count(*) AS links FROM k0 JOIN e ON a = node GROUP BY ALL),
k1 AS (SELECT seed, node, 1 AS depth, 1 + row_number() OVER (PARTITION BY seed ORDER BY links DESC, node) AS place FROM l1 QUALIFY place <= 50),
s1 AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1), l2 AS (SELECT seed, b AS node, count(*) AS links FROM k1 JOIN e ON a = node WHERE (seed, b) NOT IN (SELECT (seed, node) FROM s1) GROUP BY ALL),
k2 AS (SELECT l2.seed, node, 2 AS depth, (SELECT count(*) FROM s1 WHERE s1.seed = l2.seed) + row_number() OVER (PARTITION BY l2.seed ORDER BY links DESC, node) AS place FROM l2 QUALIFY place <= 50),
kept AS (SELECT * FROM s1 UNION ALL SELECT * FROM k2)"""


def _around(spark, sf_dir):
    seeds = _t(spark, sf_dir, "nation").select(F.concat(F.lit("p"), _s(F.col("n_nationkey"))).alias("seed"))
    return graph.subgraph(relations(spark, sf_dir), seeds)


def subgraph_nodes(spark, sf_dir):
    return _around(spark, sf_dir)[0]


SUBGRAPH_NODES = f"WITH {_RELATIONS} SELECT seed, node, depth, CAST(place AS INTEGER) AS place FROM kept"


def graph_evidence(spark, sf_dir):
    found = graph.evidence(*_around(spark, sf_dir))
    return found.withColumns({"labels": F.array_join("labels", "|"), "provenance": F.array_join("provenance", "|")})


GRAPH_EVIDENCE = f"""WITH {_RELATIONS}, x AS (SELECT a.seed, r.source, lower(r.relation) AS relation, r.target, min(r.relation || r.file_path) AS _, min_by(r.file_path, r.relation) AS file_path FROM r JOIN kept a ON a.node = r.source JOIN kept b ON b.node = r.target AND a.seed = b.seed GROUP BY ALL),
n AS (SELECT seed, count(*) AS node_count, string_agg(node, '|' ORDER BY place) FILTER (WHERE place <= 10) AS labels FROM kept GROUP BY seed), g AS (SELECT seed, count(*) AS edge_count, string_agg(DISTINCT file_path, '|' ORDER BY file_path) AS provenance FROM x GROUP BY seed)
SELECT n.seed, node_count, coalesce(edge_count, 0) AS edge_count, labels, coalesce(provenance, '') AS provenance FROM n LEFT JOIN g USING (seed)"""


def related_neighbors(spark, sf_dir):
    seeds = _t(spark, sf_dir, "nation").select(F.concat(F.lit("p"), _s(F.col("n_nationkey"))).alias("seed"))
    found = graph.expand(relations(spark, sf_dir).drop("file_path"), seeds, budget=30)
    return found.withColumn("relation", F.lower("relation"))


RELATED = f"""WITH {_RELATIONS}, h1 AS (SELECT seed, 1 AS hop, a AS source, relation, first_, b AS target FROM k0 JOIN e ON a = node),
f AS (SELECT seed, target FROM (SELECT DISTINCT seed, target FROM h1) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY target) <= 5),
h2 AS (SELECT seed, 2 AS hop, a AS source, relation, first_, b AS target FROM f JOIN e ON a = f.target WHERE b <> seed),
o AS (SELECT seed, source, relation, first_, target, min(hop) AS hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL)
SELECT seed, hop, source, relation, target FROM o QUALIFY row_number() OVER (PARTITION BY seed ORDER BY hop, source, first_, target) <= 30"""


def graph_citations(spark, sf_dir):
    """The citations of an order, then edges of its first part as citations; two in five edges repeat the words of a citation or each other's path."""
    c = citations(spark, sf_dir)
    li = _t(spark, sf_dir, "lineitem")
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    edges = li.where(o % 3 > 0).select(
        o.alias("query_id"), F.row_number().over(_order()).alias("place"), F.concat(F.lit("p"), _s(F.col("l_partkey") % 4)).alias("seed_entity"), F.concat(F.lit("s"), _s(F.col("l_suppkey") % 3)).alias("related_entity"),
        F.when(n % 2 == 0, "supplies").alias("relationship"), F.when(n % 5 > 0, F.concat(F.lit("line "), _s(n))).alias("context"),
    )
    return graph.with_expansion(c, edges, ["query_id"])


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


GRAPH_CITATIONS = f"""WITH {CITE}, g AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS place, 'p' || (l_partkey % 4) AS a, 's' || (l_suppkey % 3) AS b, CASE WHEN l_linenumber % 2 = 0 THEN 'supplies' ELSE '' END AS rel,
  CASE WHEN l_linenumber % 5 > 0 THEN 'line ' || l_linenumber ELSE '' END AS ctx FROM lineitem WHERE l_orderkey % 3 > 0),
u AS (SELECT query_id, false AS from_graph, rank AS r, path, content FROM cite UNION ALL SELECT query_id, true, place, 'graph://' || a || '/' || b, trim('[Graph expansion: ' || a || ' --' || rel || '--> ' || b || '] ' || ctx) FROM g),
v AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY from_graph, r) = 1), w AS (SELECT * FROM v QUALIFY content IS NULL OR row_number() OVER (PARTITION BY query_id, content ORDER BY from_graph, r) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY from_graph, r) AS rank, path, content, from_graph FROM w"""


def shared_runs(spark, sf_dir):
    """Runs of 8 to 32 characters that benchmark items share with what conversations say."""
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return probes.longest_shared_run(items, _t(spark, sf_dir, "conversations").select("text"), least=8, cap=32)


SHARED_RUNS = r"""WITH a AS (SELECT item_id AS id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM benchmark), b AS (SELECT DISTINCT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM conversations),
n AS (SELECT unnest(range(8, 33)) AS n), p AS (SELECT id, t, unnest(range(1, length(t) - 6)) AS i FROM a WHERE length(t) >= 8), q AS (SELECT t, unnest(range(1, length(t) - 6)) AS i FROM b WHERE length(t) >= 8),
g AS (SELECT DISTINCT substr(t, i, 8) AS g FROM p), k AS (SELECT DISTINCT substr(t, i, 32) AS rest FROM q WHERE substr(t, i, 8) IN (SELECT g FROM g)),
h AS (SELECT DISTINCT n, substr(rest, 1, n) AS g FROM k, n WHERE length(rest) >= n),
f AS (SELECT id, max(n) AS longest FROM p JOIN h ON substr(t, i, n) = g AND length(t) - i + 1 >= n GROUP BY id)
SELECT item_id AS id, coalesce(longest, 0) AS longest FROM benchmark LEFT JOIN f ON item_id = id"""

def reports(spark, sf_dir):
    """A report for each customer: headings, running lines, page marks, captions, tables, lists and prose for each order."""
    o = _t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    part = F.concat_ws("\n", F.concat(F.lit("## 1.1 Order "), _s(k)), F.concat(F.lit("Status "), F.col("o_orderstatus"), F.lit(" of priority "), F.col("o_orderpriority"), F.lit(". It goes on for a while, so that it must be cut.")), F.lit(""), F.lit("Table 1: prices"), F.lit("| Key | Price |"),
        F.lit("|-----|-------|"), F.concat(F.lit("| first | "), _s(k), F.lit(" |")), F.concat(F.lit("| second | "), _s(k + 1), F.lit(" |")), F.lit(""), F.lit("- ship it"), F.lit("  and bill it"), F.lit("Acme Corp confidential"), F.concat(F.lit("Page "), _s(k % 2)), F.lit(""))
    g = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), part.alias("part")))), lambda x: x["part"]), "\n").alias("body"))
    return g.select("doc_id", F.concat(F.lit("# Customer report\nAcme Corp confidential\n"), F.col("body")).alias("text"))


_REPORTS = """ol AS (SELECT o_custkey AS doc, o_orderkey AS k, unnest(['## 1.1 Order ' || o_orderkey, 'Status ' || o_orderstatus || ' of priority ' || o_orderpriority || '. It goes on for a while, so that it must be cut.', '', 'Table 1: prices', '| Key | Price |', '|-----|-------|', '| first | ' || o_orderkey || ' |',
  '| second | ' || (o_orderkey + 1) || ' |', '', '- ship it', '  and bill it', 'Acme Corp confidential', 'Page ' || (o_orderkey % 2), '']) AS line, unnest(['heading', 'text', 'blank', 'caption', 'table', 'separator', 'table', 'table', 'blank', 'bullet', 'text', 'text', 'page_mark', 'blank']) AS kind FROM orders),
l AS (SELECT doc, line, kind FROM ol UNION ALL SELECT DISTINCT o_custkey, '# Customer report', 'heading' FROM orders UNION ALL SELECT DISTINCT o_custkey, 'Acme Corp confidential', 'text' FROM orders),
fu AS (SELECT doc, lower(trim(line)) AS key, count(*) AS n, count(*) FILTER (WHERE kind = 'page_mark') AS page_marks FROM l WHERE lower(trim(line)) IN ('acme corp confidential', 'page 0', 'page 1', 'table 1: prices', 'and bill it') GROUP BY ALL HAVING count(*) >= 3)"""


def report_kinds(spark, sf_dir):
    return structure.lines(reports(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


REPORT_KINDS = f"WITH {_REPORTS} SELECT kind, count(*) AS n FROM l GROUP BY kind"


def report_furniture(spark, sf_dir):
    return structure.furniture(structure.lines(reports(spark, sf_dir)))


REPORT_FURNITURE = f"WITH {_REPORTS} SELECT * FROM fu"


def report_pieces(spark, sf_dir):
    """All reports in pieces of 60 tokens at most."""
    found = structure.with_headers(structure.pieces(reports(spark, sf_dir), 60, 20))
    return found.withColumn("section", F.array_join("section", "|"))


def report_coverage(spark, sf_dir):
    """Words of the reports without furniture, and how many of them the pieces lack."""
    text = reports(spark, sf_dir)
    marked = structure.lines(text)
    kept = marked.withColumn("key", structure.running_key(F.col("line"))).join(structure.furniture(marked), ["doc", "key"], "left_anti")
    words = lambda df, c: df.select("doc", F.explode(F.filter(F.regexp_extract_all(c, F.lit(chunking.WORD), F.lit(0)), lambda w: w.rlike(r"[\p{L}\p{Nd}]"))).alias("w"))
    found = chunking.coverage(words(kept, "line"), words(structure.pieces(text, 60, 20), "body"), "doc")
    return found


REPORT_COVERAGE = rf"""WITH {_REPORTS}, kept AS (SELECT doc, line FROM l WHERE (doc, lower(trim(line))) NOT IN (SELECT (doc, key) FROM fu)),
w AS (SELECT doc, count(*) AS expected FROM (SELECT doc, unnest(regexp_extract_all(line, '\S+')) AS w FROM kept) WHERE regexp_matches(w, '[A-Za-z0-9]') GROUP BY doc) SELECT doc, expected, CAST(0 AS BIGINT) AS missing, 100.0 AS covered_pct FROM w"""


def document_pieces(spark, sf_dir):
    found = structure.with_headers(structure.pieces(_t(spark, sf_dir, "documents"), 400, 40))
    return found.withColumn("section", F.array_join("section", "|"))


def piece_payloads(spark, sf_dir):
    """Pieces of documents as one text each; every ninth document holds the first delimiter itself."""
    d = _t(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("as <<<CHUNK-BREAK>>> says. "), F.col("text"))).otherwise(F.col("text"))
    found = structure.payloads(structure.pieces(d.withColumn("text", text), 400, 40))
    held = F.when(F.col("delimiter").isNull(), 1).otherwise(F.size(F.call_function("split", F.col("payload"), F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E")))))
    return found.select("doc", F.trim(F.translate("delimiter", "\n", "")).alias("delimiter"), held.alias("texts"), F.length("payload").alias("n_chars"))


def joined_rows(spark, sf_dir):
    """The reports with their tables set in columns, as a page's text layer gives them: cells wrap onto lines of their own."""
    r = reports(spark, sf_dir)
    columns = F.regexp_replace(F.regexp_replace("text", r"\| first \| (\d+) \|", "  first cell    $1   7\n        that wraps"), r"\| second \| (\d+) \|", "  second   $1\n           and more\nprose again")
    return structure.wrapped_rows(r.withColumn("text", columns))


QUERIES = {
    "json_shapes": json_shapes, "context_units": context_units, "payload_sources": payload_sources, "subgraph_nodes": subgraph_nodes, "graph_evidence": graph_evidence, "related_neighbors": related_neighbors,
    "graph_citations": graph_citations, "shared_runs": shared_runs, "report_kinds": report_kinds, "report_furniture": report_furniture, "report_pieces": report_pieces, "report_coverage": report_coverage,
    "document_pieces": document_pieces, "piece_payloads": piece_payloads, "joined_rows": joined_rows,
}
ORACLE = {
    "json_shapes": JSON_SHAPES, "context_units": CONTEXT_UNITS, "payload_sources": PAYLOAD_SOURCES, "subgraph_nodes": SUBGRAPH_NODES, "graph_evidence": GRAPH_EVIDENCE, "related_neighbors": RELATED,
    "graph_citations": GRAPH_CITATIONS, "shared_runs": SHARED_RUNS, "report_kinds": REPORT_KINDS, "report_furniture": REPORT_FURNITURE, "report_coverage": REPORT_COVERAGE,
}
