"""Gates, co-location and identifier probes over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import gates, loaders
from ..operators import probes as probe_ops
from .retrieval_queries import _t

SIZES = (50, 100, 200, 400, 1000)


def _s(c):
    return c.cast("string")


def evidence(spark, sf_dir):
    """Parts as notes that name codes, some of four segments, some in small letters."""
    p = _t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    code = F.when(k % 3 == 0, F.concat(F.lit("PX-"), _s(k % 40), F.lit("-T-"), _s(k % 9))).otherwise(F.concat(F.lit("PX-"), _s(k % 40), F.lit("-Q"), _s(k % 30)))
    text = F.concat(F.lit("note "), F.when(k % 7 == 0, F.lower(code)).otherwise(code), F.lit(", see "), F.when(k % 11 == 0, F.concat(F.lit("CO-"), _s(k % 200 % 4))).otherwise("none"), F.lit("."))
    return p.select((k % 200).alias("doc"), (k % 200 % 4).alias("company"), F.when(k % 13 > 0, text).alias("text"))


_EVIDENCE = """p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'PX-' || (p_partkey % 40) || '-T-' || (p_partkey % 9) ELSE 'PX-' || (p_partkey % 40) || '-Q' || (p_partkey % 30) END AS code FROM part),
ev AS (SELECT k % 200 AS doc, k % 200 % 4 AS company, CASE WHEN k % 13 > 0 THEN 'note ' || CASE WHEN k % 7 = 0 THEN lower(code) ELSE code END || ', see ' || CASE WHEN k % 11 = 0 THEN 'CO-' || (k % 200 % 4) ELSE 'none' END || '.' END AS text FROM p)"""


def probes(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    j = k * 7 % 600
    long = F.concat(F.lit("PX-"), _s(j % 40), F.lit("-T-"), _s(j % 9))
    short = F.concat(F.lit("PX-"), _s(j % 40), F.lit("-Q"), _s(j % 30))
    q = (
        F.when(k % 6 == 0, F.concat(F.lit("What of "), short, F.lit("?"))).when(k % 6 == 1, F.concat(F.lit("Both "), short, F.lit(" and "), long, F.lit(" came up"))).when(k % 6 == 2, F.concat(F.lit("And PX-"), _s(j % 40), F.lit(" T-"), _s(j % 9), F.lit(", please")))
        .when(k % 6 == 3, F.concat(F.lit("tell me of "), F.lower(long))).when(k % 6 == 4, F.concat(F.lit("At CO-"), _s(k % 200 % 4), F.lit(", what of "), short, F.lit(" "), short)).otherwise(F.lit("What else?"))
    )
    kind = F.when(k % 5 == 0, gates.CONTROL).when(k % 3 == 0, "edge").otherwise("plain")
    return o.select(k.alias("probe"), kind.alias("kind"), q.alias("question"), (k % 200 % 4).alias("company"), F.when(k % 10 > 0, F.concat(F.lit("co-"), _s(k % 200 % 4))).alias("company_code"), F.when(k % 17 > 0, k % 200).alias("doc"))


_PROBES = """o AS (SELECT o_orderkey AS k, o_orderkey * 7 % 600 AS j FROM orders), l AS (SELECT *, 'PX-' || (j % 40) || '-T-' || (j % 9) AS long_, 'PX-' || (j % 40) || '-Q' || (j % 30) AS short_ FROM o),
pr AS (SELECT k AS probe, CASE WHEN k % 5 = 0 THEN 'control_unanswerable' WHEN k % 3 = 0 THEN 'edge' ELSE 'plain' END AS kind, k % 200 % 4 AS company, CASE WHEN k % 10 > 0 THEN 'co-' || (k % 200 % 4) END AS company_code, CASE WHEN k % 17 > 0 THEN k % 200 END AS doc,
  CASE k % 6 WHEN 0 THEN 'What of ' || short_ || '?' WHEN 1 THEN 'Both ' || short_ || ' and ' || long_ || ' came up' WHEN 2 THEN 'And PX-' || (j % 40) || ' T-' || (j % 9) || ', please' WHEN 3 THEN 'tell me of ' || lower(long_)
  WHEN 4 THEN 'At CO-' || (k % 200 % 4) || ', what of ' || short_ || ' ' || short_ ELSE 'What else?' END AS question FROM l)"""


def gate_simulation(spark, sf_dir):
    return gates.simulate(probes(spark, sf_dir), evidence(spark, sf_dir))


_RULES = """r AS (SELECT * FROM (VALUES ('shipped_rule', '', false, false, false), ('+join_hyphen_split', 'split', false, false, false), ('+join_hyphen_union', 'union', false, false, false), ('+reconstruct_if_known', 'known', false, false, false),
  ('+fold_case', '', true, false, false), ('+drop_company_code', '', false, true, false), ('+stricter_all_unsupported', '', false, false, true), ('+all_variants', 'known', true, true, true)) v(rule, mend, fold, drop_, strict)),
tok AS (SELECT doc, company, false AS fold, unnest(regexp_extract_all(text, '\\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+\\b')) AS code FROM ev UNION ALL SELECT doc, company, true, unnest(regexp_extract_all(upper(text), '\\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+\\b')) FROM ev),
there AS (SELECT DISTINCT 'evidence_own_doc' AS model, doc AS scope, fold, code FROM tok UNION SELECT 'evidence_all_docs', company, fold, code FROM tok),
m AS (SELECT probe, kind, company_code, rule, mend, fold, drop_, strict, model, CASE model WHEN 'evidence_own_doc' THEN doc WHEN 'evidence_all_docs' THEN company END AS scope,
  CASE WHEN fold THEN list_filter(regexp_extract_all(question, '\\b[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)+\\b'), lambda x: regexp_matches(x, '[0-9]')) ELSE list_filter(regexp_extract_all(question, '\\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+\\b'), lambda x: regexp_matches(x, '[0-9]')) END AS t
  FROM pr, r, (VALUES ('evidence_none'), ('evidence_own_doc'), ('evidence_all_docs')) e(model)),
k AS (SELECT *, t[1] || '-' || t[2] AS p1, t[2] || '-' || t[3] AS p2 FROM m), kn AS (SELECT k.*, a.code IS NOT NULL AS k1, b.code IS NOT NULL AS k2 FROM k LEFT JOIN there a ON a.model = k.model AND a.scope = k.scope AND NOT a.fold AND a.code = p1 LEFT JOIN there b ON b.model = k.model AND b.scope = k.scope AND NOT b.fold AND b.code = p2),
a AS (SELECT probe, kind, company_code, rule, fold, drop_, strict, model, scope, CASE mend WHEN '' THEN t WHEN 'known' THEN CASE WHEN k1 THEN [p1] || t[3:] WHEN k2 THEN [t[1], p2] ELSE t END
  ELSE CASE WHEN mend = 'union' THEN t ELSE [] END || CASE len(t) WHEN 0 THEN [] WHEN 1 THEN t WHEN 2 THEN [p1] ELSE [p1, t[3]] END END AS c FROM kn),
d AS (SELECT probe, kind, rule, fold, strict, model, scope, list_distinct(CASE WHEN drop_ AND company_code IS NOT NULL THEN list_filter(c, lambda x: upper(x) <> upper(company_code)) ELSE c END) AS c FROM a),
x AS (SELECT d.* EXCLUDE (c), len(c) AS asked, unnest(CASE WHEN len(c) = 0 THEN [NULL] ELSE c END) AS code FROM d),
sim AS (SELECT probe, kind, x.rule, x.model, any_value(asked) AS asked, count(t.code) AS supported, bool_or(strict) AS strict FROM x LEFT JOIN there t ON t.model = x.model AND t.scope = x.scope AND t.fold = x.fold AND t.code = CASE WHEN x.fold THEN upper(x.code) ELSE x.code END GROUP BY ALL),
fired AS (SELECT probe, kind, rule, model, asked, supported, asked > 0 AND CASE WHEN strict THEN supported = 0 ELSE supported < asked END AS fired FROM sim)"""
SIMULATION = f"WITH {_EVIDENCE}, {_PROBES}, {_RULES} SELECT * FROM fired"


def gate_margins(spark, sf_dir):
    return gates.margins(gate_simulation(spark, sf_dir))


MARGINS = f"""WITH {_EVIDENCE}, {_PROBES}, {_RULES} SELECT model, rule, kind, count(*) AS rows, count(*) FILTER (WHERE fired) AS refused FROM fired GROUP BY ALL
UNION ALL SELECT model, rule, NULL, count(*), count(*) FILTER (WHERE fired) FROM fired WHERE kind <> 'control_unanswerable' GROUP BY ALL"""


def _facts(spark, sf_dir):
    """Of each document: its words 41 to 48 as a sentence, and a word that stands at a place of its own as the code; some facts name what isn't there."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(gates.WORD), F.lit(0)).alias("w"))
    i = F.col("doc_id")
    code = F.when(i % 10 == 0, "no-such-word").otherwise(F.get("w", (i * 13 % 90).cast("int")))
    sentence = F.when(i % 11 == 0, "nowhere to be found").otherwise(F.array_join(F.slice("w", 41, 8), " "))
    return d.where(F.size("w") >= 10).select(i.alias("fact"), i.alias("doc"), code.alias("code"), sentence.alias("sentence"))


def covering_windows(spark, sf_dir):
    return gates.covering(gates.places(_t(spark, sf_dir, "documents"), _facts(spark, sf_dir)))


_FACTS = r"""w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id AS fact, w, CASE WHEN doc_id % 10 = 0 THEN 'no-such-word' ELSE w[doc_id * 13 % 90 + 1] END AS code, CASE WHEN doc_id % 11 = 0 THEN ['nowhere', 'to', 'be', 'found'] ELSE w[41:48] END AS s FROM w WHERE len(w) >= 10),
i AS (SELECT fact, w, code, s, unnest(range(0, len(w))) AS pos FROM f), codes AS (SELECT fact, pos FROM i WHERE w[pos + 1] = code), runs AS (SELECT fact, pos, len(s) AS n FROM i WHERE len(s) > 0 AND w[pos + 1] = s[1] AND w[pos + 1 : pos + len(s)] = s)"""
COVERING = f"""WITH {_FACTS} SELECT r.fact, CAST(min(CASE WHEN c.pos IS NOT NULL THEN greatest(r.pos + r.n, c.pos + 1) - least(r.pos, c.pos) END) AS BIGINT) AS window FROM runs r LEFT JOIN codes c ON c.fact = r.fact GROUP BY r.fact"""


def co_location_sweep(spark, sf_dir):
    f = _facts(spark, sf_dir)
    found = gates.co_location(gates.places(_t(spark, sf_dir, "documents"), f), f, SIZES)
    return found.groupBy("size", "verdict").agg(F.count("*").alias("facts"))


SWEEP = f"""WITH {_FACTS}, z AS (SELECT unnest([50, 100, 200, 400, 1000]) AS size), a AS (SELECT size, fact, pos // size AS piece FROM codes, z), b AS (SELECT size, fact, pos // size AS piece FROM runs, z WHERE pos // size = (pos + n - 1) // size),
v AS (SELECT size, fact, CASE WHEN (size, fact) NOT IN (SELECT (size, fact) FROM b) THEN 'no_piece_with_sentence' WHEN (size, fact) NOT IN (SELECT (size, fact) FROM a) THEN 'no_piece_with_code'
  WHEN (size, fact) IN (SELECT (a.size, a.fact) FROM a JOIN b USING (size, fact, piece)) THEN 'co_located' ELSE 'different_pieces' END AS verdict FROM f, z)
SELECT size, verdict, count(*) AS facts FROM v GROUP BY ALL"""

def _codes(spark, sf_dir):
    k = F.col("p_partkey")
    return _t(spark, sf_dir, "part").select(F.concat(F.lit("co"), _s(k % 4)).alias("company"), (k % 200).alias("doc"), k.alias("fact"), F.concat(F.lit("PX-"), _s(k % 40), F.lit("-T"), _s(k)).alias("code"))


def _absent(spark, sf_dir):
    c = _codes(spark, sf_dir)
    fakes = probe_ops.lookalikes(c.where("fact % 50 = 0"), c, 1)
    return c.join(fakes, "code").select("company", F.col("fake").alias("code"))


_CODES = """c AS (SELECT 'co' || (p_partkey % 4) AS company, p_partkey % 200 AS doc, p_partkey AS fact, 'PX-' || (p_partkey % 40) || '-T' || p_partkey AS code FROM part),
pos AS (SELECT code, fact, unnest(range(1, length(code) + 1)) AS i FROM c), di AS (SELECT *, unnest(range(0, 10)) AS d FROM pos WHERE substr(code, i, 1) BETWEEN '0' AND '9'),
fk AS (SELECT DISTINCT code, fact, substr(code, 1, i - 1) || d || substr(code, i + 1) AS fake FROM di), fr AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY fake) AS place FROM fk WHERE fake NOT IN (SELECT code FROM c))"""


def code_lookalikes(spark, sf_dir):
    c = _codes(spark, sf_dir)
    return probe_ops.lookalikes(c, c)


LOOKALIKES = f"WITH {_CODES} SELECT code, fake, place FROM fr WHERE place <= 3"


def identifier_probes(spark, sf_dir):
    c = _codes(spark, sf_dir)
    pieces = c.select("company", "doc", F.when(F.col("fact") % 13 > 0, F.concat(F.lit("row "), F.col("code"), F.lit(" done"))).alias("text"))
    found = probe_ops.identifier_probes(c, pieces, _absent(spark, sf_dir), ["What of {code} at {company}?", "Tell me of {code}"])
    return found.withColumns({"asked": F.array_join("asked", "|"), "unsupported": F.array_join("unsupported", "|")})


PROBES = f"""WITH {_CODES}, f AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY code, fact) - 1 AS n FROM c), q AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'What of ' ELSE 'Tell me of ' END AS a, CASE WHEN n % 2 = 0 THEN ' at ' || company || '?' ELSE '' END AS z FROM f),
ab AS (SELECT company, fake, row_number() OVER (PARTITION BY company ORDER BY fake) - 1 AS m FROM (SELECT DISTINCT c.company, fr.fake FROM c JOIN fr USING (code, fact) WHERE fact % 50 = 0 AND place = 1)), n_ab AS (SELECT company, count(*) AS of_ FROM ab GROUP BY company),
two AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY doc, code, fact) - 1 AS k FROM (SELECT *, lead(code) OVER (PARTITION BY company, doc ORDER BY code, fact) AS other FROM f) WHERE other IS NOT NULL),
v AS (SELECT *, n // 4 AS t, split_part(code, '-', 1) AS c1, split_part(code, '-', 2) AS c2, split_part(code, '-', 3) AS c3 FROM q WHERE n % 4 = 0),
r AS (SELECT company || '-s' || (n + 1) AS probe, 'identifier_answerable' AS kind, company, doc, a || code || z AS question, [code] AS asked FROM q
  UNION ALL SELECT company || '-e' || (n + 1), 'edge_' || (['lowercase_code', 'hyphen_as_space', 'trailing_comma'])[t % 3 + 1], company, doc, a || CASE t % 3 WHEN 0 THEN lower(code) WHEN 2 THEN code || ',' ELSE CASE WHEN t % 2 = 0 THEN c1 || ' ' || c2 || '-' || c3 ELSE c1 || '-' || c2 || ' ' || c3 END END || z,
    CASE t % 3 WHEN 0 THEN [] WHEN 2 THEN [code] ELSE CASE WHEN t % 2 = 0 THEN [] ELSE [c1 || '-' || c2] END END FROM v
  UNION ALL SELECT company || '-t' || (k + 1), 'two_code_both_present', company, doc, 'Both ' || code || ' and ' || other || ' came up in the review - what outcome was recorded for each?', [code, other] FROM two WHERE k < 3
  UNION ALL SELECT f.company || '-x' || (n + 1), 'two_code_one_absent', f.company, doc, code || ' and ' || fake || ' were both raised - what outcome was recorded for each?', [code, fake] FROM f JOIN n_ab USING (company) JOIN ab ON ab.company = f.company AND ab.m = n % of_ WHERE n < 3
  UNION ALL SELECT company || '-u' || (m + 1), 'control_unanswerable', company, NULL, 'What outcome was recorded for ' || fake || '?', [fake] FROM ab),
known AS (SELECT company, doc, code FROM c WHERE fact % 13 > 0), x AS (SELECT r.*, list_filter(asked, lambda y: NOT list_contains(coalesce(k.codes, []), y)) AS u FROM r LEFT JOIN (SELECT company, doc, list(code) AS codes FROM known GROUP BY ALL UNION ALL SELECT company, NULL, list(code) FROM known GROUP BY ALL) k
  ON k.company = r.company AND k.doc IS NOT DISTINCT FROM r.doc)
SELECT probe, kind, company, CAST(doc AS VARCHAR) AS doc, question, array_to_string(asked, '|') AS asked, array_to_string(u, '|') AS unsupported, CASE WHEN len(asked) = 0 THEN 'no_identifier' WHEN len(u) > 0 THEN 'fire' ELSE 'not_fire' END AS expected_gate FROM x"""


def _manifests(spark, sf_dir):
    """Orders as probe rows of forty manifests: some broken, without a company, with unknown groups, odd rows and words in two shapes."""
    k = F.col("o_orderkey")
    src = F.col("o_custkey") % 40
    bucket = F.element_at(F.array(F.lit("scoped"), F.lit("cross_company"), F.lit("unanswerable")), (k % 3 + 1).cast("int"))
    shape = F.when(k % 83 == 0, "odd").otherwise(F.replace(bucket, F.lit("_"), F.lit("-")))
    row = F.when(k % 97 == 0, F.lit('"text"')).when(k % 89 == 0, F.lit('{"shape": "scoped"}')).otherwise(F.concat(F.lit('{"question": "q'), _s(k % 600), F.lit('", "shape": "'), shape, F.lit('"}')))
    rows = _t(spark, sf_dir, "orders").groupBy(src.alias("src"), bucket.alias("bucket")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), row.alias("row")))), lambda x: x["row"]), ", ").alias("rows"))
    made = F.concat(F.lit('"'), F.col("bucket"), F.lit('": '), F.when((F.col("src") % 17 == 3) & (F.col("bucket") == "unanswerable"), F.lit('{"a": 1}')).otherwise(F.concat(F.lit("["), F.col("rows"), F.lit("]"))))
    g = rows.groupBy("src").agg(F.array_join(F.sort_array(F.collect_list(made)), ", ").alias("groups"))
    head = F.concat(F.lit("{"), F.when(F.col("src") % 13 == 0, F.lit("")).otherwise(F.concat(F.lit('"company": "co'), _s(F.col("src") % 7), F.lit('", '))), F.lit('"probes": {'))
    text = F.concat(head, F.when(F.col("src") % 5 == 0, F.lit('"extra": [], ')).otherwise(F.lit("")), F.col("groups"), F.lit("}}"))
    return g.select(F.concat(F.lit("m"), _s(F.col("src"))).alias("source"), F.when(F.col("src") % 11 == 0, F.substring(text, 1, 50)).otherwise(text).alias("text"))


def manifest_probes(spark, sf_dir):
    return loaders.manifests(_manifests(spark, sf_dir))[0]


def manifest_problems(spark, sf_dir):
    return loaders.manifests(_manifests(spark, sf_dir))[1]


_MANIFESTS = """b AS (SELECT o_orderkey AS k, o_custkey % 40 AS src, 'm' || (o_custkey % 40) AS source, 'co' || (o_custkey % 40 % 7) AS company, o_orderkey % 3 AS ord, (['scoped', 'cross_company', 'unanswerable'])[o_orderkey % 3 + 1] AS bucket, 'q' || (o_orderkey % 600) AS question FROM orders),
p AS (SELECT *, replace(bucket, '_', '-') AS shape, row_number() OVER (PARTITION BY src, ord ORDER BY k) - 1 AS i FROM b), fine AS (SELECT * FROM p WHERE src % 11 <> 0 AND src % 13 <> 0), l AS (SELECT * FROM fine WHERE NOT (src % 17 = 3 AND ord = 2)),
j AS (SELECT *, 'probes.' || bucket || '[' || i || ']' AS spot, CASE WHEN k % 97 = 0 THEN 'not an object' WHEN k % 89 = 0 THEN 'no ''question'' string' WHEN k % 83 = 0 THEN 'shape does not match its group, expected ' || shape END AS wrong FROM l),
g AS (SELECT *, first_value(shape) OVER (PARTITION BY company, question ORDER BY source, ord, i) AS first_shape FROM j WHERE wrong IS NULL), kept AS (SELECT company, question, shape, count(*) AS probe_entries FROM g WHERE shape = first_shape GROUP BY ALL)"""
MANIFEST_PROBES = f"WITH {_MANIFESTS} SELECT *, CAST((SELECT sum(probe_entries) FROM kept) AS BIGINT) AS total_entries FROM kept"
MANIFEST_PROBLEMS = f"""WITH {_MANIFESTS} SELECT DISTINCT source, '' AS where, CASE WHEN src % 11 = 0 THEN 'manifest is not valid JSON' ELSE 'manifest has no ''company'' string' END AS problem FROM p WHERE src % 11 = 0 OR src % 13 = 0
UNION ALL SELECT DISTINCT source, 'probes', 'unrecognised probe shape key extra' FROM fine WHERE src % 5 = 0 UNION ALL SELECT DISTINCT source, 'probes.unanswerable', 'not a list' FROM fine WHERE src % 17 = 3
UNION ALL SELECT source, spot, wrong FROM j WHERE wrong IS NOT NULL UNION ALL SELECT source, spot, 'the same question text also appears as shape ' || first_shape FROM g WHERE shape <> first_shape"""


def _lines(spark, sf_dir):
    i = F.col("event_id")
    kinds = ['{"query": "q", "verdict": " Correct "}', '{"question": "q", "label": "odd", "company_scope": "c"}', "not json", "[1]", '{"prompt": null, "grade": 3, "draw": 2}', '{"question": "q", "label": "refused", "requestid": "r1", "draw": 1.5}', "  "]
    return _t(spark, sf_dir, "events").select(F.concat(F.lit("u"), _s(F.col("user_id"))).alias("source"), i.alias("line"), F.element_at(F.array(*[F.lit(x) for x in kinds]), (i % 7 + 1).cast("int")).alias("text"))


def export_rows(spark, sf_dir):
    return loaders.exports(_lines(spark, sf_dir))[0]


def export_problems(spark, sf_dir):
    return loaders.exports(_lines(spark, sf_dir))[1]


EXPORT_ROWS = """SELECT 'u' || user_id AS source, event_id AS line, CASE WHEN event_id % 7 <> 4 THEN 'q' END AS question, CASE event_id % 7 WHEN 0 THEN 'correct' WHEN 1 THEN 'odd' WHEN 5 THEN 'refused' END AS label, CASE event_id % 7 WHEN 0 THEN 'accepted' WHEN 5 THEN 'refused' END AS role,
  CASE WHEN event_id % 7 = 1 THEN 'c' END AS company, CASE WHEN event_id % 7 = 5 THEN 'r1' END AS request_id, CASE event_id % 7 WHEN 4 THEN '2' WHEN 5 THEN '1.5' END AS draw FROM events WHERE event_id % 7 IN (0, 1, 4, 5)"""
EXPORT_PROBLEMS = """SELECT 'u' || user_id AS source, 'line ' || event_id AS where, unnest(CASE event_id % 7 WHEN 1 THEN ['unrecognised label odd'] WHEN 2 THEN ['not JSON'] WHEN 3 THEN ['JSON array, expected object'] ELSE ['no ''question'' field', 'label is not a string'] END) AS problem FROM events WHERE event_id % 7 IN (1, 2, 3, 4)"""


def name_candidates(spark, sf_dir):
    """Capitalised runs in what conversations say, with some of their own words as known names and as ordinary words."""
    c = _t(spark, sf_dir, "conversations")
    known, ordinary = F.array(F.lit("the and"), F.lit("en")), F.array(*[F.lit(w) for w in ("the", "and", "that", "was", "a", "la", "der", "el")])
    return c.select("conv_id", "turn", F.array_join(X.name_candidates(F.concat(F.lit("about "), F.initcap(F.substring("text", 1, 40)), F.lit(" then "), F.col("text")), known, ordinary), "|").alias("candidates"))


QUERIES = {
    "gate_simulation": gate_simulation, "gate_margins": gate_margins, "covering_windows": covering_windows, "co_location_sweep": co_location_sweep, "code_lookalikes": code_lookalikes, "identifier_probes": identifier_probes,
    "manifest_probes": manifest_probes, "manifest_problems": manifest_problems, "export_rows": export_rows, "export_problems": export_problems, "name_candidates": name_candidates,
}
ORACLE = {
    "gate_simulation": SIMULATION, "gate_margins": MARGINS, "covering_windows": COVERING, "co_location_sweep": SWEEP, "code_lookalikes": LOOKALIKES, "identifier_probes": PROBES,
    "manifest_probes": MANIFEST_PROBES, "manifest_problems": MANIFEST_PROBLEMS, "export_rows": EXPORT_ROWS, "export_problems": EXPORT_PROBLEMS,
}
