"""Inline values for single operators."""

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from veldspar.functions import rows as P
from veldspar.functions import text as X
from veldspar.operators import chunking, conversation, evaluation, graph, lifecycle, metrics, registry, retrieval, runs
from veldspar.sources import files
from veldspar.streaming import events


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'string' if isinstance(values[n], str) or values[n] is None else 'int'}" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("grades", "ndcg", "ap", "first"),
    [([2, 0, 0, 0, 0], 1.0, 1.0, 1), ([0, 0, 2], 0.5, 0.3333, 3), ([1, 2, 0, 0, 0], 0.7967, 1.0, 1), ([0, 2, 0, 2], 0.6509, 0.5, 2), ([2, 0, 2], 0.9197, 0.8333, 1), ([0, 0], 0.0, 0.0, None)],
)
def test_ranking(spark, grades, ndcg, ap, first):
    df = spark.createDataFrame([(1, i + 1, g) for i, g in enumerate(grades)], "p int, rank int, grade int")
    r = metrics.ranking(df, "p", "rank", "grade").first()
    assert (r.ndcg, r.average_precision, r.first_hit_rank) == (ndcg, ap, first)


def test_paired(spark):
    a = spark.createDataFrame([(i, 1.0) for i in range(10)], "id int, v double")
    b = spark.createDataFrame([(i, 1.0) for i in range(6, 14)], "id int, v double")
    r = metrics.paired(a, b, "id", "v").first()
    assert (r.n, r.only_in_a, r.only_in_b, r.difference) == (4, 6, 4, 0.0)


def test_bootstrap(spark):
    same = [("same", i, float(i % 2), float(i % 2)) for i in range(40)]
    apart = [("apart", i, 0.0, float(i < 30)) for i in range(40)]
    r = {x.arm: x for x in metrics.bootstrap(spark.createDataFrame(same + apart, "arm string, id int, a double, b double"), ["arm"]).collect()}
    assert (r["same"].difference, r["same"].resolved) == (0.0, False)
    assert (r["apart"].difference, r["apart"].resolved) == (0.75, True)


def test_valley_depth(spark):
    sims = [0.9, 0.85, 0.8, 0.2, 0.75, 0.9]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sims)], "d int, i int, s double")
    depths = [r.depth for r in chunking.topic_depths(df, ["d"], "i", "s").orderBy("i").collect()]
    assert [d > 0 for d in depths] == [False, False, False, True, False, False]


def test_duplicate_pick(spark):
    rows = [(s, f"/{s}", "h", s, None, "t", None) for s in ("accepted", "submitted", "processing", "ingested", "failed")]
    rows.append(("marked", "/m", "h", "ingested", "duplicate_content", "a", None))
    df = spark.createDataFrame(rows, "document_id string, path string, sha256 string, status string, error_code string, updated_at string, company string")
    got = {r.document_id: (r.duplicate_of, r.match_count) for r in registry.pick_duplicates(df).collect()}
    assert got["failed"] == ("ingested", 4)
    assert got["ingested"] == ("processing", 3)
    assert got["marked"] == ("ingested", 4)


def test_ambiguous_owner(spark):
    reg = spark.createDataFrame([("a/x.pdf", "A", "h1"), ("b/x.pdf", "B", "h2"), ("c/y.pdf", "C", "h3"), ("d/y.pdf", "C", "h4"), ("100%.pdf", "D", "h5"), ("100x.pdf", "E", "h6")], "path string, company string, sha256 string")
    refs = spark.createDataFrame([("x.pdf",), ("y.pdf",), ("100%.pdf",), ("none.pdf",)], "path string")
    got = {r.path: (r.companies, r.ambiguous) for r in retrieval.owners_by_name(refs, reg).collect()}
    assert got == {"x.pdf": ([], True), "y.pdf": (["C"], False), "100%.pdf": (["D"], False)}


def test_dropped_content_still_blocks_its_path(spark):
    rows = [(1, "a", "t1"), (2, "b", "t1"), (3, "b", "t2"), (4, "c", None), (5, "d", None)]
    df = spark.createDataFrame([(0, *r) for r in rows], "q int, rank int, path string, content string")
    got = retrieval.first_occurrences(df, ["rank"], "path", "content", ["q"]).orderBy("rank").collect()
    assert [r.rank for r in got] == [1, 4, 5]


def test_budget_closes_at_the_first_that_does_not_fit(spark):
    df = spark.createDataFrame([(0, 1, 100), (0, 2, 150), (0, 3, 10)], "q int, rank int, n int")
    assert [r.rank for r in retrieval.fill(df, F.col("n"), 200, ["q"], ["rank"]).collect()] == [1]


@pytest.mark.parametrize(
    ("line", "kind"),
    [("FREIGHT COSTS", "heading"), ("FREIGHT COSTS ARE RISING.", "text"), ("## Part", "heading"), ("| a | b |", "table"), ("|---|---|", "table_separator"), ("- item", "bullet"), ("Page 3 of 9", "page_mark"), ("  ", "blank"), ("1.2 Scope", "heading")],
)
def test_line_kind(spark, line, kind):
    assert one(spark, chunking.line_kind(F.col("t")), t=line) == kind


def test_fixed_chunks_cover_all_words(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(23)))), (2, ""), (3, None), (4, "one")], "doc_id int, text string")
    got = [(r.doc_id, r.chunk, r.body.split()[0], r.n_tokens) for r in chunking.fixed_chunks(df, 10, 3).orderBy("doc_id", "chunk").collect()]
    assert got == [(1, 0, "0", 10), (1, 1, "7", 10), (1, 2, "14", 9), (4, 0, "one", 1)]


def test_sections_keep_every_word():
    text = "# A\n" + "word " * 300 + "\n## B\nshort\n\n" + "x" * 5000 + "\n# C\nend"
    found = chunking.sections(text, 100, 20)
    assert "".join("".join(b.split()) for _, b in found) == "".join(text.split())
    assert all(chunking.estimate(b) <= 100 for _, b in found)
    assert found[-1][0] == ["C"]


def test_transcript(spark):
    text = "Ann: hello there\nBob: hi\nmore of it\nAnn: bye\nBob: see you"
    df = spark.createDataFrame([(1, text), (2, "Key: value\nOther: thing"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in chunking.transcript(df).collect()}
    assert [t.speaker for t in got[1].turns] == ["Ann", "Bob", "Ann", "Bob"] and got[1].turns[1].words == "hi more of it"
    assert not got[2].is_transcript and not got[3].is_transcript


@pytest.mark.parametrize(
    ("q", "a", "e", "verdict", "supported"),
    [("AB-12?", "", "has AB-12", "supported", True), ("AB-12?", "", "has AB-123", "no_support_for_asked_identifier", False), ("what?", "ZZ-9", "text", "unsupported_identifiers_in_answer", False), ("what?", "no", "text", "no_identifier_in_question", None), ("AB-12?", "x", "  ", "no_evidence", False)],
)
def test_support(spark, q, a, e, verdict, supported):
    r = one(spark, X.support(F.col("q"), F.col("a"), F.col("e")), q=q, a=a, e=e)
    assert (r.verdict, r.supported) == (verdict, supported)


@pytest.mark.parametrize(("path", "norm", "base"), [("A/./b/../C.md", "a/c.md", "C.md"), ("/x//Y/Z", "/x/y/z", "Z"), ("../q/", "../q", "q"), (" ./ ", None, None)])
def test_paths(spark, path, norm, base):
    assert one(spark, X.normal_path(F.col("p")), p=path) == norm
    assert base is None or one(spark, X.basename(F.col("p")), p=path) == base
    assert one(spark, X.basename(F.col("p")), p="x\\y\\Z") == "Z"


def test_legal_moves(spark):
    cases = [(None, "pending", True), ("pending", "bogus", False), ("legacy", "failed", True), ("ingested", "failed", False), ("ingested", "ingested", True), ("skipped", "ingested", False), ("processing", "ingested", True)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "f string, t string").select("f", "t", registry.is_legal(F.col("f"), F.col("t")).alias("ok"))
    assert [(r.f, r.t, r.ok) for r in df.collect()] == cases


def test_rows_functions():
    assert P.sanitize("  a&amp;lt;\x00b​ ") == "a&lt;b​"
    assert P.json_object('x {bad {"a": 1} {"b": {"c": 2}}') == '{"a": 1}'
    assert P.json_object('x {bad {"a": 1} {"b": {"c": 2}}', last=True) == '{"b": {"c": 2}}'
    assert P.detect_companies("What of Acme Corp and Acmeist?", ["Acme", "Acme Corp"]) == ["Acme Corp"]
    assert P.decode("é".encode("cp1252")) == ("é", "cp1252")
    masked = P.anonymize("mail a@b.co or a@b.co, 123-45-6789 and 5551234567 for Ada Mary Lovelace; Find Ada Mary; New York")
    assert masked.count("EMAIL_") == 2 and "SSN_" in masked and "PHONE_" in masked and "PERSON_" in masked and masked.endswith("Find Ada Mary; New York") and "a@b" not in masked
    assert P.keywords('Does "net profit" of Acme Corp grow 12 percent in one year at all?') == (["net", "profit", "grow", "percent", "one", "year", "all"], ["net profit", "Acme Corp", "12"])
    assert P.keywords("Profit of Acme Corp") == (["profit"], ["Profit of Acme Corp", "Acme Corp"])


def test_credit(spark):
    units = spark.createDataFrame([(1, 1, "alpha  beta"), (1, 2, "Gamma \u201cdelta\u201d"), (1, 3, "Alpha beta again"), (2, 1, "alpha beta")], "probe int, rank int, text string")
    rows = [(1, 1, "\u2018alpha BETA\u2019 ", 2), (1, 2, "beta gamma", 1), (1, 3, "nowhere", 1), (1, 4, " alpha beta", 0), (1, 5, " '' ", 1), (1, 6, None, 1), (1, 7, "gamma", 9), (1, 8, "again", None), (1, 9, "Beta Again", 0)]
    quotes = spark.createDataFrame(rows, "probe int, quote_id int, quote string, grade int")
    got = retrieval.credit(units, quotes)
    assert {(r.quote_id, r.grade, r.rank) for r in got.collect()} == {(1, 2, 1), (2, 1, None), (3, 1, None), (7, 2, 2), (8, 2, 3), (9, 0, 3)}
    assert {(r.probe, r.rank, r.grade) for r in retrieval.unit_grades(got, units).collect()} == {(1, 1, 2), (1, 2, 2), (1, 3, 2), (2, 1, 0)}


def test_seams_are_those_of_a_document(spark):
    chunks = spark.createDataFrame([("A", 0, "one alpha", 5), ("B", 0, "beta two", 5), ("A", 1, "beta three key", 5), ("A", 3, "four value", 5), ("C", 0, "x alpha beta y", 50)], "doc string, index int, text string, tokens int")
    gold = spark.createDataFrame([(1, "Alpha  beta three"), (1, "a"), (2, "three key four"), (3, "\u201cx alpha beta\u201d"), (4, "gone text here"), (5, " ")], "probe int, quote string").where("quote <> 'a'")
    places = retrieval.quote_places(chunks, gold)
    assert {tuple(r) for r in places.collect()} == {(1, "A", 0, True), (3, "C", 0, False)}  # index 1 and 3 of A don't follow each other
    ranking = spark.createDataFrame([(p, *r) for p in (1, 2, 3) for r in (("A", 1, 1), ("B", 0, 2), ("A", 0, 3), ("A", 3, 4))], "probe int, doc string, index int, rank int")
    rows = spark.createDataFrame([(1, "three", "key"), (2, "four", "key"), (3, "k", "v")], "probe int, row_key string, row_value string")
    sources = spark.createDataFrame([("Gone text\nHERE it was",), ("one alpha beta three",)], "text string")
    ranked = retrieval.rank_probes(places, ranking, chunks, gold, [10, 15], sources, rows)
    got = {r.probe: (r.rank, r.located, r.quote_in_seam, r.lost_text, r.row_intact, r.within_10, r.within_15) for r in ranked.collect()}
    assert got == {1: (3, True, True, False, True, False, True), 2: (None, False, False, False, False, False, False), 3: (5, True, False, False, None, False, False), 4: (None, False, False, True, None, False, False), 5: (None, False, False, False, None, False, False)}
    r = retrieval.recall_report(ranked, [1, 3], [10, 15]).first()
    assert (r.n, r.seam_quotes, r.located_pct, r.lost_text_n, r.row_intact_n, r.row_intact_pct, r.recall_1, r.recall_3, r.recall_15_tokens, r.mrr, r.found_at_all) == (5, 1, 40.0, 1, 2, 50.0, 0.0, 20.0, 20.0, round((1 / 3 + 1 / 5) / 5, 4), 40.0)


def test_contained_finds_every_substring(spark):
    texts = ["the quick brown fox", "quick", "ab", "", "a b c d", "xquick browny", "日本語 text"]
    needles = ["quick brown", "k b", "b", "ab", "the quick brown fox", "fox", " b", "c d", "本", "own fox", "brown fo", "he quick br"]
    df, nd = spark.createDataFrame(list(enumerate(texts)), "id int, t string"), spark.createDataFrame(list(enumerate(needles)), "probe int, needle string")
    got = {(r.probe, r.id) for r in retrieval.contained(df, nd, ["id"]).collect()}
    assert got == {(i, j) for i, n in enumerate(needles) for j, t in enumerate(texts) if n in t}


def test_cut_block(spark):
    block = "Source: a\n" + "one line\n" * 20
    cut = one(spark, retrieval.cut_block(F.col("b"), 100), b=block)
    assert len(cut) <= 100 and cut.startswith("Source: a\none line\n") and cut.endswith("line\n" + retrieval.CUT)


def test_expand_two_hops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "source int, target int")
    got = {(r.hop, r.source, r.target) for r in graph.expand(edges, spark.createDataFrame([(1,)], "seed int"), 10).collect()}
    assert got == {(1, 1, 2), (2, 2, 3)}


def test_history_and_prompt(spark):
    turns = spark.createDataFrame([(1, 1, "user", "a" * 900), (1, 2, "assistant", "x"), (1, 3, "user", "q"), (1, 4, "user", "  ")], "conv_id int, turn int, role string, text string")
    h = conversation.history(turns).first()
    assert (h.n_turns, len(h.block)) == (2, 402)
    assert conversation.latest_prompt(turns).first().prompt == "q"


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "acme").mkdir()
    (tmp_path / "acme" / "a.txt").write_bytes("caf\xe9".encode("cp1252"))
    (tmp_path / "acme" / "._a.txt").write_text("x")
    (tmp_path / "b.exe").write_text("x")
    (tmp_path / "c.txt.part").write_text("x")
    buf = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(buf.getvalue())
    (tmp_path / "e.docx").write_bytes(b"not a zip")
    found = files.scan(spark, str(tmp_path))
    rows = {r.name: r for r in found.collect()}
    assert set(rows) == {"a.txt", "b.exe", "d.docx", "e.docx"}
    assert rows["a.txt"].company == "acme" and rows["b.exe"].company is None and rows["b.exe"].validation.verdict == "reject"
    text = {r.path.rsplit("/", 1)[1]: r for r in files.extract(found).collect()}
    assert text["a.txt"].text == "café" and text["d.docx"].text == "# Title\nBody\n| 1 | 2 |"
    assert text["e.docx"].error_code.startswith("extract_failed")


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{broken\n')
    rows = files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int", strict=False).collect()
    assert [r.a for r in rows] == [1, None]


def test_stream_windows_and_state(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'x' event_type, 1.0D value, 1L event_id union all select timestamp'2024-01-01 00:20:00', 'x', 2.0D, 1L union all select timestamp'2024-01-02 00:00:00', 'x', 5.0D, 2L").coalesce(1).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    stream = events.read_events(spark, str(src), schema)
    q = events.tumbling(stream).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.n, r.total) for r in spark.table("w").collect()} == {(2, 3.0), (1, 5.0)}
    seen = tmp_path / "seen"
    rows = [("p", "h1", False, 1), ("p", "h1", True, 2), ("p", "h1", True, 3), ("p", "h2", True, 4)]
    spark.createDataFrame(rows, "path string, sha256 string, ok boolean, ts int").coalesce(1).write.parquet(str(seen))
    snap = spark.readStream.schema("path string, sha256 string, ok boolean, ts int").parquet(str(seen))
    q = events.file_actions(snap).writeStream.format("memory").queryName("acts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.action for r in spark.table("acts").collect()] == ["new", "retry", "unchanged", "changed"]


def test_serving_functions(spark):
    from veldspar.operators import evaluation as E

    df = spark.createDataFrame([("a=b, c;; d= ;e=f",)], "raw string")
    assert df.select(E.alias_map(F.col("raw")).alias("m")).first().m == {"a": ["b", "c"], "e": ["f"]}
    m = spark.createDataFrame([({"x": "1", "y": "2"}, {"y": None, "z": "3"})], "old map<string,string>, new map<string,string>")
    assert m.select(E.merged_warnings(F.col("old"), F.col("new")).alias("m")).first().m == {"x": "1", "z": "3"}
    assert E.word_pieces("unaffable", {"un", "##aff", "##able"}) == ["un", "##aff", "##able"]
    assert E.word_pieces("xyz", {"x"}) == ["[UNK]"]
    arms = spark.createDataFrame([("a", 80.0, 9), ("b", 90.0, 9), ("c", 90.0, 5), ("d", None, 1)], "arm string, correct_pct double, p95_ms int")
    assert E.best_arm(arms).first().arm == "c"
    assert one(spark, E.is_weak(F.col("t")), t="Sorry, I don't know") is False
    assert one(spark, E.is_weak(F.col("t")), t="There is NOT enough information here") is True
    reason = lambda q, weak: one(spark, E.rewrite_reason(F.col("q"), ["transcript", "workshop"], F.lit(weak), 5), q=q)
    assert [reason("a b c d e", False), reason("The Workshop", False), reason("plain", True), reason("plain", False), reason("  ", True)] == ["long_query", "transcript_keyword", "weak_signal", "none", "none"]
    assert one(spark, E.is_transient(F.lit(404), F.col("e")), e="ReadTimeout") is True and one(spark, E.is_retryable(F.col("c")), c="decode_failed") is False
    assert one(spark, E.size_request(F.col("n")), n=100) == 184


def test_topic_cuts_are_not_neighbours(spark):
    from veldspar.operators import evaluation as E

    df = spark.createDataFrame([(1, i, d) for i, d in enumerate([0.0, 0.5, 0.9, 0.4, 0.0, 0.35])], "doc int, i int, depth double")
    got = [r.topic for r in E.topic_groups(df, "doc", "i").orderBy("i").collect()]
    assert got == [0, 0, 0, 1, 1, 1]


def test_bootstrap_in_parts(spark):
    import inspect

    from veldspar.plans import retrieval_queries

    assert "samples" not in inspect.getsource(retrieval_queries.paired_bootstrap)
    rows = [("x", i, 0.0, float(i % 10 < 6)) for i in range(1000)]
    whole, parts = (metrics.bootstrap(spark.createDataFrame(rows, "arm string, id int, a double, b double"), ["arm"], size=s).first() for s in (2000, 50))
    for r in (whole, parts):  # 0.6 with a standard error of 0.0155
        assert (r.n, r.difference, r.resolved) == (1000, 0.6, True) and abs(r.low - 0.5696) < 0.006 and abs(r.high - 0.6304) < 0.006


def test_ranks_of_counted_values(spark):
    rows = [("a", float(v % 37)) for v in range(500)] + [("b", None), (None, 2.0), (None, 1.0), ("c", 5.0), ("c", None)]
    got = {r.g: r for r in metrics.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    v = sorted(float(x % 37) for x in range(500))
    assert tuple(got["a"])[1:] == (500, v[474], v[474], v[475], v[475], (v[249] + v[250]) / 2)
    assert tuple(got["b"])[1:] == (0, None, None, None, None, None) and tuple(got[None])[1:] == (2, 2.0, 2.0, 2.0, 2.0, 1.5) and got["c"].median == 5.0
    plan = metrics.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v")._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_paths_quote_the_whole_page(spark, tmp_path):
    from urllib.parse import unquote

    from veldspar.plans import text_queries

    html = "<p>" + "a b/c " * 50 + "end</p>"
    spark.createDataFrame([(1, "http://a.b/c", html)], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert unquote(text_queries.paths(spark, str(tmp_path)).first().quoted) == html


def test_owners_by_name(spark):
    reg = [("a/x.pdf", "A", "h1", None), ("b/x.pdf", "B", "h2", None), ("c/y.pdf", "C", "h3", None), ("d/y.pdf", "C", "h4", None), ("e/z.pdf", "E", "h3", None), ("f/p.pdf", "F", "pending", "sent"), ("g/q.pdf", "G", "pending", None)]
    df = spark.createDataFrame(reg, "path string, company string, sha256 string, submitted_source string")
    refs = spark.createDataFrame([("x.pdf",), ("y.pdf",), ("a/x.pdf",), ("sent",), ("none.pdf",), (None,)], "path string")
    got = {r.path: (r.via, r.companies, r.ambiguous) for r in retrieval.owners_by_name(refs, df).collect()}
    # y.pdf has two hashes of one company, so that company E of equal bytes makes it no riddle
    assert got == {"x.pdf": ("basename", [], True), "y.pdf": ("basename", ["C", "E"], False), "a/x.pdf": ("path", ["A"], False), "sent": ("submitted_source", ["F"], False)}
    scoped = retrieval.scope(refs, retrieval.owners_by_name(refs, df), F.array(F.lit("E")))
    assert {r.path: r.scope for r in scoped.collect()} == {"x.pdf": "ambiguous", "y.pdf": "kept", "a/x.pdf": "other", "sent": "other", "none.pdf": "unattributable", None: "unattributable"}


def test_reindex_force(spark):
    df = spark.createDataFrame([(1, "ingested", "accept", True), (2, "failed", "auto_split", False)], "document_id int, status string, validation_state string, query_ready boolean")
    df = df.withColumns({"error_code": F.lit(None).cast("string"), "track_id": F.lit("t"), "retry_count": F.lit(3)})
    assert {r.document_id: r.reason for r in lifecycle.reindex(df).collect()} == {1: "ingested", 2: "split_required"}
    assert {(r.outcome, r.status, r.track_id, r.retry_count) for r in lifecycle.reindex(df, force=True).collect()} == {("queued", "pending", None, 0)}


def test_skip_marks_settle(spark):
    files = spark.createDataFrame([("a/manifest.json", "h"), ("b/Manifest.JSON", "h"), ("b/x.md", "h")], "path string, sha256 string")
    none = spark.createDataFrame([], "path string, status string, error_code string, error_detail string")
    first = lifecycle.skipped_by_name(files, none, ["MANIFEST.json"])
    assert {r.path for r in first.collect()} == {"a/manifest.json", "b/Manifest.JSON"}
    assert lifecycle.skipped_by_name(files, first.drop("sha256"), ["manifest.json"]).count() == 0


def test_near_misses(spark):
    pool = spark.createDataFrame([("AC-001",), ("AC-0012",), ("AC-B-1",), ("ZZ-AC-001",), ("QQ-1",), (None,)], "code string")
    asked = spark.createDataFrame([("AC-001", "AC"), ("NO-1", None)], "code string, company_code string")
    got = {r.code: (r.same_first_segment, r.same_company_code, r.shares_a_subtoken) for r in runs.near_misses(asked, pool).collect()}
    assert got == {"AC-001": (2, 2, 2), "NO-1": (0, 0, 0)}


def test_answer_problems(spark):
    sources = spark.createDataFrame([("s.md", "The  Alpha code is AB-1.")], "name string, text string")
    questions = spark.createDataFrame([("ab01", "d/s.md"), ("ab02", "d/s.md"), ("ab03", "d/s.md")], "id string, source_doc string")
    rows = [("ab01", "d/s.md", "the alpha code", ["alpha"], 0, 15), ("ab02", "s.md", "beta", ["gamma"], 5, 99), ("ab09", "gone.md", "x", ["x"], 0, 1)]
    answers = spark.createDataFrame(rows, "id string, source_doc string, evidence string, key_phrases array<string>, start int, end int")
    got = {}
    for r in runs.answer_problems(answers, questions, sources).collect():
        got.setdefault(r.id, set()).add(r.problem)
    assert got == {"ab02": {"source_differs", "evidence_not_in_source", "phrase_not_in_evidence", "span_past_end"}, "ab03": {"no_answer"}, "ab09": {"no_question", "source_missing"}}


def test_merge_answers(spark):
    q = spark.createDataFrame([("a", "old"), ("b", "kept")], "id string, evidence string")
    a = spark.createDataFrame([("a", "new", "easy")], "id string, evidence string, difficulty string")
    assert {(r.id, r.evidence, r.difficulty) for r in runs.merge_answers(q, a, ["evidence", "difficulty"]).collect()} == {("a", "new", "easy"), ("b", "kept", None)}


def test_unanswerable_and_improvement(spark):
    df = spark.createDataFrame([(None, ["a"], ["a", "b"]), ("It is Not Mentioned.", ["a", "b"], ["a"]), ("42", ["a"], None)], "e string, base array<string>, graph array<string>")
    got = df.select(runs.is_unanswerable(F.col("e")).alias("u"), runs.improves(F.col("base"), F.col("graph")).alias("i")).collect()
    assert [(r.u, r.i) for r in got] == [(True, True), (True, False), (False, False)]


def test_recursive_chunks(spark):
    text = "one two three. four five six. seven eight\n\nnine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, "a b c d e f g")], "doc_id int, text string")
    got = [(r.doc_id, r.body) for r in chunking.recursive_chunks(docs, 5).orderBy("doc_id", "chunk").collect()]
    assert got[:4] == [(1, "one two three. "), (1, "four five six. seven eight\n"), (1, "nine ten eleven twelve thirteen "), (1, "fourteen")]
    # separators are tried down to single blanks, so pieces of one word are packed
    assert got[4:] == [(4, "a b c d e "), (4, "f g")]
    over = [r.body for r in chunking.recursive_chunks(docs.where("doc_id = 4"), 3, 1).orderBy("chunk").collect()]
    assert over == ["a b c ", "c d e ", "e f g"]


def test_unanswerable_answers(spark):
    sources = spark.createDataFrame([("s.md", "The Alpha code is AB-1."), ("t.md", "Other words, zeta.")], "name string, text string")
    questions = spark.createDataFrame([(f"ab0{i}", "s.md") for i in range(1, 6)], "id string, source_doc string")
    rows = [
        ("ab01", "s.md", None, None, None, None, "near-miss", "no such phrase", "It is not in the documents.", ["beta gamma", "delta"], "easy"), ("ab02", "s.md", "x", None, None, None, "unanswerable", "alpha  CODE", "unknown", ["ZETA", " ", "eta"], "odd"),
        ("ab03", "s.md", "alpha code", ["alpha"], 4, 14, "fact", None, "AB-1", None, "hard"), ("ab04", "s.md", "alpha code", ["alpha"], 4, 14, "fact", None, None, None, None), ("ab05", "s.md", " ", None, None, None, "near-miss", None, "not in the documents", [], "easy"),
    ]
    answers = spark.createDataFrame(rows, "id string, source_doc string, evidence string, key_phrases array<string>, start int, end int, shape string, distinctive_phrase string, expected_answer string, absent_terms array<string>, difficulty string")
    got = {}
    for r in runs.answer_problems(answers, questions, sources).collect():
        got.setdefault(r.id, set()).add(r.problem)
    zeta, eta = (hashlib.sha256(t).hexdigest()[:8] for t in (b"zeta", b"eta"))  # eta stands inside zeta
    assert got == {
        "ab02": {"evidence_of_unanswerable", "expected_answer_unsaid", "distinctive_phrase_in_source", "absent_term_blank", f"absent_term_in_source #1 {zeta}", f"absent_term_in_source #3 {eta}", "difficulty_unknown"},
        "ab04": {"expected_answer_missing", "expected_answer_blank", "difficulty_missing"}, "ab05": {"distinctive_phrase_missing"},
    }


def test_question_files_hold_no_answers(spark):
    rows = [("ab01", "q", "s.md", "follow-up", "fact", None, [], "", None), ("ab02", "q", "s.md", "single-fact", "fact", None, ["h"], "x", "y"), ("ab03", "q", "s.md", "follow-up", "fact", None, ["h"], " ", "")]
    q = spark.createDataFrame(rows, "id string, question string, source_doc string, type string, shape string, absent_terms array<string>, history array<string>, evidence string, expected_answer string")
    got = {(r.id, r.problem) for r in runs.question_problems(q, spark.createDataFrame([("s.md",)], "name string")).collect()}
    assert got == {("ab01", "history_missing"), ("ab02", "history_unasked"), ("ab02", "evidence_given"), ("ab02", "expected_answer_given")}


def test_separation(spark):
    probes = spark.createDataFrame([(1, "scoped", "A-1"), (2, "scoped", "B-2"), (3, "unanswerable", "Z-9"), (4, "unanswerable", "Y-8")], "probe int, shape string, code string")
    ranked = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.5), (2, 11, 1, 0.4), (2, 12, 3, 0.1), (3, 10, 1, 0.3)], "probe int, chunk int, rank int, score double")
    codes = spark.createDataFrame([(10, "A-1"), (10, "C-3"), (12, "B-2"), (11, "C-3")], "chunk int, code string")
    got = {r["shape"]: r.asDict() for r in runs.separation(probes, ranked, codes, 2).collect()}
    assert got["scoped"] == {"shape": "scoped", "probes": 2, "code_in_top_k": 1, "lookalikes_min": 1, "lookalikes_max": 1, "best_min": 0.4, "best_median": 0.9, "best_max": 0.9, "rank_min": 1, "rank_max": 3, "with_code_chunk": 2}
    assert got["unanswerable"] == {"shape": "unanswerable", "probes": 2, "code_in_top_k": 0, "lookalikes_min": 0, "lookalikes_max": 2, "best_min": 0.0, "best_median": 0.3, "best_max": 0.3, "rank_min": None, "rank_max": None, "with_code_chunk": 0}


def test_request_reindex(spark):
    rows = [(1, "a", "failed", "accept", "c", None, False, "t", 2, '{"worker": {"x": 1, "reindex_force": true}, "k": "v"}'), (2, "b", "ingested", "accept", "c", "e", True, "t", 0, None), (3, "d", "failed", "reject", "other", None, False, None, 0, None), (4, "e", "pending", "accept", "c", None, False, None, 0, "old note")]
    df = spark.createDataFrame([(*r, "upload") for r in rows], "document_id int, path string, status string, validation_state string, company string, error_code string, query_ready boolean, track_id string, retry_count int, warnings_json string, source_type string")
    got = {r.document_id: r for r in lifecycle.request_reindex(df, company="c").collect()}
    assert set(got) == {1, 2, 4} and got[2].message == lifecycle.BLOCKED["ingested"] and got[2].warnings_json is None and got[2].error_stage is None and got[1].message is None
    assert (got[1].status, got[1].error_stage, got[1].error_code, got[1].track_id, got[1].retry_count) == ("pending", "reindex", "reindex_requested", None, 0) and json.loads(got[1].error_detail) == {"force": False, "scope": {"company": "c"}}
    asked = {"requested_from_status": "failed", "requested_from_validation_state": "accept"}
    assert json.loads(got[1].warnings_json) == {"k": "v", "worker": {"x": 1, "reindex_requested": True, "reindex_force": False, **asked}, "reindex": {"force": False, "scope": {"company": "c"}, **asked}}
    assert json.loads(got[4].warnings_json)["legacy_warning"] == "old note"
    marked = lifecycle.request_reindex(df, True, document_id=2).withColumn("m", lifecycle.reindex_requested(df)).first()
    assert marked.m and marked.outcome == "queued"
    for bad in ({}, {"nothing": 1}, {"company": None}):
        with pytest.raises(ValueError):
            lifecycle.request_reindex(df, **bad)


@pytest.mark.parametrize(
    ("text", "source", "reason", "kept"),
    [
        ("What of the Acme site?", "rewritten", None, "What of the Acme site?"), ("  WHAT of it? ", "unchanged", None, "WHAT of it?"), ("<think>hm</think>\n“What of Acme?”", "rewritten", None, "What of Acme?"), ("<think>hm", "rejected", "reasoning_markers", None),
        ("```text\nRewritten question: What now?\n```", "rewritten", None, "What now?"), (" '' ", "rejected", "empty", None), (None, "rejected", "empty", None), ("a\nb", "rejected", "multi_line", None), ("x" * 601, "rejected", "too_long", None), ("y" * 260, "rejected", "too_long", None),
        ("Sure, it is here", "rejected", "answer_like", None), ("See **Sources** there", "rejected", "sources_marker", None), ('{"a": [{"function": 1}]}', "rejected", "tool_call_shape", None), ("[tool_call: x", "rejected", "tool_call_shape", None), ('{"a": 1}', "rewritten", None, '{"a": 1}'), ("It  IS so", "rejected", "identical_to_last_assistant", None),
    ],
)
def test_checked_rewrite(spark, text, source, reason, kept):
    df = spark.createDataFrame([("What of it?", text, "it is so")], "q string, t string, a string")
    r = df.select(evaluation.checked_rewrite(F.col("q"), F.col("t"), F.col("a")).alias("r")).first().r
    assert (r.source, r.reason, r.text) == (source, reason, kept or "What of it?")


def test_canned(spark):
    df = spark.createDataFrame([(evaluation.NO_CONTEXT,), (f"x {evaluation.NO_CONTEXT} y",), ("Sorry",), (None,)], "a string")
    assert [r[0] for r in df.select(evaluation.is_canned(F.col("a"))).collect()] == [True, True, False, False]
