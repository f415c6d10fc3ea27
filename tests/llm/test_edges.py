"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from veldspar.llm import ann, decontaminate, html_text, line_dedup, mixing, quality, sharding, simhash, toxicity, url_reputation
from veldspar.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, h int, y int, root int, bucket int, w int, size int, shard int, _x int, _gone int, _key string, _doc string, _quality_x string, row int, x int, doc int, key int, gone int"
MORE = (1, "k", "d", "q", 1, 1, 1, 1, 1)
LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(30_000))
TEXTS = [None, "", "   \n\t ", "one", "The same text as another, for all to see.\nA line that is shared by documents.", "The same text as another, for all to see.\nA line that is shared by documents.", LONG, "日本語 テキスト \U0001f600 ñandú", "a\x00b \ud7ff", "YOU SPAM!! YOU SPAM!! YOU SPAM!!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "b", "a"][i % 3], 0, "f", 1, 1, 1, 1, 1, 1, 1, 1, *MORE) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id", *[None] * 21), (None,) * 23]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i != 9), int(i == 9)) for i in range(10)] + [(3, 1, 0), (None, 1, 1), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_toxicity(docs, empty, labels):
    got = toxicity.rate(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity.rate(empty, labels).count() == 0
    assert toxicity.rate(docs, labels.limit(0)).count() == docs.count()


def test_quality(docs, empty, labels):
    got = quality.rate(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality.rate(empty, labels).count() == 0 and quality.rate(docs, labels.limit(0)).count() == docs.count()
    assert quality.keep(docs, labels).columns == docs.columns and {r._quality_x for r in quality.keep(docs, labels.limit(0)).collect()} == {"q", None}


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].component_id == 4 and by[0].fp == 0 and by[1].component_id == by[2].component_id == 0
    assert simhash.near_duplicates(empty).count() == 0


def test_lines(docs, empty):
    got = line_dedup.dedup(docs).collect()
    assert len(got) == docs.count() and line_dedup.dedup(docs).columns == [*docs.columns, "n_lines", "n_removed"]
    assert {r._key for r in got} == {"k", None} and {r._doc for r in got} == {"d", None} and {r._gone for r in got} == {1, None}
    gone = {r.doc_id: r.n_removed for r in got if r.doc_id in (4, 5)}
    assert gone == {4: 0, 5: 2}
    assert next(r for r in got if r.doc_id == 5).text == "" and next(r for r in got if r.doc_id == 0).text is None
    assert line_dedup.dedup(empty).count() == 0


def test_leaks(spark, docs, empty):
    items = spark.createDataFrame([(1, "all to see a line that is shared"), (2, None), (3, ""), (4, "one"), (4, "one"), (5, "no such thing here at all")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(4, 1), (5, 1), (3, 4)}
    assert decontaminate.leaks(empty, items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items, slice_=2).collect()} == got


def test_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (None, None, "<p>" + "long enough text to be kept as content, surely so. " * 3), (4, "u", "<div" * 3000), (4, "u", "<p>x" * 5000), (5, "u", "<article><p>a&nbsp; b&#33;\n c</p>t</article>")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = {(r.page_id, r.n_chars, r.text[:12]) for r in html_text.extract(df).collect()}
    assert (1, 0, "") in got and (2, 0, "") in got and (5, 8, "a b! c\nt") in got
    assert html_text.extract(df).count() == len(rows) and html_text.extract(df.limit(0)).count() == 0


def test_sharding(docs, empty):
    placed = sharding.reshard(docs, 5, F.coalesce(F.pmod("doc_id", F.lit(3)), F.lit(0)), 3)
    got = placed.collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {r.text_crc32 for r in got if r.doc_id == 0} == {0} and {r.text_crc32 for r in got if r.doc_id == 3} == {zlib.crc32(b"one")}
    whole = sharding.attach(docs.drop("shard"), placed)
    clash = sharding.attach(docs.drop("shard").withColumns({"Shard": F.lit("x"), "slot": F.lit(-1)}), placed)
    assert clash.count() == docs.count() and sorted(clash.columns) == sorted(whole.columns)
    assert sorted((r.shard, r.slot) for r in clash.collect()) == sorted((r.shard, r.slot) for r in got)
    assert sharding.reshard(empty, 5, F.lit(0), 1).count() == 0


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(60, None), (61, []), (62, [0.0, 0.0, 0.0]), (63, [1.0, nan, 1.0]), (64, [1.0, inf, 1.0]), (65, [1.0, None, 2.0]), (66, [1.0, 2.0]), (None, [1.0, 2.0, 3.0]), (7, [0.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id bigint, embedding array<double>, v int, ids int")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect()
    kept = {i: v for i, v in rows[:60]}
    for q in (0, 20, 40):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        best = sorted((-sum(a * b for a, b in zip(kept[q], v, strict=True)), i) for i, v in kept.items() if i != q)[:20]
        assert [(-r.score, r.vec_id) for r in own] == best
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert {(r.query_id, r.vec_id) for r in ann.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()} == {(0, 1), (0, 2)}


def test_mix(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in got)
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= max(2, 0.01 * target[s]) for s in taken)
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs.where("text is null")).count() == 2


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://WWW.Example.com/en/1"), (4, "x://a.example.com/en/"), (5, "http://example.net/es/2?q"), (6, "http://example.org"), (6, "http://example.org"), (7, "http://com#x"), (8, "http://notexample.com/en/"), (9, "a://b://c/d")]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id bigint, url string, host string, path int")
    none = spark.createDataFrame([], "host string, g bigint, n bigint")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge(pages, none).collect()}
    assert got[1][:3] == ("", "", None) and got[2][:3] == ("", "", None)
    assert got[3] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and got[4][2:] == ("example.com/en/", "block")
    assert got[5][1:] == ("/es/2", "net/es/", "block") and got[7][:3] == ("com", "", None) and got[8][2] == "com/" and got[9][:2] == ("b:", "//c/d")
    assert url_reputation.judge(pages, none).count() == len(rows) and url_reputation.judge(pages.limit(0), none).count() == 0


def test_stages(spark, docs, empty):
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for _, stage in corpus_pipeline.STAGES:
        for table in (docs.select(plain), empty.select(plain)):
            out = stage(spark, table, SMALL)
            assert out.columns[:5] == plain
            out.count()


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1001), (None, 5), (2000, 2001), (2001, 2000)] + [(5000, 5001 + i) for i in range(200)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000, 2000: 2000, 2001: 2000, **dict.fromkeys(range(5000, 5201), 5000)}


def test_near_dedup_keeps_other_texts(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta"))
    near = a.replace("alpha59", "changed")
    rows = [(1, a), (2, a), (2, b), (3, near), (4, b), (4, b), (None, a), (5, None), (6, "short")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int")
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, SMALL).where("doc_id < 5").collect())
    assert kept == [(1, a), (2, b)]
    assert corpus_pipeline.near_dedup(spark, df, SMALL).where("doc_id is null or doc_id >= 5").count() == 2
