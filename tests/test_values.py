"""Queries that have no SQL: their values at sf0.001 against plain re-tellings."""

import html
import math
import posixpath
import re
from collections import Counter, defaultdict

import pytest

from tests.conftest import SMALL
from veldspar.plans import catalogue


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet").collect()


def run(spark, name):
    return catalogue.QUERIES[name](spark, SMALL).collect()


def over(text):
    return max(-(-len(text) * 10 // 36), len(text.split()), 1)


def words(text):
    return Counter(w for w in (text or "").split() if any(c.isalnum() for c in w))


def test_paired_bootstrap(spark, table):
    lang, label = {r.doc_id: r.lang for r in table("documents")}, table("labels")
    by = defaultdict(list)
    for r in label:
        by[lang[r.doc_id]].append(r.quality - r.toxic)
    got = {r.lang: r for r in run(spark, "paired_bootstrap")}
    assert {k: (r.n, r.difference) for k, r in got.items()} == {k: (len(v), round(sum(v) / len(v), 4)) for k, v in by.items()}
    assert all(r.low <= r.difference <= r.high and r.resolved == (r.low > 0 or r.high < 0) for r in got.values())
    for k, r in got.items():  # near the normal interval
        sd = math.sqrt(sum((x - r.difference) ** 2 for x in by[k])) / len(by[k])
        assert abs(r.low - (r.difference - 1.96 * sd)) < 0.12 + sd and abs(r.high - (r.difference + 1.96 * sd)) < 0.12 + sd


def test_paths(spark, table):
    pages = {r.page_id: r for r in table("pages")}
    got = run(spark, "paths")
    assert len(got) == len(pages)
    for r in got:
        raw = "Root\\a/./B/../" + re.sub(r"^https?://", "", pages[r.page_id].url)
        assert r.path == posixpath.normpath(raw.lower()) and r.name == re.split(r"[/\\]", raw.rstrip("/\\"))[-1]
        assert r.slug == re.sub("[^a-z0-9]+", "-", raw.lower()).strip("-")


def test_sanitize(spark, table):
    pages = {r.page_id: r.html for r in table("pages")}
    for r in run(spark, "sanitize"):
        plain = "".join(c for c in html.unescape(pages[r.page_id].strip()) if c in "\t\n\r" or c >= " " and c != "\x7f")
        assert words(r.text) == words(plain) and "&amp;" not in r.text.replace("&amp;amp;", "")


def test_anonymize(spark, table):
    texts = {r.doc_id: r.text for r in table("documents")}
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
    seen = {}
    for r in run(spark, "anonymize"):
        assert not mail.search(r.text)
        found = mail.findall(texts[r.doc_id])
        masks = re.findall(r"EMAIL_[0-9A-F]{4}", r.text)
        assert len(masks) == len(found)
        for value, mask in zip(found, masks, strict=True):
            assert seen.setdefault(value, mask) == mask
        if not re.search(r"[0-9@]|[A-Z]\w+ [A-Z]\w+ [A-Z]\w+", texts[r.doc_id]):
            assert r.text == texts[r.doc_id]
    assert seen


def test_keyword_fallback(spark, table):
    texts = {(r.conv_id, r.turn): r.text for r in table("conversations")}
    got = run(spark, "keyword_fallback")
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.conv_id, r.turn] or ""
        high = [x for x in r.high.split("|") if x]
        assert len(high) <= 10 and len(set(high)) == len(high) and all(x in text.lower() for x in high) and all(w in text for x in r.low.split("|") for w in x.split())


def test_companies_detected(spark, table):
    texts = {(r.conv_id, r.turn): r.text for r in table("conversations")}
    for r in run(spark, "companies_detected"):
        key = f" {' '.join(re.sub('[^a-z0-9]+', ' ', (texts[r.conv_id, r.turn] or '').lower()).split())} "
        found = []
        for name in ("and the", "src1", "src11", "the"):
            if f" {name} " in key:
                found.append(name)
                key = key.replace(f" {name} ", " " + "_" * len(name) + " ")
        assert set(filter(None, r.companies.split(","))) <= {"and the", "src1", "src11", "the"} and ("and the" in found) == ("and the" in r.companies.split(","))


@pytest.mark.parametrize(("name", "most"), [("structure_chunks", 500), ("document_pieces", 400)])
def test_chunks_keep_all_words(spark, table, name, most):
    got = defaultdict(list)
    for r in run(spark, name):
        got[r[0]].append(r)
    for r in table("documents"):
        own = sorted(got.get(r.doc_id, []), key=lambda x: x.part)
        lines = Counter(" ".join(x.split()).lower() for x in r.text.split("\n"))
        often = sum((words(x) for x in r.text.split("\n") if lines[" ".join(x.split()).lower()] >= 3), Counter())
        assert not (words(r.text) - often if name == "document_pieces" else words(r.text)) - words("\n".join(x.body for x in own))
        assert {x.parts for x in own} <= {len(own)} and all(over(x.body) <= most or len(x.body.split()) == 1 for x in own)


def test_recursive_chunks(spark, table):
    got = defaultdict(list)
    for r in run(spark, "recursive_chunks"):
        got[r.doc_id].append((r.chunk, r.body))
    for r in table("documents"):
        own = [b for _, b in sorted(got.get(r.doc_id, []))]
        assert all(b.strip() in r.text or " ".join(b.split()) in " ".join(r.text.split()) for b in own) and not words(r.text) - words("\n".join(own))


def test_transcript_prep(spark, table):
    turns = defaultdict(list)
    for r in sorted(table("conversations"), key=lambda r: (r.conv_id, r.turn)):
        turns[r.conv_id].append(r)
    got = {r.conv_id: r for r in run(spark, "transcript_prep")}
    assert set(got) == set(turns)
    for i, own in turns.items():
        names = [r.role.title() for r in own if r.text and re.match(r"\S", r.text.replace("\n", " ").lstrip())]
        is_one = len(names) >= 3 and 2 <= len(set(names)) <= len(names) // 2 + 1
        runs = 1 + sum(a != b for a, b in zip(names, names[1:], strict=False)) if names else 0
        assert (got[i].is_transcript, got[i].n_turns) == (is_one, runs if is_one else 0)


def test_topic_segments(spark):
    depth = defaultdict(list)
    for r in sorted(run(spark, "texttiling_depth"), key=lambda r: r.vec_id):
        depth[r.run].append(r.depth)
    cuts = {}
    for k, d in depth.items():
        taken = set()
        for i in sorted(range(len(d)), key=lambda i: (-d[i], i)):
            if d[i] >= 0.3 and not taken & {i - 1, i + 1}:
                taken.add(i)
        cuts[k] = len(taken - {len(d) - 1})  # a cut behind the last row opens nothing
    assert {r.run: r.cuts for r in run(spark, "topic_segments")} == cuts


def test_second_judge_sample(spark, table):
    got = {r.lang: (r.sampled, r.n) for r in run(spark, "second_judge_sample")}
    assert {k: n for k, (_, n) in got.items()} == Counter(r.lang for r in table("documents"))
    assert 0.1 < sum(s for s, _ in got.values()) / sum(n for _, n in got.values()) < 0.3
    assert got == {r.lang: (r.sampled, r.n) for r in run(spark, "second_judge_sample")}


def test_report_pieces(spark):
    rows = run(spark, "report_pieces")
    assert all(r.tokens == over(r.body) <= 60 and over(r.header) <= 25 for r in rows)
    assert all("| Key | Price |\n|-----|-------|" in r.body for r in rows if "| first |" in r.body or "| second |" in r.body)
    by = defaultdict(list)
    for r in rows:
        by[r.doc].append(r.part)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in by.values())


def test_piece_payloads(spark, table):
    parts = Counter(r.doc for r in run(spark, "document_pieces"))
    for r in run(spark, "piece_payloads"):
        assert r.delimiter == (None if r.texts == 1 else "<<<CHUNK-BREAK-HERE>>>" if r.doc % 9 == 0 else "<<<CHUNK-BREAK>>>")
        assert r.texts == parts[r.doc] or r.doc % 9 == 0


def test_name_candidates(spark, table):
    texts = {(r.conv_id, r.turn): r.text or "" for r in table("conversations")}
    for r in run(spark, "name_candidates"):
        found = [x for x in r.candidates.split("|") if x]
        whole = " ".join(f"about {texts[r.conv_id, r.turn][:40].title()} then {texts[r.conv_id, r.turn]}".split()).lower()
        assert len(found) <= 10 and len(set(found)) == len(found) and all(len(x.split()) <= 3 and len(x) <= 40 and x.lower() in whole for x in found)
