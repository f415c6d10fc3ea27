"""Structure chunks: line kinds, furniture, section paths, tables, windows, coverage, headers and delimiters."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veldspar.operators import structure as S

FOOT = ["", "Acme Corp confidential", "Page 3", ""]
REPORT = "\n".join([
    "# Title", "Intro line one.", "And two.", *FOOT, "## 1 Scope", "(Ana) Got it", "(Ana) Got it", "(Ana) Got it", "", "- item one", "  more of it", "- item two", *FOOT, "## Data", "Table 1: Freight", "| Name | Cost |", "|------|------|",
    *[f"| row{i} | {i * 10} and some words to fill |" for i in range(12)], *FOOT, "", "FREIGHT COSTS", " ".join(f"Sentence number {i} says a thing." for i in range(30)), "", "3. Approval", "last words 12",
])


def over(text):
    return max(-(-len(text) * 10 // 36), len(text.split()), 1)


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        ("FREIGHT COSTS", "heading"), ("FREIGHT COSTS ARE RISING.", "text"), ("## Part", "heading"), ("| a | b |", "table"), ("| A | B |", "table"), ("|---|---|", "separator"), ("--- ---", "separator"), ("- item", "bullet"), ("(2) item", "bullet"), ("Page 3", "page_mark"), ("iv", "page_mark"),
        (" \t", "blank"), ("1.2 Scope", "heading"), ("3. Approval", "heading"), ("3. approval of it", "bullet"), ("12 months ago we signed it", "text"), ("2019  1240  3300", "table"), ("a\tb", "table"), ("Table 2: x", "caption"), ("Exhibit iv. y", "caption"), ("plain words", "text"), ("1.2 Scope ends here.", "text"),
    ],
)
def test_kind(spark, line, kind):
    assert spark.createDataFrame([(line,)], "l string").select(S.kind(F.col("l"))).first()[0] == kind


def test_furniture(spark):
    df = spark.createDataFrame([(1, REPORT), (2, "Note\nNote\nsome text"), (3, "It ends.\nIt ends.\nIt ends.\n- a\n- a\n- a\n\tb c\n\tb c\n\tb c\nname  of\nNAME of\nname of")], "doc_id int, text string")
    assert {(r.doc, r.key, r.n, r.page_marks) for r in S.furniture(S.lines(df)).collect()} == {(1, "acme corp confidential", 3, 0), (1, "page 3", 3, 3), (3, "name of", 3, 0)}


def test_section_paths(spark):
    text = "x\n# A\na\n### C\nc\n## B\nb\n# D\nd\n1.1 Edge\ne"
    df = S.sections(S.lines(spark.createDataFrame([(1, text)], "doc_id int, text string")))
    got = {r.line: [p.title for p in r.path] for r in df.collect()}
    assert [got[x] for x in ("x", "a", "c", "b", "d", "e")] == [[], ["A"], ["A", "C"], ["A", "B"], ["D"], ["D", "Edge"]]


def test_blocks(spark):
    text = "para one\npara two\nFig. 2: cap\n| a | b |\n| c | d |\nTable 1. below\n\n- x\n  y  z\n- w\nlone  columns  here\nafter\n\n|x|y|"
    got = [(r.block, r.form, r.line) for r in S.blocks(S.sections(S.lines(spark.createDataFrame([(1, text)], "doc_id int, text string")))).orderBy("pos").collect()]
    assert [(f, x) for _, f, x in got] == [("para", "para one"), ("para", "para two"), ("table", "Fig. 2: cap"), ("table", "| a | b |"), ("table", "| c | d |"), ("table", "Table 1. below"), ("list", "- x"), ("list", "  y  z"), ("list", "- w"), ("para", "lone  columns  here"), ("para", "after"), ("para", "|x|y|")]
    assert len({b for b, _, _ in got}) == 6


def cut(spark, texts, window, floor):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in S.pieces(df, window, floor).collect():
        got.setdefault(r.doc, []).append(r)
    return {d: sorted(v, key=lambda r: r.part) for d, v in got.items()}


def test_report(spark):
    got = cut(spark, [REPORT, None, " \n", "one line"], 60, 15)
    assert set(got) == {0, 3} and [r.body for r in got[3]] == ["one line"]
    assert all(r.tokens == over(r.body) <= 60 and r.parts == len(got[0]) for r in got[0]) and [r.part for r in got[0]] == list(range(1, len(got[0]) + 1))
    tables = [r.body for r in got[0] if "| row" in r.body]
    assert len(tables) > 2 and all("| Name | Cost |\n|------|------|" in b for b in tables) and sum("Table 1: Freight" in b for b in tables) == 1
    assert "## Data\nTable 1: Freight\n| Name | Cost |" in tables[0]
    assert not any("confidential" in r.body or "Page 3" in r.body for r in got[0]) and sum(r.body.count("Got it") for r in got[0]) == 3
    prose = [r for r in got[0] if "Sentence number" in r.body]
    assert all(r.body.endswith("thing.") or "Approval" in r.body for r in prose) and len({len(r.body) // 60 for r in prose[:-1]}) == 1  # pieces of like size
    assert all(r.tokens >= 15 for r in got[0][:-1]) and got[0][-1].section == ["Approval"]


def test_whole_documents_stay_whole(spark):
    got = cut(spark, [REPORT], 7500, 150)[0]
    assert len(got) == 2 and got[0].body.startswith("# Title\nIntro line one.\nAnd two.\n## 1 Scope") and got[1].body.startswith("FREIGHT COSTS\n") and got[1].body.endswith("3. Approval\nlast words 12")


def words(text):
    return Counter(w for w in text.split() if any(c.isalnum() for c in w))


def random_text(rng):
    out = []
    for _ in range(rng.randint(0, 40)):
        n = rng.randint(1, 30)
        some = " ".join(rng.choice(["alpha", "be", "Gamma.", "delta,", "eps!", "z9"]) + str(rng.randint(0, 99)) * rng.randint(0, 1) for _ in range(n))
        kind = rng.randrange(9)
        if kind == 0:
            out.append("#" * rng.randint(1, 4) + " Head " + str(rng.randint(0, 99)))
        elif kind == 1:
            out += ["| k | v |", "|---|---|"][: rng.randint(0, 2)] + [f"| r{i} | {some} | {rng.randint(0, 9)} |" for i in range(rng.randint(1, 6))]
        elif kind == 2:
            out += [f"- {some}", "  " + some]
        elif kind == 3:
            out += ["a\tb\tc", f"x\t{some}\t7"]
        elif kind == 4:
            out.append("")
        elif kind == 5:
            out.append(f"Table {rng.randint(1, 9)}: {some}")
        else:
            out.append(some)
    return "\n".join(out)


@pytest.mark.parametrize(("window", "floor"), [(40, 0), (64, 20), (200, 60)])
def test_no_word_is_lost(spark, window, floor):
    rng = random.Random(window)
    texts = [random_text(rng) for _ in range(40)]
    got = cut(spark, texts, window, floor)
    for i, t in enumerate(texts):
        have = words("\n".join(r.body for r in got.get(i, [])))
        lost = words(t) - have
        gone = Counter(x.strip().lower() for x in t.split("\n"))
        assert all(any(w in line.split() for line, n in gone.items() if n >= 3 for w in [w.lower()]) for w in lost), (i, lost)
        assert all(r.tokens <= window for r in got.get(i, []))


def test_headers(spark):
    df = spark.createDataFrame([(1, 1, 2, ["A long section title", "Deeper still in it"]), (1, 2, 2, []), (2, 1, 1, ["x"])], "doc int, part bigint, parts bigint, section array<string>")
    titles = spark.createDataFrame([(1, "A title of words", "2024-01-02")], "doc int, title string, date string")
    head = lambda most, **k: {(r.doc, r.part): r.header for r in S.with_headers(df, titles, most, **k).collect()}
    whole = "[Doc: A title of words | Date: 2024-01-02 | Section: A long section title / Deeper still in it | Part 1/2]"
    assert head(99)[1, 1] == whole and head(99)[1, 2] == "[Doc: A title of words | Date: 2024-01-02 | Part 2/2]" and head(99)[2, 1] == "[Section: x | Part 1/1]"
    assert head(26)[1, 1] == whole.replace(" / Deeper still in it", "") and head(16)[1, 1] == "[Doc: A title of words | Date: 2024-01-02 | Part 1/2]" and head(11)[1, 1] == "[Doc: A title of words | Part 1/2]" and head(1)[1, 1] == "[Part 1/2]"
    assert head(99, shuffled=True)[1, 2] == whole and head(99, shuffled=True)[2, 1] == "[Section: x | Part 1/1]"


def test_payloads(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (2, 1, "has <<<CHUNK-BREAK>>>"), (2, 2, "b"), (3, 1, "alone")] + [(4, i, d.strip()) for i, d in enumerate(S.DELIMITERS, 1)]
    got = {r.doc: (r.delimiter, r.payload) for r in S.payloads(spark.createDataFrame(rows, "doc int, part bigint, body string")).collect()}
    assert got[1] == (S.DELIMITERS[0], "a" + S.DELIMITERS[0] + "b") and got[2][0] == S.DELIMITERS[1] and got[3] == (None, "alone")
    assert got[4][0].startswith("\n\n<<<CHUNK-BREAK-") and got[4][0] not in S.DELIMITERS and len(got[4][1].split(got[4][0])) == len(S.DELIMITERS)


def plain_rows(text):
    """Wrapped rows told with two loops."""
    import re

    def tabular(x):
        t = x.strip()
        return bool(t) and len(t) <= 600 and (t[0] in "|│" or len(t.split()) > 1 and bool(re.search(r"\S[ \t]{2,}\S", t) or len(re.findall(r"(?<![\w.])[-+−]?\d[\d,\u00a0.]*%?(?![\w])", t)) > 1))

    indent = lambda x: len(x.replace("\t", "    ")) - len(x.replace("\t", "    ").lstrip(" "))
    out, block = [], []

    def close():
        rows = []
        for x in block:
            if rows and indent(x) > min(map(indent, block)):
                rows[-1] += "  " + x.strip()
            else:
                rows.append(x.strip())
        out.extend(rows)
        block.clear()

    for x in text.split("\n"):
        if block and x.strip() and (tabular(x) or indent(x) > indent(block[0])):
            block.append(x)
            continue
        close()
        if tabular(x):
            block.append(x)
        else:
            out.append(x.rstrip())
    close()
    return "\n".join(out)


def test_wrapped_rows(spark):
    rng = random.Random(8)
    line = lambda: " " * rng.randint(0, 5) + rng.choice(["a  b", "word", "1 2", "", "| x", "one two", "7% of 3.5", "\tx  y", "end "])
    texts = ["\n".join(line() for _ in range(rng.randint(0, 15))) for _ in range(80)] + ["Name   Value\n     more of it\nNext   Row", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc: r.text for r in S.wrapped_rows(df).collect()}
    assert got == {i: None if t is None else plain_rows(t) for i, t in enumerate(texts)}
