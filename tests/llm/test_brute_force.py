"""Operators against brute force on small fixtures, and against the given tables."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SMALL
from veldspar.llm import ann, decontaminate, hamming, html_text, line_dedup, mixing, near_copies, sharding, simhash, toxicity
from veldspar.llm.common import table
from veldspar.llm.components import components
from veldspar.llm.queries import ORACLE, QUERIES


def roots(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("radius", [0, 1, 3, 4])
def test_masks_lose_no_pair(radius):
    rng = random.Random(radius)
    for masks in (hamming.covering_masks(radius), hamming.block_masks(radius)):
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
            assert any(diff & m == 0 for m in masks)


@pytest.mark.parametrize("cap", [3, 8192])
def test_links_have_all_components(spark, cap):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6))) & hamming.FULL for b in base for _ in range(25)})
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    df = spark.createDataFrame([(hamming.signed(x),) for x in fps], "fp bigint")
    found = hamming.links(df, 4, hamming.covering_masks(4), cap)
    at = {hamming.signed(x): i for i, x in enumerate(fps)}
    got = [(at[r.a], at[r.b]) for r in found.collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in got)
    assert roots(len(fps), got) == roots(len(fps), near)


def test_simhash_on_the_table(spark):
    rows = table(spark, SMALL, "documents").select("doc_id", "text").collect()

    def fp(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", low) if x]
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    ids, fps = [r.doc_id for r in rows], [fp(r.text) for r in rows]
    top = roots(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    low = {}
    for i, t in zip(ids, top, strict=True):
        low[t] = min(low.get(t, i), i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash_neardup"](spark, SMALL).collect()}
    assert got == {i: (f"{f:016x}", low[t]) for i, f, t in zip(ids, fps, top, strict=True)}


def test_shingle_sets_are_those_of_the_words():
    texts = [None, "", " ", "a", "a b", "B a", "a b c d e", "a b c d e f", "A B c  d\te", "e d c b a", "a a a a a a a", "a b c d", "b c d e"] + [" ".join(f"w{(i * i) % 7}" for i in range(k)) for k in range(3, 40)]
    words = [(t or "").lower().split() for t in texts]
    plain = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in words]
    sets = near_copies.shingle_sets(near_copies.word_hashes(texts, near_copies._Hashes()), 5)
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for a, p in zip(sets, plain, strict=True):
        assert [len(np.intersect1d(a, b)) for b in sets] == [len(p & q) for q in plain]
    for t, s in zip(texts, sets, strict=True):
        assert near_copies.shingle_set(t, 5).tolist() == s.tolist()


def test_near_copies(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(8):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 6, 30):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(150)] = "edit"
            texts.append(" ".join(copy))
    sets = [set(near_copies.shingle_set(t, 5).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for block in (2, 128):
        near_copies.BLOCK = block
        got = [r.component_id for r in near_copies.near_copies(df).orderBy("doc_id").collect()]
        assert got == roots(len(texts), pairs)
    near_copies.BLOCK = 128


def test_similar_one_by_one():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4, 5], [1, 2, 3, 4], [9], [])]
    whole = near_copies.similar(sets, 0.8)
    near_copies.CELLS, kept = 0, near_copies.CELLS
    assert (near_copies.similar(sets, 0.8) | np.eye(4, dtype=bool) == whole | np.eye(4, dtype=bool)).all()
    near_copies.CELLS = kept
    assert whole[0, 1] and not whole[0, 2]


def test_edit_similarity():
    rng = random.Random(2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert line_dedup.edit_similarity(a, b) == pytest.approx(1 - distance(a, b) / max(len(a), len(b), 1))


def test_lines_keep_one_of_a_group(spark):
    line = "the quick brown fox number {} jumps over the lazy dog and runs away from here {}"
    docs = [(1, "own line of the first text\n" + line.format(1, "fast")), (2, line.format(22, "fast") + "\nanother line that stays here"), (3, line.format(3, "fasr")), (4, "a b c\na b c"), (5, "own line of the first text")]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[1] == docs[0][1] and got[4] == docs[3][1] and got[5] == ""
    assert got[2] == "another line that stays here"


def test_exact_repeats_of_long_passages_are_met(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randrange(900)}" for _ in range(60))
    docs = [(i, f"head {i} of text {rng.random()}\n{passage}\ntail {rng.random()} of it") for i in range(30)]
    got = line_dedup.dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sum(passage in r.text for r in got) == 1


def test_leaks_on_the_table(spark):
    import re

    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    docs = [(r.doc_id, plain(r.text)) for r in table(spark, SMALL, "documents").collect()]
    items = [(r.item_id, plain(r.text)) for r in table(spark, SMALL, "benchmark").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_benchmark_leaks"](spark, SMALL).collect()}
    assert got >= {(d, i) for d, t in docs for i, s in items if s in t}


def test_leaks_against_all_windows(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([12, 20, 33])))) for i in range(6)]
    docs = []
    for d in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if d % 2:
            part = rng.choice(items)[1].split()
            if d % 3 == 0:
                part[rng.choice([0, 1, -1])] = "changed"
            own[len(own) // 2 : len(own) // 2] = part
        docs.append((d, " ".join(own)))

    def grams(w):
        return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []

    df = {}
    for i, t in items:
        for g in set(grams(t.split())):
            df.setdefault(g, set()).add(i)
    expected = set()
    for d, text in docs:
        g = grams(text.split())
        for i, t in items:
            h = grams(t.split())
            for s in range(max(1, len(g) - len(h) + 1)):
                w = g[s : s + len(h)]
                both = set(w) | set(h)
                weight = {x: 1 / len(df.get(x, {0})) for x in both}
                low, high = (sum(weight[x] * f(w.count(x), h.count(x)) for x in both) for f in (min, max))
                if high and low / high >= 0.8:
                    expected.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got <= expected and len(got) >= 0.95 * len(expected)


def test_minimum_cut():
    import itertools

    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 8)
        cost = [rng.choice([-3, -1, -0.5, 0.5, 1, 3]) * rng.random() for _ in range(n)]
        edges = [(i, j, rng.random()) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6]
        value = lambda keep, c=cost, e=edges: sum(abs(x) for x, k in zip(c, keep, strict=True) if (x > 0) != k) + sum(w for i, j, w in e if keep[i] != keep[j])
        assert value(html_text.minimum_cut(cost, edges)) == pytest.approx(min(value(k) for k in itertools.product([False, True], repeat=n)))


def test_main_text():
    page = """<html><head><title>T</title><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies to improve everything that you see here, and many other things.</div>
    <div id="content"><h1>Title here</h1><p>First paragraph &amp; more, with a <a href=q>link</a> inside it and enough of text.<p>Short.</p><div class="ad-box"><p>Buy this now, the very best product there ever was in the whole world.</p></div></div>
    <section id="comments"><article class="comment"><p>Great article, I loved reading every single word of it, thank you so much!</p></article></section><footer>(c)</footer></body></html>"""
    assert html_text.main_text(page) == "Title here\nFirst paragraph & more, with a link inside it and enough of text.\nShort."


ARTICLE = "<h1>The title</h1><p>A text that goes on for a while, as it should.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f'<form id="aspnetForm"><div class="nav"><a href=x>Home</a></div><div>{ARTICLE}</div><div class="footer">(c)</div></form>',
        f'<nav>Menu</nav><div class="product-reviews"><article>{ARTICLE}</article></div>',
        f'<main><div class="search-results-page"><article>{ARTICLE}</article></div></main><aside>x</aside>',
        '<article><div class="entry-header"><h1>The title</h1></div><p>A text that goes on for a while, as it should.</p></article>',
        f'<article>{ARTICLE}</article><div class="newsletter"><form><p>Sign up now, it is free.</p></form></div>',
        f'<article>{ARTICLE}</article><section id="comments"><article><p>{"I loved reading every word of it. " * 9}</p></article></section>',
    ],
)
def test_wrapped_articles(page):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == "The title\nA text that goes on for a while, as it should."


def test_flow_moves_the_least():
    rng = random.Random(3)
    for _ in range(30):
        supply = [rng.randint(0, 50) for _ in range(4)]
        room = sharding.level_capacities([0] * 6, sum(supply))
        assert sum(room) == sum(supply) and max(room) - min(room) <= 1
        sent = sharding.min_cost_flow(supply, room)
        assert [sum(x) for x in sent] == supply and [sum(x) for x in zip(*sent, strict=True)] == room
        assert sum(sent[i][i] for i in range(4)) == sum(min(a, b) for a, b in zip(supply, room, strict=False))


def test_reshard_and_rewrite(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    placed = sharding.reshard(docs, 6, sharding.hashed_shard(F.col("doc_id"), 4), 4).cache()
    size = {r.shard: r.b for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert len(size) == 6 and max(size.values()) <= 1.05 * min(size.values())
    manifest = sharding.rewrite_affected(docs, placed, str(tmp_path / "old"), str(tmp_path / "new")).collect()
    new = [r for r in manifest if r.path.startswith(str(tmp_path / "new"))]
    back = {(r.doc_id, zlib.crc32(r.text.encode())) for m in new for r in spark.read.parquet(m.path).collect()}
    assert back == {(r.doc_id, r.text_crc32) for r in placed.where(F.col("shard").isin([m.shard for m in new])).collect()}


def test_recall(spark):
    rows = table(spark, SMALL, "embeddings").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in QUERIES["op7_multi_index_hashing"](spark, SMALL).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = {int(ids[j]) for j in np.lexsort((ids, -s))[:20]}
        hit, total = hit + len(best & got[ids[i]]), total + len(best)
    assert hit >= 0.9 * total


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 16))
    codes = ann.fit(x, 5, 0.9)
    q, r = ann.search(codes, x[:20], x, 400)
    own = codes.encode(x)
    for i in range(20):
        near = np.bitwise_count(own[i] ^ own).sum(1) <= codes.radius
        assert set(r[q == i]) >= set(np.flatnonzero(near))


def test_targets(spark):
    rng = random.Random(8)
    for _ in range(3):
        sizes = [rng.choice([1, 10, 100, 1000]) * rng.randint(1, 9) for _ in range(7)]
        df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, size bigint")
        got = [r.target for r in mixing.targets_of(df).orderBy("source").collect()]
        assert got == pytest.approx(mixing.water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(7)]))


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([("a", 700, 700.0), ("b", 200, 200.0), (None, 100, 100.0)], "source string, source_size bigint, target double")
    rows = mixing.schedule(spark, targets, 1, 1000).orderBy("slot").collect()
    for n in (50, 200, 1000):
        head = [r.source for r in rows[:n]]
        assert abs(head.count("a") - 0.7 * n) <= 4 and abs(head.count(None) - 0.1 * n) <= 4
    assert len(rows) == 1000


def test_gapped_insults_are_met():
    rng = random.Random(5)
    words = ["the", "river", "market", "garden", "window", "paper", "summer", "letter", "morning", "station", "bridge", "winter"]
    insults = ["idiot", "scumbag", "moronic", "worthless"]
    texts, toxic = [], []
    for i in range(400):
        own = [rng.choice(words) + rng.choice(["", "s", "ly", "ed"]) for _ in range(40)]
        if i % 4 == 0:
            own[rng.randrange(40)] = rng.choice(insults)
        texts.append(" ".join(own))
        toxic.append(int(i % 4 == 0))
    m = toxicity.train(texts, np.array(toxic))
    clean = "the river market garden window paper summer letter"
    score = dict(zip(["clean", "plain", "inserted", "spaced", "gapped", "suffix"], m.scores([clean, clean + " idiot", clean + " id-iot", clean + " i d i o t", clean + " wor.th.less", clean + " scumbags!"], {}), strict=True))
    assert score["clean"] < 0.3 and all(v >= 0.3 for k, v in score.items() if k != "clean"), score


@pytest.mark.parametrize(("name", "label", "cutoff"), [("op9_quality_ranking", "quality", 0.9), ("op1_subsequence_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, label, cutoff):
    got = QUERIES[name](spark, "/root/testdata/sf0.01").where("held_out").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id")
    right = got.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]
    assert right >= cutoff


def test_oracle(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    for name, sql in ORACLE.items():
        rel = con.execute(sql)
        cols = [d[0] for d in rel.description]
        got = {tuple(r[c] for c in cols) for r in QUERIES[name](spark, SMALL).collect()}
        assert got == set(rel.fetchall())


@pytest.mark.parametrize("slots", [1, 3, 40, 500, 1 << 17])
def test_every_source_gets_its_target(spark, slots):
    rng = random.Random(slots)
    sizes = {"a": [rng.randint(0, 900) for _ in range(40)], "b": [100, 50], "c": [1], None: [7, 0, 3], "d": [rng.randint(1, 5) for _ in range(60)]}
    rows = [(i, s, " ".join(["w"] * n)) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, text string"), slots=slots).collect()
    order = sorted((s for s in sizes if s is not None)) + [None]
    totals = [sum(sizes[s]) for s in order]
    targets = dict(zip(order, mixing.water_fill(totals, [mixing.WEIGHTS[i % 3] for i in range(len(order))]), strict=True))
    for s in order:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - targets[s]) <= 0.5 and all(r.taken <= 2 * r.size for r in own)
        assert sorted(r.size for r in own) == sorted(sizes[s])
