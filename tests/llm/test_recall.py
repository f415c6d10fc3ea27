"""Pairs that the stated similarity asks for, by kind of edit, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_brute_force import roots
from veldspar.llm import ann, decontaminate, line_dedup, minhash, near_copies


@pytest.mark.parametrize("kind", ["appended", "cut", "edited", "short"])
def test_near_copies_of_every_kind(spark, kind):
    rng = random.Random(kind)
    texts = []
    for _ in range(150):
        n = 25 if kind == "short" else rng.choice([50, 100, 250])
        base = [f"w{rng.randrange(50000)}" for _ in range(n)]
        copy = list(base)
        if kind == "appended":
            copy += [f"v{rng.randrange(50000)}" for _ in range(n // 6)]
        elif kind == "cut":
            copy = copy[n // 8 :]
        elif kind == "short":
            copy += [f"v{rng.randrange(50000)}" for _ in range(4)]
        else:
            for at in rng.sample(range(n), n // 50):
                copy[at] = "edit"
        texts += [" ".join(base), " ".join(copy)]
    sets = [set(near_copies.shingle_set(t, 5).tolist()) for t in texts]
    pairs = [(i, i + 1) for i in range(0, len(sets), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert len(pairs) > 60
    got = [r.component_id for r in near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()]
    assert got == roots(len(texts), pairs)


@pytest.mark.parametrize("cap", [3, 10, 4096])
def test_links_of_large_buckets(spark, cap):
    rng = np.random.default_rng(1)
    sig = np.concatenate([np.where(rng.random((60, 64)) < 0.1, rng.integers(0, 1 << 16, (60, 64)), rng.integers(0, 1 << 16, (1, 64))) for _ in range(3)]).astype(np.uint16)
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sig)], "id bigint, sig binary")
    got = [(r.a, r.b) for r in minhash.links(df, 4, 38, cap).collect()]
    assert roots(180, got) == [i // 60 * 60 for i in range(180)]


def test_leaks_just_above_the_similarity(spark):
    rng = random.Random(12)
    items, docs = [], []
    for i in range(120):
        n, edits = [(50, [24]), (57, [28]), (100, [30, 70]), (35, [32, 33, 34])][i % 4]
        item = [f"w{rng.randrange(50000)}" for _ in range(n)]
        copy = [f"x{rng.randrange(50000)}" if k in edits else w for k, w in enumerate(item)]
        items.append((i, " ".join(item)))
        docs.append((i, " ".join([f"y{rng.randrange(50000)}" for _ in range(40)] + copy + [f"y{rng.randrange(50000)}" for _ in range(40)])))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(i, i) for i in range(120)}


@pytest.mark.parametrize(("n", "typos"), [(10, 1), (15, 1), (20, 2), (40, 3)])
def test_misspelt_lines(spark, n, typos):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 8)))
    docs = []
    for i in range(150):
        base = [word() for _ in range(n)]
        copy = list(base)
        for at in rng.sample(range(n), typos):
            copy[at] = copy[at][:-1] + "z"
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert all(got[i] == t for i, t in docs if i % 2 == 0)
    assert sum(got[i] == "" for i in range(1, 300, 2)) >= 0.99 * 150


def test_numbers_and_short_lines(spark):
    docs = [(1, "from 1234 to 5678 at 9012 and 3456\nAll rights reserved.\n12 40\n***"), (2, "from 7777 to 8888 at 1111 and 2222\nall rights reserved\n12 41\n***\n---\n \n"), (3, "12 40\n\n")]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id bigint, text string"), short=True).collect()}
    assert got == {1: docs[0][1], 2: "from 7777 to 8888 at 1111 and 2222\n12 41\n---\n \n", 3: "\n"}


def test_stages_decide_row_by_row(spark):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(40))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a, "s"), (2, a, "s"), (2, b, "s"), (3, c, "s"), (3, c, "s"), (None, d, "s"), (None, d + " end", "s"), (None, c, "s")]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "").collect()]
    left = [x for x in got if x[0] is None]
    assert sorted(x for x in got if x[0]) == sorted([(1, a), (2, b), (3, c)]) and len(left) >= 1 and (None, c) not in left
    same = [(None, text(), "t" if i % 4 else "s") for i in range(200)]
    out = corpus_pipeline.mixing_sources(spark, spark.createDataFrame(same, "doc_id bigint, text string, source string"), "").groupBy("source", "text").count().collect()
    times = {(r.source, r.text): r["count"] for r in out}
    by = {s: {times.get((s, t), 0) for _, t, x in same if x == s} for s in "st"}
    assert any(len(v) > 1 for v in by.values())


def test_clustered_vectors_are_probed(spark):
    """On clustered vectors the radius leaves few probes: the tables return a small share of the rows and the recall holds."""
    rng = np.random.default_rng(8)
    x = np.repeat(rng.standard_normal((60, 32)), 40, axis=0) + 0.1 * rng.standard_normal((2400, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    codes = ann.fit(x, 20, 0.97)
    tables = -(-codes.turns.shape[1] // ann.INDEXED)
    assert ann.n_probes(codes.radius, tables) == len(ann.probes(codes.radius, tables)) <= ann.PROBES
    queries = df.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS v")
    pairs = {(r.query_id, r.uid) for r in ann.probed(codes, queries, df.selectExpr("vec_id AS uid", "embedding AS v")).collect()}
    apart = np.bitwise_count(codes.encode(x)[::20][:, None, :] ^ codes.encode(x)[None]).sum(2)
    assert pairs == {(20 * int(i), int(j)) for i, j in zip(*np.nonzero(apart <= codes.radius))}
    assert len(pairs) < 0.1 * 120 * 2400
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect()}
    score = x[::20] @ x.T
    score[np.arange(120), np.arange(0, 2400, 20)] = -np.inf
    true = {(20 * i, int(j)) for i in range(120) for j in np.argsort(-score[i], kind="stable")[:20]}
    assert len(got) == 2400 and len(got & true) >= 0.9 * len(true)


@pytest.mark.parametrize("kind", ["plain", "short queries", "few long rows"])
def test_nearest_of_other_rows(spark, kind):
    """Blocks dealt over several tasks, queries unlike the rows, and neighbours that a sample of the rows hardly holds."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "short queries":
        x[::20] *= 0.01
    elif kind == "few long rows":
        x[rng.choice(4000, 24, replace=False)] *= 50
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, str(kind != "plain").lower())
    try:
        got = {(r.query_id, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, sample=400, index_rows=500).collect()}
    finally:
        spark.conf.unset(coalesce)
    score = x[::20] @ x.T
    score[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    true = {(20 * i, int(j)) for i in range(200) for j in np.argsort(-score[i], kind="stable")[:20]}
    assert len(got) == 4000 and len(got & true) >= 0.95 * len(true)


def test_distances_of_many_pairs():
    """Bands of many pairs at a time tell the same as one pair at a time, whatever the lengths, widths and characters."""
    rng = random.Random(6)
    pairs = [("", ""), ("", "ab"), ("ab", "")]
    for n in [1, 2, 5, 20, 60, 200] * 40:
        a = [rng.choice("abcé漢") for _ in range(n)]
        b = [c for c in a for c in ([c], [c, "x"], [], ["y"], *[[c]] * 12)[rng.randrange(16)]]
        pairs.append(("".join(a), "".join(b)))
    most = np.array([rng.choice([0, 1, 3, 8, 40]) for _ in pairs])
    whole = np.array([round((1 - line_dedup.edit_similarity(a, b)) * max(len(a), len(b))) for a, b in pairs])
    got = line_dedup.distances(pairs, most)
    assert ((got == whole) | ((got > most) & (whole > most))).all() and 20 < (whole <= most).sum() < 220


def test_buckets_are_dealt_packed(monkeypatch):
    """A line's sixteen buckets travel packed by parts, not as rows; links of small buckets are found and members of large ones sent on, in parts too large to hold as well."""
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(12)) for _ in range(40)]
    lines = [" ".join(w if rng.random() > 0.06 else "x" + w for w in b.split()) for b in base for _ in range(15)] + base[:20]
    fp, band = line_dedup.prints(lines)
    signs = pa.RecordBatch.from_arrays([pa.array(fp), pa.array([x.tobytes() for x in band], pa.binary())], names=["fp", "bands"])
    apart = np.bitwise_count((fp[:, None] ^ fp[None]).view(np.uint64))
    met = ((band[:, None] == band[None]).any(2) & (apart <= line_dedup.APART)) | (apart <= 3)
    at = {f: i for i, f in reversed(list(enumerate(fp.tolist())))}  # links are of SimHashes
    links = {(at[int(fp[i])], at[int(fp[j])]) for i, j in zip(*np.nonzero(met), strict=True)}
    for cap, held in ((16384, 4_000_000), (5, 4_000_000), (5, 300)):
        monkeypatch.setattr(line_dedup, "CAP", cap)
        monkeypatch.setattr(line_dedup, "HELD", held)
        dealt = list(line_dedup._deal(iter([signs.slice(0, 300), signs.slice(300)]), 3, 7))
        assert sum(b.num_rows for b in dealt) <= 2 * 7 and sum(len(x) for b in dealt for x in b.column(2).to_pylist()) == 16 * 16 * len(lines)
        rows = [r for b in line_dedup._meet((b.slice(i, 1) for b in dealt for i in range(b.num_rows)), 3) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        pairs = [(at[a], at[b]) for level, _, a, b in rows if level < 0]
        assert set(pairs) <= links
        large = {}
        for level, key, a, _ in rows:
            if level >= 0:
                large.setdefault((level, key), set()).add(at[a])
        assert bool(large) == (cap == 5)
        pairs += [(i, j) for (level, _), x in large.items() for i in x for j in x if i < j and apart[i, j] <= (line_dedup.APART, 3)[level]]
        same = [(i, at[f]) for i, f in enumerate(fp.tolist())]
        assert roots(len(lines), pairs + same) == roots(len(lines), [*links, *same])
