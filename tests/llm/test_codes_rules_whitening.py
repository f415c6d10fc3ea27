"""Part codes, weak rules and whitening against brute force, and on nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tests.conftest import SMALL
from veldspar.llm import part_codes, weak_rules, whitening
from veldspar.llm.common import table
from veldspar.llm.queries import QUERIES

VEC = "vec_id bigint, embedding array<float>, label int, row int, pos string, x int, n int, _label int"
INF, NAN = float("inf"), float("nan")


def vectors(spark, rows, d=VEC):
    return spark.createDataFrame([(*r, 1, "c", 1, 1, 1) for r in rows], d)


def plain_codes(rows, parts, entries, rounds, scale):
    """(code, error) by row and the codebooks, one row and part at a time; rows: (id, vector)."""
    x = [[math.floor(scale * c) for c in v] for _, v in rows]
    w = len(x[0]) // parts
    cut = [[tuple(v[p * w : p * w + w]) for p in range(parts)] for v in x]
    order = sorted(range(len(x)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]

    def near(p, v):
        apart = ((np.array(books[p]) - np.array(v)) ** 2).sum(1).tolist()
        return min(apart), apart.index(min(apart))

    for _ in range(rounds):
        own = [{} for _ in range(parts)]
        for v in cut:
            for p in range(parts):
                own[p].setdefault(near(p, v[p])[1], []).append(v[p])
        for p in range(parts):
            for k, members in own[p].items():
                books[p][k] = tuple(sum(m[i] for m in members) // len(members) for i in range(w))
    found = [[near(p, v[p]) for p in range(parts)] for v in cut]
    return [("".join(f"{k:02x}" for _, k in f), sum(e for e, _ in f)) for f in found], books


def test_part_codes_on_the_table(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table(spark, SMALL, "embeddings").collect()]
    expected, books = plain_codes([r[:2] for r in rows], 8, 16, 6, 4096)
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    by_label = Counter()
    for (_, e), r in zip(expected, rows, strict=True):
        by_label[r[2]] += e
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in QUERIES["op11_part_codes"](spark, SMALL).collect()}
    assert got == {r[0]: (c, e, by_label[r[2]], digest) for (c, e), r in zip(expected, rows, strict=True)}


@pytest.mark.parametrize("heavy", [2, 1000])
@pytest.mark.parametrize("labels", [0, 1_000_000])
def test_part_codes_edges(spark, monkeypatch, heavy, labels):
    monkeypatch.setattr(part_codes, "HEAVY", heavy)
    monkeypatch.setattr(part_codes, "LABELS", labels)
    rng = np.random.default_rng(5)
    rows = [(i, np.round(rng.standard_normal(4), 2).tolist(), [None, 1, 2][i % 3]) for i in range(40)]
    rows += [(50, [1.0, 1.0, 0.5, -0.0], None)] * 30 + [(None, [9.0, 1.0, 0.5, 2.0], 7), (3, [0.25, 0.0, 0.0, 0.0], 1)]
    odd = [(60, None, 1), (61, [1.0, None, 1.0, 1.0], 1), (62, [1.0, NAN, 1.0, 1.0], 1), (63, [INF, 0.0, 0.0, 0.0], 1), (64, [], 1), (65, [1.0, 2.0], 1)]
    out, books = part_codes.compress(vectors(spark, rows + odd), parts=2, entries=5, rounds=3, scale=16)
    expected, plain = plain_codes([(i, np.array(v, np.float32).tolist()) for i, v, _ in rows], 2, 5, 3, 16)
    assert [[tuple(e) for e in p] for p in books.tolist()] == plain
    sums = Counter()
    for (_, e), r in zip(expected, rows, strict=True):
        sums[r[2]] += e
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()) == Counter((r[0], c, e, sums[r[2]]) for (c, e), r in zip(expected, rows, strict=True))


def test_part_codes_few_and_none(spark):
    empty = hashlib.sha256(b"").hexdigest()
    none, books = part_codes.compress(vectors(spark, [(1, None, 1)]), parts=2)
    assert none.count() == 0 and books.size == 0 and hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest() == empty
    assert part_codes.compress(vectors(spark, [(1, [1.0, 2.0, 3.0], 1)]), parts=2)[0].count() == 0
    one = part_codes.compress(vectors(spark, [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)]), parts=2)[0].collect()
    assert [(r.code, r.error, r.label_error) for r in one] == [("0000", 0, 0)] * 2
    huge = part_codes.compress(vectors(spark, [(1, [1e9, 2.0], 1), (2, [3e38, 2.0], 2), (3, [1.5e9, 0.0], 1)]), parts=2, entries=1, rounds=1)[0].collect()
    assert len(huge) == 3 and all(r.error is None or r.error >= 0 for r in huge)


def plain_counts(text):
    ws = re.findall("[^\x20\x09-\x0d]+", text or "")
    runs = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    covered = {j for i in range(len(ws) - 7) if runs[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


ODD = [None, "", " \t\n", "one", "a b c d e f g h a b c d e f g h", "x " * 40, "a\na\na \n\n\na", "日本語 \U0001f600 ñandú #|*", "a\x0bb\x0cc\x1cd\x85e f", " ".join(f"w{i % 9}" for i in range(5000)), "a\x00b ퟿", "b c d e f g h i b c d e f g h j b c d e f g h i"]


def test_counts():
    rng = np.random.default_rng(1)
    texts = ODD + [" ".join(map(str, rng.integers(0, 3, n))) for n in (7, 8, 9, 15, 16, 17, 60, 200)]
    assert [weak_rules.measure(t)[:5] for t in texts] == [plain_counts(t) for t in texts]


def plain_learn(votes, mean=0.8, weight=1.0, rounds=200):
    """The same model, one text at a time: (posterior by text)."""
    k = len(votes[0])
    p = [0.9 * 0.5 ** v.count(0) for v in votes]
    for _ in range(rounds):
        right = []
        for j in range(k):
            spoke = [i for i, v in enumerate(votes) if v[j] != 1]
            g = (sum(p[i] for i in spoke if votes[i][j] == 2) + mean * weight) / (sum(p[i] for i in spoke) + weight)
            b = (sum(1 - p[i] for i in spoke if votes[i][j] == 0) + mean * weight) / (sum(1 - p[i] for i in spoke) + weight)
            right.append((g, b))
        prior = (sum(p) + 1) / (len(p) + 2)
        q = []
        for v in votes:
            a, c = prior, 1 - prior
            for x, (g, b) in zip(v, right, strict=True):
                a *= {0: 1 - g, 1: 1, 2: g}[x]
                c *= {0: b, 1: 1, 2: 1 - b}[x]
            q.append(a / (a + c))
        moved, p = max(abs(x - y) for x, y in zip(p, q, strict=True)), q
        if moved < 1e-9:
            break
    return p


def test_weak_rules_on_the_table(spark):
    docs = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    got = {r.doc_id: r for r in weak_rules.judge(table(spark, SMALL, "documents")).collect()}
    assert {i: tuple(r[c] for c in weak_rules.COUNTS) for i, r in got.items()} == {i: plain_counts(t) for i, t in docs.items()}
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed and r.quality >= 0.5) for r in got.values())
    ids = list(got)
    posterior = plain_learn([[got[i].votes // 3**j % 3 for j in range(len(weak_rules.RULES))] for i in ids])
    assert max(abs(got[i].quality - q) for i, q in zip(ids, posterior, strict=True)) < 1e-6
    told = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    judged = [(r.kept, told[i]) for i, r in got.items() if i in told and not r.base_failed]
    assert all(k for k, y in judged if y == 1) and sum(k for k, y in judged if y == 0) <= 0.1 * sum(y == 0 for _, y in judged)
    assert QUERIES["op12_weak_rules"](spark, SMALL).count() == len(docs)


def test_weak_rules_edges(spark):
    rows = [(i, t, 1, "q") for i, t in enumerate(ODD)] + [(1, "", 1, "q"), (None, "no id", 1, "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, votes string")
    got = weak_rules.judge(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.quality <= 1 for r in got)
    assert next(r for r in got if r.doc_id == 0).base_failed and not any(r.kept for r in got if r.n_words < 20)
    assert weak_rules.judge(docs.limit(0)).count() == 0
    fixed = weak_rules.judge(docs, [weak_rules.Rule("none", "n_words > n_words", "n_words > n_words")]).collect()
    assert len({r.quality for r in fixed}) == 1


def test_accuracies_are_found():
    """Votes drawn from a known model: learnt accuracies come close, and the posterior beats the vote of the most."""
    rng = np.random.default_rng(2)
    y = rng.random(20_000) < 0.7
    right = np.array([[0.95, 0.9], [0.9, 0.85], [0.99, 0.4], [0.6, 0.55], [0.85, 0.9], [0.97, 0.3]])
    votes = np.ones((len(y), 6), int)
    for j, (g, b) in enumerate(right):
        spoke, ok = rng.random(len(y)) < 0.8, rng.random(len(y)) < np.where(y, g, b)
        votes[:, j] = np.where(spoke, np.where(ok == y, 2, 0), 1)
    u, n = np.unique(votes, axis=0, return_counts=True)
    trust = weak_rules.learn(u, n.astype(float))
    assert np.abs(trust.right - right).max() < 0.03 and abs(trust.prior - 0.7) < 0.02
    judged = trust.posterior(votes) >= 0.5
    most = (votes == 2).sum(1) > (votes == 0).sum(1)
    assert (judged == y).mean() > (most == y).mean() + 0.01


def check_white(rows, got, scale, k=4):
    """``rows``: (id, vector) kept; brute force by exact sums and numpy's eigenvectors."""
    x = [[math.floor(scale * c) for c in v] for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(v, s, strict=True)] for v in fit])
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1], axes[:, ::-1]
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert len(got) == len(rows) * min(k, len(s))
    for (i, _), v in zip(rows, x, strict=True):
        for j in range(min(k, len(s))):
            r = by[i, j + 1][0]
            assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))
            assert abs(r.explained - e[j] / e.sum()) < 1e-9 * e[0] / e.sum()
    white = {i: [by[i, j + 1][0].whitened for j in range(min(k, len(s)))] for i, _ in rows}
    for j in range(min(k, len(s))):
        plain = [float(np.array([a - b / n for a, b in zip(v, s, strict=True)]) @ axes[:, j] / math.sqrt(e[j])) for v in x]
        own = [white[i][j] for i, _ in rows]
        sign = 1 if sum(a * b for a, b in zip(plain, own, strict=True)) > 0 else -1
        assert max(abs(a - sign * b) for a, b in zip(plain, own, strict=True)) < 1e-6
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_on_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, SMALL, "embeddings").collect()]
    check_white(rows, QUERIES["op13_jacobi_whitening"](spark, SMALL).collect(), 256)


def test_whitening_edges(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.standard_normal(3) * [1, 5, 2]).astype(np.float32).tolist(), 1) for i in range(50)]
    rows += [(50 + i, rows[i][1], None) for i in range(10)] + [(70, [0.0, -0.0, 1.0], 1)]
    odd = [(80, None, 1), (81, [1.0, None, 1.0], 1), (82, [1.0, NAN, 1.0], 1), (83, [-INF, 0.0, 0.0], 1), (84, [], 1), (85, [1.0, 2.0], 1)]
    df = vectors(spark, rows + odd).repartition(7)
    check_white([r[:2] for r in rows], whitening.whiten(df)[0].collect(), 256)
    assert whitening.whiten(df.limit(0))[0].count() == 0 and whitening.whiten(vectors(spark, [(1, [], 1)]))[0].count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)]))[0].collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, None)] * 4
    two = whitening.whiten(vectors(spark, [(1, [0.0, 0.0], 1), (2, [1.0, 1.0], 1)]))[0].collect()
    assert sorted((r.vec_id, r.component, r.whitened is None) for r in two) == [(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, True)]
    huge = whitening.whiten(vectors(spark, [(1, [3e38, 0.0], 1), (2, [1.0, 1e12], 1), (3, [0.0, 0.0], 1)]))[0].collect()
    assert len(huge) == 6


def test_factor_tree(spark):
    """Many partitions: several levels of the tree, the same R but for signs."""
    rng = np.random.default_rng(3)
    x = rng.integers(-500, 500, (400, 5))
    df = spark.createDataFrame([(v,) for v in x.tolist()], "x array<bigint>").repartition(40)
    sums = x.sum(0).tolist()
    r = whitening.tsqr(df, len(x), sums)
    c = x - x.mean(0)
    assert np.allclose(r.T @ r, c.T @ c)
    lengths, turns = whitening.jacobi(r)
    assert np.allclose(lengths, np.linalg.svd(c, compute_uv=False), rtol=1e-12) and np.allclose(turns.T @ turns, np.eye(5), atol=1e-14)


@pytest.mark.parametrize("d", [1, 2, 3, 8, 33])
def test_jacobi(d):
    rng = np.random.default_rng(d)
    r = np.triu(rng.standard_normal((d, d))) * np.logspace(0, -8, d)
    lengths, turns = whitening.jacobi(r)
    assert np.allclose(lengths, np.linalg.svd(r, compute_uv=False), rtol=1e-6, atol=0) and np.allclose(turns.T @ turns, np.eye(d), atol=1e-13)
    assert np.allclose((r @ turns).T @ (r @ turns), np.diag(lengths**2), atol=1e-12)
