"""JSON walks, subgraphs and shared runs: pinned cases and brute force."""

import random

from veldspar.operators import graph, jsontree, probes

MESSY = '{"query": "q", "references": [{"path": " a.md ", "content": ["one", ""], "tags": {"mode": ["x", {"say": "y"}]}}], "b": 1, "a": -2.50, "source": ["no", {"source": "s"}], "n": null, "t": false, "s": "{\\"not\\": 1}", "big": 123456789012345678901234567890}'


def tree(spark, rows, depth=6):
    return jsontree.nodes(spark.createDataFrame(rows, "id int, payload string"), "id", "payload", depth)


def test_strings_keep_the_payload_order(spark):
    got = jsontree.strings(tree(spark, [(1, MESSY), (2, '["b", "a"]'), (3, '"alone"'), (4, None), (5, "{broken"), (6, "7")]), "id").orderBy("id", "rank").collect()
    assert [(r.id, r.text) for r in got] == [(1, x) for x in (" a.md ", "one", "y", "no", "s", '{"not": 1}')] + [(2, "b"), (2, "a"), (3, "alone")]
    assert [r.rank for r in got] == [1, 2, 3, 4, 5, 6, 1, 2, 1]


def test_provenance(spark):
    got = jsontree.provenance(tree(spark, [(1, MESSY), (2, '{"path": "x", "z": [{"path": "y"}, {"file_path": "x"}], "source_id": "  "}')]), "id").orderBy("id", "rank").collect()
    assert [(r.id, r.source) for r in got] == [(1, "a.md"), (1, "s"), (2, "x"), (2, "y")]


def test_shapes(spark):
    got = {(r.path, r["shape"]): r.n for r in jsontree.shapes(tree(spark, [(1, MESSY), (2, MESSY), (3, "[[[1]]]"), (4, "{broken"), (5, '{"a": 1, "a": 2}'), (6, "null")], 2)).collect()}
    assert got[("<root>", "dict(keys=9)")] == 2 and got[("<root>", "broken")] == 2 and got[("<root>", "list(n=1)")] == 1 and got[("<root>", "null")] == 1
    assert got[("b", "int")] == 2 and got[("a", "float")] == 2 and got[("big", "int")] == 2 and got[("n", "null")] == 2 and got[("t", "bool")] == 2
    assert got[("query", "str(len=1 sha256=8e35c2cd3bf6)")] == 2 and got[("references[]", "max_depth")] == 2 and got[("[][]", "max_depth")] == 1 and got[("[]", "list(n=1)")] == 1


def plain_subgraph(edges, seed, depth, most):
    links = {(a.lower(), b.lower(), r.lower()): (a, b) for a, r, b in sorted(edges, key=lambda e: (e[0], e[2], e[1]), reverse=True)}
    links |= {(b.lower(), a.lower(), r.lower()): (b, a) for a, r, b in edges}
    kept, level = [seed], [seed]
    for _ in range(depth):
        n = {}
        for (_, _, _), (a, b) in links.items():
            if a in level and b not in kept and a != b:
                n[b] = n.get(b, 0) + 1
        level = sorted(n, key=lambda x: (-n[x], x))[: most - len(kept)]
        kept += level
    return kept


def test_subgraph(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(30)}", rng.choice(["is", "has"]), f"n{int(rng.random() ** 3 * 30)}") for _ in range(80)]
    df = spark.createDataFrame([(*e, f"f{i % 3}") for i, e in enumerate(edges)], "source string, relation string, target string, file_path string")
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(6)] + [("unknown",)], "seed string")
    for depth, most in ((1, 50), (2, 6), (3, 9)):
        nodes, inside = graph.subgraph(df, seeds, depth, most)
        got = {}
        for r in nodes.collect():
            got.setdefault(r.seed, []).append((r.place, r.node))
        assert {s: [n for _, n in sorted(v)] for s, v in got.items()} == {s: plain_subgraph(edges, s, depth, most) for s in [f"n{i}" for i in range(6)] + ["unknown"]}
        assert all(p == list(range(1, len(p) + 1)) for p in ([a for a, _ in sorted(v)] for v in got.values()))
        members = {s: {n for _, n in v} for s, v in got.items()}
        assert {(r.seed, r.source, r.relation, r.target) for r in inside.collect()} == {(s, *e) for s, m in members.items() for e in edges if e[0] in m and e[2] in m}
    told = {r.seed: r for r in graph.evidence(nodes, inside).collect()}
    assert told["unknown"].node_count == 1 and told["unknown"].edge_count == 0 and told["unknown"].provenance == [] and told["n1"].labels[0] == "n1"


def test_expand_keeps_relations(spark):
    edges = spark.createDataFrame([("A", "is", "B"), ("A", "Has", "B"), ("A", "has", "B"), ("B", "has", "C")], "source string, relation string, target string")
    got = {(r.hop, r.source, r.relation, r.target) for r in graph.expand(edges, spark.createDataFrame([("A",)], "seed string"), 10).collect()}
    assert got == {(1, "A", "is", "B"), (1, "A", "Has", "B"), (2, "B", "has", "C")}


def test_longest_shared_run(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab ") for _ in range(rng.randint(0, 40)))
    left = [(i, word()) for i in range(25)] + [(25, None), (26, ""), (27, "Same  TEXT here"), (None, "no id ab")]
    right = [(word(),) for _ in range(6)] + [(None,), ("the same text here too",), ("same text here",)]
    plain = lambda t: " ".join((t or "").split()).lower()

    def run(t, least, cap):
        best = 0
        for n in range(least, cap + 1):
            if any(plain(t)[i : i + n] in plain(r) for (r,) in right for i in range(len(plain(t)) - n + 1)):
                best = n
        return best

    a, b = spark.createDataFrame(left, "id int, text string"), spark.createDataFrame(right, "text string")
    for least, cap in ((4, 13), (1, 32)):
        got = {r.id: r.longest for r in probes.longest_shared_run(a, b, least=least, cap=cap).collect()}
        assert got == {i: run(t, least, cap) for i, t in left}
    plan = probes.longest_shared_run(a, b, least=8, cap=8)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
