"""Operators over many tasks: keys of both sides meet, ties are told alike, work and state stay in proportion."""

import re

import numpy as np
from pyspark.sql import functions as F

from veldspar.operators import gates, probes, retrieval, structure
from veldspar.runtime import cut


def test_cosine_top_k_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24)).astype(np.float32)
    vectors = np.concatenate([base] * 5)  # each vector five times: ties go to the smaller id
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, [float("nan")] * 24), (901, None)], "vec_id long, embedding array<float>")
    v = vectors.astype(float)
    length = np.cumsum(v * v, axis=1)[:, -1]
    want = {}
    for q in range(0, len(v), 20):
        s = np.cumsum(v * v[q], axis=1)[:, -1] / np.sqrt(length * length[q])
        want[q] = sorted((i for i in range(len(v)) if i != q), key=lambda i: (-s[i], i))[:7]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        rows = retrieval.cosine_top_k(df, (F.col("vec_id") % 20 == 0) & (F.col("vec_id") < 900), 7, block=16).collect()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want


def test_lines_are_cleaned_once(spark):
    df = spark.createDataFrame([(1, "Foot of page  \nfoot of page\t\r\nFoot  of page\n \t \nbody text goes on."), (2, None)], "doc_id int, text string")
    marked = structure.lines(df)
    assert [(r.pos, r.line, r.kind) for r in marked.orderBy("pos").collect()] == [(1, "Foot of page", "text"), (2, "foot of page", "text"), (3, "Foot  of page", "text"), (4, "", "blank"), (5, "body text goes on.", "text")]
    found = structure.furniture(marked)
    assert [tuple(r) for r in found.collect()] == [(1, "foot of page", 3, 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\s+$") == 1  # not once for each use of a line


def test_shared_runs_keep_only_what_meets(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(probes, "cut", lambda df: (kept.append(df.count()), cut(df))[1])
    left = spark.createDataFrame([(1, "the quick brown fox"), (2, "nothing alike 123"), (3, "short")], "id int, text string")
    right = spark.createDataFrame([(f"{i:05d} unlike words {i * 7919:07d}",) for i in range(300)] + [("a QUICK  brown dog",)], "text string")
    got = {r.id: r.longest for r in probes.longest_shared_run(left, right, least=8, cap=16).collect()}
    assert got == {1: 13, 2: 0, 3: 0}
    assert max(kept) < 40  # not the thousands of places of texts that share nothing


def test_simulation_deals_out_probes_not_rules(spark):
    ps = spark.createDataFrame([(i, "plain", f"Of AB-{i} and CD-{i} E-1?", i % 2, "co-1", i % 3) for i in range(20)], "probe int, kind string, question string, company int, company_code string, doc int")
    ev = spark.createDataFrame([(i % 3, i % 2, f"see AB-{i}, CD-{i}-E-1") for i in range(20)], "doc int, company int, text string")
    found = gates.simulate(ps, ev)
    assert found.count() == 20 * len(gates.RULES) * len(gates.MODELS)
    dealt = re.findall(r"hashpartitioning\(([^()]*)\)", found._jdf.queryExecution().executedPlan().toString()) or re.findall(r"hashpartitioning\((.*)", found._jdf.queryExecution().executedPlan().toString())
    assert not [keys for keys in dealt if "rule" in keys or "_r#" in keys or "scope" in keys]
