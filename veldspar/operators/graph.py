"""Entity graph: neighbour expansion, seed labels, neighbour filter, evidence fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms
from .retrieval import first_occurrences


def triple_key(*columns: str) -> list[Column]:
    """What makes an edge the same as another: its ends and its relation, without case."""
    return [F.lower(F.col(c).cast("string")) for c in columns]


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from each of its ends; an edge that differs in case alone counts once."""
    cols = [c for c in edges.columns if c not in ("source", "target")]
    turned = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *cols)
    least = [F.min(F.struct("source", "target", *cols)).alias("e")]
    keys = triple_key("source", "target", *(["relation"] if "relation" in cols else []))
    return edges.select("source", "target", *cols).unionByName(turned).groupBy(*[k.alias(f"_{i}") for i, k in enumerate(keys)]).agg(*least).select("e.*")


def expand(edges: DataFrame, seeds: DataFrame, budget: int, hops: int = 2, frontier: int = 5) -> DataFrame:
    """(seed, hop, source, [relation,] target): distinct edges met within ``hops``, at most ``budget`` of a seed.

    ``edges`` (source, target, and relation if there are several between two nodes) are read both ways, ``seeds`` (seed). The second hop starts
    from the first min(budget, frontier) neighbours of each seed. Edges that differ in case alone are one.
    """
    own = ["source", "relation", "target"] if "relation" in edges.columns else ["source", "target"]
    both = both_ways(edges.select(*own))
    found = seeds.join(both, F.col("seed") == F.col("source")).select("seed", F.lit(1).alias("hop"), *own)
    reached = found
    for hop in range(2, hops + 1):
        w = Window.partitionBy("seed").orderBy("target")
        front = reached.where(F.col("hop") == hop - 1).select("seed", "target").distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= min(budget, frontier))
        more = front.select("seed", F.col("target").alias("source")).join(both, "source").where("target <> seed").select("seed", F.lit(hop).alias("hop"), *own)
        found = found.unionByName(more)
        reached = more
    once = found.groupBy("seed", *own).agg(F.min("hop").alias("hop"))
    w = Window.partitionBy("seed").orderBy("hop", *own)
    return once.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= budget).select("seed", F.col("hop").cast("long").alias("hop"), *own)


def subgraph(edges: DataFrame, seeds: DataFrame, max_depth: int = 2, max_nodes: int = 50) -> tuple[DataFrame, DataFrame]:
    """((seed, node, depth, place), (seed, source, relation, target, ...)): what lies around each seed, within both bounds.

    Breadth first: of each level, the nodes with most links to the nodes before them come first, then
    by name, until a seed has ``max_nodes``; the seed is node 1 and counts. Edges (source, relation, target and more) are
    those between kept nodes, each once without regard to case and in the direction it was given. A level is aggregated to
    one row a node before it is ranked, and only a prefix of that is kept, so a hub brings no more than the budget.
    A seed that no edge has stands alone.
    """
    linked = both_ways(edges.select("source", "relation", "target")).where("source <> target")
    level = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(1).alias("place")).distinct()
    kept = level
    for depth in range(1, max_depth + 1):
        links = level.select("seed", F.col("node").alias("source")).join(linked, "source").groupBy("seed", F.col("target").alias("node")).agg(F.count("*").alias("links"))
        fresh = links.join(kept.select("seed", "node"), ["seed", "node"], "left_anti").join(kept.groupBy("seed").agg(F.count("*").alias("so_far")), "seed")
        ranked = fresh.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy(F.col("links").desc(), "node"))).where(F.col("n") <= max_nodes).where(F.col("so_far") + F.col("n") <= max_nodes)
        level = ranked.select("seed", "node", F.lit(depth).alias("depth"), (F.col("so_far") + F.col("n")).cast("int").alias("place"))
        kept = kept.unionByName(level)
    a, b = kept.select(F.col("seed"), F.col("node").alias("source")), kept.select(F.col("seed").alias("_s"), F.col("node").alias("_t"))
    more = [c for c in edges.columns if c not in ("source", "relation", "target")]
    inside = edges.join(a, "source").join(b, (F.col("seed") == F.col("_s")) & (F.col("target") == F.col("_t"))).select("seed", "source", "relation", "target", *more)
    row = F.struct("source", "relation", "target", *more)
    once = inside.groupBy("seed", *[k.alias(f"_{i}") for i, k in enumerate(triple_key("source", "relation", "target"))]).agg(F.min(row).alias("e"))
    return kept, once.select("seed", "e.*")


def evidence(nodes: DataFrame, edges: DataFrame, provenance: str = "file_path", labels: int = 10) -> DataFrame:
    """(seed, node_count, edge_count, labels, provenance): one row for each seed; the first ``labels`` nodes by place, distinct sources of its edges."""
    n = nodes.groupBy("seed").agg(F.count("*").alias("node_count"), F.array_sort(F.collect_list(F.when(F.col("place") <= labels, F.struct("place", F.trim(F.col("node").cast("string")).alias("node"))))).alias("_l"))
    e = edges.groupBy("seed").agg(F.count("*").alias("edge_count"), F.sort_array(F.collect_set(F.nullif(F.trim(provenance), F.lit("")))).alias("provenance"))
    j = n.join(e, "seed", "left")
    return j.select("seed", "node_count", F.coalesce("edge_count", F.lit(0).cast("long")).alias("edge_count"), F.transform("_l", lambda x: x["node"]).alias("labels"), F.coalesce("provenance", F.array().cast("array<string>")).alias("provenance"))


def with_expansion(base: DataFrame, neighbors: DataFrame, within: list[str]) -> DataFrame:
    """``base`` (within, rank, path, content) followed by graph neighbours as citations, without repeats by path, then by content.

    ``neighbors``: within, place, seed_entity, related_entity, relationship, context. Their path and wording are fixed formats.
    """
    words = F.concat(F.lit("[Graph expansion: "), F.col("seed_entity"), F.lit(" --"), F.coalesce("relationship", F.lit("")), F.lit("--> "), F.col("related_entity"), F.lit("] "), F.coalesce("context", F.lit("")))
    made = neighbors.select(*within, F.struct(F.lit(1).alias("part"), F.col("place").cast("long").alias("rank")).alias("order"), F.concat(F.lit("graph://"), F.col("seed_entity"), F.lit("/"), F.col("related_entity")).alias("path"), F.trim(words).alias("content"))
    own = base.select(*within, F.struct(F.lit(0).alias("part"), F.col("rank").cast("long").alias("rank")).alias("order"), "path", "content")
    merged = first_occurrences(own.unionByName(made), ["order"], "path", "content", within)
    return merged.select(*within, F.row_number().over(Window.partitionBy(*within).orderBy("order")).alias("rank"), "path", "content", (F.col("order.part") == 1).alias("from_graph"))


def seed_labels(labels: DataFrame, query: Column, most: int) -> DataFrame:
    """(label, overlap): distinct labels that share a term with the query: most shared, shortest, first by name."""
    terms = query_terms(query)
    own = F.array_distinct(F.regexp_extract_all(F.lower("label"), F.lit("[a-z0-9]+"), F.lit(0)))
    scored = labels.select("label").distinct().withColumn("overlap", F.size(F.array_intersect(own, terms)).cast("long"))
    return scored.where("overlap > 0").orderBy(F.col("overlap").desc(), F.length("label"), "label").limit(most)


def filter_neighbors(edges: DataFrame, query: Column, domain_terms: list[str], most: int = 3, least_score: float = 0.2) -> DataFrame:
    """Edges with a relation of 2 and a context of 10 characters at least, no low score, that share a term; the best ``most`` of each seed."""
    terms = F.array_union(query_terms(query, 2, 100), F.array(*[F.lit(t) for t in domain_terms]).cast("array<string>"))
    said = F.lower(F.concat_ws(" ", "related_entity", "relationship", "context"))
    overlap = F.size(F.filter(terms, lambda t: said.contains(t)))
    good = (F.length(F.trim("relationship")) >= 2) & (F.length(F.trim("context")) >= 10) & (F.col("score").isNull() | (F.col("score") >= least_score))
    w = Window.partitionBy("seed_entity").orderBy(F.col("overlap").desc(), F.col("score").desc_nulls_last(), "related_entity", "relationship", "context")
    return edges.where(good).withColumn("overlap", overlap).where("overlap > 0").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def text_edges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, source, relation, target) from lines like ``A -> B`` or ``A relates to B``."""
    each = docs.select(id_col, F.explode(F.split(text_col, "\n")).alias("line"))
    p = r"^\s*[-*]?\s*([^>|]{1,80}?)\s*(->|-->|=>|\brelates to\b|\bdepends on\b|\bis part of\b)\s*([^>|]{1,80}?)\s*[.]?\s*$"
    return each.select(id_col, *[F.regexp_extract("line", p, i).alias(n) for i, n in ((1, "source"), (2, "relation"), (3, "target"))]).where("source <> '' and target <> ''")
