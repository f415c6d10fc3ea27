"""JSON payloads as rows: one row for each node, to a fixed depth; shapes, strings in order, provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that echo the request, keys that name a source.
ECHO_KEYS = ("query", "question", "mode", "response_type", "model", "status", "message", "only_need_context", "only_need_prompt", "stream", "include_references", "include_chunk_content")
PROVENANCE_KEYS = ("source_id", "file_path", "source", "path")
NODE = "struct<path:array<struct<key:string,index:int>>,at:array<int>,key:string,raw:string,v:variant>"


def _fields(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _children(n: Column) -> Column:
    """Nodes below an object, in the order in which its text has them (a VARIANT sorts its keys), or below a list."""
    texts = F.map_entries(F.from_json(n["raw"], "map<string,string>"))
    fields = F.transform(texts, lambda e, i: _node(n, F.struct(e["key"].alias("key"), F.lit(None).cast("int").alias("index")), i, e["key"], e["value"], F.element_at(_fields(n["v"]), e["key"])))
    parts = F.from_json(n["raw"], "array<string>")
    items = F.transform(parts, lambda r, i: _node(n, F.struct(F.lit(None).cast("string").alias("key"), i.alias("index")), i, n["key"], r, F.get(_items(n["v"]), i)))
    return F.when(_fields(n["v"]).isNotNull(), fields).when(_items(n["v"]).isNotNull(), items)


def _node(parent: Column, step: Column, i: Column, key: Column, raw: Column, v: Column) -> Column:
    return F.struct(F.concat(parent["path"], F.array(step)).alias("path"), F.concat(parent["at"], F.array(i)).alias("at"), key.alias("key"), raw.alias("raw"), v.alias("v")).cast(NODE)


def nodes(docs: DataFrame, id_col: str, json_col: str, depth: int = 6) -> DataFrame:
    """(id, path, at, key, in_object, kind, size, raw, deep): the nodes of each payload, parents before children.

    ``path`` has a key or an index for each step, ``at`` the positions of the steps, by which nodes sort
    depth first in the payload's own order; ``key`` is the nearest key above a value. Kinds: object,
    list, string, bool, int, float, null, and broken for a text that isn't JSON (or repeats a key in an object). ``size`` counts
    characters or members. Nodes at ``depth`` are ``deep`` and not looked into. A null payload
    has no nodes. One pass: each level explodes the frontier in place, nothing is shuffled.
    """
    v = F.try_parse_json(json_col)
    raw = F.when(F.schema_of_variant(v) == "STRING", v.cast("string")).otherwise(F.trim(json_col))
    root = F.struct(F.array().cast("array<struct<key:string,index:int>>").alias("path"), F.array().cast("array<int>").alias("at"), F.lit(None).cast("string").alias("key"), raw.alias("raw"), v.alias("v")).cast(NODE)
    tree = docs.where(F.col(json_col).isNotNull()).select(F.col(id_col), root.alias("n"))
    n = F.col("n")
    for level in range(depth):
        below = F.when(F.size(n["at"]) == level, _children(n))
        tree = tree.select(id_col, F.explode(F.concat(F.array(n), F.coalesce(below, F.array().cast(f"array<{NODE}>")))).alias("n"))
    leaf = F.schema_of_variant(n["v"])
    kind = (
        F.when(n["v"].isNull(), "broken").when(_fields(n["v"]).isNotNull(), "object").when(_items(n["v"]).isNotNull(), "list").when(leaf == "STRING", "string")
        .when(leaf == "BOOLEAN", "bool").when(leaf == "VOID", "null").when(n["raw"].rlike("^-?[0-9]+$"), "int").otherwise("float")
    )
    size = F.coalesce(F.size(_fields(n["v"])), F.size(_items(n["v"])), F.length(n["raw"]))
    last = F.get(n["path"], F.size(n["path"]) - 1)
    return tree.select(id_col, n["path"].alias("path"), n["at"].alias("at"), n["key"].alias("key"), F.coalesce(last["index"].isNull() & (F.size(n["path"]) > 0), F.lit(False)).alias("in_object"), kind.alias("kind"), size.alias("size"), n["raw"].alias("raw"), (F.size(n["at"]) == depth).alias("deep"))


def shapes(tree: DataFrame) -> DataFrame:
    """(path, shape, n): what stands at each key path, without content: types, lengths, short hashes. List positions count as one."""
    steps = F.array_join(F.transform("path", lambda p: F.when(p["index"].isNull(), F.concat(F.lit("."), p["key"])).otherwise("[]")), "")
    kind, size = F.col("kind"), F.col("size").cast("string")
    shape = (
        F.when(F.col("deep"), "max_depth").when(kind == "string", F.concat(F.lit("str(len="), size, F.lit(" sha256="), F.substring(F.sha2("raw", 256), 1, 12), F.lit(")")))
        .when(kind == "list", F.concat(F.lit("list(n="), size, F.lit(")"))).when(kind == "object", F.concat(F.lit("dict(keys="), size, F.lit(")"))).otherwise(kind)
    )
    return tree.select(F.coalesce(F.nullif(F.regexp_replace(steps, r"^\.", ""), F.lit("")), F.lit("<root>")).alias("path"), shape.alias("shape")).groupBy("path", "shape").agg(F.count("*").alias("n"))


def strings(tree: DataFrame, id_col: str, echo: Sequence[str] = ECHO_KEYS, skip: Column | None = None) -> DataFrame:
    """(id, rank, text): every string of a payload in its own order, but for empty ones, those under a key that echoes the request, and ``skip``."""
    said = (F.col("kind") == "string") & (F.col("raw") != "") & ~F.coalesce(F.col("key").isin(*echo), F.lit(False))
    if skip is not None:
        said = said & F.coalesce(F.col("raw") != skip, F.lit(True))
    return tree.where(said).select(id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("at")).alias("rank"), F.col("raw").alias("text"))


def provenance(tree: DataFrame, id_col: str, keys: Sequence[str] = PROVENANCE_KEYS) -> DataFrame:
    """(id, rank, source): the sources that a payload names, trimmed, each once where it comes first."""
    named = tree.where((F.col("kind") == "string") & F.col("in_object") & F.col("key").isin(*keys)).select(id_col, F.trim("raw").alias("source"), "at").where("source <> ''")
    first = named.groupBy(id_col, "source").agg(F.min("at").alias("at"))
    return first.select(id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("at")).alias("rank"), "source")
