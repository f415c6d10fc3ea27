"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .common import cut, table
from .components import components
from .hamming import covering_masks, links


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of n words, repeats included."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= n:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in found)]
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], 42) for s, e in zip(starts, ends[n - 1 :], strict=False)), np.uint64, len(found) - n + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; none gives 0."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        count += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row, from its whole text. Null and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(shingle_hashes(t.as_py(), shingle)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, cap: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest
    id reachable over links, the row's own included. Equal fingerprints are one vertex, so
    copies are never paired with each other.

    Null or blank texts have fingerprint 0 and link like any other. Rows with a null id
    keep their row; they lend no id, so a component of such rows alone has a null
    component_id. Repeated rows come back repeated. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, shingle, id_col, text_col))
    unique = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = links(unique.select("fp"), radius, covering_masks(radius), cap)
    roots = components(found).select(F.col("id").alias("fp"), "root")
    # only linked fingerprints need a second look for the smallest id
    linked = roots.join(unique, "fp")
    lowest = linked.groupBy("root").agg(F.min("low").alias("lowest"))
    named = roots.join(lowest, "root").select("fp", "lowest")
    component = unique.join(named, "fp", "left").select("fp", F.coalesce("lowest", "low").alias("component_id"))
    return fps.join(component, "fp").select("doc_id", "fp", "component_id")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: 4-word shingles, radius 4."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
