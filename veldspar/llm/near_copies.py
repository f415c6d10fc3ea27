"""Near copies at a stated shingle similarity: SimHash and MinHash candidates, exact Jaccard in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import minhash
from .common import cut
from .components import components
from .hamming import covering_masks, links, majority, mixed

#: Fingerprints of a text's distinct words; members of a verified block; candidates broadcast at once.
PRINTS, BLOCK, KEYS = 2, 128, 1_000_000
#: Characters that are hashed at once, unless a text has more; words whose hashes a task remembers.
CHARS, WORDS = 200_000, 200_000
#: Places of a MinHash band, and bands: at 0.8 all of them miss a pair once in 4,600.
ROWS, BANDS = 4, 16
#: Cells of the incidence matrix that a block pair may take; beyond it pairs are intersected one by one.
CELLS = 30_000_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Hashes(dict):
    """XXH64 of words, each computed once as long as it is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 1)
        return h


def word_hashes(texts: list[str | None], known: _Hashes) -> list[np.ndarray]:
    """Hashes of the words of each text, in order."""
    split = [t.encode().lower().split() if t else [] for t in texts]
    return [np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) for words in split]


def shingle_sets(words: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of ``n`` words of each text; a shorter text is one shingle, an empty one none."""
    every, out, start = np.concatenate([*words, np.empty(0, np.uint64)]), [], 0
    folded = np.zeros(max(len(every) - n + 1, 0), np.uint64)
    for j in range(n):
        folded = mixed(folded * np.uint64(5) + every[j : j + len(folded)])
    for own in words:
        if len(own) >= n:
            out.append(np.unique(folded[start : start + len(own) - n + 1]))
        else:
            one = np.zeros(min(len(own), 1), np.uint64)
            for j in range(len(own)):
                one = mixed(one * np.uint64(5) + own[j : j + 1])
            out.append(one)
        start += len(own)
    return out


def shingle_set(text: str | None, n: int) -> np.ndarray:
    return shingle_sets(word_hashes([text], _Hashes()), n)[0]


def _parts(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``b`` in slices of about CHARS bytes of the text in ``column``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < b.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARS, "right")))
        yield b.slice(at, upto - at)
        at = upto


def _prints(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) and the text's hash to (doc_id, text_hash, tkey, f0, f1, sig): a hash of the shingle set, SimHashes of the distinct words and
    the MinHash signature of the shingle set, null for the empty set."""
    known = _Hashes()
    for whole in batches:
        for b in _parts(whole, 1):
            words = word_hashes(b.column(1).to_pylist(), known)
            sets = shingle_sets(words, n)
            keys = [_signed(xxhash.xxh64_intdigest(s.tobytes(), 3)) for s in sets]
            filled = [i for i, s in enumerate(sets) if len(s)]
            prints, sigs = np.zeros((PRINTS, len(sets)), np.int64), [None] * len(sets)
            if filled:
                sizes = np.array([len(sets[i]) for i in filled])
                for i, sig in zip(filled, minhash.signatures(np.concatenate([sets[i] for i in filled]), sizes, ROWS * BANDS), strict=True):
                    sigs[i] = sig.tobytes()
                own = [np.unique(words[i]) for i in filled]
                h, sizes = np.concatenate(own), np.array([len(x) for x in own])
                for k in range(PRINTS):
                    prints[k, filled] = majority(h, sizes)
                    h = mixed(h)
            cols = [pa.array(keys, pa.int64()), *(pa.array(p) for p in prints), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], names=["doc_id", "text_hash", "tkey", "f0", "f1", "sig"])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(tkey, root, blocks, text) to (tkey, root, blocks, hashes), for the texts that have the key."""
    known = _Hashes()
    for whole in batches:
        for b in _parts(whole, 3):
            rows = []
            *heads, texts = (b.column(i).to_pylist() for i in range(4))
            for key, root, blocks, h in zip(*heads, shingle_sets(word_hashes(texts, known), n), strict=True):
                if _signed(xxhash.xxh64_intdigest(h.tobytes(), 3)) == key:
                    rows.append((key, root, blocks, h.view(np.int64)))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(cols, names=["tkey", "root", "blocks", "hashes"])


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Boolean matrix: Jaccard similarity of two sets is at least ``similarity``."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    if m * len(every) <= CELLS:
        x = np.zeros((m, len(every)), np.float32)
        x[np.repeat(np.arange(m), sizes), at] = 1
        both = x @ x.T
    else:
        both = np.zeros((m, m))
        for i in range(m):
            near = np.flatnonzero(np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]))
            for j in near[near > i]:
                both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    return both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9


def _forest(keys: list[int], near: np.ndarray) -> list[tuple[int, int]]:
    out, rest = [], np.ones(len(keys), bool)
    for start in range(len(keys)):
        if not rest[start]:
            continue
        rest[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(near[i] & rest):
                rest[j] = False
                out.append((keys[i], keys[int(j)]))
                todo.append(int(j))
    return out


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (root, lo, hi, tkey, hashes) sorted by their first three: links of each block pair."""
    own: list[tuple] = []
    last = None

    def done() -> pa.RecordBatch:
        found = _forest([r[0] for r in own], similar([r[1] for r in own], similarity)) if len(own) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for b in batches:
        heads = list(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
        for k, (root, lo, hi, key) in enumerate(heads):
            if (root, lo, hi) != last and own:
                yield done()
                own = []
            last = (root, lo, hi)
            own.append((key, b.column(4)[k].values.to_numpy(zero_copy_only=False)))
    if own:
        yield done()


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 4, cap: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id, text_hash, group): one row for each row of ``docs``; component_id is the smallest id reachable.

    ``group`` tells groups apart where ids repeat or are null.

    Texts link if the Jaccard similarity of their sets of ``shingle``-word shingles is at
    least ``similarity``. Candidates are texts whose SimHashes of distinct words, one or the
    other of two, are connected at ``radius`` or fewer differing bits (covering masks find
    all of these), and texts whose MinHash signatures of the shingle set share a band,
    whatever was appended, cut or edited. Each candidate group is then verified exactly,
    block against block, and only a spanning forest of its links is kept. The bands are set
    for 0.8 and above; the README gives the recall.

    Null and blank texts have the empty set and are copies of each other. Rows with a null id
    keep their row and lend no id; texts that only such rows have are compared as copies
    only. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("text_hash"))
    prints = cut(own.mapInArrow(lambda it: _prints(it, shingle), "doc_id bigint, text_hash bigint, tkey bigint, f0 bigint, f1 bigint, sig binary"))
    unique = cut(prints.groupBy("tkey").agg(F.min("doc_id").alias("low"), F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.first("sig").alias("sig")))
    signed = unique.where("sig is not null").select(F.col("tkey").alias("id"), "sig")
    edges = minhash.links(signed, ROWS, minhash.least_agreement(ROWS * BANDS, similarity), cap)
    for j in range(PRINTS):
        node = lambda c, j=j: F.xxhash64(F.lit(j), c)
        fp = unique.select("tkey", F.col(f"f{j}").alias("fp"))
        near = cut(links(fp.select("fp").distinct(), radius, covering_masks(radius, seed=7 + j), cap))
        met = near.select(F.explode(F.array("a", "b")).alias("fp")).unionByName(fp.groupBy("fp").count().where("count > 1").select("fp")).distinct()
        part = near.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")).unionByName(fp.join(met, "fp").select(F.col("tkey").alias("a"), node(F.col("fp")).alias("b")))
        edges = edges.unionByName(part)
    roots = components(edges).select(F.col("id").alias("tkey"), "root")
    named = roots.join(unique.where("low is not null").select("tkey", "low"), "tkey")
    sizes = named.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    some = cut(named.join(sizes, "root"))
    few = some.count() <= KEYS
    texts = own.join(F.broadcast(some) if few else some, F.col("doc_id") == F.col("low")).select("tkey", "root", "blocks", "text")
    sets = texts.mapInArrow(lambda it: _sets(it, shingle), "tkey bigint, root bigint, blocks int, hashes array<bigint>").withColumn("block", F.pmod("tkey", F.col("blocks")).cast("int"))
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "tkey", "hashes")
    found = pairs.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(lambda it: _verify(it, similarity), "a bigint, b bigint")
    linked = components(cut(found)).select(F.col("id").alias("tkey"), "root").join(unique.select("tkey", "low"), "tkey")
    lowest = linked.groupBy("root").agg(F.min("low").alias("lowest"))
    named = linked.join(lowest, "root").select("tkey", "lowest", "root")
    settled = unique.join(named, "tkey", "left").select("tkey", F.coalesce("lowest", "low").alias("component_id"), F.coalesce("root", "tkey").alias("group"))
    return prints.join(settled, "tkey").select("doc_id", "component_id", "text_hash", "group")
