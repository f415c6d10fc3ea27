"""Fuzzy line deduplication: SimHash of normalised lines on pigeonhole blocks and MinHash bands, edit similarity, connected groups."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from . import minhash
from .common import cut, keep, table
from .components import components
from .hamming import LINK, _search, block_masks, bucket_links, links, majority, mixed, signed

MIN_WORDS, RADIUS, SIMILARITY = 4, 3, 0.9
#: Places of a MinHash band of a line's words, bands, and the bits in which SimHashes that meet in a band may differ.
ROWS, BANDS, APART = 4, 12, 22
#: Words of fewer bytes count together with the word after them.
SHORT = 4
#: Members of a bucket, lines of a block that is verified at once, candidate keys that are broadcast.
CAP, BLOCK, KEYS = 16384, 256, 1_000_000
#: Pairs and lines that are compared at once.
PAIRS, LINES = 4000, 10_000
#: Edits within which all pairs are tried first, pairs for each word of a band from which they share steps, words of a table of characters.
NARROW, FEW, CELLS = 40, 32, 1 << 22
#: Lines that are dealt at once, entries of buckets that a task holds before it sends large buckets on.
DEALT, HELD = 50_000, 4_000_000
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


#: ASCII at once: lower case, anything but letters, digits and line ends as a space.
PLAIN = bytes(ord(chr(c).lower()) if chr(c).isalnum() and c < 128 or c == 10 else 32 for c in range(256))
#: Ideographs and kana: each counts as a word.
CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")


@cache
def _plain_codes(n: int) -> np.ndarray:
    """Of each code point below n: itself in lower case if that is a letter, a digit or a line end, else a space."""
    low = (chr(c).lower() for c in range(n))
    return np.array([ord(x) if len(x) == 1 and x.isalnum() or x == "\n" else 32 for x in low], np.uint32)


def normal(text: str) -> str:
    """Lower case, anything but letters and digits as one space, ideographs and kana as words; lines stay lines."""
    if text.isascii():
        plain = text.encode().translate(PLAIN).decode()
    else:
        if "\u0130" in text or "\u03a3" in text:
            text = text.lower()  # becomes two characters, or depends on its neighbours
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        top = code.max()
        plain = _plain_codes(0x3040 if top < 0x3040 else 0x110000)[code].tobytes().decode("utf-32-le", "surrogatepass")
        if top >= 0x3040:
            plain = CJK.sub(r" \g<0> ", plain)
    while "  " in plain:
        plain = plain.replace("  ", " ")
    return plain


def lines_of(text: str | None, min_words: int, short: bool) -> Iterator[tuple[int, int, str | None]]:
    """(place, key, line) of the lines that take part; the key is a hash of the normalised line.

    Lines of fewer than ``min_words`` words take part if ``short`` is set, without a line: their
    key is that of exactly their words, or marks.
    """
    for pos, (plain, raw) in enumerate(zip(normal(text).split("\n"), text.split("\n"), strict=True) if text else ()):
        line = plain.strip(" ")
        if line.count(" ") >= min_words - 1:
            yield pos, signed(xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))), line
        elif short and (line or raw.strip()):
            yield pos, signed(xxhash.xxh64_intdigest((line or raw.strip()).encode("utf-8", "surrogatepass"), 1)), None


def features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): one 64-bit hash for each word of the normalised lines, and the number of words of each line.

    A word of fewer than SHORT bytes is hashed with the word after it, so that "of", "the" and
    single ideographs don't make unlike lines meet. A word is told by its length and its first
    and last eight bytes; all words of a chunk are hashed at once.
    """
    whole = ("\n".join(lines) + "\n").encode("utf-8", "surrogatepass") + b"\0" * 8
    byte = np.frombuffer(whole, np.uint8)[:-8]
    eight = np.ndarray(len(byte), "<u8", whole, strides=(1,))  # the eight bytes from each place on
    ends = np.flatnonzero((byte == 32) | (byte == 10))
    starts = np.r_[0, ends[:-1] + 1]
    length = ends - starts
    tail = np.where(length > 8, eight[np.maximum(ends - 8, 0)], np.uint64(0))
    h = mixed((eight[starts] & KEEP[np.minimum(length, 8)]) + mixed(tail + length.astype(np.uint64)))
    last = byte[ends] == 10
    joined = (length < SHORT) & ~last
    h[joined] = mixed(h[joined] * np.uint64(3) + h[np.flatnonzero(joined) + 1])
    return h, np.diff(np.r_[-1, np.flatnonzero(last)])


def prints(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(SimHash, BANDS band values of 32 bits) of each line."""
    h, sizes = features(lines)
    sig = minhash.signatures(h, sizes, ROWS * BANDS).astype(np.uint64)
    band = np.zeros((len(lines), BANDS), np.uint64)
    for j in range(ROWS):
        band = mixed(band * np.uint64(5) + sig[:, j::ROWS] + np.uint64(1))
    return majority(h, sizes), (band >> np.uint64(32)).astype(np.uint32)


def _simhash(batches: Iterator[pa.RecordBatch], min_words: int, short: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, doc, text) to (doc_id, doc, pos, key, fp, bands), a row for each line that takes part.

    The last two are null for short lines, and where the task gave them for the key before.
    """
    given: set[int] = set()
    for b in batches:
        if len(given) > 2_000_000:
            given.clear()
        row, pos, keys, fresh, lines = [], [], [], [], []
        for i, text in enumerate(b.column(2)):
            for at, key, line in lines_of(text.as_py(), min_words, short):
                if line is not None and key not in given:
                    given.add(key)
                    fresh.append(len(keys))
                    lines.append(line)
                row.append(i)
                pos.append(at)
                keys.append(key)
        fps, bands = np.zeros(len(keys), np.int64), [None] * len(keys)
        for at in range(0, len(lines), 1000):
            fp, band = prints(lines[at : at + 1000])
            for i, f, x in zip(fresh[at : at + 1000], fp, band, strict=True):
                fps[i], bands[i] = f, x.tobytes()
        there = np.zeros(len(keys), bool)
        there[fresh] = True
        of = pa.array(row, pa.int64())
        cols = [b.column(0).take(of), b.column(1).take(of), pa.array(pos, pa.int32()), pa.array(keys, pa.int64()), pa.array(fps, mask=~there), pa.array(bands, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "doc", "pos", "key", "fp", "bands"])


def _deal(batches: Iterator[pa.RecordBatch], radius: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(fp, bands) to (part, level, packed): of each band (level 0) and pigeonhole block (1), the bucket and the SimHash, packed for each part of the buckets."""
    masks = np.array([signed(m) for m in block_masks(radius)])
    held: list[tuple[np.ndarray, bytes]] = []

    def dealt() -> pa.RecordBatch:
        fp = np.concatenate([x for x, _ in held])
        band = np.frombuffer(b"".join(x for _, x in held), np.uint32).reshape(len(fp), BANDS)
        rows = []
        for level, key in enumerate([band.astype(np.int64) + (np.arange(BANDS) << 32), (fp[:, None] & masks) ^ (np.arange(len(masks)) << 8)]):
            key, own = mixed(key.ravel().view(np.uint64)), np.repeat(fp, key.shape[1])
            part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            key, own, part = key[order], own[order], part[order]
            ends = np.flatnonzero(np.r_[part[1:] != part[:-1], True]) + 1
            rows += [(part[e - 1], level, key[s:e].tobytes() + own[s:e].tobytes()) for s, e in zip(np.r_[0, ends[:-1]], ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "level", "packed"])

    for b in batches:
        if b.num_rows:
            held.append((b.column(0).to_numpy(zero_copy_only=False), b"".join(b.column(1).to_pylist())))
        if sum(len(x) for x, _ in held) >= DEALT:
            yield dealt()
            held = []
    if held:
        yield dealt()


def _meet(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Packed buckets to (level, key, a, b) as ``hamming._search`` gives them: links as level -1, members of buckets above CAP as they came."""
    held: list[list[np.ndarray]] = [[], []]
    full = [np.empty(0, np.int64)] * 2  # buckets that were above CAP before

    def over(level: int, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), level), pa.int32()), pa.array(key), pa.array(fp), pa.array(fp)], schema=LINK)

    def shrunk(level: int) -> Iterator[pa.RecordBatch]:
        """Leaves no bucket above CAP and no repeated row."""
        key, fp = np.concatenate(held[level], axis=1)
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])]
        key, fp = key[new], fp[new]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        full[level] = np.union1d(full[level], key[starts[sizes > CAP]])
        gone = np.isin(key, full[level])
        if gone.any():
            yield over(level, key[gone], fp[gone])
        held[level] = [np.stack([key[~gone], fp[~gone]])]

    for b in batches:
        for level, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            held[level].append(np.frombuffer(x, np.int64).reshape(2, -1))
        for level in (0, 1):
            if sum(x.shape[1] for x in held[level]) > HELD:
                yield from shrunk(level)
    for level in (0, 1):
        if not held[level]:
            continue
        key, fp = np.concatenate(held[level], axis=1)
        held[level] = []
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        several = np.r_[same, False] | np.r_[False, same]
        if not several.any():
            continue
        held[level] = [np.stack([key[several], fp[order[several]]])]
        yield from shrunk(level)
        key, fp = held[level].pop()
        rows = (pa.RecordBatch.from_arrays([pa.array(np.full(len(key[at : at + 10_000]), level), pa.int32()), pa.array(key[at : at + 10_000]), pa.array(fp[at : at + 10_000])], names=["level", "key", "fp"]) for at in range(0, len(key), 10_000))
        yield from _search(rows, (APART, radius)[level], CAP)


def _candidates(signs: DataFrame, radius: int) -> DataFrame:
    """(a, b): links of SimHashes that differ in at most ``radius`` bits, or share a band and differ in at most APART. ``signs`` has fp and bands.

    Buckets above CAP are searched by ``bucket_links`` and ``links``, so none of their links is lost.
    """
    parts = max(256, 4 * int(signs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = signs.mapInArrow(lambda it: _deal(it, radius, parts), "part int, level int, packed binary")
    result = cut(dealt.repartition("part").mapInArrow(lambda it: _meet(it, radius), "level int, key bigint, a bigint, b bigint"))
    near = result.where("level = -1").select("a", "b")
    over = [result.where(F.col("level") == level).select("key", F.col("a").alias("fp")) for level in (0, 1)]
    large = {r.level for r in result.where("level >= 0").select("level").distinct().collect()}
    if 0 in large:
        near = near.unionByName(bucket_links(over[0], APART, CAP))
    if 1 in large:
        near = near.unionByName(links(over[1].select("fp").distinct(), radius, block_masks(radius), CAP))
    return near.where("a <> b").distinct()


def cells_of(lines: list[str], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of each line, and the keys of its bands and pigeonhole blocks."""
    masks = np.array([signed(m) for m in block_masks(radius)])
    fp, band = prints(lines)
    return fp.view(np.uint64), np.concatenate([band.astype(np.int64) + (np.arange(BANDS) << 32), (fp[:, None] & masks) ^ (np.arange(len(masks)) << 8) ^ (1 << 40)], axis=1)


def _cells(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """(set, line) to (cell, nth, set, line): one row for each band and each pigeonhole block of the line, and its number."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            _, cell = cells_of(part.column(1).to_pylist(), radius)
            of = pa.array(np.repeat(np.arange(len(cell)), cell.shape[1]))
            nth = pa.array(np.tile(np.arange(cell.shape[1], dtype=np.int32), len(cell)))
            yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), nth, part.column(0).take(of), part.column(1).take(of)], names=["cell", "nth", "set", "line"])


def edit_similarity(a: str, b: str, most: int | None = None) -> float:
    """1 - Levenshtein distance / longer length; two empty strings give 1. Given ``most`` edits, only which side of it is right."""
    if len(a) < len(b):
        a, b = b, a
    if not a:
        return 1.0
    longest = len(a)
    # what both begin and end with costs nothing
    lo = _shared(a, b, len(b), True)
    a, b = a[lo:], b[lo:]
    hi = _shared(a, b, len(b), False)
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    if not b:
        return 1 - len(a) / longest
    if most is not None and len(a) <= most:
        return 1 - len(a) / longest  # an upper bound is enough
    return 1 - (_distance(a, b, len(a) if most is None else most) if b else len(a)) / longest


def _distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or any number above ``most`` if it is above; as ``_bits``, one pair. ``a`` is no shorter than ``b``."""
    more = len(a) - len(b)
    if more > most:
        return most + 1
    up, low = (most + more) // 2, (most - more) // 2
    top, full = 1 << up + low, (2 << up + low) - 1
    # of each character the band's bits at the step of its last use
    eqs: dict[str, tuple[int, int]] = {}
    for q, c in enumerate(a[:up]):
        eqs[c] = (eqs.get(c, (0, 0))[0] | 1 << low + q, 0)
    vp, vn, met, place, n = full >> low << low, 0, 0, low + more, len(a) - up
    for i, c in enumerate(b):
        if i < n:
            x = a[i + up]
            bits, at = eqs.get(x, (0, i))
            eqs[x] = (bits >> i - at | top, i)
        bits, at = eqs.get(c, (0, i))
        eq = bits >> i - at
        d = ((eq & vp) + vp ^ vp | eq | vn) & full
        hp = vn | (d | vp) ^ full
        met += d >> place & 1
        if more + i + 1 - met > most:
            return most + 1
        hn, d = d & vp, d >> 1
        vp, vn = hn | (d | hp) ^ full, d & hp
    return more + len(b) - met


def _in_place(a: str, b: str, similarity: float) -> bool | None:
    """Whether two lines are similar enough, as far as lengths and words changed in place tell."""
    most = _most(a, b, similarity)
    if abs(len(a) - len(b)) > most:
        return False
    left, right = a.split(" "), b.split(" ")
    if len(left) == len(right) and sum(max(len(x), len(y)) for x, y in zip(left, right, strict=True) if x != y) <= most:
        return True
    return None


def _most(a: str, b: str, similarity: float) -> int:
    return math.floor((1 - similarity) * max(len(a), len(b)) + 1e-9)


def alike(a: str, b: str, similarity: float) -> bool:
    """Whether the edit similarity is at least ``similarity``."""
    said = _in_place(a, b, similarity)
    return edit_similarity(a, b, _most(a, b, similarity)) >= similarity - 1e-9 if said is None else said


def distances(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """Levenshtein distance of each pair, or any number above its ``most`` if it is above; many pairs at a time.

    All are tried within NARROW edits first, which one word holds; what is above goes on to its own bound.
    """
    out = _within(pairs, np.minimum(most, NARROW))
    rest = np.flatnonzero((out > NARROW) & (most > NARROW))
    out[rest] = _within([pairs[p] for p in rest], most[rest])
    return out


def _within(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """As ``distances``: pairs of like lengths and bounds together, few or wide ones one by one."""
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    size, longer = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
    out = np.where(size == 0, longer, most + 1)
    order = np.flatnonzero((size > 0) & (longer - size <= most))
    words = 3 * most // 128 + 1
    order = order[np.lexsort((size[order], words[order]))]
    while len(order):
        at = order[: int(np.argmin(np.r_[(size[order] <= 1.5 * size[order[0]] + 32) & (words[order] == words[order[0]]), False]))]
        if len(at) >= FEW * words[at[0]]:
            code = np.frombuffer("".join([pairs[p][k] for k in (0, 1) for p in at]).encode("utf-32-le", "surrogatepass"), np.uint32)
            seen = np.zeros(int(code.max()) + 1, bool)
            seen[code] = True
            kinds = int(seen.sum())
            n = CELLS // ((kinds + 1) * (int(longer[at].max()) // 64 + words[at[0]] + 2))
            if n >= len(at):
                out[at] = _bits((np.cumsum(seen) - 1)[code], kinds, size[at], longer[at], most[at])
                order = order[len(at) :]
                continue
            at = at[: max(n // 2, 1)]
            if n // 2 >= FEW * words[at[0]]:
                out[at] = _within([pairs[p] for p in at], most[at])
                order = order[len(at) :]
                continue
        out[at] = [_distance(pairs[p][1], pairs[p][0], int(most[p])) for p in at]
        order = order[len(at) :]
    return out


def _rows(code: np.ndarray, size: np.ndarray, fill: int) -> np.ndarray:
    out = np.full((len(size), int(size.max())), fill)
    out[np.arange(out.shape[1]) < size[:, None]] = code
    return out


def _bits(code: np.ndarray, kinds: int, size: np.ndarray, longer: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bit vectors of a band around the diagonal (Hyyro, 2003), a step for each character of the shorter lines, all pairs at once.

    ``code`` has the characters of the shorter lines, then of the longer ones, numbered from 0. An alignment of d edits
    whose lines differ by k in length stays within (d + k) / 2 diagonals above and (d - k) / 2 below the first. The
    cells of the last diagonal grow by 0 or 1 a step; a pair above its ``most`` there ends.
    """
    more, cut_ = longer - size, int(size.sum())
    up, down = int(((most + more) // 2).max()), int(((most - more) // 2).max())
    words = (up + down) // 64 + 1
    low = 64 * words - 1 - up  # the bit of the main diagonal
    # bit q + low of a pair and character: whether it is the q-th of the longer line
    base = np.arange(len(size))[:, None] * (kinds + 1)
    text, other = _rows(code[:cut_], size, kinds) + base, _rows(code[cut_:], longer, kinds) + base
    table = np.zeros(((max(text.shape[1] + 64 * words, other.shape[1] + low) >> 6) + 2, len(size) * (kinds + 1)), np.uint64)
    flat = table.reshape(-1)
    for j in range(min(64, other.shape[1])):
        q = np.arange(j, other.shape[1], 64) + low
        flat[other[:, j::64] + (q >> 6) * table.shape[1]] |= np.uint64(1 << (j + low & 63))
    text = np.ascontiguousarray(text.T)
    start = (1 << 64 * words) - (1 << low)
    vp = np.repeat(np.array([[start >> 64 * w & (1 << 64) - 1] for w in range(words)], np.uint64), len(size), axis=1)
    vn, met, one = np.zeros_like(vp), np.zeros(len(size), np.uint64), np.uint64(1)
    word, bit = low + more >> 6, (low + more & 63).astype(np.uint64)
    own, out, stops, begun = np.arange(len(size)), most + 1, set(size.tolist()), 0
    for i in range(int(size.max())):
        part = table[i >> 6 : (i >> 6) + words + 1].take(text[i - begun], axis=1)
        eq = part[:-1]
        if i & 63:
            eq = eq >> np.uint64(i & 63)
            eq |= part[1:] << np.uint64(64 - (i & 63))
        d = eq & vp
        carry = None
        for x, v in zip(d, vp, strict=True):
            x += v
            if words > 1:
                over = x < v
                if carry is not None:
                    x += carry
                    over |= x < carry
                carry = over.astype(np.uint64)
        d ^= vp
        d |= eq
        d |= vn
        hp = d | vp
        np.invert(hp, out=hp)
        hp |= vn
        vp &= d
        met += (d[0] if words == 1 else d[word, np.arange(len(own))]) >> bit & one
        down_ = d >> one
        if words > 1:
            down_[:-1] |= d[1:] << np.uint64(63)
        np.bitwise_and(down_, hp, out=vn)
        down_ |= hp
        np.invert(down_, out=down_)
        vp |= down_
        if i + 1 in stops:
            done = np.flatnonzero(size[own] == i + 1)
            out[own[done]] = more[own[done]] + (i + 1) - met[done].astype(np.int64)
        if i % 32 == 31:
            alive = (size[own] > i + 1) & (more[own] + (i + 1) - met.astype(np.int64) <= most[own])
            if not alive.any():
                break
            if alive.sum() < 0.8 * len(own):
                own, vp, vn, met, word, bit = own[alive], vp[:, alive], vn[:, alive], met[alive], word[alive], bit[alive]
                text, begun = text[i + 1 - begun :, alive], i + 1
    return out


def all_alike(pairs: list[tuple[str, str]], similarity: float) -> list[bool]:
    """``alike`` of many pairs at once."""
    said = [_in_place(a, b, similarity) for a, b in pairs]
    rest = [p for p, s in enumerate(said) if s is None]
    cut_ = []
    for a, b in (pairs[p] for p in rest):
        lo = _shared(a, b, min(len(a), len(b)), True)
        hi = _shared(a[lo:], b[lo:], min(len(a), len(b)) - lo, False)
        cut_.append((a[lo : len(a) - hi], b[lo : len(b) - hi]))
    most = np.array([_most(*pairs[p], similarity) for p in rest], np.int64)
    for p, d, x in zip(rest, distances(cut_, most), most, strict=True):
        said[p] = bool(d <= x)
    return said


def _shared(a: str, b: str, most: int, front: bool) -> int:
    """Length of the longest common start, or end."""
    low = 0
    while low < most:
        mid = (low + most + 1) // 2
        if a[:mid] == b[:mid] if front else a[len(a) - mid :] == b[len(b) - mid :]:
            low = mid
        else:
            most = mid - 1
    return low


def _bags(lines: list[str]) -> np.ndarray:
    """Counts of characters in 64 bins, doubled, and of character pairs in 256 bins; one row for each line."""
    out = np.zeros((len(lines), 320), np.int32)
    for at in range(0, len(lines), 500):
        part = lines[at : at + 500]
        c = np.frombuffer("\n".join([*part, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.flatnonzero(c == 10)
        of = np.repeat(np.arange(len(part)), np.diff(np.r_[-1, ends]))
        # a line's end, and the pair that it closes, aren't counted
        own = c != 10
        out[at : at + 500, :64] = 2 * np.bincount((of * 64 + (c & np.uint32(63)))[own], minlength=64 * len(part)).reshape(-1, 64)
        two = (c[:-1] * np.uint32(2654435761) + c[1:]) >> np.uint32(3) & np.uint32(255)
        out[at : at + 500, 64:] = np.bincount((of[:-1] * 256 + two)[own[:-1] & own[1:]], minlength=256 * len(part)).reshape(-1, 256)
    return out


def _near(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """False where bags rule a similarity out: an edit brings in one character and two pairs at most, and takes out as many."""
    apart, most = a - b, 2 * (1 - similarity) * sizes + 2e-3
    fine = np.ones(len(sizes), bool)
    for part in (apart[:, :64], apart[:, 64:]):
        fine &= (np.maximum(part, 0).sum(1) <= most) & (np.maximum(-part, 0).sum(1) <= most)
    return fine


def _verified(lines: list[str], prepared: tuple[np.ndarray, np.ndarray, np.ndarray], sets: np.ndarray, sides: np.ndarray, nth: int, similarity: float, out: list[tuple[int, int]]) -> Iterator[list[tuple[str, str]]]:
    """Fills ``out``, see ``verified``; yields pairs of lines and is sent whether they are alike."""
    label = sets.copy()
    fp, cell, bags = prepared
    sizes = np.array([len(x) for x in lines])
    right = np.flatnonzero(sides != 0)
    for at in range(0, len(lines), BLOCK):
        left = at + np.flatnonzero(sides[at : at + BLOCK] != 1)
        fine = (label[left, None] != label[right]) & ((sides[left, None] == 0) | (left[:, None] < right))
        fine &= np.bitwise_count(fp[left, None] ^ fp[right]) <= APART
        i, j = (x[y] for x, y in zip((left, right), np.nonzero(fine), strict=True))
        shared = cell[i] == cell[j]
        met = shared[:, nth:].any(1) & ~shared[:, :nth].any(1)
        i, j = i[met], j[met]
        near = [_near(bags[x], bags[y], np.maximum(sizes[x], sizes[y]), similarity) for x, y in ((i[k : k + PAIRS], j[k : k + PAIRS]) for k in range(0, len(i), PAIRS))]
        asked = np.flatnonzero(np.concatenate(near)) if near else np.empty(0, int)
        while len(asked):
            now, asked = asked[:PAIRS], asked[PAIRS:]
            for x, y, same in zip(i[now].tolist(), j[now].tolist(), (yield [(lines[x], lines[y]) for x, y in zip(i[now], j[now], strict=True)]), strict=True):
                if same and label[x] != label[y]:
                    out.append((x, y))
                    label[label == label[y]] = label[x]
            asked = asked[label[i[asked]] != label[j[asked]]]


def verified(groups: list[tuple[list[str], np.ndarray, np.ndarray, int]], radius: int, similarity: float) -> list[list[tuple[int, int]]]:
    """Of each group, positions of lines that are similar enough and join different sets, as few as join them.

    A group has lines, their sets and sides, and nth. Sides tell which lines are compared: 0 with 1, 2 with 2.
    Only candidates are: lines whose SimHashes differ in at most APART bits and that share a cell, none before
    the ``nth``. Distances of all groups are told together.
    """
    every = [x for lines, *_ in groups for x in lines]
    fp, cell = cells_of(every, radius)
    bags, ends = _bags(every), np.cumsum([len(lines) for lines, *_ in groups])
    out: list[list[tuple[int, int]]] = [[] for _ in groups]
    open_, answers = [], []
    for (lines, sets, sides, nth), found, end in zip(groups, out, ends, strict=True):
        part = slice(end - len(lines), end)
        open_.append(_verified(lines, (fp[part], cell[part], bags[part]), sets, sides, nth, similarity, found))
        answers.append(None)
    while open_:
        more, asked = [], []
        for g, said in zip(open_, answers, strict=True):
            try:
                asked.append(g.send(said))
                more.append(g)
            except StopIteration:
                pass
        same = iter(all_alike([p for x in asked for p in x], similarity))
        open_, answers = more, [[next(same) for _ in x] for x in asked]
    return out


def _verify(batches: Iterator[pa.RecordBatch], radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (pair, side, set, line, nth) sorted by pair: links (a, b) between the sets of each pair of blocks.

    In the nth cell of its lines, a pair that met in an earlier one is passed over.
    """
    own, last, held, n = [], None, [], 0

    def done() -> pa.RecordBatch:
        found = verified([([r[3] for r in g], np.array([r[2] for r in g]), np.array([r[1] for r in g]), g[0][4]) for g in held], radius, similarity)
        return pa.RecordBatch.from_arrays([pa.array([g[x[k]][2] for g, f in zip(held, found, strict=True) for x in f], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if row[0] != last and own:
                held.append(own)
                n += len(own)
                own = []
                if n >= LINES:
                    yield done()
                    held, n = [], 0
            last = row[0]
            own.append(row)
    if own:
        held.append(own)
        yield done()


def _similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b, line, other) to (a, b, same): whether the two lines are similar enough."""
    for b in batches:
        for at in range(0, b.num_rows, LINES):
            part = b.slice(at, LINES)
            pairs = list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
            same = [_in_place(x, y, similarity) for x, y in pairs]
            rest = [i for i, s in enumerate(same) if s is None]
            if rest:
                left, right = zip(*(pairs[i] for i in rest), strict=True)
                near = _near(_bags(left), _bags(right), np.array([max(len(x), len(y)) for x, y in zip(left, right, strict=True)]), similarity)
                some = [i for i, n in zip(rest, near, strict=True) if n]
                said = dict(zip(some, all_alike([pairs[i] for i in some], similarity), strict=True))
                for i in rest:
                    same[i] = said.get(i, False)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(same, pa.bool_())], names=["a", "b", "same"])


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, raw), all of a key in one task, to (key, line): one normalised line for each key."""
    seen: set[int] = set()
    for b in batches:
        keys = b.column(0).to_pylist()
        own = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), pa.array([normal(b.column(1)[i].as_py()).strip() for i in own], pa.string())], names=["key", "line"])


def _between(members: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(a, b): similar lines of different sets. ``members`` has (group, set, key, line); groups hold several sets.

    A group of up to BLOCK lines is one cell. Lines of larger groups are compared in each band
    and pigeonhole block in which they met. A cell is cut into blocks of BLOCK lines, a set of
    more lines into blocks of its own, and only blocks that hold different sets are paired:
    one large set and a few other lines take work in proportion to the set.
    """
    counted = keep(members.join(members.groupBy("group").agg(F.count("*").alias("n")), "group"))
    cells = counted.where(F.col("n") <= BLOCK).select(F.col("group").alias("cell"), F.lit(0).alias("nth"), "set", "line")
    if not counted.where(F.col("n") > BLOCK).isEmpty():
        dealt = counted.where(F.col("n") > BLOCK).select("set", "line").mapInArrow(lambda it: _cells(it, radius), "cell bigint, nth int, set bigint, line string")
        cells = cells.unionByName(dealt)
    cells = keep(cells)
    parts = cells.groupBy("cell", "set").agg(F.count("*").alias("n")).withColumn("own", F.when(F.col("n") > BLOCK, F.col("set")))
    shared = parts.groupBy("cell").agg(F.coalesce(F.sum(F.when(F.col("own").isNull(), F.col("n"))), F.lit(0)).alias("rest"), F.count("*").alias("sets")).where("sets > 1")
    parts = parts.join(shared, "cell").select("cell", "set", "own", F.ceil(F.when(F.col("own").isNull(), F.col("rest")).otherwise(F.col("n")) / BLOCK).alias("blocks"))
    spread = F.when(F.col("own").isNull(), F.xxhash64("set")).otherwise(F.xxhash64("line"))
    placed = keep(cells.join(parts, ["cell", "set"]).select("cell", "nth", "set", "line", "own", F.pmod(spread, F.col("blocks")).alias("block")))
    blocks = placed.select("cell", "own", "block").distinct().withColumn("name", F.xxhash64("own", "block"))
    other = blocks.select(F.col("cell").alias("_cell"), F.col("own").alias("_own"), F.col("name").alias("_name"))
    met = blocks.join(other, (F.col("cell") == F.col("_cell")) & (F.col("name") <= F.col("_name")) & ~F.coalesce(F.col("own") == F.col("_own"), F.lit(False)))
    pair, alone = F.xxhash64("cell", "name", "_name"), F.col("name") == F.col("_name")
    sides = F.when(alone, F.array(F.struct(F.col("name").alias("name"), F.lit(2).alias("side")))).otherwise(F.array(F.struct(F.col("name").alias("name"), F.lit(0).alias("side")), F.struct(F.col("_name").alias("name"), F.lit(1).alias("side"))))
    met = met.select("cell", pair.alias("pair"), F.explode(sides).alias("s")).select("cell", "pair", "s.name", "s.side")
    rows = placed.withColumn("name", F.xxhash64("own", "block")).join(met, ["cell", "name"]).select("pair", "side", "set", "line", "nth")
    return cut(rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(lambda it: _verify(it, radius, similarity), "a bigint, b bigint"))


def groups(docs: DataFrame, min_words: int = MIN_WORDS, radius: int = RADIUS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """(doc_id, doc, pos, keeps): the lines of groups of more than one; ``keeps`` is true for one occurrence of each.

    Normalised lines link if their edit similarity is at least ``similarity``; a group is a
    connected set of lines. Candidates are lines whose SimHashes differ in at most ``radius``
    bits (pigeonhole blocks find all of these), or that share a MinHash band of words and
    whose SimHashes differ in at most APART bits. A spanning forest of each block's and band's
    candidates is verified first; where lines that met stay apart by it, their sets are compared
    line by line. The first occurrence by id, then place, is kept. Lines of fewer than
    ``min_words`` words take no part, or with ``short`` as exact copies only.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    hashed = keep(own.mapInArrow(lambda it: _simhash(it, min_words, short), "doc_id bigint, doc bigint, pos int, key bigint, fp bigint, bands binary"))
    signs = hashed.where("bands is not null").select("fp", "bands")
    near = _candidates(signs, radius)
    # candidates as pairs of keys: of fingerprints that are linked, or that several keys share
    names = hashed.where("fp is not null").groupBy("fp").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    left, right = (names.select(F.col("fp").alias(c), F.col("low").alias(f"key_{c}")) for c in "ab")
    met = near.join(left, "a").join(right, "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    several = hashed.where("fp is not null").select("key", "fp").join(names.where("low < high"), "fp").where("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b")).distinct()
    edges = cut(met.unionByName(several).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # one occurrence of each candidate; only its document is read again
    keys = edges.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    some = cut(hashed.where("bands is not null").join(keys, "key").select("key", F.col("doc").alias("_doc"), F.col("pos").alias("_pos")).dropDuplicates(["key"]))
    read = docs.select(F.xxhash64(id_col, text_col).alias("doc"), F.col(text_col).alias("_text"))
    holders = some.select(F.col("_doc").alias("doc")).distinct()
    few = some.count() <= KEYS
    read = read.join(F.broadcast(holders) if few else holders, "doc", "left_semi")
    raw = read.select("doc", F.posexplode(F.split("_text", "\n")).alias("pos", "raw")).join(F.broadcast(some) if few else some, (F.col("doc") == F.col("_doc")) & (F.col("pos") == F.col("_pos")))
    text = keep(raw.select("key", "raw").repartition("key").mapInArrow(_plain, "key bigint, line string"))
    lines, others = text.select(F.col("key").alias("a"), "line"), text.select(F.col("key").alias("b"), F.col("line").alias("other"))
    tried = cut(edges.join(lines, "a").join(others, "b").select("a", "b", "line", "other").mapInArrow(lambda it: _similar(it, similarity), "a bigint, b bigint, same boolean"))
    found = cut(components(tried.where("same").select("a", "b")).select(F.col("id").alias("key"), F.col("root").alias("set")))
    # sets that met but stayed apart
    sets = text.select("key").join(found, "key", "left").select("key", F.coalesce("set", "key").alias("set"))
    ends = [sets.select(F.col("key").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab"]
    apart = cut(tried.where("not same").select("a", "b").join(ends[0], "a").join(ends[1], "b").where("set_a <> set_b").select(F.col("set_a").alias("a"), F.col("set_b").alias("b")).distinct())
    group = found.select("key", F.col("set").alias("group"))
    if not apart.isEmpty():
        open_ = components(apart).select(F.col("id").alias("set"), F.col("root").alias("group"))
        more = components(_between(sets.join(open_, "set").join(text, "key"), radius, similarity)).select(F.col("id").alias("set"), F.col("root").alias("group"))
        group = sets.join(more, "set", "left").select("key", F.coalesce("group", "set").alias("group"))
    found = group
    # a line that is linked to none is a group of its own key
    counts = hashed.groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.count("doc_id").alias("ids"))
    named = cut(counts.join(found, "key", "left").where("group is not null or n > 1"))
    linked = named.where("group is not null")
    whole = linked.groupBy("group").agg(F.min("low").alias("low"), F.sum("n").alias("n"), F.sum("ids").alias("ids"))
    alone = named.where("group is null").select("key", F.col("key").alias("group"), "low", "n", "ids")
    of = linked.select("key", "group").join(whole, "group").select("key", "group", "low", "n", "ids").unionByName(alone)
    # lines of the group's lowest id, null before all, of which one stays
    lowest = F.when(F.col("ids") < F.col("n"), F.col("doc_id").isNull()).otherwise(F.col("doc_id").eqNullSafe(F.col("low")))
    line = cut(hashed.select("doc_id", "doc", "pos", "key").join(of.hint("shuffle_hash"), "key").select("doc_id", "doc", "pos", "group", lowest.alias("lowest")))
    heads = line.where("lowest").groupBy("group").agg(F.min(F.struct("doc", "pos")).alias("head"))
    first = line.where("lowest").join(heads, "group").select("doc_id", "doc", "pos", (F.struct("doc", "pos") == F.col("head")).alias("keeps"))
    return first.unionByName(line.where("not lowest").select("doc_id", "doc", "pos", F.lit(False).alias("keeps")))


def without(text: Column, gone: Column) -> Column:
    """``text`` without the lines at the positions ``gone``; null where gone is null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, away: pd.Series) -> pd.Series:
        out = []
        for t, g in zip(texts, away, strict=True):
            left = set(g) if g is not None and t is not None else None
            out.append(None if left is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in left))
        return pd.Series(out, dtype=object)

    return run(F.when(gone.isNotNull(), text), gone)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, radius: int = RADIUS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """``docs`` with text cleaned and the columns n_lines and n_removed, one row for each row.

    Of each group of ``groups`` one line stays; lines that are taken out leave the others as
    they were. Null and empty texts stay (n_lines 0 and 1). Rows of equal id and text are one
    document: they keep and lose the same lines. An empty table gives an empty result.
    """
    gone = groups(docs, min_words, radius, similarity, id_col, text_col, short).where(~F.col("keeps")).groupBy("doc").agg(F.collect_set("pos").alias("gone"))
    own = docs.select(F.struct("*").alias("row"), F.xxhash64(id_col, text_col).alias("key")).join(gone.hint("shuffle_hash"), F.col("key") == F.col("doc"), "left")
    text = F.col("row").getField(text_col)
    clean = F.when(F.col("gone").isNull(), text).otherwise(without(text, F.col("gone")))
    count = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1)))
    kept = [clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return own.select(*kept, count.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; lines of fewer than four words as exact copies."""
    return dedup(table(spark, sf_dir, "documents"), short=True).select("doc_id", "text", "n_lines", "n_removed")
