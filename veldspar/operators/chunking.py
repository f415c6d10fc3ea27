"""Documents to chunks: line kinds, running lines, token windows, structure, coverage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship

WORD = r"[^\x20\x09-\x0D]+"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, line): one row for each line."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))


def line_kind(line: Column) -> Column:
    """heading, table, table_separator, bullet, page_mark, blank or text; the first that fits."""
    t = F.trim(line)
    loud = (F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) <= 80) & ~t.rlike("[.!?;:,]$") & (F.regexp_count(t, F.lit(WORD)) <= 10)
    return (
        F.when(t == "", "blank")
        .when(t.rlike(r"^#{1,6} +[^ ]"), "heading")
        .when(t.rlike(r"^[|]?( *:?-{3,}:? *[|])+ *(:?-{3,}:?)? *$"), "table_separator")
        .when(t.rlike(r"^[|].*[|]$") | (F.regexp_count(t, F.lit(r" [|] ")) >= 2), "table")
        .when(t.rlike(r"^([-*•+]|[0-9]{1,3}[.)]) +[^ ]") & ~t.rlike(r"^[0-9]+([.][0-9]+)+ "), "bullet")
        .when(t.rlike(r"^(?:[Pp]age )?[0-9]{1,4}(?: of [0-9]{1,4})?$"), "page_mark")
        .when(t.rlike(r"^[0-9]+([.][0-9]+)+ +[A-Z]") & (F.length(t) <= 90) & ~t.rlike("[.!?]$"), "heading")
        .when(loud, "heading")
        .otherwise("text")
    )


def running_lines(docs: DataFrame, least: int = 3, id_col: str = "doc_id") -> DataFrame:
    """(id, line, n): short lines that recur in one document and aren't sentences: headers and footers of pages."""
    each = lines(docs, id_col).select(id_col, F.trim("line").alias("line"))
    short = (F.length("line") > 0) & (F.length("line") <= 90) & (F.regexp_count("line", F.lit(WORD)) <= 12) & ~F.col("line").rlike("[.!?]$")
    return each.where(short).groupBy(id_col, "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def fixed_chunks(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, n_tokens, body): windows of ``size`` words, each ``overlap`` words into the one before."""
    stride = max(1, size - overlap)
    # a column of its own, so words are split once
    w = docs.select(id_col, F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0)).alias("_w"))
    starts = F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    # a window that the one before already covers is left out
    pieces = F.transform(F.filter(starts, lambda s: (s == 0) | (s + overlap < F.size("_w"))), lambda s: F.slice("_w", s + 1, size))
    each = w.select(id_col, F.posexplode_outer(pieces).alias("chunk", "_p")).where("_p is not null")
    return each.select(id_col, F.col("chunk").cast("long").alias("chunk"), F.size("_p").cast("long").alias("n_tokens"), F.array_join("_p", " ").alias("body"))


def coverage(expected: DataFrame, got: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: words expected, words missing from ``got`` as a multiset, covered percentage.

    Both sides have the id and a column ``w`` of one word each.
    """
    a = expected.select(id_col, "w", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = got.select(id_col, "w", F.lit(0).alias("a"), F.lit(1).alias("b"))
    n = a.unionByName(b).groupBy(id_col, "w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    g = n.groupBy(id_col).agg(F.sum("a").alias("expected"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("missing"))
    return g.withColumn("covered_pct", F.round(100.0 * (F.col("expected") - F.col("missing")) / F.greatest("expected", F.lit(1)), 2))


def topic_depths(sims: DataFrame, within: list[str], order: str, sim: str, span: int = 2) -> DataFrame:
    """Adds ``depth`` of each similarity valley: how far the peaks within ``span`` on both sides rise above it.

    Depth is 0 where a neighbour is lower, so only valleys count.
    """
    w = Window.partitionBy(*within).orderBy(order)
    left, right = F.max(sim).over(w.rowsBetween(-span, -1)), F.max(sim).over(w.rowsBetween(1, span))
    valley = (F.coalesce(F.lag(sim).over(w), F.lit(2.0)) >= F.col(sim)) & (F.coalesce(F.lead(sim).over(w), F.lit(2.0)) >= F.col(sim))
    rise = F.greatest(F.coalesce(left, F.col(sim)) - F.col(sim), F.lit(0.0)) + F.greatest(F.coalesce(right, F.col(sim)) - F.col(sim), F.lit(0.0))
    return sims.withColumn("depth", F.when(valley, rise).otherwise(0.0))


HEADING = re.compile(r"^(#{1,6})\s+(\S.*)$")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def estimate(text: str) -> int:
    return max(-(-len(text) * 10 // 36), len(text.split()), 1)


def _fit(body: str, most: int) -> Iterator[str]:
    """Pieces of at most ``most`` tokens: whole, by paragraph, by line, by sentence, by word."""
    if estimate(body) <= most:
        yield body
        return
    for cut, glue in ((re.compile(r"\n\s*\n"), "\n\n"), (re.compile(r"\n"), "\n"), (SENTENCE, " "), (re.compile(r"\s+"), " ")):
        parts = [p for p in cut.split(body) if p.strip()]
        if len(parts) > 1:
            held = ""
            for p in parts:
                if held and estimate(held + glue + p) > most:
                    yield from _fit(held, most)
                    held = p
                else:
                    held = held + glue + p if held else p
            yield from _fit(held, most)
            return
    half = max(1, int(most * 3.6) - 1)
    yield from (body[i : i + half] for i in range(0, len(body), half))


def sections(text: str, most: int, least: int) -> list[tuple[list[str], str]]:
    """(section path, body) pieces: markdown headings open sections, small neighbours of one path merge."""
    path: list[tuple[int, str]] = []
    units: list[tuple[list[str], list[str]]] = [([], [])]
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if m := HEADING.match(line):
            level = len(m[1])
            path = [p for p in path if p[0] < level] + [(level, m[2].strip())]
            units.append(([p[1] for p in path], [line]))
        else:
            units[-1][1].append(line)
    out: list[tuple[list[str], str]] = []
    for at, body in units:
        joined = "\n".join(body).strip("\n")
        if not joined.strip():
            continue
        for piece in _fit(joined, most):
            last = out[-1] if out else None
            small = last and (estimate(last[1]) < least or estimate(piece) < least)
            if small and last[0][:1] == at[:1] and estimate(last[1] + "\n" + piece) <= most:
                out[-1] = (last[0], last[1] + "\n" + piece)
            else:
                out.append((at, piece))
    return out


def structure_chunks(docs: DataFrame, most: int = 500, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, parts, section, header, body, n_tokens): structure-aware pieces within the budget."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b[id_col], b[text_col], strict=True):
                found = sections(text or "", most, least)
                rows += [(i, k, len(found), at, " > ".join(at), body, estimate(body)) for k, (at, body) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["id", "part", "parts", "section", "header", "body", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInPandas(run, f"id {kind}, part long, parts long, section array<string>, header string, body string, n_tokens long").withColumnRenamed("id", id_col)


TURN = re.compile(r"^\s*(?:\[?\d{1,2}:\d{2}(?::\d{2})?\]?\s*)?([A-Z][\w.'-]*(?:\s+[A-Z][\w.'-]*){0,3})\s*(?:\([^)]*\)\s*)?:\s+(.*)$")


def transcript(docs: DataFrame, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, is_transcript, turns): ``turns`` of speaker and words where enough lines open a turn and speakers recur."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b[id_col], b[text_col], strict=True):
                own = [x for x in (text or "").splitlines() if x.strip()]
                hits = [TURN.match(x) for x in own]
                names = [m[1] for m in hits if m]
                is_one = len(names) >= 3 and len(names) >= share * len(own) and len(set(names)) <= len(names) // 2 + 1 and len(set(names)) >= 2
                turns: list[dict] = []
                for line, m in zip(own, hits, strict=True) if is_one else ():
                    if m and (not turns or turns[-1]["speaker"] != m[1]):
                        turns.append({"speaker": m[1], "words": m[2]})
                    elif turns:
                        turns[-1]["words"] += " " + (m[2] if m else line.strip())
                rows.append((i, is_one, turns))
            yield pd.DataFrame(rows, columns=["id", "is_transcript", "turns"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInPandas(run, f"id {kind}, is_transcript boolean, turns array<struct<speaker: string, words: string>>").withColumnRenamed("id", id_col)


#: Fixed value: where a text may be split, coarsest first; words are the last resort.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")


def fitting_pieces(text: str, size: int, separators: tuple[str, ...], count) -> list[str]:
    """The largest pieces of at most ``size`` tokens; a separator stays with the piece on its left."""
    if count(text) <= size:
        return [text] if text.strip() else []
    for n, mark in enumerate(separators):
        *heads, last = text.split(mark)
        parts = [h + mark for h in heads] + [last] * bool(last)
        if len(parts) > 1:
            finer = (fitting_pieces(p, size, separators[n + 1 :], count) if count(p) > size else [p] for p in parts)
            return [p for own in finer for p in own if p.strip()]
    out, line = [], ""
    for word in text.split():
        longer = f"{line} {word}" if line else word
        if line and count(longer) > size:
            out.append(line + " ")
            longer = word
        line = longer
    return [*out, line] if out else [text]


def packed(pieces: list[str], size: int, overlap: int, count) -> list[str]:
    """Whole pieces in chunks of at most ``size`` tokens; up to ``overlap`` tokens of last pieces open the next chunk if they fit."""
    own, out, start, used = [count(p) for p in pieces], [], 0, 0
    for i, n in enumerate(own):
        if used and used + n > size:
            out.append("".join(pieces[start:i]))
            back, carried = i, 0
            while overlap > 0 and back > start and carried + own[back - 1] <= overlap:
                back -= 1
                carried += own[back]
            start, used = (i, 0) if carried + n > size else (back, carried)
        used += n
    return [c for c in (*out, "".join(pieces[start:])) if c.strip()]


def recursive_chunks(docs: DataFrame, size: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk, body): texts split at the coarsest separator whose pieces fit, packed up to ``size`` words. Null and blank texts have none."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        words = lambda t: len(t.split())
        return texts.map(lambda t: packed(fitting_pieces(t, size, separators, words), size, overlap, words) if t else [])

    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(run(F.col(text_col))).alias("chunk", "body"))
