"""Files as tables: recursive scans, text and OOXML extraction, JSON lines, log sink."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rows import decode
from ..functions.text import basename
from ..operators.registry import company_of, is_sidecar, verdict
from ..runtime import ship

WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAW_NS = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def scan(spark: SparkSession, root: str, source_type: str = "filesystem", skip_names: tuple[str, ...] = ()) -> DataFrame:
    """One row for each file under ``root``: path, name, sha256, size, company, verdict, content.

    Partial uploads, sidecars, hidden folders and the names in ``skip_names`` are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    where = re.sub(r"^\w+://[^/]*", "", root.rstrip("/")) if "://" in root else root.rstrip("/")
    relative = F.regexp_replace("path", f"^.*?{re.escape(where)}/", "")
    named = raw.select("path", relative.alias("relative"), basename(F.col("path")).alias("name"), F.col("length").alias("byte_size"), "modificationTime", "content")
    skipped = is_sidecar(F.col("name")) | F.col("name").endswith(".part") | F.col("relative").rlike(r"(^|/)\.[^/]+/") | F.lower("name").isin([n.lower() for n in skip_names])
    kept = named.where(~skipped)
    v = verdict(F.col("name"), F.col("byte_size"))
    return kept.select("path", "relative", "name", "byte_size", F.sha2("content", 256).alias("sha256"), company_of(F.lit(None).cast("string"), F.col("relative")).alias("company"), F.lit(source_type).alias("source_type"), v.alias("validation"), "modificationTime", "content")


def docx_text(raw: bytes) -> str:
    """Paragraphs and tables of a DOCX in document order; headings as #, rows with pipes."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD_NS}body")
    out = []
    for node in body if body is not None else ():
        if node.tag == f"{WORD_NS}p":
            text = "".join(t.text or "" for t in node.iter(f"{WORD_NS}t"))
            style = node.find(f"{WORD_NS}pPr/{WORD_NS}pStyle")
            level = re.match(r"[Hh]eading\s*(\d)", style.get(f"{WORD_NS}val", "")) if style is not None else None
            if text.strip():
                out.append("#" * int(level[1]) + " " + text if level else text)
        elif node.tag == f"{WORD_NS}tbl":
            for row in node.iter(f"{WORD_NS}tr"):
                cells = [" ".join("".join(t.text or "" for t in c.iter(f"{WORD_NS}t")).split()) for c in row.iter(f"{WORD_NS}tc")]
                out.append("| " + " | ".join(cells) + " |")
    return "\n".join(out)


def pptx_text(raw: bytes) -> str:
    """Text of a PPTX, slide by slide, shapes by their place from top to bottom."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
        for k, name in enumerate(sorted(names, key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0])), 1):
            shapes = []
            for sp in (e for e in ElementTree.fromstring(z.read(name)).iter() if e.tag.endswith("}sp") or e.tag.endswith("}graphicFrame")):
                off = next(sp.iter(f"{DRAW_NS}off"), None)
                place = (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (1 << 40, 0)
                text = "\n".join(filter(None, ("".join(t.text or "" for t in p.iter(f"{DRAW_NS}t")).strip() for p in sp.iter(f"{DRAW_NS}p"))))
                if text:
                    shapes.append((*place, len(shapes), text))
            out.append("\n".join([f"## Slide {k}", *[s[-1] for s in sorted(shapes)]]))
    return "\n\n".join(out)


EXTRACTED = T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType()), T.StructField("backend", T.StringType()), T.StructField("error_code", T.StringType())])


def extract(files: DataFrame, pdf=None, most_chars: int | None = None) -> DataFrame:
    """(path, text, backend, error_code) of each file of a scan; a failure is a row, never an exception.

    ``pdf`` maps bytes to text where a PDF reader is at hand.
    """
    ship(files.sparkSession)

    def one(name: str, raw: bytes) -> tuple[str | None, str | None, str | None]:
        ext = name.rsplit(".", 1)[-1].lower()
        try:
            if ext == "docx":
                return docx_text(raw), "ooxml", None
            if ext == "pptx":
                return pptx_text(raw), "ooxml", None
            if ext == "pdf":
                return (pdf(raw), "pdf", None) if pdf else (None, None, "no_pdf_backend")
            if ext == "xlsx":
                return None, None, "unsupported_extension"
            text, encoding = decode(raw)
            return text, encoding, None
        except Exception as e:  # a broken file must not stop the scan
            return None, None, f"extract_failed:{type(e).__name__}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *one(n, c)) for p, n, c in zip(b["path"], b["name"], b["content"], strict=True)]
            out = pd.DataFrame(rows, columns=EXTRACTED.names)
            if most_chars is not None:
                out["text"] = out["text"].map(lambda t: t if t is None or len(t) <= most_chars else t[:most_chars].rstrip() + "\n[truncated]")
            yield out

    return files.select("path", "name", "content").mapInPandas(run, EXTRACTED)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; strict reading fails on a broken line, tolerant reading keeps it in _corrupt_record."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON lines."""
    rows.write.mode("append").json(path)
