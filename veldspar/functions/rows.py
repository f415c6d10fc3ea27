"""Text functions that need Python's Unicode rules or sequential state, as Arrow-batched UDFs."""

from __future__ import annotations

import hashlib
import html
import json
import re
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

INVISIBLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ud800-\udfff￾￿]")
#: Patterns of personal data, first words of a question that are no name, words without content.
PII = (
    ("email", re.compile(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")),
    ("phone", re.compile(r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b")),
    ("ssn", re.compile(r"\b\d{3}-\d{2}-\d{4}\b")),
    ("cc", re.compile(r"\b(?:\d{4}[-.\s]?){3}\d{4}\b")),
    ("ip", re.compile(r"\b(?:\d{1,3}\.){3}\d{1,3}\b")),
)
NAME = re.compile(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b")
ASKING = frozenset("What How When Where Why Which Who List Show Find Compare Extract Summarize".split())
STOPWORDS = frozenset(
    "a about an and are as at be been but by can could did do does for from had has have how i if in into is it its me my no not of on or our please say said she should so "
    "summarize tell than that the their them then there these they this those to too up us was we were what when where which who why will with would you your".split()
)
TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9'\-]*")
QUOTED = re.compile(r"[\"']([^\"']{2,})[\"']")
PROPER = re.compile(r"[A-Z][A-Za-z0-9'\-]+")


def sanitize(text: str) -> str:
    """Trim, decode character references once, drop what can't be shown, trim."""
    return INVISIBLE.sub("", html.unescape(text.strip())).strip()


def anonymize(text: str, salt: str = "veldspar") -> str:
    """Personal data as KIND_HHHH: the same value always gets the same four hex digits. Names are runs of three words or more."""
    mask = lambda kind, value: f"{kind.upper()}_{hashlib.sha256(f'{salt}:{kind}:{value}'.encode()).hexdigest()[:4].upper()}"
    for kind, pattern in PII:
        text = pattern.sub(lambda m, k=kind: mask(k, m[0]), text)
    named = lambda words: len(words) > 2 and words[0] not in ASKING
    return NAME.sub(lambda m: mask("person", m[0]) if named(m[0].split()) else m[0], text)


def keywords(query: str, most: int = 10) -> tuple[list[str], list[str]]:
    """(high, low): content words; and quoted phrases, a query of up to 8 words, runs of names and numbers, in this order."""
    query = query.strip()
    low = [p.strip() for p in QUOTED.findall(query)] + ([query] if 0 < len(query.split()) <= 8 else [])

    def kind(numbered: tuple[int, str]) -> str:
        at, token = numbered
        if token[0].isdigit():
            return "number"
        return "name" if at and PROPER.fullmatch(token) and token.lower() not in STOPWORDS else "word"

    high: list[str] = []
    for k, run in groupby(enumerate(TOKEN.findall(query)), kind):
        tokens = [t for _, t in run]
        if k == "word":
            high += [t.lower() for t in tokens if len(t) > 1 and t.lower() not in STOPWORDS]
        else:
            low += [" ".join(tokens)] if k == "name" else tokens
    once = lambda items: list({x.lower(): x for x in reversed(items) if x}.values())[::-1][:most]
    return once(high), once(low)


def json_object(text: str, last: bool = False) -> str | None:
    """The first (or last) balanced JSON object inside a text, as compact JSON."""
    decoder, found, at = json.JSONDecoder(), None, 0
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        found = json.dumps(value, sort_keys=True, ensure_ascii=False)
        if not last:
            return found
        at = end
    return found


def decode(raw: bytes) -> tuple[str, str]:
    """(text, encoding): UTF-8, else Windows-1252, else Latin-1."""
    for name in ("utf-8", "cp1252", "latin-1"):
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace"), "replace"


def detect_companies(question: str, names: list[str]) -> list[str]:
    """Company names in a question: longest first, each stretch of text used once, whole words only."""
    key = lambda t: " ".join(re.findall(r"[a-z0-9]+", t.lower()))
    left, found = f" {key(question)} ", []
    for name in sorted(names, key=lambda n: (-len(key(n)), n)):
        k = key(name)
        if k and f" {k} " in left:
            left = left.replace(f" {k} ", " \x00 ")
            found.append(name)
    return sorted(found)


def _text_udf(fn, kind: str):
    ship(SparkSession.active())

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fn(x))

    return F.pandas_udf(run, kind)


def sanitized(text: Column) -> Column:
    return _text_udf(sanitize, "string")(text)


def anonymized(text: Column) -> Column:
    return _text_udf(anonymize, "string")(text)


def keyword_list(text: Column) -> Column:
    """Struct of two arrays, high and low."""
    ship(SparkSession.active())

    @F.pandas_udf("high array<string>, low array<string>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([keywords(x or "") for x in s], columns=["high", "low"])

    return run(text)


def salvaged_json(text: Column, last: bool = False) -> Column:
    return _text_udf(lambda x: json_object(x, last), "string")(text)


def companies_in(text: Column, names: list[str]) -> Column:
    """``names`` are the known companies of a deployment, given by the caller."""
    return _text_udf(lambda x: detect_companies(x, names), "array<string>")(text)
