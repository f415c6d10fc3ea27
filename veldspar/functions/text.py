"""Scalar text functions: Column in, Column out, all on the JVM.

Patterns that speak of word characters carry ``(?U)``, so letters outside ASCII count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = r"(?U)\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+\b"
BLANK_RUN = r"(?U)\s+"


def squeeze(text: Column) -> Column:
    """White space runs as one space, ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(text, BLANK_RUN, " "))


def blank_to_null(text: Column) -> Column:
    return F.when(F.regexp_replace(text, BLANK_RUN, "") == "", None).otherwise(text)


def first_filled(*columns: Column) -> Column:
    """The first column, in the order given, that isn't blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def identifiers(text: Column) -> Column:
    """Upper-case, hyphenated tokens with a digit, in order of first appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: x.rlike("[0-9]")))


def support(question: Column, answer: Column, evidence: Column) -> Column:
    """struct<verdict, unsupported, supported>: are asked and asserted identifiers in the evidence?

    ``supported`` is null where neither names an identifier: nothing was checked.
    """
    asked, asserted, known = identifiers(question), identifiers(answer), identifiers(evidence)
    asked_not, asserted_not = F.array_except(asked, known), F.array_except(asserted, known)
    verdict = (
        F.when(F.trim(F.coalesce(evidence, F.lit(""))) == "", "no_evidence")
        .when(F.size(asked_not) > 0, "no_support_for_asked_identifier")
        .when(F.size(asserted_not) > 0, "unsupported_identifiers_in_answer")
        .when(F.size(asked) == 0, "no_identifier_in_question")
        .otherwise("supported")
    )
    none = (F.size(asked) == 0) & (F.size(asserted) == 0)
    checked = F.when(none, None).otherwise((F.size(asked_not) == 0) & (F.size(asserted_not) == 0))
    return F.struct(verdict.alias("verdict"), F.when(F.size(asked_not) > 0, asked_not).otherwise(asserted_not).alias("unsupported"), checked.alias("supported"))


def hard_refusal(question: Column, context: Column) -> Column:
    """True if the question names identifiers and the context has none of them."""
    asked = identifiers(question)
    return (F.size(asked) > 0) & (F.size(F.array_intersect(asked, identifiers(context))) == 0)


def match_key(text: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normal_quote(text: Column) -> Column:
    """White space collapsed, lower case, quote marks at the ends taken off."""
    return F.regexp_replace(F.lower(squeeze(text)), "^[\"'“”‘’` ]+|[\"'“”‘’` ]+$", "")


def normal_submission(text: Column) -> Column:
    """Newlines as \\n, time stamps out, blanks before line ends and runs of empty lines out."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"\[\d{1,2}:\d{2}(?::\d{2})?\]", "")
    t = F.regexp_replace(t, r"\d{1,2}:\d{2}:\d{2}[.,]?\d* *--> *\d{1,2}:\d{2}:\d{2}[.,]?\d*", "")
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def slug(text: Column) -> Column:
    """Letters and digits lower-cased, other runs as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def stored_name(unique: Column, name: Column) -> Column:
    """``<unique>--<slug><ext>`` for an uploaded file."""
    ext = F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), "[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+$", "")
    return F.concat(unique, F.lit("--"), F.when(stem == "", "file").otherwise(stem), ext)


def basename(path: Column) -> Column:
    """Last part of a path with / or \\ between parts; trailing separators don't count."""
    return F.element_at(F.split(F.regexp_replace(path, r"[/\\]+$", ""), r"[/\\]"), -1)


def normal_path(path: Column) -> Column:
    """Trimmed, lower case, empty and . parts out, .. takes the part before it; a leading / stays, nothing left gives null."""
    low = F.lower(F.trim(path))
    empty = F.array().cast("array<string>")
    walked = F.aggregate(F.split(low, "/"), empty, lambda acc, p: F.when((p == "") | (p == "."), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    left = F.array_join(walked, "/")
    return F.when(left != "", F.concat(F.when(low.startswith("/"), "/").otherwise(""), left))


def query_terms(query: Column, more_than: int = 3, most: int = 6) -> Column:
    """Distinct lower-case words longer than ``more_than``, the first ``most`` of them."""
    found = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda w: F.length(w) > more_than)), 1, most)


def token_set(text: Column) -> Column:
    """Distinct lower-case runs of a-z and 0-9."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def over_count(text: Column) -> Column:
    """Token estimate that errs high: max(ceil(length / 3.6), words, 1)."""
    return F.greatest(F.ceil(F.length(text) / 3.6), F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(1)).cast("long")


def letter_count(text: Column) -> Column:
    """Token estimate by length: max(int(length / 4) + 1, runs of letters)."""
    return F.greatest(F.floor(F.length(text) / 4) + 1, F.regexp_count(text, F.lit(r"\p{L}+"))).cast("long")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def cap_with_marker(text: Column, most: int, marker: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit(marker))).otherwise(text)


def head_and_tail(text: Column, most: int, marker: str) -> Column:
    """A quarter from the head and three quarters from the tail of what fits."""
    room = most - len(marker)
    head = room // 4
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(head)), F.lit(marker), F.right(text, F.lit(room - head)))).otherwise(text)


def strip_reasoning(text: Column) -> Column:
    """Complete <think>...</think> regions out; an unpaired tag stays."""
    return F.trim(F.regexp_replace(text, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", ""))


def drop_controls(text: Column) -> Column:
    """C0 characters except tab and newlines, and DEL, out; then runs of blank lines collapsed."""
    t = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.regexp_replace(t, r"\n[ \t]*(?:\n[ \t]*)+\n", "\n\n")


def url_quote(text: Column) -> Column:
    """Percent encoding with %20 for a space."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def date_in_name(name: Column) -> Column:
    """ISO date from yyyy-mm-dd, yyyy_mm_dd or yyyymmdd inside a file name; else null."""
    found = F.regexp_extract(name, r"(20\d{2})[-_.]?(0[1-9]|1[0-2])[-_.]?(0[1-9]|[12]\d|3[01])", 0)
    digits = F.regexp_replace(found, "[^0-9]", "")
    return F.when(found == "", None).otherwise(F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)))


def pii_counts(text: Column) -> Column:
    """struct<emails, phones, ssns, cards, ips>: how often each kind of personal data occurs."""
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    return F.struct(
        count(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("emails"),
        count(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}").alias("phones"),
        count(r"[0-9]{3}-[0-9]{2}-[0-9]{4}").alias("ssns"),
        count(r"(?:[0-9]{4}[ -]?){3}[0-9]{4}").alias("cards"),
        count(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}").alias("ips"),
    )


def nearest_rank(values: Column, index: Column) -> Column:
    """The value at a 0-based index of the sorted array; null for an empty one."""
    sorted_ = F.sort_array(values)
    return F.get(sorted_, F.greatest(F.least(index.cast("int"), F.size(sorted_) - 1), F.lit(0)))


def name_candidates(question: Column, matched: Column, ordinary: Column, most: int = 10, longest: int = 40) -> Column:
    """Runs of one to three capitalised words that aren't a known company: array in order, each once, at most ``most``.

    ``matched`` has the match keys of companies already found, ``ordinary`` lower-case words that are no names. Left out: one
    word at the very start, runs inside or around a matched name, single ordinary words, short words with a digit, long runs.
    """
    pattern = r"(?U)\b[A-Z][A-Za-z0-9&'.\-]*(?:\s+[A-Z][A-Za-z0-9&'.\-]*){0,2}"
    found = F.transform(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(pattern), F.lit(0)), lambda r, i: F.struct(squeeze(r).alias("run"), ((i == 0) & F.startswith(question, r)).alias("opens")))
    one = lambda x: F.size(F.split(x, " ")) == 1

    def fits(x: Column) -> Column:
        key = match_key(x["run"])
        known = F.exists(matched, lambda m: F.contains(m, key) | F.contains(key, m))
        dull = one(key) & (F.array_contains(ordinary, key) | (key.rlike("[0-9]") & (F.length(key) <= 4)))
        return ~(x["opens"] & one(x["run"])) & ~known & ~dull & (F.length(x["run"]) <= longest)

    return F.slice(F.array_distinct(F.transform(F.filter(found, fits), lambda x: x["run"])), 1, most)
