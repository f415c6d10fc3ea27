"""Probe sets: shared runs of text between sets of questions, codes that look like others, probes that ask for codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifiers
from ..runtime import cut


#: Distinct grams that are broadcast at most; more meet the other side by a shuffle.
GRAMS = 1_000_000


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def longest_shared_run(left: DataFrame, right: DataFrame, id_col: str = "id", text_col: str = "text", least: int = 8, cap: int = 64) -> DataFrame:
    """(id, longest): for each row of ``left``, the longest run of characters that any text of ``right`` shares with it.

    Case and white space don't count. Runs shorter than ``least`` (a power of two) count as 0, longer than ``cap`` as
    ``cap``. A null id is an id like any other; rows of one id count together.

    Positions carry the text that follows them, up to ``cap``. Their common length is found by
    doubling from ``least`` and then by halving steps; a step meets the two sides on distinct
    grams of the length it tries, so texts are never paired, whatever many of them share.
    """
    if least < 1 or least & (least - 1) or cap < least:
        raise ValueError("least must be a power of two, and cap not below it")

    def places(df: DataFrame, *cols: str) -> DataFrame:
        t = df.select(*cols, _plain(F.col(text_col)).alias("_t")).distinct()
        at = F.when(F.length("_t") >= least, F.sequence(F.lit(1), F.length("_t") - (least - 1)))
        return t.select(*cols, F.explode(F.transform(at, lambda i: F.substring(F.col("_t"), i, F.lit(cap)))).alias("rest")).withColumn("g", F.substring("rest", 1, least))

    # what shares no gram of the least length takes no further part, so it is left out before anything is shuffled or kept
    ours = places(left, id_col)
    grams = cut(ours.select("g").distinct())
    few = F.broadcast(grams) if grams.count() <= GRAMS else grams
    theirs = cut(places(right).join(few, "g", "left_semi").distinct())
    ours = cut(ours.distinct().join(theirs.select("g").distinct(), "g", "left_semi").select(id_col, "rest", F.lit(least).alias("c")))
    theirs = theirs.select("rest", F.lit(least).alias("c"))

    def tried(ours: DataFrame, theirs: DataFrame, fits: Column, n: Column) -> tuple[DataFrame, DataFrame]:
        gram = F.when(fits & (F.length("rest") >= n), F.substring(F.col("rest"), F.lit(1), n))
        ours, theirs = ours.withColumn("g", gram), theirs.withColumn("g", gram)
        key = ["c", "g"]
        both = cut(ours.where("g is not null").select(*key).distinct().join(theirs.where("g is not null").select(*key).distinct(), key))
        ours = ours.join(both.withColumn("hit", F.lit(True)), key, "left").select(id_col, "rest", F.when(F.col("hit"), n).otherwise(F.col("c")).alias("c"))
        return cut(ours), cut(theirs.select("rest", "c").unionByName(theirs.join(both, key, "left_semi").select("rest", n.alias("c"))))

    length = 2 * least
    while length <= cap:
        ours, theirs = tried(ours, theirs, F.col("c") == length // 2, F.lit(length))
        length *= 2
    step = length // 4
    while step:  # what stands at a multiple of two steps may grow by one: its longer half has failed
        ours, theirs = tried(ours, theirs, (F.col("c") > 0) & (F.col("c") % (2 * step) == 0), F.col("c") + step)
        step //= 2
    found = ours.groupBy(F.col(id_col).alias("_i")).agg(F.max("c").alias("longest"))
    ids = left.select(id_col).distinct()
    return ids.join(found, F.col(id_col).eqNullSafe(F.col("_i")), "left").select(id_col, F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))


#: The ways in which a question may spell a code, in turn.
EDGE_VARIANTS = ("lowercase_code", "hyphen_as_space", "trailing_comma")
BOTH, ONE, CONTROL = "two_code_both_present", "two_code_one_absent", "control_unanswerable"


def lookalikes(codes: DataFrame, pool: DataFrame, most: int = 3) -> DataFrame:
    """(code, fake, place): for each code, codes that differ in one digit and that ``pool`` (code) doesn't have, at most ``most``.

    Each digit is replaced by each other one, so a code has nine times as many neighbours as digits; they are anti joined
    to the pool on equality and the first by name are kept.
    """
    at = F.sequence(F.lit(1), F.length("code"))
    digits = F.filter(F.when(F.length("code") > 0, at), lambda i: F.substring(F.col("code"), i, F.lit(1)).rlike("[0-9]"))
    swap = lambda i, d: F.overlay(F.col("code"), d.cast("string"), i, F.lit(1))
    each = F.flatten(F.transform(digits, lambda i: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: swap(i, d))))
    near = codes.select("code").distinct().select("code", F.explode(F.array_distinct(each)).alias("fake"))
    free = near.join(pool.select(F.col("code").alias("fake")).distinct(), "fake", "left_anti")
    place = F.row_number().over(Window.partitionBy("code").orderBy("fake"))
    return free.select("code", "fake", place.alias("place")).where(F.col("place") <= most)


def spelt(code: Column, variant: Column, turn: Column) -> Column:
    """A code as one of EDGE_VARIANTS spells it; which hyphen opens goes in turns."""
    parts = F.split(code, "-")
    hyphens = F.size(parts) - 1
    cut = F.pmod(turn, F.greatest(hyphens, F.lit(1))).cast("int") + 1
    opened = F.concat_ws(" ", F.array_join(F.slice(parts, F.lit(1), cut), "-"), F.array_join(F.slice(parts, cut + 1, F.size(parts)), "-"))
    return F.when(variant == "lowercase_code", F.lower(code)).when(variant == "trailing_comma", F.concat(code, F.lit(","))).otherwise(F.when(hyphens > 0, opened).otherwise(code))


def expected_gates(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """``rows`` with asked, unsupported (arrays in the question's order) and expected_gate: fire, not_fire or no_identifier.

    ``rows`` has (probe, question, company, doc), ``pieces`` (company, doc, text). A probe with a document is held against that document's pieces, one
    without against all of its company's; asked codes meet distinct tokens on equality. Questions are sanitised.
    """
    found = pieces.select("company", "doc", F.explode(identifiers(F.col("text"))).alias("code"))
    there = found.select("company", F.col("doc").cast("string").alias("scope"), "code").unionByName(found.select("company", F.lit(None).cast("string").alias("scope"), "code")).distinct()
    asked = rows.select("probe", "company", F.col("doc").cast("string").alias("scope"), F.posexplode(identifiers(F.col("question"))).alias("at", "code"))
    same = (F.col("l.company").eqNullSafe(F.col("r.company"))) & F.col("l.scope").eqNullSafe(F.col("r.scope")) & (F.col("l.code") == F.col("r.code"))
    judged = asked.alias("l").join(there.withColumn("hit", F.lit(True)).alias("r"), same, "left").select("l.probe", "l.at", "l.code", "r.hit")
    lists = judged.groupBy("probe").agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.struct("at", "code")))).alias("u"))
    names = lambda c: F.coalesce(F.transform(c, lambda x: x["code"]), F.array().cast("array<string>"))
    out = rows.join(lists, "probe", "left").withColumns({"asked": names("a"), "unsupported": names("u")}).drop("a", "u")
    return out.withColumn("expected_gate", F.when(F.size("asked") == 0, "no_identifier").when(F.size("unsupported") > 0, "fire").otherwise("not_fire"))


def identifier_probes(facts: DataFrame, pieces: DataFrame, absent: DataFrame, templates: list[str], every: int = 4, pairs: int = 3) -> DataFrame:
    """(probe, kind, company, doc, question, asked, unsupported, expected_gate): probes that ask for codes.

    ``facts`` has (company, doc, fact, code), ``absent`` (company, code) codes that no piece of the company has, ``pieces`` (company, doc, text). Facts of a company
    are numbered by code and ask by the ``templates`` ({code}, {company}) in turn; each ``every``-th also with its code spelt otherwise. Neighbours in a document's order
    are asked for together, at most ``pairs`` of a company, documents in order; so are as many facts with an absent code, both in turn.
    Each absent code is a control, held against all of its company. Probe ids are <company>-s/e/t/x/u<number>.
    """
    number = F.row_number().over(Window.partitionBy("company").orderBy("code", "fact")) - 1
    f = facts.withColumn("n", number)
    shape = F.element_at(F.array(*[F.lit(t) for t in templates]), (F.col("n") % len(templates) + 1).cast("int"))
    fill = lambda t, code: F.replace(F.replace(t, F.lit("{code}"), code), F.lit("{company}"), F.col("company").cast("string"))
    name = lambda kind, n: F.concat(F.col("company").cast("string"), F.lit(f"-{kind}"), (n + 1).cast("string"))
    cols = lambda kind, question, probe, doc=F.col("doc"): [probe.alias("probe"), kind.alias("kind"), F.col("company"), doc.cast("string").alias("doc"), question.alias("question")]
    plain = f.select(*cols(F.lit("identifier_answerable"), fill(shape, F.col("code")), name("s", F.col("n"))))
    turn = F.floor(F.col("n") / every)
    variant = F.element_at(F.array(*[F.lit(v) for v in EDGE_VARIANTS]), (turn % len(EDGE_VARIANTS) + 1).cast("int"))
    edge = f.where(F.col("n") % every == 0).select(*cols(F.concat(F.lit("edge_"), variant), fill(shape, spelt(F.col("code"), variant, turn)), name("e", F.col("n"))))
    second = F.lead("code").over(Window.partitionBy("company", "doc").orderBy("code", "fact"))
    two = f.withColumn("other", second).where("other is not null").withColumn("k", F.row_number().over(Window.partitionBy("company").orderBy("doc", "code", "fact")) - 1).where(F.col("k") < pairs)
    both = two.select(*cols(F.lit(BOTH), F.concat(F.lit("Both "), F.col("code"), F.lit(" and "), F.col("other"), F.lit(" came up in the review - what outcome was recorded for each?")), name("t", F.col("k"))))
    gone = absent.select("company", F.col("code").alias("fake")).distinct().withColumn("m", F.row_number().over(Window.partitionBy("company").orderBy("fake")) - 1)
    counts = gone.groupBy("company").agg(F.max(F.col("m") + 1).alias("of"))
    mixed = f.where(F.col("n") < pairs).join(counts, "company").withColumn("m", (F.col("n") % F.col("of")).cast("int")).join(gone, ["company", "m"])
    one = mixed.select(*cols(F.lit(ONE), F.concat(F.col("code"), F.lit(" and "), F.col("fake"), F.lit(" were both raised - what outcome was recorded for each?")), name("x", F.col("n"))))
    control = gone.select(*cols(F.lit(CONTROL), F.concat(F.lit("What outcome was recorded for "), F.col("fake"), F.lit("?")), name("u", F.col("m")), F.lit(None)))
    rows = plain.unionByName(edge).unionByName(both).unionByName(one).unionByName(control)
    return expected_gates(rows, pieces)
