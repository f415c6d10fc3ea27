"""Structure-aware chunks as DataFrame steps: line kinds, furniture, section paths, blocks, units, packing, merging, headers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import over_count
from ..runtime import cut

#: Patterns of line kinds, what counts as furniture, delimiters in order of preference.
MARKDOWN = r"^#{1,6}[ \t]*\S"
DOTTED = r"^\d{1,3}(?:\.\d{1,3})+(?:[.)][ \t]|[ \t])\S"
NUMBERED = r"^\d{1,3}[.)][ \t]+\S"
NUMBERED_TITLE = r"^\d{1,3}[.)][ \t]+[A-ZÀ-Ÿ]"
PAGE = r"(?i)^\s*(?:page[ \t]*\d+|\d{1,4}|[ivxlcdm]{1,5})\s*$"
BULLET = r"^\s*(?:[-*•·]|\(?\d{1,3}[.)])\s+\S"
TERMINAL = r"[.!?…]$"
CAPTION = r"(?i)^\s*(?:table|figure|fig\.|exhibit|ex\.)[ \t]*[\divx]+[:.)\s]"
PIPE_RULE = r"^\|[ \t:|-]{3,}\|?$"
PLAIN_RULE = r"^[-–—]{3,}(?:[ \t]+[-–—]{3,})+$"
REPEATS, SHORT_CHARS, SHORT_WORDS, LEVELS = 3, 90, 12, 6
DELIMITERS = ("\n\n<<<CHUNK-BREAK>>>\n\n", "\n\n<<<CHUNK-BREAK-HERE>>>\n\n", "\n\n<<<PIECE-DONE-NEXT-PIECE>>>\n\n")
#: A line that opens a speaker's turn is never furniture.
TURN = r"^(?:\([^)]{1,60}\)\s*\S|\[?[A-Z][\w.'-]*(?:\s+[A-Z][\w.'-]*){0,3}\]?\s*:\s)"


def _words(t: Column) -> Column:
    return F.regexp_count(t, F.lit(r"\S+"))


def _letters(t: Column) -> Column:
    return F.length(F.regexp_replace(t, r"[^\p{L}]", ""))


def is_rule(line: Column) -> Column:
    t = F.trim(line)
    return t.rlike(PIPE_RULE) | t.rlike(PLAIN_RULE)


def is_row(line: Column) -> Column:
    """A table's row: pipes, tabs, or runs of spaces between columns at least twice."""
    t = F.trim(line)
    return (t.startswith("|") & (F.regexp_count(line, F.lit(r"\|")) >= 2)) | (F.contains(line, F.lit("\t")) & (F.trim(F.replace(line, F.lit("\t"), F.lit(""))) != "")) | (F.regexp_count(line, F.lit(r"\S[ \t]{2,}(?=\S)")) >= 2)


def is_heading(line: Column) -> Column:
    """Markdown, a numbered title, or a short line in capitals; rows of tables and sentences are none."""
    t = F.trim(line)
    numbered = (t.rlike(DOTTED) | t.rlike(NUMBERED_TITLE)) & (_words(t) <= 12) & (_letters(t) >= F.length(F.regexp_replace(t, r"[^\p{Nd}]", "")))
    capitals = (F.length(t) <= 60) & (_words(t) <= 6) & (_letters(t) >= 2) & (F.upper(t) == t) & ~t.rlike(BULLET)
    return line.rlike(MARKDOWN) | ((numbered | capitals) & ~t.rlike(TERMINAL) & ~is_row(t) & ~is_rule(t))


def heading_level(line: Column) -> Column:
    hashes = F.length(F.regexp_extract(line, r"^(#{1,6})[ \t]*", 1))
    number = F.regexp_extract(F.trim(line), r"^(\d{1,3}(?:\.\d{1,3}){0,4})[.)]?[ \t]", 1)
    return F.when(hashes > 0, hashes).when(number != "", F.regexp_count(number, F.lit(r"\.")) + 1).otherwise(1)


def heading_text(line: Column) -> Column:
    plain = F.trim(F.regexp_replace(line, r"^#{1,6}[ \t]*", ""))
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(plain, r"^\d{1,3}(?:\.\d{1,3}){0,4}[.)]?[ \t]+", ""), r"\s+", " ")), 1, 80)


def kind(line: Column) -> Column:
    """blank, heading, separator, table, bullet, caption, page_mark or text; the first that fits."""
    return (
        F.when(~line.rlike(r"\S"), "blank").when(is_heading(line), "heading").when(is_rule(line), "separator").when(is_row(line), "table")
        .when(line.rlike(BULLET), "bullet").when(line.rlike(CAPTION), "caption").when(line.rlike(PAGE), "page_mark").otherwise("text")
    )


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, pos, line, kind): a document's lines, numbered from 1; white space at a line's end is dropped."""
    text = F.regexp_replace(F.col(text_col), r"\r\n?", "\n")
    # cut before they are exploded: what is computed below that would be put in for each of the many uses of a line
    own = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"\s+$", ""))
    each = docs.select(F.col(id_col).alias("doc"), F.posexplode(own).alias("pos", "line"))
    return each.select("doc", (F.col("pos") + 1).alias("pos"), "line", kind(F.col("line")).alias("kind"))


def furniture(marked: DataFrame) -> DataFrame:
    """(doc, key, n, page_marks): short fragments that a document repeats: running headers, footers, page numbers. Sentences, turns, headings, lists and tables are none."""
    t = F.trim("line")
    short = (F.length(t) <= SHORT_CHARS) & (_words(t) <= SHORT_WORDS) & ~t.rlike(TERMINAL) & ~t.rlike(TURN) & F.col("kind").isin("text", "caption", "page_mark") & ((_letters(t) > 0) | t.rlike(PAGE))
    g = marked.where(short).groupBy("doc", running_key(F.col("line")).alias("key")).agg(F.count("*").alias("n"), F.count_if(t.rlike(PAGE)).alias("page_marks"))
    return g.where(F.col("n") >= REPEATS)


def running_key(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def sections(marked: DataFrame) -> DataFrame:
    """Adds ``path``, array of (at, title): the headings a line stands under. A heading ends those of its level and deeper; each level's last heading comes from one window."""
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col("kind") == "heading", heading_level(F.col("line")))
    df = marked.withColumn("_level", level)
    for n in range(1, LEVELS + 1):
        df = df.withColumn(f"_h{n}", F.last(F.when(F.col("_level") == n, F.struct(F.col("pos").alias("at"), heading_text(F.col("line")).alias("title"))), ignorenulls=True).over(w))
    alive = [F.when(reduce(lambda a, b: a & b, (F.col(f"_h{n}.at") > F.coalesce(F.col(f"_h{k}.at"), F.lit(0)) for k in range(1, n)), F.lit(True)), F.col(f"_h{n}")) for n in range(1, LEVELS + 1)]
    return df.withColumn("path", F.array_compact(F.array(*alive))).drop("_level", *[f"_h{n}" for n in range(1, LEVELS + 1)])


def blocks(sectioned: DataFrame) -> DataFrame:
    """Lines that aren't blank, with block (a number), form (heading, table, list or para) and rows (of the block that are a table's).

    Runs of rows are a table if they are two or more or hold a rule, a caption next to them goes along; bullets and what is indented below
    them are a list; a heading stands alone; what lies between blank lines and these is a paragraph.
    """
    w = Window.partitionBy("doc").orderBy("pos")
    form = F.when(F.col("kind") == "blank", "").when(F.col("kind") == "heading", "heading").when(F.col("kind").isin("table", "separator"), "table").when(F.col("kind") == "bullet", "list").otherwise("para")
    df = sectioned.withColumn("form", form).withColumn("_island", F.sum((F.col("form") == "").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    indented = F.col("line").rlike(r"^(?:  |\t)")
    above = F.last(F.when(~indented, F.col("form")), ignorenulls=True).over(Window.partitionBy("doc", "_island").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("form", F.when(indented & (F.col("form") != "") & (above == "list"), "list").otherwise(F.col("form")))
    beside = F.lead("form").over(w).eqNullSafe(F.lit("table")) | F.lag("form").over(w).eqNullSafe(F.lit("table"))
    df = df.withColumn("form", F.when((F.col("kind") == "caption") & (F.col("form") == "para") & beside, "table").otherwise(F.col("form")))
    before = F.lag("form").over(w)
    opens = (F.col("form") != "") & (before.isNull() | (before != F.col("form")) | (F.col("form") == "heading"))
    df = df.withColumn("block", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("form <> ''")
    b = Window.partitionBy("doc", "block")
    table = (F.count_if(F.col("kind") == "table").over(b) >= 2) | (F.count_if(F.col("kind") == "separator").over(b) > 0)
    return df.withColumn("form", F.when((F.col("form") == "table") & ~table, "para").otherwise(F.col("form"))).drop("_island")


def _fold(costs: Column, room: Column) -> Column:
    """Greedy packing of costs in order: array of bin numbers."""
    start = F.struct(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        full = (acc["used"] > 0) & (acc["used"] + c > room)
        at = F.when(full, acc["bin"] + 1).otherwise(acc["bin"])
        return F.struct(at.alias("bin"), F.when(full, c).otherwise(acc["used"] + c).alias("used"), F.concat(acc["out"], F.array(at)).alias("out"))

    return F.aggregate(costs, start, step, lambda acc: acc["out"])


def _merge(pieces: Column, floor: int, window: int, either: bool) -> Column:
    """Bins of pieces (cost, form) in order: one below the floor takes the next in if both fit, with ``either`` also goes to the one before; two tables stay apart."""
    start = F.struct(F.lit(-1).alias("bin"), F.lit(0).cast("long").alias("used"), F.lit("").alias("form"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        small = (acc["used"] < floor) | (F.lit(either) & (p["cost"] < floor))
        joins = (acc["bin"] >= 0) & small & (acc["used"] + 1 + p["cost"] <= window) & ~((acc["form"] == "table") & (p["form"] == "table"))
        at = F.when(joins, acc["bin"]).otherwise(acc["bin"] + 1)
        form = F.when(joins & (acc["form"] == "table"), "table").otherwise(p["form"])
        return F.struct(at.alias("bin"), F.when(joins, acc["used"] + 1 + p["cost"]).otherwise(p["cost"]).alias("used"), form.alias("form"), F.concat(acc["out"], F.array(at)).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def _welded(p: DataFrame, floor: int, window: int, either: bool) -> DataFrame:
    """(doc, at, form, section, body, cost): pieces joined as ``_merge`` says."""
    docs = p.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "cost", "form", "section", "body"))).alias("ps")).withColumn("bin", _merge(F.col("ps"), floor, window, either))
    each = docs.select("doc", F.explode(F.arrays_zip("ps", "bin")).alias("z")).select("doc", "z.bin", "z.ps.*")
    g = each.groupBy("doc", "bin").agg(
        F.min("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), "\n").alias("body"),
        F.max_by("section", F.struct(F.size("section"), -F.col("at.group"), -F.col("at.lane"), -F.col("at.bin"))).alias("section"),
        F.when(F.max(F.col("form") == "table"), "table").when(F.max(F.col("form") == "section"), "section").otherwise(F.min_by("form", "at")).alias("form"),
    )
    return g.select("doc", "at", "form", "section", "body", over_count(F.col("body")).cast("long").alias("cost"))


def _cells(line: Column) -> Column:
    t = F.trim(line)
    piped = F.transform(F.split(F.regexp_replace(t, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return F.when(t.startswith("|"), piped).when(F.contains(line, F.lit("\t")), F.transform(F.split(line, "\t"), lambda c: F.trim(c))).otherwise(F.split(t, r"[ \t]{2,}"))


def _cost(text: Column) -> Column:
    """Tokens of a text with what joins it to the next: sums of these are never below the count of the joined text."""
    return over_count(F.concat(text, F.lit("\n"))).cast("long")


def _few(text: Column, room: Column) -> Column:
    """Runs of whole words, each well below ``room`` tokens."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    n = F.greatest(F.lit(1), F.floor(room / 16)).cast("int")
    at = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), n))
    return F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))


def _atoms(line: Column, form: Column, room: Column) -> Column:
    """What a line of a block beyond the window is cut into: a table's row stays whole, or by cells with its first cell repeated; other lines by sentences; what is longer still by words."""
    cells = _cells(line)
    key = F.get(cells, F.lit(0))
    inner = F.greatest(F.lit(8), room - over_count(key) - 4)
    parts = F.flatten(F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda c: F.when(over_count(c) > inner, _few(c, inner)).otherwise(F.array(c))))
    keyed = F.transform(parts, lambda c: F.when(F.trim(line).startswith("|"), F.concat(F.lit("| "), key, F.lit(" | "), c, F.lit(" |"))).otherwise(F.concat_ws("\t", key, c)))
    row = F.when(_cost(line) <= room, F.array(line)).when(F.size(cells) > 1, keyed).otherwise(_few(line, room))
    sentences = F.filter(F.split(line, r"(?<=[.!?…])\s+"), lambda s: s != "")
    prose = F.flatten(F.transform(sentences, lambda s: F.when(_cost(s) <= room, F.array(s)).otherwise(_few(s, room))))
    return F.when(form == "table", row).otherwise(prose)


def pieces(docs: DataFrame, window: int = 7500, floor: int = 150, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, part, parts, form, section, body, tokens): documents cut where they are built, within ``window`` tokens.

    Furniture goes. The largest section that fits stays whole; of one that doesn't, its subsections stand by themselves and what lies between is packed block by block.
    A table beyond the window is cut between rows, its header rows stand on each piece, its caption and a heading before it on the first; a row beyond it is
    cut between cells with its first cell repeated. Other blocks are cut between sentences into pieces of like size, and only then between words. A single
    word beyond the window stays as it is. Pieces below ``floor`` take the next one in; what is left of them goes to the one before. Null and blank texts have no pieces.

    Everything is keyed by document, so a document's lines meet in one task and large tables of documents are dealt over all.
    """
    marked = lines(docs, id_col, text_col)
    marked = cut(marked.withColumn("key", running_key(F.col("line"))).join(furniture(marked), ["doc", "key"], "left_anti").drop("key"))
    df = blocks(sections(marked)).withColumn("cost", _cost(F.col("line")))
    at = F.transform("path", lambda p: p["at"])
    sums = [F.when(F.size("path") >= n, F.sum("cost").over(Window.partitionBy("doc", F.slice(at, 1, n)))) for n in range(1, LEVELS + 1)]
    df = df.withColumn("_sums", F.array_compact(F.array(*sums)))
    # the shallowest section that fits; 0 where none does
    fits = F.array_position(F.transform("_sums", lambda s: s <= window), True).cast("int")
    front = F.sum("cost").over(Window.partitionBy("doc", F.size("path") == 0))
    df = df.withColumn("_fits", fits)
    df = df.withColumns({"group": F.when(F.size("path") == 0, 0).when(F.col("_fits") > 0, F.get(at, F.col("_fits") - 1)).otherwise(F.element_at(at, -1)), "split": F.when(F.size("path") == 0, front > window).otherwise(F.col("_fits") == 0)})
    # a heading before a block beyond the window goes with it
    b = Window.partitionBy("doc", "block")
    df = df.withColumn("big", F.col("split") & (F.sum("cost").over(b) > window))
    g = Window.partitionBy("doc", "group").orderBy("pos")
    after = F.first(F.when(F.col("form") != "heading", F.struct("block", "big")), ignorenulls=True).over(g.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_after", after).withColumns({"lead": F.coalesce((F.col("form") == "heading") & ~F.col("big") & F.col("_after.big") & (F.col("_after.block") == F.col("block") + 1), F.lit(False)), "unit": F.col("block")})
    df = df.withColumn("unit", F.when(F.col("lead"), F.col("block") + 1).otherwise(F.col("block"))).withColumn("big", F.col("big") | F.col("lead"))
    previous = F.lag(F.struct("unit", "big")).over(g)
    opens = previous.isNull() | ((previous["unit"] != F.col("unit")) & (F.col("big") | previous["big"]))
    df = df.withColumn("lane", F.sum(opens.cast("int")).over(g.rowsBetween(Window.unboundedPreceding, 0)))
    # header rows of a table: what stands before its rule, or a first row without a figure above rows that have some
    t = Window.partitionBy("doc", "group", "lane")
    in_table = F.col("big") & (F.max(F.when(~F.col("lead"), F.col("form"))).over(t) == "table")
    nth = F.when(F.col("kind").isin("table", "separator"), F.sum(F.col("kind").isin("table", "separator").cast("int")).over(t.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumns({"table": in_table, "_nth": F.when(in_table, nth)})
    ruled = F.max((F.col("_nth") == 2) & (F.col("kind") == "separator")).over(t)
    figures = F.exists(_cells(F.col("line")), lambda c: c.rlike(r"^[-+−(]?[$€£]?\d[\d,. ]*%?\)?$"))
    named = ~F.coalesce(F.max(F.when(F.col("_nth") == 1, figures)).over(t), F.lit(True)) & F.coalesce(F.max(F.when(F.col("_nth") > 1, figures)).over(t), F.lit(False))
    df = df.withColumn("head", F.coalesce(F.when(ruled, F.col("_nth") <= 2).when(named, F.col("_nth") == 1), F.lit(False)))
    header = F.when(F.col("table"), F.concat_ws("\n", F.array_sort(F.collect_list(F.when(F.col("head"), F.struct("pos", "line"))).over(t))["line"]))
    df = df.withColumn("header", F.coalesce(header, F.lit("")))
    room = F.greatest(F.lit(16), F.lit(window) - F.when(F.col("header") != "", _cost(F.col("header"))).otherwise(0))
    df = df.withColumn("room", room.cast("long"))
    # rows to units: whole blocks where they fit, atoms where they don't
    whole = df.where("not big").groupBy("doc", "group", "lane", "unit").agg(F.min("pos").alias("pos"), F.min(F.struct("form", "path")).alias("f"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    whole = whole.select("doc", "group", "lane", "pos", F.lit(0).alias("sub"), "text", F.col("f.form").alias("form"), F.col("f.path").alias("path"), F.lit("").alias("header"), F.lit(window).cast("long").alias("room"), F.lit("\n").alias("glue"), F.lit(False).alias("even"))
    cut_up = df.where("big and not head").withColumn("a", F.when((F.col("lead") | (F.col("kind") == "caption")) & (F.col("cost") <= F.col("room")), F.array("line")).otherwise(_atoms(F.col("line"), F.when(F.col("table") & F.col("kind").isin("table", "separator"), "table").otherwise("para"), F.col("room"))))
    atoms = cut_up.select("doc", "group", "lane", "pos", F.posexplode("a").alias("sub", "text"), F.when(F.col("table"), "table").otherwise(F.col("form")).alias("form"), "path", "header", "room", F.when(F.col("table"), "\n").otherwise(" ").alias("glue"), (~F.col("table")).alias("even"))
    units = whole.unionByName(atoms).withColumn("cost", _cost(F.col("text")))
    key = ["doc", "group", "lane"]
    lanes = units.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "sub", "cost", "text", "form", "path"))).alias("u"), F.max("header").alias("header"), F.min("room").alias("room"), F.max("glue").alias("_g"), F.max("even").alias("even"))
    costs = F.transform("u", lambda x: x["cost"])
    total = F.aggregate(costs, F.lit(0).cast("long"), lambda a, c: a + c)
    lanes = lanes.withColumns({"greedy": _fold(costs, F.col("room")), "_total": total})
    # of like size: the room shrinks to an even share, if that needs no further piece
    share = F.ceil(F.col("_total") / (F.element_at("greedy", -1) + 1)) + F.array_max(costs) / 2
    level = _fold(costs, F.least(share, F.col("room")).cast("long"))
    bins = F.when(F.col("even") & (F.element_at("greedy", -1) > 0) & (F.element_at(level, -1) == F.element_at("greedy", -1)), level).otherwise(F.col("greedy"))
    each = lanes.select(*key, "header", "even", F.explode(F.arrays_zip("u", bins.alias("bin"))).alias("z")).select(*key, "header", "even", "z.u.*", "z.bin")
    body = F.transform(F.array_sort(F.collect_list(F.struct("pos", "sub", "text"))), lambda x: x["text"])
    p = each.groupBy(*key, "bin").agg(body.alias("texts"), F.min(F.struct("pos", "sub", "path")).alias("first"), F.max("header").alias("header"), F.max("even").alias("even"), F.min_by("form", F.struct(F.col("form") == "heading", "pos", "sub")).alias("form"), F.max(F.col("form") == "heading").alias("has_heading"))
    joined = F.when(F.col("even"), F.array_join("texts", " ")).otherwise(F.array_join("texts", "\n"))
    # a lane of a table: caption and heading first, then the header rows, then rows
    lead_in = F.filter(F.col("texts"), lambda x: ~is_row(x) & ~is_rule(x))
    rows_of = F.filter(F.col("texts"), lambda x: is_row(x) | is_rule(x))
    table_body = F.concat_ws("\n", lead_in, F.array("header"), rows_of)
    p = p.withColumn("body", F.when(F.col("header") != "", table_body).otherwise(joined))
    p = p.select("doc", F.struct("group", "lane", "bin").alias("at"), F.when(F.col("form") == "table", "table").when(F.col("has_heading"), "section").otherwise(F.col("form")).alias("form"), F.transform("first.path", lambda x: x["title"]).alias("section"), "body", over_count(F.col("body")).cast("long").alias("cost"))
    out = _welded(_welded(p, floor, window, False), floor, window, True)
    n = Window.partitionBy("doc")
    return out.select("doc", F.row_number().over(n.orderBy("at")).cast("long").alias("part"), F.count("*").over(n).alias("parts"), "form", "section", "body", F.col("cost").alias("tokens"))


def with_headers(cut_docs: DataFrame, titles: DataFrame | None = None, most: int = 25, shuffled: bool = False) -> DataFrame:
    """``cut_docs`` with ``header``: [Doc: title | Date: date | Section: a / b | Part k/n] within ``most`` tokens.

    ``titles`` has (doc, title, date). What is missing isn't shown. To fit, the deepest sections go first, then the path, the date, the title; the part always stays. ``shuffled`` gives each piece the
    header of the one after it, as a placebo of equal cost.
    """
    df = cut_docs.join(titles.select("doc", "title", "date"), "doc", "left") if titles is not None else cut_docs.withColumns({"title": F.lit(None).cast("string"), "date": F.lit(None).cast("string")})
    part = F.concat(F.lit("Part "), F.col("part").cast("string"), F.lit("/"), F.col("parts").cast("string"))
    named = lambda name, c: F.when(F.coalesce(F.trim(c) != "", F.lit(False)), F.concat(F.lit(f"{name}: "), F.trim(c)))
    wrap = lambda *fields: F.concat(F.lit("["), F.concat_ws(" | ", *fields), F.lit("]"))
    doc, date = named("Doc", F.col("title")), named("Date", F.col("date"))
    steps = F.reverse(F.sequence(F.lit(0), F.size("section")))
    by_path = F.transform(steps, lambda n: wrap(doc, date, F.when(n > 0, F.concat(F.lit("Section: "), F.array_join(F.slice("section", F.lit(1), n), " / "))), part))
    ladder = F.concat(by_path, F.array(wrap(doc, part), wrap(part)))
    short = F.filter(ladder, lambda h: over_count(h) <= most)
    df = df.withColumn("header", F.coalesce(F.get(short, F.lit(0)), wrap(part))).drop("title", "date")
    if shuffled:
        w = Window.partitionBy("doc").orderBy("part")
        df = df.withColumn("header", F.coalesce(F.lead("header").over(w), F.first("header").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return df


def payloads(cut_docs: DataFrame, delimiters: Sequence[str] = DELIMITERS) -> DataFrame:
    """(doc, delimiter, payload): a document's pieces, with headers if they have some, between the first delimiter that none of them holds.

    If they hold all, the first is lengthened by a hash of the text, so that one text always has one delimiter; a document of one piece has none.
    """
    said = F.concat_ws("\n", *(["header"] if "header" in cut_docs.columns else []), "body")
    g = cut_docs.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", said.alias("said")))), lambda x: x["said"]).alias("all"))
    marks = F.array(*[F.lit(d) for d in delimiters])
    absent = F.filter(marks, lambda d: ~F.exists("all", lambda t: F.contains(t, F.trim(F.translate(d, "\n", "")))))
    made = F.concat(F.lit("\n\n<<<CHUNK-BREAK-"), F.upper(F.substring(F.sha2(F.concat_ws("\n", "all"), 256), 1, 16)), F.lit(">>>\n\n"))
    g = g.withColumn("delimiter", F.when(F.size("all") > 1, F.coalesce(F.get(absent, F.lit(0)), made)))
    return g.select("doc", "delimiter", F.call_function("array_join", F.col("all"), F.coalesce("delimiter", F.lit(""))).alias("payload"))


#: What makes a line look like a row of a table set in columns.
GAP = r"\S[ \t]{2,}\S"
FIGURE = r"(?U)(?<![\w.])[-+−]?\d[\d,\u00a0.]*%?(?![\w])"


def looks_tabular(line: Column) -> Column:
    """A line set in columns: it starts with a bar, has a gap between words, or two figures."""
    t = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    return (t != "") & (F.length(t) <= 600) & (t.rlike("^[|│]") | ((_words(t) >= 2) & (t.rlike(GAP) | (F.regexp_count(t, F.lit(FIGURE)) >= 2))))


def _indent(line: Column) -> Column:
    wide = F.replace(line, F.lit("\t"), F.lit("    "))
    return F.length(wide) - F.length(F.regexp_replace(wide, "^ +", ""))


def wrapped_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text): texts whose table rows were wrapped over lines, one line a row again; no character is lost but white space at ends.

    A block opens with a line set in columns and goes on while lines aren't blank and are such lines too or stand deeper than its first;
    in it, lines at its smallest indent open rows and deeper ones go on with the row above. Other lines stay. A null text stays null.
    """
    own = F.split(F.regexp_replace(F.col(text_col), r"\r\n?", "\n"), "\n", -1)
    marked = F.transform(own, lambda x: F.struct(x.alias("line"), (F.trim(F.regexp_replace(x, r"(?U)\s", "")) == "").alias("blank"), looks_tabular(x).alias("row"), _indent(x).alias("indent")))
    start = F.struct(F.lit(0).alias("block"), F.lit(False).alias("open"), F.lit(0).alias("floor"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        goes_on = acc["open"] & ~x["blank"] & (x["row"] | (x["indent"] > acc["floor"]))
        opens = ~goes_on & ~x["blank"] & x["row"]
        block = acc["block"] + opens.cast("int")
        return F.struct(block.alias("block"), (goes_on | opens).alias("open"), F.when(opens, x["indent"]).otherwise(acc["floor"]).alias("floor"), F.concat(acc["out"], F.array(F.when(goes_on | opens, block).otherwise(0))).alias("out"))

    texts = docs.select(F.col(id_col).alias("doc"), F.monotonically_increasing_id().alias("_row"), marked.alias("ls"))
    zipped = texts.withColumn("b", F.aggregate("ls", start, step, lambda acc: acc["out"]))
    each = zipped.select("doc", "_row", F.posexplode_outer(F.arrays_zip("ls", "b")).alias("pos", "z")).select("doc", "_row", "pos", "z.ls.*", F.col("z.b").alias("block"))
    least = F.min("indent").over(Window.partitionBy("_row", "block"))
    opens = (F.col("block") == 0) | (F.col("indent") <= least) | ~F.lag("block").over(Window.partitionBy("_row").orderBy("pos")).eqNullSafe(F.col("block"))
    each = each.withColumn("n", F.sum(opens.cast("int")).over(Window.partitionBy("_row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    shown = F.when(F.col("block") > 0, F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).otherwise(F.regexp_replace("line", r"(?U)\s+$", ""))
    rows = each.groupBy("doc", "_row", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("x")))), lambda y: y["x"]), "  ").alias("x"), F.count("line").alias("lines"))
    return rows.groupBy("doc", "_row").agg(F.when(F.sum("lines") > 0, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda y: y["x"]), "\n")).alias("text")).drop("_row")
