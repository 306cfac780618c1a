"""Routing, visual lines, sections, tables and measurements of page text (L1-L16)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medtab.functions.text import BLANK_INSIDE, SEPARATOR, SOLID, even_ends, once, strip, strip_markup
from medtab.operators.sides import read_once
from medtab.sources.scratch import kept

#: Characters that make a text page, share of text pages of a digital document, line and column gaps.
TEXT_PAGE_CHARS, DIGITAL_SHARE, LINE_GAP, COLUMN_GAP = 30, 0.5, 3.0, 25.0


def inspect(pages: DataFrame) -> DataFrame:
    """Per document: pages, characters, text and image-only pages, and its route (digital, scanned, unknown)."""
    n = F.length(strip(F.coalesce("text", F.lit(""))))
    per = pages.select("doc_id", "page", n.alias("n"), F.coalesce("n_images", F.lit(0)).alias("images"))
    out = per.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.sum("n").alias("chars"), F.count_if(F.col("n") >= TEXT_PAGE_CHARS).alias("text_pages"),
                                    F.count_if((F.col("n") < TEXT_PAGE_CHARS) & (F.col("images") > 0)).alias("image_pages"))
    share = F.col("text_pages") / F.col("page_count")
    route = F.when(share >= DIGITAL_SHARE, "digital").when(F.col("image_pages") > 0, "scanned").otherwise("unknown")
    return out.withColumn("source_type", route)


def select_extractor(candidates: DataFrame) -> DataFrame:
    """The extractor a document goes on with: ``candidates(doc_id, extractor, priority, success, status, n_tables,
    n_measurements, errors)``.

    The first is taken if its quality is GOOD and it has no tables without measurements; else a later one that succeeded;
    with none, the row is FAILED and has all errors, also where the first gave a text that was not good enough.
    """
    good = F.col("success") & (F.col("status") == "GOOD") & ~((F.col("n_tables") > 0) & (F.col("n_measurements") == 0))
    rank = F.when((F.col("priority") == 1) & good, 0).when((F.col("priority") > 1) & F.col("success"), 1)
    pick = F.min_by(F.struct("extractor", "status"), F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("priority").alias("p"))))
    out = candidates.groupBy("doc_id").agg(pick.alias("x"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("priority", "errors"))), lambda s: s["errors"])).alias("errors"))
    return out.select("doc_id", F.col("x.extractor").alias("extractor"), F.coalesce("x.status", F.lit("FAILED")).alias("status"), F.when(F.col("x").isNull(), F.col("errors")).otherwise(F.array().cast("array<string>")).alias("errors"))


def rebuild_lines(words: DataFrame, line_gap: float = LINE_GAP, column_gap: float = COLUMN_GAP) -> DataFrame:
    """Word boxes as visual lines ``(doc_id, page, line_no, line)``; a wide gap between words becomes " | ".

    Words come in the order of ``word_no`` (then height, x0). Each joins the first line whose first word's centre is within the gap of
    its own in height, or begins a line, so a drifting baseline breaks instead of running on. Lines stand by the height of
    their first word, words by x0. Words without a height share a last line; blank ones are left out.
    """
    height = F.coalesce((F.col("y0") + F.col("y1")) / 2, F.lit(1e300))
    word = F.struct("word_no", height.alias("y"), "x0", "x1", strip(F.col("text")).alias("text"))
    per_page = words.where(strip(F.col("text")) != "").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(word)).alias("ws"))
    near = lambda a, w: F.abs(a - w["y"]) <= line_gap
    firsts = F.aggregate("ws", F.array().cast("array<double>"), lambda seen, w: F.when(F.exists(seen, lambda a: near(a, w)), seen).otherwise(F.concat(seen, F.array(w["y"]))))
    placed = per_page.withColumn("firsts", firsts).select("doc_id", "page", F.explode(F.transform("ws", lambda w: F.struct(F.get(F.filter("firsts", lambda a: near(a, w)), F.lit(0)).alias("first"), w["x0"].alias("x0"), w["word_no"].alias("word_no"), w["y"].alias("y"), w["x1"].alias("x1"), w["text"].alias("text")))).alias("w"))
    lines = placed.groupBy("doc_id", "page", F.col("w.first").alias("first")).agg(F.array_sort(F.collect_list("w")).alias("ws"))
    gap = lambda w, i: w["x0"] - F.get("ws", i - 1)["x1"] > column_gap
    bits = F.transform("ws", lambda w, i: F.concat(F.when(i == 0, "").when(gap(w, i), " | ").otherwise(" "), w["text"]))
    number = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("first"))
    return lines.select("doc_id", "page", number.alias("line_no"), F.array_join(bits, "").alias("line"))


def assemble(pages: DataFrame, marker: bool = True) -> DataFrame:
    """Whole document text ``(doc_id, text)``, pages in order, each under a page marker."""
    head = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n")) if marker else F.lit("")
    bits = F.collect_list(F.struct("page", F.concat(head, F.coalesce("text", F.lit(""))).alias("t")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(bits), lambda s: s["t"]), "\n\n").alias("text"))


HEADING = r"^#{1,6}\s+"
CAPITALS = r"^[A-Z][A-Z0-9\s\-/&():,.]+$"
#: Lines of a whole text with even ends as expressions: what a line may hold, its leading blanks, a character that is none.
_IN_LINE, _INDENT, _SOLID = r"[^\n]", BLANK_INSIDE, SOLID
#: A line in capitals of five characters or more, without the blanks around it, up to its end.
_LOUD = rf"{_INDENT}*+[A-Z][A-Z0-9 \t\-/&():,.]{{3,}}[A-Z0-9\-/&():,.]{_INDENT}*+(?!{_IN_LINE})"


def _sections(pages: DataFrame, heading: str, title: Callable[[Column], Column]) -> DataFrame:
    """A page is cut before each line that ``heading`` matches from its start, without parting it into rows of lines; pieces
    are read where they are cut, so that no filter reads them again."""

    def read(piece: Column) -> Column:
        halves = F.when(piece.rlike(rf"^{heading}"), F.split(piece, "\n", 2)).otherwise(F.array(F.lit(None).cast("string"), piece))
        return once(halves, lambda h: F.struct(title(h[0]).alias("title"), strip(F.coalesce(F.get(h, F.lit(1)), F.lit(""))).alias("text")))

    cut = F.split(even_ends(F.coalesce("text", F.lit(""))), rf"\n(?={heading})")
    out = pages.select("doc_id", "page", F.posexplode(F.transform(cut, read)).alias("part", "s")).select("doc_id", "page", "part", "s.title", "s.text")
    out = out.where((F.coalesce("title", F.lit("")) != "") | (F.col("text") != ""))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "part"))
    return out.select("doc_id", "page", number.alias("section_no"), F.nullif("title", F.lit("")).alias("title"), "text")


def sections_markdown(pages: DataFrame) -> DataFrame:
    """``sections`` of Markdown pages: a heading starts one, on each page anew; what stands before has no title."""
    return _sections(pages, r"#{1,6}[ \t]", lambda line: strip(F.regexp_replace(line, HEADING, "")))


def sections_plain(pages: DataFrame) -> DataFrame:
    """``sections`` of plain pages: a line in capitals of more than four characters starts one; a trailing colon goes."""
    return _sections(pages, _LOUD, lambda line: F.regexp_replace(strip(line), r":+$", ""))


#: Lines that begin with a pipe; lines with a column break between two of their characters.
_PIPED = rf"{_INDENT}*+\|{_IN_LINE}*+"
_BROKEN = rf"{_INDENT}*+{_SOLID}{_IN_LINE}*? \| {_IN_LINE}*?{_SOLID}{_IN_LINE}*+"


def _blocks(pages: DataFrame, line: str, reset: bool) -> DataFrame:
    """Tables ``(doc_id, page, block, title, lines)``: runs of two or more lines that ``line`` matches, with the line before them.

    Runs are cut out of a page's text at once; between them is what may name the next one: its last line that is not blank.
    Without ``reset`` a table that follows another after blank lines only is named like that.
    """
    run = rf"(?dm)^{line}(?:\n{line})*+"
    # marked in one go, by a character that no text with even ends holds: gaps and runs stand in turn
    cut = F.split(F.regexp_replace(even_ends(F.coalesce("text", F.lit(""))), run, "\u001e$0\u001e"), "\u001e")
    found = pages.select("doc_id", "page", cut.alias("cut")).select("doc_id", "page", F.filter("cut", lambda x, i: i % 2 == 0).alias("gaps"), F.filter("cut", lambda x, i: i % 2 == 1).alias("runs"))
    last = F.transform(F.slice("gaps", F.lit(1), F.size("runs")), lambda g: F.nullif(strip(F.element_at(F.split(strip(g), "\n"), -1)), F.lit("")))
    if not reset:
        found = found.withColumn("last", last)
        last = F.transform("last", lambda g, i: F.coalesce(g, F.try_element_at(F.filter(F.slice("last", F.lit(1), i), lambda x: x.isNotNull()), F.lit(-1))))
    rows = found.select("doc_id", "page", F.posexplode(F.arrays_zip(last.alias("title"), F.col("runs").alias("run"))).alias("block", "b"))
    rows = rows.where(F.col("b.run").contains("\n")).select("doc_id", "page", "block", "b.title", F.transform(F.split("b.run", "\n"), strip).alias("lines"))
    return rows.withColumn("title", F.when(~F.col("title").contains(" | ") & (F.length("title") < 120), F.col("title")))


FIELDS = ("name", "value", "unit", "reference_range")
#: Header words of each field, in the order in which a header is tried.
FIELD_WORDS = {
    "name": r"(?i)\b(measurements?|parameters?|tests?|names?|descriptions?)\b",
    "value": r"(?i)\b(value|result|finding|reading)\b",
    "unit": r"(?i)\b(units?|u|nit)\b",
    "reference_range": r"(?i)\b(reference|range|ref|expected|normal\s+values?|refere|nce)\b",
}


def column_map(headers: Column) -> Column:
    """struct of each field's 0-based column (null: none): a header goes to the first field whose word it has and that is
    still free; with no value column, the first blank header left over is it."""
    clean = F.transform(headers, lambda h: strip_markup(h))
    said = F.transform(clean, lambda h, i: F.struct(i.alias("i"), F.array(*(h.rlike(FIELD_WORDS[f]) for f in FIELDS)).alias("has")))
    first = lambda acc, has: F.array_position(F.zip_with(acc, has, lambda a, b: (a < 0) & b), F.lit(True))
    step = lambda acc, h: once(first(acc, h["has"]), lambda k: F.transform(acc, lambda a, j: F.when(j + 1 == k, h["i"]).otherwise(a)))
    found = F.aggregate(said, F.array_repeat(F.lit(-1), len(FIELDS)), step)
    number = lambda x: F.when(x >= 0, x)
    spare = lambda m: F.get(F.filter(F.transform(clean, lambda h, i: F.when((h == "") & ~F.array_contains(m, i), i)), lambda i: i.isNotNull()), F.lit(0))
    return once(found, lambda m: F.struct(*((F.coalesce(number(m[k]), spare(m)) if f == "value" else number(m[k])).alias(f) for k, f in enumerate(FIELDS))))


def _read_rows(body: DataFrame) -> DataFrame:
    """Rows ``(headers, m, names, r, ...)``, ``r`` being cells as they stand and without marks, with what they say under their header."""
    body = body.select(*body.columns, "r.cells", "r.clean")
    field = lambda f: F.nullif(F.try_element_at("clean", F.col(f"m.{f}") + 1), F.lit(""))
    used = F.array_compact(F.array(*(F.col(f"m.{f}") for f in FIELDS)))
    spare = F.filter(F.transform(F.slice("clean", F.lit(1), F.size("headers")), lambda c, i: F.struct(F.element_at("names", i + 1).alias("k"), c.alias("v"), i.alias("i"))),
                     lambda s: (s["v"] != "") & ~F.array_contains(used, s["i"]))
    body = body.withColumn("spare", spare)
    # of equal headers the last cell counts
    last = F.filter("spare", lambda s: ~F.exists("spare", lambda o: (o["k"] == s["k"]) & (o["i"] > s["i"])))
    extra = F.map_from_entries(F.transform(last, lambda s: F.struct(s["k"], s["v"])))
    return body.select(*(c for c in body.columns if c not in ("m", "names", "r", "clean", "spare")), *(field(f).alias(f) for f in FIELDS), extra.alias("extra"))


def _table_rows(blocks: DataFrame, cells: Callable[[Column], Column], strict_parity: bool, repeated: bool = False) -> DataFrame:
    """Rows of tables; ``repeated`` ones are stored as lines, and each different one (with its table's header) is read once."""
    cut = SEPARATOR if strict_parity else r"^\|[\s\-:|]*-[\s\-:|]*\|$"
    # a letter in the third place tells a row from a separator at once
    third = lambda x: F.substring(x, 3, 1)
    rows = blocks.withColumn("lines", F.filter("lines", lambda x: third(x).between("A", "z") | ~x.rlike(cut))).withColumn("head", F.get("lines", F.lit(0)))
    mapped = lambda df: df.withColumn("headers", cells(F.col("head"))).withColumns({"m": column_map(F.col("headers")), "names": F.transform("headers", lambda h: strip_markup(h))})
    body_lines = F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))
    read = lambda bare: once(cells(bare), lambda cs: F.struct(cs.alias("cells"), F.transform(cs, lambda c: strip_markup(c)).alias("clean")))
    if repeated:
        lines = kept(rows.select("doc_id", "page", "block", "title", "head", F.posexplode(body_lines).alias("k", "line")), "lines")
        body = read_once(lines, ["head", "line"], lambda df: _read_rows(read_once(df, ["head"], mapped, "heads").withColumn("r", read(F.col("line")))), "different")
    else:  # headers are mapped once for each table, and cells read once for each row, before rows part: filters on them then cost nothing
        found = mapped(rows).withColumn("read", F.transform(body_lines, read))
        body = _read_rows(found.select("doc_id", "page", "block", "title", "headers", "m", "names", F.posexplode("read").alias("k", "r")))
    number = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page", "block"))
    return body.select("doc_id", "page", number.alias("table_no"), (F.col("k") + 1).alias("row_no"), "title", "headers", "cells", *FIELDS, "extra")


def tables_markdown(pages: DataFrame, strict_parity: bool = True, repeated: bool = False) -> DataFrame:
    """``table_rows`` of Markdown pages: runs of lines that start with a pipe; the first row is the header.

    The separator test also takes rows whose first cell is blank; ``strict_parity=False`` keeps those. Where rows repeat over
    many tables, ``repeated`` has them stored and each different one read once.
    """
    cells = lambda bare: F.transform(F.split(F.regexp_replace(bare, r"^\|+|\|+$", ""), r"\|"), strip)
    return _table_rows(_blocks(pages, _PIPED, reset=True), cells, strict_parity, repeated)


def tables_plain(pages: DataFrame) -> DataFrame:
    """``table_rows`` of plain pages: runs of lines with column breaks; empty cells are left out."""
    cells = lambda bare: F.filter(F.transform(F.split(bare, r"\|"), strip), lambda c: c != "")
    return _table_rows(_blocks(pages, _BROKEN, reset=False), cells, strict_parity=False)


#: Fixed value: a number with one of the units that may follow it in a cell.
VALUE_UNIT = r"(?i)^(\d+(?:\.\d+)?)\s*(%|mm|cm|m/s|mmHg|l|mg|dl|g|IU|U/L|u/l|bpm)$"


def measurements_from_tables(table_rows: DataFrame) -> DataFrame:
    """``measurements`` of rows with a name and a value; "60 %" is split, an own unit column goes first."""
    value = strip(F.col("value"))
    split = value.rlike(VALUE_UNIT)
    return table_rows.where("name is not null and value is not null").select(
        "doc_id", "page", "name", F.when(split, F.regexp_extract(value, VALUE_UNIT, 1)).otherwise(value).alias("value"),
        F.coalesce("unit", F.when(split, F.regexp_extract(value, VALUE_UNIT, 2))).alias("unit"), "reference_range", F.col("title").alias("source_section"))
