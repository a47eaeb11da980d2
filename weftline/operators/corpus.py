"""From page texts to sections, mapping pairs and quality reports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECTION_SCHEMA = "section string, title string, start int, stop int, body_start int"
_NUMBER = "[0-9]{1,3}[A-Z]{0,2}"
_LONG_DASH = "[—–―]"
#: A character of a title: no blank line and no next section begins there.
_IN_TITLE = rf"(?:(?!\n[ \t]*\n|\n\s*\[?{_NUMBER}\s?[.]\s)[\s\S])"
_LEAD = rf"^\s*\[?(?P<n>{_NUMBER})\s?[.]\s*"
_START = re.compile(rf"{_LEAD}{_LONG_DASH}{{0,2}}\s*(?P<title>{_IN_TITLE}{{3,300}}?)(?:[.]\s*(?:-|{_LONG_DASH}){{1,2}}|\s*{_LONG_DASH}{{1,2}})", re.M)
_GONE = re.compile(rf"{_LEAD}\[(?P<title>(?:(?!\]).){{3,200}}?)[.]?\](?=\s*(?:Omitted|Rep))", re.M)
_INNER = re.compile(rf"^\s*{_NUMBER}[.]\s", re.M)


def kept_spans(spans: str = "spans", height: str = "page_height", small: float = 7.5, note: float = 9.5, from_share: float = 0.78) -> Column:
    """Text spans of a page (size, y0, text) without superscripts and without small print at its bottom."""
    return F.filter(F.col(spans), lambda s: (s["size"] > small) & ~((s["size"] <= note) & (s["y0"] >= F.col(height) * from_share)))


def page_lines(lines: Column) -> Column:
    """Lines without a first one that is just a page number."""
    first = F.coalesce(F.get(lines, F.lit(0)).rlike(r"^\s*[0-9]+\s*$"), F.lit(False))
    return F.array_join(F.when(first, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines), "\n")


def slice_body(text: str | Column, opening: str = r"(?i)be it enacted|hereby enacted", ending: str = r"(?m)^\s*\[?(?:(?:THE\s+)?(?:FIRST\s+)?SCHEDULE|APPENDIX)\b") -> Column:
    """From the opening formula to the first ending; the whole text where neither occurs."""
    c = F.col(text) if isinstance(text, str) else text
    a = F.regexp_instr(c, F.lit(opening))
    body = F.when(a > 0, F.substring(c, a, F.length(c))).otherwise(c)
    z = F.regexp_instr(body, F.lit(ending))
    return F.when(z > 0, F.substring(body, F.lit(1), z - 1)).otherwise(body)


def split_text(text: str) -> Iterator[tuple[str, str, int, int, int]]:
    """(number, title, start, stop, body start) of sections, in order.

    Acceptance is sequential: a start inside an accepted heading, a title that holds
    another start, and a number seen before are passed over.
    """
    found = sorted([*_START.finditer(text), *_GONE.finditer(text)], key=lambda m: m.span())
    kept: list[re.Match] = []
    seen: set[str] = set()
    for m in found:
        if kept and m.start() < kept[-1].end() or _INNER.search(m["title"]) or m["n"] in seen:
            continue
        kept.append(m)
        seen.add(m["n"])
    stops = [*(m.start() for m in kept[1:]), len(text)][: len(kept)]
    for m, stop in zip(kept, stops, strict=True):
        yield m["n"], " ".join(m["title"].split()), m.start(), stop, m.end()


def split_sections(acts: DataFrame, key: str, text: str, heading: str = r"CHAPTER\s+[IVXLC]+[A-Z]?") -> DataFrame:
    """``key``, ord, section, title, text, chapter: one row per section.

    Spans come from an Arrow UDF, one act's text at a time; bodies are cut at the
    next heading, and the chapter is the last heading at or before the section.
    """
    line = re.compile(rf"^\s*({heading})\s*$", re.M)

    @F.pandas_udf("array<struct<section: string, title: string, text: string, chapter: string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for t in s:
                t = t or ""
                marks = []
                for m in line.finditer(t):
                    rest = re.sub(r"\A\n+", "", t[m.end() :])
                    name = rest.partition("\n")[0].strip()
                    named = name and name == name.upper() and not _START.match(rest)
                    marks.append((m.start(), f"{m[1].strip()} — {name.title()}" if named else m[1].strip()))
                rows = []
                for n, title, start, stop, body in split_text(t):
                    chapter = None
                    for at, label in marks:
                        if at <= start:
                            chapter = label
                    rows.append({"section": n, "title": title, "text": " ".join(line.split(t[body:stop])[0].split()), "chapter": chapter})
                out.append(rows)
            yield pd.Series(out)

    return acts.select(key, F.posexplode(run(F.col(text))).alias("ord", "s")).select(key, "ord", "s.*")


def last_before(points: DataFrame, marks: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``points`` with the value of the last mark at or before them: an as-of join by one sort."""
    every = points.withColumn("_m", F.lit(None).cast("string")).withColumn("_k", F.lit(1)).unionByName(
        marks.select(key, at, F.col(value).alias("_m"), F.lit(0).alias("_k")), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(at, "_k").rowsBetween(W.unboundedPreceding, 0)
    return every.withColumn(value, F.last("_m", ignorenulls=True).over(w)).where("_k = 1").drop("_m", "_k")


def column_lines(words: DataFrame, page: str = "page", width: str = "width", share: float = 0.48, band: float = 3.0) -> DataFrame:
    """page, y, col, text, ord: words (block, line, x0, y0, word_no, word) of a two-column page as lines in reading order."""
    w = words.withColumn("col", F.when(F.col("x0") < F.col(width) * share, 0).otherwise(1))
    g = w.groupBy(page, "block", "line", "col").agg(F.min("y0").alias("y"), F.array_sort(F.collect_list(F.struct("word_no", "x0", "word"))).alias("_w"))
    g = g.select(page, "y", "col", F.array_join(F.transform("_w", lambda x: x["word"]), " ").alias("text"))
    # rows of one height differ by fractions of a point
    return g.withColumn("ord", F.row_number().over(W.partitionBy(page).orderBy(F.bround(F.col("y") / band), "col", "y", "text")))


def table_block(pages: DataFrame, page: str, header: str, numbered: str, part: str | None = None) -> DataFrame:
    """Pages of the first block: from one with the header and numbered lines to before the next without them."""
    w = W.partitionBy(*([part] if part else [F.lit(1)])).orderBy(page)
    started = F.max(F.when(F.col(header) & F.col(numbered), 1).otherwise(0)).over(w)
    p = pages.withColumn("_on", started)
    ended = F.max(F.when((F.col("_on") == 1) & ~F.col(numbered), 1).otherwise(0)).over(w)
    return p.withColumn("_off", ended).where("_on = 1 and _off = 0").drop("_on", "_off")


def _cell_numbers(cell: Column) -> Column:
    """Section numbers that begin lines of a cell."""
    lines = F.split(F.coalesce(cell, F.lit("")), "\n")
    one = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"^[ \t]*([0-9]{1,3})[.](?=$|\s)", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"^[ \t]*([0-9]{1,3}[A-Z][A-Z]?)[.]?(?=$|\s)", 1), F.lit("")))
    return F.array_compact(F.transform(lines, one))


def mapping_pairs(cells: DataFrame, key: str, order: str, left: str = "left_cell", right: str = "right_cell") -> DataFrame:
    """``key``, ord, new_section, old_section: each old number with the last new one at or above it.

    A number or a subsection marker in the left cell sets the new section; chapter rows don't.
    """
    a, b = F.coalesce(F.col(left), F.lit("")), F.coalesce(F.col(right), F.lit(""))
    rows = cells.where(~F.contains(F.upper(a), F.lit("CHAPTER")) & ((F.trim(a) != "") | (F.trim(b) != "")))
    own = F.coalesce(F.get(_cell_numbers(a), F.lit(0)), F.nullif(F.regexp_extract(a, r"^\s*([0-9]{1,3})\s*\([0-9]+\)", 1), F.lit("")))
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    filled = rows.withColumn("new_section", F.last(own, ignorenulls=True).over(w)).where("new_section is not null")
    return filled.select(key, F.col(order).alias("ord"), "new_section", F.explode(_cell_numbers(b)).alias("old_section"))


def section_quality(sections: DataFrame, key: str, order: str, section: str = "section", text: str = "text", expected: str | None = None, short: int = 40) -> DataFrame:
    """``key``, extracted, monotonic, gaps, short, clean_fraction."""
    n = F.regexp_extract(section, r"^([0-9]+)", 1).cast("int")
    rows = sections.withColumn("_n", n)
    rows = rows.withColumn("_back", F.lag("_n").over(W.partitionBy(key).orderBy(order)) > F.col("_n"))
    out = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("extracted"), (F.coalesce(F.max(F.col("_back").cast("int")), F.lit(0)) == 0).alias("monotonic"),
        F.array_sort(F.array_except(F.sequence(F.min("_n"), F.max("_n")), F.collect_set("_n"))).alias("gaps"),
        F.array_sort(F.collect_set(F.when(F.length(text) < short, F.col(section)))).alias("short"), *([F.max(expected).alias("_e")] if expected else []),
    )
    problems = F.size("gaps") + F.size("short") + F.when(F.col("monotonic"), 0).otherwise(1)
    below = F.greatest(F.col("extracted"), F.coalesce(F.col("_e"), F.lit(0)) if expected else F.lit(0), F.lit(1))
    return out.withColumn("clean_fraction", F.round(F.greatest(F.lit(0.0), 1 - problems / below), 4)).drop("_e")


def page_text(html: str | Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags gone, five entities resolved, white space squeezed."""
    c = F.col(html) if isinstance(html, str) else html
    c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return F.btrim(F.regexp_replace(c, r"[ \t\n\r\f\x0b]+", " "), F.lit(" "))
