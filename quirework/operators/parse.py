"""Lines of pages as headings, list items and text.

Lines are arrays inside a page's row until they are exploded, so classification, offsets and levels need no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


#: All heading patterns as one: lines that are none are tested once.
_ANY_HEADING = r"\A(?:" + "|".join(f"(?:{p})" for p in T.HEADING_PATTERNS) + ")"


def pattern_index(line: Column, patterns: list[str] | None = None) -> Column:
    """Position of the first heading pattern that matches, else null."""
    out = F.lit(None).cast("int")
    for i, pattern in reversed(list(enumerate(patterns or T.HEADING_PATTERNS))):
        out = F.when(line.rlike(pattern), F.lit(i)).otherwise(out)
    return out


def heading_level(line: Column, patterns: list[str] | None = None) -> Column:
    """Level by the line's beginning, or by the pattern's position; null if it is no heading."""
    at = pattern_index(line, patterns)
    by_start = (
        F.when(line.rlike(r"(?i)\A(chapter|part)"), 1)
        .when(line.rlike(r"(?i)\Asection"), 2)
        .when(line.rlike(r"\A\d+\.\d+"), 3)
        .when(line.rlike(r"(?i)\A(abstract|introduction|conclusion|references|appendix)"), 1)
        .otherwise(F.least(at + 1, F.lit(4)))
    )
    level = F.when(at.isNotNull() if patterns else line.rlike(_ANY_HEADING), by_start)
    if patterns:
        level = level.when(line.rlike(T.CAPS_HEADING) & (F.size(F.split(line, " ")) <= 8), 2)
    return level


#: Lines whose offsets are summed in one go: sums grow by copying, which this bounds.
_BLOCK = 256


def _offsets(raw: Column) -> Column:
    """Character offset of each line: sums within blocks of lines, after the sums of the blocks. Most pages are one block, for which none are cut."""
    after = lambda a, x: F.array_append(a, F.element_at(a, -1) + F.length(x) + 1)
    few = F.aggregate(F.slice(raw, F.lit(1), F.size(raw) - 1), F.array(F.lit(0)), after)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(raw) - 1) / _BLOCK).cast("int")), lambda k: F.slice(raw, k * _BLOCK + 1, _BLOCK))
    sizes = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + F.length(x) + 1))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    many = F.flatten(F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), lambda p, at: F.aggregate(F.slice(p, F.lit(1), F.size(p) - 1), F.array(at), after)))
    return F.when(F.size(raw) <= _BLOCK, few).otherwise(many)


def lines(pages: DataFrame, offsets: bool = True) -> DataFrame:
    """doc_id, page_no, line_no (from 0), pos (character offset in the page; null without ``offsets``), line, text (trimmed). Blank lines are there."""
    split = pages.select("doc_id", "page_no", F.split(F.coalesce("text", F.lit("")), "\n").alias("raw"))
    # Trimmed before lines become rows: filters on the text would trim again each time they name it.
    line = lambda x, pos: F.struct(pos.alias("pos"), x.alias("line"), T.trim(x).alias("text"))
    if offsets:
        rows = F.zip_with("raw", _offsets(F.col("raw")), line)
    else:
        rows = F.transform("raw", lambda x: line(x, F.lit(None).cast("int")))
    return split.select("doc_id", "page_no", F.posexplode(rows).alias("line_no", "z")).select("doc_id", "page_no", "line_no", "z.pos", "z.line", "z.text")


def _texts(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, text of ``lines``: an array of plain strings, as a structure for each line costs more than its patterns."""
    split = pages.select("doc_id", "page_no", F.split(F.coalesce("text", F.lit("")), "\n").alias("raw"))
    return split.select("doc_id", "page_no", F.posexplode(F.transform("raw", T.trim)).alias("line_no", "text"))


def _kind(text: Column, level: Column, lists: bool) -> Column:
    kind = F.when(level.isNotNull(), "heading")
    return (kind.when(text.rlike(T.LIST_PATTERN), "list") if lists else kind).otherwise("text")


def _level(text: Column, headings: bool, patterns: Sequence[str] | None) -> Column:
    return heading_level(text, list(patterns or []) or None) if headings else F.lit(None).cast("int")


def elements(pages: DataFrame, headings: bool = True, lists: bool = True, patterns: Sequence[str] | None = None, offsets: bool = True) -> DataFrame:
    """doc_id, page_no, line_no, pos (null without ``offsets``, for readers that go by lines), type (heading, list, text), text, level (of headings). Blank lines give none."""
    every = lines(pages).drop("line") if offsets else _texts(pages).withColumn("pos", F.lit(None).cast("int"))
    found = every.filter("text <> ''").withColumn("level", _level(F.col("text"), headings, patterns))
    return found.select("doc_id", "page_no", "line_no", "pos", _kind(F.col("text"), F.col("level"), lists).alias("type"), "text", "level")


def element_array(text: Column, headings: bool = True, lists: bool = True, patterns: Sequence[str] | None = None) -> Column:
    """The elements of one page's text as an array of (text, level, type), without their places."""
    found = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), T.trim), lambda x: x != "")
    found = F.transform(found, lambda x: F.struct(x.alias("text"), _level(x, headings, patterns).alias("level")))
    return F.transform(found, lambda e: F.struct(e["text"].alias("text"), e["level"].alias("level"), _kind(e["text"], e["level"], lists).alias("type")))


def headings(elements: DataFrame, levels: tuple[int, ...] | None = None) -> DataFrame:
    """doc_id, page_no, line_no, pos, text, level of headings, at ``levels`` or all."""
    kept = F.col("type") == "heading"
    # Few lines have a level, so it is looked at first.
    found = elements.filter(kept if levels is None else F.col("level").isin(*levels) & kept)
    return found.select("doc_id", "page_no", "line_no", "pos", "text", "level")
