"""Entities, sections, tables and summaries of page groups.

A group's pages are gathered in one row, and everything is found there by array functions: one exchange for all parts, whatever a
group holds. The same functions serve single pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as T
from ..functions.config import Extraction, Parsing
from . import grouping, parse

#: Types of what is extracted from a group, by patterns or by a model.
ENTITIES = "array<struct<type:string,name:string,value:string,confidence:double>>"
SECTIONS = "array<struct<heading:string,content:string,level:int>>"
TABLES = "array<struct<headers:array<string>,rows:array<array<string>>,caption:string,page_no:int>>"

# Plain tests that a text with a match passes: most texts have none, and a test costs far less than a pattern with look-around.


def _any_of(text: Column, parts: Sequence[str]) -> Column:
    out = F.contains(text, F.lit(parts[0]))
    for part in parts[1:]:
        out = out | F.contains(text, F.lit(part))
    return out


def _possible(text: Column, kind: str, k: int) -> Column:
    if kind == "date":
        # A month's pattern fails at most letters; bringing the text to lower case would cost more.
        return F.lit(True) if k == 2 else _any_of(text, ("-", "/"))
    return _any_of(text, {"money": ("$", "USD", "EUR", "GBP"), "email": ("@",), "url": ("://",), "percentage": ("%",)}[kind])


def _names(text: Column, k: int, kind: str, pattern: str) -> Column:
    return F.when(_possible(text, kind, k), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))


def entity_array(text: Column, kinds: Sequence[str] | None = None) -> Column:
    """Entities of a text, of some kinds or all, in order of emission: array of (ord, type, name, value, confidence)."""

    def matches(k: int, kind: str, confidence: float, pattern: str) -> Column:
        def entity(name: Column, i: Column) -> Column:
            place = F.struct(F.lit(k).alias("pattern"), i.alias("match"))
            return F.struct(place.alias("ord"), F.lit(kind).alias("type"), name.alias("name"), F.lit(None).cast("string").alias("value"), F.lit(confidence).alias("confidence"))

        return F.transform(_names(text, k, kind, pattern), entity)

    return F.concat(*[matches(k, *p) for k, p in enumerate(T.ENTITY_PATTERNS) if kinds is None or p[0] in kinds])


def page_entities(pages: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """doc_id, page_no, ord, type, name, value, confidence: all matches, before any is dropped."""
    return pages.select("doc_id", "page_no", F.explode(entity_array(F.coalesce("text", F.lit("")), kinds)).alias("e")).select("doc_id", "page_no", "e.*")


def first_entities(entities: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The first of the entities with one type and name, letters' case counting.

    Order within a group: pattern, then page, then match.
    """
    keys = [*by, "type", "name"]
    order = F.struct(F.col("ord.pattern").alias("pattern"), F.col("page_no"), F.col("ord.match").alias("match"))
    return entities.groupBy(*keys).agg(F.min(F.struct(order.alias("ord"), "value", "confidence")).alias("m")).select(*keys, "m.*")


def group_entities(content: Column) -> Column:
    """As ``first_entities``, of the joined texts of a group's pages: array of (type, name, value, confidence).

    Across a page break no pattern matches, as none spans dashes and line breaks. Patterns of one type are neighbours and matches come in the order of
    pages, so a type's names are in their order already and their first ones are what is distinct.
    """
    found: dict[tuple[str, float], list[Column]] = {}
    for k, (kind, confidence, pattern) in enumerate(T.ENTITY_PATTERNS):
        found.setdefault((kind, confidence), []).append(_names(content, k, kind, pattern))

    def entities(kind: str, confidence: float, names: list[Column]) -> Column:
        return F.transform(F.array_distinct(F.concat(*names)), lambda x: F.struct(F.lit(kind).alias("type"), x.alias("name"), F.lit(None).cast("string").alias("value"), F.lit(confidence).alias("confidence")))

    return F.concat(*[entities(*key, names) for key, names in found.items()])


def sections(elements: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """by, section_no (from 1), heading, level, content: text after each heading, up to the next. List items and text before the first heading are dropped."""
    order = Window.partitionBy(*by).orderBy("page_no", "line_no")
    head = (F.col("type") == "heading") & F.col("level").isNotNull()
    numbered = elements.withColumn("section_no", F.sum(head.cast("int")).over(order)).filter("section_no > 0")
    body = F.sort_array(F.collect_list(F.when(F.col("type") == "text", F.struct("page_no", "line_no", "text"))))
    out = numbered.groupBy(*by, "section_no").agg(F.max(F.when(head, F.col("text"))).alias("heading"), F.max(F.when(head, F.col("level"))).alias("level"), body.alias("body"))
    return out.select(*by, F.col("section_no").cast("int").alias("section_no"), "heading", "level", T.trim(F.array_join(F.transform("body", lambda x: x["text"]), "\n")).alias("content"))


def group_sections(pages: Column, parsing: Parsing = Parsing()) -> Column:
    """As ``sections``, of an array of pages: array of (heading, content, level)."""
    every = element_array(joined(pages, "\n"), parsing)

    def section(part: Column) -> Column:
        head, body = F.get(part, F.lit(0)), F.filter(part, lambda e: e["type"] == "text")
        return F.struct(head["text"].alias("heading"), T.trim(F.array_join(F.transform(body, lambda e: e["text"]), "\n")).alias("content"), head["level"].alias("level"))

    of = lambda e: T.let(T.places(F.size(e), lambda i: F.get(e, i)["type"] == "heading"), lambda heads: T.runs(e, F.size(e), heads, section))
    return T.let(every, of)


def element_array(text: Column, parsing: Parsing) -> Column:
    return parse.element_array(text, parsing.headings, parsing.lists, parsing.patterns)


def table_row(line: Column) -> Column:
    """Cells of a trimmed line: by tabs, else bars, else runs of two and more spaces; empty cells go."""
    cells = lambda text, mark: F.filter(F.transform(F.split(text, mark), T.trim), lambda c: c != "")
    wide = rf"{T.SPACE}{{2,}}"
    # A line without a tab can be cut at tabs; a pattern would be compiled anew for each line.
    spaced = cells(F.regexp_replace(line, wide, "\t"), "\t")
    return F.when(F.contains(line, F.lit("\t")), cells(line, "\t")).when(F.contains(line, F.lit("|")), cells(line, r"\|")).when(line.rlike(wide), spaced).otherwise(F.array().cast("array<string>"))


def table_array(text: Column) -> Column:
    """Tables of one page's text: array of (headers, rows).

    A blank line or another number of cells begins a new run of rows; lines of fewer than two cells
    are passed over. A run of two rows and more is a table.
    """
    rows = F.transform(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), T.trim), lambda x: F.struct((x == "").alias("blank"), table_row(x).alias("cells")))

    def of_rows(r: Column) -> Column:
        width = lambda i: F.size(F.get(r, i)["cells"])

        def of_filled(k: Column) -> Column:
            apart = lambda a, b: (width(a) != width(b)) | F.exists(F.slice(r, a + 2, b - a - 1), lambda x: x["blank"])
            starts = T.places(F.size(k), lambda n: (n == 0) | apart(F.get(k, n - 1), F.get(k, n)))
            return T.let(starts, lambda s: T.runs(k, F.size(k), s, lambda part: F.transform(part, lambda i: F.get(r, i)["cells"])))

        return T.let(T.places(F.size(r), lambda i: width(i) >= 2), of_filled)

    found = F.filter(T.let(rows, of_rows), lambda t: F.size(t) >= 2)
    return F.transform(found, lambda t: F.struct(F.get(t, F.lit(0)).alias("headers"), F.slice(t, F.lit(2), F.size(t)).alias("rows")))


def page_tables(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, table_no (from 0), headers, rows: found in each page's row."""
    return pages.select("doc_id", "page_no", F.posexplode(table_array(F.col("text"))).alias("table_no", "t")).select("doc_id", "page_no", "table_no", "t.headers", "t.rows")


def group_tables(pages: Column) -> Column:
    found = lambda p: F.transform(table_array(p["text"]), lambda t: F.struct(t["headers"].alias("headers"), t["rows"].alias("rows"), F.lit(None).cast("string").alias("caption"), p["page_no"].cast("int").alias("page_no")))
    return F.flatten(F.transform(pages, found))


def summary(content: Column) -> Column:
    """The first three sentences of more than 20 characters, 500 characters at most."""
    flat = F.regexp_replace(content, r"\n+", " ")
    sentences = F.filter(F.transform(F.split(flat, r"[.!?]+"), T.trim), lambda s: F.length(s) > 20)

    def cut(found: Column) -> Column:
        first = F.array_join(F.slice(found, 1, 3), ". ")
        short = F.when(F.length(first) > 500, F.concat(F.substring(first, 1, 500), F.lit("..."))).otherwise(F.concat(first, F.lit(".")))
        return F.when(F.size(found) == 0, T.NO_CONTENT).otherwise(short)

    return T.let(sentences, cut)


def joined(pages: Column, separator: str = T.PAGE_BREAK, numbered: bool = False) -> Column:
    """The texts of an array of pages as one, each under its number if ``numbered``."""
    part = lambda p: F.concat(F.lit("--- Page "), p["page_no"], F.lit(" ---\n"), p["text"]) if numbered else p["text"]
    return F.array_join(F.transform(pages, part), separator)


def join_pages(pages: DataFrame, by: tuple[str, ...], separator: str = T.PAGE_BREAK, numbered: bool = False) -> DataFrame:
    """by, content: the texts of the pages of a group in order."""
    ordered = F.sort_array(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy(*by).agg(joined(ordered, separator, numbered).alias("content"))


def group_rows(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """Each group (all columns) with ``pages``: an ordered array of its pages (page_no, text), empty for an empty group.

    A group meets its pages by document and page number, so nothing is compared that doesn't belong together, and a
    document's pages spread over tasks if it has many.
    """
    own = groups.select(F.struct(*[F.col(f"`{c}`") for c in groups.columns]).alias("g"), "doc_id", "group_ord", F.explode_outer(F.when(F.col("end_page") >= F.col("start_page"), F.sequence("start_page", "end_page"))).alias("page_no"))
    # Never a broadcast: texts that a plan makes up are larger than the planner thinks, and the groups' side may be one task.
    met = own.join(pages.select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text")).hint("merge"), ["doc_id", "page_no"], "left")
    part = F.when(F.col("text").isNotNull(), F.struct("page_no", "text"))
    return met.groupBy("doc_id", "group_ord").agg(F.any_value("g").alias("g"), F.sort_array(F.collect_list(part)).alias("pages")).select("g.*", "pages")


def fixed_rows(pages: DataFrame, pages_per_group: int = 10) -> DataFrame:
    """As ``group_rows`` of ``grouping.fixed_groups``: a page's number alone says which group it is in, so pages meet nothing and are dealt out once, by document."""
    own = pages.filter("page_no >= 1").groupBy("doc_id", F.floor((F.col("page_no") - 1) / pages_per_group).cast("int").alias("group_ord"))
    held = own.agg(F.sort_array(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))).alias("pages"))
    order = Window.partitionBy("doc_id").orderBy("group_ord")
    last = F.lead("group_ord").over(order).isNull()
    # Groups before the last one that no page is in are there too.
    missing = F.sequence(F.coalesce(F.lag("group_ord").over(order), F.lit(-1)) + 1, "group_ord")
    held = held.select("doc_id", F.col("group_ord").alias("at"), "pages", F.when(last, F.element_at("pages", -1)["page_no"]).alias("n"), missing.alias("k"))
    every = held.select("doc_id", F.explode("k").alias("group_ord"), "at", "pages", "n")
    here = F.col("group_ord") == F.col("at")
    start, whole = F.col("group_ord") * pages_per_group + 1, (F.col("group_ord") + 1) * pages_per_group
    every = every.select("doc_id", "group_ord", start.alias("start_page"), F.when(here, F.coalesce("n", whole)).otherwise(whole).alias("end_page"), F.when(here, F.col("pages")).otherwise(F.slice("pages", F.lit(1), F.lit(0))).alias("pages"))
    return grouping.finish_fixed(every, "pages")


def stamp(now: str | None) -> Column:
    """``now``, or the time in UTC, as text."""
    return F.lit(now) if now else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def outcome(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds what every result has, however it came about: agent_id, extracted_by, llm_enhanced, success, error, duration_ms, tokens_used, extra (see ``fields``)."""
    kinds = {"agent_id": "string", "extracted_by": "string", "llm_enhanced": "boolean", "success": "boolean", "error": "string", "duration_ms": "long", "tokens_used": "long", "extra": "variant"}
    base = {"agent_id": F.concat(F.lit("agent-"), "group_id"), "success": F.lit(True), "duration_ms": F.lit(0), "tokens_used": F.lit(0)}
    return df.withColumns({name: columns.get(name, base.get(name, F.lit(None))).cast(kind) for name, kind in kinds.items()})


def extracted(rows: DataFrame, extraction: Extraction = Extraction(), parsing: Parsing = Parsing(), now: str | None = None) -> DataFrame:
    """Results of ``group_rows`` by patterns: all group columns, raw_content, summary, entities, sections, tables, extracted_at, and those of ``outcome``.

    Parts that are turned off are empty, a summary that is turned off is null.
    """
    none = lambda kind: F.array().cast(kind)
    own = rows.withColumn("raw_content", joined(F.col("pages")))
    own = own.withColumns(
        {
            "summary": summary(F.col("raw_content")) if extraction.summary else F.lit(None).cast("string"),
            "entities": (group_entities(F.col("raw_content")) if extraction.entities else none(ENTITIES)).cast(ENTITIES),
            "sections": (group_sections(F.col("pages"), parsing) if extraction.sections else none(SECTIONS)).cast(SECTIONS),
            "tables": (group_tables(F.col("pages")) if extraction.tables and parsing.tables else none(TABLES)).cast(TABLES),
            "extracted_at": stamp(now),
        }
    )
    return outcome(own.drop("pages"))


def fixed_results(pages: DataFrame, pages_per_group: int = 10, extraction: Extraction = Extraction(), parsing: Parsing = Parsing(), now: str | None = None) -> DataFrame:
    """As ``group_results`` of fixed groups."""
    return extracted(fixed_rows(pages, pages_per_group), extraction, parsing, now)


def group_results(groups: DataFrame, pages: DataFrame, extraction: Extraction = Extraction(), parsing: Parsing = Parsing(), now: str | None = None) -> DataFrame:
    """One result per group, by patterns; see ``extracted``."""
    return extracted(group_rows(groups, pages), extraction, parsing, now)
