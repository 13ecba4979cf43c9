"""Page groups of documents: fixed, by headings, by the table of contents, and the first of these that applies.

Every grouper returns doc_id, group_ord (from 0), group_id, type, title, start_page, end_page, page_count, level. All windows
and joins are on doc_id, so they share one exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import config
from ..functions.config import Grouping
from . import parse

COLUMNS = ["doc_id", "group_ord", "group_id", "type", "title", "start_page", "end_page", "page_count", "level"]


def group_id(kind: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), kind, F.col("group_ord").cast("string")), 256)


def _finish(df: DataFrame, kind: str, *more: str) -> DataFrame:
    df = df.withColumn("type", F.lit(kind)).withColumn("group_id", group_id(F.lit(kind)))
    return df.select("doc_id", F.col("group_ord").cast("int").alias("group_ord"), "group_id", "type", "title", F.col("start_page").cast("int").alias("start_page"), F.col("end_page").cast("int").alias("end_page"), F.col("page_count").cast("int").alias("page_count"), F.col("level").cast("int").alias("level"), *more)


def finish_fixed(spans: DataFrame, *more: str) -> DataFrame:
    """Fixed groups from doc_id, group_ord, start_page, end_page, and columns ``more``, which stay."""
    return _finish(spans.select("*", F.concat(F.lit("Pages "), "start_page", F.lit("-"), "end_page").alias("title"), (F.col("end_page") - F.col("start_page") + 1).alias("page_count"), F.lit(None).alias("level")), "fixed", *more)


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.max("page_no").alias("n"))


def fixed_groups(pages: DataFrame, pages_per_group: int = 10) -> DataFrame:
    """Runs of ``pages_per_group`` pages. Made from each document's page count alone."""
    size = F.lit(pages_per_group)
    starts = page_counts(pages).select("doc_id", "n", F.explode(F.sequence(F.lit(1), F.col("n"), size)).alias("start_page"))
    out = starts.withColumn("end_page", F.least(F.col("start_page") + size - 1, F.col("n"))).withColumn("group_ord", F.floor((F.col("start_page") - 1) / size))
    return finish_fixed(out)


def _bounded_groups(pages: DataFrame, elements: DataFrame, toc: DataFrame | None, grouping: Grouping) -> DataFrame:
    """Groups from a document's table of contents if it has one, else from its headings, else fixed.

    Starts of groups from either source meet the page counts in one join by document; documents without any get their fixed groups from
    the same row, so pages and elements are read once.
    """
    order = Window.partitionBy("doc_id").orderBy("place", "line_no")
    starts = parse.headings(elements, grouping.heading_levels).select("doc_id", F.lit("heading").alias("type"), F.col("page_no").cast("long").alias("place"), "line_no", F.col("page_no").alias("start_page"), F.col("text").alias("title"), "level")
    if toc is not None:
        starts = starts.union(toc.select("doc_id", F.lit("toc"), F.col("toc_ord").cast("long"), F.lit(0), "page_no", "title", "level"))
    own = page_counts(pages).join(starts, "doc_id", "left")
    if toc is not None:
        # "toc" comes after "heading".
        own = own.withColumn("best", F.max("type").over(Window.partitionBy("doc_id"))).filter("best IS NULL OR type = best")
    after = F.lead("start_page").over(order)
    size = F.col("end_page") - F.col("start_page") + 1
    spans = own.select("*", F.coalesce(after - 1, F.col("n")).alias("end_page"), after.isNull().alias("last"))
    by_heading = F.coalesce(F.col("type") == "heading", F.lit(False))
    spans = spans.filter(~by_heading | F.col("last") | (size >= grouping.min_size)).withColumn("page_count", F.greatest(size, F.lit(0)))
    # Only the last group can be too small; the one before takes it in if both fit.
    joins = by_heading & F.col("last") & (F.col("page_count") < grouping.min_size) & (F.lag("page_count").over(order) + F.col("page_count") <= grouping.max_size)
    spans = spans.withColumn("absorbed", F.coalesce(joins, F.lit(False)))
    follow = lambda c: F.lead(c).over(order)
    spans = spans.select("*", F.coalesce(follow("absorbed"), F.lit(False)).alias("takes"), follow("title").alias("next_title"), follow("end_page").alias("next_end"), follow("page_count").alias("next_count"), (F.row_number().over(order) - 1).alias("k"))
    spans = spans.filter(~F.col("absorbed"))
    takes = F.col("takes")
    bounded = F.struct(
        F.col("type"),
        F.col("k").alias("group_ord"),
        F.when(takes, F.concat("title", F.lit(" / "), "next_title")).otherwise(F.col("title")).alias("title"),
        F.col("start_page"),
        F.when(takes, F.col("next_end")).otherwise(F.col("end_page")).alias("end_page"),
        (F.col("page_count") + F.when(takes, F.col("next_count")).otherwise(0)).alias("page_count"),
        F.col("level"),
    )
    each = grouping.pages_per_group

    def fixed(start: Column, k: Column) -> Column:
        end = F.least(start + each - 1, F.col("n"))
        title = F.concat(F.lit("Pages "), start.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(F.lit("fixed").alias("type"), k.alias("group_ord"), title.alias("title"), start.alias("start_page"), end.alias("end_page"), (end - start + 1).alias("page_count"), F.lit(None).cast("int").alias("level"))

    groups = spans.select("doc_id", F.explode(F.when(F.col("type").isNull(), F.transform(F.sequence(F.lit(1), F.col("n"), F.lit(each)), fixed)).otherwise(F.array(bounded))).alias("g"))
    out = groups.select("doc_id", "g.*")
    ints = ("group_ord", "start_page", "end_page", "page_count", "level")
    return out.withColumns({c: F.col(c).cast("int") for c in ints}).withColumn("group_id", group_id(F.col("type"))).select(COLUMNS)


def heading_groups(pages: DataFrame, elements: DataFrame, grouping: Grouping = Grouping()) -> DataFrame:
    """A group from each heading to the next. Documents without one at these levels get fixed groups; pages before the first are in none."""
    return _bounded_groups(pages, elements, None, grouping)


def toc_groups(pages: DataFrame, elements: DataFrame, toc: DataFrame, grouping: Grouping = Grouping()) -> DataFrame:
    """A group from each entry of the table of contents to the next, empty ones too; documents without one by headings."""
    return _bounded_groups(pages, elements, toc, grouping)


def hybrid_groups(pages: DataFrame, elements: DataFrame, toc: DataFrame, grouping: Grouping = Grouping()) -> DataFrame:
    """Table of contents if there is one, else headings of any level, else fixed. Same rows as ``toc_groups``, which falls back alike."""
    return toc_groups(pages, elements, toc, grouping)


def clamp_groups(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """Groups that a model named (doc_id, group_ord, id, type, title, start_page, end_page), kept within the document.

    A group keeps the id that the model gave, or has one made as other groups' ids are.
    """
    inside = groups.join(page_counts(pages), "doc_id").withColumn("start_page", F.greatest("start_page", F.lit(1))).withColumn("end_page", F.least("end_page", "n"))
    inside = inside.withColumns({"page_count": F.greatest(F.col("end_page") - F.col("start_page") + 1, F.lit(0)), "level": F.lit(None), "group_id": F.coalesce(F.nullif("id", F.lit("")), group_id(F.col("type")))})
    ints = ("group_ord", "start_page", "end_page", "page_count", "level")
    return inside.withColumns({c: F.col(c).cast("int") for c in ints}).select(COLUMNS)


#: Groups from pages, elements, table of contents and settings.
Grouper = Callable[[DataFrame, DataFrame, DataFrame, Grouping], DataFrame]

_HANDLERS: dict[str, Grouper] = {
    "heading": lambda pages, elements, toc, g: heading_groups(pages, elements, g),
    "toc": toc_groups,
    "hybrid": hybrid_groups,
    "fixed": lambda pages, elements, toc, g: fixed_groups(pages, g.pages_per_group),
}


def register(strategy: str, handler: Grouper) -> None:
    """Adds a strategy of one's own, or replaces one; settings may name it from then on."""
    _HANDLERS[strategy] = handler
    if strategy not in config.STRATEGIES:
        config.STRATEGIES.append(strategy)


def grouper(strategy: str) -> Grouper:
    """Handler of a strategy; an unknown one is fixed. Where a model groups, ``model.group_documents`` is the handler of all but fixed."""
    return _HANDLERS.get(strategy, _HANDLERS["fixed"])


def group_pages(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of each group: groups become a row a page, which meet the pages by document and number, so no page is compared with a group that isn't its own."""
    own = groups.filter("end_page >= start_page").select("doc_id", "group_ord", "group_id", F.explode(F.sequence("start_page", "end_page")).alias("page_no"))
    return own.join(pages.hint("merge"), ["doc_id", "page_no"])


def has_headings(elements: DataFrame) -> DataFrame:
    return elements.groupBy("doc_id").agg(F.bool_or(F.col("type") == "heading").alias("has_headings"))


def sample_pages(n: Column) -> Column:
    """Page numbers that stand for a document of ``n`` pages."""
    some = F.array(F.lit(1), F.lit(2), F.floor(n / 2).cast("int"), F.when(n > 10, F.floor(n * 0.75).cast("int")), n - 1, n)
    few = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.when(n <= 5, few).otherwise(F.array_sort(F.array_distinct(F.filter(some, lambda x: x.isNotNull()))))


def sample_content(pages: DataFrame, limit: int = 1000) -> DataFrame:
    """doc_id, content: the beginnings of the sampled pages."""
    counts = page_counts(pages).select("doc_id", F.explode(sample_pages(F.col("n"))).alias("page_no"))
    from ..functions.text import preview

    parts = pages.join(counts, ["doc_id", "page_no"]).select("doc_id", "page_no", F.concat(F.lit("--- Page "), "page_no", F.lit(" ---\n"), preview(F.col("text"), limit)).alias("part"))
    ordered = F.sort_array(F.collect_list(F.struct("page_no", "part")))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("content"))


def format_toc(toc: DataFrame) -> DataFrame:
    """doc_id, listing: the table of contents as an indented list (levels from 1)."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), "title", F.lit(" (page "), "page_no", F.lit(")"))
    ordered = F.sort_array(F.collect_list(F.struct("toc_ord", line.alias("line"))))
    return toc.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("listing"))
