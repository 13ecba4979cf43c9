"""Results of a document's groups merged into one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as T
from ..functions.config import Merging


#: Between the contents of groups (fixed value).
BREAK = "\n\n---\n\n"


def succeeded(results: DataFrame) -> DataFrame:
    return results.filter(F.coalesce(F.col("success"), F.lit(False)))


def group_status(results: DataFrame) -> DataFrame:
    return results.select("*", F.when(F.col("success"), "success").otherwise("failed").alias("status"))


def best_entities(entities: DataFrame, fold_case: bool = True, ranked: bool = True) -> DataFrame:
    """Of a document's entities with one type and name the surest, the first of equals: doc_id, rank, type, name, value, confidence.

    ``entities`` has a sortable ``ord``. Names are one in any case of letters unless ``fold_case`` is off. ``rank`` (from 1) goes by confidence,
    then by where the type and name came first; without ``ranked`` only by the latter. Aggregates, so a frequent name is combined before it is shuffled.
    """
    name = F.lower("name") if fold_case else F.col("name")
    # First the earliest of each confidence, then the surest of these.
    first = entities.groupBy("doc_id", "type", name.alias("key"), "confidence").agg(F.min("ord").alias("ord"), F.min_by(F.struct("name", "value"), "ord").alias("t"))
    least = first.groupBy("doc_id", "type", "key").agg(F.max("confidence").alias("confidence"), F.min("ord").alias("first"), F.max_by("t", "confidence").alias("t"))
    order = Window.partitionBy("doc_id").orderBy(*([F.desc("confidence")] if ranked else []), "first")
    return least.select("doc_id", F.row_number().over(order).alias("rank"), "type", "t.name", "t.value", "confidence")


def merged_sections(sections: DataFrame) -> DataFrame:
    """doc_id, rank, heading, level, content: sections with one heading (in any case) as one, contents folded in order.

    ``sections``: doc_id, ord, heading, level, content. The first one's heading and level stay. Ordered by level, then heading.
    """
    ordered = F.sort_array(F.collect_list(F.struct("ord", "heading", "level", "content")))
    folded = F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.element_at("s", 1)["content"], lambda a, x: T.merge_content(a, x["content"]))
    out = sections.groupBy("doc_id", F.lower("heading").alias("key")).agg(ordered.alias("s"))
    out = out.select("doc_id", F.element_at("s", 1).alias("f"), folded.alias("content"))
    order = Window.partitionBy("doc_id").orderBy("level", F.collate("heading", "UNICODE"), "ord")
    return out.select("doc_id", "f.ord", "f.heading", "f.level", "content").withColumn("rank", F.row_number().over(order)).drop("ord")


def _joined(column: str, separator: str) -> Column:
    listed = F.sort_array(F.collect_list(F.when(F.coalesce(F.col(column), F.lit("")) != "", F.struct("group_ord", F.col(column).alias("x")))))
    return F.array_join(F.transform(listed, lambda v: v["x"]), separator)


def combined_summary(results: DataFrame, limit: int = 1000) -> DataFrame:
    """doc_id, summary of the groups in order, cut to ``limit``."""
    own = succeeded(results).groupBy("doc_id").agg(_joined("summary", " ").alias("s"))
    return own.select("doc_id", F.when(F.col("s") == "", T.NO_SUMMARY).otherwise(T.truncate_sentence(F.col("s"), limit)).alias("summary"))


def first_title(results: DataFrame) -> DataFrame:
    return succeeded(results).groupBy("doc_id").agg(F.min_by("title", F.when(F.coalesce("title", F.lit("")) != "", F.col("group_ord"))).alias("title"))


def full_content(results: DataFrame) -> DataFrame:
    return succeeded(results).groupBy("doc_id").agg(_joined("raw_content", BREAK).alias("full_content"))


def merge_metadata(results: DataFrame) -> DataFrame:
    """doc_id, total_groups, successful_groups (both over what succeeded), groups (ids), of_groups: metadata of each group."""
    listed = F.sort_array(F.collect_list(F.struct("group_ord", "group_id", group_metadata().alias("m"))))
    out = succeeded(results).groupBy("doc_id").agg(F.count("*").alias("total_groups"), F.count_if("success").alias("successful_groups"), listed.alias("l"))
    return out.select("doc_id", "total_groups", "successful_groups", F.transform("l", lambda x: x["group_id"]).alias("groups"), F.transform("l", lambda x: x["m"]).alias("of_groups"))


def group_metadata() -> Column:
    """What a result says of its group, under the names that outputs have."""
    return F.struct(F.col("group_id").alias("groupId"), F.col("start_page").alias("startPage"), F.col("end_page").alias("endPage"), F.col("page_count").alias("pageCount"), F.col("extracted_at").alias("extractedAt"), F.col("extracted_by").alias("extractedBy"), F.col("llm_enhanced").alias("llmEnhanced"))


def best_array(entities: Column, merging: Merging = Merging(), fold_case: bool = True) -> Column:
    """As ``best_entities``, of an array of (ord, type, name, value, confidence): array of (rank, type, name, value, confidence).

    A sort brings the entities with one type and name together, the surest first; no pair is compared. The earliest of them is another one only where
    they aren't equally sure, and only then is sorted for too. An entity without a confidence is the least sure.
    """
    key = lambda e: F.lower(e["name"]) if fold_case else e["name"]
    rest = lambda e: [e["type"].alias("type"), e["name"].alias("name"), e["value"].alias("value"), e["confidence"].alias("confidence")]
    doubt = lambda e: F.coalesce(-e["confidence"], F.lit(float("inf")))
    same = lambda a, b: a["key"].eqNullSafe(b["key"]) & a["type"].eqNullSafe(b["type"])
    if merging.deduplicate:
        by_doubt = F.sort_array(F.transform(entities, lambda e: F.struct(key(e).alias("key"), e["type"].alias("type"), doubt(e).alias("d"), e["ord"].alias("ord"), F.struct(*rest(e)).alias("e"))))
        keep = lambda x, order: F.struct((x["d"] if merging.sort_entities else F.lit(0.0)).alias("d"), order.alias("ord"), x["e"].alias("e"))

        def best(sure: Column) -> Column:
            early = F.sort_array(F.transform(sure, lambda x: F.struct(x["key"].alias("key"), x["type"].alias("type"), x["ord"].alias("ord"))))
            uneven = F.exists(T.places(F.size(sure), lambda i: i > 0), lambda i: (F.get(sure, i)["d"] != F.get(sure, i - 1)["d"]) & same(F.get(sure, i), F.get(sure, i - 1)))
            apart = F.zip_with(T.first_of_each(sure, same), T.first_of_each(early, same), lambda a, b: keep(a, b["ord"]))
            return F.when(uneven, apart).otherwise(F.transform(T.first_of_each(sure, same), lambda x: keep(x, x["ord"])))

        kept = T.let(by_doubt, best)
    else:
        kept = F.transform(entities, lambda e: F.struct((doubt(e) if merging.sort_entities else F.lit(0.0)).alias("d"), e["ord"].alias("ord"), F.struct(*rest(e)).alias("e")))
    return F.transform(F.sort_array(kept), lambda x, i: F.struct((i + 1).alias("rank"), *rest(x["e"])))


def section_array(sections: Column, merging: Merging = Merging()) -> Column:
    """As ``merged_sections``, of an array of (ord, heading, level, content): array of (rank, heading, level, content)."""
    own = lambda s: F.struct(s["level"].alias("level"), F.collate(s["heading"], "UNICODE").alias("h"), s["ord"].alias("ord"), s["heading"].alias("heading"), s["content"].alias("content"))
    if merging.merge_sections:
        keyed = F.sort_array(F.transform(sections, lambda s: F.struct(F.lower(s["heading"]).alias("key"), s["ord"].alias("ord"), s["heading"].alias("heading"), s["level"].alias("level"), s["content"].alias("content"))))

        def fold(part: Column) -> Column:
            first = F.get(part, F.lit(0))
            content = F.aggregate(F.slice(part, F.lit(2), F.size(part)), first["content"], lambda a, x: T.merge_content(a, x["content"]))
            return F.struct(first["level"].alias("level"), F.collate(first["heading"], "UNICODE").alias("h"), first["ord"].alias("ord"), first["heading"].alias("heading"), content.alias("content"))

        starts = lambda s: T.places(F.size(s), lambda i: (i == 0) | ~F.get(s, i)["key"].eqNullSafe(F.get(s, i - 1)["key"]))
        sections = T.let(keyed, lambda s: T.let(starts(s), lambda at: T.runs(s, F.size(s), at, fold)))
    else:
        sections = F.transform(sections, own)
    return F.transform(F.sort_array(sections), lambda s, i: F.struct((i + 1).alias("rank"), s["heading"].alias("heading"), s["level"].alias("level"), s["content"].alias("content")))


def merged(results: DataFrame, merging: Merging = Merging(), now: str | None = None) -> DataFrame:
    """One row per document: title, summary, sections, entities, tables, full_content, total_groups, successful_groups, of_groups, extracted_at.

    ``results`` as of ``extract.group_results``. Only results that succeeded count. A document's results are gathered once and merged in its row.
    """
    from .extract import stamp

    # A list for each part, so that a reader of some parts leaves the others out of the plan.
    each = lambda name, c: F.sort_array(F.collect_list(F.struct("group_ord", c.alias("x")))).alias(name)
    parts = {c: F.col(c) for c in ("title", "summary", "raw_content", "entities", "sections", "tables")} | {"m": group_metadata()}
    own = succeeded(results).groupBy("doc_id").agg(*[each(*p) for p in parts.items()], F.count("*").alias("total_groups"), F.count_if("success").alias("successful_groups"))
    filled = lambda c: F.filter(F.transform(c, lambda r: r["x"]), lambda x: F.coalesce(x, F.lit("")) != "")
    flat = lambda c, f: F.flatten(F.transform(c, lambda r: F.coalesce(F.transform(r["x"], lambda e, i: f(r, e, i)), F.array())))
    place = lambda r, i: F.struct(r["group_ord"].alias("group_ord"), i.alias("i")).alias("ord")
    # One number is made and compared faster than two.
    number = lambda r, i: (r["group_ord"].cast("long") * (1 << 32) + i).alias("ord")
    entities = flat("entities", lambda r, e, i: F.struct(number(r, i), e["type"].alias("type"), e["name"].alias("name"), e["value"].alias("value"), e["confidence"].alias("confidence")))
    sections = flat("sections", lambda r, e, i: F.struct(place(r, i), e["heading"].alias("heading"), e["level"].alias("level"), e["content"].alias("content")))
    tables = flat("tables", lambda r, e, i: F.struct(r["group_ord"].alias("group_ord"), i.alias("i"), e["headers"].alias("headers"), e["rows"].alias("rows"), e["caption"].alias("caption"), e["page_no"].alias("page_no")))
    text = F.array_join(filled("summary"), " ")
    return own.select(
        "doc_id",
        F.get(filled("title"), F.lit(0)).alias("title"),
        T.let(text, lambda s: F.when(s == "", T.NO_SUMMARY).otherwise(T.truncate_sentence(s, merging.summary_limit))).alias("summary"),
        section_array(sections, merging).alias("sections"),
        T.let(entities, lambda e: best_array(e, merging)).alias("entities"),
        tables.alias("tables"),
        F.array_join(filled("raw_content"), BREAK).alias("full_content"),
        "total_groups",
        "successful_groups",
        F.transform("m", lambda r: r["x"]).alias("of_groups"),
        stamp(now).alias("extracted_at"),
    )


@dataclass
class Parts:
    """Merged documents as tables, none of which has a whole document in a row.

    ``documents``: doc_id, title, summary, total_groups, successful_groups, extracted_at; ``sections``: doc_id, rank, heading, level, content; ``entities``: doc_id, rank, type, name, value, confidence;
    ``tables``: doc_id, group_ord, i, headers, rows, caption, page_no; ``contents``: doc_id, piece, content, pieces to be joined by a break; ``groups``: doc_id, group_ord, m.
    """

    documents: DataFrame
    sections: DataFrame
    entities: DataFrame
    tables: DataFrame
    contents: DataFrame
    groups: DataFrame
    #: All of a document but its sections and entities in a row, which only ``whole`` reads: one pass over the results instead of four.
    gathered: DataFrame

    def whole(self) -> DataFrame:
        """One row per document, as ``merged``."""

        def listed(df: DataFrame, order: list[str], name: str, fields: list[str]) -> DataFrame:
            rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("e"))), lambda a, b: _compared(a, b, order))
            return df.groupBy("doc_id").agg(F.transform(rows, lambda x: x["e"]).alias(name))

        sections = listed(self.sections, ["rank"], "sections", ["rank", "heading", "level", "content"])
        entities = listed(self.entities, ["rank"], "entities", ["rank", "type", "name", "value", "confidence"])
        out = self.gathered.join(sections, "doc_id", "left").join(entities, "doc_id", "left")
        kinds = {own.columns[1]: own.schema[own.columns[1]].dataType for own in (sections, entities)}
        out = out.withColumns({name: F.coalesce(F.col(name), F.array().cast(kind)) for name, kind in kinds.items()})
        return out.select("doc_id", "title", "summary", "sections", "entities", "tables", "full_content", "total_groups", "successful_groups", "of_groups", "extracted_at")


def _compared(a: Column, b: Column, order: list[str]) -> Column:
    """-1, 0 or 1 by whole numbers in ``order``."""
    out = F.lit(0)
    for name in reversed(order):
        out = F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(out)
    return out


def in_parts(results: DataFrame, merging: Merging = Merging(), now: str | None = None, segment: int = 1000) -> Parts:
    """As ``merged``, for documents of any number of groups.

    What can be combined early is: an entity's best by its key, a summary's beginning by segments of ``segment`` groups. A heading's contents are folded by heading, as that goes by their order; texts are
    joined by segment. So no task holds more of a document than a segment, one heading's contents, or the beginnings of its segments' summaries.
    """
    from .extract import stamp

    own = succeeded(results)
    piece = F.floor(F.col("group_ord") / segment).alias("piece")
    # Outer, and the empty ones' rows dropped: of a plain one Spark asks below whether the array is empty, and so makes it a second time.
    each = lambda c: own.select("doc_id", "group_ord", F.posexplode_outer(c).alias("i", "e")).filter("i IS NOT NULL")
    place = F.struct("group_ord", "i").alias("ord")

    kept = lambda name, c: F.sort_array(F.collect_list(F.struct("group_ord", c.alias("x")))).alias(name)
    pieces = own.groupBy("doc_id", piece).agg(
        F.count("*").alias("total"), F.count_if("success").alias("ok"), F.min_by("title", F.when(F.coalesce("title", F.lit("")) != "", F.col("group_ord"))).alias("title"),
        F.substring(_joined("summary", " "), 1, merging.summary_limit + 1).alias("summary"), _joined("raw_content", BREAK).alias("content"), kept("tables", F.col("tables")), kept("groups", group_metadata()),
    )
    filled = lambda name, by: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(name) != "", F.struct("piece", name)))), lambda x: x[name]), by)
    flat = lambda name: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", name))), lambda x: x[name]))
    per = pieces.groupBy("doc_id").agg(
        F.sum("total").alias("total_groups"), F.sum("ok").alias("successful_groups"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("piece"))).alias("title"), filled("summary", " ").alias("s"),
        filled("content", BREAK).alias("full_content"), flat("tables").alias("t"), flat("groups").alias("g"),
    )
    table = lambda r, e, i: F.struct(r["group_ord"].alias("group_ord"), i.alias("i"), e["headers"].alias("headers"), e["rows"].alias("rows"), e["caption"].alias("caption"), e["page_no"].alias("page_no"))
    tables = F.flatten(F.transform("t", lambda r: F.coalesce(F.transform(r["x"], lambda e, i: table(r, e, i)), F.array())))
    # A summary over the limit is longer by one letter or more, which is all that counts of the rest.
    text = F.when(F.col("s") == "", T.NO_SUMMARY).otherwise(T.truncate_sentence(F.substring("s", 1, merging.summary_limit + 1), merging.summary_limit))
    gathered = per.select("doc_id", "title", text.alias("summary"), tables.alias("tables"), "full_content", "total_groups", "successful_groups", F.transform("g", lambda r: r["x"]).alias("of_groups"), stamp(now).alias("extracted_at"))
    documents = gathered.select("doc_id", "title", "summary", "total_groups", "successful_groups", "extracted_at")

    found = each("entities").select("doc_id", place, "e.type", F.lower("e.name").alias("key"), F.coalesce(-F.col("e.confidence"), F.lit(float("inf"))).alias("d"), F.struct("e.type", "e.name", "e.value", "e.confidence").alias("t"))
    if merging.deduplicate:
        first = found.groupBy("doc_id", "type", "key", "d").agg(F.min("ord").alias("ord"), F.min_by("t", "ord").alias("t"))
        found = first.groupBy("doc_id", "type", "key").agg(F.min("d").alias("d"), F.min("ord").alias("ord"), F.min_by("t", "d").alias("t"))
    order = Window.partitionBy("doc_id").orderBy(*(["d"] if merging.sort_entities else []), "ord")
    entities = found.select("doc_id", F.row_number().over(order).alias("rank"), "t.*")

    heads = each("sections").select("doc_id", place, "e.heading", "e.level", "e.content")
    if merging.merge_sections:
        sections = merged_sections(heads)
    else:
        order = Window.partitionBy("doc_id").orderBy("level", F.collate("heading", "UNICODE"), "ord")
        sections = heads.withColumn("rank", F.row_number().over(order))
    sections = sections.select("doc_id", "rank", "heading", "level", "content")
    contents = pieces.select("doc_id", "piece", "content").filter("content <> ''")
    return Parts(documents, sections, entities, each("tables").select("doc_id", "group_ord", "i", "e.headers", "e.rows", "e.caption", "e.page_no"), contents, own.select("doc_id", "group_ord", group_metadata().alias("m")), gathered)
