"""Merged documents as JSON, Markdown, summary text and search-index records."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.config import Output
from ..functions.text import NO_SUMMARY, capitalised


def _size(name: str) -> Column:
    return F.coalesce(F.size(F.col(name)), F.lit(0))


def summary_text(merged: DataFrame) -> DataFrame:
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("Title: "), "title", F.lit("\n\n"))).otherwise("")
    body = F.concat(title, F.lit("Summary:\n"), F.coalesce(F.nullif("summary", F.lit("")), F.lit(NO_SUMMARY)), F.lit("\n\nSections: "), _size("sections"), F.lit("\nEntities: "), _size("entities"), F.lit("\nTables: "), _size("tables"))
    return merged.select("doc_id", body.alias("output"))


def markdown_entities(entities: Column) -> Column:
    """Entities (rank, type, name, value) under a heading for each type, types in order of appearance."""
    kinds = F.array_distinct(F.transform(entities, lambda e: e["type"]))

    def part(kind: Column) -> Column:
        lines = F.transform(F.filter(entities, lambda e: e["type"] == kind), lambda e: F.concat(F.lit("- "), e["name"], F.when(F.coalesce(e["value"], F.lit("")) != "", F.concat(F.lit(": "), e["value"])).otherwise("")))
        return F.concat(F.lit("### "), capitalised(kind), F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n"))

    return F.array_join(F.transform(kinds, part), "\n")


def markdown_table(table: Column, number: Column) -> Column:
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = row(F.transform(table["headers"], lambda h: F.lit("---")))
    title = F.concat(F.lit("### Table "), number, F.when(F.coalesce(table["caption"], F.lit("")) != "", F.concat(F.lit(": "), table["caption"])).otherwise(""))
    return F.when(F.size(table["headers"]) == 0, F.concat(title, F.lit("\n"))).otherwise(F.concat(title, F.lit("\n\n"), F.array_join(F.concat(F.array(row(table["headers"]), rule), F.transform(table["rows"], row)), "\n"), F.lit("\n")))


@F.pandas_udf(T.StringType())
def _pretty(texts: pd.Series) -> pd.Series:
    """Two-space indented JSON, whole Arrow batches at a time; Spark's own differs in spacing."""
    return pd.Series([None if t is None else json.dumps(json.loads(t), indent=2, ensure_ascii=False) for t in texts], dtype=object)


def _metadata() -> Column:
    """Counts, the time, and what each group's result says of itself; without results there is no list of groups."""
    groups = F.when(F.size("of_groups") > 0, F.col("of_groups"))
    return F.struct(F.col("total_groups").alias("totalGroups"), F.col("successful_groups").alias("successfulGroups"), F.col("extracted_at").alias("extractedAt"), groups.alias("groups"))


def _listed(name: str, *fields: str) -> Column:
    strip = lambda x: F.struct(*[x[f].alias({"page_no": "pageNumber"}.get(f, f)) for f in fields])
    return F.coalesce(F.transform(F.col(name), strip), F.array())


def _document(metadata: bool) -> Column:
    parts = ["title", "summary", _listed("sections", "heading", "content", "level").alias("sections"), _listed("entities", "type", "name", "value", "confidence").alias("entities"), _listed("tables", "headers", "rows", "caption", "page_no").alias("tables")]
    if metadata:
        parts += [_metadata().alias("metadata"), F.col("full_content").alias("fullContent")]
    return F.to_json(F.struct(*parts))


def json_text(merged: DataFrame, metadata: bool = True, pretty: bool = True) -> DataFrame:
    text = _document(metadata)
    return merged.select("doc_id", (_pretty(text) if pretty else text).alias("output"))


def markdown_text(merged: DataFrame, metadata: bool = True) -> DataFrame:
    filled = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    empty = F.array().cast("array<string>")
    section = lambda s: F.concat(F.repeat(F.lit("#"), s["level"] + 2), F.lit(" "), s["heading"], F.lit("\n\n"), s["content"], F.lit("\n"))
    parts = F.concat(
        F.when(filled("title"), F.array(F.concat(F.lit("# "), "title", F.lit("\n")))).otherwise(empty),
        F.when(filled("summary"), F.array(F.lit("## Summary\n"), F.concat("summary", F.lit("\n")))).otherwise(empty),
        F.when(_size("sections") > 0, F.concat(F.array(F.lit("## Sections\n")), F.transform("sections", section))).otherwise(empty),
        F.when(_size("entities") > 0, F.array(F.lit("## Entities\n"), markdown_entities(F.col("entities")))).otherwise(empty),
        F.when(_size("tables") > 0, F.concat(F.array(F.lit("## Tables\n")), F.transform("tables", lambda t, i: markdown_table(t, i + 1)))).otherwise(empty),
    )
    body = F.array_join(parts, "\n")
    if metadata:
        body = F.concat(body, F.lit("\n## Metadata\n\n```json\n"), _pretty(F.to_json(_metadata())), F.lit("\n```"))
    return merged.select("doc_id", body.alias("output"))


#: Fields of a search record and their types, after doc_id.
RECORD = {"id": "string", "type": "string", "title": "string", "heading": "string", "content": "string", "level": "int", "entity_type": "string", "name": "string", "confidence": "double", "headers": "array<string>", "rows": "array<array<string>>", "page_no": "int"}


def search_documents(merged: DataFrame) -> DataFrame:
    """Flat records: doc_id and the fields of ``RECORD``. One pass: a document's records are made as one array in its row."""

    def record(**fields: Column) -> Column:
        return F.struct(*[fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in RECORD.items()])

    def records(name: str, kind: str, f) -> Column:
        listed = F.transform(F.col(name), lambda x, i: record(id=F.concat(F.lit(kind + "-"), i), type=F.lit(kind), **f(x)))
        return F.coalesce(listed, F.array().cast(f"array<struct<{', '.join(f'{n}: {t}' for n, t in RECORD.items())}>>"))

    summary = record(id=F.lit("summary"), type=F.lit("summary"), title=F.coalesce(F.nullif("title", F.lit("")), F.lit("Summary")), content=F.col("summary"))
    every = F.concat(
        F.filter(F.array(summary), lambda x: F.coalesce(x["content"], F.lit("")) != ""),
        records("sections", "section", lambda x: {"heading": x["heading"], "content": x["content"], "level": x["level"]}),
        records("entities", "entity", lambda x: {"entity_type": x["type"], "name": x["name"], "confidence": x["confidence"]}),
        records("tables", "table", lambda x: {"headers": x["headers"], "rows": x["rows"], "page_no": x["page_no"]}),
    )
    return merged.select("doc_id", F.explode(every).alias("r")).select("doc_id", "r.*")


def search_index(merged: DataFrame) -> DataFrame:
    """One JSON text per document with its records, always indented.

    Records of all kinds have one type, so that a document is written as JSON in one go; what a kind doesn't have is null, and nulls aren't written.
    """
    kinds = {"id": "string", "type": "string", "heading": "string", "content": "string", "title": "string", "level": "int", "entityType": "string", "name": "string", "value": "string", "confidence": "double", "caption": "string", "headers": "array<string>", "rows": "array<array<string>>", "pageNumber": "int"}
    of = f"array<struct<{', '.join(f'{n}: {t}' for n, t in kinds.items())}>>"

    def record(kind: str, place: Column, **cols: Column) -> Column:
        return F.struct(*[(cols | {"id": place, "type": F.lit(kind)}).get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])

    part = lambda name, kind, f: F.coalesce(F.transform(F.col(name), lambda x, i: record(kind, F.concat(F.lit(kind + "-"), i), **f(x))), F.array().cast(of))
    summary = record("summary", F.lit("summary"), content=F.col("summary"), title=F.coalesce(F.nullif("title", F.lit("")), F.lit("Summary")))
    listed = F.concat(
        F.when(F.coalesce("summary", F.lit("")) != "", F.array(summary)).otherwise(F.array().cast(of)),
        part("sections", "section", lambda s: {"heading": s["heading"], "content": s["content"], "level": s["level"]}),
        part("entities", "entity", lambda e: {"entityType": e["type"], "name": e["name"], "value": e["value"], "confidence": e["confidence"]}),
        part("tables", "table", lambda t: {"caption": t["caption"], "headers": t["headers"], "rows": t["rows"], "pageNumber": t["page_no"]}),
    )
    return merged.select("doc_id", _pretty(F.to_json(F.struct("title", listed.alias("documents"), _metadata().alias("metadata")))).alias("output"))


def format_output(merged: DataFrame, output: Output = Output()) -> DataFrame:
    """doc_id, output in the format that ``output`` names; anything else is JSON."""
    if output.format == "markdown":
        return markdown_text(merged, output.include_metadata)
    if output.format == "summary":
        return summary_text(merged)
    if output.format == "search-index":
        return search_index(merged)
    return json_text(merged, output.include_metadata, output.pretty)
