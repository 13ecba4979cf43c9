"""Fields beyond the standard ones in what a model replies: typed by a schema of the caller's, the rest kept open as VARIANT.

A result's ``extra`` holds every field of its reply that isn't standard. Nothing is known of them beforehand: ``schema_of`` finds what there is,
``typed`` takes out what a schema names, ``by_document`` merges both over a document's groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import json_object

#: Fields of a reply that results have columns for (fixed values).
STANDARD = ("groupId", "title", "summary", "entities", "sections", "tables", "metadata", "rawContent")
#: Keys of a result's metadata that are never the reply's (fixed values).
OWN_METADATA = ("startPage", "endPage", "pageCount", "extractedAt", "extractedBy")


def object_map(value: Column) -> Column:
    """An object's fields by name; null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def bag(response: Column) -> Column:
    """What a reply has beyond the standard fields, as an object: empty where it has nothing else, null where it is no JSON object."""
    return F.to_variant_object(F.map_filter(object_map(F.try_parse_json(json_object(response))), lambda k, v: ~k.isin(*STANDARD)))


def _fields(schema: str) -> list[T.StructField]:
    return T._parse_datatype_string(schema).fields


def is_schema(text: str | None) -> bool:
    """Whether a text is a list of columns and types, as in SQL."""
    if not text:
        return False
    try:
        return bool(_fields(text))
    except Exception:  # any error of Spark's parser: then it is words for the model alone
        return False


def _path(name: str) -> str:
    quote = "'" if "'" not in name else '"'
    if quote in name:
        raise ValueError(f"a field's name has both kinds of quotes: {name}")
    return f"$[{quote}{name}{quote}]"


def typed(results: DataFrame, schema: str) -> DataFrame:
    """Adds a column for each field of ``schema`` (columns and types, as in SQL), and ``rest``, the other fields of ``extra``.

    A field that is missing or doesn't fit its type is null. Columns of ``results`` with these names are replaced.
    """
    fields = _fields(schema)
    names = [f.name for f in fields]
    rest = F.to_variant_object(F.map_filter(object_map(F.col("extra")), lambda k, v: ~k.isin(*names)))
    return results.withColumns({f.name: F.try_variant_get("extra", _path(f.name), f.dataType.simpleString()) for f in fields} | {"rest": rest})


def by_document(results: DataFrame, schema: str) -> DataFrame:
    """doc_id, the fields of ``schema``, and ``rest``, over the groups that succeeded: the first value in the groups' order that isn't null; of arrays all items, in order.

    Fields under other names go into ``rest``, the first that isn't null of each name. A document has as many values as groups, each field is merged on its own.
    """
    fields = _fields(schema)
    own = typed(results.filter("success"), schema)
    aggregates = []
    for f in fields:
        if isinstance(f.dataType, T.ArrayType):
            # By the groups' order alone: items may be of types that have none.
            held = F.array_sort(F.collect_list(F.when(F.col(f.name).isNotNull(), F.struct("group_ord", F.col(f.name).alias("v")))), lambda a, b: a["group_ord"] - b["group_ord"])
            aggregates.append(F.flatten(F.transform(held, lambda x: x["v"])).alias(f.name))
        else:
            aggregates.append(F.min_by(f.name, F.when(F.col(f.name).isNotNull(), F.col("group_ord"))).alias(f.name))
    known = own.groupBy("doc_id").agg(*aggregates)
    # Each name's values on their own: a document's open fields need not fit one row before they are merged.
    parts = own.select("doc_id", "group_ord", F.explode(object_map(F.col("rest"))).alias("name", "value")).filter(~F.is_variant_null("value"))
    first = parts.groupBy("doc_id", "name").agg(F.min_by(F.to_json("value"), "group_ord").alias("j"))
    rest = first.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.parse_json("j")))).alias("m"))
    empty = F.parse_json(F.lit("{}"))
    return known.join(rest, "doc_id", "left").withColumn("rest", F.coalesce(F.to_variant_object("m"), empty)).drop("m")


def schema_of(results: DataFrame) -> DataFrame:
    """One row, ``schema``: the fields of all ``extra`` and their types, those that agree in no type as VARIANT."""
    return results.agg(F.schema_of_variant_agg("extra").alias("schema"))


def metadata_bag(response: Column, start_page: Column, end_page: Column, page_count: Column, extracted_at: Column, extracted_by: Column) -> Column:
    """A result's metadata: the object that the reply has for it, with what is known of the group over it."""
    own = (start_page, end_page, page_count, extracted_at, extracted_by)
    known = F.map_from_arrays(F.array(*[F.lit(k) for k in OWN_METADATA]), F.array(*[F.to_variant_object(F.array(c)) for c in own]))
    known = F.transform_values(known, lambda k, v: F.variant_get(v, "$[0]", "variant"))
    given = F.map_filter(object_map(F.try_variant_get(F.try_parse_json(json_object(response)), "$.metadata", "variant")), lambda k, v: ~k.isin(*OWN_METADATA))
    return F.to_variant_object(F.map_concat(F.coalesce(given, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))), known))
