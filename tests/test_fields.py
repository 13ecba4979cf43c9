"""Open schemas: typed fields, the rest as an object, merging over a document's groups."""

import json

import pytest
from pyspark.sql import functions as F

from quirework.functions.config import Settings
from quirework.operators import fields, model
from quirework.plans import flow

REPLIES = [
    (1, 0, True, 'so: {"title": "t", "span": 3, "tags": ["a", "b"], "o": {"n": "q"}, "color": "c1", "it\'s": 1, "metadata": {"k": 1, "startPage": 9}} done'),
    (1, 1, True, '{"span": "no number", "tags": ["c"], "color": "c2", "z": null, "w": [1, {"a": 2}], "big": 12345678901234567890}'),
    (2, 0, True, "no object"),
    (2, 1, True, None),
    (3, 0, False, '{"span": 5}'),
    (4, 0, True, '{"z": null, "summary": "s"}'),
    (4, 1, True, '{"z": 0, "tags": []}'),
]


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(REPLIES, "doc_id long, group_ord int, success boolean, response string").repartition(3).withColumn("extra", fields.bag(F.col("response")))


def test_bag_has_what_is_not_standard(results):
    got = {(r.doc_id, r.group_ord): r.j for r in results.select("doc_id", "group_ord", F.to_json("extra").alias("j")).collect()}
    want = {(d, g): json.loads(t[t.index("{") : t.rindex("}") + 1]) if t and "{" in t else None for d, g, _, t in REPLIES}
    for key, value in want.items():
        own = value and {k: v for k, v in value.items() if k not in fields.STANDARD}
        assert (json.loads(got[key]) if got[key] else None) == (own if value is not None else None)


def test_typed_and_by_document(results):
    schema = "span int, tags array<string>, o struct<n:string>, `it's` long"
    rows = {r.doc_id: r for r in fields.by_document(results, schema).withColumn("rest", F.to_json("rest")).collect()}
    assert set(rows) == {1, 2, 4}
    assert (rows[1].span, rows[1].tags, rows[1].o.n, rows[1]["it's"]) == (3, ["a", "b", "c"], "q", 1)
    assert json.loads(rows[1].rest) == {"color": "c1", "w": [1, {"a": 2}], "big": 12345678901234567890}
    assert (rows[2].span, rows[2].tags, rows[2].rest) == (None, [], "{}") and json.loads(rows[4].rest) == {"z": 0}


def test_schema_of_all_replies(results):
    (row,) = fields.schema_of(results).collect()
    assert row.schema.startswith("OBJECT<") and "span: VARIANT" in row.schema and "tags: ARRAY<STRING>" in row.schema


def test_metadata_of_a_reply_gives_way_to_what_is_known(results):
    m = fields.metadata_bag(F.col("response"), F.lit(1), F.lit(2), F.lit(2), F.lit("now"), F.lit("me"))
    got = {(r.doc_id, r.group_ord): json.loads(r.m) for r in results.select("doc_id", "group_ord", F.to_json(m).alias("m")).collect()}
    known = {"startPage": 1, "endPage": 2, "pageCount": 2, "extractedAt": "now", "extractedBy": "me"}
    assert got[1, 0] == known | {"k": 1} and got[2, 0] == known == got[2, 1]


def test_words_are_no_schema():
    assert fields.is_schema("a int, b array<string>") and not any(map(fields.is_schema, (None, "", "Give all invoices", '{"a": "number"}')))


def test_fields_of_a_run(spark):
    class Own:
        def complete_json(self, messages):
            return model.Reply('{"title": "x", "total": 1.5, "other": true}')

    pages = spark.createDataFrame([(1, k, "text") for k in range(1, 13)], "doc_id long, page_no int, text string")
    settings = Settings().with_(grouping={"strategy": "fixed"}, extraction={"schema": "total double"})
    run = flow.run(pages, settings=settings, client=Own())
    (row,) = run.fields().withColumn("rest", F.to_json("rest")).collect()
    assert (row.total, row.rest) == (1.5, '{"other":true}')
    with pytest.raises(ValueError, match="schema"):
        flow.run(pages, settings=settings.with_(extraction={"schema": "some words"}), client=Own()).fields()
    assert flow.run(pages, settings=settings).fields().collect()[0].total is None
