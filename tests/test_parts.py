"""Merging part by part gives what merging in a document's row gives."""

import random

import pytest
from pyspark.sql import functions as F

from quirework.functions.config import Merging
from quirework.operators import merge

SCHEMA = (
    "doc_id long, group_ord int, group_id string, start_page int, end_page int, page_count int, success boolean, title string, summary string, raw_content string, entities array<struct<type:string,name:string,value:string,confidence:double>>, "
    "sections array<struct<heading:string,content:string,level:int>>, tables array<struct<headers:array<string>,rows:array<array<string>>,caption:string,page_no:int>>, extracted_at string, extracted_by string, llm_enhanced boolean"
)
NOW = "2024-01-01T00:00:00.000Z"


def results(rng, docs):
    out = []
    for d, n in docs:
        for g in range(n):
            entities = [(rng.choice(["a", "b", None]), rng.choice(["X", "x", "Y", "é", None]), rng.choice(["v", None]), rng.choice([0.5, 0.9, None])) for _ in range(rng.randrange(4))]
            sections = [(rng.choice(["Intro", "INTRO", "b", "Ä"]), rng.choice(["p", "q", "p q r", "q", ""]), rng.choice([1, 2])) for _ in range(rng.randrange(3))]
            tables = [(["h"], [["1"], [str(g)]], None, g)] * rng.randrange(3)
            out.append((d, g, f"g{g}", g, g, 1, rng.random() < 0.8, rng.choice([None, "", f"t{g}"]), rng.choice([None, "", f"Words of {g}. ", "x" * 40]), rng.choice([None, "", f"raw {g}"]), entities or rng.choice([None, []]), sections, tables, NOW, None, None))
    return out


@pytest.mark.parametrize("segment", [1, 3, 1000])
@pytest.mark.parametrize("merging", [Merging(), Merging(deduplicate=False, merge_sections=False, sort_entities=False, summary_limit=90), Merging(summary_limit=1)])
def test_parts_are_the_whole(spark, segment, merging):
    rng = random.Random(segment)
    rows = results(rng, [(1, 1), (2, 7), (3, 40), (4, 2), (None, 3)])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = sorted((r for r in merge.merged(df, merging, NOW).collect() if r.doc_id is not None), key=lambda r: r.doc_id)
    got = sorted((r for r in merge.in_parts(df, merging, NOW, segment).whole().collect() if r.doc_id is not None), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    for a, b in zip(got, want):
        a, b = a.asDict(True), b.asDict(True)
        for name in b:
            assert a[name] == b[name], (a["doc_id"], name)


def test_a_document_of_very_many_groups(spark):
    """No row of the parts holds a whole document: pieces of its text are of a segment each."""
    df = spark.range(60_000).selectExpr("7L AS doc_id", "CAST(id AS INT) AS group_ord", "concat('g', id) AS group_id", "CAST(id AS INT) AS start_page", "CAST(id AS INT) AS end_page", "1 AS page_count", "true AS success", "concat('t', id) AS title", "concat('Sentence ', id, '.') AS summary",
        "concat('raw ', id) AS raw_content", "array(named_struct('type', 'n', 'name', concat('N', id % 100), 'value', CAST(NULL AS STRING), 'confidence', id % 7 / 10.0D)) AS entities", "array(named_struct('heading', concat('h', id % 50), 'content', concat('c', id % 200), 'level', 1)) AS sections",
        "CAST(array() AS array<struct<headers:array<string>,rows:array<array<string>>,caption:string,page_no:int>>) AS tables", f"'{NOW}' AS extracted_at", "CAST(NULL AS STRING) AS extracted_by", "CAST(NULL AS BOOLEAN) AS llm_enhanced")
    parts = merge.in_parts(df, now=NOW)
    assert parts.contents.count() == 60 and parts.contents.selectExpr("max(length(content)) AS m").first().m < 20_000
    (a,), (b,) = parts.whole().collect(), merge.merged(df, now=NOW).collect()
    assert a.asDict(True) == b.asDict(True)


def test_results_are_made_once_for_each_way_they_are_dealt(spark):
    """Once for what goes by segment, by name and by heading; an array that is exploded isn't asked for its size first, which would make it twice."""
    rows = results(random.Random(1), [(1, 3), (2, 2)])
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    df = df.withColumn("entities", F.concat("entities", F.array_distinct("entities")))
    plan = merge.in_parts(df, now=NOW).whole()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(") == 1 and plan.count("LogicalRDD") == 3
