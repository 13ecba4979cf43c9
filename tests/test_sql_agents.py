"""Agents of rows, as DataFrame steps and as table functions in SQL."""

import pytest

from quirework.operators import agents, extract, grouping
from quirework.plans.queries import line_counter

SCHEMA = "n_lines int, longest int, seen int"


@pytest.fixture(scope="module")
def rows(spark):
    pages = spark.createDataFrame([(d, k, f"page {k}\n" + "x" * (d * k)) for d in range(1, 6) for k in range(1, 2 + 4 * d)], "doc_id long, page_no int, text string")
    return extract.group_rows(grouping.fixed_groups(pages, 3), pages).selectExpr("*", "'clashes' AS success")


def plain(df):
    return sorted((r.asDict(True) for r in df.collect()), key=lambda r: (r["doc_id"], r["group_ord"]))


def test_sql_is_the_dataframe_way(spark, rows):
    """Whichever way: a document's groups come in order to one call of the maker, other columns stay, one that clashes gives way."""
    agents.sql_agent(spark, "own_lines", line_counter, SCHEMA)
    by_sql = spark.sql("SELECT * FROM own_lines(TABLE({rows}) PARTITION BY doc_id ORDER BY group_ord)", rows=rows)
    by_frame = agents.row_agent(line_counter, SCHEMA)(rows)
    assert by_sql.columns == by_frame.columns and by_sql.columns[-5:] == ["n_lines", "longest", "seen", "success", "error"]
    got = plain(by_frame)
    assert plain(by_sql) == got and [r["seen"] for r in got if r["doc_id"] == 2] == [3, 6, 9]


def test_a_failing_group_stops_no_other(spark, rows):
    def make():
        def call(group):
            if group["group_ord"] == 1:
                raise RuntimeError("no")
            return {"n": 1, "unknown": 2}

        return call

    agents.sql_agent(spark, "failing", make, "n int, other string")
    for df in (agents.row_agent(make, "n int, other string")(rows), spark.sql("SELECT * FROM failing(TABLE({rows}) PARTITION BY doc_id ORDER BY group_ord)", rows=rows)):
        assert all((r["success"], r["error"], r["n"], r["other"]) == ((False, "no", None, None) if r["group_ord"] == 1 else (True, None, 1, None)) for r in plain(df))


def test_columns_follow_from_the_table(spark):
    agents.sql_agent(spark, "sizes", lambda: lambda g: {"size": len(g["text"])}, "size int")
    one = spark.sql("SELECT * FROM sizes(TABLE(SELECT 1 AS doc_id, 0 AS group_ord, 'abc' AS text) PARTITION BY doc_id)")
    assert one.columns == ["doc_id", "group_ord", "text", "size", "success", "error"] and one.first()["size"] == 3
    with pytest.raises(Exception, match="table of groups"):
        spark.sql("SELECT * FROM sizes(1)").collect()


def test_row_agent_in_a_run(spark):
    """An agent of rows can be what a run extracts with, through the factories."""
    agents.register("lines", lambda **_: agents.row_agent(line_counter, SCHEMA))
    pages = spark.createDataFrame([(1, 1, "a\nb")], "doc_id long, page_no int, text string")
    groups = grouping.fixed_groups(pages)
    assert agents.create("lines")(extract.group_rows(groups, pages)).first().n_lines == 2
    assert agents.row_agent(line_counter, SCHEMA)(extract.group_rows(groups, pages).limit(0)).count() == 0
