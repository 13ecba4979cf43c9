import pytest
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import parse

GOLDEN = {
    "Chapter 3: Intro": ("heading", 1), "PARTNERS": ("heading", 1), "SECTIONAL REVIEW": ("heading", 2), "Section 2.1.3": ("heading", 2),
    "1.2 Overview": ("heading", 3), "1 Overview": ("heading", 4), "EXECUTIVE SUMMARY": ("heading", 4), "USA": ("heading", 4), "Part different": ("heading", 1),
    "1. Overview": ("heading", 4), "1. Buy milk, eggs": ("list", None), "1.2.3 Overview": ("text", None), "Introduction to Foo": ("text", None),
    "INTRODUCTION": ("heading", 1), "Appendix": ("heading", 1), "a) foo": ("list", None), "A. Foo": ("list", None), "- item": ("list", None), "OK": ("text", None), "Part time": ("text", None),
}


def page(spark, text):
    return spark.createDataFrame([(1, 1, text)], "doc_id int, page_no int, text string")


def test_golden_lines(spark):
    rows = parse.elements(page(spark, "\n".join(GOLDEN))).orderBy("line_no").collect()
    assert {r.text: (r.type, r.level) for r in rows} == GOLDEN


def test_offsets_blank_lines_and_other_spaces(spark):
    rows = parse.elements(page(spark, "ab\n\n  cd  \n " + chr(0xA0) + "\nlast")).collect()
    assert [(r.line_no, r.pos, r.text) for r in rows] == [(0, 0, "ab"), (2, 4, "cd"), (4, 14, "last")]


def test_null_page_has_no_elements(spark):
    assert parse.elements(page(spark, None)).count() == 0


def test_custom_patterns_reach_the_capitals_rule(spark):
    rows = parse.elements(page(spark, "MANY CAPITALS HERE\n# mark"), patterns=[r"\A#.*\z"]).collect()
    assert [(r.type, r.level) for r in rows] == [("heading", 2), ("heading", 1)]


@pytest.mark.parametrize("a,b,out", [("abc", "b", "abc"), ("a", "xay", "xay"), ("a", "b", "a\n\nb")])
def test_merge_content(spark, a, b, out):
    assert spark.range(1).select(T.merge_content(F.lit(a), F.lit(b))).first()[0] == out


def test_truncate_at_sentence(spark):
    cut = lambda s: spark.range(1).select(T.truncate_sentence(F.lit(s), 10)).first()[0]
    assert cut("short") == "short"
    assert cut("12345678. more") == "12345678."
    assert cut("12. 45678901") == "12. 456789..."


def test_json_object(spark):
    get = lambda s: spark.range(1).select(T.json_object(F.lit(s))).first()[0]
    assert get('so {"a": {"b": 1}} end') == '{"a": {"b": 1}}'
    assert get("none") == "none"


def test_offsets_of_long_pages(spark):
    """Offsets across blocks of lines, in time that doesn't grow with the square of the lines."""
    import time

    raw = [("x" * (k % 7)) for k in range(100_000)]
    began = time.time()
    rows = parse.lines(page(spark, "\n".join(raw))).select("line_no", "pos").collect()
    assert time.time() - began < 20
    at = 0
    for r, line in zip(sorted(rows), raw):
        assert r.pos == at
        at += len(line) + 1
    assert len(rows) == len(raw)
