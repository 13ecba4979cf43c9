import random

from pyspark.sql import functions as F

from quirework.functions.config import Grouping
from quirework.operators import grouping as G
from quirework.operators import parse


def report(spark, heads: dict[int, list[str]], n: int):
    return spark.createDataFrame([(1, p, "\n".join(heads.get(p, ["plain text here"]))) for p in range(1, n + 1)], "doc_id int, page_no int, text string")


def spans(df):
    return [(r.start_page, r.end_page, r.page_count, r.title) for r in df.orderBy("group_ord").collect()]


def test_fixed(spark):
    assert [s[:3] for s in spans(G.fixed_groups(report(spark, {}, 25)))] == [(1, 10, 10), (11, 20, 10), (21, 25, 5)]


def test_headings_drop_what_precedes_and_empty_groups(spark):
    pages = report(spark, {3: ["Chapter 1 A", "Chapter 2 B"], 7: ["Chapter 3 C"]}, 10)
    assert spans(G.heading_groups(pages, parse.elements(pages))) == [(3, 6, 4, "Chapter 2 B"), (7, 10, 4, "Chapter 3 C")]


def test_last_small_group_is_absorbed(spark):
    pages = report(spark, {1: ["Chapter 1 A"], 5: ["Chapter 2 B"], 10: ["Chapter 3 C"]}, 10)
    g = lambda most: spans(G.heading_groups(pages, parse.elements(pages), Grouping("heading", min_size=2, max_size=most)))
    assert g(50) == [(1, 4, 4, "Chapter 1 A"), (5, 10, 6, "Chapter 2 B / Chapter 3 C")]
    assert [s[:2] for s in g(5)] == [(1, 4), (5, 9), (10, 10)]


def test_toc_keeps_empty_groups(spark):
    toc = spark.createDataFrame([(1, k, 1, f"t{k}", p) for k, p in enumerate((1, 4, 4))], "doc_id int, toc_ord int, level int, title string, page_no int")
    pages = report(spark, {}, 6)
    assert [s[:3] for s in spans(G.toc_groups(pages, parse.elements(pages), toc))] == [(1, 3, 3), (4, 3, 0), (4, 6, 3)]


def test_unknown_strategy_is_fixed(spark):
    pages = report(spark, {}, 3)
    assert G.grouper("other")(pages, parse.elements(pages), None, Grouping()).first().type == "fixed"


def test_sample_pages(spark):
    want = {0: [], 3: [1, 2, 3], 6: [1, 2, 3, 5, 6], 10: [1, 2, 5, 9, 10], 11: [1, 2, 5, 8, 10, 11], 100: [1, 2, 50, 75, 99, 100]}
    df = spark.createDataFrame([(n,) for n in want], "n int").select("n", G.sample_pages(F.col("n")).alias("p"))
    assert {r.n: r.p for r in df.collect()} == want


def literal_groups(heads, n, least, most):
    """The sequential fold, step by step."""
    found = []
    for i, (p, title) in enumerate(heads):
        end = heads[i + 1][0] - 1 if i + 1 < len(heads) else n
        if end - p + 1 < least and i < len(heads) - 1:
            continue
        found.append([p, end, max(0, end - p + 1), title])
    merged, current = [], None
    for g in found:
        if current is None:
            current = list(g)
        elif current[2] + g[2] <= most and g[2] < least:
            current[1], current[2], current[3] = g[1], current[2] + g[2], f"{current[3]} / {g[3]}"
        else:
            if current[2] >= least:
                merged.append(current)
            current = list(g)
    return [tuple(g) for g in [*merged, current]]


def test_heading_groups_match_the_fold(spark):
    rng, rows, want = random.Random(3), [], {}
    for doc in range(60):
        n = rng.randint(1, 12)
        heads = sorted((rng.randint(1, n), k) for k in range(rng.randint(1, 5)))
        heads = [(p, f"Chapter {i + 1} x") for i, (p, _) in enumerate(heads)]
        rows += [(doc, p, "\n".join(t for q, t in heads if q == p) or "body") for p in range(1, n + 1)]
        want[doc] = literal_groups(heads, n, 3, 6)
    pages = spark.createDataFrame(rows, "doc_id int, page_no int, text string")
    got = G.heading_groups(pages, parse.elements(pages), Grouping("heading", min_size=3, max_size=6)).collect()
    for doc, groups in want.items():
        own = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.group_ord)
        assert [(r.start_page, r.end_page, r.page_count, r.title) for r in own] == groups
