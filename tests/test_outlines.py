"""Outlines of any depth and shape."""

import random

from quirework.sources import readers


def brute(nodes):
    out, below = [], {}
    for d, n, p, pos, t, page in nodes:
        below.setdefault((d, p), []).append((pos, n, t, page))

    def walk(d, parent, level, rows):
        for _, n, t, page in sorted(below.get((d, parent), []))[:1000]:
            rows.append((level, t or "Untitled", 1 if page is None else page))
            walk(d, n, level + 1, rows)

    for d in {x[0] for x in nodes}:
        rows = []
        walk(d, None, 1, rows)
        out += [(d, k + 1, *r) for k, r in enumerate(rows)]
    return sorted(out)


def toc(spark, nodes):
    df = spark.createDataFrame(nodes, "doc_id int, node_id int, parent_id int, position int, title string, page_no int").repartition(4)
    return sorted(map(tuple, readers.outline(df).collect()))


def test_random_trees(spark):
    rng, nodes = random.Random(3), []
    for d in range(8):
        for n in range(rng.randrange(1, 60)):
            nodes.append((d, n, rng.choice([None, *range(max(0, n - 3), n)]), rng.randrange(5), rng.choice(["t", "", None, f"n{n}"]), rng.choice([None, n])))
    assert toc(spark, nodes) == brute(nodes)


def test_orphans_and_circles_are_left_out(spark):
    nodes = [(1, 1, None, 0, "a", 1), (1, 2, 1, 0, "b", 1), (1, 3, 99, 0, "orphan", 1), (1, 4, 3, 0, "under it", 1), (1, 5, 6, 0, "x", 1), (1, 6, 5, 0, "y", 1), (1, 7, 7, 0, "own", 1), (1, 8, 5, 0, "into a circle", 1)]
    assert toc(spark, nodes) == [(1, 1, 1, "a", 1), (1, 2, 2, "b", 1)]
    assert toc(spark, nodes[4:]) == [] and toc(spark, []) == []


def test_a_chain_of_ten_thousand_levels(spark, monkeypatch):
    """Under 20 joins, and ways stay short where nothing parts."""
    saved = []
    keep = readers.Scratch.save
    monkeypatch.setattr(readers.Scratch, "save", lambda self, df: saved.append(1) or keep(self, df))
    nodes = [(1, n, n - 1 if n else None, 0, f"n{n}", n) for n in range(10_000)] + [(1, 20_000, 9_998, 1, "side", 5)]
    got = toc(spark, nodes)
    assert len(saved) < 20 and [r[2:] for r in got[:9_999]] == [(n + 1, f"n{n}", n) for n in range(9_999)]
    assert got[9_999:] == [(1, 10_000, 10_000, "n9999", 9999), (1, 10_001, 10_000, "side", 5)]


def test_the_first_thousand_siblings_count(spark):
    nodes = [(1, n, None if n == 0 else 0, n * 7, f"n{n}", n) for n in range(1_200)]
    got = toc(spark, nodes)
    assert len(got) == 1_001 and got[-1] == (1, 1_001, 2, "n1000", 1000)


def test_the_query_has_the_suppliers_its_sql_names(spark, tmp_path):
    """Keys from 1000 on are no nodes, however many siblings there are."""
    import duckdb

    from quirework.plans.oracle import ORACLES
    from quirework.plans.queries import QUERIES
    from tests.conftest import SF, same_rows

    con = duckdb.connect()
    for name in ("region", "nation"):
        con.sql(f"COPY (SELECT * FROM '{SF}/{name}.parquet') TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    con.sql(f"COPY (SELECT * REPLACE (CAST(s_suppkey + i * 500 AS BIGINT) AS s_suppkey) FROM '{SF}/supplier.parquet', range(4) r(i)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    for name in ("region", "nation", "supplier"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    assert con.sql("SELECT count(*) FROM supplier WHERE s_suppkey >= 1000").fetchall()[0][0] > 0
    same_rows(QUERIES["outline_flatten"](spark, str(tmp_path)), con.sql(ORACLES["outline_flatten"]))
