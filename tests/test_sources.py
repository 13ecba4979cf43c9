from quirework.sources import readers


def test_outline_keeps_the_first_thousand_siblings_of_each_parent(spark):
    nodes = [("d", "a", None, 0, "A", 1), ("d", "b", None, 7000, "B", 2)]
    nodes += [("d", f"a{k}", "a", 5000 + 3 * k, f"a{k}", k) for k in range(400)]
    nodes += [("d", f"b{k}", "b", 2 * k, f"b{k}", k) for k in range(1200)]
    df = spark.createDataFrame(nodes, "doc_id string, node_id string, parent_id string, position int, title string, page_no int")
    got = [(r.level, r.title) for r in readers.outline(df).orderBy("toc_ord").collect()]
    assert got == [(1, "A"), *[(2, f"a{k}") for k in range(400)], (1, "B"), *[(2, f"b{k}") for k in range(1000)]]
