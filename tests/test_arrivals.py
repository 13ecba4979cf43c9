"""Pages that arrive out of order, twice, late or not at all."""

import random
import time
from collections import Counter

import pytest

from quirework.operators import grouping
from quirework.streaming import arrivals

SCHEMA = "doc_id long, page_no int, page_count int, text string"


@pytest.fixture
def provider(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    yield
    spark.conf.set(name, before)


def test_shuffled_pages_give_the_batch_result(spark, tmp_path, provider):
    rng = random.Random(2)
    pages = [(d, k, d % 7 + 1, f"{d}/{k}") for d in range(20) for k in range(1, d % 7 + 2)]
    extra = [(d, k, n, "again") for d, k, n, _ in pages[::5]] + [(1, 99, 2, "far"), (2, 0, 3, "none"), (3, None, 4, "no number")]
    missing = (6, 3)
    first = [p for p in pages if p[:2] != missing]
    rng.shuffle(first)
    parts = [first[k::3] for k in range(3)] + [extra]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(0.05)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    groups, rest = [], []

    def work(df):
        groups.extend(tuple(r) for r in grouping.fixed_groups(df, 2).select("doc_id", "group_ord", "start_page", "end_page").collect())

    arrived = arrivals.whole_documents(stream)
    others = lambda df: rest.extend((r.doc_id, r.page_no, r.text, r.kind) for r in df.collect())
    run = arrivals.for_whole_documents(arrived, work, others).option("checkpointLocation", f"{tmp_path}/at").trigger(processingTime="1 second").start()
    until = time.time() + 150
    while time.time() < until and run.isActive and (len(rest) < len(extra) or len({g[0] for g in groups}) < 19):
        time.sleep(0.5)
    run.stop()
    batch = spark.createDataFrame([p for p in pages if p[0] != 6], SCHEMA)
    want = [tuple(r) for r in grouping.fixed_groups(batch.select("doc_id", "page_no", "text"), 2).select("doc_id", "group_ord", "start_page", "end_page").collect()]
    assert sorted(groups) == sorted(want)
    kinds = Counter(r[3] for r in rest)
    assert kinds["stray"] == 3 and kinds["late"] + kinds["repeated"] == len(extra) - 3
    assert len(rest) == len(extra) and {r[3] for r in rest if r[0] == 6} <= {"repeated"}
    # Pages are held of the document alone that isn't whole.
    state = spark.read.format("statestore").option("stateVarName", "pages").option("path", f"{tmp_path}/at").load()
    assert {r.key.doc_id for r in state.select("key").collect()} == {6}


def test_waiting_ends(spark, tmp_path, provider):
    """A document that stays incomplete comes out as it is; a page that comes then is late."""
    spark.createDataFrame([(1, 2, 3, "b"), (1, 1, 3, "a")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen = []
    run = arrivals.whole_documents(stream, wait_ms=500).writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/at").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while len(seen) < 2 and time.time() < until:
            time.sleep(0.5)
        assert seen == [(1, 1, "a", "partial"), (1, 2, "b", "partial")]
        spark.createDataFrame([(1, 3, 3, "c")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/1")
        while len(seen) < 3 and time.time() < until:
            time.sleep(0.5)
        assert seen[2:] == [(1, 3, "c", "late")]
    finally:
        run.stop()
