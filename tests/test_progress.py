"""Progress that is seen while one action runs."""

import time

import pytest

from quirework.functions.config import Execution, Settings
from quirework.operators import model
from quirework.plans import flow


class Slow:
    """A reply takes a while, longer for some prompts; every tenth has none."""

    def complete(self, messages):
        n = int(messages[-1]["content"])
        time.sleep(0.02 + n % 4 * 0.03)
        if n % 10 == 0:
            raise RuntimeError("no")
        return model.Reply("x")

    def complete_json(self, messages):
        return model.Reply('{"title": "x"}')


@pytest.mark.parametrize("kept", [False, True])
def test_counts_rise_during_one_action(spark, tmp_path, kept):
    seen = []
    prompts = spark.range(120).selectExpr("id", "'s' AS system", "CAST(id AS STRING) AS prompt")
    execution = Execution(max_concurrency=3, retries=0, replies=f"{tmp_path}/log" if kept else None)
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        out = model.called(prompts, Slow(), execution, as_json=False, on_progress=lambda *x: seen.append((*x, time.monotonic())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out.filter("success").count() == 108
    done = [x[0] for x in seen]
    assert done == sorted(set(done)) and done[-1] == 120 and len([d for d in done if 0 < d < 120]) >= 1
    assert seen[-1][1:3] == (12, 120) and seen[-1][3] - seen[0][3] > 0.3


def test_hook_of_a_run(spark):
    seen, calls = [], spark.sparkContext.accumulator(0)

    class Counting:
        def complete_json(self, messages):
            calls.add(1)
            return model.Reply('{"title": "x"}')

    pages = spark.createDataFrame([(d, k, "text") for d in range(4) for k in range(1, 13)], "doc_id long, page_no int, text string")
    run = flow.run(pages, settings=Settings().with_(grouping={"strategy": "fixed"}), client=Counting(), hooks={"on_extraction_tick": lambda *x: seen.append(x)})
    assert seen[-1] == (8, 0, 8) and run.results.count() == 8 and calls.value == 8


def test_a_failing_hook_stops_no_run(spark):
    def hook(done, failed, total):
        if done < total:
            raise RuntimeError("hook")

    pages = spark.createDataFrame([(1, k, "text") for k in range(1, 13)], "doc_id long, page_no int, text string")
    run = flow.run(pages, settings=Settings().with_(grouping={"strategy": "fixed"}), client=Slow(), hooks={"on_extraction_tick": hook})
    assert run.results.filter("success").count() == 2
