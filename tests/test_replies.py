"""Calls that are kept: a run that is killed goes on where it was, calls in flight stay within their limit."""

import os
import time
import uuid
from functools import partial

import pytest
from pyspark.sql import functions as F

from quirework.functions.config import Execution
from quirework.operators import model
from quirework.operators.replies import ReplyLog


class Counting:
    """Leaves a file for each reply. At the prompt named in ``fatal`` its process dies, as long as the file of that name isn't there."""

    def __init__(self, folder, fatal=None, slow=0.0):
        self.folder, self.fatal, self.slow = str(folder), fatal, slow

    def complete(self, messages):
        text = messages[-1]["content"]
        if text == self.fatal and not os.path.exists(f"{self.folder}/died"):
            open(f"{self.folder}/died", "w").close()
            os._exit(1)
        mine = f"{self.folder}/flying-{uuid.uuid4().hex}"
        open(mine, "w").close()
        flying = sum(n.startswith("flying-") for n in os.listdir(self.folder))
        open(f"{self.folder}/most-{flying}", "w").close()
        time.sleep(self.slow)
        os.remove(mine)
        if text.startswith("bad"):
            raise RuntimeError("no")
        open(f"{self.folder}/sent-{text}-{uuid.uuid4().hex}", "w").close()
        return model.Reply(f"re: {text}", 3)

    def sent(self):
        return sorted(n.split("-")[1] for n in os.listdir(self.folder) if n.startswith("sent-"))

    def most(self):
        return max(int(n.split("-")[1]) for n in os.listdir(self.folder) if n.startswith("most-"))


def prompts(spark, names):
    return spark.createDataFrame([(k, "s", n) for k, n in enumerate(names)], "k long, system string, prompt string")


NAMES = [f"p{k:02}" for k in range(30)]


def test_a_killed_run_goes_on(spark, tmp_path, monkeypatch):
    """The worker dies at one prompt and the job with it. The next run sends that prompt and those after it, none twice."""
    monkeypatch.setattr(model, "ReplyLog", partial(ReplyLog, every=1))
    client, kept = Counting(tmp_path, "p17"), Execution(max_concurrency=1, retries=0, replies=f"file://{tmp_path}/log")
    with pytest.raises(Exception):
        model.called(prompts(spark, NAMES), client, kept, as_json=False)
    before = client.sent()
    assert 0 < len(before) < len(NAMES)
    out = model.called(prompts(spark, NAMES), client, kept, as_json=False).collect()
    assert client.sent() == NAMES and client.most() == 1
    assert sorted((r.prompt, r.response, r.success, r.sent) for r in out) == [(n, f"re: {n}", True, n not in before) for n in NAMES]


def test_failures_are_sent_again_and_repeats_once(spark, tmp_path):
    client, kept = Counting(tmp_path), Execution(retries=0, replies=f"{tmp_path}/log")
    names = ["a", "a", "a", "bad", "b"]
    first = {(r.k, r.success, r.sent) for r in model.called(prompts(spark, names), client, kept, as_json=False).collect()}
    assert first == {(0, True, True), (1, True, True), (2, True, True), (3, False, True), (4, True, True)} and client.sent() == ["a", "b"]
    again = {(r.k, r.success, r.sent, r.error) for r in model.called(prompts(spark, [*names, "c"]), client, kept, as_json=False).collect()}
    assert again == {(0, True, False, None), (1, True, False, None), (2, True, False, None), (3, False, True, "no"), (4, True, False, None), (5, True, True, None)}
    # Another client, or JSON instead of words, is another reply.
    other = type("Other", (Counting,), {})(tmp_path)
    assert all(r.sent for r in model.called(prompts(spark, ["a"]), other, kept, as_json=False).collect())


def test_log_is_compacted(spark, tmp_path):
    client, kept = Counting(tmp_path), Execution(retries=0, replies=f"{tmp_path}/log")
    model.called(prompts(spark, NAMES), client, kept, as_json=False)
    log = ReplyLog(kept.replies)
    log.compact(spark)
    assert len(list((tmp_path / "log").glob("whole-*/*.parquet"))) == 1 and len(os.listdir(tmp_path / "log")) == 1
    assert not any(r.sent for r in model.called(prompts(spark, NAMES), client, kept, as_json=False).collect()) and client.sent() == NAMES


@pytest.mark.parametrize("limit, least", [(2, 2), (4, 3), (9, 5)])
def test_calls_in_flight_stay_within_the_limit(spark, tmp_path, limit, least):
    """Under four slots two calls are two tasks; nine are two in each of the tasks that run at once."""
    client = Counting(tmp_path, slow=0.1)
    out = model.run(prompts(spark, [f"q{k:03}" for k in range(64)]).repartition(16), client, retries=0, max_concurrency=limit)
    assert out.filter("success").count() == 64
    assert least <= client.most() <= limit


def test_windows(spark):
    assert model.windows(spark, None) == (1, None) and model.windows(spark, 3) == (1, 3)
    window, tasks = model.windows(spark, 20)
    assert window == 20 // spark.sparkContext.defaultParallelism and tasks >= spark.sparkContext.defaultParallelism


def test_rows_keep_their_replies_in_a_window(spark):
    class Late:
        def complete(self, messages):
            time.sleep(int(messages[-1]["content"]) % 3 / 100)
            return model.Reply(messages[-1]["content"])

    out = model.run(spark.range(50).select(F.lit("s").alias("system"), F.col("id").cast("string").alias("prompt")), Late(), max_concurrency=20)
    assert out.filter("response <> prompt OR NOT success").count() == 0
