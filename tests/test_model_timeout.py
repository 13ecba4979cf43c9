import time

from quirework.operators import model


class Slow:
    def complete(self, messages):
        time.sleep(4 if messages[1]["content"] == "slow" else 0)
        return model.Reply("done", 1)


def test_a_slow_call_is_ended(spark):
    df = spark.createDataFrame([("s", "slow"), ("s", "fast")], "system string, prompt string").coalesce(1)
    got = {r.prompt: r for r in model.run(df, Slow(), retries=0, timeout_ms=500).collect()}
    assert got["fast"].success and got["fast"].response == "done"
    assert not got["slow"].success and "500 ms" in got["slow"].error and got["slow"].duration_ms < 3000
