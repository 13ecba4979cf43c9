"""How far calls are, while they run: counted by the tasks, told to the driver as each task ends."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.accumulators import Accumulator
from pyspark.sql import SparkSession

#: What is called with how many calls are done, how many of these failed, and how many there are (None if that isn't known).
OnProgress = Callable[[int, int, int | None], None]


@dataclass
class Counters:
    """Calls done and failed. Tasks that run again count again, so these are for watching, not for results."""

    done: Accumulator
    failed: Accumulator


@contextmanager
def watched(spark: SparkSession, on_progress: OnProgress, total: int | None = None, poll_s: float = 0.2) -> Iterator[Counters]:
    """Counters for what runs inside; ``on_progress`` is called from a thread of its own whenever they have changed, and once at the end. An error in it ends the telling, not the run."""
    context = spark.sparkContext
    counters, over, last = Counters(context.accumulator(0), context.accumulator(0)), threading.Event(), [-1]

    def tell() -> None:
        done = counters.done.value if total is None else min(counters.done.value, total)
        if done != last[0]:
            last[0] = done
            on_progress(done, min(counters.failed.value, done), total)

    def watch() -> None:
        while not over.wait(poll_s):
            tell()

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield counters
    finally:
        over.set()
        thread.join()
    tell()
