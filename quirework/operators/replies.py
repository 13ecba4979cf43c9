"""Replies of a model kept by prompt, so that a run that stopped goes on where it was: only prompts without a reply are sent.

Tasks write replies as they come, a few to a file; whole files alone are read, so a task, an executor or a run may be lost at any time.
"""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "prompt_key string, response string, tokens_used long, duration_ms long"


def prompt_key(client, as_json: bool) -> Column:
    """What a reply is kept under: the prompt, whether JSON is asked for, and the client's kind and model."""
    who = f"{type(client).__name__}|{getattr(client, 'model', '')}|{getattr(client, 'temperature', '')}|{as_json}"
    return F.sha2(F.concat(F.lit(who + "|"), F.coalesce(F.length("system"), F.lit(-1)).cast("string"), F.lit("|"), F.coalesce("system", F.lit("")), F.lit("|"), F.coalesce("prompt", F.lit(""))), 256)


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class ReplyLog:
    """A folder of replies that all executors reach. A file holds ``every`` replies, or those of ``seconds``, at most: so many a task that is lost may have to ask for again."""

    path: str
    every: int = 20
    seconds: float = 10.0

    def read(self, spark: SparkSession) -> DataFrame:
        """prompt_key, response, tokens_used, duration_ms: one reply a prompt."""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
        rows = spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)
        reply = F.min(F.struct("response", "tokens_used", "duration_ms")).alias("r")
        return rows.groupBy("prompt_key").agg(reply).select("prompt_key", "r.*")

    def compact(self, spark: SparkSession, files: int = 1) -> None:
        """Writes all replies into a few files; files that were read are deleted once the new ones are whole. Not while a run writes."""
        whole = f"{self.path.rstrip('/')}/whole-{uuid.uuid4().hex}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        system = hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        rows = self.read(spark)
        before = [s.getPath() for s in system.listStatus(hadoop(self.path))]
        # Written beside under a name that readers pass over, then renamed.
        hidden = f"{self.path.rstrip('/')}/_{uuid.uuid4().hex}"
        rows.repartition(files, "prompt_key").write.parquet(hidden)
        system.rename(hadoop(hidden), hadoop(whole))
        for old in before:
            system.delete(old, True)


@dataclass
class TaskLog:
    """A task's part of the log."""

    log: ReplyLog
    run: str
    held: list = field(default_factory=list)
    since: float = field(default_factory=time.monotonic)
    lock: threading.Lock = field(default_factory=threading.Lock)

    def __post_init__(self):
        context = TaskContext.get()
        self.store, top = _store(self.log.path)
        self.folder = f"{top.rstrip('/')}/{self.run}/{context.partitionId()}"
        self.known = self._before() if context.attemptNumber() else {}

    def _before(self) -> dict[str, tuple]:
        """What an attempt of this task that was lost has left."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        out = {}
        for info in self.store.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if info.base_name.endswith(".parquet") and not info.base_name.startswith("_"):
                with self.store.open_input_file(info.path) as f:
                    out |= {r["prompt_key"]: (r["response"], r["tokens_used"], r["duration_ms"], True, None) for r in pq.read_table(f).to_pylist()}
        return out

    def add(self, key: str, response: str, tokens: int, duration: int) -> None:
        with self.lock:
            self.held.append((key, response, tokens, duration))
            if len(self.held) >= self.log.every or time.monotonic() - self.since > self.log.seconds:
                self._write()

    def close(self) -> None:
        with self.lock:
            self._write()

    def _write(self) -> None:
        import pyarrow as pa
        import pyarrow.parquet as pq

        if self.held:
            self.store.create_dir(self.folder, recursive=True)
            name = f"{uuid.uuid4().hex}.parquet"
            table = pa.table([pa.array(c, k) for c, k in zip(zip(*self.held), (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["prompt_key", "response", "tokens_used", "duration_ms"])
            with self.store.open_output_stream(f"{self.folder}/_{name}") as f:
                pq.write_table(table, f)
            self.store.move(f"{self.folder}/_{name}", f"{self.folder}/{name}")
            self.held.clear()
        self.since = time.monotonic()
