"""Documents whose pages arrive in any order: each comes out once its pages are whole, as what batch operators take."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a row is: a page of a whole document; of one that was waited for long enough; one that came after its document had come out, or twice, or under a number the document hasn't.
WHOLE, PARTIAL, LATE, REPEATED, STRAY = "whole", "partial", "late", "repeated", "stray"


class _Pages(StatefulProcessor):
    """Pages of a document until they are whole; then only that it has come out, for a while."""

    def __init__(self, wait_ms: int, remember_ms: int):
        self.wait_ms, self.remember_ms = wait_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page_no int", "text string")
        self.facts = handle.getValueState("facts", "n int, held int, out boolean, timer long")

    def _set_timer(self, old: int | None, at: int) -> int:
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        return at

    def _all(self, key, kind: str) -> Iterator[Row]:
        for (page_no,), (text,) in sorted(self.pages.iterator(), key=lambda x: x[0][0]):
            yield Row(doc_id=key[0], page_no=page_no, text=text, kind=kind)
        self.pages.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        n, held, out, timer = self.facts.get() or (None, 0, False, None)
        for r in rows:
            n = r.page_count if n is None else n
            kind = STRAY if r.page_no is None or r.page_no < 1 or n is not None and r.page_no > n else LATE if out else REPEATED if self.pages.containsKey((r.page_no,)) else None
            if kind:
                yield Row(doc_id=key[0], page_no=r.page_no, text=r.text, kind=kind)
                continue
            self.pages.updateValue((r.page_no,), (r.text,))
            held += 1
            if held == n:
                yield from self._all(key, WHOLE)
                out, timer = True, self._set_timer(timer, now + self.remember_ms)
        if not out:
            # Waited for from the last page on.
            timer = self._set_timer(timer, now + self.wait_ms)
        self.facts.update((n, held, out, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, held, out, _ = self.facts.get()
        if out:
            self.facts.clear()
            return
        yield from self._all(key, PARTIAL)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.remember_ms
        self.handle.registerTimer(timer)
        self.facts.update((n, held, True, timer))


def whole_documents(pages: DataFrame, wait_ms: int = 3_600_000, remember_ms: int = 3_600_000) -> DataFrame:
    """doc_id, page_no, text, kind of streamed pages (doc_id, page_no, page_count, text).

    All pages of a document come out together, in the micro-batch in which the last of them arrives, as ``whole``; so what is done by document needs no state of its own after it. A document that
    gets no page for ``wait_ms`` comes out as far as it is, as ``partial``. Of a page that arrives twice the first counts; it and pages that come after their document, or under a number
    it hasn't, are rows of their own kind. A document's pages are dropped when it comes out, and that it has is forgotten after ``remember_ms``: then its pages would begin anew.
    The first page_count that is known holds; until one is, the document waits. Pages without a document are stray only by their number: they wait as one document.
    Uses the RocksDB state store, which the session is set to. Start it with a processing-time trigger: timers keep a stream going that is to end by itself.
    """
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    own = pages.select("doc_id", F.col("page_no").cast("int").alias("page_no"), F.col("page_count").cast("int").alias("page_count"), F.col("text").cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.groupBy("doc_id").transformWithState(_Pages(wait_ms, remember_ms), f"doc_id {kind}, page_no int, text string, kind string", "Append", "ProcessingTime")


def for_whole_documents(arrived: DataFrame, work: Callable[[DataFrame], None], others: Callable[[DataFrame], None] | None = None) -> DataStreamWriter:
    """A writer that gives each micro-batch's whole documents, and partial ones, to ``work`` as pages (doc_id, page_no, text), and all other rows to ``others``: any operator of pages can be used there."""

    def batch(df: DataFrame, _: int) -> None:
        df = df.persist()
        try:
            work(df.filter(F.col("kind").isin(WHOLE, PARTIAL)).select("doc_id", "page_no", "text"))
            if others:
                others(df.filter(~F.col("kind").isin(WHOLE, PARTIAL)))
        finally:
            df.unpersist()

    return arrived.writeStream.foreachBatch(batch)
