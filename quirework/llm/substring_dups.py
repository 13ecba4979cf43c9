"""Removal of passages that an earlier document holds, with a count-min prefilter.

A window is 50 consecutive words. The least hash of the 16-word grams in a window is its anchor; windows
in a row with one anchor form a run, so a text has about one run for 18 words. Equal windows
have equal anchors. Each partition counts its anchors in a sparse count-min sketch (two rows of cells, as wide as
the corpus needs), partial sums are merged by cell, and the lesser of an anchor's two
cells overestimates the documents that hold any of its windows: runs under two are done. The second pass
is exact: runs are grouped by their whole word sequence, which settles windows of copies in one row
a run, and only anchors with several different runs are grouped window by window. Word sequences are told apart by
128 bits of BLAKE2b over the words themselves, so nothing is cut because of hashes that meet by structure or chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import Scratch
from .textops import begin, chunks, digests, release, windows_of, words_of

WINDOW_WORDS = 50
ANCHOR_WORDS = 16
#: Cells for each run in a row of the sketch.
CELLS_PER_RUN = 16
#: Ids of documents are broadcast up to this many (16 MB), and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, span = values, 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[:-step], out[step:])
        span += step
    return out


def _runs(size: int, gram: int):
    def of_chunk(words):
        count = np.diff(words.first)
        usable = np.maximum(count - size + 1, 0)
        if not usable.sum():
            return None
        anchors = _least(windows_of(words.hashes, gram), size - gram + 1)
        doc = np.repeat(np.arange(len(count)), usable)
        start = np.arange(len(doc)) + np.repeat(words.first[:-1] - np.concatenate(([0], np.cumsum(usable)[:-1])), usable)
        own = anchors[start]
        new = np.ones(len(doc), bool)
        new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        lo = start[at]
        hi = np.append(start[at[1:] - 1], start[-1]) + 1
        keys = digests(words, lo, hi + size - 1)
        base = words.first[:-1][doc[at]]
        return doc[at], lo - base, hi - base, own[at], keys

    def run(batches):
        begin("substrings")
        for batch in batches:
            for i, _, data, offsets in chunks(batch.column(2)):
                if (found := of_chunk(words_of(data, offsets))) is None:
                    continue
                doc, lo, hi, anchor, key = found
                rows = pa.array(doc + i)
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), lo.astype(np.int32), hi.astype(np.int32), anchor.view(np.int64), key[:, 0], key[:, 1]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", "seq", "lo", "hi", "anchor", "key1", "key2"])
        release()

    return run


def _window_keys(size: int):
    """Digest of each window of the runs listed with a text."""

    def run(batches):
        begin("substrings")
        for batch in batches:
            ids, seqs, spans = batch.column(0), batch.column(1), batch.column(3)
            for i, j, data, offsets in chunks(batch.column(2)):
                words = words_of(data, offsets)
                rows, starts = [], []
                for k in range(j - i):
                    at = np.unique(np.concatenate([np.arange(s["lo"], s["hi"]) for s in spans[i + k].as_py()]))
                    rows.append(np.full(len(at), k))
                    starts.append(at)
                rows, starts = np.concatenate(rows), np.concatenate(starts)
                lo = words.first[rows] + starts
                keys, rows = digests(words, lo, lo + size), pa.array(rows + i)
                yield pa.RecordBatch.from_arrays([ids.take(rows), seqs.take(rows), pa.array(starts.astype(np.int32)), pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["doc_id", "seq", "lo", "key1", "key2"])
        release()

    return run


def _cut(size: int, text_at: int, spans_at: int):
    """Texts without the words of the windows listed with them, and both word counts."""

    def one(data, starts, ends, spans):
        n = len(starts)
        mark = np.zeros(n + 1, np.int32)
        lo = np.array([s["lo"] for s in spans])
        hi = np.minimum(np.array([s["hi"] for s in spans]) + size - 1, n)
        np.add.at(mark, lo, 1)
        np.add.at(mark, hi, -1)
        gone = np.cumsum(mark[:-1]) > 0
        until = np.append(starts[1:], len(data))
        edge = np.zeros(len(data) + 1, np.int32)
        edge[starts[gone]] += 1
        np.add.at(edge, until[gone], -1)
        return data[np.cumsum(edge[:-1]) == 0].tobytes().decode(), int(gone.sum())

    def run(batches):
        begin("substrings")
        for batch in batches:
            texts, spans = batch.column(text_at), batch.column(spans_at)
            some = spans.is_valid().to_pylist()
            counts, removed, new = [], np.zeros(batch.num_rows, np.int64), {}
            for i, j, data, offsets in chunks(texts):
                words = words_of(data, offsets)
                counts.append(np.diff(words.first))
                for k in range(j - i):
                    if some[i + k]:
                        a, b = words.first[k], words.first[k + 1]
                        new[i + k], removed[i + k] = one(data[offsets[k] : offsets[k + 1]], words.starts[a:b] - offsets[k], words.ends[a:b] - offsets[k], spans[i + k].as_py())
            if new:
                place = np.arange(batch.num_rows)
                place[list(new)] = batch.num_rows + np.arange(len(new))
                texts = pa.concat_arrays([texts, pa.array(list(new.values()), texts.type)]).take(pa.array(place))
            columns = [texts if c == text_at else batch.column(c) for c in range(batch.num_columns) if c != spans_at]
            names = [n for c, n in enumerate(batch.schema.names) if c != spans_at]
            number = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(number), pa.array(removed)], [*names, "n_words", "n_removed"])
        release()

    return run


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = (), size: int = WINDOW_WORDS, gram: int = ANCHOR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text without repeats, the columns in ``keep``, n_words, n_removed.

    Words are runs of characters other than ASCII white space, unchanged. A word goes if a window that covers it has the
    word sequence of a window in a document with a smaller id; windows are judged on the input.
    White space goes with the word before it; a text that loses nothing stays as it is.
    A null text has no words and stays null, an empty one and one under ``size`` words lose nothing. Rows that share an id don't affect each
    other. Rows without an id keep all words and serve for no other row. A text of any length is read whole. Other columns are ignored, whatever their names;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    names = {f"k{i}": c for i, c in enumerate(keep)}
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("seq"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(k) for k, c in names.items()])
    texts = own.select("doc_id", "seq", "text").filter("doc_id IS NOT NULL")
    runs = scratch.save(texts.mapInArrow(_runs(size, gram), "doc_id long, seq long, lo int, hi int, anchor long, key1 long, key2 long"))

    width = 1 << max(16, (CELLS_PER_RUN * runs.count()).bit_length())
    cell = [F.pmod(F.xxhash64("anchor", F.lit(r)), F.lit(width)) * 2 + r for r in (0, 1)]
    sketch = runs.select(F.explode(F.array(*cell)).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    hot = scratch.save(sketch.filter("n >= 2").select("cell"))
    likely = runs.withColumn("cell", cell[0]).join(hot, "cell", "left_semi").withColumn("cell", cell[1]).join(hot, "cell", "left_semi").drop("cell")
    likely = scratch.save(likely)
    scratch.drop(runs, hot)

    key = ["key1", "key2"]
    classes = scratch.save(likely.groupBy("anchor", *key).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    several = scratch.save(classes.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor"))
    whole = likely.join(classes.filter("n > 1").select("anchor", *key, "least"), ["anchor", *key]).filter("doc_id > least").select("doc_id", "seq", "lo", "hi")

    first = likely.join(classes.select("anchor", *key, "least"), ["anchor", *key]).filter("doc_id = least").select("doc_id", "seq", "lo", "hi", "anchor")
    first = first.join(several, "anchor", "left_semi").groupBy("doc_id", "seq").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    first = scratch.save(first)
    ids = first.select("doc_id").distinct()
    held = texts.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= BROADCAST_IDS else texts
    # Rows that repeat an id and text give their windows again, which changes neither the least nor what is cut.
    windows = scratch.save(held.join(first, ["doc_id", "seq"]).select("doc_id", "seq", "text", "spans").mapInArrow(_window_keys(size), "doc_id long, seq long, lo int, key1 long, key2 long"))
    shared = scratch.save(windows.groupBy(*key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select(*key, "least"))
    single = windows.join(shared, key).filter("doc_id > least").select("doc_id", "seq", "lo", (F.col("lo") + 1).alias("hi"))
    # Lists are bounded by a document's own windows.
    spans = scratch.save(whole.union(single).groupBy("doc_id", "seq").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    scratch.drop(likely, classes, several, first, windows, shared)

    cols = ["doc_id", "text", *names]
    none = F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("spans")
    ids = spans.select("doc_id").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
        hit = own.join(ids, "doc_id", "left_semi").join(spans, ["doc_id", "seq"], "left").select(*cols, "spans")
        joined = own.join(ids, "doc_id", "left_anti").select(*cols, none).union(hit)
    else:
        joined = own.join(spans, ["doc_id", "seq"], "left").select(*cols, "spans")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in cols], "n_words long, n_removed long"])
    out = joined.mapInArrow(_cut(size, 1, len(cols)), schema)
    return out.select(F.col("doc_id"), F.col("text"), *[F.col(k).alias(c) for k, c in names.items()], "n_words", "n_removed")
