"""Packing of tokenised documents into sequences: first-fit decreasing with a tournament tree.

Documents are dealt into randomised groups of about equal size by a hash of their place in the input's files; a group is packed by
one task on its own, so the memory a task needs doesn't grow with the corpus. In a group, whole
capacities are cut off long documents, what is left over is packed first-fit decreasing, and the gaps
that remain are filled by cutting pieces of the emptiest bins. The last bin is split into
sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import _LOWER, chunks, kept, release, spans_of
from .wordtable import WordTable, grown

CAPACITY = 2048
END_ID = 1
#: Bytes of text in a group, about.
GROUP_BYTES = 1 << 20
#: Words whose ids a worker remembers.
CACHE_WORDS = 1_500_000
#: Words that the tokenizer encodes at once: what it makes of a word is some hundred times as large.
ENCODE_WORDS = 2048
#: Groups after which a worker gives freed memory back.
RELEASE_GROUPS = 8

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True


class Tournament:
    """Leftmost bin with enough room: a tree of the greatest room below each node."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (max(n, 1) - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        found = k - self.leaves
        room[k] -= size
        k //= 2
        while k:
            top = max(room[2 * k], room[2 * k + 1])
            if room[k] == top:
                break
            room[k] = top
            k //= 2
        return found


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length); every sequence but the powers of two is full.

    Items of length 0 take no piece. Ties go by position.
    """
    full, rest = [], []
    for i, n in enumerate(lengths):
        whole = n // capacity * capacity
        full += [[(i, at, capacity)] for at in range(0, whole, capacity)]
        if n > whole:
            rest.append((i, whole, n - whole))
    rest.sort(key=lambda p: -p[2])
    tree, bins = Tournament(len(rest), capacity), []
    for piece in rest:
        b = tree.place(piece[2])
        if b == len(bins):
            bins.append([])
        bins[b].append(piece)
    filled = sorted(((sum(p[2] for p in b), b) for b in bins), key=lambda x: -x[0])
    lo, hi = 0, len(filled) - 1
    while lo < hi:
        used, own = filled[lo]
        have, donor = filled[hi]
        while used < capacity and donor:
            item, at, n = donor.pop()
            take = min(n, capacity - used)
            own.append((item, at, take))
            if take < n:
                donor.append((item, at + take, n - take))
            used, have = used + take, have - take
        filled[lo], filled[hi] = (used, own), (have, donor)
        if used == capacity:
            full.append(own)
            lo += 1
        if not donor:
            hi -= 1
    if lo == hi and filled[lo][1]:
        left, total = filled[lo][1][::-1], filled[lo][0]
        while total:
            want = 1 << (total.bit_length() - 1)
            total -= want
            part = []
            while want:
                item, at, n = left.pop()
                take = min(n, want)
                part.append((item, at, take))
                if take < n:
                    left.append((item, at + take, n - take))
                want -= take
            full.append(part)
    return full


class WordEncoder:
    """Ids of texts by a tokenizer that splits at white space: each distinct word is encoded once.

    ASCII letters are lower-cased and a closing run of .,;:!? after an ASCII letter or digit is cut off first, as
    the tokenizer does both itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # A task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.groups = 0
        self.clear()

    def clear(self) -> None:
        self.known = WordTable()
        self.begin, self.pool, self.n = np.zeros(1, np.int64), np.zeros(0, np.uint32), 0

    def remember(self, words: list[bytes]) -> None:
        codes, size = [], []
        for i in range(0, len(words), ENCODE_WORDS):
            part = [c.ids for c in self.tokenizer.encode_batch_fast([w.decode() for w in words[i : i + ENCODE_WORDS]], add_special_tokens=False)]
            size += map(len, part)
            codes.append(np.fromiter(chain.from_iterable(part), np.uint32))
        ends = self.begin[self.n] + np.cumsum(size)
        self.begin = grown(self.begin, self.n + len(size) + 1)
        self.begin[self.n + 1 : self.n + len(size) + 1] = ends
        self.pool = grown(self.pool, int(ends[-1]))
        self.pool[self.begin[self.n] : ends[-1]] = np.concatenate(codes)
        self.n += len(size)

    def units(self, data, offsets):
        s, e, first = spans_of(data, offsets)
        if not len(s):
            return s, e, first
        last = np.maximum.accumulate(np.where(_STOP[data], -1, np.arange(len(data))))[e - 1]
        cut = (last >= s) & (last < e - 1) & _ALNUM[data[np.maximum(last, 0)]]
        where = np.flatnonzero(cut)
        starts = np.insert(s, where + 1, last[where] + 1)
        ends = np.insert(e, where, last[where] + 1)
        before = np.concatenate(([0], np.cumsum(cut)))
        return starts, ends, first + before[first]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, each closed by END_ID, and where each document's ids start."""
        starts, ends, first = self.units(data, offsets)
        if self.known.n > CACHE_WORDS:
            self.clear()
        entry = self.known.lookup(_LOWER[data], starts, ends, self.remember)
        begin = self.begin[entry]
        n = self.begin[entry + 1] - begin
        out_at = np.concatenate(([0], np.cumsum(n)))
        ids = self.pool[np.arange(out_at[-1]) + np.repeat(begin - out_at[:-1], n)]
        bounds = out_at[first]
        return np.insert(ids, bounds[1:], END_ID), bounds + np.arange(len(bounds))


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer, which later packing tasks find as this one left it."""
    own = kept("packing")
    if path not in own:
        own[path] = WordEncoder(path)
    return own[path]


def _pack_group(path: str, capacity: int):
    def run(table):
        own, group = encoder(path), table.column("grp")[0].as_py()
        table = table.combine_chunks().sort_by([("deal", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        docs = table.column("doc_id").to_pylist()
        tokens = []
        for part in table.column("text").chunks:
            for _, _, data, offsets in chunks(part):
                ids, bounds = own.encode(data, offsets)
                tokens += [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        rows = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
        for k, sequence in enumerate(pack([len(t) for t in tokens], capacity)):
            offset = 0
            for item, at, n in sequence:
                for name, value in zip(rows, (docs[item], at, n, tokens[item][at : at + n].tobytes(), len(tokens[item]), (group << 32) + k, offset)):
                    rows[name].append(value)
                offset += n
        own.groups += 1
        if own.groups % RELEASE_GROUPS == 0:
            release()
        return pa.table([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in rows.items()], list(rows))

    return run


def _place(docs: DataFrame) -> Column | None:
    """Hash of a row's place in the files it is read from, the same on every run; None where there are no files."""
    try:
        at = docs.metadataColumn("_metadata")
        docs.select(at["row_index"])
    except AnalysisException:
        return None
    return F.xxhash64(at["file_path"], at["row_index"])


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (packed little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its tokenizer's ids and then id 1; a null, empty or white text is that id alone, a text of any length is packed whole. Each id lies in one
    piece. Repeated rows and rows with one id, or with none, are documents of their own. Other columns are ignored; an empty table
    gives an empty result. A sequence is full unless its length is a power of two.
    Rows are dealt into groups, and ordered there, by a hash of their place in the files: copies of a document come apart. Rows of a
    table that isn't read from files are dealt by id and text, so repeated rows meet in one group.
    """
    place = _place(docs)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (F.lit(0) if place is None else place).alias("place"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    groups = size // GROUP_BYTES + 1
    key = F.col("place") if place is not None else F.xxhash64("doc_id", "text")
    dealt = own.select("doc_id", "text", F.xxhash64(F.lit(seed), key).alias("deal")).withColumn("grp", F.pmod("deal", F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(_pack_group(tokenizer_path, capacity), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
