"""Periodic runs of words by Kolpakov and Kucherov: factors from a suffix automaton, Main's runs across their edges, the rest copied.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. A text's words that no repeated window
covers lie in no run that counts, so only the stretches between them are searched.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import Words, begin, chunks, mix64, release, windows_of, words_of

MIN_LENGTH, MIN_EXPONENT = 24, 3
#: One word out of a text's own alphabet, at the end of each stretch.
_END = -1


def factors(x: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, earlier start) of the factors of ``x``: each the longest that also begins earlier, or one new letter (earlier start -1).

    The suffix automaton keeps the single transition of a state in two arrays; only states that branch have a dictionary.
    """
    length, link, first, letter, target = array("q", [0]), array("q", [-1]), array("q", [-1]), array("q", [-2]), array("q", [-1])
    more: dict[int, dict[int, int]] = {}
    last = 0
    for i, c in enumerate(x):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        first.append(i)
        letter.append(-2)
        target.append(-1)
        p = last
        while p >= 0:
            if letter[p] == c:
                q = target[p]
                break
            if letter[p] == -2:
                letter[p], target[p] = c, new
            else:
                own = more.get(p)
                if own is None:
                    more[p] = {c: new}
                elif c in own:
                    q = own[c]
                    break
                else:
                    own[c] = new
            p = link[p]
        if p >= 0:
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                first.append(first[q])
                letter.append(letter[q])
                target.append(target[q])
                if q in more:
                    more[twin] = more[q].copy()
                while p >= 0:
                    if letter[p] == c:
                        if target[p] != q:
                            break
                        target[p] = twin
                    else:
                        own = more.get(p)
                        if own is None or own.get(c) != q:
                            break
                        own[c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new

    out, i, n = [], 0, len(x)
    while i < n:
        state, k, end = 0, i, -1
        while k < n:
            c = x[k]
            to = target[state] if letter[state] == c else more[state].get(c, -1) if state in more else -1
            # The factor so far ends first at first[to]; it must begin before i.
            if to < 0 or first[to] >= k:
                break
            state, end = to, first[to]
            k += 1
        if k == i:
            out.append((i, i + 1, -1))
            i += 1
        else:
            out.append((i, k, end - (k - i) + 1))
            i = k
    return out


def z_values(x: list[int]) -> list[int]:
    """How far ``x`` agrees with itself from each position on."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def _across(x: list[int], b: int, e: int, back: int, min_length: int, min_exponent: int, found: dict[tuple[int, int], int]) -> None:
    """Main's runs that cross or touch the left edge of the factor ``x[b:e]``, within ``back`` words before it, and end inside it.

    A period lies whole on one side of the edge; how far it goes on to either side is read from Z values of the factor and of the reversed words before it.
    """
    if back + e - b < min_length:
        return
    v, t = x[b:e], x[b - back : b]
    ahead = z_values([*v, _END - 1, *t, *v])
    rt = t[::-1]
    behind = z_values([*rt, _END - 1, *v[::-1], *rt])
    nv, nt = e - b, back
    base = nv + 1
    ahead_of, behind_of = np.array(ahead), np.array(behind)

    def keep(start: np.ndarray, stop: np.ndarray, p: np.ndarray) -> None:
        size = stop - start
        for k in np.flatnonzero((size >= min_length) & (size >= min_exponent * p)).tolist():
            lo, hi, q = int(start[k]), int(stop[k]), int(p[k])
            # What goes on beyond the factor is found at a later edge, what goes on before the words looked at was found at an earlier one.
            if hi < len(x) and x[hi] == x[hi - q] or lo and x[lo - 1] == x[lo - 1 + q]:
                continue
            found[lo, hi] = min(q, found.get((lo, hi), q))

    # Periods inside the factor: how far v[p:] agrees with v, and the words before b + p, backwards, with those before b.
    p = np.arange(1, nv + 1)
    right = np.append(ahead_of[1:nv], 0)
    left = np.minimum(behind_of[nt + 1 + nv - p], nt)
    keep(b - left, b + p + right, p)
    # Periods before it: how far the words from b - p on agree with v, and the words before b - p, backwards, with those before b.
    if nt:
        p = np.arange(1, nt + 1)
        right = np.minimum(ahead_of[base + nt - p], nv)
        left = np.append(behind_of[1:nt], 0)
        keep(b - p - left, b + right, p)


def find_runs(x: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the letters ``x`` (0 and up) with at least so many letters and periods, by start, then period."""
    x = [*x, _END]
    parts = factors(x)
    found: dict[tuple[int, int], int] = {}
    before = 0
    for b, e, _ in parts:
        _across(x, b, e, min(b, 2 * before + e - b), min_length, min_exponent, found)
        before = e - b
    at: dict[int, list[tuple[int, int]]] = {}
    for (s, t), q in sorted(found.items()):
        at.setdefault(s, []).append((t, q))
    if at:
        # A run inside a factor, its edges apart, lies in the factor's earlier place too; places are gone through in order, as a factor may lie over its own source.
        for b, e, source in parts:
            if source < 0:
                continue
            shift, stop = b - source, e
            for s in range(source + 1, e - shift):
                for t, q in at.get(s, ()):
                    if t + shift < stop:
                        own = at.setdefault(s + shift, [])
                        if (t + shift, q) not in own:
                            own.append((t + shift, q))
    return sorted((s, t - s, q) for s, ends in at.items() for t, q in ends)


def _stretches(hashes: np.ndarray, first: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(document, first word, end word) of the maximal stretches whose words are all covered by windows that occur twice or more in their document."""
    keys = windows_of(hashes, window)
    if not len(keys):
        return []
    doc = np.searchsorted(first, np.arange(len(keys)), "right") - 1
    own = np.arange(len(keys)) + window <= first[doc + 1]
    keys = mix64(keys ^ mix64(doc.astype(np.uint64) + np.uint64(1)))
    place = np.flatnonzero(own)
    order = place[np.argsort(keys[place], kind="stable")]
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = order[twice]
    mark = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + window, -1)
    covered = np.cumsum(mark[:-1]) > 0
    edge = np.zeros(len(hashes) + 1, bool)
    edge[first] = True
    starts = np.flatnonzero(covered & (np.append(True, ~covered[:-1]) | edge[:-1]))
    ends = np.flatnonzero(covered & (np.append(~covered[1:], True) | edge[1:])) + 1
    return list(zip((np.searchsorted(first, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist()))


def _kept_texts(words: Words, keep: np.ndarray) -> list[str]:
    """Each document's words that stay, joined by one space: their bytes and the first one after each, which becomes a space."""
    last = np.zeros(len(keep), bool)
    last[words.first[1:][np.diff(words.first) > 0] - 1] = True
    data, until = words.data.copy(), words.ends + ~last
    data[words.ends[~last]] = 32
    edge = np.zeros(len(data) + 1, np.int8)
    edge[words.starts[keep]] += 1
    edge[until[keep]] -= 1
    out = data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    at = np.concatenate(([0], np.cumsum(np.where(keep, until - words.starts, 0))))[words.first]
    return [out[a:b].tobytes().decode().removesuffix(" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _search(min_length: int, min_exponent: int):
    # A run of n words with period q has n - q >= n (1 - 1 / exponent) words that come again q words later: windows of half as many as that cover it all.
    window = max(1, min_length * (min_exponent - 1) // min_exponent // 2)

    def run(batches):
        begin("runs")
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(0)):
                words = words_of(data, offsets)
                runs: list[list[tuple[int, int, int]]] = [[] for _ in range(j - i)]
                for d, a, b in _stretches(words.hashes, words.first, window):
                    if b - a < min_length:
                        continue
                    _, letters = np.unique(words.hashes[a:b], return_inverse=True)
                    shift = a - int(words.first[d])
                    runs[d] += [(s + shift, n, q) for s, n, q in find_runs(letters.tolist(), min_length, min_exponent)]
                gone = np.zeros(len(words.starts) + 1, np.int32)
                for d, own in enumerate(runs):
                    for s, n, q in own:
                        gone[words.first[d] + s + q] += 1
                        gone[words.first[d] + s + n] -= 1
                texts = _kept_texts(words, np.cumsum(gone[:-1]) == 0)
                own = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
                rest = [c.slice(i, j - i) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(words.first)), own, pa.array(texts, pa.string())], [*batch.schema.names[1:], "n_words", "runs", "collapsed"])
        release()

    return run


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns in ``keep``, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are runs of characters other than ASCII white space, unchanged, numbered from 0. A run counts from ``min_length`` words and ``min_exponent`` (2 or more) periods on.
    ``collapsed`` joins by one space the words that stay when each run keeps only its first period; runs that overlap each drop theirs.
    A null, empty or white text has no words and no runs, and an empty ``collapsed``. A text of any length is searched whole. Rows are independent of each other: repeats give repeated results, ids may be
    null, other columns are ignored, whatever their names; ``keep`` can't name the result's columns. An empty table gives an empty result.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two periods at least")
    own = docs.select(F.col(text_col).cast("string").alias("r_text"), F.col(id_col).cast("long").alias("doc_id"), *[F.col(c) for c in keep])
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields[1:])
    return own.mapInArrow(_search(min_length, min_exponent), kept + "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest_by_exponent(runs: Column) -> Column:
    """The run with the greatest length/period, compared exactly; ties go to the smaller start, then period (the order of ``runs``). Null without runs."""
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, 0), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plants runs to be found: in a tenth of the documents (by a checksum of the id) the words from some place on repeat the first few of them.

    With h = crc32(id), g = h div 10 and h mod 10 = 0 each of the n words from a = g mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    own = docs.withColumns({"r_g": F.when(h % 10 == 0, F.floor(h / 10).cast("long")), "r_words": F.when(h % 10 == 0, words)})
    n = F.size("r_words")
    a = (F.col("r_g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("r_g") % 8))).cast("int")
    own = own.withColumns({"r_a": F.when(n > 0, a), "r_p": F.when(n > 0, p)})
    planted = F.transform("r_words", lambda w, i: F.when(i < F.col("r_a"), w).otherwise(F.get("r_words", F.col("r_a") + (i - F.col("r_a")) % F.col("r_p"))))
    return own.withColumn(text_col, F.when(F.col("r_p").isNotNull(), F.array_join(planted, " ")).otherwise(F.col(text_col))).drop("r_g", "r_words", "r_a", "r_p")
