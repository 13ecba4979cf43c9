"""Toxic spans by a linear-chain conditional random field over tokens.

Labelled documents give labelled tokens: in the training sample, words and word beginnings that are found almost only
in toxic documents mark the tokens of those documents. The field is fitted to these tokens (words, beginnings, endings and neighbours as hashed
features; transitions), so it generalises to inflected forms. Forward-backward marginals give spans, and
their sum and maximum give the document's score through a logistic calibration on the same sample's document labels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import _KEEP, _LOWER, begin, byte_hashes, chunks, eights, mix64, release, spans_of

#: Bounds of the training sample: documents of each class, and bytes of a text.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_TEXT_BYTES = 1500, 5000, 60_000
#: Sequences of the sample that the field is fitted to.
TRAIN_SEQUENCES = 6000
SEQUENCE = 64
BUCKETS = 1 << 17
SEED_BUCKETS = 1 << 22
PREFIXES = (3, 4, 5, 6, 7)
#: A word or beginning marks tokens if so large a part of the documents that hold it is toxic, and so many that chance would not do it.
#: No share of all toxic documents is asked for: the words of a rare language are in few of them.
SEED_PRECISION, SEED_CHANCE = 0.97, 1e-7

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``fold``; false without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def token_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of tokens, first token of each document, and a row of feature keys per token: word, ending, beginnings.

    A beginning as long as the word or longer is the key 0, which has no weight.
    """
    starts, ends, first = spans_of(data, offsets, _BETWEEN)
    low = _LOWER[data]
    view, size = eights(low), ends - starts
    keys = np.zeros((2 + len(PREFIXES), len(starts)), np.uint64)
    keys[0] = byte_hashes(low, starts, ends, view)
    # Up to seven bytes are a number; the eighth says what they are.
    tail = np.minimum(size, 3)
    keys[1] = mix64((view[ends - tail] & _KEEP[tail]) | (tail.astype(np.uint64) + np.uint64(16)) << np.uint64(56))
    for k, n in enumerate(PREFIXES):
        keys[2 + k] = np.where(size > n, mix64((view[starts] & _KEEP[n]) | np.uint64(n << 56)), 0)
    return starts, ends, first, keys


def _slots(keys: np.ndarray) -> np.ndarray:
    return np.where(keys == 0, 0, (keys >> np.uint64(20)) % np.uint64(BUCKETS - 1) + np.uint64(1)).astype(np.int64)


def _padded(values: np.ndarray, first: np.ndarray, fill=0.0) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all documents as columns of sequences of SEQUENCE steps, and each token's place in it."""
    count = np.diff(first)
    rows = -(-count // SEQUENCE)
    begin = np.concatenate(([0], np.cumsum(rows)))
    within = np.arange(first[-1]) - np.repeat(first[:-1], count)
    place = np.repeat(begin[:-1] * SEQUENCE, count) + within
    out = np.full(begin[-1] * SEQUENCE, fill)
    out[place] = values
    return out.reshape(-1, SEQUENCE), place


@dataclass
class Field:
    """Weights of label 1 against label 0. ``trans[i, j]``: from label i to j."""

    word: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    before: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    after: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    bias: float = -3.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Logistic weights of (1, log(1 + sum of marginals), greatest marginal).
    score: np.ndarray = field(default_factory=lambda: np.array([-6.0, 0.0, 0.0]))

    def emissions(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        e = self.bias + self.word[slots].sum(axis=0)
        n = len(e)
        if n > 1:
            inner = np.ones(n + 1, bool)
            inner[first] = False
            inner = inner[1:n]
            e[1:] += np.where(inner, self.before[slots[0, :-1]], 0)
            e[:-1] += np.where(inner, self.after[slots[0, 1:]], 0)
        return e

    def passes(self, e: np.ndarray, real: np.ndarray, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log-ratios of label 1 to 0: forward with the own emission, backward without. Padding is neutral.

        A row is a chain of its own, or ``blocks`` says how many rows in order make one chain; all but a chain's last are full.
        """
        t = np.exp(self.trans)
        enter, leave, inner = self.seams(e, real, blocks, t) if blocks is not None and blocks.max(initial=0) > 1 else (0.0, 0.0, False)
        step = lambda r: np.log((t[0, 1] + t[1, 1] * r) / (t[0, 0] + t[1, 0] * r))
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0] + np.where(inner, step(np.exp(np.clip(enter, -30, 30))), 0)
        for k in range(1, e.shape[1]):
            f[:, k] = e[:, k] + step(np.exp(np.clip(f[:, k - 1], -30, 30)))
        b[:, -1] = leave
        for k in range(e.shape[1] - 2, -1, -1):
            r = np.exp(np.clip(e[:, k + 1] + b[:, k + 1], -30, 30))
            b[:, k] = np.where(real[:, k + 1], np.log((t[1, 0] + t[1, 1] * r) / (t[0, 0] + t[0, 1] * r)), 0)
        return f, b

    @staticmethod
    def seams(e: np.ndarray, real: np.ndarray, blocks: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of chains cut into rows: forward log-ratio before it, backward log-ratio after it, and whether a row comes before.

        A row's steps are a product of 2 x 2 matrices, made for all rows at once; then chains of any length take one step a row.
        """
        n, steps = e.shape
        lead = np.concatenate(([0], np.cumsum(blocks)))[:-1]
        inner = np.ones(n, bool)
        inner[lead[blocks > 0]] = False
        enter, leave = np.zeros(n), np.zeros(n)
        rows = np.flatnonzero(inner)
        weight = np.exp(np.clip(e[rows], -30, 30))
        made = np.broadcast_to(np.eye(2), (len(rows), 2, 2)).copy()
        for k in range(steps):
            new = made @ t
            new[:, :, 1] *= weight[:, k, None]
            made = np.where(real[rows, k, None, None], new / new.max(axis=(1, 2), keepdims=True), made)
        at = np.cumsum(inner) - 1  # place of a row in ``made``
        chains = np.argsort(-blocks, kind="stable")
        chains = chains[blocks[chains] > 1]
        number, heads = blocks[chains], lead[chains]
        f = e[heads, 0]
        for k in range(1, steps):
            r = np.exp(np.clip(f, -30, 30))
            f = e[heads, k] + np.log((t[0, 1] + t[1, 1] * r) / (t[0, 0] + t[1, 0] * r))
        ahead, behind = np.stack([np.ones(len(f)), np.exp(np.clip(f, -30, 30))], 1), np.ones((len(f), 2))
        # Long chains come first, so those that have a row j are the first ones.
        live = [int(np.searchsorted(-number, -j, "left")) for j in range(int(number[0]))]
        for j in range(1, int(number[0])):
            own = heads[: live[j]] + j
            ahead = ahead[: live[j]]
            enter[own] = np.log(ahead[:, 1] / ahead[:, 0])
            ahead = np.einsum("mi,mij->mj", ahead, made[at[own]])
            ahead /= ahead.max(axis=1, keepdims=True)
        for j in range(int(number[0]) - 1, 0, -1):
            own = heads[: live[j]] + j
            back = np.einsum("mij,mj->mi", made[at[own]], behind[: live[j]])
            behind[: live[j]] = back / back.max(axis=1, keepdims=True)
            leave[own - 1] = np.log(behind[: live[j], 1] / behind[: live[j], 0])
        return enter, leave, inner

    def marginals(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each token; each document is one chain."""
        e = self.emissions(slots, first)
        if not len(e):
            return e
        grid, place = _padded(e, first)
        real = np.zeros(grid.size, bool)
        real[place] = True
        f, b = self.passes(grid, real.reshape(grid.shape), -(-np.diff(first) // SEQUENCE))
        return 1 / (1 + np.exp(-np.clip((f + b).ravel()[place], -30, 30)))

    @staticmethod
    def features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(p)))
        most = [p[a:b].max() if b > a else 0.0 for a, b in zip(first[:-1], first[1:])]
        return np.stack([np.ones(len(most)), np.log1p(total[first[1:]] - total[first[:-1]]), most], 1)

    def document_scores(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(p, first) @ self.score, -30, 30)))


def _seed_slots(keys: np.ndarray) -> np.ndarray:
    """Places of words and beginnings in the table of document counts; endings are too common to mark tokens."""
    marks = np.delete(keys, 1, axis=0)
    return np.where(marks == 0, 0, (marks >> np.uint64(20)) % np.uint64(SEED_BUCKETS - 1) + np.uint64(1)).astype(np.int64)


def _seeds(parts, toxic: np.ndarray) -> np.ndarray:
    """Which places are found almost only in toxic documents, from document counts by class in a table of fixed size."""
    counts, k = np.zeros((2, SEED_BUCKETS), np.int32), 0
    for _, _, first, keys in parts:
        places = _seed_slots(keys)
        for a, b in zip(first[:-1], first[1:]):
            counts[int(toxic[k]), np.unique(places[:, a:b])] += 1
            k += 1
    least = math.log(SEED_CHANCE) / math.log(toxic.mean())
    # Classes are sampled at different rates; rates are compared, not counts.
    ratio = toxic.sum() / max(1, (~toxic).sum())
    found = np.zeros(SEED_BUCKETS, bool)
    often = np.flatnonzero(counts[1] >= least)
    found[often] = counts[1, often] >= SEED_PRECISION * (counts[1, often] + counts[0, often] * ratio)
    found[0] = False
    return found


def _training_sequences(parts, toxic: np.ndarray, seeds: np.ndarray, share: float, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Tokens of sequences with a mark and of a share of the others, TRAIN_SEQUENCES at most: slots, neighbours, place in the grid, label."""
    kept: dict[str, list] = {k: [] for k in ("own", "before", "after", "row", "step", "y")}
    place_of, doc = np.zeros(0), 0

    def thin(most: int) -> None:
        """Keeps the sequences with the least random numbers."""
        if np.isfinite(place_of).sum() <= most:
            return
        place_of[place_of > np.partition(place_of, most - 1)[most - 1]] = np.inf
        for i, rows in enumerate(kept["row"]):
            stay = np.isfinite(place_of[rows])
            for k in kept:
                kept[k][i] = kept[k][i][..., stay]

    for _, _, first, keys in parts:
        n, count = keys.shape[1], np.diff(first)
        y = seeds[_seed_slots(keys)].any(axis=0) & np.repeat(toxic[doc : doc + len(count)], count)
        doc += len(count)
        if not n:
            continue
        grid, place = _padded(y.astype(float), first)
        chosen = (grid.sum(axis=1) > 0) | (rng.random(len(grid)) < share)
        number = np.cumsum(chosen) - 1 + len(place_of)
        use = np.flatnonzero(chosen[place // SEQUENCE])
        slots = _slots(keys)
        inner = np.ones(n + 1, bool)
        inner[first] = False
        kept["own"].append(slots[:, use].astype(np.int32))
        kept["before"].append(np.where(inner[use], slots[0, np.maximum(use - 1, 0)], 0).astype(np.int32))
        kept["after"].append(np.where(inner[use + 1], slots[0, np.minimum(use + 1, n - 1)], 0).astype(np.int32))
        kept["row"].append(number[place[use] // SEQUENCE].astype(np.int32))
        kept["step"].append((place[use] % SEQUENCE).astype(np.int32))
        kept["y"].append(y[use])
        place_of = np.concatenate([place_of, rng.random(int(chosen.sum()))])
        if np.isfinite(place_of).sum() > 2 * TRAIN_SEQUENCES:
            thin(TRAIN_SEQUENCES)
    thin(TRAIN_SEQUENCES)
    out = {k: np.concatenate(v, axis=-1) if v else np.zeros(0, np.int32) for k, v in kept.items()}
    number = np.cumsum(np.isfinite(place_of)) - 1
    out["at"] = number[out.pop("row")] * SEQUENCE + out.pop("step") if len(number) else np.zeros(0, np.int64)
    out["rows"] = np.array(np.isfinite(place_of).sum())
    return out


def fit(texts: list[str], labels: list[int], steps: int = 40, rate: float = 0.3, seed: int = 0) -> Field:
    """A field from texts and document labels. Without both classes every document gets a low score.

    The texts are read three times in chunks: counts of seeds, sequences to fit, document features to calibrate. So memory is bounded by
    the number of sequences and the tables.
    """
    model, toxic = Field(), np.array(labels, bool)
    if not toxic.any() or toxic.all():
        return model
    column = pa.array(texts, pa.string())

    def parts():
        for _, _, data, offsets in chunks(column, 1 << 17):
            yield token_keys(data, offsets)

    rng = np.random.default_rng(seed)
    seeds = _seeds(parts(), toxic)
    # About a token in seven bytes, and as many unmarked sequences as half of those to fit.
    share = min(1.0, TRAIN_SEQUENCES / 2 / max(1, sum(map(len, texts)) / 7 / SEQUENCE))
    release()
    got = _training_sequences(parts(), toxic, seeds, share, rng)
    del seeds
    release()
    own, before, after, at, rows = got["own"], got["before"], got["after"], got["at"], int(got["rows"])
    if not rows:
        return model
    real = np.zeros(rows * SEQUENCE, bool)
    real[at] = True
    real = real.reshape(-1, SEQUENCE)
    target = np.zeros(real.size)
    target[at] = got["y"]
    target = target.reshape(real.shape)

    params = [model.word, model.before, model.after, np.array([model.bias]), model.trans]
    squares = [np.full_like(p, 1e-6) for p in params]
    both = real[:, :-1] & real[:, 1:]
    for _ in range(steps):
        word, prev, nxt, bias, trans = params
        model.trans = trans
        e = bias[0] + prev[before] + nxt[after]
        for k in range(len(own)):
            e += word[own[k]]
        full = np.zeros(real.size)
        full[at] = e
        full = full.reshape(real.shape)
        f, b = model.passes(full, real)
        p = 1 / (1 + np.exp(-np.clip(f + b, -30, 30)))
        gap = (target - p).ravel()[at] / rows
        grads = [np.zeros(BUCKETS) for _ in range(3)]
        for k in range(len(own)):
            grads[0] += np.bincount(own[k], gap, BUCKETS)
        grads[1] += np.bincount(before, gap, BUCKETS)
        grads[2] += np.bincount(after, gap, BUCKETS)
        for g, w in zip(grads, params):
            g -= 1e-5 * w
            g[0] = 0
        # Pairs of neighbouring labels: expected and marked.
        t, left, right = np.exp(trans), np.exp(np.clip(f[:, :-1], -30, 30)), np.exp(np.clip((full + b)[:, 1:], -30, 30))
        joint = np.stack([np.full_like(left, t[0, 0]), t[0, 1] * right, t[1, 0] * left, t[1, 1] * left * right])
        joint = (joint / joint.sum(axis=0) * both).sum(axis=(1, 2))
        u, v = target[:, :-1][both], target[:, 1:][both]
        seen = np.array([((1 - u) * (1 - v)).sum(), ((1 - u) * v).sum(), (u * (1 - v)).sum(), (u * v).sum()])
        grads += [np.array([gap.sum()]), ((seen - joint) / rows).reshape(2, 2) - 1e-3 * trans]
        for p_, g, s in zip(params, grads, squares):
            s += g * g
            p_ += rate * g / np.sqrt(s)
    model.word, model.before, model.after, bias, model.trans = params
    model.bias = float(bias[0])

    x = np.concatenate([model.features(model.marginals(_slots(keys), first), first) for _, _, first, keys in parts()])
    w = np.zeros(3)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([1e-3, 1e-2, 1e-2])
        w += np.linalg.solve((x * (q * (1 - q) + 1e-9)[:, None]).T @ x + ridge, x.T @ (toxic - q) - ridge @ w)
    model.score = w
    release()
    return model


def training_sample(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[int]]:
    """Texts and labels of a bounded sample by hash of the id, outside the held-out fold. A document with several labels is toxic if one says so."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    known = known.filter(~held_out("doc_id", folds, fold)).groupBy("doc_id").agg(F.max("y").alias("y"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    usable = own.filter(F.octet_length("text").between(1, TRAIN_TEXT_BYTES))
    ids = known.join(usable.select("doc_id").distinct(), "doc_id").withColumn("h", F.xxhash64("doc_id"))
    picked: dict[int, int] = {}
    for y, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)):
        picked |= {r.doc_id: r.y for r in ids.filter(F.col("y") == y).orderBy("h").limit(n).collect()}
    if not picked:
        return [], []
    # At most TRAIN_TOXIC and TRAIN_CLEAN ids; of texts that share one the first, the same on every run.
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in picked], "doc_id long"))
    rows = dict(usable.join(wanted, "doc_id").groupBy("doc_id").agg(F.min("text")).toLocalIterator())
    order = sorted(rows)
    return [rows[i] for i in order], [picked[i] for i in order]


def _score(model: Field):
    def run(batches):
        begin("toxicity")
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, offsets in chunks(batch.column(1)):
                starts, ends, first, keys = token_keys(data, offsets)
                p = model.marginals(_slots(keys), first)
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                hits = np.flatnonzero(p >= 0.5)
                doc = np.searchsorted(first, hits, "right") - 1
                base = chars[offsets[:-1]]
                at = pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32))
                span = pa.StructArray.from_arrays(
                    [pa.array((chars[starts[hits]] - base[doc]).astype(np.int32)), pa.array((chars[ends[hits]] - base[doc]).astype(np.int32)), pa.array(p[hits])], ["begin", "end", "marginal"]
                )
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(model.document_scores(p, first)), pa.ListArray.from_arrays(at, span)], ["doc_id", "score", "spans"])
        release()

    return run


def score_toxicity(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), spans (begin, end in code points, marginal) of tokens likelier toxic than not.

    A null, empty or white text has no tokens: the calibration's least score, no spans. Repeated rows give repeated results,
    ids may be null, other columns are ignored; an empty table gives an empty result.
    A text of any length is one chain: its marginals are those of all its tokens together.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_score(model), "doc_id long, score double, spans array<struct<begin:int,end:int,marginal:double>>")


def _flag(model: Field, text_at: int):
    def run(batches):
        begin("toxicity")
        for batch in batches:
            scores = []
            for _, _, data, offsets in chunks(batch.column(text_at)):
                _, _, first, keys = token_keys(data, offsets)
                scores.append(model.document_scores(model.marginals(_slots(keys), first), first))
            keep = np.concatenate(scores) < 0.5 if scores else np.zeros(0, bool)
            yield batch.filter(pa.array(keep))
        release()

    return run


def keep_clean(docs: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under 0.5: one pass, no join. A null text is an empty one."""
    return docs.mapInArrow(_flag(model, docs.columns.index(text_col)), docs.schema)
