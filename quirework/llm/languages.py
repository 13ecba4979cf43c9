"""Language of texts by a bidirectional gated recurrent network over bytes.

The network is trained here in numpy by backpropagation through time, on windows of a bounded sample, and
labels every byte position of whole texts; a document's probabilities are the mean over its letters' positions. Long texts are read in windows that
overlap, and a position counts in the one where it has 32 bytes of its text or more on either side: by then the states have forgotten where they began.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textops import begin, chunks, release
from .toxicity import held_out

#: Bounds of the training sample: documents of a language and of all, windows of a document, bytes of a text.
TRAIN_DOCS, TRAIN_ALL, TRAIN_WINDOWS, TRAIN_TEXT_BYTES = 300, 6000, 8, 60_000
#: Languages that are learnt, the most frequent ones.
MAX_LANGUAGES = 1000
STEPS, BATCH, RATE = 350, 256, 0.02
UNITS = 8
#: Bytes of a training window, of a window of a text, and on either side that count in the window before or after.
TRAIN_WINDOW, WINDOW, CONTEXT = 64, 256, 32
#: Windows that are run at once.
LANES = 512
UNDETERMINED = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class BiGRU:
    """Both directions as one state of 2 * UNITS, with block-diagonal recurrences. Gates in order: update, reset, candidate."""

    names: list[str]
    ahead: np.ndarray  # 256 x 6 units: input of the byte to the forward half
    back: np.ndarray
    gates: np.ndarray  # 2 units x 4 units
    cand: np.ndarray  # 2 units x 2 units
    out: np.ndarray  # 2 units x languages
    bias: np.ndarray

    @classmethod
    def start(cls, names: list[str], rng: np.random.Generator) -> BiGRU:
        n = UNITS
        half = np.concatenate([np.ones(n), np.zeros(n)])
        own = np.tile(half, 3)
        block = np.outer(half, half) + np.outer(1 - half, 1 - half)
        draw = lambda *shape, scale: rng.normal(0, scale, shape)
        m = cls(names, draw(256, 6 * n, scale=0.3) * own, draw(256, 6 * n, scale=0.3) * (1 - own), draw(2 * n, 4 * n, scale=0.3) * np.tile(block, 2), draw(2 * n, 2 * n, scale=0.3) * block, draw(2 * n, len(names), scale=0.3), np.zeros(len(names)))
        m.masks = [own, 1 - own, np.tile(block, 2), block, 1.0, 1.0]
        for k in ("ahead", "back", "gates", "cand", "out", "bias"):
            setattr(m, k, getattr(m, k).astype(np.float32))
        return m

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States by step of byte windows x (steps x lanes): forward half at step t, backward half at the mirrored step."""
        steps, lanes = x.shape
        n = UNITS
        h = np.zeros((lanes, 2 * n), np.float32)
        all_ = np.empty((steps, lanes, 2 * n), np.float32)
        for t in range(steps):
            a = self.ahead[x[t]] + self.back[x[steps - 1 - t]]
            zr = _sigmoid(a[:, : 4 * n] + h @ self.gates)
            z, r = zr[:, : 2 * n], zr[:, 2 * n :]
            rh = r * h
            c = np.tanh(a[:, 4 * n :] + rh @ self.cand)
            if keep is not None:
                keep.append((h, z, r, rh, c))
            h = h + z * (c - h)
            all_[t] = h
        return all_

    @staticmethod
    def by_position(states: np.ndarray) -> np.ndarray:
        return np.concatenate([states[:, :, :UNITS], states[::-1, :, UNITS:]], axis=2)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """steps x lanes x languages."""
        s = self.by_position(self.states(x)) @ self.out + self.bias
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        return s / s.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss over the letters' positions and its gradients, by backpropagation through all steps."""
        steps, lanes = x.shape
        n, keep = UNITS, []
        feats = self.by_position(self.states(x, keep))
        s = feats @ self.out + self.bias
        s -= s.max(axis=2, keepdims=True)
        p = np.exp(s)
        p /= p.sum(axis=2, keepdims=True)
        use = _LETTER[x]
        total = max(1, use.sum())
        loss = -np.log(np.take_along_axis(p, np.broadcast_to(y[None, :, None], (steps, lanes, 1)), 2)[..., 0] + 1e-9)[use].sum() / total
        d = p
        np.put_along_axis(d, np.broadcast_to(y[None, :, None], (steps, lanes, 1)), np.take_along_axis(d, np.broadcast_to(y[None, :, None], (steps, lanes, 1)), 2) - 1, 2)
        d = d * (use[:, :, None] / np.float32(total))
        flat, df = d.reshape(-1, d.shape[2]), d @ self.out.T
        g_out, g_bias = feats.reshape(-1, 2 * n).T @ flat, flat.sum(axis=0)
        dh_at = np.concatenate([df[:, :, :n], df[::-1, :, n:]], axis=2)
        g_gates, g_cand = np.zeros_like(self.gates), np.zeros_like(self.cand)
        da = np.empty((steps, lanes, 6 * n), np.float32)
        dh = np.zeros((lanes, 2 * n), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, rh, c = keep[t]
            dh = dh + dh_at[t]
            dz = dh * (c - h) * z * (1 - z)
            dc = dh * z * (1 - c * c)
            drh = dc @ self.cand.T
            dzr = np.concatenate([dz, drh * h * r * (1 - r)], axis=1)
            g_gates += h.T @ dzr
            g_cand += rh.T @ dc
            da[t, :, : 4 * n], da[t, :, 4 * n :] = dzr, dc
            dh = dh * (1 - z) + drh * r + dzr @ self.gates.T
        one = np.zeros((x.size, 256), np.float32)
        one[np.arange(x.size), x.ravel()] = 1
        g_ahead = one.T @ da.reshape(-1, 6 * n)
        g_back = one.T @ da[::-1].reshape(-1, 6 * n)
        return float(loss), [g_ahead, g_back, g_gates, g_cand, g_out, g_bias]


def windows(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte windows (windows x ``window``) that cover all documents, their documents, and which positions count.

    Windows overlap by twice ``context``, whose halves count in one window each. A document's last window ends at its end; one shorter than a window is filled with spaces.
    """
    size, stride = np.diff(offsets), window - 2 * context
    number = np.where(size > window, 1 + -(-(size - window) // stride), np.minimum(size, 1))
    doc = np.repeat(np.arange(len(size)), number)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    start = np.minimum(rank * stride, np.maximum(size[doc] - window, 0))
    at = start[:, None] + np.arange(window)
    inside = at < size[doc][:, None]
    lo = np.where(rank > 0, rank * stride + context, 0)
    hi = np.where(rank + 1 < number[doc], (rank + 1) * stride + context, size[doc])
    counts = (at >= lo[:, None]) & (at < hi[:, None])
    x = np.where(inside, data[np.minimum(at + offsets[doc][:, None], max(0, len(data) - 1))], 32) if len(doc) else np.zeros((0, window), np.uint8)
    return x.astype(np.uint8), doc, counts & _LETTER[x] if len(doc) else counts


def fit(texts: list[str], langs: list[str], seed: int = 0) -> BiGRU:
    """A network trained by Adam on windows drawn from the texts, as many for each language."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    model = BiGRU.start(names, rng)
    if len(names) < 2:
        return model
    by: list[list[np.ndarray]] = [[] for _ in names]
    for text, lang in zip(texts, langs):
        raw = np.frombuffer(text.encode(), np.uint8)
        x, _, counts = windows(raw, np.array([0, len(raw)]), TRAIN_WINDOW, 0)
        x = x[counts.any(axis=1)]
        by[names.index(lang)].append(x[rng.permutation(len(x))[:TRAIN_WINDOWS]])
    pools = [np.concatenate(b) for b in by]
    known = [k for k, pool in enumerate(pools) if len(pool)]
    fields = ("ahead", "back", "gates", "cand", "out", "bias")
    mean, square = [np.zeros_like(getattr(model, k)) for k in fields], [np.zeros_like(getattr(model, k)) for k in fields]
    for step in range(1, STEPS + 1):
        y = np.array(known)[rng.integers(0, len(known), BATCH)]
        x = np.stack([pools[k][rng.integers(len(pools[k]))] for k in y])
        # Windows of short documents: some of the batch is cut and filled with spaces.
        cut = rng.integers(8, TRAIN_WINDOW, BATCH)
        x = np.where((np.arange(TRAIN_WINDOW)[None, :] < cut[:, None]) | (rng.random(BATCH) < 0.85)[:, None], x, 32)
        _, grads = model.gradients(np.ascontiguousarray(x.T), y)
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, g, m, v, mask in zip(fields, grads, mean, square, model.masks):
            g = np.clip(g * mask, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            setattr(model, k, (getattr(model, k) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
    return model


def training_sample(docs: DataFrame, folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[str]]:
    """Texts and languages of a bounded sample by hash of the id, outside the held-out fold.

    One pass counts the languages, and one takes of each the documents with the least hashes, out of those whose
    hash is so small that about three times as many as are wanted come forward: no language is sorted whole.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.filter("doc_id IS NOT NULL AND lang IS NOT NULL").filter(~held_out("doc_id", folds, fold)).filter(F.octet_length("text").between(1, TRAIN_TEXT_BYTES))
    found = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not found:
        return [], []
    each = min(TRAIN_DOCS, max(1, TRAIN_ALL // len(found)))
    # Bounded by MAX_LANGUAGES.
    share = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, min(1.0, (3 * each + 30) / r.n)) for r in found], "lang string, share double"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    near = own.withColumn("h", place).join(share, "lang").filter("h < share").dropDuplicates(["doc_id", "lang"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    rows = near.withColumn("rank", rank).filter(F.col("rank") <= each).select("doc_id", "text", "lang").collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang))
    return [r.text for r in rows], [r.lang for r in rows]


def _predict(model: BiGRU):
    def run(batches):
        begin("languages")
        names = np.array(model.names)
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1), 1 << 18):
                x, doc, counts = windows(data, offsets)
                total = np.zeros((j - i, len(names)))
                for k in range(0, len(x), LANES):
                    p = model.probabilities(np.ascontiguousarray(x[k : k + LANES].T))
                    sums = np.einsum("tbl,bt->bl", p, counts[k : k + LANES].astype(np.float32))
                    for c in range(len(names)):
                        total[:, c] += np.bincount(doc[k : k + LANES], sums[:, c], j - i)
                every = total.sum(axis=1, keepdims=True)
                share = np.divide(total, every, out=np.zeros_like(total), where=every > 0)
                best = share.argmax(axis=1)
                score = np.clip(share[np.arange(j - i), best], 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(names[best]), pa.array(score)], ["doc_id", "letters", "lang", "score"])
        release()

    return run


def identify_languages(docs: DataFrame, model: BiGRU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (mean probability of that language over the letters' positions).

    A text in a language that wasn't learned (none of its documents is labelled, or MAX_LANGUAGES others are more frequent) gets the learned one it is most like, mostly with a low score.
    A null text and one without a letter is ``und`` with score 1; so is every text if no language was learned. A text of any length is read whole. Repeated rows give
    repeated results, ids may be null, other columns are ignored; an empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if not model.names:
        return own.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(1.0).alias("score"))
    out = own.mapInArrow(_predict(model), "doc_id long, letters boolean, lang string, score double")
    return out.select("doc_id", F.when(F.col("letters"), F.col("lang")).otherwise(UNDETERMINED).alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(1.0).alias("score"))
