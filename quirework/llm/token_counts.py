"""Token counts by a unigram model: dynamic programming over a trie of pre-tokens.

A pre-token is a word with the mark U+2581 before it. Pre-tokens are inserted into a trie whose nodes are
prefixes, all new ones of a chunk together and letter by letter; the best score of a prefix, and the tokens of that segmentation, are computed once when its node is made, from its
ancestors' scores, and serve every pre-token that begins with it. Pieces that end at a node are found by a walk
up the trie along a trie of the reversed vocabulary. Terminal nodes store the counts. Each worker keeps a
trie of bounded size for the texts it reads, so nothing is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import chunks, kept, release, spans_of
from .wordtable import NumberTable, WordTable, grown

MARK = "▁"
#: Nodes and words after which a worker starts a new trie.
MAX_NODES = 2_000_000
#: Longer pre-tokens are scored on their own by the same recurrence, not stored.
MAX_WORD_CHARS = 256
#: Bytes of text whose words are looked up together.
CHUNK_BYTES = 1 << 21


class Unigram:
    """Pieces with scores, and the recurrence. A character without a piece counts as its UTF-8 bytes' pieces.

    A piece of rank r in the vocabulary scores -log(r + 1), by Zipf's law, as the public file holds ranks rather
    than probabilities; ``scores`` gives other values. The best segmentation has the greatest sum; of equal ones, that with the
    shortest last piece wins.
    """

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte_score = scores, byte_score
        self.longest = max(map(len, scores), default=1)

    @classmethod
    def load(cls, path: str) -> Unigram:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ranks = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
        scores = {p.id_to_piece(i): -math.log(r + 2) for r, i in enumerate(ranks)}
        return cls(scores, -math.log(len(ranks) + 2))

    def steps(self, word: str, best: list[float], count: list[int]) -> None:
        """Extends ``best`` and ``count``, which hold the prefixes so far, over the rest of ``word``."""
        scores, longest = self.scores, self.longest
        for end in range(len(best), len(word) + 1):
            char = word[end - 1]
            if char in scores:
                top, n = best[end - 1] + scores[char], count[end - 1] + 1
            else:
                size = len(char.encode())
                top, n = best[end - 1] + size * self.byte_score, count[end - 1] + size
            for begin in range(end - 2, max(-1, end - longest - 1), -1):
                s = scores.get(word[begin:end])
                if s is not None and best[begin] + s > top:
                    top, n = best[begin] + s, count[begin] + 1
            best.append(top)
            count.append(n)


class Endings:
    """The vocabulary as a trie of reversed pieces: state 0 is the empty ending."""

    def __init__(self, scores: dict[str, float]):
        down: dict[int, int] = {}
        value = [-math.inf]
        for piece, score in scores.items():
            state = 0
            for char in reversed(piece):
                key = (state + 1) << 21 | ord(char)
                if key not in down:
                    down[key] = len(value)
                    value.append(-math.inf)
                state = down[key]
            value[state] = score
        self.table = NumberTable(1 << (2 * len(down) + 2).bit_length(), spread=True)
        self.table.add(np.fromiter(down, np.uint64, len(down)), np.fromiter(down.values(), np.int64, len(down)))
        self.value = np.array(value)


class Trie:
    """Prefix nodes with forward scores. Node 0 is the empty prefix."""

    def __init__(self, model: Unigram):
        self.model, self.endings = model, Endings(model.scores)
        #: (node, character) -> node.
        self.down = NumberTable(spread=True)
        self.n = 1
        self.parent, self.char, self.count = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(1024, np.int64)
        self.best = np.zeros(1024)

    def _score(self, new: np.ndarray) -> None:
        """Best scores of new nodes, whose ancestors have theirs: over all pieces that end there, shortest first."""
        above, char = self.parent[new], self.char[new]
        size = np.select([char < 0x80, char < 0x800, char < 0x10000], [1, 2, 3], 4)
        state = self.endings.table.find((np.uint64(1) << np.uint64(21)) | char.astype(np.uint64))
        own = np.where(state >= 0, self.endings.value[state], -np.inf)
        piece = own > -np.inf
        top = self.best[above] + np.where(piece, own, size * self.model.byte_score)
        count = self.count[above] + np.where(piece, 1, size)
        at, node = np.flatnonzero((state >= 0) & (above != 0)), above
        while len(at):
            state[at] = self.endings.table.find((state[at] + 1).astype(np.uint64) << np.uint64(21) | self.char[node[at]].astype(np.uint64))
            at = at[state[at] >= 0]
            node[at] = self.parent[node[at]]
            score = self.best[node[at]] + self.endings.value[state[at]]
            better = score > top[at]
            top[at[better]], count[at[better]] = score[better], self.count[node[at[better]]] + 1
            at = at[node[at] != 0]
        self.best[new], self.count[new] = top, count

    def insert(self, words: list[str]) -> np.ndarray:
        """Node of each word; prefixes that were inserted before are not scored again."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        start = np.cumsum(size) - size
        node, live, at = np.zeros(len(words), np.int64), np.flatnonzero(size > 0), 0
        while len(live):
            keys = (node[live] + 1).astype(np.uint64) << np.uint64(21) | chars[start[live] + at].astype(np.uint64)
            found = self.down.find(keys)
            new = np.flatnonzero(found < 0)
            if len(new):
                fresh, group = np.unique(keys[new], return_inverse=True)
                made = self.n + np.arange(len(fresh))
                self.n += len(fresh)
                self.parent, self.char, self.best, self.count = (grown(a, self.n) for a in (self.parent, self.char, self.best, self.count))
                self.parent[made] = (fresh >> np.uint64(21)).astype(np.int64) - 1
                self.char[made] = (fresh & np.uint64((1 << 21) - 1)).astype(np.int64)
                self._score(made)
                self.down.add(fresh, made)
                found[new] = made[group]
            node[live] = found
            at += 1
            live = live[size[live] > at]
        return node


class Counter:
    """Counts and scores of words; a trie that is too large is begun anew."""

    def __init__(self, path: str):
        self.model = Unigram.load(path)
        self.reset()

    def reset(self) -> None:
        self.trie, self.known, self.n = Trie(self.model), WordTable(), 0
        self.tokens, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def learn(self, words: list[bytes]) -> None:
        texts = [MARK + w.decode() for w in words]
        short = [k for k, text in enumerate(texts) if len(text) <= MAX_WORD_CHARS]
        node = self.trie.insert([texts[k] for k in short])
        at = self.n + np.array(short, np.int64)
        self.n += len(texts)
        self.tokens, self.scores = grown(self.tokens, self.n), grown(self.scores, self.n)
        self.tokens[at], self.scores[at] = self.trie.count[node], self.trie.best[node]
        for k, text in enumerate(texts):
            if len(text) > MAX_WORD_CHARS:
                best, count = [0.0], [0]
                self.model.steps(text, best, count)
                self.tokens[self.n - len(texts) + k], self.scores[self.n - len(texts) + k] = count[-1], best[-1]

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entry of each word; words not met before go into the trie."""
        if self.trie.n > MAX_NODES:
            self.reset()
        return self.known.lookup(data, starts, ends, self.learn)


def _count(path: str):
    def run(batches):
        memory = kept("token-counts")
        if path not in memory:
            memory[path] = Counter(path)
        own = memory[path]
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, offsets in chunks(batch.column(1), CHUNK_BYTES):
                starts, ends, first = spans_of(data, offsets)
                slots = own.lookup(data, starts, ends)
                tokens = np.concatenate(([0], np.cumsum(own.tokens[slots])))
                scores = [float(own.scores[slots[a:b]].sum()) for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(np.diff(first)), pa.array(tokens[first[1:]] - tokens[first[:-1]]), pa.array(scores, pa.float64())], ["doc_id", "n_words", "n_tokens", "score"]
                )
        release()

    return run


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens, score (log-score of the best segmentation).

    A null, empty or white text has no words and 0 tokens; a text or word of any length is counted whole. Repeated rows give repeated results, ids may be null, other columns
    are ignored; an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_count(model_path), "doc_id long, n_words long, n_tokens long, score double")
