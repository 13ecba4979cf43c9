"""Structured words, seams of long texts, repeated ids, and what tasks leave in a worker."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirework.llm import languages, near_dups, packing, substring_dups, textops, token_counts, toxicity, wordtable
from tests.llm.test_text_and_links import WORD, brute_near, brute_removed


def thue_morse(n: int, a: str, b: str) -> tuple[str, str]:
    """Two strings of ``n`` letters that every polynomial hash modulo a power of two confuses from some length on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(a if x == 0 else b for x in bits), "".join(b if x == 0 else a for x in bits)


LONG = [thue_morse(1024, "a", "b"), thue_morse(4096, "a", "b")]


@pytest.mark.parametrize("pair", LONG)
def test_thue_morse_words_and_sequences_differ(pair):
    words = textops.words_of(*textops.buffers(pa.array([" ".join(pair)])))
    assert words.hashes[0] != words.hashes[1]
    left, right = (textops.windows_of(np.array([ord(c) for c in x], np.uint64), len(x)) for x in pair)
    assert left[0] != right[0]


def test_hashes_by_length_and_place():
    """All prefixes, suffixes and zero paddings of a text have hashes of their own, across every eight-byte edge."""
    raw = np.frombuffer(bytes(80) + b"abcdefghij" * 12, np.uint8)
    starts, ends = zip(*[(0, n) for n in range(1, 200)] + [(n, 200) for n in range(81, 199)])
    got = textops.byte_hashes(raw, np.array(starts), np.array(ends))
    strings = [raw[a:b].tobytes() for a, b in zip(starts, ends)]
    assert len(set(got.tolist())) == len(set(strings))


def test_near_duplicates_of_thue_morse_words(spark):
    docs = [(10 * k + i, " ".join([w] + [f"x{j}" for j in range(3)])) for k, pair in enumerate(LONG) for i, w in enumerate(pair)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_near(docs)


def test_repeats_of_thue_morse_words(spark):
    """Documents that differ in words only that a polynomial hash confuses repeat nothing; nor do sequences of two words in that order."""
    docs = []
    for k, pair in enumerate(LONG):
        docs += [(10 * k + i, " ".join([w] + [f"x{k}{j}" for j in range(49)])) for i, w in enumerate(pair)]
    docs += [(50 + i, " ".join(x)) for i, x in enumerate(thue_morse(1024, "u", "v"))]
    want = brute_removed(docs, 50)
    for r in substring_dups.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        assert (r.n_words, r.n_removed, WORD.findall(r.text.encode())) == want[r.doc_id]


def test_ids_of_thue_morse_words(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    docs = [(10 * k + i, w + " and " + w) for k, pair in enumerate(LONG) for i, w in enumerate(pair)]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), path).collect()
    for i, text in docs:
        ids = b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start))
        assert np.frombuffer(ids, np.uint32).tolist() == plain.encode(text, add_special_tokens=False).ids + [1]


def test_counts_of_thue_morse_words(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = token_counts.Unigram.load(path)
    docs = [(10 * k + i, f"{w} {w[:200]} {w}") for k, pair in enumerate(LONG) for i, w in enumerate(pair)]
    rows = {r.doc_id: r for r in token_counts.count_tokens(spark.createDataFrame(docs, "doc_id long, text string"), path).collect()}
    for i, text in docs:
        total = 0
        for w in text.split():
            best, count = [0.0], [0]
            model.steps(token_counts.MARK + w, best, count)
            total += count[-1]
        assert rows[i].n_tokens == total


@pytest.mark.parametrize("bad", [False, True])
def test_word_table_is_exact(monkeypatch, bad):
    """Also if nearly all words share a hash."""
    if bad:
        monkeypatch.setattr(wordtable, "byte_hashes", lambda *a: textops.byte_hashes(*a) & np.uint64(6))
    rng, table, learnt = random.Random(1), wordtable.WordTable(16), []
    for _ in range(20):
        words = [bytes(rng.choices(b"abc", k=rng.choice([1, 2, 7, 8, 9, 16, 17, 64, 65, 90]))) for _ in range(100)]
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        got = table.lookup(np.frombuffer(b" ".join(words), np.uint8), ends - np.array([len(w) for w in words]), ends, learnt.extend)
        assert [learnt[k] for k in got] == words
    assert len(set(learnt)) == len(learnt) == table.n


def test_digests_are_of_the_words():
    texts = ["a  b\tc d", "\n", "b c d\n e"]
    words = textops.words_of(*textops.buffers(pa.array(texts)))
    got = textops.digests(words, np.array([0, 1, 4]), np.array([4, 4, 7]))
    assert got[1].tolist() == got[2].tolist() != got[0].tolist()
    assert got[0].tobytes() == hashlib.blake2b(b"a b c d", digest_size=16).digest()


def test_marginals_do_not_depend_on_the_cut(monkeypatch):
    """A document is one chain whatever the rows it is computed in."""
    rng = np.random.default_rng(0)
    model = toxicity.Field(trans=rng.normal(size=(2, 2)))
    for name in ("word", "before", "after"):
        setattr(model, name, rng.normal(size=toxicity.BUCKETS))
    first = np.concatenate(([0], np.cumsum([0, 1, 64, 65, 300, 0, 128, 129, 1000, 63])))
    slots = rng.integers(1, toxicity.BUCKETS, (7, first[-1]))
    got = model.marginals(slots, first)
    for cut in (7, 1024):
        monkeypatch.setattr(toxicity, "SEQUENCE", cut)
        assert np.allclose(model.marginals(slots, first), got, atol=1e-12)


def test_field_scores_match_enumeration():
    """Marginals and the document score of a short text, from the weights alone."""
    rng = np.random.default_rng(3)
    model = toxicity.Field(trans=rng.normal(size=(2, 2)), score=np.array([-1.0, 0.7, 1.3]))
    for name in ("word", "before", "after"):
        setattr(model, name, rng.normal(size=toxicity.BUCKETS))
    text = "One vilething, and Others"
    out = pa.Table.from_batches(toxicity._score(model)(pa.table({"doc_id": [1], "text": [text]}).to_batches()))
    _, _, first, keys = toxicity.token_keys(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    slots = toxicity._slots(keys)
    e = [model.bias + model.word[slots[:, k]].sum() + (model.before[slots[0, k - 1]] if k else 0) + (model.after[slots[0, k + 1]] if k < 3 else 0) for k in range(4)]
    weight, total = np.zeros(4), 0.0
    for k in range(16):
        y = [k >> i & 1 for i in range(4)]
        w = np.exp(sum(a * b for a, b in zip(e, y)) + sum(model.trans[y[i], y[i + 1]] for i in range(3)))
        total, weight = total + w, weight + w * np.array(y)
    p = weight / total
    score = 1 / (1 + np.exp(-(np.array([1, np.log1p(p.sum()), p.max()]) @ model.score)))
    assert np.isclose(out["score"][0].as_py(), score)
    want = [(a, b) for (a, b), x in zip([(0, 3), (4, 13), (15, 18), (19, 25)], p) if x >= 0.5]
    assert [(s["begin"], s["end"]) for s in out["spans"][0].as_py()] == want


def test_pooled_languages_match_one_long_run():
    """Probabilities pooled over overlapping windows against the network run over whole texts, and a plain recurrence."""
    rng = random.Random(2)
    forms = {"aa": "the and of ing tion er".split(), "bb": "der und sch keit ung ein".split()}
    make = lambda lang, n: " ".join("".join(rng.choices(forms[lang], k=rng.randint(1, 3))) for _ in range(n))
    model = languages.fit([make(k, 60) for k in forms for _ in range(30)], [k for k in forms for _ in range(30)])
    texts = [make("aa", 200), make("bb", 150), make("aa", 3), make("bb", 60) + " " + make("aa", 60)]
    got = pa.Table.from_batches(languages._predict(model)(pa.table({"doc_id": range(4), "text": texts, "letters": [True] * 4}).to_batches()))
    sig = lambda v: 1 / (1 + np.exp(-v))
    n = languages.UNITS

    def run(raw, weights, half):
        h, out = np.zeros(n), []
        pick = lambda m, k: m[half * n : half * n + n, k * 2 * n + half * n : k * 2 * n + half * n + n]
        for byte in raw:
            a = [weights[byte][k * 2 * n + half * n : k * 2 * n + half * n + n] for k in range(3)]
            z, r = sig(a[0] + h @ pick(model.gates, 0)), sig(a[1] + h @ pick(model.gates, 1))
            h = h + z * (np.tanh(a[2] + (r * h) @ pick(model.cand, 0)) - h)
            out.append(h)
        return np.array(out)

    for k, text in enumerate(texts):
        raw = text.encode().ljust(languages.WINDOW)
        states = np.concatenate([run(raw, model.ahead, 0), run(raw[::-1], model.back, 1)[::-1]], 1)
        s = states @ model.out + model.bias
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        pooled = p[[i for i, c in enumerate(text) if c.isalpha()]].mean(axis=0)
        assert got["lang"][k].as_py() == model.names[pooled.argmax()]
        assert abs(got["score"][k].as_py() - pooled.max()) < 2e-3


def test_language_sample_is_bounded(spark, monkeypatch):
    rows = [(i, f"text {i}", f"l{i % 40}") for i in range(2000)] + [(5000 + i, "more", "big") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(languages, "TRAIN_ALL", 200)
    texts, langs = languages.training_sample(docs)
    assert set(langs) == {r[2] for r in rows} and max(langs.count(x) for x in set(langs)) == 200 // 41
    monkeypatch.setattr(languages, "MAX_LANGUAGES", 3)
    assert len(set(languages.training_sample(docs)[1])) == 3


def test_near_duplicates_of_repeated_ids(spark):
    """A row is judged by its own text, whichever rows share its id."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(1, text("a")), (5, text("a")), (5, text("b")), (7, text("b")), (7, text("c")), (9, text("c")), (9, text("d"))]
    got = {(r.doc_id, r.seq): (r.component_id, r.kept) for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seq = {t: s for t, s in spark.createDataFrame(rows, "doc_id long, text string").select("text", F.xxhash64("text")).collect()}
    want = [(1, True), (1, False), (5, True), (5, False), (7, True), (7, False), (9, True)]
    assert [got[i, seq[t]] for i, t in rows] == want


@pytest.mark.parametrize("block", [5, 512])
def test_template_clusters_are_parted(spark, monkeypatch, block):
    """Documents that share most of a template, some of them also near-duplicates: same components however the clusters are cut."""
    rng = random.Random(4)
    template, docs = [f"t{i}" for i in range(70)], []
    for i in range(60):
        own = [f"d{i}x{j}" for j in range(30)]
        docs.append((2 * i, " ".join(template + own)))
        if i % 3 == 0:
            own[rng.randrange(30)] = "other"
            docs.append((2 * i + 1, " ".join(template + own)))
    monkeypatch.setattr(near_dups, "BLOCK", block)
    monkeypatch.setattr(near_dups, "BLOCK_SHINGLES", 500 if block == 5 else 1 << 20)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_near(docs)


def test_copies_are_dealt_apart(spark, tmp_path):
    """Rows read from files are dealt by their place there: copies of one document don't meet in one group."""
    path = f"file://{tmp_path}/copies"
    spark.createDataFrame([(7, "word " * 4000)] * 400, "doc_id long, text string").coalesce(1).write.parquet(path)
    rows = packing.pack_documents(spark.read.parquet(path), public_tokenizers.path("word_bpe_49k.json")).collect()
    groups = {}
    for r in rows:
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + (r.start == 0)
    assert sum(groups.values()) == 400 and len(groups) > 4 and max(groups.values()) < 150


def test_workers_forget_other_operators():
    textops._KEPT.clear()
    textops.kept("packing")["x"] = 1
    assert textops.kept("packing") == {"x": 1}
    textops.begin("toxicity")
    assert textops.kept("packing") == {}


def test_very_long_texts(spark):
    """One text of some MB beside short ones, through every operator that reads texts in Python."""
    rng = random.Random(9)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.randint(0, 99)) for _ in range(300_000))
    docs = spark.createDataFrame([(1, "short text"), (2, long), (3, long + " x"), (4, "y" * 1_000_000)], "doc_id long, text string")
    near = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 2, 3: 2, 4: 4}
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dups.remove_repeats(docs).collect()}
    assert cut == {1: (2, 0), 2: (300_000, 0), 3: (300_001, 300_000), 4: (1, 0)}
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert len(pieces) == 4 and all(r.n == r.t for r in pieces)
    counts = {r.doc_id: r.n_words for r in token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert counts == {1: 2, 2: 300_000, 3: 300_001, 4: 1}
    assert toxicity.score_toxicity(docs, toxicity.Field()).count() == 4
    model = languages.BiGRU.start(["a", "b"], np.random.default_rng(0))
    assert languages.identify_languages(docs, model).filter("score between 0 and 1").count() == 4


PIPELINE_ROWS = [(1, "A " * 60, "en", "s"), (1, "A " * 60, "en", "s"), (5, "A " * 60, "en", "s"), (5, " ".join(f"b{i}" for i in range(70)), None, None), (None, "no id", "en", "s"), (None, None, None, None), (6, None, "en", "s"), (7, "", "en", "s"), (8, " \n", "en", "s"), (9, "word " * 50_000, "en", "s")]


def test_pipeline_edge_rows(spark):
    import corpus_pipeline as c
    from tests.conftest import SF

    rows = [(i, t, lang, source, len(t or ""), "x", 1) for i, t, lang, source in PIPELINE_ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string, seq int")
    near = [(r.doc_id, r.text) for r in c.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(near, key=str) == sorted([(i, t) for i, t, _, _ in PIPELINE_ROWS if (i, (t or "")[:1]) != (5, "A")], key=str)
    for _, stage in c.STAGES[1:]:
        assert stage(spark, docs.limit(0), SF).count() == 0
    cut = c.cut_repeats(spark, docs, SF)
    assert cut.columns == c.COLUMNS and cut.count() == len(rows)
    mixed = c.mix(spark, docs, SF)
    assert mixed.columns == c.COLUMNS and {r.doc_id for r in mixed.collect()} <= {r[0] for r in rows}
    packed = c.pack(spark, docs, SF)
    assert packed.filter("start = 0").count() == len(rows)
    clean = c.drop_toxic(spark, docs, SF)
    assert clean.columns == c.COLUMNS and clean.count() == len(rows)
    assert c.drop_toxic(spark, docs.limit(0), SF).count() == 0
