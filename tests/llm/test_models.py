"""Toxicity, languages, licences, token counts, packing, mixing, fingerprints and vectors."""

import math
import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework.llm import fingerprints, languages, licences, mixing, packing, token_counts, toxicity, vector_dups

DOCS = [(0, "Hello there, stupid world. " * 3), (1, None), (2, ""), (3, " \n\t"), (4, "x" * 5000), (5, "Été à Paris 東京 ok"), (5, "Été à Paris 東京 ok"), (None, "no id here"), (None, None)]
SCHEMA = "doc_id long, text string, score string, spans int, ids int, p int, grp int, row string, source string, lang string, n_words int, mix_copy int"


def edge(spark, n=None):
    df = spark.createDataFrame([(*d, "s", 1, 2, 3, 4, "r", None if d[0] == 0 else "src", "en", 7, 9) for d in DOCS], SCHEMA)
    return df if n is None else df.limit(n)


def rows_of(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))


# Toxicity


def toy_texts(n=300, seed=1):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["vilething", "vileness", "horridly", "horridest"]))
        texts.append(" ".join(own) + ".")
        labels.append(int(bad))
    return texts, labels


@pytest.fixture(scope="module")
def field():
    return toxicity.fit(*toy_texts())


def test_field_finds_new_forms_and_spans(spark, field):
    df = spark.createDataFrame([(1, "word1 word2 é VILEST word3"), (2, "word1 word2 word3"), (3, "word4 vilething, word5 horridly")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, field).collect()}
    assert got[2].score < 0.5 < got[3].score
    text = "word4 vilething, word5 horridly"
    assert [text[s.begin : s.end] for s in got[3].spans] == ["vilething", "horridly"]


def test_held_out_accuracy(field):
    texts, labels = toy_texts(seed=2)
    out = pa.Table.from_batches(toxicity._score(field)(pa.table({"doc_id": range(len(texts)), "text": texts}).to_batches()))
    assert ((out["score"].to_numpy() >= 0.5) == np.array(labels)).mean() > 0.97


def test_marginals_match_enumeration():
    rng = np.random.default_rng(4)
    f = toxicity.Field(trans=rng.normal(size=(2, 2)))
    e = rng.normal(size=(1, 6))
    a, b = f.passes(e, np.ones(e.shape, bool))
    weight, total = np.zeros(6), 0.0
    for k in range(64):
        y = [k >> i & 1 for i in range(6)]
        w = math.exp(sum(e[0, i] * y[i] for i in range(6)) + sum(f.trans[y[i], y[i + 1]] for i in range(5)))
        total += w
        weight += w * np.array(y)
    assert np.allclose(1 / (1 + np.exp(-(a + b)[0])), weight / total)


def test_toxicity_edge_rows(spark, field):
    rows = rows_of(toxicity.score_toxicity(edge(spark), field))
    assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(edge(spark, 0), field).count() == 0
    assert toxicity.fit([], []).score[0] < 0 and toxicity.fit(["a"], [1]).score[0] < 0
    assert toxicity.keep_clean(edge(spark), field).count() == len(DOCS)


def test_training_rows_are_outside_the_fold(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    texts, ys = toxicity.training_sample(docs, labels)
    ids = [int(t.split()[1]) for t in texts]
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert dict(zip(ids, ys)) == {i: i % 2 for i in range(60) if zlib.crc32(str(i).encode()) % 5}
    assert toxicity.training_sample(docs.limit(0), labels) == ([], [])


def test_words_of_a_rare_language_are_learnt():
    """22 of 1500 toxic documents are in a language of its own: over the chance level, under 2% of all."""
    rng = random.Random(11)
    make = lambda lang, bad: " ".join(rng.sample([f"{lang}{i}" for i in range(40)], 6) + bad)
    texts = [make("en", ["vilething"]) for _ in range(1478)] + [make("qu", ["millaymuck"]) for _ in range(22)]
    texts += [make("en", []) for _ in range(4900)] + [make("qu", []) for _ in range(100)]
    model = toxicity.fit(texts, [1] * 1500 + [0] * 5000)
    new = [make("qu", ["millaymuck"]) for _ in range(20)] + [make("qu", []) for _ in range(20)]
    out = pa.Table.from_batches(toxicity._score(model)(pa.table({"doc_id": range(40), "text": new}).to_batches()))
    assert [s >= 0.5 for s in out["score"].to_pylist()] == [True] * 20 + [False] * 20
    assert all(t[s["begin"] : s["end"]] == "millaymuck" for t, spans in zip(new, out["spans"].to_pylist()) for s in spans)


def test_long_documents_are_trained_on(spark):
    docs = spark.createDataFrame([(i, "word " * 10_000) for i in (1, 2)], "doc_id long, text string")
    assert len(toxicity.training_sample(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"))[0]) == 2


# Languages


def test_windows_cover_each_byte_once():
    rng = random.Random(0)
    sizes = [0, 1, 63, 64, 255, 256, 257, 449, 700, 0, 448, 130]
    data = np.array([rng.choice(b"abc \n.") for _ in range(sum(sizes))], np.uint8)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    x, doc, counts = languages.windows(data, offsets)
    for k in range(len(sizes)):
        own = data[offsets[k] : offsets[k + 1]]
        assert counts[doc == k].sum() == languages._LETTER[own].sum()
        assert sorted(x[doc == k][counts[doc == k]].tolist()) == sorted(own[languages._LETTER[own]].tolist())


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    m = languages.BiGRU.start(["a", "b"], rng)
    fields = ("ahead", "back", "gates", "cand", "out", "bias")
    for k in fields:
        setattr(m, k, getattr(m, k).astype(float))
    x, y = rng.integers(97, 123, (7, 4)), np.array([0, 1, 1, 0])
    _, grads = m.gradients(x, y)
    for k, g in zip(fields, grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        a = getattr(m, k)
        old = a[at]
        a[at] = old + 1e-3
        up = m.gradients(x, y)[0]
        a[at] = old - 1e-3
        down = m.gradients(x, y)[0]
        a[at] = old
        assert abs(g[at] - (up - down) / 2e-3) < 1e-4 + 0.01 * abs(g[at])


def test_languages_held_out_and_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(languages, "STEPS", 120)
    rng = random.Random(3)
    forms = {"aa": "the and of ing tion er".split(), "bb": "der und sch keit ung ein".split()}
    make = lambda lang: " ".join("".join(rng.choices(forms[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(4, 60)))
    rows = [(i, make("aa" if i % 2 else "bb"), None if i % 7 == 0 else "aa" if i % 2 else "bb") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = languages.training_sample(docs)
    assert len(texts) == sum(1 for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 3 != 1)
    model = languages.fit(texts, langs)
    got = {r.doc_id: r.lang_pred for r in languages.identify_languages(docs, model).collect()}
    assert np.mean([got[i] == ("aa" if i % 2 else "bb") for i, _, _ in rows]) > 0.95
    out = rows_of(languages.identify_languages(edge(spark), model))
    assert len(out) == len(DOCS) and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {"und"}
    assert languages.identify_languages(edge(spark, 0), model).count() == 0
    assert {r.lang_pred for r in languages.identify_languages(edge(spark), languages.fit([], [])).collect()} == {"und"}


# Licences


def test_licences(spark):
    model = licences.fit()
    text = "Some prose here.\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0. And more words follow on."
    docs = [(1, text), (2, "no such talk"), (3, "This license is granted to the customer only, a licence of an unheard kind."), (4, "This work is licensed under the GNU General Public License, version 3."), (5, None), (6, ""), (4, "Licensed under CC BY-NC 4.0."), (None, "Released under the MIT License.")]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, family string, d string")
    got = {r.doc_id: r for r in licences.scan_licences(df, model).collect()}
    assert got[1].families == "Apache-2.0,MIT" and got[1].n_licence == 2 and got[1].n_paragraphs == 3
    assert (got[2].family, got[3].family, got[5].n_paragraphs, got[6].n_paragraphs) == ("none", "unknown", 0, 1)
    assert got[4].families == "CC-BY-NC,GPL" and got[None].family == "MIT"
    assert licences.scan_licences(df.limit(0), model).count() == 0


def test_wrapped_licences(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    cc = "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    domain = "We say that this work is in the public domain now."
    docs = []
    for width in (12, 20, 40, 50, 72, 1000):
        wrap = lambda t: "\n".join(textwrap.wrap(t, width))
        docs += [(len(docs), wrap(gpl)), (len(docs) + 1, wrap(cc)), (len(docs) + 2, wrap(domain)), (len(docs) + 3, "\n".join(" * " + x for x in wrap(gpl).split("\n"))), (len(docs) + 4, f"Prose.\n{wrap(gpl)}\n{wrap(cc)}\nMore prose.")]
    docs += [(100, "This work is licensed under a Creative Commons\n\nAttribution-ShareAlike 4.0 International License.")]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs[:-1]:
        want = [("GPL", 1), ("CC-BY-SA", 1), ("CC0", 1), ("GPL", 1), ("CC-BY-SA,GPL", 2)][i % 5]
        assert (got[i].families, got[i].n_licence) == want, text
    assert got[100].families == ""


def test_no_confirmable_paragraph_lacks_a_key():
    """Whatever part of a template's shingles confirms it, one of them holds a key word."""
    keys = licences.key_words()
    for line in [x for v in licences.TEMPLATES.values() for x in v]:
        grams = licences.template_grams(line)
        bare = [g for g in grams if not any(k in g for k in keys)]
        assert grams and len(bare) < licences.CONFIRM * len(grams), line


def test_short_notices(spark):
    want = {"Released under the GPL version 2.": "GPL", "CC BY 4.0": "CC-BY", "MIT License": "MIT", "Text: CC BY-SA 4.0.": "CC-BY-SA", "BSD 3-Clause License, released under the BSD 3-Clause license": "BSD", "a public account of the person": "none", "this copy of the source": "none"}
    got = {r.doc_id: r.family for r in licences.scan_licences(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def plain_scan(text, model):
    """(first line, family, probability, template score, confirmed) of the paragraphs of a text, from the definition."""
    find = [*licences.STEMS, *licences.key_words()]
    lines = (text or "").split("\n")
    found = []
    for i in range(len(lines)):
        inner = 0
        for j in range(i, len(lines)):
            if not licences._tokens(lines[j]) or j > i and (inner > licences.INNER or j - i > licences.INNER + 1):
                break
            if j > i:
                inner += len(licences._tokens(lines[j]))
            words = [licences._tokens(x) for x in lines[i : j + 1]]
            broken = [bool(re.search(r"[A-Za-z0-9]-\s*$", x)) for x in lines[i : j + 1]]
            if j > i:
                words[0], words[-1] = words[0][-licences.INNER :], words[-1][: licences.INNER]
            # A word that a line breaks after its hyphen goes on in the next.
            words = "".join(" ".join(w) + ("-" if b else " ") for w, b in zip(words, broken)).rstrip(" -").split()
            if not any(k in " ".join(words) for k in find):
                continue
            grams = licences._grams(words) & set(model.weights)
            if not grams:
                continue
            z = np.array(model.bias) + sum(np.array(model.weights[g]) for g in grams)
            z = z / model.temperature
            p = np.exp(z - z.max())
            family = model.classes[int(z.argmax())]
            hits, score = 0, 0.0
            if family in licences.TEMPLATES:
                of = [(len(set(t) & grams), len(t)) for t in map(licences.template_grams, licences.TEMPLATES[family])]
                hits, score = max((n if n >= licences.CONFIRM * m else 0, n / m) for n, m in of)
            if family != "none" and (hits or i == j):
                found.append((hits, j - i, -p.max() / p.sum(), i, j, family, score))
    taken = []
    for u in sorted((u for u in found if u[0]), key=lambda u: (-u[0], *u[1:5])):
        if not any(t[3] <= u[4] and u[3] <= t[4] for t in taken):
            taken.append(u)
    taken += [u for u in found if not u[0] and not any(t[3] <= u[4] and u[3] <= t[4] for t in taken)]
    return sorted((u[3], u[5] if u[0] else "unknown", round(-u[2], 6), round(u[6], 6), u[0] > 0) for u in taken)


def test_paragraphs_by_definition(spark):
    rng, model = random.Random(3), licences.fit()
    every = [x for v in licences.TEMPLATES.values() for x in v] + licences.UNKNOWN
    prose = lambda: " ".join(rng.choice([*licences.FILL, "person", "house", "river", "public"]) for _ in range(rng.randint(1, 14)))
    docs = []
    for i in range(120):
        parts = [prose() for _ in range(rng.randint(0, 3))]
        for _ in range(rng.randint(0, 2)):
            words = [w for w in rng.choice(every).title().split() if rng.random() > 0.08]
            parts.insert(rng.randint(0, len(parts)), "\n".join(textwrap.wrap(" ".join(words), rng.choice((15, 30, 400)))) + rng.choice((".", "", "\n")))
        docs.append((i, "\n".join(parts)))
    got: dict = {}
    for r in licences.scan_paragraphs(spark.createDataFrame(docs, "doc_id long, text string"), model).collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.family, round(r.probability, 6), round(r.template_score, 6), r.confirmed))
    assert sum(r[4] for rows in got.values() for r in rows) > 60
    for i, text in docs:
        assert sorted(got.get(i, [])) == plain_scan(text, model), text


# Token counts


def brute_count(word, scores, byte):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        c = word[end - 1]
        n = 1 if c in scores else len(c.encode())
        top = (best[end - 1][0] + (scores[c] if c in scores else n * byte), best[end - 1][1] + n)
        for begin in range(end - 2, -1, -1):
            s = scores.get(word[begin:end])
            if s is not None and best[begin][0] + s > top[0]:
                top = (best[begin][0] + s, best[begin][1] + 1)
        best.append(top)
    return best[-1]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="abcé", min_size=1, max_size=9), max_size=30))
def test_trie_matches_plain_recurrence(words):
    scores = {"a": -1.0, "b": -1.5, "ab": -1.8, "abc": -2.0, "ca": -0.7, "bca": -2.6, "éa": -1.1}
    trie = token_counts.Trie(token_counts.Unigram(scores, -4.0))
    for w, node in zip(words, [*trie.insert(words[:7]), *trie.insert(words[7:])]):
        want = brute_count(w, scores, -4.0)
        assert math.isclose(trie.best[node], want[0]) and trie.count[node] == want[1]
    assert trie.n == 1 + len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_token_counts(spark, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = token_counts.Unigram.load(path)
    want = lambda t: sum(brute_count("▁" + w, model.scores, model.byte_score)[1] for w in (t or "").split())
    for nodes in (10, 10**6):
        monkeypatch.setattr(token_counts, "MAX_NODES", nodes)
        rows = rows_of(token_counts.count_tokens(edge(spark), path))
        assert [r.n_tokens for r in rows][:7] == [want(t) for _, t in DOCS][:7]
    assert token_counts.count_tokens(edge(spark, 0), path).count() == 0


# Packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=40))
def test_pack(lengths):
    sequences = packing.pack(lengths, 16)
    pieces = sorted(p for s in sequences for p in s)
    for i, n in enumerate(lengths):
        own = [p for p in pieces if p[0] == i]
        assert sum(p[2] for p in own) == n and all(p[1] == q[1] + q[2] for q, p in zip(own, own[1:])) and (not own or own[0][1] == 0)
    for s in sequences:
        n = sum(p[2] for p in s)
        assert n == 16 or n & (n - 1) == 0 and n < 16


def test_tournament_is_first_fit():
    rng = random.Random(2)
    sizes = [rng.randint(1, 10) for _ in range(50)]
    tree, room = packing.Tournament(50, 10), [10] * 50
    for n in sizes:
        k = next(i for i in range(50) if room[i] >= n)
        room[k] -= n
        assert tree.place(n) == k


def test_packed_ids_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = packing.pack_documents(edge(spark), path, 64).collect()
    want = sorted(plain.encode(t or "", add_special_tokens=False).ids + [1] for _, t in DOCS)
    assert sum(r.length for r in rows) == sum(map(len, want))
    single = [r for r in rows if r.doc_id not in (5, None)]
    for i, text in DOCS[:5]:
        own = sorted((r for r in single if r.doc_id == i), key=lambda r: r.start)
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in own), np.uint32).tolist()
        assert ids == plain.encode(text or "", add_special_tokens=False).ids + [1] and own[0].doc_tokens == len(ids)
    by: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert all(n == 64 or n & (n - 1) == 0 for n in by.values())
    assert packing.pack_documents(edge(spark, 0), path).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aB'sS .,;!?é3İ̇ﬁ東-­   \n", max_size=25), min_size=1, max_size=4))
def test_word_encoder_matches_the_tokenizer(texts):
    own = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    for i, j, data, offsets in packing.chunks(pa.array(texts)):
        ids, at = own.encode(data, offsets)
        for k in range(j - i):
            assert ids[at[k] : at[k + 1]].tolist() == own.tokenizer.encode(texts[i + k], add_special_tokens=False).ids + [1]


# Mixing


@pytest.mark.parametrize("rate", [0.0, 0.1, 1.0, 3.5, 40.0])
def test_poisson_inverse(spark, rate):
    us = [0.0, 1e-9, 0.1, 0.5, 0.9, 0.999999, 1 - 2**-52]
    got = spark.createDataFrame([(u, rate) for u in us], "u double, r double").select(mixing.poisson(F.col("u"), F.col("r")).alias("n")).collect()
    for u, row in zip(us, got):
        p = c = math.exp(-rate)
        k = 0
        while c <= u and k < 400:
            k += 1
            p *= rate / k
            c += p
            if p < 1e-30 and k > rate:
                break
        assert row.n == k or 1 - u < 1e-12


@pytest.mark.parametrize("rate", [499.0, 501.0, 750.0, 1000.0, 100_000.0])
def test_poisson_inverse_at_high_rates(spark, rate):
    us = [0.0, 2**-52, 1e-9, 0.1, 0.5, 0.9, 0.999999, 1 - 1e-9]
    got = spark.createDataFrame([(u, rate) for u in us], "u double, r double").select(mixing.poisson(F.col("u"), F.col("r")).alias("n")).collect()
    c = np.cumsum(np.exp([k * math.log(rate) - rate - math.lgamma(k + 1) for k in range(int(rate + 12 * math.sqrt(rate)) + 42)]))
    for u, row in zip(us[1:], got[1:]):
        # Both sides round: the distribution function is at most u before the count and above it after.
        assert (row.n == 0 or c[row.n - 1] <= u * (1 + 1e-8) + 1e-17) and c[row.n] > u * (1 - 1e-8)
    assert got[0].n == 0


def test_mix_of_a_tiny_source(spark):
    """Sources under 1/745 of their target share keep to it, and their counts spread."""
    docs = spark.createDataFrame([(i, "x" * 999, "big") for i in range(3000)] + [(10_000 + i, "x" * 9, "tiny") for i in range(100)], "doc_id long, text string, source string")
    out = mixing.mix_sources(docs, {}, epochs=1.0).groupBy("source", "doc_id").count().collect()
    n = [r["count"] for r in out if r.source == "tiny"]
    rate = 0.5 * (3000 * 1000 + 100 * 10) / (100 * 10)
    assert rate > 745 and len(n) == 100
    assert abs(np.mean(n) / rate - 1) < 0.02 and 0.7 < np.std(n) / math.sqrt(rate) < 1.3


def test_mix_shares_and_edges(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "abc d", "big" if i % 3 else "small") for i in range(6000)], "doc_id long, text string, source string")
    for bound in (100, 0):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", bound)
        out = mixing.mix_sources(docs, {"big": 1.0, "small": 3.0}, epochs=2.0)
        n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
        assert abs(n["small"] / 9000 - 1) < 0.05 and abs(n["big"] / 3000 - 1) < 0.08
    keys = [r.mix_key for r in out.collect()]
    assert keys == sorted(keys)
    e = mixing.mix_sources(edge(spark), {}, epochs=30.0)
    assert {r.doc_id for r in e.collect()} == {0, 1, 2, 3, 4, 5, None}
    assert set(edge(spark).columns) <= set(e.columns)
    assert mixing.mix_sources(edge(spark, 0), {"src": 2.0}).count() == 0


def test_rows_without_an_id_are_mixed_by_text(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "a") for i in range(200)] + [(1, None, None), (2, "x", None)], "doc_id long, text string, source string")
    out = mixing.mix_sources(docs, {}, epochs=8.0).collect()
    assert len({r.mix_key for r in out}) == len(out) and len({r.mix_copies for r in out}) > 5


# Fingerprints


def test_fingerprints(spark):
    rng = random.Random(6)
    make = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    docs = [(i, make(rng.choice([0, 3, 30, 400]))) for i in range(60)] + [(100, make(300))]
    docs.append((101, docs[-1][1]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(df).collect()}
    order = sorted(docs, reverse=True)
    from tests.llm.test_text_and_links import shingles

    error = []
    for (i, text), (_, after) in zip(order, [*order[1:], order[0]]):
        half = len(text) // 2
        assert got[i].edited_text == text[: len(text) - half] + after[:half] and got[i].n_chars == len(text)
        a, b = shingles(text), shingles(got[i].edited_text)
        error.append(got[i].near_edited - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.sqrt(np.mean(np.square(error))) < 0.06
    assert got[100].fingerprint == got[101].fingerprint and got[101].near_next == 1.0


def plain_print(spark, text):
    """Fingerprint of a text by the definition, in plain Python over the engine's hash function."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return ""
    hashes = [spark.range(1).select(F.xxhash64(F.lit(w))).first()[0] for w in words]
    if len(hashes) >= 5:
        values = [spark.range(1).select(F.xxhash64(*[F.lit(h).cast("long") for h in hashes[i : i + 5]])).first()[0] for i in range(len(hashes) - 4)]
    else:
        values = [spark.range(1).select(F.xxhash64(F.lit(" ".join(map(str, hashes))))).first()[0]]
    least: dict[int, int] = {}
    for v in values:
        v = (v & (1 << 64) - 1) >> 1
        least[v >> 56] = min(v, least.get(v >> 56, v))
    filled, out = sorted(least), []
    for b in range(128):
        if b not in least:
            ranks = [(r, i) for i, r in enumerate(spark.range(1).select(F.array(*[F.hash(F.lit(b), F.lit(f)) for f in filled])).first()[0])]
            out.append(least[filled[min(ranks)[1]]] & 255)
        else:
            out.append(least[b] & 255)
    return bytes(out).hex()


def test_fingerprints_by_definition(spark):
    texts = ["", "one", "two words", "a b c d e", "a b c d e f g h i j k l", "  x y\tz x y z x y z x y z  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(df).collect()}
    prints = [plain_print(spark, t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == prints
    for i in range(len(texts)):
        a, b = prints[i], prints[i - 1]
        same = sum(a[k : k + 2] == b[k : k + 2] for k in range(0, 256, 2)) / 128
        want = 1.0 if not a and not b else 0.0 if not a or not b else min(1.0, max(0.0, (same - 1 / 256) / (1 - 1 / 256)))
        assert abs(got[i].near_next - want) < 1e-12


@pytest.mark.parametrize("quantiles,rows,heads", [(2000, 256, 10**6), (2000, 3, 10**6), (3, 2, 0)])
def test_successors_by_sorting(spark, monkeypatch, quantiles, rows, heads):
    """Ids in clumps, ids that repeat, extreme ids and many rows without one, in ranges of any size."""
    monkeypatch.setattr(fingerprints, "QUANTILES", quantiles)
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", rows)
    monkeypatch.setattr(fingerprints, "BROADCAST_HEADS", heads)
    ids = [i * i for i in range(40)] + [10**12 + i for i in range(30)] + [-(2**63), 2**63 - 1, 7, 7, -5] + [None] * 25
    docs = [(i, f"text number {k} of a few words") for k, i in enumerate(ids)]
    docs += [docs[-1], docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    h = dict(df.select("text", F.xxhash64("text")).collect())
    order = sorted(docs, key=lambda d: (1, h[d[1]], d[1]) if d[0] is None else (0, -d[0], d[1]))
    want = sorted(((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)), key=str)
    got = sorted(((r.doc_id, r.text, r.next_text) for r in fingerprints.successor_pairs(df).collect()), key=str)
    assert got == want


def test_fingerprint_edges(spark):
    rows = rows_of(fingerprints.fingerprint_edits(edge(spark)))
    assert len(rows) == len(DOCS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.fingerprint_edits(edge(spark, 0)).count() == 0
    alone = fingerprints.fingerprint_edits(spark.createDataFrame([(1, "one text")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0
    long = spark.createDataFrame([(1, "word " * 300_000), (2, "x" * 2_000_000)], "doc_id long, text string")
    assert {r.n_chars for r in fingerprints.fingerprint_edits(long).collect()} == {1_500_000, 2_000_000}


# Vectors


def test_vectors_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + rng.normal(0, 0.1, (20, 16)), np.repeat(base[:1], 30, 0) + rng.normal(0, 0.12, (30, 16)), base[5:8], 2 * base[9:10]]).astype(np.float32)
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(x)]
    odd = [(1000, None, 1, 1), (1001, [0.0] * 16, 1, 1), (1002, [1.0] * 15 + [float("nan")], 1, 1), (1003, [1.0] * 15 + [None], 1, 1), (1004, [float("inf")] + [1.0] * 15, 1, 1), (1005, [1.0, 2.0], 1, 1), (1006, [], 1, 1), (1007, [2.0, 4.0], 1, 1), (1008, [2.0, -4.0], 1, 1), (None, x[0].tolist(), 1, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, list int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    from tests.llm.test_text_and_links import roots

    want = roots(range(len(u)), list(zip(*np.nonzero(hit))))
    for block in (1024, 8):
        monkeypatch.setattr(vector_dups, "MEMBER_BLOCK", block)
        monkeypatch.setattr(vector_dups, "QUERY_BLOCK", block)
        monkeypatch.setattr(vector_dups, "LIST_ROWS", 16)
        got = vector_dups.near_vectors(df).collect()
        assert len(got) == len(rows) + len(odd)
        own = {r.vec_id: r for r in got}
        assert all(own[i].n_links == hit[i].sum() and own[i].component_id == want[i] for i in range(len(u)))
        assert all(own[i].n_links == 0 and own[i].kept for i in [*range(1000, 1005), 1006, None])
        assert (own[1005].n_links, own[1007].n_links, own[1008].n_links, own[1007].component_id) == (1, 1, 0, 1005)
    assert vector_dups.near_vectors(df.limit(0)).count() == 0
    assert vector_dups.near_vectors(df.filter("vec_id >= 1000")).count() == 9


@pytest.mark.parametrize("split", [10**9, 300])
def test_recall_at_many_lists(spark, monkeypatch, split):
    """Vectors without clusters, the hard case for lists: pairs at the threshold are found, in lists whole and cut into cells; none is below it. With the reach that the cosine allows none is lost."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=(2000, 24))
    side -= (side * x[:2000]).sum(axis=1)[:, None] * x[:2000]
    side /= np.linalg.norm(side, axis=1)[:, None]
    c = rng.uniform(0.89, 0.93, 2000)[:, None]
    x[2000:4000] = c * x[:2000] + np.sqrt(1 - c * c) * side
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hit = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert hit.sum() > 2000
    from tests.llm.test_text_and_links import roots

    want = roots(range(len(x)), list(zip(*np.nonzero(hit))))
    monkeypatch.setattr(vector_dups, "LIST_ROWS", 8 if split > 6000 else 600)
    monkeypatch.setattr(vector_dups, "SPLIT_ROWS", split)
    for exact in (False, True):
        if exact:
            monkeypatch.setattr(vector_dups, "EXACT_ROWS", 10**9)
        got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dups.near_vectors(df).collect()}
        assert all(got[i][0] <= hit[i].sum() for i in got) and len(got) == len(x)
        assert sum(n for n, _ in got.values()) >= 0.96 * hit.sum()
        if exact:
            assert got == {i: (hit[i].sum(), want[i]) for i in range(len(x))}


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as c
    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for k, (_, stage) in enumerate(c.STAGES):
        docs = stage(spark, docs, SF)
        docs = docs.sparkSession.createDataFrame(docs.toPandas(), docs.schema)
        if k < 4:
            assert docs.columns == c.COLUMNS
        if k < 3:
            assert 0.7 * n <= docs.count() <= n
    assert docs.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_pipeline_matches_brute_force_where_it_is_exact(spark):
    """Near-duplicates and repeats of the pipeline against plain Python, on what the stage before kept."""
    import corpus_pipeline as c
    from tests.conftest import SF
    from tests.llm.test_text_and_links import WORD, brute_near, brute_removed

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    near = c.drop_near_duplicates(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {i for i, (_, comp) in brute_near(rows).items() if comp == i}
    assert {r.doc_id for r in near.collect()} == kept
    cut = c.cut_repeats(spark, near, SF).collect()
    want = brute_removed([r for r in rows if r[0] in kept], 50)
    assert all(WORD.findall(r.text.encode()) == want[r.doc_id][2] and r.n_chars == len(r.text) for r in cut)
