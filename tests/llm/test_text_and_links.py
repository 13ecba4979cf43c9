"""Byte-level words and hashes, near-duplicates, substring dedup and components against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quirework.llm import components, mixing, near_dups, substring_dups, textops
from quirework.functions.scratch import Scratch

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab A\n\té\x1c ", max_size=30), min_size=1, max_size=6))
def test_words(texts):
    column = pa.array(texts)
    for i, j, data, offsets in textops.chunks(column, 40):
        words = textops.words_of(data, offsets)
        for k in range(j - i):
            own = [data[a:b].tobytes() for a, b in zip(words.starts[words.first[k] : words.first[k + 1]], words.ends[words.first[k] : words.first[k + 1]])]
            assert own == WORD.findall(texts[i + k].encode())
    one = textops.words_of(*textops.buffers(column))
    by = {}
    for a, b, h in zip(one.starts, one.ends, one.hashes):
        assert by.setdefault(one.data[a:b].tobytes(), h) == h
    assert len(set(by.values())) == len(by)


def test_sliced_and_null_columns():
    column = pa.array(["x y", None, "z w v"]).slice(1)
    data, offsets = textops.buffers(column)
    assert [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])] == [b"", b"z w v"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 9))
def test_windows(values, size):
    h = textops.mix64(np.array(values, np.uint64))
    got = textops.windows_of(h, size).tolist()
    assert len(got) == max(0, len(values) - size + 1)
    keys = [tuple(values[i : i + size]) for i in range(len(got))]
    assert all((got[i] == got[j]) == (keys[i] == keys[j]) for i in range(len(keys)) for j in range(i))


def shingles(text):
    w = WORD.findall((text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_near(docs):
    sets = {i: shingles(t) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in roots(sets, links).items()}


def test_near_duplicates_with_a_broad_group(spark):
    """A group of copies edited more and less, so that many pairs lie on either side of the threshold."""
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 999)}" for _ in range(80)]
    docs = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(80)] = f"n{rng.random()}"
        docs.append((i, " ".join(words)))
    docs += [(100, docs[3][1].upper()), (101, docs[3][1]), (102, None), (103, ""), (104, " \n"), (105, "One two"), (106, "one  TWO"), (107, "unrelated words of another kind here")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(df).collect()}
    assert got == brute_near(docs)


def test_blocks_match_sets(monkeypatch):
    rng = np.random.default_rng(0)
    x = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(9)]
    y = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(7)]
    want = [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert near_dups.overlaps(x, y).tolist() == want
    same = near_dups.overlaps(x, x)
    assert all(same[i, j] == len(np.intersect1d(x[i], x[j])) for i in range(9) for j in range(9) if i != j)


def test_small_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    docs = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(60)] = f"n{rng.random()}"
        docs.append((i, " ".join(words)))
    monkeypatch.setattr(near_dups, "BLOCK", 7)
    monkeypatch.setattr(near_dups, "BROADCAST_IDS", 0)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(df).collect()}
    assert got == brute_near(docs)


def test_near_duplicates_edge_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 0, 0), (1, "a b c d e f", 1, 1), (None, "a b c d e f", 2, 2), (None, None, 3, 3)], "doc_id long, text string, rep long, component_id long")
    rows = near_dups.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in rows) == [(0, 0, 0, True), (0, 2, 0, True), (1, 2, 1, True), (1, 2, 1, True)]
    assert near_dups.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)] + [(7, 7)]
    got = components.components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t")).collect()
    ids = {x for a, b in links if a != b for x in (a, b)}
    want = roots(ids, [(a, b) for a, b in links if a != b])
    assert {r.id: r.component_id for r in got} == want and len(got) == len(want)


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def brute_removed(docs, size):
    seen, out = {}, {}
    for i, text in sorted(docs):
        w = WORD.findall((text or "").encode())
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen.setdefault(tuple(w[k : k + size]), i) < i:
                gone[k : k + size] = [True] * size
        out[i] = (len(w), sum(gone), [x for x, g in zip(w, gone) if not g])
    return out


@pytest.mark.parametrize("size,gram", [(50, 16), (8, 3), (5, 5)])
def test_repeats_match_brute_force(spark, size, gram):
    rng = random.Random(size)
    passages = [" ".join(f"p{rng.randint(0, 9)}" for _ in range(size + k)) for k in range(6)]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(rng.randint(0, 12))) for _ in range(3)]
        docs.append((i, " \n".join([parts[0], rng.choice(passages), parts[1], rng.choice(passages)[rng.randint(0, 9) :], parts[2]])))
    docs += [(60, docs[0][1]), (61, docs[0][1]), (62, None), (63, ""), (64, "x " * (size + 5)), (65, "x " * (size + 9)), (66, docs[5][1] + " " + docs[5][1])]
    df = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id long, text string, lang string, n_words int")
    want = brute_removed(docs, size)
    for r in substring_dups.remove_repeats(df, keep=("lang",), size=size, gram=gram).collect():
        assert (r.n_words, r.n_removed, WORD.findall((r.text or "").encode()), r.lang) == (*want[r.doc_id], "k")


def test_repeats_edge_rows(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(5, long), (5, long), (None, long), (9, "x " + long), (9, "other")], "doc_id long, text string")
    for bound in (0, 10):
        monkeypatch.setattr(substring_dups, "BROADCAST_IDS", bound)
        rows = substring_dups.remove_repeats(df).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in rows) == [(0, 60, 0), (5, 60, 0), (5, 60, 0), (9, 1, 0), (9, 61, 60)]
        assert {r.text for r in rows if r.n_removed} == {"x "}
    assert substring_dups.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2048, 2049, 4000, 100_000, 2**31 - 1])
def test_mix_partitions_of_any_number(spark, n):
    """Keys of 52 bits go to partitions in their order, however many there are, under ANSI arithmetic."""
    keys = [0, 1, (1 << 52) - 1, 1 << 51, (1 << 20) - 1, 987654321987654]
    got = spark.createDataFrame([(k,) for k in sorted(keys)], "k long").select("k", mixing.partition_of(F.col("k"), n).alias("p")).collect()
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert all(r.p == ((r.k >> 20) * n) >> 32 and 0 <= r.p < n for r in got) and [r.p for r in got] == sorted(r.p for r in got)


@pytest.mark.parametrize("n", [2049])
def test_mix_of_more_partitions_than_2048(spark, n):
    """The whole operator, and the pipeline's stage, where the session asks for many partitions."""
    docs = spark.createDataFrame([(k, f"text {k}", "en", f"s{k % 2}", 6) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    few = sorted(map(tuple, mixing.mix_sources(docs, {"s0": 3.0}, epochs=2.0).collect()), key=str)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        mixed = mixing.mix_sources(docs, {"s0": 3.0}, epochs=2.0)
        rows = mixed.select("*", F.spark_partition_id().alias("part")).collect()
        assert sorted((tuple(r)[:-1] for r in rows), key=str) == few
        by_part = sorted(rows, key=lambda r: (r.part, r.mix_key))
        assert [r.mix_key for r in by_part] == sorted(r.mix_key for r in rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
