"""op11 to op13 against brute force, planted cases and edge rows."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirework.llm import main_text, queries, resampling, runs
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ("struct(1) AS words", "'x' AS r_text", "2 AS n_words", "'y' AS rank", "3 AS place")


# Periodic runs


def brute_runs(x, least=24, exponent=3):
    """All runs by going through every period."""
    out = {}
    for q in range(1, len(x)):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i - s >= q:
                out.setdefault((s, i + q - s), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in out.items() if n >= least and n >= exponent * q)


def brute_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(rng):
    x = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.choice([0, 1, 5, 30, 90]))]
    for _ in range(rng.randrange(5)):
        a, p = rng.randrange(len(x) + 1), rng.randint(1, 9)
        x = x[:a] + (x[a : a + p] or [7]) * rng.randint(2, 12) + x[a + p :]
    return x + [11] + x[len(x) // 3 :] if rng.random() < 0.4 else x


def test_runs_of_random_and_periodic_letters():
    rng = random.Random(1)
    for _ in range(400):
        x = periodic(rng)
        for least, exponent in ((2, 2), (6, 3), (24, 3)):
            assert runs.find_runs(x, least, exponent) == brute_runs(x, least, exponent), x


def test_factors_are_longest_earlier_words():
    rng = random.Random(2)
    for _ in range(200):
        x = periodic(rng)
        for a, b, source in runs.factors(x):
            earlier = any(x[j : j + b + 1 - a] == x[a : b + 1] for j in range(a)) if b < len(x) else False
            assert not earlier and (x[source : source + b - a] == x[a:b] if source >= 0 else b == a + 1 and x[a] not in x[:a])


def test_runs_of_long_words_sequences():
    a, b = [0], [0, 1]
    while len(b) < 20000:
        a, b = b, b + a
    assert runs.find_runs(b[:3000]) == brute_runs(b[:3000])
    assert runs.find_runs([0, 1, 2] * 100000) == [(0, 300000, 3)]


def test_runs_of_documents(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{k}" for k in periodic(rng)) for _ in range(150)]
    texts += ["", None, " \t\n", "one", "a " * 24, "a " * 23, "é ü\x0b" * 30, "x " * 50000, "same same " * 13, "same same " * 13]
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = runs.periodic_runs(docs.selectExpr("*", *CLASHING)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, text in rows:
        words = WORD.findall(text or "")
        want = brute_runs(words) if len(words) < 1000 else [(0, 50000, 1)]
        assert [tuple(r) for r in by[i].runs] == want and by[i].n_words == len(words) and by[i].collapsed == brute_collapsed(words, want)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_of_runs(spark):
    """The contract on the smallest table, from its wording."""
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    docs, planted = spark.read.parquet(f"{SF}/documents.parquet").collect(), 0
    assert len(docs) == len(got)
    for d in docs:
        w = WORD.findall(d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        r = got[d.doc_id]
        if n > 3000:
            continue
        found = brute_runs(w)
        best = min(found, key=lambda x: (-x[1] * math.prod(y[2] for y in found) // x[2], x[0], x[2])) if found else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best), d.doc_id
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(w, found).encode()).hexdigest()
    assert planted > 5


# Main text


PAGES = {
    "named": (
        "<html><head><title>x</title><script>if(a<b){'</p>'}</script></head><body class='has-sidebar'><header><h1>Site</h1></header><div class='cookie-notice'><p>We use cookies.</p></div><main><nav>menu</nav>"
        "<article><header><h1>T &amp; t</h1></header><p>One <b>two</b>three<br>four<p>Five &lt;b&gt;<div class='ad'>buy</div><ul><li>i1<li>i2</ul><p>x</p><section id='comments'><article class='comment'><p>long words of a reader who goes on</p></article></section></article>"
        "<aside>side</aside></main><footer>f</footer></body></html>",
        ["T & t", "One twothree four", "Five <b>", "i1", "i2", "x"],
    ),
    "plain": (
        "<body><div id='header'>Site</div><ul class=menu><li><a href=x>a</a><li><a href=y>b</a></ul><div id=content><h1>Head</h1><p>Long paragraph of text, with words and words and words.</p><div class=ad><p>Buy this now now now now</p></div><p>Be.</p><p>Another long paragraph, with words and words.</p></div>"
        "<div class='comments'><h3>Comments</h3><div class='c'><p>I think this is a long long long comment.</p></div></div><form><label>Name</label><input></form><div id=footer>Copyright</div>",
        ["Head", "Long paragraph of text, with words and words and words.", "Be.", "Another long paragraph, with words and words."],
    ),
    "no hints": ("<body><div><a href=1>Home</a> <a href=2>News</a></div><div><h1>Head</h1><p>Long paragraph of text, with words and words and more and more.</p><p>Short.</p></div><div><div>&copy; Someone</div></div>", ["Head", "Long paragraph of text, with words and words and more and more.", "Short."]),
    "short article": ("<nav>n</nav><article><h1>be.</h1><p>be.</article><footer>a footer with so many words that it is the longest part</footer>", ["be.", "be."]),
    "form around all": ("<form id=aspnetForm><div class=nav>m</div><div><h1>H</h1><p>text one two three four</p><p>again text</p></div></form>", ["H", "text one two three four", "again text"]),
    "cells": ("<table><tr><td class=sidebar>menu text</td><td><p>Hello article text that is long</p><p>b</p></td></tr></table>", ["Hello article text that is long", "b"]),
    "cut in a tag": ("<article><p>abc</p><p>def <a href='zzz", ["abc", "def"]),
    "references": ("<article><p>a &am b &amp c&#x41;&nbsp; d &amp;lt;</p></article>", ["a &am b & cA d &lt;"]),
    "quoted ends": ("<article><p title='a > b'>x <img alt=\"1 > 0\"> y < 3</p></article>", ["x y < 3"]),
    "hidden": ("<article><p>x</p><div hidden><p>no</p></div><div style='display: none'>no</div><p>y</p></article>", ["x", "y"]),
    "menus alone": ("<nav><p>menu</p></nav><footer>f</footer>", []),
    "script without end": ("<article><p>x</p><script>var a = '", ["x"]),
    "comment without end": ("<article><p>x</p><!-- <p>y</p>", ["x"]),
    "text alone": ("just  text", ["just text"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text_of_page(name):
    page, want = PAGES[name]
    assert main_text.main_blocks(page) == want


def test_surges_and_dives():
    import numpy as np

    assert main_text.spans(np.array([3, 0, 0, 0, 50, 0, 60, 0, 0, 0, 2]), 20) == [(4, 7)]
    assert main_text.spans(np.array([0, 0, 5, 0, 0, 0, 1]), 0) == [(2, 3), (6, 7)]
    assert main_text.spans(np.zeros(4, int), 0) == [] and main_text.spans(np.zeros(0, int), 0) == []


@pytest.mark.parametrize("page", ["<div>" * 200000 + "x", "<p class='ad'>x " * 50000, "</div>" * 200000, "<!-- " * 200000, '<a href="' * 200001, "<span class=ad>" * 50000 + "<li>x" * 50000, "<" * 300000, "<article>" + "<p>word word</p>" * 50000])
def test_very_long_pages_in_one_pass(page):
    import time

    began = time.time()
    blocks = main_text.main_blocks(page)
    assert time.time() - began < 20 and (len(blocks) == 50000 or not page.startswith("<article>"))


def test_main_text_rows(spark):
    rows = [(1, "u", PAGES["named"][0]), (None, None, PAGES["plain"][0]), (2, "v", None), (3, "w", ""), (1, "u", PAGES["named"][0])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = main_text.extract_main_text(pages.selectExpr("*", "'z' AS text", "1 AS n_chars", "2 AS m_html")).collect()
    want = Counter((i, u, "\n\n".join(main_text.main_blocks(h or ""))) for i, u, h in rows)
    assert Counter((r.page_id, r.url, r.text) for r in got) == want and all(r.n_chars == len(r.text) for r in got)
    assert main_text.extract_main_text(pages.limit(0)).count() == 0


def test_query_of_pages_gives_every_article(spark):
    """On the table's pages, whose articles are elements of that name, nothing of an article is lost and nothing else comes with it."""
    for r in queries.op12_html_extraction(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet"), ["page_id", "url"]).collect():
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"(?s)<article>(.*?)</article>", r.html)[1])
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        assert r.text == "\n\n".join(b for b in want if b)


# Importance resampling


def brute_resample(docs, target, percent, least, seed, max_n, buckets):
    def features(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    raw, goal = (Counter(b for _, t in rows for b in features(t)[1]) for rows in (docs, target))
    s_all, t_all, out = sum(raw.values()), sum(goal.values()), []
    gain = {b: math.floor(1000 * math.log((goal[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b in range(buckets)}
    for i, t in docs:
        n, f = features(t)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = Counter((*r, k + 1) for k, r in enumerate(order[: percent * len(order) // 100]))
    return drawn, out


@pytest.mark.parametrize("max_n, buckets, percent, least", [(1, 10000, 10, 20), (2, 64, 35, 3), (3, 7, 100, 0)])
def test_resampling_against_brute_force(spark, max_n, buckets, percent, least):
    rng = random.Random(max_n)
    docs = [(k, " ".join(rng.choice(["Déjà", "vu", "a-b", "X9", "straße", "x9", "日本 語", "..."]) for _ in range(rng.randrange(60)))) for k in range(300)]
    docs += [(None, None), (7, ""), (8, "!!"), (9, docs[5][1]), (5, docs[5][1]), (5, docs[5][1]), (1000, "long word " * 30000), (None, "x " * 25)]
    target = [(0, "vu X9 vu"), (1, None), (2, "日本 a")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    own = frame(docs).repartition(6).selectExpr("*", *CLASHING)
    got = resampling.importance_resample(own, frame(target), percent, least, 11, max_n, buckets).collect()
    drawn, every = brute_resample(docs, target, percent, least, 11, max_n, buckets)
    assert Counter(tuple(r)[:5] for r in got) == Counter(map(tuple, every))
    assert Counter(tuple(r) for r in got if r["rank"] is not None) == drawn


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resampling.importance_resample(none, some).count() == 0
    assert [tuple(r)[:3] for r in resampling.importance_resample(some, none).collect()] == [(1, 3, 3)]


def test_ranks_of_one_hot_score(spark):
    """All documents in one score: ranges split it by id, no task holds it whole, and ranks stay in order."""
    scored = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit(30).cast("long").alias("n_words"), F.lit(5).cast("long").alias("score"))
    drawn = resampling.draw(scored, 50, 20).filter("rank IS NOT NULL")
    assert drawn.count() == 10000 and drawn.filter("rank <> doc_id + 1").count() == 0


def test_scores_are_explode_free(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = resampling.importance_scores(docs, [0] * 10000)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "Python" not in plan


def test_texts_of_words_that_stay():
    """Whatever stands between words, and whichever go: those that stay, joined by one space."""
    import numpy as np
    import pyarrow as pa

    from quirework.llm.textops import buffers, words_of

    rng = random.Random(1)
    for _ in range(300):
        docs = ["".join(rng.choice(["a", "é", "bb", " ", "  ", "\n", "\t", "ccc"]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 5))]
        words = words_of(*buffers(pa.array(docs)))
        keep, k, want = np.array([rng.random() < 0.6 for _ in range(len(words.starts))], bool), 0, []
        for d in docs:
            own = WORD.findall(d)
            want.append(" ".join(w for i, w in enumerate(own) if keep[k + i]))
            k += len(own)
        assert runs._kept_texts(words, keep) == want
