"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

Training is a small numpy fit on the driver: sparse word n-gram logistic regression, one weight vector per family, one for ``unknown`` (licence talk that names no
family) and one for ``none``, on paragraphs made by rule from the families' templates, from unrelated licence talk and from words put in at random, then a temperature fitted on paragraphs held back. Scoring is native:
a paragraph is a line, or some lines in a row without a blank one, as far as a template wrapped at any width can go. Paragraphs that hold neither a key word nor a stem of
licence talk are passed over; key words are derived from the templates such that no paragraph that a template could confirm lacks one. The others' n-grams are joined with the weights. A prediction is confirmed if it
holds enough of the 3-word shingles of one of its family's templates. Of confirmed paragraphs that share a line the one that holds most shingles of its template counts, or else the shortest.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Short forms of public licence notices, by family (SPDX names).
TEMPLATES = {
    "AGPL": ["licensed under the gnu affero general public license version 3", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license version 3 19 november 2007"],
    "Apache-2.0": ["licensed under the apache license version 2.0", "apache license version 2.0 january 2004", "you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache.org licenses license-2.0"],
    "BSD": ["redistribution and use in source and binary forms with or without modification are permitted", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "released under the bsd 3-clause license", "licensed under the bsd license"],
    "CC-BY": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "available under the creative commons attribution license", "cc by 4.0"],
    "CC-BY-NC": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license", "cc by-nc 4.0"],
    "CC-BY-SA": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license", "cc by-sa 4.0"],
    "CC0": ["to the extent possible under law the author has waived all copyright and related rights to this work", "released under cc0 1.0 public domain dedication", "released under cc0 1.0", "this work is in the public domain"],
    "GPL": ["this work is licensed under the gnu general public license version 3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "released under the gpl version 2", "gpl version 2", "gpl version 3", "gnu general public license version 3 29 june 2007", "gnu general public license version 2 june 1991"],
    "ISC": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "licensed under the isc license"],
    "LGPL": ["licensed under the gnu lesser general public license version 2.1", "under the terms of the gnu lesser general public license", "gnu lesser general public license version 3 29 june 2007"],
    "MIT": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "licensed under the mit license", "mit license", "the software is provided as is without warranty of any kind express or implied"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"],
}
# Notices of public licences that aren't among the families, from which the unknown class learns what one looks like.
UNLISTED = [
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2.0", "distributed under the boost software license version 1.0", "licensed under the artistic license 2.0", "released under the zlib license",
    "this software is provided as-is without any express or implied warranty in no event will the authors be held liable for any damages", "licensed under the academic free license version 3.0", "this font software is licensed under the sil open font license version 1.1",
    "permission to use copy modify and distribute this software and its documentation for any purpose is hereby granted provided that the copyright notice appear in all copies",
]
# Talk of licences that names no family, and words to fill in.
UNKNOWN = ["all rights reserved no part may be reproduced without permission", "licensed under the terms of the proprietary agreement", "see the license file for details", "see the licence for the language governing permissions", "this license is granted to the customer only", "a driving license is required", "copyright notice of the publisher", "released under a commercial license", "usage is subject to the license agreement of the vendor", "the public library has a license for this text", "the work is licensed to the editor", *UNLISTED]
FILL = "the of and in to a is for this that text file page work software author project code data under with by on as from are document".split()
# Stems of licence talk.
STEMS = ("licen", "copyright", "redistribut", "warrant", "permission")
NONE, OTHER = "none", "unknown"
COMMON = set(FILL) | set("all you may not it its or be at can any their use used work's names name part kind no other see only required copy forms free right rights to version 1.0 2.0 2 3 4.0".split())
GRAMS = (1, 2, 3)
SHINGLE = 3
#: A template confirms its family if the paragraph holds this much of its 3-word shingles.
CONFIRM = 0.6
#: Words that deny what follows them: a paragraph that says a work isn't under a licence confirms none.
DENIAL = r"(^| )(not|never|isn t|aren t|no longer|neither|nor) (?:[a-z]+ ){0,2}(licensed|released|available|distributed|published|covered|permitted|subject|under)( |$)"
#: Bound of the trained vocabulary: n-grams, which is what is broadcast. Templates that make more are refused.
MAX_GRAMS = 5000

_WORD = r"[^a-z0-9.\-]+"


def _tokens(text: str) -> list[str]:
    return [w for w in (re.sub(r"^[.\-]+|[.\-]+$", "", w) for w in re.split(_WORD, text.lower())) if w]


def _grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in GRAMS for i in range(len(words) - n + 1)}


def rare_words() -> set[str]:
    """Words of templates and licence talk that aren't ordinary ones: an n-gram is of use only with one of them."""
    return {w for lines in [*TEMPLATES.values(), UNKNOWN] for line in lines for w in _tokens(line)} - COMMON


def template_grams(line: str) -> list[str]:
    """The shingles of a template that hold a rare word; of one of fewer words the whole."""
    words = _tokens(line)
    n = min(SHINGLE, len(words))
    rare = rare_words()
    return sorted({" ".join(g) for g in zip(*[words[i:] for i in range(n)]) if rare & set(g)})


def key_words() -> list[str]:
    """Words of which every paragraph that confirms a template holds one.

    For each template the words that are in most of its shingles, until those without one are too few to confirm it. Of a word
    with a hyphen, where a line may break, the longest part.
    """
    rare, out = rare_words(), set()
    for line in [x for lines in TEMPLATES.values() for x in lines]:
        grams = [set(g.split()) for g in template_grams(line)]
        left = [g for g in grams if not g & out]
        while len(left) >= CONFIRM * len(grams):
            words = sorted({w for g in left for w in g if w in rare}, key=lambda w: (-sum(w in g for g in left), -len(w), w))
            out.add(words[0])
            left = [g for g in left if words[0] not in g]
    return sorted({max(w.split("-"), key=len) for w in out})


@dataclass
class Model:
    classes: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float


def _invented(rng: random.Random) -> str:
    return "".join(rng.choices("aeionrstlhd", k=rng.randint(2, 9)))


def _named(rng: random.Random) -> list[str]:
    """A notice of a licence with a made-up name."""
    head = [rng.choice(["licensed", "released", "distributed", "available"]), "under", *rng.choice(["the", "the terms of the", "a"]).split()]
    tail = rng.choice(["license", "licence", "public license", "public licence", "software license"]).split()
    return [*head, *[_invented(rng) for _ in range(rng.randint(1, 3))], *tail, *rng.choice(["", "", "version 2.0", "version 1.0"]).split()]


def _paragraphs(rng: random.Random, n: int) -> list[tuple[str, str]]:
    """Paragraphs by rule: a template or unrelated line, some words lost, with words before and after it; and rare words put in singly."""
    out, rare = [], sorted(rare_words())
    for _ in range(n):
        family = rng.choice([*TEMPLATES, OTHER, OTHER, NONE, NONE, NONE])
        words = rng.sample(rare, rng.randint(0, 2)) if family == NONE else _tokens(rng.choice(TEMPLATES.get(family, UNKNOWN)))
        if family == OTHER and rng.random() < 0.5:
            words = _named(rng)
        if family != NONE and rng.random() < 0.5:
            words = [w for w in words if rng.random() > 0.1]
        fill = lambda: [rng.choice(FILL) if rng.random() < 0.3 else _invented(rng) for _ in range(rng.choice((0, 0, 0, 5, 20)))]
        out.append((" ".join(fill() + words + fill()), family))
    return out


def fit(seed: int = 0, rounds: int = 200) -> Model:
    """Multinomial logistic regression with an L2 penalty, and its temperature."""
    rng = random.Random(seed)
    data, back = _paragraphs(rng, 3000), _paragraphs(rng, 800)
    known = [*TEMPLATES.values(), UNKNOWN]
    rare = rare_words()
    vocabulary = sorted({g for lines in known for line in lines for g in _grams(_tokens(line)) if rare & set(g.split())})
    if len(vocabulary) > MAX_GRAMS:
        raise ValueError(f"templates make {len(vocabulary)} n-grams, more than {MAX_GRAMS}")
    at = {g: k for k, g in enumerate(vocabulary)}
    classes = [*TEMPLATES, OTHER, NONE]

    def matrix(rows):
        x = np.zeros((len(rows), len(vocabulary) + 1))
        x[:, -1] = 1
        for i, (text, _) in enumerate(rows):
            x[i, [at[g] for g in _grams(_tokens(text)) if g in at]] = 1
        return x, np.array([classes.index(y) for _, y in rows])

    x, y = matrix(data)
    w, goal = np.zeros((x.shape[1], len(classes))), np.eye(len(classes))[y]
    sums = np.full_like(w, 1e-6)
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (goal - p) / len(x) - 1e-4 * w
        sums += g * g
        w += 0.3 * g / np.sqrt(sums)
    x, y = matrix(back)
    z = x @ w

    def loss(t):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return -(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean()

    temperature = min((0.25 * 1.1**k for k in range(40)), key=loss)
    return Model(classes, {g: w[k].round(6).tolist() for g, k in at.items()}, w[-1].round(6).tolist(), float(temperature))


#: Words that lines between the first and the last of a paragraph hold at most: twice the longest template, so words put in have room.
INNER = 2 * max(len(_tokens(line)) for lines in TEMPLATES.values() for line in lines)


def _words(line: Column) -> Column:
    words = F.transform(F.split(F.lower(line), _WORD), lambda w: F.regexp_replace(w, r"^[.\-]+|[.\-]+$", ""))
    return F.filter(words, lambda w: w != "")


def _shingles(words: Column, n: int) -> Column:
    size = F.size(words)
    return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def _joined(near: Column, more: Column) -> Column:
    """The words of the first line of ``near`` and ``more`` lines after it as one text: of several, the end of the first and the beginning of the last."""
    ends = F.concat(F.array(F.substring_index(near[0], " ", -INNER)), F.slice(near, F.lit(2), F.greatest(more - 1, F.lit(0))), F.array(F.substring_index(F.get(near, more), " ", INNER)))
    return F.rtrim(F.replace(F.when(more > 0, F.array_join(ends, " ")).otherwise(near[0]), F.lit("- "), F.lit("-")), F.lit("-"))


def _choose(units: Column) -> Column:
    """Confirmed paragraphs of a text, best first and none that shares a line with a better one, and lines that no such paragraph holds."""
    meets = lambda taken, u: F.exists(taken, lambda t: (t["paragraph"] <= u["last"]) & (u["paragraph"] <= t["last"]))
    sure = F.array_sort(F.filter(units, lambda u: u["confirmed"]))
    taken = F.aggregate(sure, F.filter(units, lambda u: F.lit(False)), lambda t, u: F.when(meets(t, u), t).otherwise(F.concat(t, F.array(u))))
    return F.transform(F.array(taken), lambda t: F.concat(t, F.filter(units, lambda u: ~u["confirmed"] & ~meets(t, u))))[0]


def scan_paragraphs(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph that holds a key word or stem and a word n-gram of the model, and that the model doesn't give to ``none``: doc_id, paragraph (its first line, from 0), family, probability, template_score, confirmed.

    Notices wrapped over lines are one confirmed paragraph; what no confirmed paragraph holds is a row per line.
    A paragraph that the model gives to a family no template of which it holds, or that denies being under a licence, counts as ``unknown`` and is not confirmed.
    """
    spark: SparkSession = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def about(text: Column) -> Column:
        low = F.lower(text)
        out = F.lit(False)
        for part in words_to_find:
            out = out | F.contains(low, F.lit(part))
        return out

    words_to_find = sorted({*STEMS, *key_words()}, key=len, reverse=True)
    words_to_find = [w for w in words_to_find if not any(v != w and v in w for v in words_to_find)]
    # A document's lines are looked at only if it holds a key word or stem; so are lines in a row.
    held = own.filter(about(F.col("text"))).select("doc_id", F.xxhash64("text").alias("text_id"), F.split("text", "\n").alias("lines"))
    # Of a line its words with one space between and a hyphen at its end if it has one, their number, and whether a stem can begin in it.
    words = lambda x: F.concat(F.array_join(_words(x), " "), F.when(F.rlike(x, F.lit(r"[A-Za-z0-9]-\s*$")), "-").otherwise(""))
    facts = lambda t: F.struct(t.alias("t"), F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).alias("n"), about(t).alias("b"))
    held = held.select("doc_id", "text_id", F.explode(F.array(F.transform(F.transform("lines", words), facts))).alias("lines"))
    starts = held.select("doc_id", "text_id", F.posexplode(F.transform("lines", lambda _, i: F.slice("lines", i + 1, INNER + 2))).alias("paragraph", "near"))
    starts = starts.filter((F.col("near")[0]["n"] > 0) & F.exists("near", lambda x: x["b"]))
    fits = lambda s, x: s["open"] & (x["n"] > 0) & (s["inner"] <= INNER)
    reach = F.aggregate(
        F.slice("near", 2, INNER + 1),
        F.struct(F.lit(0).alias("more"), F.lit(0).alias("inner"), F.lit(True).alias("open")),
        lambda s, x: F.struct((s["more"] + fits(s, x).cast("int")).alias("more"), (s["inner"] + x["n"]).alias("inner"), fits(s, x).alias("open")),
        lambda s: s["more"],
    )
    starts = starts.select("doc_id", "text_id", "paragraph", F.col("near.t").alias("near"), F.explode(F.sequence(F.lit(0), reach)).alias("more"))
    units = starts.select("doc_id", "text_id", "paragraph", "more", F.explode(F.array(_joined(F.col("near"), F.col("more")))).alias("unit")).filter(about(F.col("unit")))
    lines = units.select("doc_id", "text_id", "paragraph", (F.col("paragraph") + F.col("more")).alias("last"), F.explode(F.array(F.split("unit", " "))).alias("words"))
    lines = lines.withColumn("grams", F.array_distinct(F.concat(*[_shingles(F.col("words"), n) for n in GRAMS])))
    # The vocabulary is bounded by MAX_GRAMS; rows of one paragraph meet by their hash, whatever the licence.
    table = F.broadcast(spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(model.weights)), "map<string,array<double>>")).alias("gram", "w")))
    key = lines.withColumn("line_id", F.xxhash64("doc_id", "text_id", "paragraph", "words"))
    place = ["doc_id", "text_id", "paragraph", "last"]
    denied = F.rlike(F.array_join("words", " "), F.lit(DENIAL)).alias("denied")
    parts = key.select(*place, "line_id", F.xxhash64("words").alias("words_id"), denied, F.explode("grams").alias("gram")).join(table, "gram")
    sums = parts.groupBy(*place, "line_id", "words_id").agg(*[F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(len(model.classes))], F.collect_set("gram").alias("held"), F.bool_or("denied").alias("denied"))
    # Equal rows give equal sums of copies; the bias and the temperature follow.
    z = F.array(*[(F.col(f"z{k}") + F.lit(b)) / F.lit(model.temperature) for k, b in enumerate(model.bias)])
    scored = sums.select(*place, "words_id", "held", "denied", z.alias("z"))
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    best = F.get(F.array(*[F.lit(c) for c in model.classes]), (F.array_position("z", top) - 1).cast("int"))
    scored = scored.select(*place, "words_id", "held", "denied", best.alias("family"), (1 / total).alias("probability"))

    def holding(family: str) -> Column:
        """Shingles held of the template that is confirmed by most, and the part of it; without a confirmed one 0 and the greatest part."""
        best_of = []
        for line in TEMPLATES[family]:
            grams = template_grams(line)
            n = F.size(F.array_intersect("held", F.array(*[F.lit(g) for g in grams])))
            best_of.append(F.struct(F.when(n >= CONFIRM * len(grams), n).otherwise(0).alias("hits"), (n / F.lit(float(len(grams)))).alias("score")))
        return F.array_max(F.array(*best_of))

    template = F.struct(F.lit(0).alias("hits"), F.lit(0.0).alias("score"))
    for family in TEMPLATES:
        template = F.when(F.col("family") == family, holding(family)).otherwise(template)
    scored = scored.filter(F.col("family") != NONE).withColumn("t", template).select("*", F.col("t.hits").alias("hits"), F.col("t.score").alias("template_score"))
    scored = scored.withColumn("confirmed", (F.col("hits") > 0) & ~F.col("denied")).filter("confirmed OR last = paragraph")
    # In the order of choice.
    unit = F.struct((-F.col("hits")).alias("rank"), (F.col("last") - F.col("paragraph")).alias("more"), (-F.col("probability")).alias("p"), "paragraph", "last", "words_id", "family", "probability", "template_score", "confirmed")
    chosen = scored.groupBy("doc_id", "text_id").agg(F.collect_list(unit).alias("units")).select("doc_id", F.explode(_choose(F.col("units"))).alias("u")).select("doc_id", "u.*")
    # Rows with one id may repeat a paragraph in texts that differ.
    chosen = chosen.dropDuplicates(["doc_id", "paragraph", "last", "words_id"])
    return chosen.select("doc_id", "paragraph", F.when(F.col("confirmed"), F.col("family")).otherwise(OTHER).alias("family"), "probability", "template_score", "confirmed")


def scan_licences(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id of ``docs``: doc_id, n_paragraphs, n_licence (confirmed), n_unknown, families (sorted, comma-separated), family (of the likeliest confirmed paragraph, else ``unknown`` or ``none``), probability, template_score.

    A null or empty text has 0 or 1 paragraphs and no licence; a text of any length is read whole. Rows that repeat an id are one row, their paragraphs are counted together; a paragraph
    that repeats at the same line of rows with one id counts once. Rows without an id are one row with a null id. Other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    model = model or fit()
    found = scan_paragraphs(docs, model, id_col, text_col)
    per = found.groupBy(F.col("doc_id").alias("d")).agg(
        F.count_if("confirmed").alias("c"),
        F.count_if(~F.col("confirmed") & (F.col("probability") >= 0.5)).alias("u"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("fs"),
        F.max(F.when(F.col("confirmed"), F.struct("probability", F.col("family").alias("f"), "template_score"))).alias("b"),
    )
    lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.length(F.col(text_col)) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)
    base = docs.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.sum(lines.cast("long")).alias("n_paragraphs"))
    return base.join(per, F.expr("doc_id <=> d"), "left").select(
        "doc_id",
        "n_paragraphs",
        F.coalesce("c", F.lit(0)).alias("n_licence"),
        F.coalesce("u", F.lit(0)).alias("n_unknown"),
        F.coalesce("fs", F.lit("")).alias("families"),
        F.coalesce(F.col("b.f"), F.when(F.col("u") > 0, OTHER), F.lit(NONE)).alias("family"),
        F.coalesce("b.probability", F.lit(0.0)).alias("probability"),
        F.coalesce("b.template_score", F.lit(0.0)).alias("template_score"),
    )
