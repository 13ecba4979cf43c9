"""Importance resampling towards a target distribution: hashed word n-grams, gains by bucket, Gumbel noise, exact top share."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import Scratch
from ..functions.text import let

BUCKETS = 10_000
#: Rows of a partition in which drawn documents are sorted, about.
SORTED_ROWS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words, once A-Z are a-z.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: A-Z as a-z, runs of digits, letters and everything beyond ASCII; none of a null."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _GAPS, -1), lambda w: w != "")


def bucket_array(own: Column, max_n: int = 1, buckets: int = BUCKETS) -> Column:
    """Bucket of each run of 1 to ``max_n`` consecutive words of an array of words, repeats included."""
    def grams_of(own: Column, n: int) -> Column:
        starts = F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(own, i, n), " "))

    # The words are bound to a name: inside the inner function they would be made anew for each run of words.
    grams = let(own, lambda w: F.concat(w, *[grams_of(w, n) for n in range(2, max_n + 1)])) if max_n > 1 else own
    return F.transform(grams, lambda g: F.pmod(F.crc32(g.cast("binary")), F.lit(buckets)).cast("int"))


def _bucketed(docs: DataFrame, text_col: str, max_n: int, buckets: int, *columns: Column) -> DataFrame:
    own = docs.select(*columns, words(F.col(text_col)).alias("r_words"))
    return own.withColumns({"r_buckets": bucket_array(F.col("r_words"), max_n, buckets), "r_n": F.size("r_words")}).drop("r_words")


def bucket_counts(docs: DataFrame, text_col: str = "text", max_n: int = 1, buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts fall in each bucket. Only ``buckets`` totals of a partition are shuffled, and as many reach the driver."""
    rows = _bucketed(docs, text_col, max_n, buckets).select(F.explode("r_buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()
    out = [0] * buckets
    for b, n in rows:
        out[b] = n
    return out


def gains(raw: Sequence[int], target: Sequence[int]) -> list[int]:
    """Floor of 1000 times the log-ratio of a bucket's smoothed share in the target to that in the raw corpus."""
    size, s_all, t_all = len(raw), sum(raw), sum(target)
    return [math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size)))) for s, t in zip(raw, target)]


def _literal(values: Sequence[int]) -> Column:
    """An array literal; written as text, as a call for each entry would take seconds, and folded to the array by the optimiser."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def gumbel(seed: int, item: Column) -> Column:
    """Floor of 1000 times Gumbel noise from the first 32 bits of SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(item.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_scores(docs: DataFrame, gain: Sequence[int], seed: int = 2024, max_n: int = 1, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain of the features; 0 without any), score (weight and noise), and the columns in ``keep``.

    Explode-free: a document's buckets are an array, summed over one literal array of gains.
    """
    own = _bucketed(docs, text_col, max_n, len(gain), F.col(id_col).cast("long").alias("r_id"), *[F.col(c).alias(f"r_keep{i}") for i, c in enumerate(keep)])
    table = _literal(gain)
    total = F.aggregate("r_buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b + 1))
    n = F.size("r_buckets").cast("long")
    scored = own.select("*", n.alias("n"), F.when(n > 0, F.floor(total / n)).otherwise(0).cast("long").alias("w"))
    return scored.select(F.col("r_id").alias("doc_id"), F.col("r_n").cast("long").alias("n_words"), F.col("n").alias("n_features"), F.col("w").alias("weight"), (F.col("w") + gumbel(seed, F.col("r_id"))).alias("score"), *[F.col(f"r_keep{i}").alias(c) for i, c in enumerate(keep)])


def draw(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """Adds rank to saved scores: 1, 2, ... by score, ties to the smaller doc_id, for the highest ``percent`` in 100 of the documents of at least ``min_words`` words, else null.

    A histogram of scores gives the least score drawn: a score is a whole number between bounds that don't depend on the number of documents, as gains are logs of
    counts and the noise has 32 bits, so it has some 100,000 lines at most. Rows from there on are dealt out by ranges of score and id, hot scores among them, and sorted where they
    lie; a row's rank is its place there after the rows of the ranges before.
    """
    spark = scored.sparkSession
    scratch = Scratch(spark, "resampling")
    enough = F.col("n_words") >= min_words
    histogram = sorted(((s, n) for s, n in scored.filter(enough).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = percent * sum(n for _, n in histogram) // 100
    least, reached = None, 0
    for score, n in histogram:
        if reached >= wanted:
            break
        least, reached = score, reached + n
    none = F.lit(None).cast("long").alias("rank")
    if least is None:
        return scored.select("*", none)
    chosen = enough & (F.col("score") >= least)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), reached // SORTED_ROWS + 1)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    place = F.monotonically_increasing_id()
    ranked = scratch.save(scored.filter(chosen).repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("place", place))
    part = F.shiftrightunsigned("place", 33)
    sizes = dict(ranked.groupBy(part.alias("p")).agg(F.count("*")).collect())
    before = [0]
    for p in range(max(sizes) + 1):
        before.append(before[-1] + sizes.get(p, 0))
    rank = F.element_at(_literal(before), part.cast("int") + 1) + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ranked.withColumn("rank", F.when(rank <= wanted, rank)).drop("place")
    return ranked.unionByName(scored.filter(~chosen).select("*", none))


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, max_n: int = 1, buckets: int = BUCKETS, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score, rank (null unless drawn), and the columns in ``keep``; ``rank IS NOT NULL`` is the sample.

    Documents like the texts of ``target`` score high: a feature's gain is the log-ratio of its bucket's shares in target and corpus, a document's weight the mean gain of
    its features. With noise by a hash of the id the highest scores are a draw without replacement by importance, the same on every run. Counts cover all rows of both tables.
    A null, empty or wordless text has no features, weight 0 and isn't drawn unless ``min_words`` is 0; a text of any length is read whole. Equal texts have equal
    weights; rows that repeat an id have its noise and take ranks of their own. A null id has the noise of the empty string and comes last among ties. Without documents, or
    an empty ``target``, nothing fails: gains are those of counts of 0. Columns that aren't asked for are ignored, whatever their names; ``keep`` can't name the result's columns.
    """
    gain = gains(bucket_counts(docs, text_col, max_n, buckets), bucket_counts(target, target_text_col, max_n, buckets))
    scored = Scratch(docs.sparkSession, "resampling").save(importance_scores(docs, gain, seed, max_n, keep, id_col, text_col))
    return draw(scored, percent, min_words)
