"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import Scratch

#: Sources whose statistics are broadcast at most; beyond, they are joined by a salted shuffle.
BROADCAST_SOURCES = 100_000
SALTS = 64
#: Up to this rate the terms of the Poisson distribution begin at 0.
EXACT_RATE = 500.0
#: Bytes of text in an output partition, about.
PARTITION_BYTES = 64 << 20


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts: 52 bits, the same on every run and engine."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson(u: Column, rate: Column) -> Column:
    """Inverse of the Poisson distribution function at ``u``: how many of P(K <= k) are at most u.

    The terms run to rate + 12 sqrt(rate) + 40, where less than 2**-52 is left. Above EXACT_RATE, where exp(-rate) soon vanishes,
    they begin at rate - 12 sqrt(rate) - 40, under which less than 2**-52 lies too, with a first term by Stirling's series.
    """
    wide = 12 * F.sqrt(rate) + 40
    last, large = F.ceil(rate + wide).cast("int"), rate > EXACT_RATE
    low = F.when(large, F.floor(rate - wide)).otherwise(0).cast("int")
    k = F.greatest(low, F.lit(1)).cast("double")
    # log of exp(-rate) rate**k / k!
    log_p = k * F.log1p((rate - k) / k) - (rate - k) - F.log(2 * math.pi * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k)
    p = F.exp(F.when(large, log_p).otherwise(-rate))
    start = F.struct(p.alias("p"), p.alias("c"), F.when(u > 0, low).otherwise(0).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), (acc["n"] + (acc["c"] <= u).cast("int")).alias("n"))

    return F.aggregate(F.sequence(low + 1, last), start, step, lambda acc: acc["n"])


def partition_of(key: Column, n: int) -> Column:
    """The partition of ``n`` that a 52-bit key belongs to, in the order of keys."""
    return F.shiftright(F.shiftright(key, 20) * F.lit(n).cast("long"), 32).cast("int")


def source_rates(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per source: documents, its size in characters (and one for each document), its target share, and the mean repetition rate.

    Rates make the expected size of the mix ``epochs`` times the corpus, and each source's expected share
    its weight over the sum of weights of the sources that occur. Sources that ``weights`` lacks, null among them, have the default.
    """
    listed = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,double>")
    size = F.coalesce(F.length(F.col(text_col)), F.lit(0)) + 1
    stats = docs.groupBy(F.col(source_col).cast("string").alias("mix_source")).agg(F.count("*").alias("source_docs"), F.sum(size).alias("source_chars"))
    # One row a source, read again below: the table itself is scanned once for it.
    stats = Scratch(docs.sparkSession, "mixing").save(stats)
    stats = stats.withColumn("weight", F.coalesce(F.try_element_at(listed, F.coalesce("mix_source", F.lit(""))), F.lit(float(default_weight))))
    # Totals are one row.
    total = stats.agg(F.sum("source_chars"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(float(total[1] or 1))
    return stats.select("mix_source", "source_docs", "source_chars", share.alias("share"), (F.lit(float(epochs)) * share * F.lit(float(total[0] or 0)) / F.col("source_chars")).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, epochs: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All columns of ``docs`` and mix_copy, mix_copies, mix_key: each row as often as its Poisson count, shuffled globally.

    The count is a function of seed, id and the rate of the source alone, so a lost task gives the same copies again; rows with the same id
    (repeats) have the same count. Rows go to partitions by the size of mix_key, a hash of seed, id and copy, and are sorted by it
    within each: files in order are a random order of the corpus, whatever the source. A row without an id goes by its text; a null text or source is a value like others; an empty
    table gives an empty result. Columns of ``docs`` named mix_copy, mix_copies or mix_key are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_copy", "mix_copies", "mix_key")
    rates = source_rates(docs, weights, default_weight, epochs, source_col, text_col)
    sizes = rates.agg(F.count("*"), F.coalesce(F.sum("source_chars"), F.lit(0))).first()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).cast("string").alias("s"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))).alias("i"))
    if sizes[0] <= BROADCAST_SOURCES:
        joined = row.join(F.broadcast(rates.select("mix_source", "rate")), F.expr("s <=> mix_source"))
    else:
        salted = rates.select("mix_source", "rate", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("m_salt"))
        joined = row.withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int")).join(salted, F.expr("s <=> mix_source AND salt = m_salt"))
    count = poisson(uniform(F.lit(str(seed)), F.lit("n"), "i"), F.col("rate"))
    copies = joined.select("row", "i", count.alias("mix_copies")).filter("mix_copies > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("k"), "i", F.col("mix_copy").cast("string"))), 1, 13), 16, 10).cast("long")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(sizes[1] * epochs) // PARTITION_BYTES + 1)
    # The first 32 bits of the key times n, over 2**32: whole numbers that fit for as many partitions as Spark can have.
    dealt = copies.withColumn("mix_key", key).repartitionById(n, partition_of(F.col("mix_key"), n))
    return dealt.sortWithinPartitions("mix_key", "i", "mix_copy").select("row.*", "mix_copy", "mix_copies", "mix_key")
