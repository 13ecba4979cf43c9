"""One-permutation MinHash fingerprints, in DataFrame functions only.

The hash of each 5-word shingle is taken once: its high bits name one of 128 bins, the rest is its value, and a bin keeps
its least value. An empty bin borrows from the filled bin that a fixed random order, another one for each bin, ranks first:
so all texts with the same filled bins borrow alike (optimal densification). The low 8 bits of each bin are the fingerprint, in hex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import Scratch

SHINGLE_WORDS = 5
BINS = 128
LOW_BITS = 8
_BIN_SHIFT = 63 - 7
#: Rows in a range of ids, about, and quantiles of the ids that the driver knows. Ranges between two quantiles are of equal width, so there are as many as the table asks for.
RANGE_ROWS, QUANTILES = 256, 2000
#: First rows of ranges are broadcast up to so many (12 MB), and joined by a shuffle beyond.
BROADCAST_HEADS = 500_000


def _word_hashes(text: Column) -> Column:
    """Hashes of the words of a text in order."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _bins(hashes: Column) -> Column:
    """Sorted non-negative 63-bit hashes of the shingles, from the words' hashes."""
    n = F.size(hashes)
    many = F.transform(F.sequence(F.lit(1), n - SHINGLE_WORDS + 1), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.element_at(hashes, i + k) for k in range(SHINGLE_WORDS)]), 1))
    one = F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(F.transform(hashes, lambda h: h.cast("string")), " ")), 1))
    return F.sort_array(F.when(n >= SHINGLE_WORDS, many).when(n > 0, one).otherwise(F.array().cast("array<long>")))


def _firsts(shingles: Column) -> Column:
    """Of sorted values, the first of each bin."""
    return F.filter(shingles, lambda x, i: (i == 0) | (F.shiftright(x, _BIN_SHIFT) != F.shiftright(F.get(shingles, i - 1), _BIN_SHIFT)))


def _filled(firsts: Column) -> Column:
    bins = F.transform(firsts, lambda x: F.shiftright(x, _BIN_SHIFT).cast("int"))
    low = F.transform(firsts, lambda x: x.bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("int"))
    return F.struct(bins.alias("bins"), low.alias("low"))


def _dense(filled: Column) -> Column:
    bins, low = filled["bins"], filled["low"]

    def value(b: Column) -> Column:
        at = F.array_position(bins, b).cast("int")
        # Rank of each filled bin in the order of bin b, with its place: the least is borrowed from.
        ranked = F.array_min(F.transform(bins, lambda f, i: F.shiftleft(F.hash(b, f).cast("long"), 8) + i))
        return F.when(at > 0, F.get(low, at - 1)).otherwise(F.get(low, F.pmod(ranked, F.lit(256)).cast("int")))

    full = F.size(bins) == BINS
    return F.when(full, low).when(F.size(bins) > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value)).otherwise(F.array().cast("array<int>"))


def packed(values: Column) -> Column:
    return F.lower(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x), LOW_BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints' shingle sets, freed of the chance agreement of low bits.

    Two texts without words are alike (1), one of them and a text with words are not (0).
    """
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << LOW_BITS)
    raw = (same / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1 - chance)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds array column ``out``: the bins' low bits; empty for a text without words. Steps are columns of their own, so each is computed once."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    df = df.withColumn("_h", _word_hashes(F.col(text)))
    df = df.withColumn("_b", _bins(F.col("_h")))
    df = df.withColumn("_f", _firsts(F.col("_b")))
    df = df.withColumn("_s", _filled(F.col("_f")))
    return df.select(*keep, _dense(F.col("_s")).alias(out))


def _below(cuts: list[int], value: Column) -> Column:
    """How many of the sorted ``cuts`` are less than ``value``, by binary search."""
    held = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    steps = [1 << k for k in range(max(1, len(cuts).bit_length()) - 1, -1, -1)]
    return F.aggregate(F.array(*[F.lit(n) for n in steps]), F.lit(0), lambda at, n: F.when(F.get(held, at + n - 1) < value, at + n).otherwise(at))


def successor_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, print, next_text, next_print: each row with the next one by descending id, the first after the last.

    Rows are dealt into ranges of ids, and each range also gets the first row of the range that follows,
    so one exchange brings neighbours together. Rows with the same id follow each other by text; rows without an id come last,
    by a hash of their text, which spreads them over ranges of their own. Only quantiles of ids and one pair of numbers for each reach the driver.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    probs = [i / QUANTILES for i in range(QUANTILES + 1)]
    n, known, cuts = own.agg(F.count("*"), F.count("doc_id"), F.percentile_approx("doc_id", probs, 20_000)).first()
    named, blank = max(1, known // RANGE_ROWS), max(1, (n - known) // RANGE_ROWS)
    groups = min(QUANTILES, named)
    edges = sorted({cuts[i * QUANTILES // groups] for i in range(groups + 1)}) if known else []
    fine = -(-named // max(1, len(edges) - 1))
    # ``place`` goes up in the order of the rows: ids from the greatest on, then hashes of texts without an id; ``part`` joins places under one quantile.
    low = F.greatest(F.lit(0), F.least(F.lit(max(0, len(edges) - 2)), _below(edges, F.col("doc_id")) - 1))
    at = F.array(*[F.lit(c).cast("long") for c in [*edges, *edges[-1:]]]) if edges else F.array().cast("array<long>")
    begin, end = F.get(at, low).cast("double"), F.get(at, low + 1).cast("double")
    inner = F.floor((F.col("doc_id") - begin) / F.greatest(end - begin, F.lit(1.0)) * fine)
    by_id = low.cast("long") * fine + F.greatest(F.lit(0).cast("long"), F.least(F.lit(fine - 1).cast("long"), inner))
    hashed = F.xxhash64("text")
    by_text = F.floor((F.shiftright(hashed, 11) + F.lit(1 << 52)).cast("double") / F.lit(float(1 << 53)) * blank)
    place = F.when(F.col("doc_id").isNull(), by_text).otherwise(-1 - by_id)
    part = F.when(F.col("doc_id").isNull(), 1 + F.floor(by_text / F.lit(max(1, blank // QUANTILES)))).otherwise(-1 - low)
    key = F.when(F.col("doc_id").isNull(), hashed).otherwise(F.bitwise_not("doc_id"))
    placed = own.select("doc_id", "text", place.alias("p"), part.cast("long").alias("part"), key.alias("key"))

    heads = placed.groupBy("part", "p").agg(F.min("key").alias("key"))
    parts = sorted(heads.groupBy("part").agg(F.max("p")).collect())  # one row a quantile
    before = {part: parts[i - 1][1] for i, (part, _) in enumerate(parts)}
    last = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]), F.col("part")) if before else F.lit(None).cast("long")
    heads = heads.select("p", "key", F.coalesce(F.lag("p").over(Window.partitionBy("part").orderBy("p")), last).alias("target"))
    heads = Scratch(spark, "fingerprints").save(heads)
    few = F.broadcast(heads) if heads.count() <= BROADCAST_HEADS else heads
    ghosts = placed.join(few, ["p", "key"]).select("doc_id", "text", F.col("target").alias("p"), "key", F.lit(1).alias("ghost"))
    rows = with_fingerprint(placed.select("doc_id", "text", "p", "key", F.lit(0).alias("ghost")).union(ghosts), "text", "print")
    w = Window.partitionBy("p").orderBy("ghost", "key", "text")
    return rows.select("doc_id", "text", "print", "ghost", F.lead("text").over(w).alias("next_text"), F.lead("print").over(w).alias("next_print")).filter("ghost = 0").drop("ghost")


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is an empty one; a text without words has an empty fingerprint, one of 1 to 4 words has its whole sequence as its only shingle. Equal texts have equal
    fingerprints. A single row follows itself. Repeated rows are rows of their own, a text of any length is read whole. Other columns are ignored, whatever their names; an empty table
    gives an empty result.
    """
    pairs = successor_pairs(docs, id_col, text_col).withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    pairs = with_fingerprint(pairs, "edited_text", "edited_print")
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "edited_text",
        packed(F.col("print")).alias("fingerprint"),
        packed(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
