"""Corpus pipeline over ``documents``: toxicity, near-duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import mixing, near_dups, packing, substring_dups, toxicity
from quirework.llm.queries import SOURCE_WEIGHTS, small_batches
from quirework.functions.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5. Rows are matched by id and text, so repeats and null ids fare alike."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(*toxicity.training_sample(docs, labels))
    return toxicity.keep_clean(docs, model).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near-duplicates.

    Rows are matched by id and text, so of rows that share an id only those whose own text is a near-duplicate go. Rows without an id, null and empty texts stay, and so
    do rows that repeat a kept document.
    """
    small_batches(spark)
    gone = near_dups.near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("seq").alias("gone_text")).distinct()
    if gone.count() <= near_dups.BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.select(COLUMNS).join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_text")), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and more that a document with a smaller id holds; all rows stay, those without an id or text as they are."""
    small_batches(spark)
    out = substring_dups.remove_repeats(docs, keep=("lang", "source"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the sources' target weights, in a global random order. A null source is a source, a null id or text a value like others."""
    small_batches(spark)
    return mixing.mix_sources(docs, SOURCE_WEIGHTS, epochs=1.0, seed=17).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids. Rows are dealt by their place in the mix's files, so copies of a document lie in different groups."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("source_mix", mix),
    ("packing", pack),
]

#: Training a classifier and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = Scratch(spark, "pipeline"), None
    for _, stage in STAGES:
        done = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        docs = before = done
    return docs
