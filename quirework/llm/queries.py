"""One thin query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, languages, licences, main_text, mixing, near_dups, packing, resampling, runs, substring_dups, token_counts, toxicity, vector_dups


#: Rows and bytes of an Arrow batch, in the JVM and in the workers.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dups.remove_repeats(_table(spark, sf_dir, "documents"))
    words = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), F.lit(" "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: Target weights of the sources; sources that aren't listed weigh 1.
SOURCE_WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 0.5}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"), SOURCE_WEIGHTS, epochs=1.0, seed=17)
    return out.select("doc_id", "source", "text", "mix_copy", "mix_copies", "mix_key")


def op3_oph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(*toxicity.training_sample(docs, _table(spark, sf_dir, "labels")))
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", toxicity.held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = languages.identify_languages(docs, languages.fit(*languages.training_sample(docs)))
    return out.select("doc_id", toxicity.held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op5_pq_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, min_words=20, seed=2024)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(_table(spark, sf_dir, "pages"), keep=("page_id", "url"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.periodic_runs(runs.with_periodic_tails(_table(spark, sf_dir, "documents")))
    best = out.withColumn("best", runs.longest_by_exponent(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
