"""Counts, times and status of runs and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_statistics(results: DataFrame) -> DataFrame:
    """doc_id, total_groups, successful_groups, failed_groups, total_duration, average_duration, total_tokens, status.

    ``results``: doc_id, success, duration_ms, tokens_used (null counts 0).
    """
    good = F.coalesce(F.col("success"), F.lit(False))
    out = results.groupBy("doc_id").agg(
        F.count("*").alias("total_groups"),
        F.count_if(good).alias("successful_groups"),
        F.count_if(~good).alias("failed_groups"),
        F.sum("duration_ms").alias("total_duration"),
        F.avg("duration_ms").alias("average_duration"),
        F.sum(F.coalesce("tokens_used", F.lit(0))).alias("total_tokens"),
    )
    return out.withColumn("status", F.when(F.col("failed_groups") == 0, "success").when(F.col("successful_groups") == 0, "failed").otherwise("partial"))


def pipeline_statistics(pages: DataFrame, results: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """As ``run_statistics``, and total_pages, for every document of ``pages``: one without groups succeeded, one of ``failed`` (doc_id, message) could not be grouped and failed."""
    zero = ("total_groups", "successful_groups", "failed_groups", "total_duration", "average_duration", "total_tokens")
    out = pages.groupBy("doc_id").agg(F.max("page_no").alias("total_pages")).join(run_statistics(results), "doc_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}).withColumn("status", F.coalesce("status", F.lit("success")))
    if failed is not None:
        out = out.join(failed.select("doc_id", F.lit(True).alias("lost")).distinct(), "doc_id", "left").withColumn("status", F.when(F.col("lost"), "failed").otherwise(F.col("status"))).drop("lost")
    return out


def progress(results: DataFrame) -> DataFrame:
    """doc_id, group_id, completed, total: how many of a document's groups were done when each was, in the order of groups; failed ones don't count as completed."""
    order = Window.partitionBy("doc_id").orderBy("group_ord")
    done = F.coalesce(F.col("success"), F.lit(False)).cast("int")
    return results.select("doc_id", "group_id", "success", F.sum(done).over(order).alias("completed"), F.count("*").over(Window.partitionBy("doc_id")).alias("total")).filter("success").drop("success")


def batch_status(executions: DataFrame) -> DataFrame:
    """job_id, completed, failed, status of jobs from the executions' status: a partial execution counts as completed."""
    failed = F.col("status") == "failed"
    out = executions.groupBy("job_id").agg(F.count_if(~failed & F.col("status").isNotNull()).alias("completed"), F.count_if(failed).alias("failed"))
    return out.withColumn("job_status", F.when(F.col("failed") == 0, "completed").when(F.col("completed") == 0, "failed").otherwise("partial"))


def executions_with_result(executions: DataFrame, status: str | None = None) -> DataFrame:
    """Executions that have a result, of one status or all."""
    own = executions.filter(F.col("has_result"))
    return own.filter(F.col("status") == status) if status else own
