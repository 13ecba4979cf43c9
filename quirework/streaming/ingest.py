"""Pages that arrive as a stream: classified lines, and counts by time window. An extension; batch operators are reused as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract, parse


def elements(pages: DataFrame) -> DataFrame:
    """Elements of streamed pages (doc_id, page_no, text): row by row, no state."""
    return parse.elements(pages)


def entities(pages: DataFrame) -> DataFrame:
    return extract.page_entities(pages)


def window_counts(events: DataFrame, time_col: str = "ts", key_col: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows by time window and key, with a watermark. Times without a zone are read as UTC session time."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    return timed.groupBy(F.window(time_col, width).alias("w"), key_col).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key_col, "n")
