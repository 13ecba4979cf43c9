"""Sources of paginated documents: text with form feeds, one row per page, files, outlines; and test views of other tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scratch import Scratch

#: Siblings under one parent that count (fixed value).
SIBLINGS = 1000


def documents_from_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per text file under ``path`` (any file system of Spark): doc_id (hash of the path), source, text."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    return files.select(F.sha2("source", 256).alias("doc_id"), "source", "text")


def documents_from_bytes(spark: SparkSession, path: str, decode: Callable[[bytes], str]) -> DataFrame:
    """One document per binary file, its text (pages divided by form feeds) by ``decode``; one that fails has a null text and the error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for source, content in zip(pdf.path, pdf.content):
                try:
                    rows.append((source, decode(bytes(content)), None))
                except Exception as e:  # a bad file is a row, not a failed task
                    rows.append((source, None, str(e)))
            yield pd.DataFrame(rows, columns=["source", "text", "error"])

    return files.mapInPandas(run, "source string, text string, error string").withColumn("doc_id", F.sha2("source", 256))


def metadata(info: DataFrame) -> DataFrame:
    """doc_id, title, author, subject, creator, producer (empty is null), creation_date (null if it isn't a timestamp), page_count."""
    names = ("title", "author", "subject", "creator", "producer")
    return info.select("doc_id", *[F.nullif(F.col(n), F.lit("")).alias(n) for n in names], F.try_to_timestamp("creation_date").alias("creation_date"), "page_count")


def split_pages(text: Column, page_count: Column) -> Column:
    """Page texts: divided at form feeds, filled up with empty pages, cut to ``page_count``."""
    parts = F.split(F.coalesce(text, F.lit("")), "\f")
    return F.slice(F.concat(parts, F.array_repeat(F.lit(""), F.greatest(page_count - F.size(parts), F.lit(0)))), F.lit(1), page_count)


def pages(documents: DataFrame) -> DataFrame:
    """doc_id, page_no, text from doc_id, page_count, text."""
    return documents.select("doc_id", F.posexplode(split_pages(F.col("text"), F.col("page_count"))).alias("n", "text")).select("doc_id", (F.col("n") + 1).alias("page_no"), "text")


def outline(nodes: DataFrame, page_refs: DataFrame | None = None) -> DataFrame:
    """Table of contents in reading order: doc_id, toc_ord, level (depth), title, page_no.

    ``nodes``: doc_id, node_id, parent_id (null at the top), position among siblings, title, page_no. Missing titles are
    ``Untitled`` and missing pages 1; of the siblings under one parent the first 1000 by position count, whatever their positions are. With ``page_refs`` (doc_id, page_ref, page_no) nodes
    have page_ref instead of page_no, and an unknown one is page 1. Nodes that no top leads to, those in circles among them, are left out.

    Each join doubles how far up a node knows its way, so depth d takes log2(d) joins. A way has a step only where siblings part; of two nodes on one way the higher comes first.
    """
    scratch = Scratch(nodes.sparkSession, "outline")
    if page_refs is not None:
        known = page_refs.select("doc_id", "page_ref", "page_no").dropDuplicates(["doc_id", "page_ref"])
        nodes = nodes.drop("page_no").join(known, ["doc_id", "page_ref"], "left")
    family = Window.partitionBy("doc_id", "parent_id")
    ranked = nodes.withColumns({"rank": F.row_number().over(family.orderBy("position", "node_id")), "n": F.count("*").over(family)}).filter(f"rank <= {SIBLINGS}")
    step = F.when(F.col("n") > 1, F.lpad(F.col("rank").cast("string"), 4, "0")).otherwise("")
    way = scratch.save(ranked.select("doc_id", "node_id", "title", "page_no", F.col("parent_id").alias("above"), step.alias("path"), F.lit(1).alias("level")))
    whole, before = way.filter("above IS NULL").count(), -1
    while whole > before and not (part := way.filter("above IS NOT NULL")).isEmpty():
        up = way.select("doc_id", F.col("node_id").alias("above"), F.col("above").alias("next"), F.col("path").alias("head"), F.col("level").alias("more"))
        further = part.join(up, ["doc_id", "above"]).select("doc_id", "node_id", "title", "page_no", F.col("next").alias("above"), F.concat("head", "path").alias("path"), (F.col("level") + F.col("more")).alias("level"))
        old, way = way, scratch.save(way.filter("above IS NULL").union(further))
        scratch.drop(old)
        # Some node always comes to its top, but for those in circles.
        whole, before = way.filter("above IS NULL").count(), whole
    order = Window.partitionBy("doc_id").orderBy("path", "level")
    return way.filter("above IS NULL").select("doc_id", F.row_number().over(order).alias("toc_ord"), "level", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("title"), F.coalesce("page_no", F.lit(1)).alias("page_no"))


#: A customer's orders as the pages of a report; runs unchanged in Spark and DuckDB.
REPORT_SQL = """
SELECT o_custkey AS doc_id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_no,
  concat_ws(chr(10),
    CASE o_orderpriority
      WHEN '1-URGENT' THEN concat('Chapter ', CAST(o_orderkey % 20 + 1 AS STRING), ': Urgent')
      WHEN '2-HIGH' THEN concat('Section ', CAST(o_orderkey % 9 + 1 AS STRING), '.1 High')
      WHEN '3-MEDIUM' THEN 'MEDIUM PRIORITY'
      WHEN '4-NOT SPECIFIED' THEN '- not specified'
      ELSE 'low priority order' END,
    concat('Order ', CAST(o_orderkey AS STRING), ' was placed on ', CAST(CAST(o_orderdate AS DATE) AS STRING),
      ' for US$', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '.'),
    concat('  Due March ', CAST(o_orderkey % 28 + 1 AS STRING), ', 2020 at ', CAST(o_orderkey % 50 AS STRING), '%pa, 10 USD fee.'),
    '',
    'status  total',
    concat('contact cust', CAST(o_custkey AS STRING), '@example.com or https://example.com/o/', CAST(o_orderkey AS STRING), '.'),
    concat(o_orderstatus, '  ', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING))
  ) AS text
FROM orders
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def report_pages(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """doc_id, page_no, text of the reports; with ``spread`` in more tasks than the cluster has slots, for work that takes far longer than its bytes suggest."""
    # The customer is named before pages are numbered, and not named again, so that what goes by document later finds its rows dealt out already.
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "doc_id")
    if spread:
        # As many as are asked for stay apart; others are merged by their bytes to about one for each slot, and a few more are a second round of tasks as long as the first.
        orders = orders.repartition(4 * max(spark.sparkContext.defaultParallelism, orders.rdd.getNumPartitions()), "doc_id")
    return spark.sql(REPORT_SQL.replace("o_custkey AS doc_id", "doc_id").replace("o_custkey", "doc_id").replace("FROM orders", "FROM {orders}"), orders=orders).withColumn("page_no", F.col("page_no").cast("int"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``documents`` as a document of one page."""
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_no"), "text")
