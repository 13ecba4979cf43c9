"""Catalogue of uploaded documents, a table: doc_id, title, author, page_count, strategy, uploaded_at."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import Grouping
from ..functions.text import preview
from . import grouping as G
from . import parse
from .extract import group_rows


def listing(catalogue: DataFrame) -> DataFrame:
    return catalogue.orderBy("uploaded_at", "doc_id")


def get(catalogue: DataFrame, doc_id) -> DataFrame:
    return catalogue.filter(F.col("doc_id") == F.lit(doc_id))


def get_group(groups: DataFrame, doc_id, group_id: str) -> DataFrame:
    return groups.filter((F.col("doc_id") == F.lit(doc_id)) & (F.col("group_id") == F.lit(group_id)))


def delete(catalogue: DataFrame, gone: DataFrame) -> DataFrame:
    """The catalogue without the documents of ``gone`` (doc_id)."""
    return catalogue.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def summaries(groups: DataFrame) -> DataFrame:
    return groups.select("doc_id", "group_id", "title", "start_page", "end_page", "type", "page_count")


def previews(pages: DataFrame, limit: int = 200) -> DataFrame:
    return pages.select("doc_id", "page_no", preview(F.col("text"), limit).alias("preview"))


def select_groups(groups: DataFrame, group_ids: list[str] | None) -> DataFrame:
    """Groups with these ids; no list, or an empty one, is all."""
    return groups.filter(F.col("group_id").isin(list(group_ids))) if group_ids else groups


def routed_groups(groups: DataFrame, routed: DataFrame) -> DataFrame:
    """Groups that a router chose (doc_id, group_id)."""
    return groups.join(routed.select("doc_id", "group_id"), ["doc_id", "group_id"], "left_semi")


def health(catalogue: DataFrame, model_configured: bool = False) -> DataFrame:
    return catalogue.agg(F.count("*").alias("documents_stored")).withColumn("model_configured", F.lit(model_configured))


def listing_with_groups(catalogue: DataFrame, groups: DataFrame) -> DataFrame:
    """The catalogue in order of upload, with the number of groups of each document."""
    n = groups.groupBy("doc_id").agg(F.count("*").alias("group_count"))
    return listing(catalogue.join(n, "doc_id", "left").withColumn("group_count", F.coalesce("group_count", F.lit(0))))


def details(catalogue: DataFrame, groups: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """The catalogue with ``groups`` (group_id, title, start_page, end_page, type) and ``toc`` (level, title, page_no) of each document as arrays in order; a document without a table of contents has a null one."""
    fields = ("group_id", "title", "start_page", "end_page", "type")
    g = groups.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("group_ord", *fields))).alias("g"))
    out = catalogue.join(g.select("doc_id", F.transform("g", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("groups")), "doc_id", "left")
    if toc is None:
        return out.withColumn("toc", F.lit(None).cast("array<struct<level:int,title:string,page_no:int>>"))
    t = toc.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("toc_ord", "level", "title", "page_no"))).alias("t"))
    return out.join(t.select("doc_id", F.transform("t", lambda x: F.struct(x["level"].alias("level"), x["title"].alias("title"), x["page_no"].alias("page_no"))).alias("toc")), "doc_id", "left")


def group_details(groups: DataFrame, pages: DataFrame, limit: int = 200) -> DataFrame:
    """doc_id, group_id, title, start_page, end_page, type, page_count, preview: the beginnings of the group's pages as an array of (page_no, preview)."""
    rows = group_rows(groups, pages)
    return rows.select("doc_id", "group_id", "title", "start_page", "end_page", "type", "page_count", F.transform("pages", lambda p: F.struct(p["page_no"].alias("page_no"), preview(p["text"], limit).alias("preview"))).alias("preview"))


class Store:
    """Parquet tables under ``path`` (any file system of Spark): catalogue, pages, elements, groups, toc.

    Every upload writes its rows under its own number and then one row of the log, which is what makes them count: an upload that breaks
    off leaves no document. A deletion is a row of the log, too.
    """

    TABLES = ("catalogue", "pages", "elements", "groups", "toc")

    def __init__(self, spark: SparkSession, path: str, client=None):
        self.spark, self.path, self.client = spark, path.rstrip("/"), client

    def _log(self, name: str) -> DataFrame | None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{name}")
        there = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.parquet(f"{self.path}/log/{name}") if there else None

    def _note(self, name: str, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/log/{name}")

    def table(self, name: str) -> DataFrame:
        """Rows of uploads that are whole, without those deleted since."""
        uploads = self._log("uploads")
        if uploads is None:
            raise ValueError("nothing was uploaded yet")
        rows = self.spark.read.parquet(f"{self.path}/{name}").join(F.broadcast(uploads.select("upload")), "upload", "left_semi")
        gone = self._log("deletions")
        return (rows if gone is None else rows.join(gone, ["doc_id", "upload"], "left_anti")).drop("upload")

    def upload(self, documents: DataFrame, pages: DataFrame, toc: DataFrame | None = None, settings: Grouping = Grouping()) -> None:
        """Adds documents (doc_id, title, author) with their pages, classified and grouped; with a client the model groups them unless the strategy is fixed, and says what type they are."""
        if documents is None or pages is None:
            raise ValueError("documents and pages are required")
        from . import model

        kind = dict(pages.dtypes)["doc_id"]
        contents = toc if toc is not None else self.spark.createDataFrame([], f"doc_id {kind}, toc_ord int, level int, title string, page_no int")
        elements, types = parse.elements(pages), None
        if self.client is not None:
            named, analysed, _ = model.group_documents(pages, self.client, toc, documents, settings.strategy)
            types = analysed.select("doc_id", "document_type")
        groups = named if types is not None and settings.strategy != "fixed" else G.grouper(settings.strategy)(pages, elements, contents, settings)
        catalogue = documents.join(G.page_counts(pages), "doc_id", "left")
        catalogue = catalogue.join(types, "doc_id", "left") if types is not None else catalogue.withColumn("document_type", F.lit(None).cast("string"))
        catalogue = catalogue.select("doc_id", "title", "author", F.coalesce("n", F.lit(0)).alias("page_count"), F.lit(settings.strategy).alias("strategy"), "document_type", F.current_timestamp().alias("uploaded_at"))
        upload = "u" + uuid.uuid4().hex
        for name, df in zip(self.TABLES, (catalogue, pages, elements, groups, contents)):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/upload={upload}")
        self._note("uploads", self.spark.range(1).select(F.lit(upload).alias("upload"), F.current_timestamp().alias("at")))

    def delete(self, doc_id) -> bool:
        """Whether there was such a document; it is gone then."""
        own = self.spark.read.parquet(f"{self.path}/catalogue").select("doc_id", "upload").filter(F.col("doc_id") == F.lit(doc_id))
        if get(self.table("catalogue"), doc_id).isEmpty():
            return False
        self._note("deletions", own)
        return True
