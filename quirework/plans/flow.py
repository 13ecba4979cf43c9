"""Whole runs: pages to merged, formatted documents; flows, batches and their export."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import config
from ..functions.config import Flow, Output, Settings
from ..operators import agents, extract, fields, grouping, merge, model, output, parse, stats
from ..sources import file_sink


@dataclass
class Run:
    """Results of a run. What patterns find is lazy: nothing is computed before it is read; a model's replies were written when the run was made."""

    groups: DataFrame
    results: DataFrame
    merged: DataFrame
    statistics: DataFrame
    errors: DataFrame
    analyses: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)

    def formatted(self, fmt: str | None = None) -> DataFrame:
        """doc_id, output in the settings' format, or another with the defaults of an export."""
        return output.format_output(self.merged, Output(fmt) if fmt else self.settings.output)

    def fields(self, schema: str | None = None) -> DataFrame:
        """doc_id, and what a model extracted beyond the standard fields: as ``schema`` or the settings' says, the rest as an object (see ``fields.by_document``)."""
        schema = schema or self.settings.extraction.schema
        if not fields.is_schema(schema):
            raise ValueError("fields need a schema of columns and types")
        return fields.by_document(self.results, schema)


def run(
    pages: DataFrame, toc: DataFrame | None = None, settings: Settings = Settings(), client: model.Client | None = None, hooks: dict[str, Callable] | None = None, documents: DataFrame | None = None, agent: agents.Agent | None = None, agent_configs: DataFrame | None = None, now: str | None = None
) -> Run:
    """Parse, group, extract, merge.

    With a client a model groups the documents (unless the strategy is fixed) and extracts or enhances, as ``settings.extraction.mode`` says; each prompt is
    sent once, and replies are read from a table then. A document that cannot be grouped and a group that cannot be extracted are rows of ``errors`` and stop nothing else. ``agent`` extracts instead, if given.
    ``documents``: doc_id, title, author, for prompts; ``agent_configs``: see ``agents.with_configs``; ``now``: time stamp of the outputs.

    ``hooks``: callables by name, on_<stage>_start and on_<stage>_complete for parse, grouping, analysis (with a client), extraction and merge, called with that stage's
    input or result while the plan is built; on_extraction_tick, with a client, while its calls run, with how many are done, how many of these failed, and of how many; on_extraction_progress with the rows of ``stats.progress``, and on_error with the rows of ``errors``.
    """
    call = lambda name, *a: (hooks or {}).get(name, lambda *_: None)(*a)
    spark = pages.sparkSession
    g, x, p = settings.grouping, settings.extraction, settings.parsing
    call("on_parse_start", pages)
    elements = parse.elements(pages, p.headings, p.lists, p.patterns, offsets=False)
    kind = dict(pages.dtypes)["doc_id"]
    contents = toc if toc is not None else spark.createDataFrame([], f"doc_id {kind}, toc_ord int, level int, title string, page_no int")
    call("on_parse_complete", elements)
    call("on_grouping_start", elements)
    analysed, lost = None, None
    if client is not None and g.strategy != "fixed":
        call("on_analysis_start", pages)
        groups, analysed, lost = model.group_documents(pages, client, toc, documents, g.strategy, settings.execution)
        call("on_analysis_complete", analysed)
    else:
        groups = grouping.grouper(g.strategy)(pages, elements, contents, g)
    call("on_grouping_complete", groups)
    call("on_extraction_start", groups)
    if agent is None and client is None:
        agent = agents.pattern_agent(x, p, now)
    elif agent is None and x.mode == "enhance":
        agent = agents.enhancing_agent(client, x, p, settings.execution, agent_configs, now, (hooks or {}).get("on_extraction_tick"))
    elif agent is None:
        agent = agents.model_agent(client, x, settings.execution, agent_configs, now, (hooks or {}).get("on_extraction_tick"))
    results = agent(extract.group_rows(groups, pages))
    call("on_extraction_progress", stats.progress(results))
    call("on_extraction_complete", results)
    call("on_merge_start", results)
    merged = merge.merged(results, settings.merging, now)
    call("on_merge_complete", merged)
    errors = agents.errors(results)
    if lost is not None:
        errors = lost.select("doc_id", F.lit(None).cast("string").alias("group_id"), F.lit("grouping").alias("stage"), "message").union(errors)
    call("on_error", errors)
    return Run(groups, results, merged, stats.pipeline_statistics(pages, results, lost), errors, analysed, settings)


def run_flow(flow: Flow, pages: DataFrame, toc: DataFrame | None = None, client: model.Client | None = None, settings: Settings = Settings(), **options) -> Run:
    own = settings.with_(grouping={"strategy": flow.strategy}, extraction={"prompt": flow.prompt or settings.extraction.prompt})
    return run(pages, toc, own, client, **options)


@dataclass
class Job:
    """A flow over some documents, one execution each."""

    job_id: str
    flow: Flow
    run: Run

    def executions(self) -> DataFrame:
        """job_id, execution_id, doc_id, flow_name, status, has_result: an execution failed if its document's run did, a partial one is completed."""
        own = F.sha2(F.concat_ws("|", F.lit(self.job_id), F.col("doc_id").cast("string")), 256)
        failed = F.col("status") == "failed"
        return self.run.statistics.select(F.lit(self.job_id).alias("job_id"), own.alias("execution_id"), "doc_id", F.lit(self.flow.name).alias("flow_name"), F.when(failed, "failed").otherwise("completed").alias("status"), F.lit(True).alias("has_result"))

    def status(self) -> DataFrame:
        return stats.batch_status(self.executions())

    def export(self, fmt: str) -> DataFrame:
        """execution_id, output of the executions that have a result; of one that failed the output is that of an empty document."""
        own = self.executions().filter("has_result").select("execution_id", "doc_id").join(self.run.formatted(fmt), "doc_id", "left")
        empty = {"markdown": "", "summary": "Summary:\nNo summary available.\n\nSections: 0\nEntities: 0\nTables: 0", "search-index": '{\n  "documents": [],\n  "metadata": {}\n}'}
        return own.select("execution_id", F.coalesce("output", F.lit(empty.get(fmt, '{\n  "sections": [],\n  "entities": [],\n  "tables": [],\n  "metadata": {}\n}'))).alias("output"))


    def export_files(self, path: str, fmt: str, folders: int = 0) -> None:
        """Writes the export as files named by execution, all of them or none; what was under ``path`` goes when they are there."""
        files = self.export(fmt).select(F.col("execution_id").alias("name"), F.col("output").alias("content"))
        file_sink.write_files(files, path, file_sink.EXTENSIONS.get(fmt, ".json"), folders=folders)


class Flows:
    """Flows run one after another with a client (or by patterns without one), and what became of them. Holds plans, not rows."""

    def __init__(self, client: model.Client | None = None, settings: Settings = Settings()):
        self.client, self.settings, self._jobs = client, settings, {}

    @staticmethod
    def create(name: str, **options) -> Flow:
        return Flow(name, **options)

    @staticmethod
    def from_preset(preset: str, **overrides) -> Flow:
        return config.flow(preset, **overrides)

    def execute(self, flow: Flow, pages: DataFrame, toc: DataFrame | None = None, job_id: str | None = None, **options) -> Job:
        """A job over all documents of ``pages``; one document is a batch of one."""
        job = Job(job_id or uuid.uuid4().hex, flow, run_flow(flow, pages, toc, self.client, self.settings, **options))
        self._jobs[job.job_id] = job
        return job

    def job(self, job_id: str) -> Job:
        if job_id not in self._jobs:
            raise ValueError(f"batch job {job_id} not found")
        return self._jobs[job_id]

    def jobs(self) -> list[Job]:
        return list(self._jobs.values())

    def executions(self, job_id: str | None = None, status: str | None = None) -> DataFrame | None:
        """Executions of one job or all, of one status or all; None where there is no job."""
        found = [j.executions() for j in ([self.job(job_id)] if job_id else self.jobs())]
        if not found:
            return None
        out = found[0]
        for df in found[1:]:
            out = out.union(df)
        return stats.executions_with_result(out, status)

    def execution(self, execution_id: str) -> DataFrame | None:
        every = self.executions()
        return every.filter(F.col("execution_id") == execution_id) if every is not None else None

    def export(self, job_id: str, fmt: str) -> DataFrame:
        return self.job(job_id).export(fmt)


def batch(job_id: str, flow: Flow, pages: DataFrame, toc: DataFrame | None = None, client: model.Client | None = None) -> tuple[Run, DataFrame]:
    """A flow over all documents as one job, and its executions."""
    job = Flows(client).execute(flow, pages, toc, job_id)
    return job.run, job.executions()


def export(run_: Run, path: str, fmt: str | None = None) -> None:
    """Writes the formatted documents of a run as Parquet."""
    run_.formatted(fmt).write.mode("overwrite").parquet(path)


def export_files(run_: Run, path: str, fmt: str | None = None, folders: int = 0) -> None:
    """Writes the formatted documents of a run as files named by document, all of them or none."""
    files = run_.formatted(fmt).select(F.col("doc_id").cast("string").alias("name"), F.col("output").alias("content"))
    file_sink.write_files(files, path, file_sink.EXTENSIONS.get(fmt or run_.settings.output.format, ".json"), folders=folders)
