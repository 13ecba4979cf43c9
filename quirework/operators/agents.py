"""Agents: what makes results of groups. An agent takes rows of ``extract.group_rows`` and returns results as ``extract.extracted`` does."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.config import Execution, Extraction, Parsing
from ..functions.scratch import Scratch
from . import extract, model
from .progress import OnProgress

Agent = Callable[[DataFrame], DataFrame]


def with_configs(rows: DataFrame, configs: DataFrame | None) -> DataFrame:
    """Rows of groups with custom_prompt, max_retries and call_timeout_ms of their own, null where ``configs`` (group_id, and any of custom_prompt, max_retries, timeout_ms) has none for a group."""
    kinds = {"custom_prompt": ("custom_prompt", "string"), "max_retries": ("max_retries", "int"), "timeout_ms": ("call_timeout_ms", "int")}
    if configs is None:
        return rows.withColumns({name: F.lit(None).cast(kind) for name, kind in kinds.values()})
    own = configs.select("group_id", *[(F.col(c) if c in configs.columns else F.lit(None)).cast(kind).alias(name) for c, (name, kind) in kinds.items()])
    return rows.join(own.dropDuplicates(["group_id"]), "group_id", "left").select(*rows.columns, *[name for name, _ in kinds.values()])


def pattern_agent(extraction: Extraction = Extraction(), parsing: Parsing = Parsing(), now: str | None = None) -> Agent:
    """Results by patterns."""
    return lambda rows: extract.extracted(rows, extraction, parsing, now)


def _replies(rows: DataFrame, client: model.Client, extraction: Extraction, execution: Execution, configs: DataFrame | None, on_progress: OnProgress | None = None) -> DataFrame:
    prompts = model.extraction_prompts(with_configs(rows, configs), extraction.prompt, extraction.schema)
    return model.called(prompts.select("doc_id", "group_ord", "system", "prompt", "max_retries", "call_timeout_ms"), client, execution, on_progress=on_progress)


def model_agent(client: model.Client, extraction: Extraction = Extraction(), execution: Execution = Execution(), configs: DataFrame | None = None, now: str | None = None, on_progress: OnProgress | None = None) -> Agent:
    """Results that are a model's replies, each group asked once."""
    return lambda rows: model.extracted(rows, _replies(rows, client, extraction, execution, configs, on_progress), now)


def enhancing_agent(client: model.Client, extraction: Extraction = Extraction(), parsing: Parsing = Parsing(), execution: Execution = Execution(), configs: DataFrame | None = None, now: str | None = None, on_progress: OnProgress | None = None) -> Agent:
    """Results by patterns with a model's fields over them."""
    return lambda rows: model.enhanced(extract.extracted(rows, extraction, parsing, now), _replies(rows, client, extraction, execution, configs, on_progress))


#: Makers of agents by name. ``register`` adds to them.
FACTORIES: dict[str, Callable[..., Agent]] = {"patterns": pattern_agent, "model": model_agent, "enhance": enhancing_agent}


def register(name: str, factory: Callable[..., Agent]) -> None:
    FACTORIES[name] = factory


def create(name: str, **options) -> Agent:
    if name not in FACTORIES:
        raise ValueError(f"unknown agent: {name}")
    return FACTORIES[name](**options)


def errors(results: DataFrame) -> DataFrame:
    """doc_id, group_id, stage, message of the groups that failed."""
    return results.filter(~F.coalesce(F.col("success"), F.lit(False))).select("doc_id", "group_id", F.lit("extraction").alias("stage"), F.coalesce("error", F.lit("Unknown error")).alias("message"))


class Orchestrator:
    """Runs an agent over groups as Spark jobs of one job group, which can be watched, waited for and cancelled."""

    def __init__(self, agent: Agent | None = None):
        self.agent, self.group = agent, f"quirework-{uuid.uuid4().hex}"

    def _own(self) -> Agent:
        if self.agent is None:
            raise ValueError("no agent is set")
        return self.agent

    def execute(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Results of all groups, written once, and errors; a group that fails stops no other."""
        context, agent = rows.sparkSession.sparkContext, self._own()
        before = context.getLocalProperty("spark.jobGroup.id")
        context.setJobGroup(self.group, "results of groups", interruptOnCancel=True)
        try:
            results = Scratch(rows.sparkSession, "results").save(agent(rows))
        finally:
            context.setLocalProperty("spark.jobGroup.id", before)
        return results, errors(results)

    def execute_single(self, rows: DataFrame, group_id: str) -> DataFrame:
        """The result of one group."""
        return self._own()(rows.filter(F.col("group_id") == group_id))

    def _stages(self, rows: DataFrame) -> list:
        tracker = rows.sparkSession.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(self.group)]
        return [s for j in jobs if j and j.status == "RUNNING" for s in map(tracker.getStageInfo, j.stageIds) if s]

    def stats(self, rows: DataFrame) -> dict[str, int]:
        """Tasks of running jobs: pending, active, and both together."""
        own = self._stages(rows)
        active = sum(s.numActiveTasks for s in own)
        pending = sum(s.numTasks - s.numCompletedTasks - s.numActiveTasks for s in own)
        return {"pending": pending, "active": active, "size": pending + active}

    def drain(self, rows: DataFrame, poll_s: float = 0.2) -> None:
        """Waits until no job of this orchestrator runs."""
        while self._stages(rows):
            time.sleep(poll_s)

    def clear(self, rows: DataFrame) -> None:
        """Cancels the jobs that run."""
        rows.sparkSession.sparkContext.cancelJobGroup(self.group)


#: What an agent of rows is made of: called for each document, it gives what is called for each of its groups, in order, with a dictionary of the group's columns.
MakeRowAgent = Callable[[], Callable[[dict], dict]]


def _told(call: Callable[[dict], dict], group: dict, names: list[str]) -> tuple:
    """The fields that an agent gives for a group, success and error; an agent that fails gives a failed row."""
    try:
        out = call(group)
        return (*[out.get(n) for n in names], True, None)
    except Exception as e:
        return (*[None] * len(names), False, str(e) or type(e).__name__)


def _row_schema(rows: T.StructType, own: list[T.StructField]) -> tuple[list[str], list[str], T.StructType]:
    """Columns of the groups that stay, the agent's fields, and both with success and error."""
    names = [f.name for f in own]
    kept = [f for f in rows.fields if f.name not in {*names, "success", "error"}]
    return [f.name for f in kept], names, T.StructType([*kept, *own, T.StructField("success", T.BooleanType()), T.StructField("error", T.StringType())])


def row_agent(make: MakeRowAgent, schema: str) -> Agent:
    """An agent from a Python function of one group: the columns of its rows, the fields of ``schema`` that it gives, success and error.

    Rows of a document come in order to one call of ``make``, and one after the other: a document of any number of groups passes through.
    """

    def agent(rows: DataFrame) -> DataFrame:
        kept, names, out = _row_schema(rows.schema, T._parse_datatype_string(schema).fields)

        def run(batches):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow, call, last = to_arrow_schema(out), None, object()
            for batch in batches:
                told = []
                for group in batch.to_pylist():
                    if call is None or group["doc_id"] != last:
                        call, last = make(), group["doc_id"]
                    told.append((*[group[k] for k in kept], *_told(call, group, names)))
                if told:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told), arrow)], schema=arrow)

        return rows.repartition("doc_id").sortWithinPartitions("doc_id", "group_ord").mapInArrow(run, out)

    return agent


def sql_agent(spark: SparkSession, name: str, make: MakeRowAgent, schema: str) -> None:
    """Makes an agent of rows a table function: ``SELECT * FROM name(TABLE(groups) PARTITION BY doc_id ORDER BY group_ord)``.

    Its columns follow from the table that it is given. Each partition is a document, as for ``row_agent``.
    """
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

    # Read here: where a call is analysed there is no session.
    own = T._parse_datatype_string(schema).fields
    names = [f.name for f in own]
    # Whatever the table's columns, those that stay are what isn't told anew.
    told = {*names, "success", "error"}

    class RowAgent:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError("a table of groups is required")
            return AnalyzeResult(schema=_row_schema(table.dataType, own)[2])

        def __init__(self):
            self.call = None

        def eval(self, table):
            self.call = self.call or make()
            group = table.asDict(recursive=True)
            yield (*[v for k, v in zip(table.__fields__, table) if k not in told], *_told(self.call, group, names))

    spark.udtf.register(name, F.udtf(RowAgent))
