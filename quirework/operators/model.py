"""Language-model steps behind one interface. The mock is offline and deterministic; a model is called in Arrow batches on the executors."""

from __future__ import annotations

import json
import re
import threading
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import EXTRACTION_PROMPT, Execution
from ..functions.scratch import Scratch
from ..functions.text import json_object, or_default
from . import grouping
from .extract import ENTITIES, SECTIONS, TABLES, joined, outcome, stamp
from .fields import bag
from .progress import Counters, OnProgress, watched
from .replies import ReplyLog, TaskLog, prompt_key

Message = dict[str, str]
#: Groups (doc_id, group_id) that bear on a question, of all groups.
Router = Callable[[str, DataFrame], DataFrame]


@dataclass(frozen=True)
class Reply:
    content: str
    tokens: int = 0


class Client(Protocol):
    """What a model is asked through. A client may also have ``complete_json``, which replies with a JSON object at once."""

    def complete(self, messages: list[Message]) -> Reply: ...


class MockClient:
    """Answers with the beginning of the last message, and with an empty object where JSON is asked for."""

    def complete(self, messages: list[Message]) -> Reply:
        return Reply("Mock response for: " + messages[-1]["content"][:100] + "...", 150)

    def complete_json(self, messages: list[Message]) -> Reply:
        return Reply("{}")


#: Asks for JSON alone (own wording).
JSON_ONLY = "Reply with one JSON object and nothing else."


def complete_json(client: Client, messages: list[Message]) -> Reply:
    """A reply whose content is a JSON object: from the first brace to the last of what the model wrote. Anything else is an error."""
    own = getattr(client, "complete_json", None)
    reply = own(messages) if own else client.complete([*messages, {"role": "system", "content": JSON_ONLY}])
    found = re.search(r"\{[\s\S]*\}", reply.content)
    text = found[0] if found else reply.content
    try:
        ok = isinstance(json.loads(text), dict)
    except ValueError as e:
        raise ValueError(f"no JSON in the reply: {e}") from e
    if not ok:
        raise ValueError("no JSON object in the reply")
    return Reply(text, reply.tokens)


def system_prompt(base: str, context: str | None = None) -> str:
    """A system prompt with what a caller adds to it."""
    return f"{base}\n\n{context}" if context else base


@dataclass(frozen=True)
class HttpClient:
    """A chat-completion endpoint."""

    api_key: str
    base_url: str = "https://api.openai.com/v1"
    model: str = "gpt-4"
    temperature: float = 0.3
    max_tokens: int = 4096
    timeout_s: float = 60

    def complete(self, messages: list[Message]) -> Reply:
        body = json.dumps({"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens}).encode()
        request = urllib.request.Request(f"{self.base_url}/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
        with urllib.request.urlopen(request, timeout=self.timeout_s) as response:
            got = json.load(response)
        return Reply(got["choices"][0]["message"]["content"], got.get("usage", {}).get("total_tokens", 0))


def create_client(provider: str = "mock", **options) -> Client:
    if provider == "mock":
        return MockClient()
    if provider != "openai":
        raise ValueError(f"unknown provider: {provider}")
    if not options.get("api_key"):
        raise ValueError("an API key is required")
    return HttpClient(**options)


def _within(call: Callable[[], Reply], seconds: float) -> Reply:
    """What ``call`` returns or raises, or TimeoutError after so many seconds; a call that never ends is left behind."""
    done: list = []

    def target() -> None:
        try:
            done.append((call(), None))
        except Exception as e:
            done.append((None, e))

    thread = threading.Thread(target=target, daemon=True)
    thread.start()
    thread.join(seconds)
    if not done:
        raise TimeoutError(f"no reply within {round(seconds * 1000)} ms")
    reply, error = done[0]
    if error is not None:
        raise error
    return reply


def windows(spark: SparkSession, limit: int | None) -> tuple[int, int | None]:
    """(calls in flight in a task, number of tasks or None for those of the data) that keep the calls in flight within ``limit``.

    With room for every task slot of the cluster tasks are many and each has its share; else there are as many tasks as calls. Slots that may come later count too.
    """
    if not limit:
        return 1, None
    conf, slots = spark.sparkContext.getConf(), spark.sparkContext.defaultParallelism
    if conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        most = conf.get("spark.dynamicAllocation.maxExecutors")
        slots = int(most) * int(conf.get("spark.executor.cores", "1")) if most else limit + 1
    if slots > limit:
        return 1, limit
    return limit // slots, max(slots, int(spark.conf.get("spark.sql.shuffle.partitions")))


def run(
    prompts: DataFrame, client: Client, retries: int = 3, delay_ms: int = 1000, max_concurrency: int | None = None, timeout_ms: int | None = None, as_json: bool = False, continue_on_error: bool = False, log: ReplyLog | None = None, counters: Counters | None = None
) -> DataFrame:
    """Adds response, tokens_used, duration_ms, success, error to rows with columns system and prompt.

    A prompt that fails after its retries is a row with the error, never a failed task. ``max_concurrency`` bounds the calls in flight,
    ``timeout_ms`` the time of each call. With ``as_json`` a reply that holds no JSON object has failed. With ``continue_on_error`` a call that fails is not
    tried again, only one that ran out of time is. Columns max_retries and call_timeout_ms, if there are any, go before ``retries`` and ``timeout_ms`` in their row.
    Replies go to ``log`` as they come, if one is given, under the column prompt_key; a task that starts again sends none that it has there. ``counters``: see ``progress``.
    """
    window, tasks = windows(prompts.sparkSession, max_concurrency)
    if tasks:
        prompts = prompts.repartition(tasks)
    if timeout_ms and isinstance(client, HttpClient):
        client = replace(client, timeout_s=timeout_ms / 1000)
    this_run = uuid.uuid4().hex

    def ask(messages: list[Message]) -> Reply:
        return complete_json(client, messages) if as_json else client.complete(messages)

    def one(row: dict, own_log: TaskLog | None) -> tuple:
        if own_log and row["prompt_key"] in own_log.known:
            return own_log.known[row["prompt_key"]]
        own = lambda name, default: default if row.get(name) is None or row[name] != row[name] else int(row[name])
        limit, tries = own("call_timeout_ms", timeout_ms), own("max_retries", retries) + 1
        messages = [{"role": "system", "content": row["system"]}, {"role": "user", "content": row["prompt"]}]
        began, error, reply = time.monotonic(), None, None
        for attempt in range(tries):
            try:
                reply = _within(lambda: ask(messages), limit / 1000) if limit else ask(messages)
                break
            except Exception as e:
                error = str(e)
                if continue_on_error and not isinstance(e, TimeoutError):
                    break
                if attempt < tries - 1:
                    time.sleep(delay_ms / 1000 * 2**attempt)
        took = int(1000 * (time.monotonic() - began))
        if reply is None:
            return None, 0, took, False, error
        if own_log:
            own_log.add(row["prompt_key"], reply.content, reply.tokens, took)
        return reply.content, reply.tokens, took, True, None

    def batch(batches: Iterator) -> Iterator:
        own_log = TaskLog(log, this_run) if log else None
        with ThreadPoolExecutor(window) as pool:
            for pdf in batches:
                rows = pdf.to_dict("records")
                # In the rows' order; of a batch so many are in flight as the window has.
                out = list(pool.map(lambda row: one(row, own_log), rows) if window > 1 else (one(row, own_log) for row in rows))
                if counters:
                    counters.done.add(len(out))
                    counters.failed.add(sum(not o[3] for o in out))
                for k, name in enumerate(("response", "tokens_used", "duration_ms", "success", "error")):
                    pdf[name] = [o[k] for o in out]
                yield pdf
        if own_log:
            own_log.close()

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema], "response string, tokens_used long, duration_ms long, success boolean, error string"])
    return prompts.mapInPandas(batch, schema)


def _asked(rows: DataFrame, options: tuple, log: ReplyLog | None, scratch: Scratch, on_progress: OnProgress | None) -> DataFrame:
    if on_progress is None:
        return scratch.save(run(rows, *options, log=log))
    with watched(rows.sparkSession, on_progress, rows.count()) as counters:
        return scratch.save(run(rows, *options, log=log, counters=counters))


def called(prompts: DataFrame, client: Client, execution: Execution = Execution(), as_json: bool = True, name: str = "replies", on_progress: OnProgress | None = None) -> DataFrame:
    """``run`` under a run's settings, its rows written once: whatever reads them, each prompt is sent once.

    With a folder of replies in the settings, prompts that have one there aren't sent, and one that several rows share is sent once; ``sent`` says of each row whether this run asked.
    ``on_progress`` is called while calls run (see ``progress``); the prompts are written first then, so that their number is known.
    """
    if on_progress:
        prompts = Scratch(prompts.sparkSession, name).save(prompts)
    e, scratch = execution, Scratch(prompts.sparkSession, name)
    options = (client, e.retries, e.retry_delay_ms, e.max_concurrency, e.timeout_ms, as_json, e.continue_on_error)
    asking = lambda rows, log: _asked(rows, options, log, scratch, on_progress)
    if e.replies is None:
        return asking(prompts, None)
    log, columns = ReplyLog(e.replies), prompts.columns
    keyed = scratch.save(prompts.withColumn("prompt_key", prompt_key(client, as_json)))
    known = scratch.save(log.read(prompts.sparkSession).join(keyed.select("prompt_key").distinct(), "prompt_key", "left_semi"))
    needs = ["prompt_key", "system", "prompt", *[c for c in ("max_retries", "call_timeout_ms") if c in columns]]
    missing = keyed.join(known.select("prompt_key"), "prompt_key", "left_anti").select(needs).dropDuplicates(["prompt_key"])
    asked = asking(scratch.save(missing) if on_progress else missing, log)
    told = ["response", "tokens_used", "duration_ms", "success", "error"]
    replies = asked.select("prompt_key", *told, F.lit(True).alias("sent")).unionByName(known.withColumns({"success": F.lit(True), "error": F.lit(None).cast("string"), "sent": F.lit(False)}))
    out = scratch.save(keyed.join(replies, "prompt_key").select(*columns, *told, "sent"))
    scratch.drop(keyed, known, asked)
    return out


#: Replies as Spark types; the names in them are the replies' own (fixed values).
EXTRACTED = "title string, summary string, entities array<struct<type:string,name:string,value:string,confidence:double>>, sections array<struct<heading:string,content:string,level:int>>, tables array<struct<headers:array<string>,rows:array<array<string>>,caption:string,pageNumber:int>>"
ANALYSED = "documentType string, summary string, recommendedStrategy string, groups array<struct<id:string,title:string,startPage:int,endPage:int,reasoning:string,suggestedExtractionType:string>>, metadata struct<hasTOC:boolean,hasHeadings:boolean,estimatedComplexity:string>"
ANSWERED = "answer string, entities array<struct<type:string,name:string,value:string,confidence:double>>, relevantExcerpt string"
ROUTED = "relevantGroupIds array<string>, reasoning string"
SYNTHESISED = "answer string, confidence double"


def parsed(response: Column, schema: str) -> Column:
    """The JSON object in a response; null fields where there is none."""
    return F.from_json(json_object(response), schema)


def heading_of() -> Column:
    """Title and pages of a group, as prompts begin."""
    title = or_default(F.col("title"), F.concat(F.lit("Pages "), "start_page", F.lit("-"), "end_page"))
    return F.concat(F.lit("Section: "), title, F.lit("\nPages: "), "start_page", F.lit(" to "), "end_page", F.lit("\n\n"))


def extraction_prompts(rows: DataFrame, prompt: str | None = None, schema: str | None = None) -> DataFrame:
    """Adds system and prompt to ``extract.group_rows``. A column ``custom_prompt``, if there is one, goes before ``prompt`` in its row."""
    form = "Reply with one JSON object: title, summary, entities (type, name, value, confidence), sections (heading, content, level), tables (headers, rows, caption, pageNumber)."
    base = system_prompt("You extract structured data from a part of a document. " + form, f"Follow this schema: {schema}" if schema else None)
    own = F.lit(prompt or EXTRACTION_PROMPT)
    if "custom_prompt" in rows.columns:
        own = F.coalesce(F.nullif("custom_prompt", F.lit("")), own)
    return rows.withColumns({"system": F.lit(base), "prompt": F.concat(own, F.lit("\n\n"), heading_of(), F.lit("Content:\n"), joined(F.col("pages"), "\n\n", numbered=True))})


def _replied(replies: DataFrame) -> DataFrame:
    return replies.select("doc_id", "group_ord", parsed(F.col("response"), EXTRACTED).alias("m"), "success", "error", "duration_ms", "tokens_used", bag(F.col("response")).alias("extra"))


def _tables() -> Column:
    return F.transform("m.tables", lambda t: F.struct(t["headers"].alias("headers"), t["rows"].alias("rows"), t["caption"].alias("caption"), t["pageNumber"].alias("page_no"))).cast(TABLES)


def extracted(rows: DataFrame, replies: DataFrame, now: str | None = None) -> DataFrame:
    """Results of ``extract.group_rows`` that are what a model replied: its title (or else the group's), summary, entities, sections and tables.

    A group whose call failed is a result that failed. There is no raw content. Fields of a reply that aren't among these are in ``extra``.
    """
    out = rows.drop("pages").join(_replied(replies), ["doc_id", "group_ord"], "left")
    agent = F.concat(F.lit("subagent-"), "group_id")
    fields = {"title": or_default(F.col("m.title"), F.col("title")), "summary": F.col("m.summary"), "raw_content": F.lit(None).cast("string"), "entities": F.col("m.entities").cast(ENTITIES), "sections": F.col("m.sections").cast(SECTIONS), "tables": _tables(), "extracted_at": stamp(now)}
    kept = {c: F.col(c) for c in ("error", "duration_ms", "tokens_used", "extra")}
    return outcome(out.withColumns(fields), agent_id=agent, extracted_by=agent, success=F.coalesce("success", F.lit(False)), **kept).drop("m")


def enhanced(base: DataFrame, replies: DataFrame) -> DataFrame:
    """Results found by patterns with whatever fields a model's reply has over their own; where the call failed they stay as they are."""
    out = base.drop("error", "duration_ms", "tokens_used", "extra").join(_replied(replies).withColumnRenamed("success", "replied").drop("error"), ["doc_id", "group_ord"], "left")
    fields = {c: F.coalesce(f"m.{c}", c) for c in ("title", "summary")} | {"entities": F.coalesce(F.col("m.entities").cast(ENTITIES), F.col("entities")), "sections": F.coalesce(F.col("m.sections").cast(SECTIONS), F.col("sections")), "tables": F.coalesce(_tables(), F.col("tables"))}
    out = out.withColumns(fields | {"llm_enhanced": F.when(F.col("replied"), True), "error": F.lit(None).cast("string")})
    return out.select(*base.columns)


def analysis_prompts(pages: DataFrame, toc: DataFrame | None = None, documents: DataFrame | None = None, strategy: str | None = None) -> DataFrame:
    """doc_id, system, prompt: a document's title, author, number of pages, table of contents and beginnings of sampled pages.

    ``documents`` (doc_id, title, author) and ``toc`` may be left out.
    """
    own = grouping.page_counts(pages).join(grouping.sample_content(pages), "doc_id", "left")
    own = own.join(grouping.format_toc(toc), "doc_id", "left") if toc is not None else own.withColumn("listing", F.lit(None).cast("string"))
    own = own.join(documents.select("doc_id", "title", "author"), "doc_id", "left") if documents is not None else own.withColumns({"title": F.lit(None).cast("string"), "author": F.lit(None).cast("string")})
    system = "You analyse a document's structure. Reply with one JSON object: documentType, summary, groups (id, title, startPage, endPage, reasoning), recommendedStrategy (heading, toc or hybrid), metadata (hasTOC, hasHeadings, estimatedComplexity)."
    known = F.concat(F.lit("Title: "), or_default(F.col("title"), "Unknown"), F.lit("\nPages: "), "n", F.lit("\nAuthor: "), or_default(F.col("author"), "Unknown"))
    listing = F.when(F.coalesce("listing", F.lit("")) != "", F.concat(F.lit("\n\nTable of contents:\n"), "listing")).otherwise("")
    wish = f"\nGroup by: {strategy}" if strategy else ""
    return own.select("doc_id", F.lit(system).alias("system"), F.concat(known, F.lit(wish), listing, F.lit("\n\nSamples:\n"), F.coalesce("content", F.lit(""))).alias("prompt"))


def analyses(replies: DataFrame) -> DataFrame:
    """doc_id, document_type, summary, recommended_strategy, has_toc, has_headings, complexity, groups of the documents whose analysis came back."""
    a = replies.filter("success").select("doc_id", parsed(F.col("response"), ANALYSED).alias("a"))
    meta = F.col("a.metadata")
    return a.select("doc_id", F.col("a.documentType").alias("document_type"), "a.summary", F.col("a.recommendedStrategy").alias("recommended_strategy"), meta["hasTOC"].alias("has_toc"), meta["hasHeadings"].alias("has_headings"), meta["estimatedComplexity"].alias("complexity"), "a.groups")


def identified_groups(analysed: DataFrame, strategy: str | None = None) -> DataFrame:
    """doc_id, group_ord, id, type, title, start_page, end_page, reasoning, suggested_type: the groups that analyses name, of the strategy asked for or else recommended."""
    g = analysed.select("doc_id", (F.lit(strategy) if strategy else F.col("recommended_strategy")).alias("type"), F.posexplode("groups").alias("group_ord", "g"))
    return g.select("doc_id", "group_ord", "g.id", "type", "g.title", F.col("g.startPage").alias("start_page"), F.col("g.endPage").alias("end_page"), "g.reasoning", F.col("g.suggestedExtractionType").alias("suggested_type"))


def group_documents(pages: DataFrame, client: Client, toc: DataFrame | None = None, documents: DataFrame | None = None, strategy: str | None = None, execution: Execution = Execution()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups that a model names, the analyses, and documents that could not be grouped (doc_id, message): the call failed, or the reply names no list of groups."""
    replies = called(analysis_prompts(pages, toc, documents, strategy), client, execution, name="analyses")
    analysed = analyses(replies)
    lost = replies.filter("NOT success").select("doc_id", F.col("error").alias("message")).union(analysed.filter("groups IS NULL").select("doc_id", F.lit("the analysis has no groups")))
    return grouping.clamp_groups(identified_groups(analysed, strategy), pages), analysed, lost


# Own wording, one for each kind of answer.
QUERY_SYSTEMS = {
    "summary": "Summarise what this part of the document says about the question.",
    "entities": "List the entities in this part of the document that bear on the question.",
    "full": "Answer the question with all details, entities and quotes of this part of the document.",
    "default": "Answer the question from this part of the document.",
}


def query_system(kind: str | None, custom_prompt: str | None = None) -> str:
    """A custom prompt wins over any kind."""
    form = " Reply with one JSON object: answer, entities, relevantExcerpt."
    return (custom_prompt or QUERY_SYSTEMS.get(kind or "default", QUERY_SYSTEMS["default"])) + form


def routing_prompts(question: str, groups: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """doc_id, system, prompt: which of a document's groups bear on the question. ``documents``: doc_id, title, document_type."""
    line = F.concat(F.lit("- ID: "), "group_id", F.lit("\n  Title: "), or_default(F.col("title"), F.concat(F.lit("Pages "), "start_page", F.lit("-"), "end_page")), F.lit("\n  Pages: "), "start_page", F.lit("-"), "end_page")
    own = groups.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("listing"))
    own = own.join(documents.select("doc_id", "title", "document_type"), "doc_id", "left") if documents is not None else own.withColumns({"title": F.lit(None).cast("string"), "document_type": F.lit(None).cast("string")})
    system = "You choose the parts of a document that a question needs; take a part in if unsure. Reply with one JSON object: relevantGroupIds, reasoning."
    known = F.concat(F.lit("Document: "), or_default(F.col("title"), "Untitled"), F.lit("\nType: "), or_default(F.col("document_type"), "Unknown"))
    return own.select("doc_id", F.lit(system).alias("system"), F.concat(known, F.lit("\n\nSections:\n"), "listing", F.lit(f"\n\nQuery: {question}")).alias("prompt"))


def routed(replies: DataFrame) -> DataFrame:
    """doc_id, group_id: the groups that routing replies name, each once."""
    return replies.filter("success").select("doc_id", F.explode(parsed(F.col("response"), ROUTED)["relevantGroupIds"]).alias("group_id")).distinct()


def model_router(client: Client, documents: DataFrame | None = None, execution: Execution = Execution()) -> Router:
    """A router that asks a model."""
    return lambda question, groups: routed(called(routing_prompts(question, groups, documents), client, execution, name="routes"))



def lexical_router(query: str, groups: DataFrame) -> DataFrame:
    """Routing without a model: groups whose title shares a word with the query, else all of the document."""
    words = [w for w in query.lower().split() if len(w) > 2]
    hit = F.arrays_overlap(F.split(F.lower(F.coalesce("title", F.lit(""))), r"\W+"), F.array(*[F.lit(w) for w in words]).cast("array<string>"))
    marked = groups.select("doc_id", "group_id", hit.alias("hit"))
    some = marked.groupBy("doc_id").agg(F.bool_or("hit").alias("some"))
    return marked.join(some, "doc_id").filter(F.col("hit") | ~F.col("some")).select("doc_id", "group_id")
