"""Questions to documents: choose groups, ask a model about each, merge the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.config import Execution, Merging
from . import extract, merge, model, store

# The answer where there is none, its confidence and that of a single one, and the characters of a group that are sent.
NOTHING = "No relevant information found in the document."
NO_CONFIDENCE, SINGLE_CONFIDENCE = 0.0, 0.8
CONTENT_LIMIT = 8000

SOURCE = "array<struct<group_id:string,title:string,start_page:int,end_page:int,excerpt:string>>"
FOUND = "array<struct<type:string,name:string,value:string,confidence:double>>"


def source_references(answers: DataFrame, groups: DataFrame) -> DataFrame:
    """Answers (doc_id, group_id, excerpt) with their group's title and pages; pages of an unknown group, or 0, are 1."""
    g = groups.select("doc_id", "group_id", "title", "start_page", "end_page")
    page = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(1)).alias(c)
    return answers.join(g, ["doc_id", "group_id"], "left").select("doc_id", "group_id", "title", page("start_page"), page("end_page"), "excerpt")


def query_entities(entities: DataFrame) -> DataFrame:
    """The surest of the answers' entities by type and name, letters' case counting, in order of appearance."""
    return merge.best_entities(entities, fold_case=False, ranked=False)


def merge_answers(answers: DataFrame) -> DataFrame:
    """doc_id, n, answer, confidence: none 0, one 0.8, several joined for synthesis (confidence null until a model gives one).

    ``answers``: one row per document and answer, with group_ord; a document without one has a null answer.
    """
    part = F.when(F.col("answer").isNotNull(), F.struct("group_ord", "group_id", "answer"))
    out = answers.groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("a"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens_used"))
    n = F.size("a")
    joined = F.array_join(F.transform("a", lambda x, i: F.concat(F.lit("--- Section "), i + 1, F.lit(" ("), x["group_id"], F.lit(") ---\n"), x["answer"])), "\n\n")
    return out.select("doc_id", n.alias("n"), F.when(n == 0, NOTHING).when(n == 1, F.get("a", F.lit(0))["answer"]).otherwise(joined).alias("answer"), F.when(n == 0, NO_CONFIDENCE).when(n == 1, SINGLE_CONFIDENCE).alias("confidence"), "tokens_used")


def question_prompts(question: str, rows: DataFrame, kind: str | None = None, custom_prompt: str | None = None) -> DataFrame:
    """Adds system and prompt to ``extract.group_rows``; of long groups the beginning is sent."""
    content = extract.joined(F.col("pages"), "\n\n")
    return rows.withColumns({"system": F.lit(model.query_system(kind, custom_prompt)), "prompt": F.concat(model.heading_of(), F.lit("Content:\n"), T.preview(content, CONTENT_LIMIT), F.lit(f"\n\nQuery: {question}"))})


def ask(
    question: str, groups: DataFrame, pages: DataFrame, client: model.Client, group_ids: list[str] | None = None, kind: str | None = None, custom_prompt: str | None = None, router: model.Router | None = None, documents: DataFrame | None = None, execution: Execution = Execution()
) -> DataFrame:
    """One row per document of ``groups``: doc_id, n, answer, confidence, sources, entities, groups_processed, tokens_used, failed.

    Explicit group ids are filtered before any page is read; else the router chooses, the model itself unless ``router`` is given. A document no group of which is chosen has an answer that says so.
    Each group is asked once, and where several answer once more for all. Sources and entities are those of the answers, entities of several answers deduplicated.
    A call that fails is counted in ``failed`` and gives no answer; where the last one fails the answers stand joined.
    """
    if not question:
        raise ValueError("a question is required")
    scratch = lambda df, name: model.called(df, client, execution, name=name)
    choose = router or model.model_router(client, documents, execution)
    own = store.select_groups(groups, group_ids) if group_ids else store.routed_groups(groups, choose(question, groups))
    rows = question_prompts(question, extract.group_rows(own, pages), kind, custom_prompt)
    replies = scratch(rows.select("doc_id", "group_ord", "group_id", "title", "start_page", "end_page", "system", "prompt"), "answers")
    page = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(1)).alias(c)
    each = replies.withColumn("r", model.parsed(F.col("response"), model.ANSWERED)).select("doc_id", "group_ord", "group_id", "success", "tokens_used", F.coalesce("r.answer", F.lit("")).alias("answer"), F.struct("group_id", "title", page("start_page"), page("end_page"), F.coalesce("r.relevantExcerpt", F.lit("")).alias("excerpt")).alias("source"), F.coalesce(F.col("r.entities").cast(FOUND), F.array().cast(FOUND)).alias("entities"))
    listed = F.array_sort(F.collect_list(F.when(F.col("success"), F.struct("group_ord", "group_id", "answer", "source", "entities"))))
    asked = F.array_sort(F.collect_list(F.struct("group_ord", "group_id")))
    per = each.groupBy("doc_id").agg(listed.alias("a"), asked.alias("asked"), F.sum("tokens_used").alias("tokens"), F.count_if(~F.col("success")).alias("failed"))
    every = F.flatten(F.transform("a", lambda x: F.transform(x["entities"], lambda e, i: F.struct(F.struct(x["group_ord"].alias("g"), i.alias("i")).alias("ord"), e["type"].alias("type"), e["name"].alias("name"), e["value"].alias("value"), e["confidence"].alias("confidence")))))
    best = F.transform(merge.best_array(every, Merging(sort_entities=False), fold_case=False), lambda e: F.struct(e["type"].alias("type"), e["name"].alias("name"), e["value"].alias("value"), e["confidence"].alias("confidence")))
    n = F.size("a")
    text = F.array_join(F.transform("a", lambda x, i: F.concat(F.lit("--- Section "), i + 1, F.lit(" ("), x["group_id"], F.lit(") ---\n"), x["answer"])), "\n\n")
    per = per.select(
        "doc_id", n.alias("n"), F.when(n == 1, F.get("a", F.lit(0))["answer"]).when(n > 1, text).alias("answer"), F.when(n == 1, SINGLE_CONFIDENCE).alias("confidence"), F.transform("a", lambda x: x["source"]).cast(SOURCE).alias("sources"),
        F.when(n == 1, F.get("a", F.lit(0))["entities"]).otherwise(best).cast(FOUND).alias("entities"), F.transform("asked", lambda x: x["group_id"]).alias("groups_processed"), "tokens", "failed",
    )
    several = per.filter("n > 1").select("doc_id", F.lit("Combine the partial answers into one, keep what each adds. Reply with one JSON object: answer, confidence.").alias("system"), F.concat(F.lit(f"Query: {question}\n\nPartial answers:\n"), "answer").alias("prompt"))
    whole = scratch(several, "syntheses").select("doc_id", model.parsed(F.col("response"), model.SYNTHESISED).alias("m"), F.col("tokens_used").alias("more"))
    out = groups.select("doc_id").distinct().join(per, "doc_id", "left").join(whole, "doc_id", "left")
    none = F.coalesce(F.col("n"), F.lit(0)) == 0
    return out.select(
        "doc_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(none, NOTHING).otherwise(F.coalesce("m.answer", "answer")).alias("answer"), F.when(none, NO_CONFIDENCE).otherwise(F.coalesce("m.confidence", "confidence")).alias("confidence"),
        F.coalesce("sources", F.array().cast(SOURCE)).alias("sources"), F.coalesce("entities", F.array().cast(FOUND)).alias("entities"), F.coalesce("groups_processed", F.array().cast("array<string>")).alias("groups_processed"),
        (F.coalesce("tokens", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("tokens_used"), F.coalesce("failed", F.lit(0)).alias("failed"),
    )
