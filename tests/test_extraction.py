import json

import pytest
from pyspark.sql import functions as F

from quirework.functions.config import FLOW_PRESETS, PRESETS, Execution, Grouping, Output, Settings, flow
from quirework.operators import extract, merge, model, output, parse, query, store
from quirework.plans import flow as runs
from quirework.plans.queries import RuleClient
from quirework.sources import readers as R

TEXT = "é12/12/2020 and 2024-01-05, US$1,200.50 $5 10 USD March 3, 2020 a@b.co 5%x 7% https://x.y/z."


def pages(spark, *texts):
    return spark.createDataFrame([(1, k + 1, t) for k, t in enumerate(texts)], "doc_id int, page_no int, text string")


def test_entities(spark):
    got = extract.first_entities(extract.page_entities(pages(spark, TEXT))).orderBy("ord").collect()
    assert [(r.type, r.name) for r in got] == [("date", "12/12/2020"), ("date", "2024-01-05"), ("date", "March 3, 2020"), ("money", "$1,200.50"), ("money", "10 USD"), ("email", "a@b.co"), ("url", "https://x.y/z"), ("percentage", "5%")]


@pytest.mark.parametrize("text,tables", [("a  b\nplain prose\n1  2", [(["a", "b"], [["1", "2"]])]), ("a  b\n\n1  2", []), ("a|b\n---|---\n1|2", [(["a", "b"], [["---", "---"], ["1", "2"]])]), ("a\tb\n1\t2\nx|y|z\n1|2|3", [(["a", "b"], [["1", "2"]]), (["x", "y", "z"], [["1", "2", "3"]])])])
def test_tables(spark, text, tables):
    got = extract.page_tables(pages(spark, text)).orderBy("table_no").collect()
    assert [(r.headers, r.rows) for r in got] == tables


def test_sections_span_pages_and_drop_lists(spark):
    got = extract.sections(parse.elements(pages(spark, "lost\nChapter 1 A\nx\n- item", "y\nChapter 2 B"))).orderBy("section_no").collect()
    assert [(r.heading, r.content) for r in got] == [("Chapter 1 A", "x\ny"), ("Chapter 2 B", "")]


def test_entities_of_equal_confidence_keep_the_first(spark):
    rows = [(1, 0, "org", "Acme", None, 0.8), (1, 1, "date", "X", None, 0.9), (1, 2, "org", "ACME", None, 0.9), (1, 3, "org", "acme", None, 0.9)]
    df = spark.createDataFrame(rows, "doc_id int, ord int, type string, name string, value string, confidence double")
    assert [(r.type, r.name) for r in merge.best_entities(df).orderBy("rank").collect()] == [("org", "ACME"), ("date", "X")]
    assert [r.name for r in query.query_entities(df).orderBy("rank").collect()] == ["Acme", "X", "ACME", "acme"]


def test_summary_without_sentences(spark):
    assert spark.range(1).select(extract.summary(F.lit("Short. Bits."))).first()[0] == "No content available for summary."


def test_whole_run_and_formats(spark):
    seen = []
    hooks = {f"on_{k}_{w}": lambda *_, n=f"on_{k}_{w}": seen.append(n) for k in ("parse", "grouping", "extraction", "merge") for w in ("start", "complete")}
    done = runs.run(pages(spark, "Chapter 1 A\nA sentence that is long enough. " + TEXT + "\nk  v\n1  2", "Chapter 1 a\nOther body"), settings=Settings().with_(grouping={"strategy": "heading"}), hooks=hooks)
    assert seen == list(hooks)
    row = done.merged.first()
    assert [(s.heading, s.content.split("\n\n")[-1]) for s in row.sections] == [("Chapter 1 A", "Other body")]
    assert len(row.tables) == 1
    assert done.statistics.first().status == "success"
    md = output.markdown_text(done.merged).first().output
    assert md.startswith("# Chapter 1 A\n\n## Summary\n\n") and "### Date\n\n- 12/12/2020\n" in md and "| k | v |\n| --- | --- |\n| 1 | 2 |" in md
    assert json.loads(output.json_text(done.merged).first().output)["metadata"]["totalGroups"] == 2
    assert set(json.loads(output.json_text(done.merged, metadata=False, pretty=False).first().output)) == {"title", "summary", "sections", "entities", "tables"}
    index = json.loads(output.search_index(done.merged).first().output)
    assert [d["id"] for d in index["documents"]][:3] == ["summary", "section-0", "entity-0"]
    assert output.format_output(done.merged, Output("summary")).first().output.startswith("Title: Chapter 1 A\n\nSummary:\n")


def test_failed_model_calls_are_rows(spark):
    class Broken:
        def complete(self, messages):
            raise RuntimeError("no model")

    done = runs.run(pages(spark, "text"), settings=Settings().with_(execution={"retries": 0}), client=Broken())
    assert done.statistics.first().status == "failed"
    assert done.errors.first().message == "no model"
    assert done.merged.count() == 0


def test_ask(spark):
    p = pages(spark, *["words of page"] * 12)
    groups = runs.run(p, settings=Settings().with_(grouping={"strategy": "fixed"})).groups
    first = groups.filter("group_ord = 0").first().group_id
    # The mock replies with an empty object: it routes nowhere, and gives an empty answer where it is asked.
    assert query.ask("what?", groups, p, model.MockClient()).first().answer == query.NOTHING
    one = query.ask("what?", groups, p, model.MockClient(), group_ids=[first]).first()
    assert (one.n, one.answer, one.confidence, one.groups_processed) == (1, "", 0.8, [first])
    many = query.ask("what is there?", groups, p, RuleClient(), router=model.lexical_router).first()
    assert (many.n, many.answer, many.confidence, many.tokens_used) == (2, "2 parts", 0.5, 21)
    assert [s.excerpt for s in many.sources] == ["page 1", "page 11"]
    with pytest.raises(ValueError):
        query.ask("", groups, p, model.MockClient())


class Counting:
    """Writes a line for each call."""

    def __init__(self, path):
        self.path = path

    def complete(self, messages):
        with open(self.path, "a") as f:
            f.write("call\n")
        return model.Reply('Of course: {"title": "T", "entities": [{"type": "org", "name": "Acme", "confidence": 0.7}]} done', 5)


def test_each_prompt_is_sent_once(spark, tmp_path):
    path = str(tmp_path / "calls")
    done = runs.run(pages(spark, *["text"] * 12), settings=Settings().with_(grouping={"strategy": "fixed"}), client=Counting(path))
    row = done.merged.first()
    assert (row.title, row.entities[0].name, row.summary) == ("T", "Acme", "No summary available.")
    assert done.statistics.first().total_tokens == 10 and done.errors.count() == 0 and done.results.count() == 2
    assert open(path).read().count("call") == 2


def test_mock_provider(spark):
    """Fixed groups succeed with nothing in them; a grouping by the mock fails, as it names no groups."""
    fixed = runs.run(pages(spark, *["text"] * 12), settings=Settings().with_(grouping={"strategy": "fixed"}), client=model.MockClient())
    row = fixed.merged.first()
    assert (row.title, row.summary, row.entities, row.sections, row.tables) == ("Pages 1-10", "No summary available.", [], [], [])
    other = runs.run(pages(spark, "text"), client=model.MockClient())
    assert (other.errors.first().stage, other.statistics.first().status, other.groups.count()) == ("grouping", "failed", 0)


@pytest.mark.parametrize("go_on,calls", [(True, 1), (False, 3)])
def test_failed_calls_are_tried_again_unless_the_run_goes_on(spark, tmp_path, go_on, calls):
    path = str(tmp_path / "calls")

    class Broken(Counting):
        def complete(self, messages):
            super().complete(messages)
            return model.Reply("no object here", 1)

    settings = Settings().with_(grouping={"strategy": "fixed"}, execution={"retries": 2, "retry_delay_ms": 100, "continue_on_error": go_on})
    done = runs.run(pages(spark, "text"), settings=settings, client=Broken(path))
    assert "no JSON in the reply" in done.errors.first().message and open(path).read().count("call") == calls


def test_settings_reach_the_run(spark):
    """Schema and prompt in the prompts, patterns and switches in the parser, options in the merger."""
    rows = extract.group_rows(runs.run(pages(spark, "a")).groups, pages(spark, "a"))
    sent = model.extraction_prompts(rows, "Find it.", '{"x": 1}').first()
    assert '{"x": 1}' in sent.system and sent.prompt.startswith("Find it.\n\nSection: ")
    text = "== One ==\nbody one. k  v\n1  2\n== one ==\nother body\nmail a@b.co and A@B.co"
    base = Settings().with_(grouping={"strategy": "fixed"}, parsing={"patterns": (r"\A== .* ==\z",)})
    row = runs.run(pages(spark, text), settings=base).merged.first()
    assert [s.heading for s in row.sections] == ["== One =="] and len(row.entities) == 1
    row = runs.run(pages(spark, text), settings=base.with_(merging={"merge_sections": False, "deduplicate": False, "summary_limit": 5}, parsing={"tables": False})).merged.first()
    assert sorted(s.heading for s in row.sections) == ["== One ==", "== one =="] and len(row.entities) == 2 and row.tables == [] and len(row.summary) <= 8
    assert runs.run(pages(spark, text), settings=base.with_(parsing={"headings": False})).merged.first().sections == []


def test_custom_strategies_and_agents(spark):
    from quirework.operators import agents, grouping

    grouping.register("single", lambda pages, elements, toc, g: grouping.fixed_groups(pages, 1))
    agents.register("shout", lambda: lambda rows: extract.extracted(rows).withColumn("summary", F.lit("!")))
    done = runs.run(pages(spark, "a", "b"), settings=Settings().with_(grouping={"strategy": "single"}), agent=agents.create("shout"))
    assert done.groups.count() == 2 and done.merged.first().summary == "! !"
    with pytest.raises(ValueError):
        agents.create("other")
    boss, rows = agents.Orchestrator(agents.pattern_agent()), extract.group_rows(done.groups, pages(spark, "a", "b"))
    results, errors = boss.execute(rows)
    boss.drain(rows)
    assert results.count() == 2 and errors.count() == 0 and boss.stats(rows) == {"pending": 0, "active": 0, "size": 0}
    assert boss.execute_single(rows, results.first().group_id).count() == 1
    boss.clear(rows)
    with pytest.raises(ValueError):
        agents.Orchestrator().execute(rows)


def test_flows_keep_their_jobs(spark):
    flows = runs.Flows(RuleClient(), Settings().with_(execution={"retries": 0}))
    job = flows.execute(flows.from_preset("invoice"), pages(spark, "a", "b"))
    assert [j.job_id for j in flows.jobs()] == [job.job_id] and flows.job(job.job_id).status().first().job_status == "completed"
    row = flows.executions(status="completed").first()
    assert flows.execution(row.execution_id).first().flow_name == "invoice"
    assert json.loads(flows.export(job.job_id, "json").first().output)["metadata"]["groups"][0]["startPage"] == 1
    assert flows.export(job.job_id, "search-index").first().output.startswith('{\n  "title": "Part 1"')
    with pytest.raises(ValueError):
        flows.job("other")


def test_system_prompt():
    assert (model.system_prompt("a"), model.system_prompt("a", "b")) == ("a", "a\n\nb")


def test_pretty_json_and_index_hold_the_same(spark):
    done = runs.run(pages(spark, "Chapter 1 A\nlong enough sentence of words. " + TEXT, "k  v\n1  2"), settings=Settings().with_(grouping={"strategy": "fixed"}), now="2024-01-01T00:00:00.000Z")
    flat, pretty = (output.json_text(done.merged, pretty=x).first().output for x in (False, True))
    assert json.loads(flat) == json.loads(pretty) and pretty.startswith('{\n  "title"')
    meta = json.loads(flat)["metadata"]
    assert (meta["totalGroups"], meta["extractedAt"], meta["groups"][0]["endPage"]) == (1, "2024-01-01T00:00:00.000Z", 2)
    md = output.markdown_text(done.merged).first().output
    assert md.endswith("```") and json.loads(md.split("```json\n")[1][:-3])["groups"][0]["pageCount"] == 2
    index = json.loads(output.search_index(done.merged).first().output)
    assert index["metadata"] == meta and [d["rows"] for d in index["documents"] if d["type"] == "table"] == [[["1", "2"]]]


def test_store_versions(spark, tmp_path):
    own = store.Store(spark, f"{tmp_path}/store", RuleClient())
    docs = lambda i, t: spark.createDataFrame([(i, t, "a")], "doc_id int, title string, author string")
    with pytest.raises(ValueError):
        own.table("catalogue")
    own.upload(docs(1, "one"), pages(spark, "a", "b"))
    assert own.table("catalogue").first().document_type == "report" and own.table("groups").count() == 2
    assert own.delete(1) and not own.delete(1) and own.table("groups").count() == 0
    own.upload(docs(1, "again"), pages(spark, "a"), settings=Grouping("fixed"))
    assert own.table("catalogue").first().title == "again" and own.table("groups").first().type == "fixed"
    # Rows of an upload that broke off don't count.
    own.table("catalogue").write.parquet(f"{tmp_path}/store/catalogue/upload=ubroken")
    assert own.table("catalogue").count() == 1


def test_settings_bounds_and_presets():
    for bad in (lambda: Grouping("other"), lambda: Grouping(heading_levels=(7,)), lambda: Execution(max_concurrency=21), lambda: Execution(timeout_ms=10), lambda: Output("xml"), lambda: model.create_client("openai")):
        with pytest.raises(ValueError):
            bad()
    assert PRESETS["structured"].grouping.min_size == 2 and PRESETS["searchIndex"].output.pretty is False
    assert flow("book").strategy == "toc" and set(FLOW_PRESETS) == {"document", "report", "invoice", "research", "book", "manual"}


def test_batch(spark):
    _, executions = runs.batch("j", flow("document"), pages(spark, "a page"))
    assert executions.first().status == "completed"


def test_store_and_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\ftwo")
    (tmp_path / "in/b.txt").write_bytes(b"\xff")
    docs = R.documents_from_files(spark, f"{tmp_path}/in/a.txt").withColumn("page_count", F.lit(3))
    assert [r.text for r in R.pages(docs).orderBy("page_no").collect()] == ["one", "two", ""]
    read = R.documents_from_bytes(spark, f"{tmp_path}/in", lambda b: b.decode())
    assert {r.source[-5:]: r.text is None for r in read.collect()} == {"a.txt": False, "b.txt": True}
    own = store.Store(spark, f"{tmp_path}/store")
    own.upload(docs.select("doc_id", F.lit("t").alias("title"), F.lit("a").alias("author")), R.pages(docs))
    assert own.table("catalogue").first().page_count == 3 and own.table("groups").first().type == "fixed"


def test_stream_of_pages(spark, tmp_path):
    from quirework.streaming import ingest

    pages(spark, "Chapter 1 A\ntext").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id int, page_no int, text string").parquet(f"{tmp_path}/in")
    q = ingest.elements(stream).writeStream.format("memory").queryName("stream_elements").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT * FROM stream_elements").count() == 2
