"""Steps that many queries share do their work once: plans of one exchange, patterns that agree with their plain forms, fixed groups without a join."""

import random
import re

from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import extract, grouping, index, parse
from quirework.plans.queries import QUERIES
from quirework.sources import readers
from tests.conftest import SF

SPACES = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
# As they are defined, with edges and white space written out.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
PLAIN = [
    rf"{EDGE}([0-9]{{1,2}}[-/][0-9]{{1,2}}[-/][0-9]{{2,4}}){EDGE}",
    rf"{EDGE}([0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}){EDGE}",
    rf"(?ai){EDGE}((?:January|February|March|April|May|June|July|August|September|October|November|December)[{SPACES}]+[0-9]{{1,2}},?[{SPACES}]+[0-9]{{4}}){EDGE}",
    rf"{EDGE}(\$[0-9,]+(?:\.[0-9]{{2}})?|[0-9,]+(?:\.[0-9]{{2}})?[{SPACES}]*(?:USD|EUR|GBP)){EDGE}",
    rf"{EDGE}([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}){EDGE}",
    rf'{EDGE}(https?://[^{SPACES}<>"{{}}|\\^`\[\]]+){EDGE}',
    rf"{EDGE}([0-9]+(?:\.[0-9]+)?%){EDGE}",
]


def exchanges(df) -> int:
    return len(re.findall(r"\bExchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_reports_are_dealt_out_once(spark):
    assert exchanges(readers.report_pages(spark, SF)) == 1
    assert exchanges(grouping.page_counts(readers.report_pages(spark, SF))) == 1
    for name in ("format_summary", "format_json", "search_records", "format_markdown_entities"):
        assert exchanges(QUERIES[name](spark, SF)) == 1, name


def test_parts_that_are_not_read_are_not_computed(spark):
    plan = QUERIES["format_markdown_entities"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert T.NO_CONTENT not in plan and r"\Achapter" not in plan and "email" in plan


def test_patterns_find_what_their_plain_forms_find(spark):
    rng = random.Random(5)
    small = ["12", "3", "2020", "-", "/", ",", ".", "$", "%", " ", "  ", "\n", "\u2003", "\u3000", "_", "x", "\u00c9", "USD", "EUR", "@", "a.b", "com", "[", "<", "\u00e9", "+", "7", "\u4e2d"]
    large = ["12/3/2020", "2020-1-2", "March 5, 2020", "may\u20037 1999", "JULY 1,2020", "1,2.50 USD", "$3.00", "7%", "a.b@c-d.com", "+x@y.org", "https://q.com/x", "http://\u00e9."]
    texts = ["".join(rng.choice(small if rng.random() < 0.7 else large) for _ in range(rng.randrange(1, 9))) for _ in range(6000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    got = df.select("i", *[F.regexp_extract_all("t", F.lit(p[2]), F.lit(1)).alias(f"p{k}") for k, p in enumerate(T.ENTITY_PATTERNS)]).collect()
    for k, pattern in enumerate(PLAIN):
        plain = re.compile(pattern)
        want = {i: plain.findall(t) for i, t in enumerate(texts)}
        assert {r.i: r[f"p{k}"] for r in got} == want, k
        assert sum(map(bool, want.values())) > 5, k


def test_white_space_is_one_set(spark):
    every = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in every], "c string")
    assert "".join(sorted(r.c for r in df.filter(F.col("c").rlike(rf"\A{T.SPACE}\z")).collect())) == "".join(sorted(SPACES))
    assert "".join(sorted(r.c for r in df.filter(T.trim(F.concat("c", F.lit("a b"), "c")) == "a b").collect())) == "".join(sorted(SPACES))
    inside = {r.c for r in df.filter(F.regexp_extract(F.concat(F.lit("http://a"), "c", F.lit("b")), T.ENTITY_PATTERNS[5][2], 1).endswith("b")).collect()}
    assert set(every) - inside == set(SPACES) | set('<>"{}|\\^`[]')


def test_fixed_rows_are_the_rows_of_fixed_groups(spark):
    """Documents with gaps, whole groups of them too, and with null texts."""
    rng, rows = random.Random(2), []
    for d in range(30):
        rows += [(d, p, rng.choice(["t", None, f"p{p}"])) for p in sorted(rng.sample(range(1, 60), rng.randrange(1, 12)))]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, text string").repartition(3)
    for each in (1, 3, 10):
        a, b = extract.fixed_rows(pages, each), extract.group_rows(grouping.fixed_groups(pages, each), pages)
        assert a.dtypes == b.dtypes and sorted(a.collect(), key=str) == sorted(b.collect(), key=str)


def test_a_line_is_trimmed_once_before_it_is_filtered(spark):
    plan = parse.headings(parse.elements(readers.report_pages(spark, SF), offsets=False), (1, 2))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(") == 1 and "regexp_replace" not in plan


def test_hits_of_questions_are_not_dealt_out(spark):
    """Postings are, once each; a hit comes for each question that has a term."""
    docs = spark.createDataFrame([(d, 0, str(d), f"a b a {d}" if d else None) for d in range(20)], "doc_id long, group_ord int, group_id string, text string")
    built = index.build(docs)
    assert (built.n, built.average) == (20, 19 * 4 / 20)
    got = {(r.term, r.doc_id): (r.tf, r.length) for r in built.postings.collect()}
    assert got == {(t, d): (2 if t == "a" else 1, 4) for d in range(1, 20) for t in ("a", "b", str(d))}
    found = index.search(built, spark.createDataFrame([(q, f"a {q}") for q in range(5)], "question_id int, question string"), 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(question_id#\d+, doc_id", plan) and re.search(r"hashpartitioning\(doc_id#\d+L, group_ord", plan)
    assert sorted((r.question_id, r["rank"], r.doc_id) for r in found.collect())[2:4] == [(1, 1, 1), (1, 2, 2)]


def test_lines_that_need_no_offsets_are_plain_strings(spark):
    pages = readers.report_pages(spark, SF)
    bare, placed = parse.elements(pages, offsets=False), parse.elements(pages)
    plan = bare._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(" not in plan and plan.count("trim(") == 1
    assert bare.dtypes == placed.dtypes and sorted(bare.drop("pos").collect()) == sorted(placed.drop("pos").collect())


def test_offsets_of_pages_of_one_block_and_of_more(spark):
    """A page of one block isn't cut into blocks."""
    rng = random.Random(3)
    texts = [None, ""] + ["\n".join("é" * rng.randrange(4) for _ in range(n)) for n in (1, 2, 255, 256, 257, 512, 700)]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id int, page_no int, text string")
    found = parse.lines(df)
    assert f"<= {parse._BLOCK}" in found._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for i, t in enumerate(texts):
        at = 0
        for k, line in enumerate((t or "").split("\n")):
            want.append((i, k, at, line))
            at += len(line) + 1
    assert sorted((r.doc_id, r.line_no, r.pos, r.line) for r in found.collect()) == want


def test_a_documents_index_is_written_in_one_go_by_more_tasks_than_slots(spark):
    """One call writes a document as JSON, not one for each record; tasks aren't merged by their bytes to one for each slot."""
    df = QUERIES["search_index_text"](spark, SF)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("StructsToJsonEvaluator(") == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert int(re.search(r"Exchange hashpartitioning\(doc_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)[1]) >= 4 * spark.sparkContext.defaultParallelism and exchanges(df) == 1


def test_entities_that_are_not_equally_sure(spark):
    """The surest of one type and name, at the place of the earliest, and among others as sure by place; with equal confidences too."""
    from quirework.functions.config import Merging
    from quirework.operators.merge import best_array

    rng, docs = random.Random(11), []
    for d in range(300):
        sure = [None, 0.5, 0.9] if d % 3 else [0.9]
        docs.append((d, [(k, rng.choice(["a", "b", None]), rng.choice(["X", "x", "y", "Z", None]), f"v{k}", rng.choice(sure)) for k in range(rng.randrange(0, 12))]))
    df = spark.createDataFrame(docs, "d int, e array<struct<ord: int, type: string, name: string, value: string, confidence: double>>")
    for ranked in (True, False):
        got = {r.d: [(e.rank, e.type, e.name, e.value, e.confidence) for e in r.b] for r in df.select("d", best_array(F.col("e"), Merging(sort_entities=ranked)).alias("b")).collect()}
        for d, entities in docs:
            doubt = lambda e: float("inf") if e[4] is None else -e[4]
            by = {}
            for e in entities:
                by.setdefault((e[1], e[2] and e[2].lower()), []).append(e)
            want = sorted(((doubt(best) if ranked else 0, min(x[0] for x in own), best[1:]) for own in by.values() for best in [min(own, key=lambda e: (doubt(e), e[0]))]), key=lambda x: x[:2])
            assert got[d] == [(k + 1, *x[2]) for k, x in enumerate(want)], (d, ranked)
