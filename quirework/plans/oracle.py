"""DuckDB SQL for the queries of ``queries.py``, written from the operators' definitions."""

from __future__ import annotations

from ..functions.config import FLOW_PRESETS
from ..sources.readers import REPORT_SQL

LINES = """lines AS (
  SELECT doc_id, page_no, i - 1 AS line_no, raw, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS text,
    coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id, page_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS pos
  FROM (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM pages)
)"""
ELEMENTS = """marked AS (
  SELECT *, CASE
    WHEN regexp_matches(text, '(?i)^chapter\\s+(\\d+|[IVXLCDM]+)[:.\\s]*.*$') THEN 1
    WHEN regexp_matches(text, '(?i)^part\\s+(\\d+|[IVXLCDM]+)[:.\\s]*.*$') THEN 2
    WHEN regexp_matches(text, '(?i)^section\\s+(\\d+\\.?\\d*)[:.\\s]*.*$') THEN 3
    WHEN regexp_matches(text, '^(\\d+\\.?\\d*)\\s+([A-Z][A-Za-z\\s]+)$') THEN 4
    WHEN regexp_matches(text, '^([A-Z][A-Z\\s]{2,50})$') THEN 5
    WHEN regexp_matches(text, '(?i)^(abstract|introduction|conclusion|references|appendix)$') THEN 6 END AS hit
  FROM lines WHERE text <> ''
), el AS (
  SELECT doc_id, page_no, line_no, pos, text, CASE WHEN hit IS NULL THEN NULL
      WHEN regexp_matches(text, '(?i)^(chapter|part)') THEN 1 WHEN regexp_matches(text, '(?i)^section') THEN 2
      WHEN regexp_matches(text, '^\\d+\\.\\d+') THEN 3
      WHEN regexp_matches(text, '(?i)^(abstract|introduction|conclusion|references|appendix)') THEN 1 ELSE least(hit, 4) END AS level,
    CASE WHEN hit IS NOT NULL THEN 'heading' WHEN regexp_matches(text, '^([-•*]\\s+|\\d+[.)]\\s+|[A-Za-z][.)]\\s+)') THEN 'list' ELSE 'text' END AS type
  FROM marked
)"""
COUNTS = "counts AS (SELECT doc_id, max(page_no) AS n FROM pages GROUP BY doc_id)"
FIXED = """fixed AS (
  SELECT doc_id, (s - 1) // 10 AS group_ord, sha256(doc_id || '|fixed|' || ((s - 1) // 10)) AS group_id, 'fixed' AS type,
    'Pages ' || s || '-' || least(s + 9, n) AS title, s AS start_page, least(s + 9, n) AS end_page, least(s + 9, n) - s + 1 AS page_count
  FROM (SELECT doc_id, n, unnest(range(1, n + 1, 10)) AS s FROM counts)
)"""
TOC = """toc AS (
  SELECT el.doc_id, page_no * 1000 + line_no AS toc_ord, level, text AS title, page_no FROM el JOIN counts USING (doc_id) WHERE n > 10 AND level IN (1, 2)
)"""


def heading(least: int, most: int) -> str:
    return f"""hs AS (
  SELECT el.*, n, lead(page_no) OVER w AS after FROM el JOIN counts USING (doc_id) WHERE level IN (1, 2) WINDOW w AS (PARTITION BY el.doc_id ORDER BY page_no, line_no)
), hg AS (
  SELECT doc_id, text, page_no AS s, coalesce(after - 1, n) AS e, after IS NULL AS last, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, line_no) - 1 AS k
  FROM hs WHERE after IS NULL OR after - page_no >= {least}
), hm AS (
  SELECT a.doc_id, a.k, a.text, a.s, a.e, a.e - a.s + 1 AS c, a.last AND a.e - a.s + 1 < {least} AND p.k IS NOT NULL AND (p.e - p.s + 1) + (a.e - a.s + 1) <= {most} AS gone
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM hg) a
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM hg) p ON p.doc_id = a.doc_id AND p.r = a.r - 1
), heads AS (
  SELECT doc_id, rank - 1 AS group_ord, text || coalesce(' / ' || nt, '') AS title, s AS start_page, coalesce(ne, e) AS end_page, c + coalesce(nc, 0) AS page_count FROM (
    SELECT *, row_number() OVER w AS rank, CASE WHEN lead(gone) OVER w THEN lead(text) OVER w END AS nt, CASE WHEN lead(gone) OVER w THEN lead(e) OVER w END AS ne,
      CASE WHEN lead(gone) OVER w THEN lead(c) OVER w END AS nc FROM hm WINDOW w AS (PARTITION BY doc_id ORDER BY k)) WHERE NOT gone
), byhead AS (
  SELECT doc_id, group_ord, sha256(doc_id || '|heading|' || group_ord) AS group_id, 'heading' AS type, title, start_page, end_page, page_count FROM heads
  UNION ALL SELECT * FROM fixed WHERE doc_id NOT IN (SELECT doc_id FROM hs)
)"""


BYTOC = """tg AS (
  SELECT toc.doc_id, title, page_no AS s, coalesce(lead(page_no) OVER w - 1, n) AS e, row_number() OVER w - 1 AS k FROM toc JOIN counts USING (doc_id) WINDOW w AS (PARTITION BY toc.doc_id ORDER BY toc_ord)
), bytoc AS (
  SELECT doc_id, k AS group_ord, sha256(doc_id || '|toc|' || k) AS group_id, 'toc' AS type, title, s AS start_page, e AS end_page, greatest(0, e - s + 1) AS page_count FROM tg
  UNION ALL SELECT * FROM byhead WHERE doc_id NOT IN (SELECT doc_id FROM toc)
)"""

ENTITIES = [
    ("date", 0.9, r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\b"),
    ("date", 0.9, r"\b(\d{4}[-/]\d{1,2}[-/]\d{1,2})\b"),
    ("date", 0.9, r"(?i)\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})\b"),
    ("money", 0.95, r"\b(\$[\d,]+(?:\.\d{2})?|[\d,]+(?:\.\d{2})?\s*(?:USD|EUR|GBP))\b"),
    ("email", 0.95, r"\b([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b"),
    ("url", 0.95, r'\b(https?://[^\s<>"{}|\\^`\[\]]+)\b'),
    ("percentage", 0.9, r"\b(\d+(?:\.\d+)?%)\b"),
]


def entities(source: str = "pages") -> str:
    parts = []
    for k, (kind, confidence, pattern) in enumerate(ENTITIES):
        found = f"regexp_extract_all(text, '{pattern}', 1)"
        parts.append(f"SELECT doc_id, page_no, {k} AS pattern, '{kind}' AS type, {confidence}::DOUBLE AS confidence, unnest({found}) AS name, generate_subscripts({found}, 1) - 1 AS match FROM {source}")
    return "ents AS (" + " UNION ALL ".join(parts) + ")"


SECTIONS = """numbered AS (
  SELECT *, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no, line_no) AS section_no FROM el
), secs AS (
  SELECT doc_id, section_no, max(text) FILTER (type = 'heading') AS heading, max(level) FILTER (type = 'heading') AS level,
    trim(coalesce(string_agg(text, chr(10) ORDER BY page_no, line_no) FILTER (type = 'text'), '')) AS content
  FROM numbered WHERE section_no > 0 GROUP BY doc_id, section_no
)"""
GROUP_SECTIONS = """gel AS (
  SELECT el.*, group_ord FROM el JOIN fixed ON fixed.doc_id = el.doc_id AND el.page_no BETWEEN start_page AND end_page
), gnum AS (
  SELECT *, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, group_ord ORDER BY page_no, line_no) AS section_no FROM gel
), gsecs AS (
  SELECT doc_id, group_ord, section_no, max(text) FILTER (type = 'heading') AS heading, max(level) FILTER (type = 'heading') AS level,
    trim(coalesce(string_agg(text, chr(10) ORDER BY page_no, line_no) FILTER (type = 'text'), '')) AS content
  FROM gnum WHERE section_no > 0 GROUP BY doc_id, group_ord, section_no
)"""


def fold(source: str, order: str) -> str:
    return f"""folded AS (
  SELECT doc_id, arg_min(heading, {order}) AS heading, arg_min(level, {order}) AS level,
    list_reduce(list(content ORDER BY {order}), lambda a, x: CASE WHEN contains(a, x) OR contains(x, a) THEN CASE WHEN length(a) > length(x) THEN a ELSE x END ELSE a || chr(10) || chr(10) || x END) AS content
  FROM {source} GROUP BY doc_id, lower(heading)
)"""


def table_runs(source: str) -> str:
    clean = "list_filter(list_transform({}, lambda c: trim(c)), lambda c: c <> '')"
    return f"""cells AS (
  SELECT doc_id, page_no, line_no, text = '' AS blank, CASE WHEN contains(text, chr(9)) THEN {clean.format("string_split(text, chr(9))")}
    WHEN contains(text, '|') THEN {clean.format("string_split(text, '|')")} WHEN regexp_matches(text, '\\s{{2,}}') THEN {clean.format("regexp_split_to_array(text, '\\s{2,}')")} ELSE [] END AS c FROM {source}
), blocks AS (
  SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS block FROM cells
), news AS (
  SELECT *, CASE WHEN lag(len(c)) OVER (PARTITION BY doc_id, page_no, block ORDER BY line_no) = len(c) THEN 0 ELSE 1 END AS new FROM blocks WHERE len(c) >= 2
), runs AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS run FROM news
), tabs AS (
  SELECT doc_id, page_no, run, list(c ORDER BY line_no) AS r, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY run) - 1 AS table_no FROM runs GROUP BY doc_id, page_no, run HAVING count(*) >= 2
)"""


def summary(text: str) -> str:
    s = f"list_filter(list_transform(regexp_split_to_array(regexp_replace({text}, '\\n+', ' ', 'g'), '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 20)"
    j = f"array_to_string({s}[1:3], '. ')"
    return f"CASE WHEN len({s}) = 0 THEN 'No content available for summary.' WHEN length({j}) > 500 THEN {j}[1:500] || '...' ELSE {j} || '.' END"


CONTENTS = """contents AS (
  SELECT fixed.doc_id, group_ord, string_agg(text, chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10) ORDER BY page_no) AS content
  FROM fixed JOIN pages ON pages.doc_id = fixed.doc_id AND page_no BETWEEN start_page AND end_page GROUP BY fixed.doc_id, group_ord
)"""
COMBINED = f"""sums AS (
  SELECT doc_id, string_agg(s, ' ' ORDER BY group_ord) AS s FROM (SELECT doc_id, group_ord, {summary("content")} AS s FROM contents) GROUP BY doc_id
), lastat AS (
  SELECT doc_id, s, s[1:1000] AS c, greatest(CASE WHEN contains(s[1:1000], '.') THEN 1000 - instr(reverse(s[1:1000]), '.') ELSE -1 END, CASE WHEN contains(s[1:1000], '!') THEN 1000 - instr(reverse(s[1:1000]), '!') ELSE -1 END,
    CASE WHEN contains(s[1:1000], '?') THEN 1000 - instr(reverse(s[1:1000]), '?') ELSE -1 END) AS e FROM sums
), combined AS (
  SELECT doc_id, CASE WHEN length(s) <= 1000 THEN s WHEN e > 700 THEN c[1:e + 1] ELSE c || '...' END AS summary FROM lastat
)"""
GROUP_ENTITIES = """gents AS (
  SELECT ents.*, group_ord FROM ents JOIN fixed ON fixed.doc_id = ents.doc_id AND page_no BETWEEN start_page AND end_page
), best AS (
  SELECT doc_id, type, max(confidence) AS confidence, min((group_ord, pattern, page_no, match)) AS first, arg_min(name, (-confidence, group_ord, pattern, page_no, match)) AS name FROM gents GROUP BY doc_id, type, lower(name)
)"""
CATALOGUE = "catalogue AS (SELECT c_custkey AS doc_id, c_name AS title, c_mktsegment AS author, coalesce(n, 0) AS page_count, c_acctbal AS uploaded_at FROM customer LEFT JOIN counts ON doc_id = c_custkey)"
PAGES = f"pages AS ({REPORT_SQL})"
PROSE = "pages AS (SELECT doc_id, 1 AS page_no, text FROM documents)"
ORDER_ENTITIES = "src AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, o_orderstatus AS type, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS name, (o_orderkey % 5) / 10 AS confidence FROM orders)"
COLUMNS = "doc_id, group_ord, group_id, type, title, start_page, end_page, page_count"


def _with(*parts_and_query: str) -> str:
    *parts, last = parts_and_query
    return "WITH " + ",\n".join(parts) + "\n" + last


def _presets() -> str:
    rows = ", ".join("({}, '{}', '{}', {})".format(k, n, s, "NULL" if p is None else "'" + p + "'") for k, (n, (s, p)) in enumerate(FLOW_PRESETS.items()))
    return f"presets(k, name, strategy, prompt) AS (VALUES {rows})"


LE, G = (PAGES, LINES, ELEMENTS), (PAGES, COUNTS, FIXED)
LEG = (PAGES, LINES, ELEMENTS, COUNTS, FIXED)

ORACLES = {
    "pages_split": _with(PAGES, COUNTS, "SELECT doc_id, page_no, text FROM pages UNION ALL SELECT doc_id, n + 1, '' FROM counts"),
    "document_metadata": "SELECT c_custkey AS doc_id, c_name AS title, NULL::VARCHAR AS author, c_mktsegment AS subject, NULL::VARCHAR AS creator, NULL::VARCHAR AS producer, 1 AS page_count FROM customer",
    "line_offsets": _with(PROSE, LINES, "SELECT doc_id, line_no, pos, length(text) AS width FROM lines"),
    "line_types": _with(*LE, "SELECT doc_id, page_no, line_no, pos, type, level FROM el"),
    "heading_levels": _with(*LE, "SELECT level, text, count(*) AS n FROM el WHERE type = 'heading' GROUP BY ALL"),
    "headings_at_levels": _with(*LE, "SELECT doc_id, page_no, pos, text, level FROM el WHERE level IN (1, 2)"),
    "list_lines": _with(*LE, "SELECT doc_id, page_no, line_no, text FROM el WHERE type = 'list'"),
    "has_headings": _with(*LE, "SELECT doc_id, bool_or(type = 'heading') AS has_headings FROM el GROUP BY doc_id"),
    "group_fixed": _with(*G, "SELECT * FROM fixed"),
    "group_heading": _with(*LEG, heading(1, 50), f"SELECT {COLUMNS} FROM byhead"),
    "group_heading_min_merge": _with(*LEG, heading(2, 5), f"SELECT {COLUMNS} FROM byhead"),
    "group_toc": _with(*LEG, TOC, heading(1, 50), BYTOC, f"SELECT {COLUMNS} FROM bytoc"),
    "group_hybrid": _with(*LEG, TOC, heading(1, 50), BYTOC, f"SELECT {COLUMNS} FROM bytoc"),
    "group_pages_range_join": _with(*LEG, heading(1, 50), "SELECT byhead.doc_id, group_ord, page_no FROM byhead JOIN pages ON pages.doc_id = byhead.doc_id AND page_no BETWEEN start_page AND end_page"),
    **{f"entities_{k}": _with(PAGES, entities(), f"SELECT doc_id, page_no, pattern, match, name, confidence FROM ents WHERE type = '{k}'") for k in ("date", "money", "url", "percentage")},
    "entities_email": _with(PROSE, entities(), "SELECT lang, name, count(*) AS n FROM (SELECT DISTINCT doc_id, name FROM ents WHERE type = 'email') JOIN documents USING (doc_id) GROUP BY ALL"),
    "entities_dedupe_first": _with(PAGES, entities(), "SELECT doc_id, type, name, confidence, pattern, page_no, match FROM ents QUALIFY row_number() OVER (PARTITION BY doc_id, type, name ORDER BY pattern, page_no, match) = 1"),
    "entities_merge_maxconf": _with(
        ORDER_ENTITIES,
        "b AS (SELECT *, min(ord) OVER (PARTITION BY doc_id, type, lower(name)) AS first FROM src QUALIFY row_number() OVER (PARTITION BY doc_id, type, lower(name) ORDER BY confidence DESC, ord) = 1)",
        "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, first) AS rank, type, name, confidence FROM b",
    ),
    "entities_query_dedupe": _with(
        ORDER_ENTITIES,
        "b AS (SELECT *, min(ord) OVER (PARTITION BY doc_id, type, name) AS first FROM src QUALIFY row_number() OVER (PARTITION BY doc_id, type, name ORDER BY confidence DESC, ord) = 1)",
        "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS rank, type, name, confidence FROM b",
    ),
    "entities_by_type": _with(ORDER_ENTITIES, "SELECT doc_id, type, min(ord) AS first, count(*) AS n FROM src GROUP BY doc_id, type"),
    "sections": _with(*LE, SECTIONS, "SELECT doc_id, section_no, heading, level, content FROM secs"),
    "sections_merged": _with(*LE, SECTIONS, fold("secs", "section_no"), "SELECT doc_id, heading, level, content FROM folded"),
    "tables_detected": _with(PAGES, LINES, table_runs("lines"), "SELECT doc_id, page_no, table_no, array_to_string(r[1], '|') AS headers, len(r) - 1 AS n_rows FROM tabs"),
    "table_rows": _with(
        f"pages AS (SELECT doc_id, 1 AS page_no, text FROM documents UNION ALL SELECT -doc_id, page_no, text FROM ({REPORT_SQL}))", LINES, table_runs("lines"),
        "SELECT doc_id, page_no, table_no, i - 2 AS row_no, array_to_string(r[i], '|') AS cells FROM (SELECT *, unnest(range(2, len(r) + 1)) AS i FROM tabs)",
    ),
    "extractive_summary": f"SELECT doc_id, {summary('text')} AS summary FROM documents",
    "title_fallback": _with(*G, "SELECT doc_id, group_ord, title FROM fixed"),
    "group_content": _with(*G, "SELECT fixed.doc_id, group_ord, string_agg('--- Page ' || page_no || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page_no) AS content FROM fixed JOIN pages ON pages.doc_id = fixed.doc_id AND page_no BETWEEN start_page AND end_page GROUP BY ALL"),
    "combined_summary": _with(*G, CONTENTS, COMBINED, "SELECT doc_id, summary FROM combined"),
    "first_title": _with(*G, "SELECT doc_id, arg_min(title, group_ord) AS title FROM fixed GROUP BY doc_id"),
    "full_content": _with(*G, CONTENTS, "SELECT doc_id, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY group_ord) AS full_content FROM contents GROUP BY doc_id"),
    "merge_metadata": _with(*G, "SELECT doc_id, count(*) AS total_groups, count(*) AS successful_groups, string_agg(group_id, ',' ORDER BY group_ord) AS groups FROM fixed GROUP BY doc_id"),
    "run_statistics": "SELECT o_custkey AS doc_id, count(*) AS total_groups, count_if(o_orderstatus <> 'F') AS successful_groups, count_if(o_orderstatus = 'F') AS failed_groups, sum(o_orderkey % 1000)::BIGINT AS total_duration, avg(o_orderkey % 1000) AS average_duration, sum(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 100 ELSE 0 END)::BIGINT AS total_tokens FROM orders GROUP BY o_custkey",
    "run_status": "SELECT o_custkey AS doc_id, CASE WHEN count_if(o_orderstatus = 'F') = 0 THEN 'success' WHEN count_if(o_orderstatus <> 'F') = 0 THEN 'failed' ELSE 'partial' END AS status FROM orders GROUP BY o_custkey",
    "batch_status": "SELECT o_custkey AS job_id, count_if(o_orderstatus <> 'F') AS completed, count_if(o_orderstatus = 'F') AS failed, CASE WHEN count_if(o_orderstatus = 'F') = 0 THEN 'completed' WHEN count_if(o_orderstatus <> 'F') = 0 THEN 'failed' ELSE 'partial' END AS job_status FROM orders GROUP BY o_custkey",
    "group_status": "SELECT o_custkey AS doc_id, CASE WHEN o_orderstatus <> 'F' THEN 'success' ELSE 'failed' END AS status, count(*) AS n FROM orders GROUP BY ALL",
    "sample_pages": _with(PAGES, COUNTS, "SELECT DISTINCT doc_id, unnest(CASE WHEN n <= 5 THEN range(1, n + 1) WHEN n <= 10 THEN [1, 2, n // 2, n - 1, n] ELSE [1, 2, n // 2, n * 3 // 4, n - 1, n] END)::INT AS page_no FROM counts"),
    "sample_content": _with(
        PAGES, COUNTS, "chosen AS (SELECT DISTINCT doc_id, unnest(CASE WHEN n <= 5 THEN range(1, n + 1) WHEN n <= 10 THEN [1, 2, n // 2, n - 1, n] ELSE [1, 2, n // 2, n * 3 // 4, n - 1, n] END) AS page_no FROM counts)",
        "SELECT doc_id, string_agg('--- Page ' || page_no || ' ---' || chr(10) || text[1:100] || CASE WHEN length(text) > 100 THEN '...' ELSE '' END, chr(10) || chr(10) ORDER BY page_no) AS content FROM chosen JOIN pages USING (doc_id, page_no) GROUP BY doc_id",
    ),
    "page_preview": "SELECT doc_id, 1 AS page_no, text[1:200] || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS preview FROM documents",
    "group_summaries": _with(*G, "SELECT doc_id, group_id, title, start_page, end_page, type, page_count FROM fixed"),
    "group_filter_ids": _with(*G, "SELECT * FROM fixed WHERE doc_id = 1 AND group_ord IN (0, 1)"),
    "group_routing_semi": _with(*G, "SELECT * FROM fixed WHERE page_count = 10"),
    "source_references": _with(*G, "SELECT doc_id, group_id, title, start_page, end_page, 'group ' || group_ord AS excerpt FROM fixed UNION ALL SELECT doc_id, 'gone', NULL, 1, 1, 'none' FROM fixed WHERE group_ord = 0"),
    "answers_merged": _with(
        *G, "a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY group_ord) AS i FROM fixed WHERE page_count > 3)",
        "b AS (SELECT doc_id, count(*) AS n, any_value(title) AS one, string_agg('--- Section ' || i || ' (' || group_id || ') ---' || chr(10) || title, chr(10) || chr(10) ORDER BY group_ord) AS many FROM a GROUP BY doc_id)",
        "SELECT doc_id, coalesce(b.n, 0) AS n, CASE WHEN b.n IS NULL THEN 'No relevant information found in the document.' WHEN b.n = 1 THEN one ELSE many END AS answer, CASE WHEN b.n IS NULL THEN 0.0::DOUBLE WHEN b.n = 1 THEN 0.8::DOUBLE END AS confidence, 0::BIGINT AS tokens_used FROM counts LEFT JOIN b USING (doc_id)",
    ),
    "search_index": _with(
        *LEG, CONTENTS, COMBINED, GROUP_SECTIONS, fold("gsecs", "(group_ord, section_no)"), entities(), GROUP_ENTITIES, table_runs("lines"),
        """SELECT doc_id, 'summary' AS type, (SELECT arg_min(title, group_ord) FROM fixed f WHERE f.doc_id = combined.doc_id) AS title, NULL AS heading, summary AS content, NULL AS level, NULL AS entity_type, NULL AS name, NULL::DOUBLE AS confidence, NULL AS page_no FROM combined
        UNION ALL SELECT doc_id, 'section', NULL, heading, content, level, NULL, NULL, NULL, NULL FROM folded
        UNION ALL SELECT doc_id, 'entity', NULL, NULL, NULL, NULL, type, name, confidence, NULL FROM best
        UNION ALL SELECT doc_id, 'table', NULL, NULL, NULL, NULL, NULL, NULL, NULL, page_no FROM tabs""",
    ),
    "format_summary": _with(
        *LEG, CONTENTS, COMBINED, GROUP_SECTIONS, fold("gsecs", "(group_ord, section_no)"), entities(), GROUP_ENTITIES, table_runs("lines"),
        "s AS (SELECT doc_id, count(*) AS n FROM folded GROUP BY doc_id), e AS (SELECT doc_id, count(*) AS n FROM best GROUP BY doc_id), t AS (SELECT doc_id, count(*) AS n FROM tabs GROUP BY doc_id)",
        "SELECT doc_id, 'Title: ' || f.title || chr(10) || chr(10) || 'Summary:' || chr(10) || summary || chr(10) || chr(10) || 'Sections: ' || coalesce(s.n, 0) || chr(10) || 'Entities: ' || coalesce(e.n, 0) || chr(10) || 'Tables: ' || coalesce(t.n, 0) AS output FROM combined JOIN fixed f USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN t USING (doc_id) WHERE f.group_ord = 0",
    ),
    "format_markdown_entities": _with(
        *G, entities(), GROUP_ENTITIES, "ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, first) AS rank FROM best)",
        "kinds AS (SELECT doc_id, type, min(rank) AS r, '### ' || upper(type[1]) || type[2:] || chr(10) || chr(10) || string_agg('- ' || name, chr(10) ORDER BY rank) || chr(10) AS part FROM ranked GROUP BY doc_id, type)",
        "SELECT doc_id, string_agg(part, chr(10) ORDER BY r) AS output FROM kinds GROUP BY doc_id",
    ),
    "toc_format": _with(*LE, COUNTS, TOC, "SELECT doc_id, string_agg(repeat('  ', level - 1) || '- ' || title || ' (page ' || page_no || ')', chr(10) ORDER BY toc_ord) AS listing FROM toc GROUP BY doc_id"),
    "catalog_list": _with(PAGES, COUNTS, CATALOGUE, "SELECT * FROM catalogue"),
    "catalog_get": _with(PAGES, COUNTS, CATALOGUE, "SELECT * FROM catalogue WHERE doc_id = 7"),
    "catalog_delete_anti": _with(PAGES, COUNTS, CATALOGUE, "SELECT * FROM catalogue WHERE page_count <> 0"),
    "catalog_health": "SELECT count(*) AS documents_stored, false AS model_configured FROM customer",
    "flow_presets_join": _with(_presets(), "SELECT c_custkey AS doc_id, name, strategy, prompt FROM customer JOIN presets ON k = c_nationkey % 6"),
    "outline_flatten": """WITH o AS (
      SELECT r_regionkey AS doc_id, 1 AS level, r_name AS title, 1 AS page_no, -1 AS a, -1 AS b FROM region
      UNION ALL SELECT n_regionkey, 2, n_name, 1, n_nationkey, -1 FROM nation
      UNION ALL SELECT n_regionkey, 3, 'Untitled', s_suppkey, n_nationkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey < 1000)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) AS toc_ord, level, title, page_no FROM o""",
}

# Runs in which the model's replies follow the rules of ``queries.RuleClient``.
DONE = "done AS (SELECT * FROM fixed WHERE start_page <> 21 AND end_page <> 3)"
REPLY_ENTITIES = """reply AS (
  SELECT doc_id, count(*) AS total, string_agg('Pages ' || start_page || ' to ' || end_page || '.', ' ' ORDER BY group_ord) AS summary,
    string_agg('part/Part ' || start_page || '/' || end_page, ';' ORDER BY group_ord) || ';kind/report/-' AS entities FROM done GROUP BY doc_id
)"""
EXECUTION = "sha256('j|' || doc_id)"
NOW = "2024-01-01T00:00:00.000Z"
# Section headings in the order of the root collation: of the signs that occur a colon comes before digits.
IN_ORDER = "level, replace(heading, ':', '!'), first"
RANKED = f"""ranked AS (
  SELECT doc_id, heading, level, content, row_number() OVER (PARTITION BY doc_id ORDER BY {IN_ORDER}) AS rank
  FROM folded JOIN (SELECT doc_id AS d, lower(heading) AS h, min((group_ord, section_no)) AS first FROM gsecs GROUP BY ALL) ON d = doc_id AND h = lower(heading)
)"""
SURE = "sure AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, first) AS rank FROM best)"
NUMBERED = "numbered_tabs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, table_no) - 1 AS k FROM tabs)"
WHOLE = (*LEG, CONTENTS, COMBINED, GROUP_SECTIONS, fold("gsecs", "(group_ord, section_no)"), RANKED, entities(), GROUP_ENTITIES, SURE, table_runs("lines"), NUMBERED)
CELLS = "array_to_string(list_transform({}, lambda x: {}), '{}')"

ORACLES |= {
    "model_extraction": _with(*G, DONE, REPLY_ENTITIES, "SELECT doc_id, 'Part 1' AS title, summary, total AS total_groups, entities, 'Scope/1' AS sections, total AS n_tables, '' AS full_content FROM reply"),
    "pipeline_errors": _with(*G, "SELECT doc_id, group_id, 'extraction' AS stage, 'no reply for this part' AS message FROM fixed WHERE start_page = 21 OR end_page = 3"),
    "pipeline_statistics": _with(*G, "s AS (SELECT doc_id, count(*) AS t, count_if(start_page = 21 OR end_page = 3) AS f FROM fixed GROUP BY doc_id)",
      """SELECT doc_id, n AS total_pages, t AS total_groups, t - f AS successful_groups, f AS failed_groups, 7 * (t - f) AS total_tokens, CASE WHEN f = 0 THEN 'success' WHEN f = t THEN 'failed' ELSE 'partial' END AS status FROM counts JOIN s USING (doc_id)"""),
    "extraction_progress": _with(*G, "p AS (SELECT *, start_page <> 21 AND end_page <> 3 AS ok FROM fixed)", "SELECT * EXCLUDE (ok) FROM (SELECT doc_id, group_id, ok, count_if(ok) OVER (PARTITION BY doc_id ORDER BY group_ord) AS completed, count(*) OVER (PARTITION BY doc_id) AS total FROM p) WHERE ok"),
    "model_enhancement": _with(*G, CONTENTS, f"""SELECT doc_id, group_ord, CASE WHEN gone THEN title ELSE 'Part ' || start_page END AS title, CASE WHEN gone THEN {summary("content")} ELSE 'Pages ' || start_page || ' to ' || end_page || '.' END AS summary,
      NOT gone AS enhanced, true AS success, length(content) AS width FROM (SELECT *, start_page = 21 OR end_page = 3 AS gone FROM fixed) JOIN contents USING (doc_id, group_ord)"""),
    "agent_configs": _with(*G, """SELECT doc_id, group_ord, CASE WHEN start_page = 21 OR end_page = 3 THEN title WHEN group_ord = 0 THEN 'Own 1' ELSE 'Part ' || start_page END AS title, NOT (start_page = 21 OR end_page = 3) AS success,
      'subagent-' || group_id AS agent_id, 'subagent-' || group_id AS extracted_by FROM fixed"""),
    "model_groups": _with(PAGES, COUNTS, """SELECT doc_id, 0 AS group_ord, 'g' || n AS group_id, 'hybrid' AS type, 'First' AS title, 1 AS start_page, n // 2 AS end_page, n // 2 AS page_count FROM counts
      UNION ALL SELECT doc_id, 1, sha256(doc_id || '|hybrid|1'), 'hybrid', 'Second', n // 2 + 1, n, n - n // 2 FROM counts"""),
    "document_analysis": _with(PAGES, COUNTS, "SELECT doc_id, 'report' AS document_type, n || ' pages.' AS summary, 'heading' AS recommended_strategy, false AS has_toc, n > 3 AS has_headings, CASE WHEN n > 10 THEN 'high' ELSE 'low' END AS complexity FROM counts"),
    "model_routing": _with(*G, "SELECT fixed.* FROM fixed JOIN counts USING (doc_id) WHERE group_ord % 2 = 0 AND n <> 7"),
    "ask_documents": _with(
        *G, "chosen AS (SELECT fixed.*, n FROM fixed JOIN counts USING (doc_id) WHERE group_ord % 2 = 0 AND n <> 7)",
        """per AS (SELECT doc_id, count(*) AS n, any_value('pages ' || start_page || ' to ' || end_page) AS one, string_agg(group_id || '/' || title || '/' || start_page || '/' || end_page || '/page ' || start_page, ';' ORDER BY group_ord) AS sources,
          'span/all/1/0.1;' || string_agg('span/p' || start_page || '/-/0.5', ';' ORDER BY group_ord) AS entities, string_agg(group_id, ';' ORDER BY group_ord) AS ids FROM chosen GROUP BY doc_id)""",
        """SELECT doc_id, coalesce(per.n, 0) AS n, CASE WHEN per.n IS NULL THEN 'No relevant information found in the document.' WHEN per.n = 1 THEN one ELSE per.n || ' parts' END AS answer,
          CASE WHEN per.n IS NULL THEN 0.0::DOUBLE WHEN per.n = 1 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence, coalesce(sources, '') AS sources, coalesce(entities, '') AS entities, coalesce(ids, '') AS groups_processed,
          CASE WHEN per.n IS NULL THEN 0 WHEN per.n = 1 THEN 7 ELSE 7 * per.n + 7 END AS tokens_used, 0 AS failed FROM counts LEFT JOIN per USING (doc_id)""",
    ),
    "executions_by_status": _with(*G, f"SELECT 'j' AS job_id, {EXECUTION} AS execution_id, 'parts' AS flow_name, 'failed' AS status FROM counts WHERE n = 3"),
    "export_batch": _with(
        *G, DONE, REPLY_ENTITIES,
        f"SELECT {EXECUTION} AS execution_id, CASE WHEN total IS NULL THEN 'Summary:' || chr(10) || 'No summary available.' || chr(10) || chr(10) || 'Sections: 0' || chr(10) || 'Entities: 0' || chr(10) || 'Tables: 0' ELSE 'Title: Part 1' || chr(10) || chr(10) || 'Summary:' || chr(10) || summary || chr(10) || chr(10) || 'Sections: 1' || chr(10) || 'Entities: ' || (total + 1) || chr(10) || 'Tables: ' || total END AS output FROM counts LEFT JOIN reply USING (doc_id)",
    ),
    "format_json": _with(
        *WHOLE,
        """js AS (SELECT doc_id, string_agg('{"heading":' || to_json(heading) || ',"content":' || to_json(content) || ',"level":' || level || '}', ',' ORDER BY rank) AS j FROM ranked GROUP BY doc_id)""",
        """je AS (SELECT doc_id, string_agg('{"type":' || to_json(type) || ',"name":' || to_json(name) || ',"confidence":' || confidence || '}', ',' ORDER BY rank) AS j FROM sure GROUP BY doc_id)""",
        f"""jt AS (SELECT doc_id, string_agg('{{"headers":' || {CELLS.format("r[1]", "to_json(x)", ",").replace("array_to_string", "'[' || array_to_string")} || '],"rows":[' || {CELLS.format("r[2:]", "'[' || " + CELLS.format("x", "to_json(y)", ",").replace("lambda x", "lambda y") + " || ']'", ",")} || '],"pageNumber":' || page_no || '}}', ',' ORDER BY k) AS j FROM numbered_tabs GROUP BY doc_id)""",
        f"""jg AS (SELECT doc_id, count(*) AS n, any_value(title) FILTER (group_ord = 0) AS title, string_agg('{{"groupId":"' || group_id || '","startPage":' || start_page || ',"endPage":' || end_page || ',"pageCount":' || page_count || ',"extractedAt":"{NOW}"}}', ',' ORDER BY group_ord) AS j FROM fixed GROUP BY doc_id)""",
        """full_text AS (SELECT doc_id, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY group_ord) AS t FROM contents GROUP BY doc_id)""",
        f"""SELECT doc_id, '{{"title":' || to_json(title) || ',"summary":' || to_json(summary) || ',"sections":[' || coalesce(js.j, '') || '],"entities":[' || coalesce(je.j, '') || '],"tables":[' || coalesce(jt.j, '')
          || '],"metadata":{{"totalGroups":' || n || ',"successfulGroups":' || n || ',"extractedAt":"{NOW}","groups":[' || jg.j || ']}},"fullContent":' || to_json(t) || '}}' AS output
          FROM combined JOIN jg USING (doc_id) JOIN full_text USING (doc_id) LEFT JOIN js USING (doc_id) LEFT JOIN je USING (doc_id) LEFT JOIN jt USING (doc_id)""",
    ),
    "format_markdown": _with(
        *WHOLE,
        "ms AS (SELECT doc_id, string_agg(repeat('#', level + 2) || ' ' || heading || chr(10) || chr(10) || content || chr(10), chr(10) ORDER BY rank) AS t FROM ranked GROUP BY doc_id)",
        "mk AS (SELECT doc_id, type, min(rank) AS r, '### ' || upper(type[1]) || type[2:] || chr(10) || chr(10) || string_agg('- ' || name, chr(10) ORDER BY rank) || chr(10) AS t FROM sure GROUP BY doc_id, type)",
        "me AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY r) AS t FROM mk GROUP BY doc_id)",
        f"""mt AS (SELECT doc_id, string_agg('### Table ' || (k + 1) || chr(10) || chr(10) || '| ' || array_to_string(r[1], ' | ') || ' |' || chr(10) || '| ' || {CELLS.format("r[1]", "'---'", " | ")} || ' |' || chr(10)
          || {CELLS.format("r[2:]", "'| ' || array_to_string(x, ' | ') || ' |' || chr(10)", "")}, chr(10) ORDER BY k) AS t FROM numbered_tabs GROUP BY doc_id)""",
        """SELECT doc_id, '# ' || f.title || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || summary || chr(10) || coalesce(chr(10) || '## Sections' || chr(10) || chr(10) || ms.t, '') || coalesce(chr(10) || '## Entities' || chr(10) || chr(10) || me.t, '')
          || coalesce(chr(10) || '## Tables' || chr(10) || chr(10) || mt.t, '') AS output FROM combined JOIN fixed f USING (doc_id) LEFT JOIN ms USING (doc_id) LEFT JOIN me USING (doc_id) LEFT JOIN mt USING (doc_id) WHERE f.group_ord = 0""",
    ),
    "search_records": _with(
        *WHOLE,
        f"""SELECT doc_id, 'summary' AS id, 'summary' AS type, (SELECT arg_min(title, group_ord) FROM fixed f WHERE f.doc_id = combined.doc_id) AS label, NULL AS headers, NULL AS cells FROM combined
        UNION ALL SELECT doc_id, 'section-' || (rank - 1), 'section', heading, NULL, NULL FROM ranked UNION ALL SELECT doc_id, 'entity-' || (rank - 1), 'entity', name, NULL, NULL FROM sure
        UNION ALL SELECT doc_id, 'table-' || k, 'table', NULL, array_to_string(r[1], '|'), {CELLS.format("r[2:]", "array_to_string(x, '|')", ";")} FROM numbered_tabs""",
    ),
    "section_order": _with(
        *LE, SECTIONS, "firsts AS (SELECT doc_id, min(section_no) AS first, arg_min(heading, section_no) AS heading, arg_min(level, section_no) AS level FROM secs GROUP BY doc_id, lower(heading))",
        f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY {IN_ORDER}) AS rank, heading, level FROM firsts",
    ),
    "merge_group_metadata": _with(*G, f"SELECT doc_id, group_id, start_page, end_page, page_count, '{NOW}' AS extracted_at FROM fixed"),
    "catalog_groups": _with(*G, CATALOGUE, "SELECT catalogue.*, coalesce(k, 0) AS group_count FROM catalogue LEFT JOIN (SELECT doc_id, count(*) AS k FROM fixed GROUP BY doc_id) USING (doc_id)"),
    "catalog_detail": _with(
        *LE, COUNTS, FIXED, TOC, CATALOGUE,
        """SELECT doc_id, title, author, g AS groups, t AS toc FROM catalogue LEFT JOIN (SELECT doc_id, string_agg(group_id || '/' || title || '/' || start_page || '/' || end_page || '/' || type, ';' ORDER BY group_ord) AS g FROM fixed GROUP BY doc_id) USING (doc_id)
          LEFT JOIN (SELECT doc_id, string_agg(level || '/' || title || '/' || page_no, ';' ORDER BY toc_ord) AS t FROM toc GROUP BY doc_id) USING (doc_id)""",
    ),
    "group_detail": _with(*G, "SELECT doc_id, group_id, any_value(title) AS title, any_value(page_count) AS page_count, string_agg(page_no || '/' || text[1:20] || CASE WHEN length(text) > 20 THEN '...' ELSE '' END, ';' ORDER BY page_no) AS preview FROM fixed JOIN pages USING (doc_id) WHERE page_no BETWEEN start_page AND end_page GROUP BY doc_id, group_id"),
    "custom_patterns": _with(PAGES, LINES, "SELECT doc_id, page_no, line_no, CASE WHEN text LIKE 'Order %' THEN 1 ELSE 2 END AS level FROM lines WHERE regexp_matches(text, '^Order \\d+') OR text LIKE 'contact %' OR text = 'MEDIUM PRIORITY'"),
    "document_dates": "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '2020-01-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || ' 03:04:05' END AS creation_date FROM customer",
    "outline_page_refs": """WITH o AS (
      SELECT r_regionkey AS doc_id, 1 AS level, r_name AS title, 1 AS page_no, -1 AS a FROM region UNION ALL SELECT n_regionkey, 2, n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 10 ELSE 1 END, n_nationkey FROM nation)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS toc_ord, level, title, page_no FROM o""",
}


#: Documents in pages of 20 lines.
_PDF = """
WITH l AS (
  SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), p AS (
  SELECT doc_id, source, CAST(unnest(range(1, (len(l) - 1) // 20 + 2)) AS INTEGER) AS k, l FROM l
)
"""

ORACLES["pdf_pages"] = _PDF + """
SELECT doc_id, k AS page_no, coalesce(array_to_string(list_filter(l[k * 20 - 19 : k * 20], lambda x: x <> ''), chr(10)), '') AS text, 595.0::DOUBLE AS width, 842.0::DOUBLE AS height, NULL::VARCHAR AS error FROM p
"""

ORACLES["pdf_metadata"] = _PDF + """
SELECT doc_id, 'doc ' || doc_id AS title, nullif(source, '') AS author, NULL::VARCHAR AS subject, max(k) AS page_count FROM p GROUP BY doc_id, source
"""

ORACLES["pdf_outline"] = _PDF + """
SELECT doc_id, k AS toc_ord, 1 + CAST(k % 2 = 0 AS INTEGER) AS level, 'Page ' || k || ' of ' || coalesce(source, '?') AS title, CASE WHEN k % 5 = 0 THEN 1 ELSE k END AS page_no FROM p
"""


#: Parts of ten pages whose extraction succeeds, and what the client adds to each.
ORACLES["custom_fields"] = """
WITH d AS (
  SELECT o_custkey AS doc_id, count(*) AS n FROM orders GROUP BY o_custkey
), g AS (
  SELECT doc_id, a, least(a + 9, n) AS b FROM (SELECT doc_id, n, unnest(range(1, n + 1, 10)) AS a FROM d)
), p AS (SELECT * FROM g WHERE a <> 21 AND b <> 3)
SELECT doc_id,
  CAST(min_by(b - a + 1, a) FILTER (WHERE a > 1) AS INTEGER) AS span,
  string_agg('t' || a % 3 || ',u' || a, ',' ORDER BY a) AS tags,
  'n' || min(a) AS owner, CAST(min(a) % 5 AS INTEGER) AS level,
  '{"color":"c' || min(a) % 4 || '"' || coalesce(',"even":' || min(b) FILTER (WHERE b % 2 = 0), '') || '}' AS rest
FROM p GROUP BY doc_id
"""


#: Sent again: what the first run had no reply for. Parts from page 21 on and those that end on page 3 have none in either.
ORACLES["resumed_calls"] = """
WITH d AS (
  SELECT o_custkey AS doc_id, count(*) AS n FROM orders GROUP BY o_custkey
), g AS (
  SELECT doc_id, a, least(a + 9, n) AS b FROM (SELECT doc_id, n, unnest(range(1, n + 1, 10)) AS a FROM d)
)
SELECT doc_id, CAST(a // 10 AS INTEGER) AS group_ord, a <> 21 AND b <> 3 AS success, a = 11 OR a = 21 OR b = 3 AS sent,
  CAST(CASE WHEN a <> 21 AND b <> 3 THEN 7 ELSE 0 END AS BIGINT) AS tokens_used, CASE WHEN a <> 21 AND b <> 3 THEN 'Part ' || a END AS title FROM g
"""


ORACLES["export_files"] = ORACLES["export_batch"]



def _bm25(texts: str, questions: str) -> str:
    """CTEs up to scored (question_id, doc_id, group_ord, score) of texts (doc_id, group_ord, text) for questions (question_id, question)."""
    words = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+')"
    return f"""own AS ({texts}
), split AS (
  SELECT doc_id, group_ord, {words.format("text")} AS w FROM own
), post AS (
  SELECT doc_id, group_ord, len(w) AS length, term, count(*) AS tf FROM (SELECT doc_id, group_ord, w, unnest(w) AS term FROM split) GROUP BY ALL
), vocabulary AS (SELECT term, count(*) AS df FROM post GROUP BY term
), total AS (SELECT count(*) AS n, avg(len(w)) AS average FROM split
), ask AS (
  SELECT question_id, unnest(list_distinct({words.format("question")})) AS term FROM ({questions})
), hits AS (
  SELECT question_id, doc_id, group_ord, term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / average))) AS s
  FROM ask JOIN vocabulary USING (term) JOIN post USING (term), total
), scored AS (
  SELECT question_id, doc_id, group_ord, list_reduce(list(s ORDER BY term), lambda a, b: a + b) AS score FROM hits GROUP BY ALL
)"""


ORACLES["search_bm25"] = _with(
    _bm25("SELECT doc_id, 0 AS group_ord, text FROM documents", "SELECT item_id AS question_id, text AS question FROM benchmark"),
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, group_ord) AS rank FROM scored)",
    "SELECT question_id, doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10",
)

ORACLES["search_routing"] = _with(
    *G,
    _bm25("SELECT fixed.doc_id, fixed.group_ord, any_value(fixed.title) || chr(10) || string_agg(pages.text, chr(10) ORDER BY page_no) AS text FROM fixed JOIN pages ON pages.doc_id = fixed.doc_id AND page_no BETWEEN start_page AND end_page GROUP BY fixed.doc_id, fixed.group_ord", "SELECT 0 AS question_id, 'Urgent orders due March 28?' AS question"),
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, group_ord) AS rank FROM scored)",
    "SELECT doc_id, group_ord, group_id FROM fixed WHERE (doc_id, group_ord) IN (SELECT (doc_id, group_ord) FROM ranked WHERE rank <= 2) OR doc_id NOT IN (SELECT doc_id FROM ranked)",
)



def _indented(json: str) -> str:
    """Two spaces a level, where the engine writes four; no text of the reports has four in a row."""
    return f"replace(json_pretty({json}), '    ', '  ')"


ORACLES["format_json_indented"] = f"SELECT doc_id, {_indented('output::JSON')} AS output FROM ({ORACLES['format_json']})"

ORACLES["format_markdown_metadata"] = f"""
SELECT m.doc_id, m.output || chr(10) || '## Metadata' || chr(10) || chr(10) || '```json' || chr(10) || {_indented("j.output::JSON -> 'metadata'")} || chr(10) || '```' AS output
FROM ({ORACLES["format_markdown"]}) m JOIN ({ORACLES["format_json"]}) j ON j.doc_id = m.doc_id
"""


def _records(part: str, kind: str, **fields: str) -> str:
    pairs = ", ".join(f"'{k}', json_extract(j, '$.{part}[' || i || '].{v}')" for k, v in fields.items())
    return f"list_transform(range(json_array_length(j, '$.{part}')::BIGINT), lambda i: json_object('id', '{kind}-' || i, 'type', '{kind}', {pairs}))"


ORACLES["search_index_text"] = f"""
WITH j AS (SELECT doc_id, output::JSON AS j FROM ({ORACLES["format_json"]}))
SELECT doc_id, {_indented(f"""json_object('title', j -> 'title', 'documents', list_concat(
  [json_object('id', 'summary', 'type', 'summary', 'content', j -> 'summary', 'title', j -> 'title')],
  {_records("sections", "section", heading="heading", content="content", level="level")},
  {_records("entities", "entity", entityType="type", name="name", confidence="confidence")},
  {_records("tables", "table", headers="headers", rows="rows", pageNumber="pageNumber")}), 'metadata', j -> 'metadata')""")} AS output FROM j
"""


ORACLES["merged_in_parts"] = ORACLES["format_json"]


ORACLES["agent_sql"] = _with(
    *G,
    """per AS (
  SELECT fixed.doc_id, fixed.group_ord, page_count, CAST(sum(len(string_split(pages.text, chr(10)))) AS INTEGER) AS n_lines, CAST(max(list_max(list_transform(string_split(pages.text, chr(10)), lambda x: length(x)))) AS INTEGER) AS longest, CAST(end_page AS INTEGER) AS seen
  FROM fixed JOIN pages ON pages.doc_id = fixed.doc_id AND page_no BETWEEN start_page AND end_page GROUP BY ALL
)""",
    "SELECT doc_id, group_ord, CASE WHEN page_count <> 9 THEN n_lines END AS n_lines, CASE WHEN page_count <> 9 THEN longest END AS longest, CASE WHEN page_count <> 9 THEN seen END AS seen, page_count <> 9 AS success, CASE WHEN page_count = 9 THEN 'nine pages' END AS error FROM per",
)
