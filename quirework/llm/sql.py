"""DuckDB SQL for the operators that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Exact all-pairs version over an inverted index of shingles.
NEAR_DUPS = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w
), x AS (SELECT doc_id, unnest(s) AS g FROM s
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT u, v FROM pairs JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v WHERE 100 * n >= 75 * (len(a.s) + len(b.s) - n)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON c.a = s.doc_id
"""

ORACLES = {"op2_minhash_near_dups": NEAR_DUPS}

SUBSTRINGS = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)
), f AS (SELECT h, min(doc_id) AS least FROM x GROUP BY h
), r AS (SELECT x.doc_id, list_distinct(flatten(list(range(x.i, x.i + 50)))) AS gone FROM x JOIN f ON x.h = f.h AND x.doc_id > f.least GROUP BY x.doc_id
), k AS (
  SELECT w.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN w ELSE list_transform(list_sort(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains(gone, i) THEN 0 ELSE i END), lambda i: i > 0)), lambda i: w[i]) END AS kept
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""

ORACLES["op7_substring_dedup"] = SUBSTRINGS

#: Same hashes and the same inverse; weights are those of the query.
MIXING = """
WITH s AS (
  SELECT source, count(*) AS n, sum(coalesce(length(text), 0) + 1)::DOUBLE AS chars,
    CASE source WHEN 'src0' THEN 3.0 WHEN 'src1' THEN 2.0 WHEN 'src2' THEN 0.5 ELSE 1.0 END::DOUBLE AS weight
  FROM documents GROUP BY source
), r AS (
  SELECT source, weight / sum(weight) OVER () * sum(chars) OVER () / chars AS rate FROM s
), u AS (
  SELECT d.*, r.rate, ('0x' || substr(md5('17:n:' || d.doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), p AS (
  SELECT source, k, rate, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM r, range(0, 80) t(k)
), c AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p
), n AS (
  SELECT u.doc_id, count(*) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.c <= u.u GROUP BY u.doc_id
)
SELECT u.doc_id, u.source, u.text, k::INT AS mix_copy, n.n::INT AS mix_copies,
  ('0x' || substr(md5('17:k:' || u.doc_id || ':' || k), 1, 13))::BIGINT AS mix_key
FROM u JOIN n USING (doc_id), range(1, 80) t(k) WHERE k <= n.n
"""

ORACLES["op1_source_mixing"] = MIXING

#: CRC-32 of each distinct word from its bytes, with the table of the polynomial made by rule.
RESAMPLING = f"""
WITH t AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS crc
), d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), m AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark
), x AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY ALL
), h AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM x UNION SELECT w FROM m)
), b AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
    lambda c, k: xor(c >> 8, crc[xor(c, k) % 256 + 1])), 4294967295::BIGINT) % 10000 AS b FROM h, t
), s AS (SELECT b, sum(n)::DOUBLE AS s FROM x JOIN b USING (w) GROUP BY b
), r AS (SELECT b, count(*)::DOUBLE AS t FROM m JOIN b USING (w) GROUP BY b
), g AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM r) + 10000)))) AS gain
  FROM s FULL JOIN r USING (b)
), w AS (SELECT doc_id, floor(sum(n * gain) / sum(n)) AS weight FROM x JOIN b USING (w) JOIN g USING (b) GROUP BY doc_id
), o AS (
  SELECT d.doc_id, len(d.w) AS n_features, coalesce(w.weight, 0)::BIGINT AS weight,
    coalesce(w.weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w ON w.doc_id = d.doc_id
), k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n_features >= 20
)
SELECT o.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM k) * 10 // 100 THEN rank END AS rank FROM o LEFT JOIN k ON k.doc_id = o.doc_id
"""

ORACLES["op13_importance_resampling"] = RESAMPLING

#: For pages whose article is in one element of that name and holds titles, paragraphs, bold text and line breaks.
MAIN_TEXT = """
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<br>', ' ', 'g') AS a FROM pages
), b AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(a, '</?(?:p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS b FROM a
), d AS (
  SELECT page_id, url, list_transform(b, lambda x: replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&')) AS b FROM b
), t AS (
  SELECT page_id, url, list_filter(list_transform(b, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM d
)
SELECT page_id, url, coalesce(array_to_string(b, chr(10) || chr(10)), '') AS text, length(coalesce(array_to_string(b, chr(10) || chr(10)), '')) AS n_chars, len(b) AS n_blocks FROM t
"""

ORACLES["op12_html_extraction"] = MAIN_TEXT
