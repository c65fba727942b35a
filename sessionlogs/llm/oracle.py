"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}'), lambda w: w <> '') AS w
  FROM documents
), items AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END) AS item FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id),
both_in AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM items a JOIN items b ON a.item = b.item JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY 1, 2
), links AS (
  SELECT a, b FROM both_in JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
  SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least_of AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.other, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(r.other, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_of r USING (doc_id)
"""

WARC = """
WITH hashed AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
fives AS (SELECT page_id, body, list_transform(range(8), lambda i: ('0x' || hex[(5 * i + 1):(5 * i + 5)])::BIGINT) AS v, max(page_id) OVER (PARTITION BY hex) AS last FROM hashed)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
  list_reduce(list_transform(v, lambda x: list_reduce(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s::INT) & 31)::INT + 1, 1)), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to, NULL::VARCHAR AS error
FROM fives
"""

# The stop words of the rule table.
STOP_WORDS = (
    "the be to of and that have with a in is it for was as on are by this from or an at "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur avec "
    "el que y los se del las por con no una su para es al lo como"
)

QUALITY = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i:i + 7] AS win FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM base)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(c.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: list_contains(string_split('{STOP_WORDS}', ' '), lower(x)))) AS n_stop_words
  FROM base LEFT JOIN covered c USING (doc_id)
), ratios AS (
  SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_ratio,
    coalesce(n_stop_words / nullif(n_words, 0), 0) AS stop_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
    coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_ratio
  FROM counts
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    array_to_string(list_filter([
      CASE WHEN n_words < 20 THEN 'n_words' END, CASE WHEN repeat_ratio > 0.3 THEN 'repeat_ratio' END,
      CASE WHEN mean_word_chars < 2 OR mean_word_chars > 14 THEN 'mean_word_chars' END, CASE WHEN symbol_ratio > 0.3 THEN 'symbol_ratio' END,
      CASE WHEN stop_ratio < 0.02 THEN 'stop_ratio' END, CASE WHEN dup_line_ratio > 0.3 THEN 'dup_line_ratio' END], lambda x: x IS NOT NULL), ',') AS failed_rules
  FROM ratios
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules = '' AND NOT base_failed AS kept, failed_rules FROM judged
"""

# The names of the rules for junk hosts.
JUNK = "casino adult porn xxx escort viagra poker betting cheap-pills free-bets ads-track ad-server spam-farm link-farm click-bait"

URL_FILTER = rf"""
WITH parts AS (
  SELECT row_number() OVER () AS k, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(rule, h, p, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
site AS (
  SELECT k, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k
), junk AS (
  SELECT k, min('host:' || name) AS name FROM parts, unnest(string_split('{JUNK}', ' ')) AS names(name)
  WHERE regexp_matches(host, '(^|[.-])' || replace(name, '-', '[.-]') || '([.-]|$)') GROUP BY k
)
SELECT page_id, host, path, s.rule, coalesce(s.verdict, CASE WHEN j.name IS NOT NULL THEN 'block' END, 'allow') AS verdict,
  CASE WHEN s.rule IS NULL THEN j.name END AS junk_rule
FROM parts LEFT JOIN site s USING (k) LEFT JOIN junk j USING (k)
"""

MIXING = rf"""
WITH docs AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda w: w <> ''))::BIGINT AS size,
    ('0x' || substr(md5(doc_id || ':42'), 1, 15))::BIGINT AS key, text FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w FROM docs GROUP BY source
), ranked AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER o AS k, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w
  FROM sources WINDOW o AS (ORDER BY 3 * source_size / w, source IS NULL, source)
), first_open AS (SELECT k, total - capped AS rest, rest_w FROM ranked WHERE (total - capped) * w / rest_w <= cap ORDER BY k LIMIT 1),
targets AS (
  SELECT r.source, r.source_size, CASE WHEN r.k < f.k THEN r.cap::DOUBLE ELSE (f.rest * r.w)::DOUBLE / f.rest_w END AS target FROM ranked r, first_open f
), placed AS (
  SELECT doc_id, size, source_size, target, round(target)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(size, greatest(0, budget % source_size - start)) END::BIGINT AS taken
FROM placed
"""

LEXICAL_SEARCH = r"""
WITH doc_terms AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), held AS (SELECT row_no, doc_id, len(w) AS n, w FROM doc_terms WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM held),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), postings AS (SELECT row_no, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row_no, doc_id, n, unnest(w) AS term FROM held) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
scores AS (
  SELECT item_id, row_no, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n::BIGINT * n_docs) // n_terms)))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY item_id, row_no, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""

ORACLES: dict[str, str] = {
    "op3_near_duplicates": NEAR_DUPLICATES,
    "op4_warc": WARC,
    "op6_quality_rules": QUALITY,
    "op8_url_filter": URL_FILTER,
    "op9_mixing": MIXING,
    "op13_lexical_search": LEXICAL_SEARCH,
}
