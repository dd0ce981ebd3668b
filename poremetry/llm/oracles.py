"""DuckDB twins of the language-model queries that SQL can express on whole tables."""

from __future__ import annotations

from poremetry.llm import decontaminate, licenses, url_filters


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_scan() -> str:
    wordings = ", ".join(f"({t}, {_text(label)}, {_text(wording)})" for t, (label, wording, _) in enumerate(licenses.TEMPLATES))
    required = ", ".join(f"({t}, {_text(' ' + phrase + ' ')})" for t, (*_, phrases) in enumerate(licenses.TEMPLATES) for phrase in phrases)
    common = ", ".join(_text(w) for w in sorted(licenses.COMMON))
    return rf"""
WITH files AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
words AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS place FROM files),
seen AS (
  SELECT *, lead(word, 1) OVER o AS second, lead(word, 2) OVER o AS third FROM words WINDOW o AS (PARTITION BY rid ORDER BY place)),
base AS (
  SELECT rid, place, CASE WHEN word = 'cc' AND second = 'by' THEN 'cc-by'
                          WHEN word = 'general' AND second = 'public' AND third = 'license' THEN 'gpl'
                          WHEN word = 'all' AND second = 'rights' AND third = 'reserved' THEN 'reserved' END AS label
  FROM seen),
base_of AS (
  SELECT rid, count(*) AS n, min(place) AS a, max(place) AS z, list(DISTINCT label) AS labels FROM base WHERE label IS NOT NULL GROUP BY rid),
wordings(template, label, wording) AS (VALUES {wordings}),
required(template, phrase) AS (VALUES {required}),
spread AS (
  SELECT template, label, unnest(string_split(wording, ' ')) AS word, generate_subscripts(string_split(wording, ' '), 1) - 1 AS place FROM wordings),
rare AS (SELECT * FROM spread WHERE word NOT IN ({common})),
frequency AS (SELECT word, count(DISTINCT rid) AS n FROM words WHERE word IN (SELECT word FROM rare) GROUP BY word),
weighed AS (
  SELECT template, label, r.place, r.word,
         CAST(floor(1000 * ln(((SELECT count(*) FROM documents) + 1) / (coalesce(n, 0) + 1))) AS BIGINT) AS weight
  FROM rare r LEFT JOIN frequency USING (word)),
postings AS (
  SELECT *, row_number() OVER (PARTITION BY template ORDER BY weight DESC, word, place) <= {licenses.PROBES} AS probe FROM weighed),
totals AS (SELECT template, sum(weight) AS total FROM postings GROUP BY template),
lined AS (
  SELECT rid, template, label, w.place - p.place AS start, sum(weight) AS weight, bool_or(probe) AS probe
  FROM words w JOIN postings p USING (word) GROUP BY ALL),
shares AS (
  SELECT rid, template, label, max(weight / total) AS share FROM lined JOIN totals USING (template)
  WHERE probe AND weight >= {licenses.SHARE} * total GROUP BY ALL),
joined AS (SELECT rid, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM files WHERE rid IN (SELECT rid FROM shares)),
verified AS (
  SELECT rid, label, share FROM shares s JOIN joined USING (rid)
  WHERE NOT EXISTS (SELECT 1 FROM required r WHERE r.template = s.template AND NOT contains(line, r.phrase))),
more AS (SELECT rid, list(DISTINCT label) AS labels, max(share) AS share FROM verified GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(b.labels, m.labels))), ','), '') AS labels,
       CAST(CASE WHEN n > 0 THEN 1.0 ELSE coalesce(m.share, 0.0) END AS DOUBLE) AS score
FROM files f LEFT JOIN base_of b USING (rid) LEFT JOIN more m USING (rid)
"""


def quality_rule_verdicts() -> str:
    """Limits: median + 6 (upper decile - median), word length half the lower to twice the upper quartile, 20 documents of the wider kind mixed in."""
    names = ["symbols", "dup_lines", "repeats", "capitals"]
    unpivot = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM rated" for m in [*names, "length"])
    upper = ", ".join(f"max(CASE WHEN measure = '{m}' THEN q50 + 6 * (q90 - q50) END) AS {m}" for m in names)
    both = [*names, "shortest", "longest"]
    mixed = lambda own, wide: ", ".join(f"({own}.n_docs * {own}.{m} + 20 * {wide}.{m}) // ({own}.n_docs + 20) AS {m}" for m in both)
    counts = [("symbols", "n_symbols", 2), ("dup_lines", "n_dup_lines", 2), ("repeats", "n_repeat_words", 6), ("capitals", "n_capitals", 2)]
    within = " AND ".join(f"(r.{m} <= t.{m} OR r.{n} <= {few})" for m, n, few in counts)
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, coalesce(text, '') AS t
  FROM documents),
split AS (
  SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')) AS ls
  FROM texts),
words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split),
windows AS (SELECT rid, i, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
again AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM windows WHERE c IS NOT NULL),
covered AS (
  SELECT rid, count(DISTINCT i + d) AS n FROM again, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1 GROUP BY rid),
counted AS (
  SELECT s.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals, CAST(len(ls) AS BIGINT) AS n_lines
  FROM split s LEFT JOIN covered c USING (rid)),
rated AS (
  SELECT *, coalesce(1000 * n_symbols // nullif(n_words, 0), 0) AS symbols, coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS dup_lines,
         coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS repeats, coalesce(1000 * n_capitals // nullif(word_chars, 0), 0) AS capitals,
         coalesce(100 * word_chars // nullif(n_words, 0), 0) AS length
  FROM counted),
long AS ({unpivot}),
binned AS (
  SELECT lang, source, measure,
         CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS bin
  FROM long),
kinds AS (
  SELECT lang, source, measure, bin FROM binned
  UNION ALL SELECT lang, NULL, measure, bin FROM binned UNION ALL SELECT NULL, NULL, measure, bin FROM binned),
summed AS (SELECT lang, source, measure, bin, count(*) AS n FROM kinds GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (k ORDER BY bin) AS upto, sum(n) OVER k AS total FROM summed WINDOW k AS (PARTITION BY lang, source, measure)),
quantiles AS (
  SELECT lang, source, measure, max(total) AS total, min(CASE WHEN 100 * upto >= 25 * total THEN bin END) AS q25,
         min(CASE WHEN 100 * upto >= 50 * total THEN bin END) AS q50, min(CASE WHEN 100 * upto >= 75 * total THEN bin END) AS q75,
         min(CASE WHEN 100 * upto >= 90 * total THEN bin END) AS q90
  FROM ranked GROUP BY lang, source, measure),
limits AS (
  SELECT lang, source, max(total) AS n_docs, {upper},
         max(CASE WHEN measure = 'length' THEN q25 END) // 2 AS shortest, 2 * max(CASE WHEN measure = 'length' THEN q75 END) AS longest
  FROM quantiles GROUP BY lang, source),
of_lang AS (SELECT l.lang, {mixed("l", "w")} FROM limits l JOIN limits w ON w.lang IS NULL WHERE l.lang IS NOT NULL AND l.source IS NULL),
thresholds AS (SELECT o.lang AS for_lang, o.source AS for_source, {mixed("o", "w")} FROM limits o JOIN of_lang w ON w.lang = o.lang WHERE o.source IS NOT NULL),
judged AS (
  SELECT r.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         {within} AND r.length BETWEEN t.shortest AND t.longest AS fits
  FROM rated r JOIN thresholds t ON for_lang = r.lang AND for_source = r.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fits AS kept FROM judged
"""


def url_verdicts() -> str:
    rules = ", ".join(f"({_text(v)}, {_text(r)})" for v, r in url_filters.BASE_RULES)

    def regex(glob: str) -> str:
        out = glob.replace(".", "[.]").replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*").replace("?", "[^/]")
        return f"regexp_full_match('.' || host || path, {_text(out)}, 's')"

    own = " OR ".join(regex(g) for g in url_filters.OWN_GLOBS)
    return rf"""
WITH parts AS (
  SELECT row_number() OVER () AS rid, page_id,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1) ELSE '' END AS h,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) ELSE '' END AS path
  FROM pages),
clean AS (SELECT rid, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
rules(verdict, rule) AS (VALUES {rules}),
fitting AS (
  SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM clean, rules
  WHERE ends_with('.' || host, '.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {own} THEN 'block' ELSE 'allow' END) AS verdict
FROM clean LEFT JOIN fitting USING (rid)
"""


def contaminated() -> str:
    return rf"""
WITH tokens AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') FROM benchmark),
placed AS (SELECT kind, id, row_number() OVER () AS rid, ws FROM tokens),
words AS (SELECT kind, id, rid, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM placed),
shingles AS (
  SELECT kind, id, n, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s
  FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
of_item AS (SELECT DISTINCT id AS item_id, s FROM shingles WHERE kind = 'i' AND s IS NOT NULL),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM of_item GROUP BY item_id),
common AS (
  SELECT id AS doc_id, item_id, count(DISTINCT s) AS n_common FROM shingles JOIN of_item USING (s) WHERE kind = 'd' GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_common, n_common / n_shingles AS containment
FROM common JOIN sizes USING (item_id) WHERE 100 * n_common >= {decontaminate.CONTAINMENT} * n_shingles
"""


def without_repeats() -> str:
    """Every 50-byte string of every document as hexadecimal text."""
    return """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
w AS (SELECT r, doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT r, doc_id, x, unnest(range(0, greatest(0, length(x) // 2 - 49))) AS i FROM d)),
f AS (SELECT r, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS again FROM w),
g AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM f WHERE again),
h AS (SELECT r, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM g),
spans AS (SELECT r, span, min(i) AS a, max(i) + 50 AS b FROM h GROUP BY r, span),
pieces AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS done, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front
         FROM pieces JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(x, 2 * coalesce(done, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


ORACLES = {"op1_license_scan": license_scan(), "op7_quality_rules": quality_rule_verdicts(), "op8_url_filter": url_verdicts(),
           "op10_decontaminate": contaminated(), "op13_suffix_dedup": without_repeats()}
