"""DuckDB SQL for the operators that SQL can express: the n-gram join by
counting common n-grams of all pairs that share one, and the quality rules;
``mining_sql`` has phrases, hard negatives and sharding.  (The others run tokenizers, fitted models or a hash index.)"""

from __future__ import annotations

from relaylens.llm import ngram_join, repetition
from relaylens.llm.mining_sql import collocations_sql, hard_negatives_sql, sharding_sql


def ngram_join_sql() -> str:
    n = ngram_join.NGRAM
    return f"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM documents
),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' ')) END) AS gram
  FROM w
),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE c >= {ngram_join.THRESHOLD} * (x.n + y.n - c) - 1e-9
),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other
)
SELECT r.doc_id, min(r.other) AS class_id, CAST((SELECT count(*) FROM edge e WHERE e.a = r.doc_id) AS BIGINT) AS n_links
FROM reach r GROUP BY r.doc_id"""


def quality_rules_sql() -> str:
    word, space = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
    sizes = ", ".join(f"({n})" for n in repetition.NGRAM_LIMITS)
    limits = " AND ".join(f"dup_share_{n} <= {v}" for n, v in repetition.NGRAM_LIMITS.items())
    shares = ", ".join(
        f"coalesce(CAST(sum(chars) FILTER (WHERE n = {n}) AS DOUBLE), 0) AS chars_{n}" for n in repetition.NGRAM_LIMITS
    )
    columns = ", ".join(
        f"CASE WHEN word_chars = 0 THEN 0.0 ELSE coalesce(chars_{n}, 0) / word_chars END AS dup_share_{n}" for n in repetition.NGRAM_LIMITS
    )
    return f"""WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents
),
run AS (
  SELECT doc_id, n, i, row_number() OVER same AS nth, count(*) OVER (PARTITION BY doc_id, n, gram) AS times
  FROM (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS gram
        FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM t, (VALUES {sizes}) v(n)))
  WINDOW same AS (PARTITION BY doc_id, n, gram ORDER BY i)
),
covered AS (
  SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS place FROM run WHERE nth > 1
),
chars AS (
  SELECT doc_id, {shares}
  FROM (SELECT c.doc_id, c.n, length(t.ws[c.place]) AS chars FROM covered c JOIN t USING (doc_id)) GROUP BY doc_id
),
repeated AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM run WHERE n = {repetition.WINDOW} AND times > 1) GROUP BY doc_id
),
line AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY place) AS nth
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM t)
  WHERE regexp_matches(line, '{word}')
),
again AS (
  SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '{space}', '', 'g'))) AS line_chars
  FROM line WHERE nth > 1 GROUP BY doc_id
),
m AS (
  SELECT t.doc_id, len(ws) AS n_words, length(regexp_replace(text, '{space}', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(line_chars, 0) AS line_chars, chars.* EXCLUDE (doc_id)
  FROM t LEFT JOIN chars USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN again USING (doc_id)
),
v AS (
  SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words AS base_failed,
         CASE WHEN word_chars = 0 THEN 0.0 ELSE CAST(line_chars AS DOUBLE) / word_chars END AS dup_line_share, {columns}
  FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND dup_line_share <= {repetition.LINE_LIMIT} AND {limits} AS kept, CAST(dup_line_share AS DOUBLE) AS dup_line_share,
       {", ".join(f"CAST(dup_share_{n} AS DOUBLE) AS dup_share_{n}" for n in repetition.NGRAM_LIMITS)}
FROM v"""


def oracle() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": ngram_join_sql(),
        "op7_quality_rules": quality_rules_sql(),
        "op11_phrase_mining": collocations_sql(),
        "op12_hard_negatives": hard_negatives_sql(),
        "op13_sharding": sharding_sql(),
    }
