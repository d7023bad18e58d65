"""DuckDB SQL of the operators on phrases, hard negatives and shards."""

from __future__ import annotations

from relaylens.llm import hard_negatives, phrases, sharding


def collocations_sql() -> str:
    sizes = ", ".join(f"({n})" for n in range(1, phrases.LONGEST + 1))
    return f"""WITH p AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{phrases.BREAK}')) AS piece FROM documents)
),
total AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM p GROUP BY lang),
f AS (
  SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f
  FROM (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
        FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (VALUES {sizes}) v(k) WHERE len(ws) >= k))
  GROUP BY lang, k, phrase HAVING count(*) >= {phrases.LEAST}
),
cand AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
inner_run AS (
  SELECT DISTINCT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, a
  FROM (SELECT lang, ws, a, size, k, unnest(range(1, size - k + 2)) AS i FROM cand, (VALUES {sizes}) v(k) WHERE k > 1 AND k < size)
),
alone AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM inner_run i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)),
cut AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM alone)
),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, t.n, (1000 * c.a * t.n) // (l.f * r.f) AS score
  FROM cut c JOIN f l ON l.lang = c.lang AND l.phrase = c.lp JOIN f r ON r.lang = c.lang AND r.phrase = c.rp JOIN total t ON t.lang = c.lang
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= {phrases.TOP}"""


def hard_negatives_sql() -> str:
    h = hard_negatives
    return f"""WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({h.SCALE} * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
pos AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {h.POSITIVES}
),
met AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM pos p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
   AND {h.LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {h.HIGH} * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM met WHERE rank <= {h.NEGATIVES}"""


def permuted_sql(x: str, n: int | str, keys: list[tuple[int, int]]) -> str:
    """One step of the permutation of ``a * b`` numbers, as SQL over a column
    ``x`` beside columns ``a`` and ``b``."""
    mixed = lambda half, k: (
        f"(xor(({half} + {k[0]}) % {sharding.PRIME} * {sharding.FIRST} % {sharding.PRIME}, {k[1]}) * {sharding.SECOND} % {sharding.PRIME})"
    )
    sql = f"SELECT *, {x} // b AS lhs, {x} % b AS rhs FROM {n}"
    for i, key in enumerate(keys):
        if i % 2 == 0:
            sql = f"SELECT * REPLACE ((lhs + {mixed('rhs', key)}) % a AS lhs) FROM ({sql})"
        else:
            sql = f"SELECT * REPLACE ((rhs + {mixed('lhs', key)}) % b AS rhs) FROM ({sql})"
    return f"SELECT * EXCLUDE (lhs, rhs) REPLACE (lhs * b + rhs AS {x}) FROM ({sql})"


def sharding_sql() -> str:
    keys = sharding.Permutation(1).keys
    # the checksum's table by its rule: eight shifts of each byte
    return f"""WITH RECURSIVE bit_step(byte, i, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT byte, i + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bit_step WHERE i < 8
),
crc_table AS (SELECT list(v ORDER BY byte) AS t FROM bit_step WHERE i = 8),
doc AS (
  SELECT doc_id, CAST(octet_length(encode(text)) + 8 AS BIGINT) AS size,
         list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))) AS bytes
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
),
summed AS (
  SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c // 256, t[CAST(xor(c % 256, x) AS BIGINT) + 1])), 4294967295) AS text_crc32
  FROM doc, crc_table
),
numbered AS (
  SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row, count(*) OVER () AS n FROM summed
),
halves AS (
  SELECT *, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a, row AS p FROM numbered)
),
walk AS (
  SELECT *, 0 AS steps FROM ({permuted_sql("p", "halves", keys)})
  UNION ALL
  SELECT * EXCLUDE (steps), steps + 1 AS steps FROM ({permuted_sql("p", "(SELECT * FROM walk WHERE p >= n)", keys)})
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % {sharding.SHARDS} AS INTEGER) AS shard, CAST(p // {sharding.SHARDS} AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, CAST(row AS BIGINT) AS row
FROM walk WHERE p < n"""
