"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP9 = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bw AS MATERIALIZED (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0))
), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))
), hits AS MATERIALIZED (
  SELECT doc_id, k, i, item_id FROM dw JOIN bw USING (k, g)
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(cover.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5 = """
WITH e AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""

#: By text alone, without hashes or chunks: of two adjacent lines that occur before, anywhere,
#: both go, unless they overlap that first occurrence.  A chunk is made of such pairs.  Ids are
#: unique here, so (doc_id, line) orders occurrences.
OP3 = """
WITH l AS MATERIALIZED (
  SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
), p AS (
  SELECT doc_id, i, x || chr(10) || lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS t FROM l
), f AS (
  SELECT doc_id, i, first_value(doc_id) OVER w AS fd, first_value(i) OVER w AS fi FROM p WHERE t IS NOT NULL AND regexp_matches(t, '[^ \\t\\n\\f\\r\\x0B]')
  WINDOW w AS (PARTITION BY t ORDER BY doc_id, i)
), gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest([i, i + 1]) AS i FROM f WHERE fd <> doc_id OR i >= fi + 2
), kept AS (
  SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t, count(*) AS n FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(n.n, 0) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.t, '') END AS text
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: CRC-32 byte by byte: the table of the reflected polynomial is made by its rule.
OP11 = """
WITH t AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(i AS BIGINT))) AS crc
), h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), d AS (
  SELECT doc_id, len(x) // 2 + 1 AS size,
         xor(list_reduce(list_transform(regexp_extract_all(x, '..'), lambda h: CAST(('0x' || h) AS BIGINT)),
                         lambda c, b: xor(c // 256, t.crc[xor(c % 256, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
  FROM h, t
), r AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS run, sum(size) OVER () AS total FROM d
), s AS (
  SELECT *, CAST(((2 * run - size) * 8) // (2 * total) AS INTEGER) AS shard FROM r
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""


def _codes_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Every round spelled out: nearest entries, then floored means."""
    gap = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.c[i]) * (p.x[i] - b.c[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT n, part, min({gap} * {entries} + entry) AS m FROM p JOIN b{r} b USING (part) GROUP BY n, part)")
        if r < rounds:
            steps.append(
                f"""b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(u.c, b.c) AS c FROM b{r} b LEFT JOIN (
                      SELECT part, entry, list(v ORDER BY i) AS c FROM (
                        SELECT part, CAST(m % {entries} AS BIGINT) AS entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS v
                        FROM a{r} JOIN p USING (n, part), (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2) u USING (part, entry))"""
            )
    return f"""
    WITH e AS MATERIALIZED (
      SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS n, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), p AS MATERIALIZED (
      SELECT n, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x FROM e, (SELECT unnest(range({parts})) AS part)
    ), b0 AS MATERIALIZED (SELECT part, n - 1 AS entry, x AS c FROM p WHERE n <= {entries}),
    {', '.join(steps)},
    o AS (SELECT n, string_agg(printf('%02x', CAST(m % {entries} AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY n),
    h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, i)) AS s FROM (SELECT part, entry, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM b{rounds}))
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h.s AS codebooks_sha256 FROM e JOIN o USING (n), h
    """


OP12 = _codes_sql(8, 16, 6, 4096)
