"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_MIX_ROUNDS = 40

OP2 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_WORDS} AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) || ':mix') AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
level(i, x) AS (
  SELECT 0, CAST(0 AS DOUBLE)
  UNION ALL
  SELECT i + 1, (SELECT CASE WHEN coalesce(sum(w) FILTER (3 * source_size > w * x), 0) = 0 THEN x
      ELSE CAST(sum(source_size) - coalesce(sum(3 * source_size) FILTER (3 * source_size <= w * x), 0) AS DOUBLE)
        / CAST(sum(w) FILTER (3 * source_size > w * x) AS DOUBLE) END FROM s)
  FROM level WHERE i < {_MIX_ROUNDS}),
t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), w * (SELECT max(x) FROM level)) AS target
  FROM s),
b AS (
  SELECT *, CAST(round(target) AS BIGINT) AS budget,
    CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t),
p AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, b.source_size, b.target,
  CAST(whole * p.size + greatest(0, least(p.size, budget - whole * source_size - before)) AS BIGINT) AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""

_STRIDE, _HISTORY = 2048 - 256 - 256, 256

OP3 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
n AS (
  SELECT *, row_number() OVER w AS pos, ceil(octet_length(encode(text)) / 4.0) + 3 AS tokens,
    row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, role, text) AS nth,
    5 + length(replace(replace(replace(replace(role, '\\', '\\b'), '### ', '\\h'), '</turn>', '\\e'), ':', '\\c')) + 1
      + length(replace(replace(replace(text, '\\', '\\b'), '### ', '\\h'), '</turn>', '\\e')) + 8 AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
k AS (SELECT *, floor(before / {_STRIDE}) AS win, role = 'system' AND nth = 1 AS kept FROM s),
o AS (SELECT conv_id, win, min(before) AS opening FROM k GROUP BY ALL),
f AS (SELECT *, lead(win) OVER (PARTITION BY conv_id ORDER BY win) AS following,
    lead(opening) OVER (PARTITION BY conv_id ORDER BY win) AS following_opening,
    count(*) OVER (PARTITION BY conv_id ORDER BY win DESC) - 1 AS later FROM o)
SELECT k.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars * (1 + CASE WHEN kept THEN later
    WHEN following IS NOT NULL AND following_opening - before <= {_HISTORY} THEN 1 ELSE 0 END)) AS BIGINT) AS formatted_chars
FROM k JOIN f ON k.conv_id IS NOT DISTINCT FROM f.conv_id AND k.win = f.win GROUP BY k.conv_id
"""

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, sum(len(terms)) AS n_terms FROM d WHERE len(terms) > 0),
i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark WHERE text IS NOT NULL),
q AS MATERIALIZED (SELECT DISTINCT i, item_id, unnest(terms) AS term FROM i),
p AS MATERIALIZED (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
x AS (
  SELECT q.i, q.item_id, p.r, p.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL),
o AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM x WHERE score > 0)
SELECT * FROM o WHERE rank <= 50
"""


def _op13(k: int = 8, rounds: int = 10) -> str:
    """Plain rounds: all distances, floors of means, one statement after the other."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, p) - 1 AS INTEGER) AS cluster, p AS c
  FROM v ORDER BY sha256('3:' || vec_id) NULLS LAST, p LIMIT {k})"""
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT v.vec_id, v.p, n.cluster, n.d FROM v, LATERAL (
    SELECT cluster, list_sum(list_transform(list_zip(v.p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM c{i}) n
  QUALIFY rank() OVER (PARTITION BY v.vec_id, v.p ORDER BY n.d, n.cluster) = 1)""")
        if i < rounds:
            parts.append(f"""m{i} AS MATERIALIZED (
  SELECT cluster, list(m ORDER BY place) AS c FROM (
    SELECT cluster, place, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
      SELECT cluster, place, sum(CAST(x AS HUGEINT)) AS s, count(*) AS n
      FROM (SELECT cluster, unnest(p) AS x, unnest(range(64)) AS place FROM a{i}) GROUP BY cluster, place)) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return f"""WITH {",".join(parts)}
SELECT vec_id, cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLES = {
    "op1_exact_top_k": OP1,
    "op3_format_chats": OP3,
    "op2_mix_sources": OP2,
    "op12_ranked_search": OP12,
    "op13_centroid_clustering": _op13(),
}
