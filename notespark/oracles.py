"""DuckDB SQL for the registered queries, by the same names."""

from __future__ import annotations

from .functions.text import SPACE, STOP_WORDS
from .operators.review import step_sql


def _tf(term: str) -> str:
    return f"CAST((length(lower(text)) - length(replace(lower(text), '{term}', ''))) / {len(term)} AS BIGINT)"


def _bm25(terms: list[str], every: bool, columns: str = "doc_id AS fragment_id, round(bm25, 6) AS bm25, rank", limit: int = 20, among: str = "true") -> str:
    """Scores of fragments that hold every (or any) term, ranked."""
    tfs = ", ".join(f"{_tf(t)} AS tf{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    idf = lambda i: f"CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) ELSE 1e-6 END"
    score = " + ".join(f"({idf(i)}) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(terms)))
    held = (" AND " if every else " OR ").join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""
WITH c AS (SELECT doc_id, greatest(length(text) - 2, 0) AS len, {tfs} FROM documents),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS mean, {dfs} FROM c),
b AS (SELECT doc_id, -({score}) AS bm25 FROM c, s WHERE ({held}) AND {among}),
r AS (SELECT *, row_number() OVER (ORDER BY bm25, doc_id) - 1 AS rank FROM b)
SELECT {columns} FROM r WHERE rank < {limit}"""


def _words(text: str) -> str:
    """The words that a search for a text asks for."""
    stop = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
    parts = lambda x: f"string_split_regex({x}, '[^\\p{{L}}\\p{{N}}]+')"
    held = f"list_filter({parts(f'lower({text})')}, lambda t: strlen(t) >= 3 AND t NOT IN ({stop}))"
    every = f"list_filter({parts(text)}, lambda t: t <> '')"
    return f"list_transform(list_filter(CASE WHEN len({held}) > 0 THEN {held} ELSE {every} END, lambda t: t NOT IN ('AND', 'OR', 'NOT')), lambda t: lower(t))"


def _search(asked: str, limit: int) -> str:
    """CTEs up to ``hits`` (query_id, doc_id, bm25, rank) of a table of queries (query_id, text)."""
    idf = "ln((n - df + 0.5) / (df + 0.5))"
    return f"""asked AS MATERIALIZED ({asked}),
t AS MATERIALIZED (SELECT query_id, unnest(w) AS token, unnest(range(len(w))) AS place FROM (SELECT query_id, {_words("text")} AS w FROM asked)),
low AS (SELECT doc_id, greatest(length(text) - 2, 0) AS len, lower(text) AS low FROM documents),
st AS (SELECT count(*) AS n, avg(len) AS mean FROM low),
tf AS MATERIALIZED (SELECT token, doc_id, len, CAST((length(low) - length(replace(low, token, ''))) / length(token) AS BIGINT) AS tf
  FROM (SELECT DISTINCT token FROM t WHERE length(token) >= 3) JOIN low ON contains(low, token)),
idf AS (SELECT token, CASE WHEN {idf} > 0 THEN {idf} ELSE 1e-6 END AS idf FROM (SELECT token, count(*) AS df FROM tf GROUP BY token), st),
sz AS (SELECT query_id, count(*) AS n_tokens FROM t GROUP BY query_id),
sc AS (SELECT query_id, doc_id, -list_reduce(list(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) ORDER BY place), lambda a, x: a + x) AS bm25, count(*) = any_value(n_tokens) AS every
  FROM t JOIN tf USING (token) JOIN idf USING (token) JOIN sz USING (query_id), st GROUP BY query_id, doc_id),
top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY every DESC, bm25, doc_id) <= {limit}),
hits AS (SELECT query_id, doc_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25, doc_id) - 1 AS rank
  FROM (SELECT *, max(every) OVER (PARTITION BY query_id) AS any_every FROM top) WHERE every OR NOT any_every)"""


_ASKED = f"""SELECT doc_id AS query_id, array_to_string(({_words("text")})[1:4], ' ') AS text, embedding AS vector
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE doc_id % 20 = 0"""


def _prefetched(limit: int) -> str:
    """CTEs up to ``pairs`` (query_id, doc_id, kr, vr): hits of the keyword and the vector branch."""
    return f"""{_search(_ASKED, limit)},
near AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), CAST(vector AS DOUBLE[])) DESC, vec_id) - 1 AS rank
  FROM embeddings, asked WHERE vector IS NOT NULL QUALIFY rank < {limit}),
pairs AS (SELECT coalesce(h.query_id, n.query_id) AS query_id, coalesce(h.doc_id, n.doc_id) AS doc_id, h.rank AS kr, n.rank AS vr
  FROM hits h FULL JOIN near n ON h.query_id = n.query_id AND h.doc_id = n.doc_id)"""


_TERMS = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
_TABLE = f"""WITH {_prefetched(15)},
inn AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(1.0 / (61.0 + kr), 0) + coalesce(w / (61.0 + vr), 0) DESC, doc_id) - 1 AS rank
  FROM pairs JOIN (SELECT query_id, CAST(1.5 * CASE WHEN len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) <= 3 THEN 1.5 ELSE 1 END AS DOUBLE) AS w FROM asked) USING (query_id)),
pool AS (SELECT query_id, doc_id, CAST(1.0 AS DOUBLE) / (61 + rank) AS fused FROM inn WHERE rank < 5),
boosted AS (SELECT query_id, pool.doc_id AS fragment_id, fused + least(0.05 * len(list_filter(string_split_regex(lower(asked.text), '\\s+'),
    lambda x: length(x) > 1 AND x NOT IN ({_TERMS}) AND list_contains(string_split_regex(lower(documents.text), '[^\\p{{L}}\\p{{N}}]+'), x))), 0.5) AS score
  FROM pool JOIN asked USING (query_id) JOIN documents ON documents.doc_id = pool.doc_id)
SELECT query_id, fragment_id, round(CAST(score AS DOUBLE), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fragment_id) - 1 AS rank FROM boosted"""

_FUZZY = """WITH RECURSIVE
ti AS (SELECT p_partkey AS note_id, p_name || ' / ' || upper(p_type[1]) || lower(p_type[2:]) || '-' || p_size AS title FROM part),
q AS (SELECT p_partkey AS query_id, string_split(p_name, ' ')[1][1:2] || string_split(p_name, ' ')[2][1:3] || lower(p_type[1]) AS query FROM part WHERE p_partkey % 20 = 0),
f AS (
  SELECT query, title, 0 AS i, CAST(NULL AS VARCHAR) AS was, list_transform(range(length(query)), lambda x: -1000000) AS here, list_transform(range(length(query)), lambda x: -1000000) AS gap, -1000000 AS best
  FROM (SELECT DISTINCT query FROM q), (SELECT DISTINCT title FROM ti)
  UNION ALL
  SELECT query, title, i + 1, c, new, list_transform(range(1, length(query) + 1), lambda j: greatest(here[j] - 3, gap[j] - 1, -1000000)), greatest(best, new[-1])
  FROM (SELECT *, list_transform(range(1, length(query) + 1), lambda j: CASE WHEN lower(query)[j] <> c THEN -1000000 WHEN j = 1 THEN 16 + 2 * bonus
      ELSE greatest(16 + bonus + greatest(here[j - 1] + 4, gap[j - 1]), -1000000) END) AS new
    FROM (SELECT *, lower(title)[i + 1] AS c, CASE WHEN was IS NULL THEN 8 WHEN regexp_matches(lower(title)[i + 1], '[\\p{L}\\p{N}]') AND NOT regexp_matches(was, '[\\p{L}\\p{N}]') THEN 7 ELSE 0 END AS bonus
      FROM f WHERE i < length(title)))),
s AS (SELECT query, title, best AS score FROM f WHERE i = length(title) AND best > -500000),
r AS (SELECT query_id, note_id, title, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, note_id) - 1 AS rank FROM q JOIN s USING (query) JOIN ti USING (title))
SELECT * FROM r WHERE rank < 5"""

_SNIPPETS = """WITH d AS (SELECT doc_id, text, string_split_regex(lower(text), 'heat|thing') AS gaps, regexp_extract_all(lower(text), 'heat|thing') AS words
  FROM documents WHERE lower(text) LIKE '%heat%' OR lower(text) LIKE '%thing%'),
m AS (SELECT doc_id, n, word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS e
  FROM (SELECT doc_id, unnest(gaps[:len(words)]) AS gap, unnest(words) AS word, unnest(range(len(words))) AS n FROM d)),
w AS (SELECT a.doc_id, a.n, a.e, min(b.e - length(b.word)) AS b, 1000 * count(DISTINCT b.word) + count(*) AS score
  FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.n <= a.n AND b.e - length(b.word) + 34 >= a.e GROUP BY a.doc_id, a.n, a.e),
p AS (SELECT doc_id, b, e FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n) = 1),
c AS (SELECT doc_id, text, greatest(least(b - CAST(floor((34 - (e - b)) / 2.0) AS INTEGER), length(text) - 34), 0) AS b FROM p JOIN d USING (doc_id))
SELECT doc_id AS fragment_id, CASE WHEN b > 0 THEN '…' ELSE '' END || regexp_replace(substr(text, b + 1, 34), '(heat|thing)', '<b>\\1</b>', 'gi') || CASE WHEN b + 34 < length(text) THEN '…' ELSE '' END AS snippet FROM c"""

#: The documents after the change of ``kw_posting_after_change``.
_CHANGED = """(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' heat' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0
  UNION ALL SELECT doc_id + 10000000, text FROM documents WHERE doc_id % 11 = 0)"""

_Q64 = "[" + ", ".join("1.0" if i % 2 else "-0.5" for i in range(64)) + "]::DOUBLE[]"
_ONES = "[" + ", ".join(["1.0"] * 64) + "]::DOUBLE[]"
_V = "CAST(embedding AS DOUBLE[])"

_TWO = """
WITH e AS (SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS a, round(CAST(embedding[2] AS DOUBLE), 6) AS b FROM embeddings),
x AS (SELECT vec_id, row_number() OVER (ORDER BY a DESC, vec_id) - 1 AS rank FROM e),
y AS (SELECT vec_id, row_number() OVER (ORDER BY b DESC, vec_id) - 1 AS rank FROM e),
u AS (SELECT vec_id, rank, 0 AS list FROM x WHERE rank < 50 UNION ALL SELECT vec_id, rank, 1 FROM y WHERE rank < 50)"""

_SCORED = "SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6) AS score FROM embeddings"

_GRID = """
WITH q AS (SELECT vec_id AS query, CAST(label AS VARCHAR) AS expected, embedding AS qv, CASE WHEN vec_id % 40 = 0 THEN 1.0 ELSE 0.9 END AS relevance FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT query, expected, vec_id AS doc, CAST(label AS VARCHAR) AS title,
    list_dot_product(CAST(embedding[1:32] AS DOUBLE[]), CAST(qv[1:32] AS DOUBLE[])) AS a,
    list_dot_product(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])) AS b
  FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY a DESC, doc) - 1 AS kr, row_number() OVER (PARTITION BY query ORDER BY b DESC, doc) - 1 AS vr FROM p),
h AS (SELECT query, expected, doc, title, CASE WHEN kr < 50 THEN kr END AS kr, CASE WHEN vr < 50 THEN vr END AS vr FROM r WHERE kr < 50 OR vr < 50),
"""

_POINTS = """
g AS (SELECT * FROM (SELECT unnest([0.0, 0.2, 0.5, 0.8, 1.0, 1.2, 1.5, 1.8, 2.0, 2.5, 3.0]::DOUBLE[]) AS w), (SELECT unnest([10.0, 20.0, 40.0, 60.0, 80.0, 100.0]::DOUBLE[]) AS k),
  (SELECT unnest([0.0, 0.01, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3]::DOUBLE[]) AS tb)),
e AS (SELECT w, k, tb, query, expected, doc, title, CAST(coalesce(1.0 / (k + kr + 1), 0) + coalesce(w / (k + vr + 1), 0) AS DOUBLE) AS fused FROM h, g),
f AS (SELECT *, fused + least((doc % 3) * tb, CAST(0.5 AS DOUBLE)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY w, k, tb, query ORDER BY fused DESC, doc) AS place FROM e) WHERE place <= 50),
o AS (SELECT *, row_number() OVER (PARTITION BY w, k, tb, query ORDER BY score DESC, doc) - 1 AS rank FROM f),
b AS (SELECT w, k, tb, query, min(rank) AS rank, min_by(score, rank) AS score FROM o WHERE lower(title) = lower(expected) GROUP BY ALL),
s AS (SELECT w, k, tb, sum(relevance / (rank + 1)) AS gain FROM b JOIN q USING (query) GROUP BY ALL),
m AS (SELECT g.w, g.k, g.tb, round(CAST(coalesce(gain, 0) / (SELECT count(*) FROM q) AS DOUBLE), 6) AS mrr FROM g LEFT JOIN s ON g.w = s.w AND g.k = s.k AND g.tb = s.tb)"""

_MARKED = "(SELECT doc_id, concat('## ', replace(text, ' ', '  '), chr(10), chr(10), '- **bold** [label](http://x) and [[note|alias]]', chr(10), '3. item `code`') AS text FROM documents)"
_LABELS = [(r"\[\[[^\]|]+\|([^\]]+)\]\]", r"\1"), (r"\[\[([^\]|]+)\]\]", r"\1"), (r"\[([^\]]+)\]\([^\)]+\)", r"\1")]
_LISTS = [(r"(?m)^\s*[-+*]\s+", "")]
_NUMBERS = [(r"(?m)^\s*\d+\.\s+", "")]
_HEADINGS = [(r"(?m)^#{1,6}\s+", "")]
_BLANKS = [(r"\n\s*\n", "\n")]
_RULES = [(r"(?m)^(?:\*{3,}|-{3,}|_{3,})\s*$", "")]
_EMPHASIS = [(f"{m}(.+?){m}", r"\1") for m in (r"\*\*", "__", "~~", "==", "`")]
_EMPHASIS += [(rf"(^|\s){m}({other}+){m}(\s|$)", r"\1\2\3") for m, other in (("_", "[^_]"), (r"\*", "[^*]"))]
_LATEX = [(r"(?s)\$\$.*?\$\$", ""), (r"\$[^$\n]+\$", "")]


def _replaced(steps: list[tuple[str, str]], text: str = "text") -> str:
    for pattern, new in steps:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


_CLEANED = "trim(lower(" + _replaced(_RULES + _NUMBERS + _LISTS + _LABELS + _EMPHASIS + _HEADINGS + _BLANKS) + "), ' ' || chr(9) || chr(10) || chr(13))"


def _hashed(expression: str, table: str = _MARKED) -> str:
    return f"SELECT doc_id, sha256({expression}) AS h FROM {table}"


_APART = "trim(regexp_replace({0}, '" + SPACE.replace("{", "{{").replace("}", "}}") + "+', ' ', 'g'))"
_TOKENS = f"CAST(ceil(greatest(CASE WHEN {_APART} = '' THEN 0 ELSE len(string_split({_APART}, ' ')) END * 1.5, length({{0}}) / 3.0)) AS BIGINT)"
_LINE = "(SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"


def _packed(size: str, keep: str, budget: int, columns: str) -> str:
    return f"""
WITH RECURSIVE l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, CAST({size} AS BIGINT) AS size FROM {_LINE} WHERE {keep}),
f AS (SELECT doc_id, n, line, size, CAST(0 AS BIGINT) AS fragment, size AS total FROM l WHERE n = 1
  UNION ALL SELECT l.doc_id, l.n, l.line, l.size, f.fragment + CASE WHEN f.total > 0 AND f.total + l.size > {budget} THEN 1 ELSE 0 END,
    CASE WHEN f.total > 0 AND f.total + l.size > {budget} THEN l.size ELSE f.total + l.size END
  FROM f JOIN l ON l.doc_id = f.doc_id AND l.n = f.n + 1)
SELECT doc_id, fragment, count(*) AS n_pieces, CAST(sum(size) AS BIGINT) AS size{columns} FROM f GROUP BY doc_id, fragment"""


_LINES = f"(SELECT doc_id AS note_id, pos AS order_index, sha256(line) AS hash FROM {_LINE})"

_NOTES = """(SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'pending' WHEN doc_id % 9 = 0 THEN 'failed' ELSE 'indexed' END AS st,
  CASE quality WHEN 1 THEN 'm1' WHEN 0 THEN 'm0' END AS model, CASE WHEN doc_id % 2 = 0 THEN '1' END AS ver,
  CASE doc_id % 3 WHEN 0 THEN 1024 WHEN 1 THEN 64 END AS dim, CASE WHEN doc_id % 10 = 0 THEN 'deleted' ELSE 'active' END AS life
  FROM documents LEFT JOIN labels USING (doc_id))"""

_TREE = """
nodes AS (SELECT r_regionkey + 1000000000 AS id, NULL AS parent_id, r_name AS name FROM region
  UNION ALL SELECT n_nationkey + 2000000000, n_regionkey + 1000000000, n_name FROM nation
  UNION ALL SELECT c_custkey, c_nationkey + 2000000000, c_name FROM customer),
t AS (SELECT CAST(id AS BIGINT) AS id, name AS path, CAST(0 AS BIGINT) AS depth, [CAST(id AS BIGINT)] AS anc FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.id, t.path || '/' || n.name, t.depth + 1, list_append(t.anc, CAST(n.id AS BIGINT)) FROM nodes n JOIN t ON n.parent_id = t.id),
closed AS (SELECT a AS ancestor_id, id AS descendant_id, depth - (list_position(anc, a) - 1) AS depth FROM (SELECT id, depth, anc, unnest(anc) AS a FROM t))"""

_NOW = 820454400
_DUE = f"""
cards AS (SELECT o_orderkey AS card_id, o_custkey AS note_id, CASE WHEN o_orderstatus = 'F' THEN 'suspended' ELSE 'active' END AS status FROM orders),
sched AS (SELECT 'card' AS tt, o_orderkey AS tid, CASE WHEN o_orderkey % 5 > 0 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS nr, CASE WHEN o_orderkey % 5 > 0 THEN 'review' ELSE 'new' END AS state FROM orders
  UNION ALL SELECT 'note', o_custkey, CAST(epoch(o_orderdate) AS BIGINT), NULL FROM orders WHERE o_orderkey % 11 = 0)"""

_TAGS = """
s AS (SELECT DISTINCT lower(trim(concat_ws('/', replace(p_type, ' ', '/'), p_brand))) AS full_path FROM part),
k AS (SELECT string_split(full_path, '/') AS parts, unnest(range(1, len(string_split(full_path, '/')) + 1)) AS n FROM s),
tags AS (SELECT DISTINCT array_to_string(parts[1:n], '/') AS path, n - 1 AS depth, parts[n] AS name FROM k),
pairs AS (SELECT DISTINCT array_to_string(parts[1:m], '/') AS ancestor_id, array_to_string(parts[1:n], '/') AS descendant_id, n - m AS depth
  FROM (SELECT parts, n, unnest(range(1, n + 1)) AS m FROM k))"""

_S, _D = step_sql("f.s", "f.d", "greatest(floor((r.done - f.done) / 86400.0), 0)", "r.rating")
_S0, _D0 = step_sql("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", "0", "rating")

_HYBRID = f"""
WITH kw AS ({_bm25(["heat", "thing"], True, "doc_id, rank", 30)}),
ve AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY list_dot_product({_V}, {_Q64}) DESC, vec_id) - 1 AS rank FROM embeddings),
u AS (SELECT doc_id, 1.0 / (61.0 + rank) AS s FROM kw UNION ALL SELECT doc_id, 2.25 / (61.0 + rank) FROM ve WHERE rank < 30),
i AS (SELECT doc_id, row_number() OVER (ORDER BY sum(s) DESC, doc_id) - 1 AS rank FROM u GROUP BY doc_id),
o AS (SELECT doc_id, CAST(1.0 AS DOUBLE) / (61 + rank) AS s FROM i WHERE rank < 10),
b AS (SELECT doc_id AS fragment_id, s + least(0.05 * len(list_filter(['heat', 'thing'], lambda t: list_contains(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), t))), 0.5) AS score
  FROM o JOIN documents USING (doc_id))
SELECT fragment_id, round(CAST(score AS DOUBLE), 6) AS score, row_number() OVER (ORDER BY score DESC, fragment_id) - 1 AS rank FROM b"""

_FOLD = f"""WITH RECURSIVE r AS (SELECT user_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS done, CASE WHEN event_id % 7 = 0 THEN 1 ELSE event_id % 3 + 2 END AS rating, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
      f AS (SELECT id, n, done, CAST({_S0} AS DOUBLE) AS s, CAST({_D0} AS DOUBLE) AS d, CAST(1 AS BIGINT) AS reps, CAST(CASE WHEN rating = 1 THEN 1 ELSE 0 END AS BIGINT) AS lapses FROM r WHERE n = 1
        UNION ALL SELECT r.id, r.n, r.done, CAST({_S} AS DOUBLE), CAST({_D} AS DOUBLE), f.reps + 1, f.lapses + CASE WHEN r.rating = 1 THEN 1 ELSE 0 END FROM f JOIN r ON r.id = f.id AND r.n = f.n + 1)
      SELECT id AS schedule_id, round(arg_max(s, n), 4) AS stability, round(arg_max(d, n), 4) AS difficulty, max(reps) AS reps, max(lapses) AS lapses, CASE WHEN max(n) = 1 THEN 'learning' ELSE 'review' END AS state, arg_max(done, n) AS last_reviewed FROM f GROUP BY id"""

#: The fragment table of the store's queries, and numbered tags.
_STORE = f"f AS (SELECT doc_id * 100000 + pos AS fragment_id, doc_id AS note_id, pos AS order_index, sha256(line) AS h FROM {_LINE} WHERE doc_id % 5 <> 0)"
_IDS = "ids AS (SELECT row_number() OVER (ORDER BY depth, path) AS tag_id, path, depth, name FROM tags)"

_MARK = "(chr(10) || chr(10) || '<!-- imported from draft #7 on 2024-01-01T00:00:00+00:00 -->' || chr(10))"

_LIVED = "lived AS (SELECT id, CAST(nodes.parent_id AS BIGINT) AS parent_id, nodes.name, path, CASE WHEN id % 13 = 0 THEN 'deleted' WHEN id % 17 = 0 THEN 'draft' ELSE 'active' END AS lifecycle FROM t JOIN nodes USING (id))"

ORACLES = {
    "hybrid_search": _HYBRID,
    "kw_bm25_single": _bm25(["heat"], True),
    "kw_bm25_and": _bm25(["heat", "thing"], True),
    "kw_bm25_or_fallback": _bm25(["zzqx", "thing"], False),
    "kw_posting_search": _bm25(["heat", "thing"], True),
    "kw_posting_after_change": _bm25(["heat", "thing"], True).replace("FROM documents", f"FROM {_CHANGED}"),
    "kw_posting_batch": f"""WITH {_search("SELECT item_id AS query_id, text FROM benchmark", 10)}
SELECT query_id, doc_id AS fragment_id, round(bm25, 6) AS bm25, rank FROM hits""",
    "hybrid_search_table": _TABLE,
    "prefetched_hits": f"WITH {_prefetched(20)} SELECT query_id, doc_id AS fragment_id, kr AS keyword_rank, vr AS vector_rank FROM pairs",
    "calibration_of_hits": f"""WITH {_prefetched(20)},
q AS (SELECT doc_id AS query, lang || '/' || source AS expected, 1.0 AS relevance FROM documents WHERE doc_id % 20 = 0),
h AS (SELECT query, expected, pairs.doc_id AS doc, lang || '/' || source AS title, kr, vr FROM pairs JOIN q ON query = query_id JOIN documents ON documents.doc_id = pairs.doc_id),
{_POINTS} SELECT * FROM m""",
    "fuzzy_titles": _FUZZY,
    "kw_snippets": _SNIPPETS,
    "kw_match_counts": "SELECT t AS token, count(*) FILTER (contains(lower(text), t)) AS n FROM documents, (SELECT unnest(['the', 'license', 'tion']) AS t) GROUP BY t",
    "vec_topk_dot": f"SELECT vec_id, round(s, 6) AS similarity, row_number() OVER (ORDER BY s DESC, vec_id) - 1 AS rank FROM (SELECT vec_id, list_dot_product({_V}, {_Q64}) AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 10)",
    "vec_topk_batch": f"""SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) - 1 AS rank
      FROM (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank < 5""",
    "vec_cosine_pairs": "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "l2_norms": f"SELECT vec_id, round(2 * sqrt(list_dot_product({_V}, {_V})), 6) AS length, round(CAST(1 AS DOUBLE), 6) AS unit_length FROM embeddings",
    "vec_dim_guard": "SELECT count(*) AS n FROM embeddings WHERE vec_id % 3 <> 0",
    "semantic_merge_groups": f"""SELECT label, vec_id, CAST(sum(CASE WHEN s >= 0.1 THEN 0 ELSE 1 END) OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS "group"
      FROM (SELECT label, vec_id, list_dot_product({_V}, lag({_V}) OVER (PARTITION BY label ORDER BY vec_id)) AS s FROM embeddings)""",
    "best_per_group_top3": f"SELECT label, round(max(s), 6) AS similarity FROM (SELECT vec_id, label, list_dot_product({_V}, {_ONES}) AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 50) GROUP BY label ORDER BY max(s) DESC, label LIMIT 3",
    "rrf_two_lists": _TWO + " SELECT vec_id, round(sum(CASE list WHEN 0 THEN 1.0 ELSE 1.5 END / (60.0 + rank + 1)), 6) AS score, min(rank) FILTER (list = 0) AS first_rank, min(rank) FILTER (list = 1) AS second_rank FROM u GROUP BY vec_id ORDER BY sum(CASE list WHEN 0 THEN 1.0 ELSE 1.5 END / (60.0 + rank + 1)) DESC, vec_id LIMIT 20",
    "rrf_weighted_k": _TWO + " SELECT vec_id, round(sum(CASE list WHEN 0 THEN 0.7 ELSE 0.2 END / (10.0 + rank + 1)), 6) AS score FROM u GROUP BY vec_id",
    "term_boost": r"SELECT doc_id AS fragment_id, round(CAST(least(0.05 * len(list_filter(['the', 'heat', 'the', 'of', 'zzqx'], lambda t: list_contains(w, t))), 0.5) AS DOUBLE), 6) AS boost FROM (SELECT doc_id, string_split_regex(lower(text), '[^\p{L}\p{N}]+') AS w FROM documents)",
    "ratio_cutoff": f"SELECT vec_id, label, score FROM (SELECT *, max(score) OVER (PARTITION BY label) AS m FROM ({_SCORED})) WHERE score >= m * 0.5",
    "min_score_filter": f"SELECT * FROM ({_SCORED}) WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 15",
    "scoring_rerank": f"SELECT vec_id, label, round(CASE WHEN vec_id % 4 = 0 THEN (vec_id % 11) / 10.0 ELSE score END, 6) AS score FROM ({_SCORED})",
    "listwise_rerank": f"""WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS rank FROM ({_SCORED})), t AS (SELECT *, CASE WHEN rank % 3 = 1 THEN 100 - rank END AS place FROM r WHERE rank < 25)
      SELECT vec_id, rank, round(1 - CAST(row_number() OVER (ORDER BY place NULLS LAST, rank) - 1 AS DOUBLE) / 25, 6) AS score FROM t""",
    "mrr_eval": _GRID + _POINTS + " SELECT * FROM m",
    "grid_search_best": _GRID + _POINTS + " SELECT * FROM m ORDER BY mrr DESC, w, k, tb LIMIT 1",
    "min_score_calibrated": _GRID + _POINTS + " SELECT round(CASE WHEN min(score) IS NULL THEN 0.005 ELSE greatest(least(min(score) * 0.9, 0.05), 0.001) END, 6) AS min_score FROM b WHERE w = 1.5 AND k = 60 AND tb = 0.05 AND rank <= 5",
    "token_counts": f"SELECT doc_id, {_TOKENS.format('text')} AS n FROM documents",
    "clean_markdown": _hashed(_CLEANED),
    "collapse_blank_lines": _hashed(_replaced(_BLANKS)),
    "strip_links": _hashed(_replaced(_LABELS)),
    "list_markers": _hashed(_replaced(_LISTS + _NUMBERS)),
    "heading_markers": _hashed(_replaced(_HEADINGS)),
    "latex_strip": _hashed(_replaced(_LATEX), "documents"),
    "fragment_lines": f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, sha256(line) AS h FROM {_LINE}",
    "pack_char_budget": _packed("octet_length(encode(line))", "line <> ''", 800, ", sha256(string_agg(line, chr(10) || chr(10) ORDER BY n)) AS h"),
    "pack_token_budget": _packed(_TOKENS.format("line"), "trim(line) <> ''", 256, ""),
    "dedup_fragments": f"SELECT note_id, CAST(order_index AS INTEGER) AS order_index, hash FROM (SELECT *, row_number() OVER (PARTITION BY note_id, hash ORDER BY order_index) AS n FROM {_LINES}) WHERE n = 1",
    "content_hash_dups": "SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "incremental_diff": f"""WITH o AS (SELECT * FROM {_LINES} WHERE note_id % 5 <> 0), n AS (SELECT note_id, order_index, CASE WHEN order_index % 5 = 2 THEN sha256(hash) ELSE hash END AS hash FROM {_LINES} WHERE note_id % 7 <> 0 AND order_index % 11 <> 10
        UNION ALL SELECT note_id, order_index + 1000000, hash FROM {_LINES} WHERE note_id % 7 <> 0 AND order_index % 13 = 0)
      SELECT note_id, CASE WHEN o.hash IS NULL THEN 'insert' WHEN n.hash IS NULL THEN 'delete' WHEN o.hash = n.hash THEN 'same' ELSE 'update' END AS change, count(*) AS n FROM o FULL JOIN n USING (note_id, order_index) GROUP BY ALL""",
    "needs_indexing": f"SELECT doc_id, life <> 'deleted' AND (st IN ('failed', 'pending') OR model IS DISTINCT FROM 'm1' OR ver IS DISTINCT FROM '1') AS needs FROM {_NOTES}",
    "drift_stale": f"SELECT doc_id FROM {_NOTES} WHERE st = 'indexed' AND NOT (model IS NOT DISTINCT FROM 'm1' AND dim IS NOT DISTINCT FROM 1024)",
    "cache_hit_miss": "SELECT sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) AS hit, count(*) AS n FROM documents GROUP BY 1",
    "cache_ttl": "SELECT count(*) AS n FROM events WHERE event_type = 'click' AND floor(epoch(ts)) >= 1707600000 - 2592000",
    "lang_mode": "SELECT lang, count(*) AS n FROM documents WHERE octet_length(encode(text)) >= 10 GROUP BY lang ORDER BY n DESC, lang LIMIT 1",
    "note_tree_paths": f"WITH RECURSIVE {_TREE} SELECT id, path, depth FROM t",
    "descendant_pairs": f"WITH RECURSIVE {_TREE} SELECT * FROM closed",
    "hierarchical_due_counts": f"""WITH RECURSIVE {_TREE}, {_DUE},
      own AS (SELECT tid AS id, count(*) AS due FROM sched WHERE tt = 'note' AND nr <= {_NOW} GROUP BY tid UNION ALL SELECT note_id, count(*) FROM sched JOIN cards ON tid = card_id WHERE tt = 'card' AND nr <= {_NOW} AND status <> 'suspended' GROUP BY note_id)
      SELECT ancestor_id AS id, CAST(coalesce(sum(due), 0) AS BIGINT) AS due FROM closed LEFT JOIN own ON descendant_id = own.id GROUP BY ancestor_id""",
    "visible_due_counts": f"""WITH RECURSIVE {_TREE}, {_DUE}, {_LIVED},
      tree AS (SELECT id AS parent, id AS descendant FROM lived WHERE lifecycle <> 'deleted'
        UNION ALL SELECT tree.parent, lived.id FROM tree JOIN lived ON lived.parent_id = tree.descendant WHERE lived.lifecycle <> 'deleted'),
      own AS (SELECT tid AS id, count(*) AS due FROM sched WHERE tt = 'note' AND nr <= {_NOW} GROUP BY tid UNION ALL SELECT note_id, count(*) FROM sched JOIN cards ON tid = card_id WHERE tt = 'card' AND nr <= {_NOW} AND status <> 'suspended' GROUP BY note_id)
      SELECT parent AS id, CAST(coalesce(sum(due), 0) AS BIGINT) AS due FROM tree LEFT JOIN own ON descendant = own.id GROUP BY parent""",
    "active_repeat_tree": f"""WITH RECURSIVE {_TREE}, {_DUE}, {_LIVED},
      tree AS (SELECT id, name, parent_id, path, CAST(0 AS BIGINT) AS depth FROM lived WHERE parent_id IS NULL AND lifecycle = 'active'
        UNION ALL SELECT l.id, l.name, l.parent_id, l.path, tree.depth + 1 FROM tree JOIN lived l ON l.parent_id = tree.id WHERE l.lifecycle = 'active'),
      own AS (SELECT note_id AS id, count(*) FILTER (nr <= {_NOW}) AS due, count(*) FILTER (state = 'new') AS new, count(*) AS total FROM cards LEFT JOIN (SELECT * FROM sched WHERE tt = 'card') ON tid = card_id WHERE status <> 'suspended' GROUP BY note_id),
      sub AS (SELECT tree.id, CAST(coalesce(sum(due), 0) AS BIGINT) AS subtree_due, CAST(coalesce(sum(total), 0) AS BIGINT) AS subtree_total
        FROM tree LEFT JOIN (SELECT path AS p, due, total FROM own JOIN lived USING (id)) ON p = path OR starts_with(p, path || '/') GROUP BY tree.id)
      SELECT tree.id, name, CAST(parent_id AS BIGINT) AS parent_id, path, depth, coalesce(due, 0) AS own_due, coalesce(new, 0) AS own_new, coalesce(total, 0) AS own_total, subtree_due, subtree_total
      FROM tree LEFT JOIN own USING (id) JOIN sub USING (id)""",
    "reschedule": f"""WITH {_DUE},
      held AS (SELECT tid * 2 AS schedule_id, tt, tid, nr, state FROM sched WHERE tt = 'card'),
      asked AS (SELECT tt, tid, CAST(tid % 30 AS DOUBLE) AS days FROM sched WHERE tt = 'card' AND tid % 4 = 0),
      top AS (SELECT max(schedule_id) AS m FROM held)
      SELECT schedule_id, tt AS target_type, tid AS target_id, CASE WHEN days IS NOT NULL THEN {_NOW} + CAST(days * 86400 AS BIGINT) ELSE nr END AS next_review, state FROM held LEFT JOIN asked USING (tt, tid)
      UNION ALL SELECT m + row_number() OVER (ORDER BY s_suppkey), 'note', s_suppkey + 100000000, {_NOW} + 43200, 'new' FROM supplier, top""",
    "merge_ends": """WITH RECURSIVE e AS (
        SELECT a.c_custkey AS c, b.c_custkey AS p FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 50 = 7 THEN c_custkey + 1 WHEN c_custkey % 77 = 0 THEN -5 ELSE c_custkey - 1 END AS into_ FROM customer) a
        LEFT JOIN customer b ON b.c_custkey = into_),
      w AS (SELECT c, p AS at_, 1 AS n FROM e WHERE p IS NOT NULL UNION ALL SELECT w.c, e.p, n + 1 FROM w JOIN e ON e.c = w.at_ WHERE e.p IS NOT NULL AND n < 60)
      SELECT c AS chunk_index, max(CASE WHEN at_ IN (SELECT c FROM e WHERE p IS NULL) THEN at_ END) AS "end" FROM w GROUP BY c""",
    "repeat_mode_tree": f"""WITH RECURSIVE {_TREE}, {_DUE},
      own AS (SELECT note_id AS id, count(*) FILTER (nr <= {_NOW}) AS due, count(*) FILTER (state = 'new') AS new, count(*) AS total FROM cards LEFT JOIN (SELECT * FROM sched WHERE tt = 'card') ON tid = card_id WHERE status <> 'suspended' GROUP BY note_id),
      sub AS (SELECT ancestor_id AS id, CAST(coalesce(sum(due), 0) AS BIGINT) AS subtree_due, CAST(coalesce(sum(total), 0) AS BIGINT) AS subtree_total FROM closed LEFT JOIN own ON descendant_id = own.id GROUP BY 1)
      SELECT t.id, nodes.name AS title, CAST(nodes.parent_id AS BIGINT) AS parent_id, path, depth, coalesce(due, 0) AS own_due, coalesce(new, 0) AS own_new, coalesce(total, 0) AS own_total, subtree_due, subtree_total FROM t JOIN nodes USING (id) LEFT JOIN own USING (id) JOIN sub USING (id)""",
    "due_queue": f"WITH {_DUE} SELECT tid AS schedule_id, nr AS next_review FROM sched WHERE tt = 'card' AND nr <= {_NOW} ORDER BY nr, tid LIMIT 25",
    "due_count": f"WITH {_DUE} SELECT count(*) AS n FROM sched WHERE nr <= {_NOW}",
    "tag_closure_build": f"WITH {_TAGS} SELECT * FROM pairs",
    "tag_autocomplete": f"""WITH {_TAGS}, u AS (SELECT lower(concat_ws('/', replace(p_type, ' ', '/'), p_brand)) AS tag_id, count(*) AS uses FROM part GROUP BY 1)
      SELECT path AS tag_id, depth, coalesce(uses, 0) AS uses FROM tags LEFT JOIN u ON path = u.tag_id WHERE starts_with(path, 'brand#1') OR starts_with(name, 'brand#1') ORDER BY uses DESC, depth, path LIMIT 10""",
    "tag_subtree_notes": f"WITH {_TAGS} SELECT DISTINCT p_partkey AS note_id FROM part JOIN pairs ON lower(concat_ws('/', replace(p_type, ' ', '/'), p_brand)) = descendant_id WHERE ancestor_id = 'standard'",
    "tag_inherit_anti": "SELECT p_brand AS tag_id, count(*) AS n FROM (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS f, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey WHERE f % 3 <> 0 OR f IS NULL GROUP BY 1",
    "tag_move_closure": """WITH RECURSIVE n AS (SELECT r_regionkey + 1000000000 AS id, CASE WHEN r_regionkey = 1 THEN 2000000000 END AS parent FROM region UNION ALL SELECT n_nationkey + 2000000000, n_regionkey + 1000000000 FROM nation
        UNION ALL SELECT c_custkey, c_nationkey + 2000000000 FROM customer),
      c AS (SELECT CAST(id AS BIGINT) AS ancestor_id, CAST(id AS BIGINT) AS descendant_id, CAST(0 AS BIGINT) AS depth FROM n UNION ALL SELECT c.ancestor_id, n.id, c.depth + 1 FROM c JOIN n ON n.parent = c.descendant_id) SELECT * FROM c""",
    "hashtag_extract": r"SELECT doc_id, array_to_string(regexp_extract_all('#a/' || lang || ' #x-y_1, # no #' || source, '#([a-zA-Z0-9_\-/]+)', 1), '|') AS tags FROM documents",
    "json_payload": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "review_state_fold": _FOLD,
    "plan_append_concat": f"SELECT c_custkey AS note_id, sha256(CASE WHEN c_custkey % 5 > 0 THEN c_name || {_MARK} ELSE '' END || string_agg(o_orderpriority, {_MARK} ORDER BY o_orderkey, o_orderpriority)) AS h FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name",
    "heuristic_parent": r"""WITH c AS (SELECT p_partkey % 200 AS draft_id, p_partkey AS chunk_index, concat_ws(' ', p_type, CASE WHEN p_partkey % 3 > 0 THEN p_brand END) AS title FROM part),
      w AS (SELECT *, string_split_regex(lower(title), '\s+') AS w FROM c)
      SELECT a.draft_id, a.chunk_index, min(b.chunk_index) AS parent_index FROM w a LEFT JOIN w b ON a.draft_id = b.draft_id AND octet_length(encode(a.title)) > octet_length(encode(b.title))
        AND (list_has_all(a.w, b.w) OR len(list_filter(b.w, lambda x: octet_length(encode(x)) >= 4 AND len(list_filter(a.w, lambda y: starts_with(y, x) OR starts_with(x, y))) > 0)) > 0) GROUP BY ALL""",
    "plan_create_child_levels": "SELECT p_partkey AS chunk_index, CASE WHEN p_partkey % 10 >= 7 THEN 0 ELSE p_partkey % 10 END AS level FROM part",
    "streaming_reviews": _FOLD,
    "streaming_index_applied": f"""WITH s AS (
      SELECT doc_id AS note_id, 0 AS order_index, text AS body FROM documents WHERE (doc_id % 3 = 0 OR doc_id % 5 <> 0) AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''
      UNION ALL SELECT doc_id, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN 1 ELSE 0 END, '## More' || chr(10) || 'heat' FROM documents WHERE doc_id % 3 = 0)
      SELECT note_id, CAST(order_index AS BIGINT) AS order_index, sha256({_CLEANED.replace("text", "body")}) AS hash FROM s""",
    "streaming_cache_expiry": """WITH RECURSIVE r AS (
        SELECT user_id, due, row_number() OVER (PARTITION BY user_id ORDER BY due) AS n
        FROM (SELECT user_id, 1704067200 + (CAST(floor(epoch(ts)) AS BIGINT) - 1704067200) * 60 AS due FROM events)),
      f AS (SELECT user_id, n, due AS made, CAST(0 AS BIGINT) AS hits, CAST(1 AS BIGINT) AS misses FROM r WHERE n = 1
        UNION ALL SELECT r.user_id, r.n, CASE WHEN r.due < f.made + 2592000 THEN f.made ELSE r.due END,
          f.hits + CASE WHEN r.due < f.made + 2592000 THEN 1 ELSE 0 END, f.misses + CASE WHEN r.due < f.made + 2592000 THEN 0 ELSE 1 END
        FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
      SELECT user_id, arg_max(hits, n) AS hits, arg_max(misses, n) AS misses, arg_max(made, n) AS made,
        arg_max(made, n) + 2592000 > (SELECT max(due) - 3600 FROM r) AS held FROM f GROUP BY user_id""",
    "active_search": " UNION ALL ".join(f"SELECT * FROM ({_bm25(t, e, f'{n} AS query, doc_id AS fragment_id, round(bm25, 6) AS bm25, rank', 20, 'doc_id % 10 <> 0')})" for n, (t, e) in enumerate(((["heat"], True), (["heat", "thing"], True), (["zzqx", "thing"], False)))),
    "index_apply": f"""WITH {_STORE},
      n AS (SELECT doc_id AS note_id, pos AS order_index, sha256(CASE WHEN pos % 5 = 2 THEN 'edited ' || line ELSE line END) AS h FROM {_LINE} WHERE doc_id % 7 <> 0 AND doc_id % 3 <> 0 AND pos % 11 <> 10),
      x AS (SELECT f.fragment_id, coalesce(f.note_id, n.note_id) AS note_id, coalesce(f.order_index, n.order_index) AS order_index, f.h AS old, n.h AS new FROM (SELECT * FROM f WHERE note_id % 3 <> 0) f FULL JOIN n ON f.note_id = n.note_id AND f.order_index = n.order_index)
      SELECT fragment_id, note_id, order_index, h AS clean_text_hash, fragment_id % 2 = 0 AS has_vector FROM f WHERE note_id % 3 = 0
      UNION ALL SELECT fragment_id, note_id, order_index, new, fragment_id % 2 = 0 AND old = new FROM x WHERE new IS NOT NULL AND old IS NOT NULL
      UNION ALL SELECT (SELECT max(fragment_id) FROM f) + row_number() OVER (ORDER BY note_id, order_index), note_id, order_index, new, false FROM x WHERE old IS NULL""",
    "drift_apply": f"""WITH {_STORE} SELECT d.doc_id AS note_id, CASE WHEN d.doc_id % 9 <> 0 AND d.doc_id % 3 = 0 THEN 'pending' WHEN d.doc_id % 9 = 0 THEN 'indexing' ELSE 'indexed' END AS indexing_status,
      CASE WHEN d.doc_id % 9 <> 0 AND d.doc_id % 3 = 0 THEN NULL ELSE CAST(0 AS BIGINT) END AS indexed_at,
      (SELECT count(*) FROM f WHERE f.note_id = d.doc_id AND fragment_id % 2 = 0 AND NOT (d.doc_id % 9 <> 0 AND d.doc_id % 3 = 0)) AS n_vectors FROM documents d""",
    "crash_recovery": f"""WITH {_STORE} SELECT d.doc_id AS note_id, CASE WHEN d.doc_id % 9 = 0 THEN 'failed' ELSE 'indexed' END AS indexing_status, CASE WHEN d.doc_id % 9 = 0 THEN 'Interrupted indexing' END AS indexing_error,
      (SELECT count(*) FROM f WHERE f.note_id = d.doc_id AND d.doc_id % 9 <> 0) AS n FROM documents d""",
    "fetch_joined": f"WITH {_STORE} SELECT fragment_id, 'n' || note_id AS note_title, order_index, fragment_id % 2 = 0 AS has_vector FROM f WHERE note_id % 10 <> 0 ORDER BY note_id, order_index LIMIT 200 OFFSET 40",
    "content_update": """SELECT doc_id AS note_id, sha256(CASE WHEN doc_id % 12 = 0 THEN text || chr(10) || chr(10) || 'more' ELSE text END) AS content_hash,
      CASE WHEN doc_id % 12 = 0 THEN 'stale' WHEN doc_id % 9 = 0 THEN 'indexing' ELSE 'indexed' END AS indexing_status, CAST(CASE WHEN doc_id % 12 = 0 THEN 9 ELSE 0 END AS BIGINT) AS updated_at,
      CASE WHEN doc_id % 12 = 0 THEN row_number() OVER (PARTITION BY doc_id % 12 = 0 ORDER BY doc_id) END AS revision_id, CASE WHEN doc_id % 12 = 0 THEN true END AS adds FROM documents""",
    "delete_cascade": f"""WITH {_STORE}, k AS (SELECT * FROM f WHERE note_id % 4 <> 0)
      SELECT 'notes' AS name, count(*) AS n FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT 'fragments', count(*) FROM k UNION ALL SELECT 'fragment_embeddings', count(*) FROM k WHERE fragment_id % 2 = 0
      UNION ALL SELECT x, (SELECT count(*) FROM k WHERE order_index < 2) FROM (SELECT unnest(['cards', 'schedules', 'review_logs']) AS x)""",
    "tag_resolve": f"WITH {_TAGS}, {_IDS} SELECT a.tag_id, b.tag_id AS parent_tag_id, a.name AS slug, CAST(a.depth AS INTEGER) AS depth, a.path AS path_cached FROM ids a LEFT JOIN ids b ON b.path = regexp_replace(a.path, '/[^/]*$', '') AND b.path <> a.path",
    "tag_rename": f"WITH {_TAGS}, {_IDS}, o AS (SELECT path AS p FROM ids WHERE tag_id = 1) SELECT tag_id, CASE WHEN tag_id = 1 THEN 'Renamed' ELSE name END AS name, CASE WHEN tag_id = 1 THEN 'renamed' ELSE name END AS slug, CASE WHEN path = p OR starts_with(path, p || '/') THEN 'renamed' || substr(path, length(p) + 1) ELSE path END AS path_cached FROM ids, o",
    "tag_move": f"""WITH {_TAGS}, {_IDS}, o AS (SELECT (SELECT path FROM ids WHERE tag_id = 1) AS p, (SELECT path FROM ids WHERE tag_id = 2) AS q)
      SELECT a.tag_id, CASE WHEN a.tag_id = 2 THEN 1 ELSE b.tag_id END AS parent_tag_id, CAST(a.depth + CASE WHEN a.path = q OR starts_with(a.path, q || '/') THEN 1 ELSE 0 END AS INTEGER) AS depth,
        CASE WHEN a.path = q OR starts_with(a.path, q || '/') THEN p || '/' || a.path ELSE a.path END AS path_cached
      FROM ids a CROSS JOIN o LEFT JOIN ids b ON b.path = regexp_replace(a.path, '/[^/]*$', '') AND b.path <> a.path""",
    "tag_delete": f"""WITH {_TAGS}, {_IDS}, o AS (SELECT path AS p FROM ids WHERE tag_id = 1), u AS (SELECT lower(concat_ws('/', replace(p_type, ' ', '/'), p_brand)) AS path, count(*) AS n FROM part GROUP BY 1)
      SELECT tag_id, ids.path AS path_cached, coalesce(n, 0) AS n FROM ids CROSS JOIN o LEFT JOIN u ON u.path = ids.path WHERE ids.path <> p AND NOT starts_with(ids.path, p || '/')""",
    "cards_rendered": """WITH c AS (SELECT *, o_orderkey % 3 > 0 AS has, CASE WHEN o_orderkey % 3 > 0 THEN 'text of ' || o_orderkey ELSE o_orderstatus END AS body, o_orderkey % 4 AS t, CASE WHEN o_orderkey % 5 = 0 THEN 'front' END AS cf, CASE WHEN o_orderkey % 7 = 0 THEN 'back' END AS cb FROM orders)
      SELECT o_orderkey AS card_id, CASE t WHEN 2 THEN body WHEN 0 THEN coalesce(cf, CASE WHEN NOT has THEN 'Orphaned Section' WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'Untitled Section' END) ELSE coalesce(cf, '') END AS front,
        CASE t WHEN 2 THEN body WHEN 0 THEN coalesce(cb, body) ELSE coalesce(cb, '') END AS back, ['heading', 'qa', 'cloze', 'manual'][t + 1] AS card_type, c_custkey AS note_id, c_name AS note_title, c_mktsegment AS note_path FROM c JOIN customer ON o_custkey = c_custkey""",
    "chunk_candidates": """WITH h AS (SELECT q.vec_id AS chunk_index, e.vec_id, e.label AS note_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY chunk_index ORDER BY s DESC, vec_id) AS n FROM h), b AS (SELECT chunk_index, note_id, max(round(s, 6)) AS score FROM r WHERE n <= 10 GROUP BY ALL)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_index ORDER BY score DESC, note_id) AS place FROM b) WHERE place <= 3""",
    "decode_recommendations": """SELECT o_orderkey AS chunk_index, CASE o_orderkey % 6 WHEN 0 THEN 'append' WHEN 1 THEN 'create_child' WHEN 2 THEN 'create_child' WHEN 3 THEN 'merge_with_chunk' ELSE 'skip' END AS action,
      CASE WHEN o_orderkey % 6 = 0 THEN o_custkey END AS target_note_id, CASE WHEN o_orderkey % 6 = 2 THEN -o_custkey - 1 END AS parent_note_id, CASE o_orderkey % 6 WHEN 1 THEN 't' || o_custkey WHEN 2 THEN 't' END AS new_note_title,
      CASE WHEN o_orderkey % 6 = 3 THEN o_custkey END AS merge_into, CASE WHEN o_orderkey % 6 = 0 THEN 'a,b' END AS tags, CASE WHEN o_orderkey % 6 = 0 THEN CAST(0.5 AS DOUBLE) END AS confidence,
      CASE o_orderkey % 6 WHEN 3 THEN '' WHEN 4 THEN 'no target' WHEN 5 THEN '' ELSE 'r' END AS reason FROM orders""",
    "calibration_run": _GRID + _POINTS + """, best AS (SELECT w, k, tb FROM m ORDER BY mrr DESC, w, k, tb LIMIT 1),
      least_score AS (SELECT CASE WHEN min(score) IS NULL THEN 0.005 ELSE greatest(least(min(score) * 0.9, 0.05), 0.001) END AS v FROM b JOIN best USING (w, k, tb) WHERE rank <= 5)
      SELECT 'retrieval_embedding_weight' AS key, CAST(w AS VARCHAR) AS value FROM best UNION ALL SELECT 'retrieval_rrf_k', CAST(k AS VARCHAR) FROM best UNION ALL SELECT 'retrieval_term_boost_weight', CAST(tb AS VARCHAR) FROM best
      UNION ALL SELECT 'retrieval_min_score', CAST(round(CAST(v AS DOUBLE), 6) AS VARCHAR) FROM least_score""",
    "model_facts": """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'Represent this sentence for searching relevant passages: x' WHEN 1 THEN 'query: x' WHEN 2 THEN 'Instruct: Given a query, retrieve relevant passages' || chr(10) || 'Query: x' ELSE 'x' END AS asked,
      CASE WHEN s_suppkey % 6 = 1 THEN 'passage: x' ELSE 'x' END AS passage, CASE s_suppkey % 6 WHEN 0 THEN 384 WHEN 1 THEN 1024 WHEN 2 THEN 4096 WHEN 3 THEN 384 WHEN 4 THEN 3072 END AS dimension,
      CASE s_suppkey % 6 WHEN 2 THEN 'QWEN3' WHEN 5 THEN 'Q8' END AS quantization FROM supplier""",
    "blob_round_trip": "SELECT vec_id, CAST(4 * len(embedding) AS BIGINT) AS n_bytes, true AS same FROM embeddings",
    "draft_titles": "SELECT o_orderkey, 'Draft ' || strftime(o_orderdate, '%Y-%m-%d %H:%M') AS title FROM orders",
    "fetch_page": "SELECT doc_id, lang FROM documents ORDER BY lang, doc_id LIMIT 25 OFFSET 40",
    "streaming_index": "SELECT doc_id AS note_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_fragments FROM documents",
}
