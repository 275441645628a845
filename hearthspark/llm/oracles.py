"""DuckDB SQL of the phrase and spelling queries."""

from __future__ import annotations

from . import phrases, spelling


def phrase_sql(longest: int = phrases.LONGEST) -> str:
    """All runs of words counted, without sample or border."""
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, a, {k} AS cut, array_to_string(w[1:{k}], ' ') AS lp, array_to_string(w[{k + 1}:], ' ') AS rp FROM x WHERE k > {k}" for k in range(1, longest))
    return rf"""
WITH p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
q AS (SELECT unnest(range(1, {longest + 1})) AS k),
g AS (SELECT lang, k, w[i:i + k - 1] AS w FROM (SELECT lang, w, q.k AS k, unnest(range(1, len(w) - q.k + 2)) AS i FROM p, q WHERE len(w) >= q.k)),
f AS (SELECT lang, k, any_value(w) AS w, array_to_string(w, ' ') AS phrase, count(*) AS a FROM g GROUP BY lang, k, array_to_string(w, ' ') HAVING count(*) >= {phrases.LEAST}),
e AS (SELECT lang, array_to_string(w[1:k - 1], ' ') AS phrase, a FROM f WHERE k > 2 UNION ALL SELECT lang, array_to_string(w[2:k], ' ') AS phrase, a FROM f WHERE k > 2),
u AS (SELECT lang, phrase, max(a) AS m FROM e GROUP BY lang, phrase),
x AS (SELECT f.lang, f.phrase, f.k, f.w, f.a FROM f LEFT JOIN u ON f.lang = u.lang AND f.phrase = u.phrase WHERE f.k > 1 AND (u.m IS NULL OR 100 * u.m < {phrases.PERCENT} * f.a)),
c AS ({cuts}),
s AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, t.n, c.cut, CAST(CAST(1000 AS HUGEINT) * c.a * t.n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM c JOIN f l ON c.lang = l.lang AND c.lp = l.phrase JOIN f r ON c.lang = r.lang AND c.rp = r.phrase JOIN t ON c.lang = t.lang),
b AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS best FROM s) WHERE best = 1),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM o WHERE rank <= {phrases.TOP}"""


def spelling_sql() -> str:
    """crc32 byte by byte from its table, all edits of every word, and forms followed by recursion."""
    return rf"""
WITH RECURSIVE z AS (SELECT i, 0 AS k, i AS v FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM z WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM z WHERE k = 8),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
l AS (SELECT id, w, count(*) AS n FROM (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM d WHERE length(run) >= {spelling.LEAST_LENGTH}) GROUP BY id, w),
y AS (SELECT w, n, list_filter(flatten(list_transform(string_split(id || ':' || w, ''), lambda c: [CASE WHEN unicode(c) < 128 THEN -1 ELSE 195 END, CASE WHEN unicode(c) < 128 THEN unicode(c) ELSE unicode(c) - 64 END])), lambda q: q >= 0) AS b FROM l),
h AS (SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(b, lambda q: CAST(q AS BIGINT))), lambda s, q: xor(t[xor(s, q) % 256 + 1], s // 256)), CAST(4294967295 AS BIGINT)) AS h FROM y, crc),
m AS (SELECT CASE WHEN h % {spelling.NOISE} = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS w, n FROM h),
v AS (SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(w) >= {spelling.LEAST_LENGTH} GROUP BY w HAVING sum(n) >= {spelling.LEAST_COUNT}),
e AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT x.word AS a, y.word AS b FROM e x JOIN e y ON x.i = y.i AND x.rest = y.rest WHERE x.word <> y.word
  UNION SELECT e.word AS a, v.word AS b FROM e JOIN v ON e.rest = v.word UNION SELECT v.word AS a, e.word AS b FROM e JOIN v ON e.rest = v.word),
k AS (SELECT a AS word, count(*) AS n_near FROM p GROUP BY a),
o AS (SELECT * FROM (SELECT p.a AS word, p.b AS form, f.n AS form_n, row_number() OVER (PARTITION BY p.a ORDER BY f.n DESC, p.b) AS q FROM p JOIN v f ON p.b = f.word) WHERE q = 1),
x AS (SELECT o.word, o.form, o.form_n FROM o JOIN v ON o.word = v.word WHERE o.form_n >= {spelling.LEAST_RATIO} * v.n),
r AS (SELECT word, form AS root FROM x UNION ALL SELECT r.word, x.form AS root FROM r JOIN x ON r.root = x.word),
s AS (SELECT r.word, r.root FROM r LEFT JOIN x ON r.root = x.word WHERE x.word IS NULL)
SELECT v.word, x.form, coalesce(s.root, v.word) AS root, v.n, CAST(coalesce(k.n_near, 0) AS BIGINT) AS n_near, x.form_n
FROM v LEFT JOIN k ON v.word = k.word LEFT JOIN x ON v.word = x.word LEFT JOIN s ON v.word = s.word"""
