"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, license_scan, near_dedup, oracles, packing, phrases, pii, quality, quality_rules, spelling, toxicity, url_filter, warc_zip
from .common import release, scratch, stage, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path=tokenizer_path(), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(~language_id.held_out()))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.train(docs))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vectors = quality.unit_rows(quality.context_sums(docs))
    net = quality.train(docs, table(spark, sf_dir, "labels").filter(~quality.held_out()), vectors)
    return quality.score(docs, vectors, net).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = scratch(spark, "warc")
    manifest = warc_zip.write_packages(pages, folder)
    records = stage(warc_zip.read_records(manifest, with_payload=False), "warc-records")
    release(folder)
    return warc_zip.digest(warc_zip.resolve(records), pages.schema["page_id"].dataType.simpleString())


QUERIES = {"op1_pii": op1_pii, "op2_language_id": op2_language_id, "op3_toxicity": op3_toxicity, "op4_near_dedup": op4_near_dedup, "op5_url_filter": op5_url_filter, "op6_license_scan": op6_license_scan, "op9_quality": op9_quality, "op10_quality_rules": op10_quality_rules, "op7_decontamination": op7_decontamination, "op8_packing": op8_packing, "op11_phrases": op11_phrases, "op12_spelling_variants": op12_spelling_variants, "op13_warc_zip": op13_warc_zip}

SQL: dict[str, str] = {
    "op13_warc_zip": r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE b >= 100 GROUP BY d)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d""",
    "op7_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM g),
p AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k.k AS k, unnest(range(1, len(w) - k.k + 2)) AS i FROM d, k WHERE len(w) >= k.k)),
h AS (SELECT p.doc_id, p.i, p.k, g.item FROM p JOIN g ON p.k = g.k AND p.gram = g.gram),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op4_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.k >= 85 * (na.n + nb.n - p.k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op10_quality_rules": r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS x, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (
  SELECT *, len(w) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2)),
m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM g),
q AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM m WHERE k > 1) GROUP BY doc_id),
a AS (SELECT l.doc_id, l.source, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(q.n, 0) AS n_repeat_words FROM l LEFT JOIN q USING (doc_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS any_failed FROM a),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS docs, CAST(count(*) FILTER (WHERE any_failed) AS DOUBLE) AS failed FROM f GROUP BY source),
u AS (SELECT count(*) AS k, sum(docs) AS n, sum(failed) / sum(docs) AS m, sum(failed * failed / docs) AS ff, sum(docs * docs) AS nn FROM h),
v AS (SELECT *, CASE WHEN n - nn / n > 0 THEN (ff - n * m * m - (k - 1) * m * (1 - m)) / (n - nn / n) ELSE 0 END AS v FROM u),
z AS (SELECT m, CASE WHEN v > 0 THEN least(1e6, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1e6 END AS strength FROM v),
b AS (SELECT h.source, (h.failed + z.m * z.strength) / (h.docs + z.strength) > 0.5 AS rejected FROM h, z)
SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT b.rejected AS kept, b.rejected AS host_rejected
FROM f JOIN b ON f.source IS NOT DISTINCT FROM b.source""",
}


def _url_sql(depth: int = 4) -> str:
    """The whole template tree in SQL, one group of common table expressions a level."""
    order = sorted(url_filter.RULES, key=lambda r: (-len(r.name), r.name))
    cases = {what: " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, what)}'" for r in order) for what in ("name", "verdict")}
    levels = "".join(
        f"""
a{k} AS (SELECT *, parts[{k + 1}] AS seg FROM t{k - 1}),
n{k} AS (SELECT host, prefix, seg, sum(n) AS m FROM a{k} WHERE seg IS NOT NULL GROUP BY host, prefix, seg),
w{k} AS (SELECT host, prefix, sum(m) AS total FROM n{k} GROUP BY host, prefix HAVING count(*) > 30),
x{k} AS (SELECT host, prefix, seg FROM n{k} JOIN w{k} USING (host, prefix) WHERE m < 0.01 * total),
t{k} AS (SELECT a.host, a.typed, a.parts, a.n, a.labels, a.blocked, CASE WHEN a.seg IS NULL THEN a.prefix ELSE a.prefix || '/' || CASE WHEN x.seg IS NOT NULL THEN '*' ELSE a.seg END END AS prefix
  FROM a{k} a LEFT JOIN x{k} x ON a.host = x.host AND a.prefix = x.prefix AND a.seg = x.seg),"""
        for k in range(1, depth + 1)
    )
    return rf"""
WITH RECURSIVE u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE {cases["name"]} END AS rule, CASE {cases["verdict"]} END AS label,
  array_to_string(list_transform(string_split(lower(path), '/'), lambda s: CASE WHEN regexp_matches(s, '^[0-9a-f]{{8,}}$') AND regexp_matches(s, '[0-9]') AND NOT regexp_matches(s, '^[0-9]+$') THEN '<hex>' WHEN length(s) > 40 THEN '<long>' ELSE regexp_replace(s, '[0-9]+', '<n>', 'g') END), '/') AS typed FROM u),
t0 AS (SELECT host, typed, string_split(typed, '/') AS parts, count(*) AS n, count(label) AS labels, count(*) FILTER (WHERE label = 'block') AS blocked, '' AS prefix FROM r GROUP BY host, typed),{levels}
f AS (SELECT *, CASE WHEN len(parts) > {depth + 1} THEN prefix || '/' || array_to_string(parts[{depth + 2}:], '/') ELSE prefix END AS template FROM t{depth}),
g AS (SELECT host, typed, template, n, labels, blocked, coalesce(string_split(template, '/')[2], '') AS branch, coalesce(array_to_string(string_split(template, '/')[3:], '/'), '') AS below FROM f),
b AS (SELECT host, branch, sum(n) AS n, CASE WHEN sum(labels) > 0 THEN sum(blocked) / sum(labels) END AS rate FROM g GROUP BY host, branch),
s AS (SELECT g.host, g.branch, below, sum(g.n) / any_value(b.n) AS share FROM g JOIN b ON g.host = b.host AND g.branch = b.branch GROUP BY g.host, g.branch, below),
c AS (SELECT x.host, x.branch, y.branch AS other FROM s x JOIN s y ON x.host = y.host AND x.below = y.below AND x.branch <> y.branch GROUP BY x.host, x.branch, y.branch HAVING sum(least(x.share, y.share)) >= 0.8),
m AS (SELECT c.host, c.branch, coalesce(min(c.other) FILTER (WHERE q.rate IS NOT NULL), min(c.other)) AS next FROM c JOIN b p ON c.host = p.host AND c.branch = p.branch JOIN b q ON c.host = q.host AND c.other = q.branch
  WHERE CASE WHEN p.rate IS NULL THEN q.rate IS NOT NULL OR c.other < c.branch ELSE c.other < c.branch AND q.rate IS NOT NULL AND abs(p.rate - q.rate) <= 0.2 END GROUP BY c.host, c.branch),
y AS (SELECT b.host, b.branch, b.branch AS into_branch FROM b LEFT JOIN m ON b.host = m.host AND b.branch = m.branch WHERE m.next IS NULL
  UNION ALL SELECT m.host, m.branch, y.into_branch FROM m JOIN y ON m.host = y.host AND m.next = y.branch),
h AS (SELECT g.host, typed, labels, blocked, into_branch AS branch, CASE WHEN into_branch = g.branch THEN template ELSE concat_ws('/', '', into_branch, nullif(below, '')) END AS template FROM g JOIN y ON g.host = y.host AND g.branch = y.branch),
z AS (SELECT CASE WHEN sum(labels) > 0 THEN (sum(blocked) + 0.5) / (sum(labels) + 1.0) ELSE 0 END AS base FROM h),
k AS (SELECT host, branch, (sum(blocked) + 5.0 * any_value(base)) / (sum(labels) + 5.0) AS branch_share FROM h, z GROUP BY host, branch HAVING sum(labels) > 0),
l AS (SELECT h.host, h.branch, h.template FROM h JOIN k ON h.host = k.host AND h.branch = k.branch GROUP BY h.host, h.branch, h.template HAVING (sum(blocked) + 5.0 * any_value(branch_share)) / (sum(labels) + 5.0) >= 0.9),
o AS (SELECT DISTINCT h.host, h.typed FROM h JOIN l ON h.host = l.host AND h.branch = l.branch AND h.template = l.template)
SELECT page_id, r.host, path, rule, coalesce(label, CASE WHEN o.typed IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM r LEFT JOIN o ON r.host = o.host AND r.typed = o.typed"""


SQL["op5_url_filter"] = _url_sql()
SQL["op11_phrases"] = oracles.phrase_sql()
SQL["op12_spelling_variants"] = oracles.spelling_sql()
