"""Registered queries of the training-data operators and their DuckDB formulations."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import anchors, decontaminate, jaccard_join, langid, lexical_search, mixing, pieces, pii, secrets, sketch, suffix, token_align, url_filter
from .common import documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op3_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op3_url_filter"] = r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM q)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN list_has_any(string_split(host, '.'), ['spam-farm', 'cheap-pills']) THEN 'block' ELSE 'allow' END AS verdict
FROM r"""


@_query
def op8_fingerprints(spark, sf_dir):
    return sketch.report(sketch.fingerprint_pairs(documents(spark, sf_dir)))


@_query
def op10_secrets(spark, sf_dir):
    return secrets.report(secrets.scan(documents(spark, sf_dir)))


@_query
def op4_substring_dedup(spark, sf_dir):
    return anchors.remove_repeats(documents(spark, sf_dir)).drop("kept")


@_query
def op2_suffix_dedup(spark, sf_dir):
    return suffix.remove_repeats(documents(spark, sf_dir)).drop("kept")


@_query
def op1_jaccard_join(spark, sf_dir):
    return jaccard_join.similar_components(documents(spark, sf_dir)).drop("sig", "root")


@_query
def op5_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text")
    return langid.annotate(out, langid.train(docs)).drop("text")


@_query
def op6_personal_data(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.train(pii.labelled_table(docs)))


@_query
def op9_decontaminate(spark, sf_dir):
    """Per document: the benchmark items that leak into it."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.size("leaks").cast("long").alias("n_items"),
                        F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"),
                        F.transform("leaks", lambda x: x["edits"]).alias("edits"))


@_query
def op7_mixing(spark, sf_dir):
    """Per document: its cell, calibrated probability and whether it is sampled."""
    return mixing.assign(documents(spark, sf_dir)).select(
        "doc_id", "m_source", "m_lang", "m_topic", "m_tokens", "weight", "probability", "sampled")


def _vocabulary(name: str) -> str:
    """The place of a public vocabulary file; the operators take the path as a parameter."""
    import public_tokenizers
    return public_tokenizers.path(name)


@_query
def op11_lexical_search(spark, sf_dir):
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_query
def op12_sentencepiece(spark, sf_dir):
    return pieces.round_trip(documents(spark, sf_dir), pieces.load_model(_vocabulary("piece_bpe_32k.model")))


@_query
def op13_token_alignment(spark, sf_dir):
    pair = token_align.load_pair(_vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))
    return token_align.align(documents(spark, sf_dir), *pair)


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES["op1_jaccard_join"] = """
WITH RECURSIVE w AS (SELECT doc_id, """ + _WORDS.format(
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + """ AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0) t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.k = q.k AND p.doc_id <> q.doc_id
      GROUP BY 1, 2) x JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)"""

ORACLES["op4_substring_dedup"] = """
WITH w AS (SELECT doc_id, """ + _WORDS.format("coalesce(text, '')") + """ AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13) t),
m AS (SELECT k, min(doc_id) AS low FROM x GROUP BY k),
g AS (SELECT DISTINCT doc_id, i + j AS p FROM x JOIN m USING (k), range(13) r(j) WHERE low < doc_id),
p AS (SELECT doc_id, ws[p] AS word, p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w) t),
k AS (SELECT p.doc_id, count(*) FILTER (WHERE g.p IS NOT NULL) AS gone, string_agg(word, ' ' ORDER BY p.p) FILTER (WHERE g.p IS NULL) AS kept
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.p = g.p GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""

ORACLES["op2_suffix_dedup"] = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, x, length(x) // 2 AS n FROM h),
s AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM b WHERE n >= 50) t),
m AS (SELECT k, min(doc_id) AS low FROM s GROUP BY k),
t AS (SELECT doc_id, i FROM s JOIN m USING (k) WHERE low < doc_id),
u AS (SELECT doc_id, i, i > lag(i) OVER v + 50 OR lag(i) OVER v IS NULL AS fresh FROM t WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, grp, min(i) AS a, max(i) + 50 AS z FROM (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS grp
      FROM u) y GROUP BY 1, 2),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM r),
f AS (SELECT k.doc_id, count(*) AS n_spans, sum(z - a) AS gone, max(z) AS last, string_agg(substr(x, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) AS head
      FROM k JOIN b ON b.doc_id = k.doc_id GROUP BY 1)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN f USING (doc_id)"""

_TERMS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op11_lexical_search"] = """
WITH q AS (SELECT row_number() OVER () AS item, item_id, """ + _TERMS.format("text") + """ AS ts FROM benchmark),
qt AS (SELECT item, t, count(*) AS times FROM (SELECT item, unnest(ts) AS t FROM q) x GROUP BY 1, 2),
d AS (SELECT row_number() OVER () AS r, doc_id, """ + _TERMS.format("text") + """ AS ts FROM documents),
n AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
g AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
v AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) x WHERE t IN (SELECT t FROM qt) GROUP BY 1, 2),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM v, g GROUP BY t, n_docs),
c AS (SELECT v.r, v.t, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS x FROM v JOIN w USING (t) JOIN n USING (r), g),
s AS (SELECT item, r, CAST(sum(times * x) AS BIGINT) AS score FROM qt JOIN c USING (t) GROUP BY 1, 2 HAVING sum(times * x) > 0),
k AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s JOIN n USING (r))
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k JOIN q USING (item) WHERE rank <= 10"""
