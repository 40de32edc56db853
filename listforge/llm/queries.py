"""Registered queries of the document operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from listforge.llm import (decontaminate, embedding_dedup, html_consensus, jaccard_join, lexical_search, line_dedup, lm_scoring, mixing, personal_data,
                           prefix_trie, quality, token_counts, toxicity)
from listforge.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage of a document that is a test item within 6 edits in 100 characters."""
    return decontaminate.matches(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query
def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score_texts(documents(spark, folder))


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, folder), "piece_bpe_32k.model")


@query
def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join_documents(documents(spark, folder), 4, 85)


@query
def op5_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.dedup(spark.read.parquet(f"{folder}/embeddings.parquet"), 0.95)


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return toxicity.score_toxicity(docs, toxicity.train(docs, labels(spark, folder)))


@query
def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.digest(documents(spark, folder))


@query
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the blocks of 25 words or more that earlier documents hold."""
    return line_dedup.cut_lines(documents(spark, folder))


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return quality.score_quality(docs, quality.train(docs, labels(spark, folder)))


@query
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """As many tokens as there are, from sources as alike in size as using none more than 1.25 times allows."""
    return mixing.mix_sources(documents(spark, folder), max_repeats=1.25)


@query
def op11_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_consensus.digest(spark.read.parquet(f"{folder}/pages.parquet"))


@query
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.digest(spark.read.parquet(f"{folder}/conversations.parquet"))


ORACLES["op10_mixing"] = r"""
WITH rows AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens FROM documents),
sources AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n_rows FROM rows GROUP BY source HAVING sum(n_tokens) > 0),
tot AS (SELECT sum(tokens)::DOUBLE AS t FROM sources),
fig AS (
  SELECT k / 4096.0::DOUBLE AS a, max(pow(tokens / t, k / 4096.0::DOUBLE) / tokens) * any_value(t) / sum(pow(tokens / t, k / 4096.0::DOUBLE)) AS r
  FROM sources, tot, (SELECT range AS k FROM range(0, 4097)) GROUP BY k),
ex AS (SELECT coalesce(min(a) FILTER (WHERE r <= 1.25 + 1e-12), 1.0) AS a FROM fig),
zed AS (SELECT sum(pow(tokens / t, a)) AS z FROM sources, tot, ex),
plan AS (
  SELECT source, tokens, floor(t * round(pow(tokens / t, a) / z, 12))::BIGINT AS budget, ceil(greatest(tokens, n_rows) / 65536.0)::BIGINT AS blocks
  FROM sources, tot, ex, zed),
dealt AS (
  SELECT r.*, p.tokens, p.budget, ('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '-')), 1, 15))::BIGINT % p.blocks AS block
  FROM rows r JOIN plan p USING (source)),
blocks AS (SELECT source, block, any_value(tokens) AS tokens, any_value(budget) AS budget, sum(n_tokens)::BIGINT AS size FROM dealt GROUP BY source, block),
epochs AS (SELECT *, unnest(range(0, budget // tokens + 1)) AS epoch FROM blocks),
started AS (
  SELECT *, epoch * tokens + coalesce(sum(size) OVER (PARTITION BY source, epoch
      ORDER BY ('0x' || substr(md5('1:' || source || ':' || epoch || ':' || block), 1, 15))::BIGINT, block
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block_start
  FROM epochs),
placed AS (
  SELECT d.doc_id, d.source, d.n_tokens, s.epoch, d.block, s.block_start, s.budget,
    ('0x' || substr(md5('1:' || s.epoch || ':' || coalesce(d.doc_id::VARCHAR, '-') || ':place'), 1, 15))::BIGINT AS place
  FROM dealt d JOIN started s ON d.source = s.source AND d.block = s.block),
summed AS (
  SELECT *, block_start + sum(n_tokens) OVER (PARTITION BY source, block, epoch ORDER BY place, doc_id, n_tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM placed)
SELECT doc_id, source, n_tokens, epoch, block, block_start, place FROM summed WHERE upto <= budget
"""


ORACLES["op4_jaccard_join"] = r"""
WITH toks AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM toks),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 85 * (nx + ny - c)),
two_way AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  WITH RECURSIVE r AS (SELECT x AS start, y AS node FROM two_way UNION SELECT r.start, b.y FROM r JOIN two_way b ON b.x = r.node)
  SELECT start, min(node) AS least FROM r GROUP BY start)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(r.least, s.doc_id)) AS component_id FROM sets s LEFT JOIN reach r ON r.start = s.doc_id
"""

ORACLES["op7_personal_data"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
hits AS (
  SELECT doc_id, text, k.rank, k.kind, regexp_split_to_array(text, k.p) AS gaps, regexp_extract_all(text, k.p) AS hits
  FROM t, (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
    (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'),
    (4, 'iban', '\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b')) k(rank, kind, p)),
each AS (
  SELECT doc_id, text, rank, kind, hits[i] AS hit,
    (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM hits)),
coded AS (SELECT *, start + length(hit) AS stop, regexp_replace(hit, '[^0-9]', '', 'g') AS d, replace(hit, ' ', '') AS bare FROM each),
good AS (
  SELECT doc_id, rank, kind, start, stop, lower(substr(text, greatest(start - 40, 0) + 1, least(start, 40))) AS before FROM coded WHERE CASE kind WHEN 'email' THEN TRUE
    WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 OR ('0' || left(ltrim(x, '0'), 3))::INTEGER > 255)) = 0
    WHEN 'card' THEN length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda i:
      CASE WHEN i % 2 = 0 THEN d[length(d) - i]::INTEGER WHEN d[length(d) - i]::INTEGER > 4 THEN d[length(d) - i]::INTEGER * 2 - 9 ELSE d[length(d) - i]::INTEGER * 2 END)) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
    ELSE list_reduce(list_prepend(0, list_transform(string_split(bare[5:] || bare[:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INTEGER ELSE ascii(c) - 55 END)),
      lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1 END),
scored AS (
  SELECT *, CASE kind
    WHEN 'email' THEN CASE WHEN regexp_matches(before, 'mail|contact|write') THEN 100 ELSE 80 END
    WHEN 'ip' THEN CASE WHEN regexp_matches(before, 'ip|host|server|address') THEN 80 ELSE 60 END
    WHEN 'card' THEN CASE WHEN regexp_matches(before, 'card|visa|credit|payment') THEN 100 ELSE 80 END
    WHEN 'phone' THEN CASE WHEN regexp_matches(before, 'phone|tel|call|mobile') THEN 70 ELSE 50 END
    ELSE CASE WHEN regexp_matches(before, 'iban|account|bank') THEN 100 ELSE 90 END END AS score FROM good),
joined AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card, count(*) FILTER (rank = 3) AS n_phone,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 4) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
    string_agg(score::VARCHAR, ',' ORDER BY start, rank) AS scores, count(*) FILTER (score >= 80) AS n_likely FROM scored GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores, coalesce(n_likely, 0) AS n_likely FROM t LEFT JOIN joined j ON j.doc_id = t.doc_id
"""
# Pages of one family: the article element, up to the end where a page is cut off.
ORACLES["op11_html_extraction"] = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '</?[a-zA-Z][^>]*$', '') AS inner_html FROM pages),
b AS (SELECT page_id, url, unnest(string_split(regexp_replace(inner_html, '</?(?:h1|p)>', chr(1), 'g'), chr(1))) AS block, generate_subscripts(string_split(regexp_replace(inner_html, '</?(?:h1|p)>', chr(1), 'g'), chr(1)), 1) AS i FROM a),
c AS (SELECT page_id, url, i, regexp_replace(block, '</?[a-zA-Z][^>]*>', '', 'g') AS block FROM b),
e AS (SELECT page_id, url, i, replace(regexp_replace(replace(replace(replace(block, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', chr(1), 'g'), chr(1), '&') AS block FROM c),
f AS (SELECT page_id, url, i, trim(regexp_replace(block, '[\s\x0B\x1C-\x1F\x{85}\x{A0}]+', ' ', 'g')) AS block FROM e),
g AS (SELECT page_id, url, string_agg(block, chr(10) ORDER BY i) FILTER (block <> '') AS text FROM f GROUP BY page_id, url)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM g
"""

ORACLES["op12_lexical_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t
  FROM documents),
tot AS (SELECT count(*) FILTER (len(t) > 0)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, tot GROUP BY term, n_docs),
q AS (
  SELECT DISTINCT item_id, unnest(list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term
  FROM benchmark),
s AS (
  SELECT q.item_id, tf.r, any_value(tf.doc_id) AS doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * tf.n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN tf ON tf.term = q.term JOIN w ON w.term = q.term, tot GROUP BY q.item_id, tf.r),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

ORACLES["op13_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark,
    len(list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS words
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'m': mark, 'w': words} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
crc AS (SELECT range AS b, list_reduce(range(0, 9)::UBIGINT[], lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, range::UBIGINT) AS v FROM range(0, 256)),
tab AS (SELECT list(v ORDER BY b) AS v FROM crc),
h AS (
  SELECT conv_id, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
      lambda a, c: xor(a >> 8, tab.v[(xor(a, c) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 4)::BIGINT AS h
  FROM own, tab),
paths AS (
  SELECT o.conv_id, coalesce(b.turns, [])[1:h.h] || o.turns[h.h + 1:] AS p
  FROM own o JOIN h ON h.conv_id = o.conv_id LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
pre AS (
  SELECT conv_id, d, len(p) AS n, list_transform(p[1:d], lambda x: x.m) AS node, CASE WHEN d > 0 THEN list_transform(p[1:d - 1], lambda x: x.m) END AS parent,
    CASE WHEN d > 0 THEN p[d].w ELSE 0 END AS words
  FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM paths)),
nodes AS (
  SELECT node, any_value(parent) AS parent, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM pre GROUP BY node, d),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.node = n.node),
up AS (SELECT list_slice(node, 1, k) AS top, n_children, (n_convs - 1) * words AS saving FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM full_nodes)),
sums AS (SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, sum(saving) AS saved FROM up GROUP BY top)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.top = n.node LEFT JOIN full_nodes p ON p.node = n.parent
"""
