"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillion.llm import chat, decontaminate, html_extract, ngram_jaccard, packing, pii_crf, qda, quality_rules, token_pack, warc
from quillion.plans.scratch import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_pack.pack_tokens(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.line_report(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture, and those with an id divisible by four captured again, unchanged, as revisit records."""
    pages = _table(spark, sf_dir, "pages")
    resolved = warc.resolve(warc.from_pages(pages).union(warc.captured_again(pages)))
    return resolved.select("page_id", "record_id", "uri", "date", "digest", "state", "original_id", "header", F.decode("payload", "UTF-8").alias("payload"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op8_pii_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.report(_table(spark, sf_dir, "documents"))


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_html_extraction,
        op2_decontamination,
        op3_token_packing,
        op4_quality_rules,
        op5_quality_classifier,
        op6_warc_revisits,
        op7_best_fit_packing,
        op8_pii_masking,
        op9_chat_rotation,
        op10_ngram_jaccard,
    )
    return {f.__name__: f for f in found}


#: Words as the operators see them, and the sets of word n-grams (a text of under n words is one gram).
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+')"

OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {ngram_jaccard.N} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {ngram_jaccard.N - 2}), lambda i: array_to_string(w[i:i + {ngram_jaccard.N - 1}], ' ')) END)) AS g
      FROM w WHERE len(w) > 0),
sets AS (SELECT min(doc_id) AS node, g, len(g) AS n FROM s GROUP BY g),
posts AS (SELECT node, n, unnest(g) AS gram FROM sets),
hits AS (SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS i
         FROM posts a JOIN posts b ON a.gram = b.gram AND a.node < b.node
           AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 7
         GROUP BY ALL),
linked AS (SELECT a, b FROM hits WHERE i * 10 >= (na + nb - i) * 7),
size AS (SELECT node, count(DISTINCT s.doc_id) AS c FROM sets JOIN s USING (g) GROUP BY node),
u AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach(node, seen) AS (SELECT node, node FROM sets UNION SELECT reach.node, u.b FROM reach JOIN u ON reach.seen = u.a),
root AS (SELECT node, min(seen) AS root FROM reach GROUP BY node),
deg AS (SELECT a AS node, sum(c) AS links FROM u JOIN size ON size.node = u.b GROUP BY a)
SELECT doc_id, root AS class_id, (c - 1 + coalesce(links, 0))::BIGINT AS n_links
FROM (SELECT DISTINCT doc_id, g FROM s) JOIN sets USING (g) JOIN root USING (node) JOIN size USING (node) LEFT JOIN deg USING (node)
UNION ALL SELECT DISTINCT doc_id, doc_id, 0 FROM documents WHERE doc_id IS NOT NULL AND coalesce(len({WORDS}), 0) = 0
"""


_Q = quality_rules


def _regex(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


OP4 = rf"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ 	
]+|[ 	
]+$', '', 'g')), lambda x: x <> '') AS every
           FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, every, list_filter(every, lambda x: regexp_matches(x, {_regex(_Q.END)})
        AND NOT regexp_matches(lower(x), {_regex(_Q.NAVIGATION)})
        AND NOT regexp_matches(lower(x), {_regex(_Q.BOILERPLATE)})
        AND len(regexp_split_to_array(x, {_regex(_Q.SYMBOL)})) - 1 <= length(x) * {_Q.MAX_SYMBOLS}::DOUBLE
        AND NOT (len(regexp_split_to_array(x, '{_Q.LOUD}')) - 1) * 4 > len(regexp_split_to_array(x, ' +'))
        AND NOT (len(regexp_split_to_array(x, ' +')) >= {_Q.MIN_WORDS_STUTTER}
                 AND len(list_distinct(regexp_split_to_array(x, ' +'))) < len(regexp_split_to_array(x, ' +')) * {_Q.MIN_DISTINCT}::DOUBLE)) AS good
      FROM l),
r AS (SELECT doc_id, array_to_string(good, chr(10)) AS text, len(every) AS n_lines, len(good) AS n_kept,
        coalesce(list_sum(list_transform(every, lambda x: length(x))), 0)::BIGINT AS n_chars,
        coalesce(list_sum(list_transform(good, lambda x: length(x))), 0)::BIGINT AS n_left FROM g)
SELECT * FROM r WHERE n_left > 0 AND n_left >= n_chars * {1 - _Q.MAX_LOSS}
"""

_D = decontaminate
OP2 = rf"""
WITH pat AS (SELECT '[\p{{L}}\p{{N}}\p{{M}}]+' AS p),
bw AS (SELECT item_id, regexp_extract_all(lower(text), (SELECT p FROM pat)) AS w FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT item_id, w, least(len(w), {_D.N}) AS n FROM bw WHERE len(w) >= {min(_D.N, _D.MIN_WORDS)}),
bg AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram FROM bs),
d AS (SELECT doc_id, text, regexp_extract_all(text, (SELECT p FROM pat)) AS w, regexp_split_to_array(coalesce(text, ''), (SELECT p FROM pat)) AS gap FROM documents),
g AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: lower(array_to_string(w[i:i + n - 1], ' ')))) AS gram
      FROM d, (SELECT DISTINCT n FROM bg)),
h AS (SELECT doc_id, i, n, item_id FROM g JOIN bg USING (n, gram)),
c AS (SELECT doc_id, list_distinct(list(p)) AS cut FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id),
j AS (SELECT d.doc_id, d.text, d.w, d.gap, coalesce(c.cut, []) AS cut, coalesce(k.items, '') AS items FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT doc_id, CASE WHEN len(cut) = 0 THEN text ELSE array_to_string(list_transform(range(1, len(gap) + 1), lambda i:
    CASE WHEN list_contains(cut, i - 1) AND list_contains(cut, i) THEN '' ELSE gap[i] END || CASE WHEN i > len(w) OR list_contains(cut, i) THEN '' ELSE w[i] END), '') END AS text,
  coalesce(len(w), 0) AS n_words, len(cut) AS n_removed, items
FROM j WHERE len(cut) < {_D.DROP_SHARE} * len(w) OR len(cut) = 0
"""


OP6 = rf"""
WITH once AS (SELECT page_id, 'urn:page:' || coalesce(page_id::VARCHAR, 'null') AS record_id, html IS NULL AS revisit, coalesce(url, '') AS uri,
             {warc.EPOCH} + coalesce(page_id, 0) AS secs, 'sha1:' || sha1(coalesce(html, url, '')) AS digest, html FROM pages),
every AS (SELECT * FROM once UNION ALL SELECT page_id, record_id || ':again', true, uri, secs + 86400, digest, NULL FROM once WHERE page_id % 4 = 0),
r AS (SELECT * EXCLUDE (secs), strftime(to_timestamp(secs) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS date,
        row_number() OVER (PARTITION BY digest, revisit ORDER BY secs, record_id, uri, page_id) AS place FROM every),
g AS (SELECT digest, min({{'d': date, 'i': record_id, 'u': uri}}) FILTER (NOT revisit AND place = 1) AS f FROM r GROUP BY digest),
s AS (SELECT r.*, g.f, CASE WHEN NOT revisit AND place = 1 THEN 'original' WHEN g.f IS NOT NULL THEN 'revisit' ELSE 'unresolved' END AS state
      FROM r JOIN g USING (digest)),
p AS (SELECT *, CASE WHEN state = 'original' THEN html ELSE '' END AS payload, chr(13) || chr(10) AS nl FROM s)
SELECT page_id, record_id, uri, date, digest, state, CASE WHEN state = 'revisit' THEN f.i END AS original_id,
  'WARC/1.1' || nl || 'WARC-Type: ' || CASE WHEN state = 'original' THEN 'response' ELSE 'revisit' END || nl || 'WARC-Record-ID: <' || record_id || '>' || nl
  || 'WARC-Target-URI: ' || uri || nl || 'WARC-Date: ' || date || nl || 'WARC-Payload-Digest: ' || digest || nl
  || CASE state WHEN 'original' THEN '' ELSE
       CASE state WHEN 'revisit' THEN 'WARC-Refers-To: <' || f.i || '>' || nl || 'WARC-Refers-To-Target-URI: ' || f.u || nl || 'WARC-Refers-To-Date: ' || f.d || nl ELSE '' END
       || 'WARC-Profile: {warc.PROFILE}' || nl END
  || 'Content-Type: text/html' || nl || 'Content-Length: ' || strlen(payload) || nl || nl AS header, payload
FROM p
"""

OP9 = r"""
WITH t AS (SELECT conv_id, turn, role, replace(replace(coalesce(text, ''), '<|im_', '<||im_'), chr(13) || chr(10), chr(10)) AS text
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM t),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE lower(trim(role)) <> 'system'),
p AS (SELECT n.conv_id, speaker, i, role = speaker AS own,
        '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN lower(trim(role)) = 'system' THEN 'system' ELSE 'user name=' || regexp_replace(replace(replace(role, '<|im_', '<||im_'), chr(13) || chr(10), chr(10)), '[\r\n\x{85}\x{2028}\x{2029}]+', ' ', 'g') END || chr(10) AS head,
        text || '<|im_end|>' || chr(10) AS body FROM n JOIN s USING (conv_id)),
o AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM p)
SELECT conv_id, speaker, count(*) AS n_turns, count(*) FILTER (own) AS n_own, string_agg(head || body, '' ORDER BY i) AS text,
  string_agg((pos + length(head)) || ':' || (pos + length(head) + length(body)), ',' ORDER BY i) FILTER (own) AS mask
FROM o GROUP BY conv_id, speaker
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2, "op4_quality_rules": OP4, "op6_warc_revisits": OP6, "op9_chat_rotation": OP9, "op10_ngram_jaccard": OP10}
