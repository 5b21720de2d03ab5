"""Queries of the prose engine over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillion.functions import markers, text
from quillion.operators import evaluate, findings, similarity, stats, volume
from quillion.operators.components import connected_components
from quillion.plans.scratch import Scratch
from quillion.sources import adapters, extract, restatement as restated

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.blocks_from_text(_read(spark, sf, "documents"))


_A = r"\p{L}\p{N}"
_WORDS = "list_filter(string_split({}, ' '), lambda x: x <> '')"
B = rf"""b AS (SELECT *, len({_WORDS.format("normalized")}) AS size_words, line_end AS size_lines, CASE kind WHEN 'docstring' THEN 0 ELSE 1 END AS kind_rank FROM
  (SELECT doc_id, lang, source, text AS raw, source || '/doc_' || doc_id || '.py' AS path, CASE WHEN doc_id % 2 = 0 THEN 'docstring' ELSE 'comment' END AS kind,
     1 AS line_start, 1 + length(text) - length(replace(text, chr(10), '')) AS line_end, trim(regexp_replace(lower(text), '[^{_A}]+', ' ', 'g')) AS normalized FROM documents))"""
_LINE = rf"""replace(regexp_replace(x, '(^|[^{_A}])-([0-9])', '\1' || chr(57344) || '\2', 'g'), '!=', chr(57345) || '=')"""
COMPARABLE = rf"""trim(regexp_replace(lower(array_to_string(list_transform(list_transform(string_split(raw, chr(10)), lambda x: {_LINE}),
  lambda y: CASE WHEN NOT regexp_matches(y, '[{_A}]') THEN '' ELSE regexp_replace(replace(replace(regexp_replace(
    replace(regexp_extract(y, '^[^{_A}]*'), '>', ' ') || substr(y, length(regexp_extract(y, '^[^{_A}]*')) + 1),
    '[^{_A}<>=\x{{E000}}\x{{E001}}]', ' ', 'g'), chr(57344), '-'), chr(57345), '!'), '([<>=!-])', ' \1 ', 'g') END), ' ')), ' +', ' ', 'g'))"""
_AT = "path || ':' || line_start || CASE WHEN line_end > line_start THEN '-' || line_end ELSE '' END"
_GRAMS = "list_distinct(list_transform(range(1, len({0}) - 1), lambda i: {0}[i] || ' ' || {0}[i + 1] || ' ' || {0}[i + 2]))"
C = rf"""c AS (SELECT *, {_WORDS.format("narrative")} AS nw FROM (SELECT *, {COMPARABLE} AS narrative FROM b WHERE size_lines >= 2 AND size_words >= 8) WHERE len({_WORDS.format("narrative")}) >= 3)"""
N = rf"""n AS (SELECT narrative, count(*) AS cnt, min(path) AS first, any_value(nw) AS w FROM c GROUP BY narrative),
g AS (SELECT first AS node, narrative, cnt, {_GRAMS.format("w")} AS gs FROM n),
p AS (SELECT node, cnt, len(gs) AS k, unnest(gs) AS s FROM g),
h AS (SELECT x.node AS l, y.node AS r, x.k AS nl, y.k AS nr, x.cnt AS cl, y.cnt AS cr, count(*) AS i FROM p x JOIN p y ON x.s = y.s AND x.node < y.node GROUP BY ALL),
e AS (SELECT l, r, i / (nl + nr - i) AS score FROM h WHERE i / (nl + nr - i) >= 0.75)"""
K = r"""u AS (SELECT l, r FROM e UNION SELECT r, l FROM e UNION SELECT node, node FROM g),
reach(node, seen) AS (SELECT l, r FROM u UNION SELECT reach.node, u.r FROM reach JOIN u ON reach.seen = u.l),
root AS (SELECT node, min(seen) AS root FROM reach GROUP BY node),
m AS (SELECT root.root, c.path, c.line_start, c.line_end, c.kind FROM c JOIN g USING (narrative) JOIN root ON root.node = g.node),
size AS (SELECT root, count(*) AS members FROM m GROUP BY root HAVING count(*) > 1),
twins AS (SELECT root, first AS l, second AS r, 1.0::DOUBLE AS score FROM (SELECT root.root, g.node AS first, (SELECT min(path) FROM c WHERE c.narrative = g.narrative AND path > g.node) AS second
   FROM g JOIN root ON root.node = g.node WHERE cnt > 1)),
edges AS (SELECT root, l, r, score FROM e JOIN root ON root.node = e.l UNION ALL SELECT * FROM twins),
weak AS (SELECT root, min({'s': score, 'l': l, 'r': r}) AS w FROM edges GROUP BY root)"""
_WITH = f"WITH RECURSIVE {B}, {C}, {N}, {K}"


@_query(f"WITH {B} SELECT doc_id, normalized FROM b")
def normalize_words(spark, sf):
    return _blocks(spark, sf).select("doc_id", "normalized")


@_query(f"WITH {B} SELECT path, kind, size_lines, size_words, size_lines >= 2 AND size_words >= 8 AS is_large_enough FROM b")
def block_sizes(spark, sf):
    return _blocks(spark, sf).select("path", "kind", "size_lines", "size_words", text.large_enough(F.col("size_lines"), F.col("size_words")).alias("is_large_enough"))


@_query(f"WITH {B} SELECT doc_id, {COMPARABLE} AS comparable FROM b")
def normalize_comparable(spark, sf):
    return _blocks(spark, sf).select("doc_id", text.normalize_comparable(F.col("raw")).alias("comparable"))


@_query(f"WITH {B} SELECT doc_id, {COMPARABLE} AS narrative FROM b")
def narrative(spark, sf):
    return _blocks(spark, sf).select("doc_id", "narrative")


_MESSAGE = f"{_AT} || ': ' || code || ' ' || kind || ' is ' || size_words || ' words long, over the ' || max_volume || '-word limit — shorten it, or mark it with `# !' || code || '` on the line above it'"
_OVER = f"""o AS (SELECT *, CASE kind WHEN 'comment' THEN 'TPX001' ELSE 'TPX002' END AS code, CASE kind WHEN 'comment' THEN {volume.COMMENT_MAX} ELSE {volume.DOCSTRING_MAX} END AS max_volume FROM b
  WHERE size_words > CASE kind WHEN 'comment' THEN {volume.COMMENT_MAX} ELSE {volume.DOCSTRING_MAX} END)"""


@_query(f"WITH {B}, {_OVER} SELECT code, path, line_start AS line, line_end AS end_line, kind AS prose_kind, {_MESSAGE} AS message, size_words AS words, max_volume FROM o")
def volume_overruns(spark, sf):
    return volume.volume_findings(_blocks(spark, sf))


@_query(f"WITH {B}, {_OVER} SELECT code, count(*) AS findings FROM o GROUP BY code")
def volume_by_kind(spark, sf):
    return volume.volume(_blocks(spark, sf)).groupBy("code").agg(F.count("*").alias("findings"))


@_query(f"WITH {B}, {C} SELECT path, len({_GRAMS.format('nw')}) AS shingles FROM c")
def shingle_counts(spark, sf):
    floor = similarity.candidates_floor(_blocks(spark, sf))
    return floor.select("path", F.size(text.shingles(text.words(F.col("narrative")))).alias("shingles"))


@_query(f"WITH {B}, {C}, s AS (SELECT unnest({_GRAMS.format('nw')}) AS s FROM c), d AS (SELECT s, count(*) AS df FROM s GROUP BY s) SELECT df, count(*) AS shingles FROM d GROUP BY df")
def shingle_df(spark, sf):
    return stats.shingle_df(_kept(spark, similarity.hashed(_blocks(spark, sf)).select("id", "grams")))


@_query(f"WITH {B}, {C} SELECT min(path) AS first, count(*) AS members FROM c GROUP BY narrative HAVING count(*) > 1")
def exact_groups(spark, sf):
    return similarity.nodes(similarity.hashed(_blocks(spark, sf))).where("n_blocks > 1").select("first.path", "n_blocks").toDF("first", "members")


_EXACT = "x AS (SELECT normalized, count(*) AS copies, arg_min(size_lines, doc_id) AS size_lines, arg_min(size_words, doc_id) AS size_words, arg_min(path, doc_id) AS path, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM b WHERE normalized <> '' GROUP BY normalized HAVING count(*) > 1)"


@_query(f"WITH {B}, {_EXACT} SELECT least(size_lines, 6)::INTEGER AS size_lines, sum(pairs)::BIGINT AS pairs, count(*) AS groups FROM x GROUP BY 1")
def exact_pairs_by_size(spark, sf):
    groups = stats.exact_groups(_blocks(spark, sf))
    return groups.groupBy(F.least("size_lines", F.lit(6)).alias("size_lines")).agg(F.sum("pairs").alias("pairs"), F.count("*").alias("groups"))


def _kept(spark, df):
    return Scratch(spark, "query").keep(df)


@_query(f"WITH {B}, {C}, {N} SELECT l AS first, r AS second, score FROM e")
def near_edges(spark, sf):
    groups, edges = similarity.joined(_blocks(spark, sf))
    a, b = (groups.select(F.col("id").alias(k), F.col("first.path").alias(p)) for k, p in (("l", "a"), ("r", "b")))
    return edges.join(a, "l").join(b, "r").select(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second"), "score")


@_query(f"WITH {B}, {C}, {N} SELECT coalesce(sum(cl * cr), 0)::BIGINT AS comparisons FROM h")
def comparisons(spark, sf):
    return similarity.comparisons(_blocks(spark, sf))


@_query(_WITH + " SELECT root AS first, size.members, w.l AS weakest_first, w.r AS weakest_second, w.s AS similarity FROM size JOIN weak USING (root)")
def clusters(spark, sf):
    found = similarity.clusters(_blocks(spark, sf))
    return found.select(
        F.col("members")[0]["path"].alias("first"), F.size("members").alias("members"), F.col("weakest_first.path").alias("weakest_first"), F.col("weakest_second.path").alias("weakest_second"), F.col("weakest_score").alias("similarity")
    )


@_query(_WITH + " SELECT root AS first, path, kind FROM m WHERE root IN (SELECT root FROM size)")
def cluster_members(spark, sf):
    found = similarity.clusters(_blocks(spark, sf))
    return found.select(F.col("members")[0]["path"].alias("first"), F.explode("members").alias("m")).select("first", "m.path", "m.kind")


@_query(f"WITH RECURSIVE {B}, {C}, {N}, {K} SELECT node, root FROM root WHERE node IN (SELECT l FROM e UNION SELECT r FROM e)")
def components(spark, sf):
    groups, edges = similarity.joined(_blocks(spark, sf))
    paths = groups.select(F.col("id").alias("node"), F.col("first.path").alias("path"))
    named = _kept(spark, connected_components(edges).join(paths, "node"))
    return named.join(named.groupBy("root").agg(F.min("path").alias("least")), "root").select(F.col("path").alias("node"), F.col("least").alias("root"))


_ADDRESSES = f"""ad AS (SELECT root, list({_AT} ORDER BY path) AS ats, min(path) AS path FROM m WHERE root IN (SELECT root FROM size) GROUP BY root),
one AS (SELECT path, {_AT} AS at, line_end, kind FROM b),
f3 AS (SELECT 'TPX003' AS code, ad.path, 1 AS line, one.line_end AS end_line, one.kind AS prose_kind,
  ats[1] || ': TPX003 same explanation in ' || len(ats) || ' places: ' || array_to_string(ats[2:11], ', ') || CASE WHEN len(ats) > 11 THEN ', … and ' || (len(ats) - 11) || ' more' ELSE '' END
  || ' (weakest ' || wl.at || ' ~ ' || wr.at || ', similarity ' || printf('%.3f', w.s) || ')' AS message, len(ats) AS places
  FROM ad JOIN one USING (path) JOIN weak USING (root) JOIN one wl ON wl.path = w.l JOIN one wr ON wr.path = w.r)"""


@_query(
    f"{_WITH}, {_OVER}, {_ADDRESSES} SELECT code, path, line_start AS line, line_end AS end_line, kind AS prose_kind, {_MESSAGE} AS message, size_words AS words, max_volume, 0 AS places FROM o "
    "UNION ALL SELECT code, path, line, end_line, prose_kind, message, 0, 0, places FROM f3"
)
def all_findings(spark, sf):
    return findings.findings(_blocks(spark, sf)).select("code", "path", "line", "end_line", "prose_kind", "message", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("words", "max_volume")], F.when(F.col("locations").isNotNull(), F.size("locations")).otherwise(0).alias("places"))


@_query(f"{_WITH}, {_OVER}, {_ADDRESSES} SELECT code, count(*) AS findings FROM (SELECT code FROM o UNION ALL SELECT code FROM f3) GROUP BY code")
def findings_per_code(spark, sf):
    return findings.findings(_blocks(spark, sf)).groupBy("code").agg(F.count("*").alias("findings"))


_MARK = "CASE doc_id % 6 WHEN 0 THEN '# !TPX003' WHEN 1 THEN '# !TPX*' WHEN 2 THEN '# !TPX002,TPX003 reason' WHEN 3 THEN '#!TPX003' WHEN 4 THEN '# !tpx003,TPX9' ELSE 'x = 1' END"


@_query(f"{_WITH.replace(' FROM documents)', f' FROM documents WHERE doc_id % 6 NOT IN (0, 1, 2))')} SELECT root AS first, size.members, w.s AS similarity FROM size JOIN weak USING (root)")
def suppressed_clusters(spark, sf):
    """Blocks silenced by the marker above them are out before clustering."""
    marked = _blocks(spark, sf).withColumn("line_above", F.expr(_MARK))
    loud = marked.where(~markers.silenced(markers.suppression(F.col("line_above")), "TPX003"))
    return similarity.clusters(loud).select(F.col("members")[0]["path"].alias("first"), F.size("members").alias("members"), F.col("weakest_score").alias("similarity"))


@_query(
    r"""WITH l AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '# !TPX001,TPX003' WHEN 1 THEN '  # !  TPX* because' WHEN 2 THEN '# !TPX002,,TPX77' WHEN 3 THEN '#!TPX001' WHEN 4 THEN '# !important: x'
  WHEN 5 THEN '# !tpx1' WHEN 6 THEN '# see TPX003 here' ELSE string_split(text, chr(10))[1] END AS line FROM documents),
t AS (SELECT *, list_filter(string_split(regexp_extract(line, '^\s*#\s+!\s*(\S+)', 1), ','), lambda x: x <> '') AS ts FROM l),
m AS (SELECT *, len(ts) > 0 AND (ts[1] = 'TPX*' OR regexp_full_match(ts[1], '(?i)TPX[0-9]+')) AS marker FROM t)
SELECT doc_id, marker AND list_contains(ts, 'TPX*') AS all, CASE WHEN marker THEN array_to_string(list_filter(ts, lambda x: x IN ('TPX001', 'TPX002', 'TPX003')), ',') ELSE '' END AS codes,
  CASE WHEN marker THEN array_to_string(list_filter(ts, lambda x: x NOT IN ('TPX001', 'TPX002', 'TPX003', 'TPX*')), ',') ELSE '' END AS unknown,
  NOT marker AND regexp_matches(line, '^\s*#') AND (coalesce(regexp_matches(ts[1], '(?i)^tp'), false) OR regexp_matches(line, '(?i)^\s*#.*TPX[0-9*]')) AS near_miss FROM m"""
)
def suppression_markers(spark, sf):
    line = F.expr(
        "CASE doc_id % 8 WHEN 0 THEN '# !TPX001,TPX003' WHEN 1 THEN '  # !  TPX* because' WHEN 2 THEN '# !TPX002,,TPX77' WHEN 3 THEN '#!TPX001' WHEN 4 THEN '# !important: x' "
        "WHEN 5 THEN '# !tpx1' WHEN 6 THEN '# see TPX003 here' ELSE split_part(text, chr(10), 1) END"
    )
    lines = _read(spark, sf, "documents").select("doc_id", line.alias("line"))
    s = markers.suppression(F.col("line"))
    return lines.select("doc_id", s["all"].alias("all"), F.array_join(s["codes"], ",").alias("codes"), F.array_join(s["unknown"], ",").alias("unknown"), markers.near_miss(F.col("line")).alias("near_miss"))


@_query()
def document_markers(spark, sf):
    """Every line of every document that is a suppression marker or nearly one."""
    lines = _read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    s = markers.suppression(F.col("line"))
    found = lines.select("doc_id", (F.col("at") + 1).alias("line"), s["all"].alias("all"), F.array_join(s["codes"], ",").alias("codes"), F.array_join(s["unknown"], ",").alias("unknown"), markers.near_miss(F.col("line")).alias("near_miss"))
    return found.where("all or codes <> '' or unknown <> '' or near_miss")


@_query()
def marked_clusters(spark, sf):
    """As `suppressed_clusters`, but what silences a document is a marker in its own first line."""
    blocks = _blocks(spark, sf)
    first = F.element_at(F.split("raw", "\n", 2), 1)
    loud = blocks.where(F.col("raw").isNotNull() & ~markers.silenced(markers.suppression(first), "TPX003"))
    return similarity.clusters(loud).select(F.col("members")[0]["path"].alias("first"), F.size("members").alias("members"), F.col("weakest_score").alias("similarity"))


_PAIRS = f"""k AS (SELECT *, CASE WHEN size_words = 0 THEN [] WHEN size_words < 3 THEN [normalized] ELSE {_GRAMS.format("ws")} END AS gs FROM (SELECT *, {_WORDS.format("normalized")} AS ws FROM b)),
ps AS (SELECT doc_id, unnest(gs) AS s FROM k), df AS (SELECT s, count(*) AS df FROM ps GROUP BY s),
lo AS (SELECT doc_id, s FROM ps JOIN df USING (s) WHERE df <= {stats.MAX_DF}),
cp AS (SELECT DISTINCT x.doc_id AS l, y.doc_id AS r FROM lo x JOIN lo y ON x.s = y.s AND x.doc_id < y.doc_id),
sp AS (SELECT l, r, len(list_intersect(a.gs, z.gs)) / (len(a.gs) + len(z.gs) - len(list_intersect(a.gs, z.gs))) AS score, least(a.size_lines, z.size_lines) AS lines, least(a.size_words, z.size_words) AS words
  FROM cp JOIN k a ON a.doc_id = l JOIN k z ON z.doc_id = r WHERE a.normalized <> z.normalized),
al AS (SELECT score, lines, words, 1 AS pairs FROM sp WHERE score >= 0.5 UNION ALL SELECT 1.0, size_lines, size_words, pairs FROM x)"""
_T = "(SELECT unnest([0.5, 0.6, 0.75, 0.9, 1.0]::DOUBLE[]) AS threshold)"


@_query(
    f"WITH {B}, {_EXACT}, {_PAIRS} SELECT min_lines, threshold, coalesce(sum(pairs), 0)::BIGINT AS pairs FROM (SELECT unnest([1, 2, 3, 4, 5]) AS min_lines), {_T} LEFT JOIN al ON score >= threshold AND lines >= min_lines GROUP BY ALL"
)
def threshold_grid(spark, sf):
    return stats.threshold_grid(_blocks(spark, sf))


@_query(
    f"WITH {B}, {_EXACT}, {_PAIRS} SELECT min_words, threshold, coalesce(sum(pairs), 0)::BIGINT AS pairs FROM (SELECT unnest([4, 6, 8, 10, 12, 16]) AS min_words), {_T} LEFT JOIN al ON score >= threshold AND words >= min_words GROUP BY ALL"
)
def word_cutoff_grid(spark, sf):
    return stats.word_cutoff_grid(_blocks(spark, sf))


@_query(
    f"WITH {B}, {_EXACT}, {_PAIRS} SELECT min_lines, min_words, threshold, coalesce(sum(pairs), 0)::BIGINT AS pairs FROM (VALUES {', '.join(map(str, stats.BOTH_CUTOFFS))}) v(min_lines, min_words), {_T} "
    "LEFT JOIN al ON score >= threshold AND words >= min_words AND lines >= min_lines GROUP BY ALL"
)
def conjunction_grid(spark, sf):
    return stats.conjunction_grid(_blocks(spark, sf))


@_query(f"WITH {B}, {_EXACT}, {_PAIRS} SELECT count(DISTINCT s) AS capped_shingles, count(DISTINCT doc_id) AS capped_blocks FROM ps JOIN df USING (s) WHERE df > {stats.MAX_DF}")
def capped_shingles(spark, sf):
    return stats.capped(_blocks(spark, sf))


@_query(f"WITH {B}, {_EXACT}, {_PAIRS} SELECT l, r, score FROM sp WHERE score >= 0.75 AND lines >= 2 AND words >= 8")
def inspect_pairs(spark, sf):
    return stats.scored_pairs(_kept(spark, stats.hashed(_blocks(spark, sf))), 0.75).where("score >= 0.75 and lines >= 2 and words >= 8").select("l", "r", "score")


@_query()
def inspect_findings(spark, sf):
    """All of what `inspect_pairs` lists the different texts of: equal texts too, and without the index's cap."""
    return stats.inspect_findings(_blocks(spark, sf))


@_query(
    f"""WITH {B}, v AS (SELECT kind, size_lines AS value, row_number() OVER (PARTITION BY kind ORDER BY size_lines) AS rn, count(*) OVER (PARTITION BY kind) AS n FROM b)
SELECT kind, percent, value::BIGINT AS value FROM v, (SELECT unnest([50, 90, 99]) AS percent) WHERE rn = greatest(1, ceil(percent / 100.0 * n))"""
)
def size_percentiles(spark, sf):
    return stats.nearest_rank(_blocks(spark, sf), "size_lines", (50, 90, 99), ["kind"])


_LINES = "ln AS (SELECT source, doc_id, sum(CASE WHEN trim(x) = '' THEN 1 ELSE 0 END)::BIGINT AS blank, sum(CASE WHEN regexp_matches(x, '[.!?]$') THEN 1 ELSE 0 END)::BIGINT AS prose, count(*) AS total FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) GROUP BY ALL)"


def _line_buckets(spark, sf):
    """Lines of each document: blank, prose (ended like a sentence), other."""
    lines = _read(spark, sf, "documents").select("source", "doc_id", F.split("text", "\n", -1).alias("x"))
    count = lambda p: F.size(F.filter("x", p)).cast("long")
    return lines.select("source", "doc_id", count(lambda x: F.trim(x) == "").alias("blank"), count(lambda x: x.rlike("[.!?]$")).alias("prose"), F.size("x").cast("long").alias("total"))


@_query(f"WITH {_LINES} SELECT source, sum(prose)::BIGINT AS prose, sum(blank)::BIGINT AS blank, sum(total - prose - blank)::BIGINT AS code, sum(total)::BIGINT AS total FROM ln GROUP BY source")
def line_buckets(spark, sf):
    return _line_buckets(spark, sf).groupBy("source").agg(F.sum("prose").alias("prose"), F.sum("blank").alias("blank"), F.sum(F.expr("total - prose - blank")).alias("code"), F.sum("total").alias("total"))


@_query(f"WITH {_LINES} SELECT source, coalesce(sum(prose) / nullif(sum(total), 0), 0) AS share, coalesce(sum(prose) / nullif(sum(total) - sum(blank), 0), 0) AS share_written FROM ln GROUP BY source")
def prose_share(spark, sf):
    b = _line_buckets(spark, sf).groupBy("source").agg(F.sum("prose").alias("p"), F.sum("total").alias("t"), F.sum("blank").alias("b"))
    return b.select("source", stats.share(F.col("p"), F.col("t")).alias("share"), stats.share(F.col("p"), F.col("t") - F.col("b")).alias("share_written"))


@_query(
    f"""WITH {_LINES}, s AS (SELECT source, round_even(prose / total * 1000, 0)::BIGINT AS v FROM ln), v AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY v) AS rn, count(*) OVER (PARTITION BY source) AS n FROM s)
SELECT source, percent, v AS value FROM v, (SELECT unnest([50, 90]) AS percent) WHERE rn = greatest(1, ceil(percent / 100.0 * n))"""
)
def share_quantiles(spark, sf):
    v = _line_buckets(spark, sf).select("source", stats.per_mille(F.col("prose") / F.col("total")).alias("v"))
    return stats.nearest_rank(v, "v", (50, 90), ["source"])


@_query(
    f"WITH {B} SELECT kind, 'lines_over' AS measure, c AS cutoff, count(*) FILTER (size_lines > c) AS blocks FROM b, (SELECT unnest([10, 20, 55]) AS c) GROUP BY ALL UNION ALL "
    "SELECT kind, 'words_under', c, count(*) FILTER (size_words < c) FROM b, (SELECT unnest([4, 6, 8, 10, 12, 16]) AS c) GROUP BY ALL"
)
def tail_counts(spark, sf):
    return stats.tails(_blocks(spark, sf))


@_query(f"WITH {B}, {_EXACT} SELECT copies, size_lines, path, left(normalized, 60) AS text FROM x ORDER BY copies DESC, size_lines DESC, path LIMIT 10")
def top_repeated(spark, sf):
    return stats.top_repeated(_blocks(spark, sf))


@_query(f"WITH {B} SELECT * FROM (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY size_lines DESC, path, line_start) AS rank, path, size_lines, size_words FROM b) WHERE rank <= 10")
def top_largest(spark, sf):
    return stats.top_largest(_blocks(spark, sf), "kind")


@_query("WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS t FROM documents) SELECT doc_id FROM n WHERE t <= 200 OR k IN (SELECT i * (t - 1) // 199 FROM range(200) r(i))")
def uniform_sample(spark, sf):
    return evaluate.uniform_sample(_read(spark, sf, "documents").select("doc_id"), "doc_id", 200)


@_query("SELECT * FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) WHERE turn <= 3 ORDER BY turn, source LIMIT 40")
def round_robin_sample(spark, sf):
    return evaluate.round_robin(_read(spark, sf, "documents").select("source", "doc_id"), "source", ["doc_id"], 3, 40)


@_query(f"WITH {B} SELECT sha256(normalized || chr(0) || path || chr(0) || '1') AS digest, path FROM b")
def blind_order(spark, sf):
    return _blocks(spark, sf).select(evaluate.blind_digest(F.col("normalized"), F.col("path"), F.col("line_start")).alias("digest"), "path").orderBy("digest")


@_query(f"WITH {B}, a AS (SELECT path FROM b WHERE size_words > 150), z AS (SELECT path FROM b WHERE length(normalized) > 900) (SELECT path FROM a EXCEPT ALL SELECT path FROM z) UNION ALL (SELECT path FROM z EXCEPT ALL SELECT path FROM a)")
def symmetric_difference(spark, sf):
    b = _blocks(spark, sf)
    return evaluate.symmetric_difference(b.where("size_words > 150").select("path"), b.where("length(normalized) > 900").select("path"))


@_query(f"WITH {B} SELECT path FROM b WHERE size_words > 150 INTERSECT SELECT path FROM b WHERE length(normalized) > 900")
def fires_and_agrees(spark, sf):
    b = _blocks(spark, sf)
    return b.where("size_words > 150").select("path").intersect(b.where("length(normalized) > 900").select("path"))


@_query(
    f"""WITH {B}, t AS (SELECT DISTINCT kind, size_words AS threshold FROM b UNION SELECT kind, min(size_words) - 1 FROM b GROUP BY kind),
f AS (SELECT t.kind, threshold, (SELECT count(*) FROM b WHERE b.kind = t.kind AND size_words > threshold) AS fired FROM t)
SELECT kind, threshold, fired FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs(fired - 40), fired, threshold DESC) AS rn FROM f WHERE abs(fired - 40) <= 1) WHERE rn = 1"""
)
def calibrated_threshold(spark, sf):
    return evaluate.calibrated_thresholds(_blocks(spark, sf), "size_words", "kind", 40)


_UNITS = "un AS (SELECT doc_id, 'words' AS unit FROM b WHERE size_words > 150 UNION ALL SELECT doc_id, 'chars' FROM b WHERE length(normalized) > 900)"


@_query(f"WITH {B}, {_UNITS} SELECT unit, count(*) AS proposed, count(*) FILTER (quality = 1) AS true FROM un JOIN labels USING (doc_id) GROUP BY unit")
def precision_by_unit(spark, sf):
    labels = _kept(spark, _read(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("yes")))
    # texts are normalised once, and only those that have a verdict
    docs = _read(spark, sf, "documents").join(labels.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    size = _kept(spark, adapters.blocks_from_text(docs).select(F.col("doc_id").alias("id"), F.col("size_words").alias("words"), F.length("normalized").alias("chars")))
    units = F.array_compact(F.array(F.when(F.col("words") > 150, "words"), F.when(F.col("chars") > 900, "chars")))
    fired = size.select(F.explode(units).alias("unit"), "id")
    return evaluate.precision_by_unit(fired, labels.join(fired, "id", "left_semi"))


_Z = evaluate.Z


@_query(
    f"""WITH s AS (SELECT lang, count(*) FILTER (quality = 0) AS k, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, round(k / n, 12) AS rate, round(greatest((k / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) - {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n), 0), 12) AS low,
  round(least((k / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) + {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n), 1), 12) AS high FROM s"""
)
def wilson_by_population(spark, sf):
    s = _read(spark, sf, "labels").join(_read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") == 0).alias("k"), F.count("*").alias("n"))
    rate, low, high = evaluate.wilson(F.col("k"), F.col("n"))
    return s.select("lang", F.round(rate, 12).alias("rate"), F.round(low, 12).alias("low"), F.round(high, 12).alias("high"))


@_query("SELECT lang, CASE WHEN count(*) FILTER (quality = 0) / count(*) <= 0.15 THEN 'PASS' ELSE 'RED' END AS verdict FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def gate_by_population(spark, sf):
    s = _read(spark, sf, "labels").join(_read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") == 0).alias("k"), F.count("*").alias("n"))
    return s.select("lang", evaluate.gate(F.col("k") / F.col("n"), 0.15).alias("verdict"))


@_query("SELECT doc_id, 'not recorded' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'not drawn' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def label_coverage(spark, sf):
    return evaluate.coverage(_read(spark, sf, "documents").select("doc_id"), _read(spark, sf, "labels").select("doc_id"), "doc_id")


@_query("SELECT lang FROM (SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS p FROM documents GROUP BY lang) WHERE n <> p")
def unexpected_runs(spark, sf):
    docs = _read(spark, sf, "documents")
    found, pinned = docs.groupBy("lang").agg(F.count("*").alias("n")), docs.groupBy("lang").agg(F.count_if(F.col("n_chars") > 1000).alias("n"))
    return evaluate.unexpected(found, pinned, "lang").select("lang")


@_query("SELECT a.conv_id, a.turn, (SELECT min(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'assistant' AND b.turn > a.turn) AS next_turn FROM conversations a WHERE a.role = 'user' AND EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'assistant' AND b.turn > a.turn)")
def next_line_lookup(spark, sf):
    """The first assistant turn behind each user turn, as the next code line behind a comment is found."""
    c = _read(spark, sf, "conversations")
    return evaluate.first_after(c.where("role = 'user'").select("conv_id", "turn"), c.where("role = 'assistant'"), "conv_id", "turn", "next_turn").where("next_turn is not null")


@_query("WITH r AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations WHERE role <> 'system') SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n FROM r GROUP BY conv_id, g")
def comment_runs(spark, sf):
    return stats.islands(_read(spark, sf, "conversations").where("role <> 'system'").select("conv_id", "turn"), "conv_id", "turn")


_PATH = "CASE doc_id % 7 WHEN 0 THEN 'src/' WHEN 1 THEN 'Vendor/x/' WHEN 2 THEN 'pkg.egg-info/' WHEN 3 THEN 'a/.venv/lib/' ELSE '' END || source || CASE WHEN doc_id % 11 = 0 THEN '_pb2.py' ELSE '.py' END"


@_query(
    f"""WITH p AS (SELECT doc_id, {_PATH} AS path FROM documents), s AS (SELECT *, string_split(lower(path), '/') AS parts FROM p)
SELECT doc_id, path FROM s WHERE NOT regexp_matches(path, '_pb2.py$') AND len(list_filter(parts[1:len(parts) - 1], lambda x: x IN ({', '.join(repr(d) for d in sorted(stats.SKIPPED_DIRS))}) OR suffix(x, '.egg-info'))) = 0"""
)
def corpus_files(spark, sf):
    paths = _read(spark, sf, "documents").select("doc_id", F.expr(_PATH).alias("path"))
    return paths.where(stats.in_first_party(F.col("path")))


_GEN = "CASE doc_id % 5 WHEN 0 THEN '# Generated by tool' WHEN 1 THEN 'IDs are generated by it' WHEN 2 THEN '\"\"\"Autogenerated file' WHEN 3 THEN 'x' ELSE '## please DO NOT EDIT' END || chr(10) || text"


@_query("SELECT doc_id, doc_id % 5 IN (0, 2, 4) AS generated FROM documents")
def generated_filter(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", stats.looks_generated(F.expr(_GEN)).alias("generated"))


@_query(
    "SELECT identity, path FROM (SELECT md5(text) AS identity, source || '/' || doc_id AS path, row_number() OVER (PARTITION BY text ORDER BY doc_id % 3 = 0 DESC, doc_id) AS rn FROM documents) WHERE rn = 1"
)
def merged_roots(spark, sf):
    """One spelling of each file: named ones before found ones, then the order of arguments."""
    files = _read(spark, sf, "documents").select(F.md5("text").alias("identity"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") % 3 == 0).alias("named"), "doc_id")
    order = Window.partitionBy("identity").orderBy(F.desc("named"), "doc_id")
    return files.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("identity", "path")


@_query(f"WITH {B} SELECT path, size_words AS words, length(normalized) AS chars FROM b")
def unit_counters(spark, sf):
    return _blocks(spark, sf).select("path", F.col("size_words").alias("words"), F.length("normalized").alias("chars"))


_STEM = "CASE " + " ".join(f"WHEN length(w) > {len(e) + 2} AND suffix(w, '{e}') THEN left(w, length(w) - {len(e)})" for e in ("ing", "ies", "ed", "es", "s")) + " ELSE w END"


@_query(f"WITH {B}, t AS (SELECT unnest({_WORDS.format('normalized')}) AS w FROM b) SELECT {_STEM} AS stem, count(*) AS n FROM t GROUP BY 1")
def stems(spark, sf):
    return _blocks(spark, sf).select(F.explode(text.words(F.col("normalized"))).alias("w")).groupBy(text.stem(F.col("w")).alias("stem")).agg(F.count("*").alias("n"))


@_query(f"WITH {B} SELECT {_AT} AS address FROM b JOIN labels USING (doc_id) WHERE quality = 0")
def baseline_addresses(spark, sf):
    bad = _blocks(spark, sf).join(_read(spark, sf, "labels").where("quality = 0"), "doc_id")
    return bad.select(text.address(F.col("path"), F.col("line_start"), F.col("line_end")).alias("address")).orderBy("address")


@_query(
    r"""WITH s AS (SELECT doc_id, source, text FROM documents WHERE NOT regexp_matches(text, '(^|\n)(\s*#|\s*noqa|\s*type:|!)', 'i'))
SELECT source || '/doc_' || doc_id || '.py' AS path, 'comment' AS kind, 1 AS line_start, (1 + length(text) - length(replace(text, chr(10), '')))::INTEGER AS line_end,
  trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS normalized FROM s"""
)
def extract_blocks(spark, sf):
    """The extractor over documents rendered as Python files; a null text is no file. The SQL knows no comments for tools."""
    docs = _read(spark, sf, "documents").where("text is not null")
    blocks, _ = extract.read_sources(adapters.rendered_sources(docs))
    return blocks.select("path", "kind", "line_start", "line_end", "normalized")


@_query()
def restatement(spark, sf):
    """Comments that restate the next code line, over documents rendered as Python files."""
    return restated.find(adapters.rendered_sources(_read(spark, sf, "documents")))


@_query()
def restatement_rate(spark, sf):
    return restated.rate(adapters.rendered_sources(_read(spark, sf, "documents")))


@_query("SELECT * FROM (VALUES ('TPX001', 'comment over the word limit'), ('TPX002', 'docstring over the word limit'), ('TPX003', 'same explanation in several places')) v(code, title)")
def rules(spark, sf):
    return spark.createDataFrame([("TPX001", "comment over the word limit"), ("TPX002", "docstring over the word limit"), ("TPX003", "same explanation in several places")], "code string, title string")


def _alike(x: pd.Series, y: pd.Series) -> pd.Series:
    """Whether difflib's ratio is 0.75 or more; its two quick upper bounds save most of the ratios."""

    def alike(p: str, q: str) -> bool:
        m = difflib.SequenceMatcher(None, p, q)
        return m.real_quick_ratio() >= 0.75 and m.quick_ratio() >= 0.75 and m.ratio() >= 0.75

    return pd.Series([alike(p, q) for p, q in zip(x, y)], dtype=bool)


@_query()
def difflib_agreement(spark, sf):
    """How often two similarities agree at 0.75, over a uniform sample of candidate pairs."""
    sample = _kept(spark, stats.sampled_pairs(_kept(spark, stats.hashed(_blocks(spark, sf))), 2000))
    ends = F.broadcast(sample.select(F.col("l").alias("doc_id")).union(sample.select("r")).distinct())
    blocks = _kept(spark, adapters.blocks_from_text(_read(spark, sf, "documents").join(ends, "doc_id", "left_semi")).select("doc_id", "normalized"))
    a, b = blocks.toDF("l", "ta"), blocks.toDF("r", "tb")

    alike = F.pandas_udf(_alike, "boolean")
    both = adapters.spread(sample.join(a, "l").join(b, "r")).select((F.col("score") >= 0.75).alias("j"), alike("ta", "tb").alias("d"))
    return both.agg(
        F.count_if(F.col("j") & F.col("d")).alias("both"), F.count_if(F.col("j") & ~F.col("d")).alias("jaccard_only"), F.count_if(~F.col("j") & F.col("d")).alias("difflib_only")
    )
