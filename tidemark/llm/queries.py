"""The queries ``opN_<name>``: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, fingerprint, langid, linededup, ngram_join, packing, pii, quality, quotes, urlfilter
from tidemark.llm.storage import materialize

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's messages quote nothing; two of three are made to."""
    made = materialize(quotes.quoting(_table(spark, sf_dir, "conversations")), "quoting")
    return quotes.thread_conversations(made)


def op2_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return langid.identify(documents, langid.fit_profiles(documents))


def op3_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op4_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return pii.find_personal_data(documents, pii.train_on(documents))


def op5_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op6_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op7_segment_edit_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines removed, and length and digest of the text left."""
    left = linededup.dedupe_lines(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_equal", "n_near", F.length("text").cast("bigint").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


#: The rules of the URL query.
URL_RULES = [
    urlfilter.Rule("com", "/", "allow"),
    urlfilter.Rule("example.com", "/en/", "block"),
    urlfilter.Rule("www.example.com", "/en/", "allow"),
    urlfilter.Rule("net", "/es/", "block"),
    urlfilter.Rule("net", "/fr/", "block"),
]


#: Share of symbols in a page's visible text from which on it counts as junk.
JUNK_SYMBOLS = 0.02


def junk_page(html: Column) -> Column:
    """Whether the visible text of a page is full of symbols; null without one."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    return F.regexp_count(text, F.lit("[#*$%&|<>]")) > JUNK_SYMBOLS * F.length(text)


def op8_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that led to junk pages are labelled block, others allow; the model
    sees the URL alone."""
    pages = _table(spark, sf_dir, "pages")
    labelled = pages.select("url", junk_page(F.col("html")).alias("blocked"))
    return urlfilter.judge(pages, URL_RULES, urlfilter.fit(labelled))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op10_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_neighbours(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quotation_linking, op2_rank_order_language, op3_minimum_slack_packing, op4_bilstm_crf_pii, op5_prefix_tree_join, op6_robust_quality, op7_segment_edit_line_dedup, op8_boosted_url_filter, op9_byte_bpe, op10_one_permutation_minhash)}


_THREADS_SQL = r"""
WITH told AS (SELECT row_number() OVER () AS id, CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations),
said AS (SELECT conv_id, turn, min(text) AS said FROM told GROUP BY ALL),
m AS (SELECT t.id, t.conv_id, t.turn, t.role, CASE WHEN ((t.conv_id + t.turn) % 3 + 3) % 3 > 0 AND a.said IS NOT NULL AND t.text IS NOT NULL THEN
  CASE WHEN ((t.conv_id + t.turn) % 3 + 3) % 3 = 2 AND b.said IS NOT NULL THEN '> > ' || replace(b.said, chr(10), chr(10) || '> > ') || chr(10) ELSE '' END ||
  '> ' || replace(a.said, chr(10), chr(10) || '> ') || chr(10) || chr(10) || t.text ELSE t.text END AS text
  FROM told t LEFT JOIN said a ON t.conv_id = a.conv_id AND t.turn = a.turn + 1 LEFT JOIN said b ON t.conv_id = b.conv_id AND t.turn = b.turn + 2),
lines AS (SELECT id, conv_id, turn, n, list_extract(string_split(text, chr(10)), n) AS line
  FROM m, LATERAL (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS n)),
parsed AS (SELECT *, regexp_extract(line, '^(?:[ \t]*>)+') AS marks FROM lines),
bodies AS (SELECT id, conv_id, turn, n, line, marks, length(marks) - length(replace(marks, '>', '')) AS level,
  trim(regexp_replace(lower(substr(line, length(marks) + 1)), '\s+', ' ', 'g')) AS body FROM parsed),
breaks AS (SELECT *, CASE WHEN body <> '' AND level = lag(level) OVER w AND lag(body) OVER w <> '' THEN 0 ELSE 1 END AS fresh FROM bodies WINDOW w AS (PARTITION BY id ORDER BY n)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS island FROM breaks),
passages AS (SELECT id, conv_id, turn, level, string_agg(body, ' ' ORDER BY n) AS passage FROM islands WHERE body <> '' GROUP BY id, conv_id, turn, level, island),
own AS (SELECT conv_id, passage, min(turn) AS turn FROM passages WHERE level = 0 AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
firsts AS (SELECT passage, min((conv_id, turn)) AS first FROM own GROUP BY passage),
anywhere AS (SELECT f.passage, f.first, min((o.conv_id, o.turn)) FILTER (o.conv_id <> f.first[1]) AS second FROM firsts f JOIN own o ON f.passage = o.passage GROUP BY f.passage, f.first),
quotes AS (SELECT DISTINCT id, conv_id, turn, level, passage FROM passages WHERE level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL),
links AS (SELECT q.id, q.level, CASE WHEN o.turn < q.turn THEN q.conv_id WHEN a.first[1] <> q.conv_id THEN a.first[1] ELSE a.second[1] END AS origin_conv,
  CASE WHEN o.turn < q.turn THEN o.turn WHEN a.first[1] <> q.conv_id THEN a.first[2] ELSE a.second[2] END AS origin_turn, q.conv_id AS asked
  FROM quotes q LEFT JOIN own o ON q.conv_id = o.conv_id AND q.passage = o.passage LEFT JOIN anywhere a ON q.passage = a.passage),
found AS (SELECT id, count(*) AS n_quotes, count(origin_turn) AS n_linked,
  min(CASE WHEN origin_conv = asked THEN (level, -origin_turn) END) AS here, min(CASE WHEN origin_conv <> asked THEN (level, origin_conv, origin_turn) END) AS there FROM links GROUP BY id),
turns AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM (SELECT DISTINCT conv_id, turn FROM m)),
clean AS (SELECT id, CASE WHEN count(*) FILTER (marks <> '') = 0 AND NOT bool_or(contains(line, '>')) THEN string_agg(line, chr(10) ORDER BY n)
  ELSE regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (marks = ''), ''), '^(?:[ \t\r]*\n)+|\s+$', '', 'g') END AS text FROM bodies GROUP BY id),
joined AS (SELECT m.id, m.conv_id, m.turn, m.role, c.text, CASE WHEN c.text <> m.text THEN m.text END AS quoting, CASE WHEN m.conv_id IS NULL OR m.turn IS NULL THEN NULL ELSE coalesce(-f.here[2], t.previous) END AS parent_turn,
  CASE WHEN f.here IS NULL THEN f.there[2] END AS origin_conv, CASE WHEN f.here IS NULL THEN f.there[3] END AS origin_turn,
  coalesce(f.n_quotes, 0) AS n_quotes, coalesce(f.n_linked, 0) AS n_linked
  FROM m LEFT JOIN found f ON m.id = f.id LEFT JOIN turns t ON m.conv_id = t.conv_id AND m.turn = t.turn LEFT JOIN clean c ON m.id = c.id)
SELECT conv_id, turn, role, text, parent_turn, origin_conv, origin_turn, n_quotes, n_linked,
  CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN rank() OVER (PARTITION BY conv_id ORDER BY parent_turn NULLS FIRST, turn, role NULLS FIRST, text NULLS FIRST, quoting NULLS FIRST) END AS position FROM joined
"""


_JOIN_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i+2], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
edges AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS root FROM sets UNION SELECT e.y, r.root FROM reach r JOIN edges e ON r.doc_id = e.x)
SELECT doc_id, any_value(len(s)) AS n_shingles, min(root) AS component_id FROM sets JOIN reach USING (doc_id) GROUP BY doc_id
"""

def _prefix(x: str, y: str) -> str:
    """SQL: how many first elements of two lists agree."""
    same = f"list_transform(generate_series(1, least(len({x}), len({y}))), lambda i: {x}[i] = {y}[i])"
    return f"coalesce(nullif(list_position({same}, false), 0) - 1, least(len({x}), len({y})))"


def _one_edit(x: str, y: str) -> str:
    """SQL: whether two lists are within one edit."""
    return f"(abs(len({x}) - len({y})) <= 1 AND {_prefix(x, y)} + {_prefix(f'list_reverse({x})', f'list_reverse({y})')} >= greatest(len({x}), len({y})) - 1)"


#: Lines near an earlier one: of two lists without their common beginning, the
#: first edit changes, removes or adds the first element, one more may follow.
_LINES_SQL = rf"""
WITH lines AS (SELECT doc_id, n, list_extract(string_split(text, chr(10)), n) AS line
  FROM documents, LATERAL (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS n)),
normal AS (SELECT *, lower(trim(line)) AS body FROM lines),
firsts AS (SELECT body, min((doc_id, n)) AS place, string_split(body, ' ') AS w, length(body) AS size
  FROM normal WHERE regexp_matches(body, '[^ \t\n\x0B\f\r]') GROUP BY body),
pairs AS (SELECT a.body, CASE WHEN least(len(a.w), len(b.w)) >= 16 THEN 2 ELSE 1 END AS edits, a.w AS x, b.w AS y
  FROM firsts a JOIN firsts b ON len(b.w) BETWEEN len(a.w) - 2 AND len(a.w) + 2 AND b.place < a.place WHERE least(len(a.w), len(b.w)) >= 8
  UNION ALL SELECT a.body, 2, list_transform(generate_series(1, a.size), lambda i: substr(a.body, i, 1)), list_transform(generate_series(1, b.size), lambda i: substr(b.body, i, 1))
  FROM firsts a JOIN firsts b ON b.size BETWEEN a.size - 2 AND a.size + 2 AND b.place < a.place WHERE greatest(len(a.w), len(b.w)) <= 18 AND least(a.size, b.size) >= 9),
likely AS (SELECT * FROM pairs WHERE abs(len(x) - len(y)) <= edits AND len(list_intersect(x, y)) >= greatest(len(list_distinct(x)), len(list_distinct(y))) - edits),
cut AS (SELECT body, edits, x[p + 1:] AS x, y[p + 1:] AS y FROM (SELECT *, {_prefix("x", "y")} AS p FROM likely)),
near AS (SELECT DISTINCT body FROM cut WHERE CASE WHEN edits = 1 THEN {_one_edit("x", "y")} ELSE {_one_edit("x", "y")}
  OR {_one_edit("x[2:]", "y[2:]")} OR {_one_edit("x[2:]", "y")} OR {_one_edit("x", "y[2:]")} END),
judged AS (SELECT l.*, r.body IS NOT NULL AS near, f.body IS NOT NULL AND r.body IS NULL AND f.place <> (l.doc_id, l.n) AS equal
  FROM normal l LEFT JOIN firsts f ON l.body = f.body LEFT JOIN near r ON l.body = r.body),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (equal) AS n_equal, count(*) FILTER (near) AS n_near,
  coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT near AND NOT equal), '') AS text FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_equal, 0) AS n_equal, coalesce(n_near, 0) AS n_near,
  length(k.text) AS kept_chars, sha256(k.text) AS kept_sha256 FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express.

    The others rest on models, tokens or packings that DuckDB cannot compute;
    their tests hold them against brute force, exact round trips or held-out
    accuracy.
    """
    return {"op1_quotation_linking": _THREADS_SQL, "op5_prefix_tree_join": _JOIN_SQL, "op7_segment_edit_line_dedup": _LINES_SQL}
