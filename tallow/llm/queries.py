"""The registered queries of this subpackage: thin digests of each operator's real output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.llm.conversation_repair import damage, repair
from tallow.llm.decontaminate import decontaminate
from tallow.llm.divergence import audit
from tallow.llm.html_crf import extract
from tallow.llm.jaccard_join import jaccard_components
from tallow.llm.packing import pack
from tallow.llm.pii import pseudonymise
from tallow.llm.pitman_yor import score as score_texts
from tallow.llm.quality_classifier import score
from tallow.llm.quality_rules import apply_rules
from tallow.llm.token_counts import prefix_counts, tokens_of
from tallow.llm.url_filter import judge_urls
from tallow.llm.warc import read_archives, write_archives


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, _read(spark, sf_dir, "benchmark"), window=13, max_percent=5)
    ids = F.size("item_ids").cast("long")
    return found.select(
        "doc_id", "n_words", "n_hit", ids.alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(_read(spark, sf_dir, "pages"))
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = apply_rules(docs, _read(spark, sf_dir, "labels"), keep_text=False)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), cutoff=0.3)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key="tallow").select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = prefix_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    n = tokens_of(F.col("prefix_tokens"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return found.select("doc_id", size.alias("n_bytes"), n.alias("n_tokens"), (n > 1024).alias("over_limit"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_texts(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    return repair(damage(rows), rows).audits


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_read(spark, sf_dir, "documents").select("text", "lang", "source"), min_docs=10, top=10)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc": op2_warc,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_pii": op5_pii,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_packing": op7_packing,
    "op8_url_filter": op8_url_filter,
    "op9_token_counts": op9_token_counts,
    "op10_html_extraction": op10_html_extraction,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_source_divergence": op13_source_divergence,
}

#: DuckDB equivalents, where SQL can express the query at this size.
ORACLES: dict[str, str] = {
    "op1_decontaminate": r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT id, least(13, len(w)) AS l, list_aggregate(w[i : i + least(13, len(w)) - 1], 'string_agg', ' ') AS k
  FROM (SELECT id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM win),
pos AS (
  SELECT r, i, l, list_aggregate(w[i : i + l - 1], 'string_agg', ' ') AS k
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, lens WHERE len(w) >= l)),
hits AS (SELECT DISTINCT p.r, p.i, p.l, x.id FROM pos p JOIN win x ON p.l = x.l AND p.k = x.k),
cover AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS j FROM (SELECT DISTINCT r, i, l FROM hits)) GROUP BY r),
met AS (SELECT r, count(DISTINCT id) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cover USING (r) LEFT JOIN met USING (r)
""",
    "op2_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h, min(page_id) OVER (PARTITION BY sha256(b)) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND f <> page_id THEN f END AS refers_to
FROM d
""",
    "op12_conversation_repair": r"""
WITH RECURSIVE
tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT src.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))),
                                      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS f FROM src, tab),
harm AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy FROM crc WHERE f <> 0),
put AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM harm),
seen AS (SELECT *, substr(role, 1, 1) AS o, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again,
                substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) AS b FROM put),
msg AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN again > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
               b IS NOT NULL AND b || o NOT IN ('su', 'ua', 'au') AS illegal FROM seen),
edit(st, edits, goes, cost, o, before, role) AS (VALUES
  (0, 'D', 0, 4, NULL, NULL, NULL), (1, 'D', 1, 4, NULL, NULL, NULL), (2, 'D', 2, 4, NULL, NULL, NULL), (3, 'D', 3, 4, NULL, NULL, NULL),
  (0, 'K', 1, 0, 's', '', NULL), (0, 'K', 2, 0, 'u', '', NULL), (0, 'R', 2, 3, NULL, '', 'user'),
  (0, 'IK', 3, 3, 'a', E'user:\n', NULL), (0, 'IR', 3, 6, NULL, E'user:\n', 'assistant'),
  (0, 'IIK', 2, 6, 'u', E'user:\nassistant:\n', NULL), (0, 'IIR', 2, 9, NULL, E'user:\nassistant:\n', 'user'),
  (1, 'K', 2, 0, 'u', '', NULL), (1, 'R', 2, 3, NULL, '', 'user'),
  (1, 'IK', 3, 3, 'a', E'user:\n', NULL), (1, 'IR', 3, 6, NULL, E'user:\n', 'assistant'),
  (1, 'IIK', 2, 6, 'u', E'user:\nassistant:\n', NULL), (1, 'IIR', 2, 9, NULL, E'user:\nassistant:\n', 'user'),
  (2, 'K', 3, 0, 'a', '', NULL), (2, 'R', 3, 3, NULL, '', 'assistant'),
  (2, 'IK', 2, 3, 'u', E'assistant:\n', NULL), (2, 'IR', 2, 6, NULL, E'assistant:\n', 'user'),
  (3, 'K', 2, 0, 'u', '', NULL), (3, 'R', 2, 3, NULL, '', 'user'),
  (3, 'IK', 3, 3, 'a', E'user:\n', NULL), (3, 'IR', 3, 6, NULL, E'user:\n', 'assistant')),
dp(conv_id, i, st, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {'cost': CAST(0 AS BIGINT), 'audit': '', 'out': ''} FROM conversations
  UNION ALL
  SELECT dp.conv_id, dp.i + 1, e.goes,
         min({'cost': best.cost + e.cost + CASE WHEN e.edits <> 'D' AND m.fault = 3 THEN 3 ELSE 0 END, 'audit': best.audit || e.edits,
              'out': best.out || CASE WHEN e.edits = 'D' THEN '' ELSE e.before || coalesce(e.role, m.role) || ':' || m.text || E'\n' END})
  FROM dp JOIN msg m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.i = dp.i + 1
  JOIN edit e ON e.st = dp.st AND (e.o IS NULL OR e.o = m.o) AND (e.edits = 'D' OR m.fault NOT IN (1, 2))
  GROUP BY dp.conv_id, dp.i + 1, e.goes),
size AS (SELECT c.conv_id, count(m.i) AS n, coalesce(max(m.turn) - min(m.turn) + 1 - count(DISTINCT m.turn), 0) AS gaps,
                count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal
         FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN msg m ON m.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
done AS (SELECT size.*, (SELECT min({'cost': best.cost + CASE st WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'audit': best.audit || CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
                                     'out': best.out || CASE st WHEN 1 THEN E'user:\nassistant:\n' WHEN 2 THEN E'assistant:\n' ELSE '' END})
                         FROM dp WHERE dp.conv_id IS NOT DISTINCT FROM size.conv_id AND dp.i = size.n) AS best FROM size)
SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, best.cost AS cost, best.audit AS audit,
       sha256(CASE WHEN best.out = '' THEN '' ELSE substr(best.out, 1, length(best.out) - 1) END) AS repaired_sha256
FROM done
""",
    "op13_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
size AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY lang, source),
cell AS (
  SELECT lang, g.source, k.term, coalesce(n.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 2)) // (coalesce(total, 0) + 2 * v) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN size USING (lang) LEFT JOIN n USING (lang, source, term) LEFT JOIN total USING (lang, source)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source AS s, b.source AS o, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
             FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.s = a.source AND x.o = b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM cell WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term) WHERE rank <= 10)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
""",
}
