"""Queries opN_<name>, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, caps, chat, licenses, minhash, packing, pages, pii, quality, warc
from .stage import written

#: Links of op1: three-word shingles, 85 percent.
OP1 = minhash.NearDuplicates(shingle_words=3, percent=85)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), OP1)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rendered = written(chat.formatted(turns.unionByName(more)), "chat")
    return chat.read_back(rendered, written(chat.examples(rendered), "examples"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"), spark)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.cap_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolved(warc.read_records(warc.write_archives(_table(spark, sf_dir, "pages"))))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.selectExpr("row.doc_id AS doc_id", *(f"m.{m} AS {m}" for m in measures), "failed AS base_failed", "kept", "bad_host")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encoded(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_chat_formatting, op3_pii, op4_license_scan, op5_embedding_near_dedup,
        op6_warc, op7_quality_rules, op8_packing, op9_byte_bpe, op10_html_extraction,
    )
}

_CONTROL = r"(\\|<\||\|>|</?s>|\[/?INST\]|<</?SYS>>)"
_OP2 = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), made AS (
  SELECT *, 18 + length(regexp_replace(role, '{_CONTROL}', '\\\1', 'g')) + length(regexp_replace(text, '{_CONTROL}', '\\\1', 'g')) AS chars FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM made GROUP BY conv_id
"""

_OP4_TEMPLATES = ", ".join("({!r}, '{}')".format(k, v.replace("'", "''")) for k, v in sorted(licenses.TEMPLATES.items()))
_OP4 = rf"""
WITH templates(license, text) AS (VALUES {_OP4_TEMPLATES}),
texts AS (
  SELECT NULL AS doc_id, license, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM templates
  UNION ALL SELECT doc_id, NULL, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM documents
),
placed AS (SELECT doc_id, license, w, unnest(range(0, len(w) - {licenses.WORDS - 1})) AS i FROM texts WHERE len(w) >= {licenses.WORDS}),
shingles AS (SELECT doc_id, license, i, array_to_string(w[i + 1 : i + {licenses.WORDS}], ' ') AS s FROM placed),
known AS (SELECT license, s, count(*) OVER (PARTITION BY license) AS m FROM (SELECT DISTINCT license, s FROM shingles WHERE license IS NOT NULL)),
sized AS (SELECT license, s, m, CAST(pow(2, ceil(log2(m))) AS BIGINT) AS width FROM known),
hits AS (SELECT d.doc_id, k.license, k.m, d.s, d.i // k.width AS win FROM shingles d JOIN sized k ON d.s = k.s WHERE d.license IS NULL),
windows AS (
  SELECT doc_id, license, m, s, win FROM hits
  UNION ALL SELECT doc_id, license, m, s, win - 1 FROM hits WHERE win > 0
),
best AS (SELECT doc_id, license, m, win, count(DISTINCT s) AS n FROM windows GROUP BY ALL)
SELECT doc_id, license, max(n) AS n_shared, max(m) AS n_template FROM best WHERE 100 * n >= {licenses.PERCENT} * m GROUP BY doc_id, license
"""

_OP5 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(id, via) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.via = l.a
), comp AS (SELECT id, min(via) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, id = component_id AS kept FROM comp LEFT JOIN n ON id = a
"""

_LETTERS = "||".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {s}) & 31), 1)" for g in range(8) for s in (15, 10, 5, 0))
_OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

_R = quality.Rules()
_OP7 = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
placed AS (SELECT r, words, unnest(range(0, len(words) - 4)) AS i FROM w WHERE len(words) >= 5),
grams AS (SELECT r, i, array_to_string(words[i + 1 : i + 5], ' ') AS g FROM placed),
twins AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twins, range(0, 5) o(j) GROUP BY r),
m AS (
  SELECT w.r, doc_id, host, len(words) AS n_words, strlen('') + length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)
),
f AS (SELECT *, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed FROM m),
hosts AS (SELECT host, sum(CAST(base_failed AS BIGINT)) AS bad, count(*) AS n FROM f GROUP BY host),
prior AS (SELECT avg(bad / n) AS mean, var_pop(bad / n) AS var FROM hosts),
shares AS (
  SELECT host, var > 0 AND (bad + mean * weight) / (n + weight) > mean + {_R.bad_deviations} * sqrt(var) AS bad_host
  FROM hosts, (SELECT mean, var, CASE WHEN var > 0 AND mean * (1 - mean) > var THEN mean * (1 - mean) / var - 1 ELSE 1 END AS weight FROM prior)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  bad_host, NOT base_failed AND NOT (bad_host AND (100 * n_symbols > {_R.max_symbol_percent} * word_chars OR 100 * n_dup_lines > {_R.max_dup_line_percent} * n_lines)) AS kept
FROM f JOIN shares USING (host)
"""

ORACLES: dict[str, str] = {
    "op2_chat_formatting": _OP2,
    "op4_license_scan": _OP4,
    "op5_embedding_near_dedup": _OP5,
    "op6_warc": _OP6,
    "op7_quality_rules": _OP7,
}
