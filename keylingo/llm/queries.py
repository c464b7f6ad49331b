"""The thin queries ``opN_<name>``, and SQL for those that SQL can express.

Each reads its whole table. Paths of public vocabularies are parameters of the
operators; the queries name the installed files.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, byte_bpe, curriculum_mix, exact_dedup, hmm, license_scan, resample, secrets, simhash, token_files, toxicity, warc
from .common import table

BYTE_BPE, WORD_BPE, WORD_BPE_END = "byte_bpe_50k.tiktoken", "word_bpe_49k.json", 2
BYTE_BPE_JSON, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), WORD_BPE_END)


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.round_trip(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE_JSON), public_tokenizers.path(PIECE_BPE))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hmm_scores": op1_hmm_scores,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_token_files": op3_token_files,
        "op4_curriculum_mix": op4_curriculum_mix,
        "op5_toxicity": op5_toxicity,
        "op6_warc": op6_warc,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_secret_scan": op8_secret_scan,
        "op9_nearest_neighbours": op9_nearest_neighbours,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_tokenizer_alignment": op11_tokenizer_alignment,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_license_scan": op13_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_exact_dedup": EXACT_DEDUP,
        "op12_importance_resampling": IMPORTANCE_RESAMPLING,
        "op13_license_scan": LICENSE_SCAN.replace("{templates}", _template_rows()),
    }


def _template_rows() -> str:
    """(template, label, base, place, word, key) for each word of each template as a list of SQL values."""
    rows = []
    for number, template in enumerate(license_scan.BASE + license_scan.TEMPLATES):
        words, keys = license_scan.words_and_keys(template)
        rows += [f"({number}, '{template.label}', {template.base}, {place}, '{word}', {place in keys})" for place, word in enumerate(words)]
    return ",\n    ".join(rows)


EXACT_DEDUP = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER same AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER same = 1 AS kept,
       sha256(norm) AS text_sha256
FROM plain
WINDOW same AS (PARTITION BY norm ORDER BY n_points DESC, doc_id NULLS LAST)
"""

# CRC32 by its table of 256 steps, once for each different word
IMPORTANCE_RESAMPLING = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS steps
),
doc_words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM documents
),
target_words AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
),
doc_counts AS MATERIALIZED (SELECT doc_id, word, count(*) AS n FROM doc_words GROUP BY ALL),
target_counts AS MATERIALIZED (SELECT word, count(*) AS n FROM target_words GROUP BY ALL),
distinct_words AS (SELECT word, hex(encode(word)) AS digits FROM (SELECT word FROM doc_counts UNION SELECT word FROM target_counts)),
hashed AS MATERIALIZED (
  SELECT word, xor(list_reduce(
    list_transform(range(length(digits) // 2), lambda i: (instr('0123456789ABCDEF', digits[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', digits[2 * i + 2]) - 1),
    lambda c, b: xor(c // 256, steps[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM distinct_words, crc_table
),
doc_buckets AS MATERIALIZED (SELECT doc_id, bucket, sum(n) AS n FROM doc_counts JOIN hashed USING (word) GROUP BY ALL),
gain AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (t_s + 10000)) / ((s + 1)::DOUBLE * (t_t + 10000))))::BIGINT AS gain
  FROM (SELECT bucket, sum(n) AS s FROM doc_buckets GROUP BY bucket)
  LEFT JOIN (SELECT bucket, sum(n) AS found FROM target_counts JOIN hashed USING (word) GROUP BY bucket) USING (bucket),
  (SELECT coalesce(sum(n), 0) AS t_s FROM doc_counts), (SELECT coalesce(sum(n), 0) AS t_t FROM target_counts), LATERAL (SELECT coalesce(found, 0) AS t)
),
weights AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::HUGEINT AS total FROM doc_buckets JOIN gain USING (bucket) GROUP BY doc_id
),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features IS NULL THEN 0 ELSE ((total - ((total % n_features) + n_features) % n_features) // n_features)::BIGINT END AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM documents LEFT JOIN weights USING (doc_id)
),
placed AS (
  SELECT *, weight + noise AS score, n_features >= 20 AS may,
         row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n_may
  FROM scored
)
SELECT doc_id, n_features AS n_words, n_features, weight, score, CASE WHEN may AND place <= 10 * n_may // 100 THEN place END AS rank
FROM placed
"""

# a template is compared with every place where one of its words stands, in place of the index
LICENSE_SCAN = r"""
WITH templates(template, label, base, place, word, key) AS (VALUES
    {templates}
),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
),
hits AS MATERIALIZED (
  SELECT doc_id, word, spot FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS spot FROM doc_words)
  WHERE word IN (SELECT word FROM templates)
),
seen AS (SELECT word, count(DISTINCT doc_id) AS n FROM hits GROUP BY word),
weighed AS (
  SELECT templates.*, ln(((SELECT count(*) FROM documents) + 1) / (coalesce(n, 0) + 0.5::DOUBLE)) AS weight, count(*) OVER (PARTITION BY template) AS length
  FROM templates LEFT JOIN seen USING (word)
),
indexed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY template ORDER BY weight DESC, place) <= least(4, greatest(1, length // 3)) AS posted FROM weighed
),
needed AS (
  SELECT template, any_value(label) AS label, any_value(base) AS base, sum(weight) AS whole, count(*) FILTER (key) AS n_keys, (count(*) FILTER (posted) + 1) // 2 AS n_posted
  FROM indexed GROUP BY template
),
agreed AS (
  SELECT doc_id, template, spot - place AS start, sum(weight) AS weight, count(*) FILTER (key) AS keys, count(*) FILTER (posted) AS agree
  FROM hits JOIN indexed USING (word) GROUP BY ALL
),
judged AS (
  SELECT doc_id, label, base, start, CASE WHEN base THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, weight / whole), 6) END AS share
  FROM agreed JOIN needed USING (template) WHERE agree >= n_posted AND keys = n_keys
),
found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, max(share) AS score,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM judged WHERE share >= 0.8 GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM doc_words LEFT JOIN found USING (doc_id)
"""
