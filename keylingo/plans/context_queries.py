"""Queries of context and segmentation operators, with their SQL.

Tokens are those of ``conversations``, a second apart within a turn. Languages
and confidences of tokens are derived from the tokens' digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import layouts as L
from ..functions import text as T
from ..functions.numbers import rounded
from ..operators import cleaning as C
from ..operators import context as K
from ..operators import models as M
from ..operators.blocks import dealt
from .common import DOCS, documents, sql_translate, table
from .model_queries import LEXICON, training


def _byte(at: int) -> Column:
    return F.conv(F.substring(F.md5(F.col("token").cast("binary")), at, 2), 16, 10).cast("long")


def tokens(spark, d, conversations: DataFrame | None = None) -> DataFrame:
    words = F.filter(F.split("text", f"{T.SPACE}+"), lambda w: w != "")
    conversations = table(spark, d, "conversations") if conversations is None else conversations
    each = conversations.select("conv_id", "turn", F.posexplode(words).alias("pos", "token"))
    langs = F.array(F.lit("en"), F.lit("ru"), F.lit("he"))
    return each.select(
        F.col("conv_id").alias("stream_id"), (F.col("turn") * 100_000 + F.col("pos")).alias("seq"), (F.col("turn") * 100_000 + F.col("pos")).cast("double").alias("ts"), "token",
        F.element_at(langs, (_byte(1) % 3 + 1).cast("int")).alias("lang"), (_byte(3) / 255).alias("confidence"), (_byte(5) < 64).alias("applied"),
        (_byte(7) / 255).alias("target_score"), (_byte(9) / 255).alias("source_score"),
    )


def _with_sentences(spark, d) -> DataFrame:
    return K.sentence_ids(dealt(tokens(spark, d), ("stream_id",), ("seq",)))


def w1_sentence_ids(spark, d):
    return _with_sentences(spark, d).select("stream_id", "seq", "sentence")


def w2_last_language(spark, d):
    return K.last_language(tokens(spark, d)).select("stream_id", "seq", "last_lang")


def w3_sentence_dominant(spark, d):
    return K.sentence_dominant(_with_sentences(spark, d)).select("stream_id", "seq", "sentence_lang", "agreeing")


def w4_context_boost(spark, d):
    return K.context_boost(_with_sentences(spark, d)).select("stream_id", "seq", "decision")


def d18_dominant_override(spark, d):
    return K.dominant_override(K.sentence_dominant(_with_sentences(spark, d))).select("stream_id", "seq", "override")


def _words(spark, d) -> DataFrame:
    return M.unigram_scores(M.train_unigrams(training(spark, d)))


def a17_phrase_frequency_score(spark, d):
    lines = C.phrases(documents(spark, d).select("doc_id", "text")).select(F.concat_ws("-", "doc_id", "line_no").alias("key"), "text")
    return K.phrase_frequency_score(lines, _words(spark, d)).withColumn("score", rounded("score", 6))


def readings(spark, d) -> DataFrame:
    """(token, whole, split, s_token, s_whole, s_split, confidence) of the distinct segments of documents typed on the Russian layout."""
    docs = documents(spark, d)
    typed = docs.select(F.explode(F.split(L.convert(F.lower("text"), "us", "ru"), f"{T.SPACE}+")).alias("token")).where("token <> ''")
    both = K.scored_readings(typed, _words(spark, d), "ru", "us")
    return both.withColumn("confidence", F.least(F.lit(1.0), 0.5 + F.col("s_whole") / 2))


def d15_split_or_whole(spark, d):
    return K.split_or_whole(readings(spark, d)).select("token", "chosen")


def d16_correct_segments(spark, d):
    docs = documents(spark, d).select("doc_id", L.convert(F.lower("text"), "us", "ru").alias("text"))
    fixed = K.correct_segments(docs, K.split_or_whole(readings(spark, d)), usual=("ru", "us"))
    return fixed.select("doc_id", "changed", F.md5(F.col("text").cast("binary")).alias("digest"))


def d17_rank_alternatives(spark, d):
    table_ = readings(spark, d).withColumn("others", F.array(F.struct(L.convert(F.col("token"), "ru", "he").alias("text"), F.lit(0.0).alias("score"))))
    return K.rank_alternatives(table_)


QUERIES = {f.__name__: f for f in (
    w1_sentence_ids, w2_last_language, w3_sentence_dominant, w4_context_boost, d18_dominant_override, a17_phrase_frequency_score, d15_split_or_whole, d16_correct_segments,
    d17_rank_alternatives)}

S = r"[ \t\n\x0B\f\r]"
_B = lambda at: f"CAST('0x' || substr(md5(token), {at}, 2) AS BIGINT)"
TOKENS = rf"""w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '{S}+'), lambda x: x <> '') AS ws FROM conversations WHERE text IS NOT NULL),
  e AS (SELECT conv_id, turn, unnest(ws) AS token, unnest(range(0, len(ws))) AS pos FROM w),
  tk AS (SELECT conv_id AS stream_id, turn * 100000 + pos AS seq, CAST(turn * 100000 + pos AS DOUBLE) AS ts, token, list_extract(['en', 'ru', 'he'], CAST({_B(1)} % 3 + 1 AS INT)) AS lang,
         {_B(3)} / 255 AS confidence, {_B(5)} < 64 AS applied, {_B(7)} / 255 AS target_score, {_B(9)} / 255 AS source_score FROM e),
  nw AS (SELECT *, CASE WHEN coalesce(regexp_matches(lag(token) OVER s, '[.!?][\p{{P}}]*$'), false) OR coalesce(ts - lag(ts) OVER s > 2, false) THEN 1 ELSE 0 END AS new FROM tk WINDOW s AS (PARTITION BY stream_id ORDER BY seq)),
  sn AS (SELECT *, CAST(sum(new) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sentence FROM nw)"""
TOKENS_ONLY = f"WITH {TOKENS} SELECT * FROM tk"
DOMINANT = """su AS (SELECT *, CASE WHEN confidence > 0.45 THEN lang END AS sure FROM sn),
  fi AS (SELECT *, first_value(sure IGNORE NULLS) OVER (PARTITION BY stream_id, sentence ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sentence_lang,
         first_value(sure IGNORE NULLS) OVER (PARTITION BY stream_id, sentence ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dom FROM su),
  dm AS (SELECT *, CAST(sum(CASE WHEN sure = dom THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, sentence ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS agreeing FROM fi)"""
USEFUL = "uf AS (SELECT lang, word, ln(1 + cnt) / ln(1 + max(cnt) OVER (PARTITION BY lang)) AS f FROM tw WHERE rank <= 200000), us AS (SELECT word, max(f) AS best FROM uf WHERE lang <> 'en' OR f >= 0.2 GROUP BY word)"


def phrase_scores(name: str, texts: str) -> str:
    return rf"""{name}_w AS (SELECT key, word, count(*) AS n FROM (SELECT key, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM {texts}) GROUP BY key, word),
      {name}_h AS (SELECT key, sum(n * best) AS score FROM {name}_w JOIN us USING (word) GROUP BY key),
      {name} AS MATERIALIZED (SELECT t.key, coalesce(h.score, 0) AS score FROM {texts} t LEFT JOIN {name}_h h ON h.key = t.key)"""


_HELDLESS = LEXICON.split(", lexicon AS")[0]
READINGS = rf"""{DOCS}, {_HELDLESS}, {USEFUL}, ty AS (SELECT DISTINCT unnest(regexp_split_to_array({sql_translate('lower(text)', 'us', 'ru')}, '{S}+')) AS token FROM docs),
  bo AS MATERIALIZED (SELECT token, {sql_translate('token', 'ru', 'us')} AS whole, array_to_string(list_transform(regexp_extract_all(token, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+'), lambda r: CASE WHEN regexp_matches(r, '^[\p{{L}}\p{{N}}]') THEN {sql_translate('r', 'ru', 'us')} ELSE r END), '') AS split FROM ty WHERE token <> ''),
  tx AS (SELECT DISTINCT unnest([token, whole, split]) AS key FROM bo), txt AS (SELECT key, key AS text FROM tx), {phrase_scores('ph', 'txt')},
  rd AS MATERIALIZED (SELECT b.*, a.score AS s_token, w.score AS s_whole, s.score AS s_split, least(1.0, 0.5 + w.score / 2) AS confidence FROM bo b JOIN ph a ON a.key = b.token JOIN ph w ON w.key = b.whole JOIN ph s ON s.key = b.split),
  sp AS (SELECT *, CASE WHEN whole <> token THEN (confidence < 0.9 AND regexp_matches(token, '\p{{L}}{{2,}}[.,]\p{{L}}{{2,}}')) OR s_split > s_whole + 0.25 ELSE s_split >= s_whole END AS is_split FROM rd),
  ch AS (SELECT token, CASE WHEN (CASE WHEN is_split THEN split ELSE whole END) <> token AND ((CASE WHEN is_split THEN s_split ELSE s_whole END) > s_token OR (s_token = 0 AND whole <> token)) THEN CASE WHEN is_split THEN split ELSE whole END END AS chosen FROM sp)"""
SQL = {
    "w1_sentence_ids": f"WITH {TOKENS} SELECT stream_id, seq, sentence FROM sn",
    "w2_last_language": f"WITH {TOKENS} SELECT stream_id, seq, last_value(CASE WHEN applied THEN lang END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_lang FROM tk",
    "w3_sentence_dominant": f"WITH {TOKENS}, {DOMINANT} SELECT stream_id, seq, sentence_lang, agreeing FROM dm",
    "w4_context_boost": f"""WITH {TOKENS}, n AS (SELECT *, lead(lang) OVER s AS nl, lead(confidence) OVER s AS nc, lead(ts) OVER s AS nt FROM sn WINDOW s AS (PARTITION BY stream_id, sentence ORDER BY seq))
        SELECT stream_id, seq, CASE WHEN confidence > 0.45 THEN 'applied' WHEN nt - ts <= 5 AND lower(token) IN ('f', 'd', 'r', 'j', 'e', 'b', 'z') AND nl = 'ru' THEN 'preposition'
          WHEN nt - ts <= 5 AND confidence >= 0.40 AND nc > 0.45 AND nl = lang AND confidence + 0.20 > 0.45 THEN 'boosted' END AS decision FROM n""",
    "d18_dominant_override": rf"""WITH {TOKENS}, {DOMINANT} SELECT stream_id, seq, coalesce(length(regexp_replace(token, '[^\p{{L}}]', '', 'g')) BETWEEN 1 AND 2 AND agreeing >= 2 AND sentence_lang <> lang AND target_score >= 0.70 AND target_score >= source_score + 0.25, false) AS override FROM dm""",
    "a17_phrase_frequency_score": rf"""WITH {DOCS}, {_HELDLESS}, {USEFUL}, raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM docs),
        ln0 AS (SELECT doc_id || '-' || line_no AS key, regexp_replace(t, '^{S}+|{S}+$', '', 'g') AS text FROM raw), lns AS (SELECT * FROM ln0 WHERE length(text) > 0), {phrase_scores('ph', 'lns')} SELECT key, round(score, 6) AS score FROM ph""",
    "d15_split_or_whole": f"WITH {READINGS} SELECT token, chosen FROM ch",
    "d16_correct_segments": rf"""WITH {READINGS}, dt AS (SELECT doc_id, regexp_extract_all({sql_translate('lower(text)', 'us', 'ru')}, '{S}+|[^ \t\n\x0B\f\r]+') AS ss FROM docs),
        sg AS (SELECT doc_id, unnest(ss) AS segment, unnest(range(1, len(ss) + 1)) AS pos FROM dt), jn AS (SELECT doc_id, pos, chosen, coalesce(chosen, segment) AS s FROM sg LEFT JOIN ch ON ch.token = sg.segment)
        SELECT doc_id, count(chosen) AS changed, CASE WHEN count(chosen) > 0 AND count(*) > 1 THEN md5(string_agg(s, '' ORDER BY pos)) END AS digest FROM jn GROUP BY doc_id""",
    "d17_rank_alternatives": f"""WITH {READINGS}, ag AS (SELECT *, CASE WHEN split = whole THEN 0.20 ELSE 0.0 END AS agree FROM rd), fs AS (SELECT *, s_split + agree + 0.05 >= s_whole + agree AS first FROM ag),
        op AS (SELECT token, 0 AS step, token AS text FROM fs UNION ALL SELECT token, 1, CASE WHEN first THEN split ELSE whole END FROM fs UNION ALL SELECT token, 2, CASE WHEN first THEN whole ELSE split END FROM fs UNION ALL SELECT token, 3, {sql_translate('token', 'ru', 'he')} FROM fs),
        un AS (SELECT token, text, min(step) AS step FROM op GROUP BY token, text) SELECT token, row_number() OVER (PARTITION BY token ORDER BY step, text) - 1 AS place, text FROM un""",
}
