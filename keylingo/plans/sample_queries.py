"""Queries of training samples, the classifier and evaluation cases, with SQL where draws and encodings can be repeated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import decide as D
from ..operators import evaluate as E
from ..operators import models as M
from ..operators import samples as P
from ..sources.scratch import kept, shared_folder
from .common import DOCS, documents, held_out, sql_translate
from .decide_queries import WORDS, document_words
from .model_queries import ALL_DOCS
from .model_queries import by_lang, lexicon_of, scored, scores_of_two, trigram_scores, trigrams
from .model_queries import HELD as HELD_SQL
from .model_queries import unigrams

def words(spark, d) -> DataFrame:
    """Distinct words of all documents, numbered; all of them are typed on the us layout, whose language is ``en``."""
    return kept(P.sample_words(document_words(spark, d).withColumn("lang", F.lit("en")), 500_000), "words")


def samples(spark, d) -> DataFrame:
    """As many samples as there are words."""
    found = words(spark, d)
    return P.make_samples(found, found.count())


def m1_sample_words(spark, d):
    return P.sample_words(M.train_unigrams(documents(spark, d)), 500_000)


def m1_head_words(spark, d):
    return P.sample_words(M.train_unigrams(documents(spark, d)), 500_000, mode="head")


def m2_make_samples(spark, d):
    return samples(spark, d)


def m3_augment_samples(spark, d):
    return P.augment_samples(samples(spark, d), p=0.5)


def m4_split_samples(spark, d):
    return P.split_samples(documents(spark, d).select(F.col("doc_id").alias("id"), "lang"))


def p21_encode_samples(spark, d):
    coded = P.encode_samples(samples(spark, d))
    return coded.select("id", F.array_join("codes", ",").alias("codes"), "cls", "unknown")


def p21_unknown_rates(spark, d):
    return P.unknown_rates(P.encode_samples(samples(spark, d))).withColumn("rate", rounded("rate", 6))


def _parts(spark, d) -> tuple[DataFrame, DataFrame]:
    coded = P.split_samples(P.encode_samples(kept(samples(spark, d), "samples")))
    return coded.where("part = 'train'"), coded.where("part = 'validation'")


def m5_m6_classifier(spark, d):
    """Predictions for the validation samples by a classifier trained on the others."""
    train, validation = _parts(spark, d)
    return P.predict_classes(P.train_classifier(train), validation.select("id", "text", "label")).withColumn("confidence", rounded("confidence", 6))


def m8_select_best(spark, d):
    train, validation = (x.select("id", "text", "label", "cls") for x in _parts(spark, d))
    return P.select_best(train, validation)


def m7_blend_models(spark, d):
    counted = kept(M.count_trigrams_of(documents(spark, d), ~held_out()), "counts")
    trained = kept(M.smoothed(counted.where("part > 0").select("lang", "gram", F.col("part").alias("cnt"))), "trigrams")
    other = kept(M.smoothed(counted.select("lang", "gram", "cnt"), k=2.0), "trigrams")
    scores = scores_of_two(scored(spark, d), trained, other)
    parts = [scores.groupBy("doc_id").agg(by_lang(c).alias("scores")) for c in ("x", "y")]
    made = P.blend_models(*parts, key="doc_id")
    return made.select("doc_id", F.posexplode("scores").alias("place", "score")).select("doc_id", F.col("place").cast("long").alias("place"), rounded("score", 6).alias("score"))


def m9_synthetic_cases(spark, d):
    return P.synthetic_cases(M.rank_bands(M.train_unigrams(documents(spark, d).where("lang = 'en'"))).select("word", "rank"))


#: Latin letters as Cyrillic and Hebrew ones, for lexicons of three scripts: the given tables have no Russian or Hebrew text.
STAND_INS = {"ru": ("es", "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшыжз"), "he": ("de", "abcdefghijklmnopqrstuvwxyz", "אבגדהוזחטיכלמנסעפצקרשתםןףץ")}


def lexicons(spark, d) -> DataFrame:
    """(lang, word, cnt, rank): English words, and the Spanish and German ones of Latin letters in Cyrillic and Hebrew letters."""
    words = M.train_unigrams(documents(spark, d)).where(F.length("word") >= 2)
    parts = [words.where("lang = 'en'").select("lang", "word", "cnt", "rank")]
    for lang, (of, latin, own) in STAND_INS.items():
        usable = words.where((F.col("lang") == of) & F.col("word").rlike("^[a-z]+$"))
        parts.append(usable.select(F.lit(lang).alias("lang"), F.translate("word", latin, own).alias("word"), "cnt", F.row_number().over(Window.partitionBy("lang").orderBy("rank")).cast("long").alias("rank")))
    return reduce(DataFrame.unionByName, parts)


def informal(words: DataFrame) -> DataFrame:
    """One word in fifty, by digest, counts as informal."""
    return words.where(P.draw(F.col("word"), 42, "informal") % 50 == 0).select("lang", "word")


def m9_evaluation_cases(spark, d):
    words = kept(lexicons(spark, d), "lexicons")
    return P.evaluation_cases(words, informal(words))


def m10_evaluate_cases(spark, d):
    """Stratified cases in three scripts, routed by models of all three and applied: accuracy and gate by languages (typed, intended)."""
    words = kept(lexicons(spark, d), "lexicons")
    cases = kept(P.evaluation_cases(words, informal(words)), "cases")
    grams = kept(M.train_trigrams(words.select("lang", F.col("word").alias("text")), langs=D.LANGS), "grams")
    models = D.Models.of(lexicon_of(words), M.unigram_scores(words), grams, M.trigram_header(grams)).kept(shared_folder(spark, "models"))
    none = spark.createDataFrame([], "token string, action string, hyp string")
    decided = D.apply_decision(D.route(cases.select(F.col("typed").alias("token")).distinct(), models, none)).select("token", "output")
    judged = cases.withColumn("pair", F.concat_ws("->", "typed_on", "lang")).join(decided, cases["typed"] == decided["token"])
    return E.class_report(judged, "pair", expected="intended", predicted="output").withColumn("accuracy", rounded("accuracy", 6))


QUERIES = {f.__name__: f for f in (
    m1_sample_words, m1_head_words, m2_make_samples, m3_augment_samples, m4_split_samples, p21_encode_samples, p21_unknown_rates, m5_m6_classifier, m7_blend_models, m8_select_best, m9_synthetic_cases, m9_evaluation_cases, m10_evaluate_cases)}


def draw(key: str, name: str, seed: int = 42) -> str:
    return f"CAST('0x' || substr(md5('{seed}|{name}|' || {key}), 1, 6) AS BIGINT)"


_ID = "CAST(id AS VARCHAR)"
_MEANT = "us"
_ON = {"en_from_ru": ["ru", "ru_phonetic"], "en_from_he": ["he", "he_qwerty"]}
_TYPED = " ".join(f"WHEN label = '{h}' AND {draw(_ID, 'typed')} % 2 = {n} THEN {sql_translate('phrase', _MEANT, x)}" for h, on in _ON.items() for n, x in enumerate(on))
SAMPLE = f"""{DOCS}, {WORDS}, sw AS MATERIALIZED (SELECT word, row_number() OVER (ORDER BY {draw('word', 'sample')}, word) AS pos FROM ew WHERE length(word) BETWEEN 2 AND 19 QUALIFY pos <= 500000),
  tot AS (SELECT count(*) AS total FROM sw), ids AS MATERIALIZED (SELECT unnest(range(total)) AS id FROM tot),
  pt AS (SELECT id, unnest(range(1, CAST({draw(_ID, 'length')} % 3 + 2 AS BIGINT))) AS part FROM ids),
  pk AS (SELECT id, part, {draw("id || '/' || part", 'word')} % total + 1 AS pos FROM pt, tot),
  ph AS (SELECT id, string_agg(word, ' ' ORDER BY part) AS phrase FROM pk JOIN sw USING (pos) GROUP BY id),
  lb AS (SELECT id, phrase, CASE WHEN {draw(_ID, 'class')} / 16777216.0 < 0.5 THEN 'en' WHEN {draw(_ID, 'which')} % 2 = 0 THEN 'en_from_ru' ELSE 'en_from_he' END AS label FROM ph),
  sm AS MATERIALIZED (SELECT id, CASE {_TYPED} ELSE phrase END AS text, label FROM lb)"""


def sampled(order: str) -> str:
    return f"WITH {DOCS}, {unigrams('u')}, w AS (SELECT DISTINCT lang, word FROM u WHERE rank <= 200000 AND length(word) BETWEEN 2 AND 19) SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY {order}) AS \"at\" FROM w QUALIFY \"at\" <= 500000"


_AT = f"CAST({draw('CAST(id AS VARCHAR)', 'place')} % greatest(length(text) - 1, 1) + 1 AS BIGINT)"
_other = lambda c: f"CASE WHEN {c} = 'ß' THEN 'ß' WHEN {c} = upper({c}) THEN lower({c}) ELSE upper({c}) END"
_CASE, _SLOT = "lang || '/' || id", "lang || '/' || id || '/' || slot"
_UPTO = [sum(list(P.quotas(300).values())[: n + 1]) for n in range(len(P.KINDS))]
_KINDS = " ".join(f"WHEN id < {upto} THEN '{name}'" for upto, (name, _) in zip(_UPTO, P.KINDS, strict=True))
_SIZES = " ".join(f"WHEN '{name}' THEN " + (f"{draw(_CASE, 'length')} % 5 + 2" if name == "phrase" else str(len(ranges))) for name, ranges in P.SLOTS.items())
_RANGES = " ".join(f"WHEN kind = '{name}' AND slot = {i} THEN '{a}-{b}'" for name, ranges in P.SLOTS.items() for i, (a, b) in enumerate(ranges))
_TYPING = " ".join(f"WHEN '{x}/{y}' THEN {sql_translate('intended', D.ACTIVE[x], D.ACTIVE[y])}" for x in D.LANGS for y in D.LANGS if x != y)
_ALPHABET = P.ALPHABET.replace("'", "''")
SQL = {
    "m1_sample_words": sampled(f"{draw('word', 'sample')}, word"),
    "m1_head_words": sampled("word"),
    "m2_make_samples": f"WITH {SAMPLE} SELECT id, text, label FROM sm",
    "m3_augment_samples": f"""WITH {SAMPLE}, a AS (SELECT id, label, text, {draw(_ID, 'augment')} / 16777216.0 < 0.5 AND length(text) >= 2 AS hit, {draw(_ID, 'kind')} % 5 AS kind, {draw(_ID, 'way')} % 4 AS way, {_AT} AS p FROM sm),
        b AS (SELECT *, substr(text, 1, p - 1) AS head, substr(text, p, 1) AS one, substr(text, p + 1, 1) AS two, substr(text, p + 2) AS tail FROM a)
        SELECT id, label, CASE WHEN NOT hit THEN text WHEN kind = 0 THEN head || CASE WHEN way < 2 THEN {_other('one')} WHEN way = 2 THEN translate(one, '{P._LETTERS}', '{P.AFTER}') ELSE translate(one, '{P._LETTERS}', '{P.BEFORE}') END || two || tail
          WHEN kind = 1 THEN array_to_string(list_transform(range(1, length(text) + 1), lambda i: CASE WHEN {draw("id || '/' || (i - 1)", 'case')} % 10 < 3 THEN {_other('substr(text, i, 1)')} ELSE substr(text, i, 1) END), '')
          WHEN kind = 2 THEN head || two || one || tail WHEN kind = 3 THEN CASE WHEN length(text) > 2 THEN head || two || tail ELSE text END ELSE head || one || one || two || tail END AS text FROM b""",
    "m4_split_samples": f"WITH {DOCS} SELECT doc_id AS id, lang, CASE WHEN {draw('CAST(doc_id AS VARCHAR)', 'split')} / 16777216.0 < 0.9 THEN 'train' ELSE 'validation' END AS part FROM docs",
    "p21_encode_samples": f"""WITH {SAMPLE}, c AS (SELECT id, label, list_transform(list_filter(regexp_split_to_array(text, ''), lambda x: x <> ''), lambda x: strpos('{_ALPHABET}', x)) AS codes FROM sm)
        SELECT id, array_to_string(list_transform(range(1, 21), lambda i: coalesce(codes[i], 0)), ',') AS codes, list_position([{', '.join(repr(c) for c in P.CLASSES)}], label)::BIGINT - 1 AS cls, len(list_filter(codes, lambda x: x = 0)) AS unknown FROM c""",
    "p21_unknown_rates": f"""WITH {SAMPLE} SELECT label, count(*) AS samples, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text) - length(translate(text, translate(text, '{_ALPHABET}', ''), ''))) AS BIGINT) AS unknown,
        round(sum(length(text) - length(translate(text, translate(text, '{_ALPHABET}', ''), ''))) / sum(length(text)), 6) AS rate FROM sm GROUP BY label""",
    "m7_blend_models": f"""WITH {DOCS}, {ALL_DOCS}, {trigrams('tg', f'NOT ({HELD_SQL})')}, {trigram_scores('sc', 'held', 'tg')}, {trigrams('tk', 'true', 2.0)}, {trigram_scores('sk', 'held', 'tk')}
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY lang) - 1 AS place, round(0.6 / (1 + exp(-sc.score)) + 0.4 / (1 + exp(-sk.score)), 6) AS score FROM sc JOIN sk USING (doc_id, lang)""",
    "m9_evaluation_cases": f"""WITH {DOCS}, {unigrams('u')}, w AS (SELECT 'en' AS lang, word, rank FROM u WHERE lang = 'en' AND rank <= 200000
          UNION ALL SELECT 'ru', translate(word, '{STAND_INS['ru'][1]}', '{STAND_INS['ru'][2]}'), row_number() OVER (ORDER BY rank) FROM u WHERE lang = 'es' AND rank <= 200000 AND regexp_matches(word, '^[a-z]+$')
          UNION ALL SELECT 'he', translate(word, '{STAND_INS['he'][1]}', '{STAND_INS['he'][2]}'), row_number() OVER (ORDER BY rank) FROM u WHERE lang = 'de' AND rank <= 200000 AND regexp_matches(word, '^[a-z]+$')),
        w2 AS MATERIALIZED (SELECT *, length(word) AS len, count(*) OVER (PARTITION BY lang) AS total FROM w),
        c AS (SELECT id, lang, CASE {_KINDS} END AS kind FROM (SELECT unnest(range(300)) AS id), (SELECT unnest(['en', 'ru', 'he']) AS lang)),
        s AS (SELECT id, lang, kind, unnest(range(CASE kind {_SIZES} END)) AS slot FROM c),
        r AS (SELECT *, CASE {_RANGES} END AS letters FROM s),
        p AS (SELECT *, row_number() OVER (PARTITION BY lang, letters ORDER BY {draw(_SLOT, 'band')}, id, slot) AS p, count(*) OVER (PARTITION BY lang, letters) AS m FROM r),
        b AS (SELECT *, CASE WHEN letters = '0-0' THEN 'informal' WHEN p * 100 <= m * 50 + 50 THEN 'head' WHEN p * 100 <= m * 85 + 50 THEN 'middle' ELSE 'tail' END AS band FROM p),
        j AS (SELECT *, row_number() OVER (PARTITION BY lang, letters, band ORDER BY {draw(_SLOT, 'pick')}, id, slot) AS j FROM b),
        o AS (SELECT lang, word, letters, band FROM w2, (VALUES ('2-3', 2, 3), ('4-8', 4, 8), ('2-10', 2, 10), ('3-8', 3, 8), ('2-8', 2, 8)) l(letters, least, most), (VALUES ('head', 1, 4000), ('middle', 20001, 40000), ('tail', 150001, 999999999)) k(band, first, last)
            WHERE len BETWEEN least AND most AND (rank BETWEEN first AND last OR total < first)
          UNION ALL SELECT lang, word, '0-0', 'any' FROM w2 WHERE rank <= 4000 UNION ALL SELECT DISTINCT lang, word, '0-0', 'informal' FROM w2 WHERE {draw('word', 'informal')} % 50 = 0),
        q AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY lang, letters, band) AS n FROM (SELECT *, row_number() OVER (PARTITION BY lang, letters, band ORDER BY {draw('word', 'word')}, word) AS j FROM o) WHERE j <= 1800),
        g AS (SELECT j.id, j.lang, j.kind, j.slot, j.j, coalesce(h.letters, '0-0') AS letters, coalesce(h.band, 'any') AS band, coalesce(h.n, a.n) AS n FROM j LEFT JOIN q h ON h.lang = j.lang AND h.letters = j.letters AND h.band = j.band AND h.j = 1 LEFT JOIN q a ON a.lang = j.lang AND a.band = 'any' AND a.j = 1),
        d AS (SELECT id, g.lang, kind, list(word ORDER BY slot) AS ws FROM g JOIN q ON q.lang = g.lang AND q.letters = g.letters AND q.band = g.band AND q.j = (g.j - 1) % g.n + 1 GROUP BY id, g.lang, kind),
        i AS (SELECT id, lang, kind, CASE WHEN kind IN ('short', 'medium', 'informal') THEN ws[1] WHEN kind = 'phrase' THEN array_to_string(ws, ' ')
            WHEN kind = 'mixed' THEN CASE WHEN {draw(_CASE, 'order')} % 2 = 0 THEN ws[1] || ' ' || ws[2] ELSE ws[2] || ' ' || ws[1] END
            WHEN kind = 'punctuation' THEN CASE {draw(_CASE, 'mark')} % 6 WHEN 0 THEN ws[1] || ', ' || ws[2] WHEN 1 THEN ws[1] || ',' || ws[2] WHEN 2 THEN ws[1] || ' / ' || ws[2] WHEN 3 THEN '(' || ws[1] || ') ' || ws[2] WHEN 4 THEN ws[1] || ' ' || ws[2] || '! ' || ws[3] ELSE ws[1] || ' ' || ws[2] END
            ELSE CASE {draw(_CASE, 'style')} % 5 WHEN 0 THEN ws[1] || '!!!' WHEN 1 THEN ws[1] || '???' WHEN 2 THEN ws[1] || ', ' || ws[2] WHEN 3 THEN ws[1] || '... ' || ws[2] ELSE ws[1] || ' ' || ws[2] || '!' END END AS intended FROM d),
        t AS (SELECT i.*, typed_on, CASE lang || '/' || typed_on {_TYPING} ELSE intended END AS typed FROM i, (SELECT unnest(['en', 'ru', 'he']) AS typed_on))
        SELECT lang, id, kind, typed_on, intended, typed, CASE WHEN lang = typed_on THEN lang ELSE lang || '_from_' || typed_on END AS expected FROM t WHERE lang = typed_on OR typed <> intended""",
    "m9_synthetic_cases": f"""WITH docs AS (SELECT doc_id, text, lang, source FROM documents WHERE text IS NOT NULL AND lang = 'en'), {unigrams('u')}, k AS (SELECT word, CASE WHEN length(word) <= 3 THEN 'short' WHEN length(word) <= 7 THEN 'medium' ELSE 'long' END AS kind,
          CASE WHEN {draw('word', 'mark')} % 10 < 2 THEN word || '!' ELSE word END AS intended FROM u WHERE rank <= 200000),
        e AS (SELECT word, kind, intended, 'us' AS typed_on, intended AS typed, 'en' AS expected FROM k UNION ALL SELECT word, kind, intended, 'ru', {sql_translate('intended', 'us', 'ru')}, 'en_from_ru' FROM k UNION ALL SELECT word, kind, intended, 'he', {sql_translate('intended', 'us', 'he')}, 'en_from_he' FROM k)
        SELECT * FROM e WHERE typed_on = 'us' OR typed <> intended""",
}
