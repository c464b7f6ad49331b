"""Queries that write what they derive from the tables and read it back, and the last decision operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import conversion as V
from ..operators import decide as D
from ..operators import feedback as B
from ..operators import models as M
from ..operators import samples as P
from ..sources import readers as R
from ..sources import writers as W
from ..sources.scratch import shared_folder
from . import decide_queries as Q
from . import sample_queries as A
from .common import DOCS, documents, table
from .model_queries import LEXICON, all_words, lexicon_of, trigrams, unigrams


def s8_unigram_files(spark, d):
    words, folder = M.train_unigrams(documents(spark, d)), shared_folder(spark, "unigrams")
    W.write_unigrams(words, folder)
    back = None
    for lang in M.LANGS:
        one = R.read_unigrams(spark, f"{folder}/lang={lang}", lang)
        back = one if back is None else back.unionByName(one)
    return back


def s9_trigram_files(spark, d):
    trigrams, folder = M.train_trigrams(documents(spark, d)), shared_folder(spark, "trigrams")
    W.write_trigram_model(trigrams, M.trigram_header(trigrams), folder)
    back, header = R.read_trigram_model(spark, folder)
    return back.join(header.select("lang", "floor", "unique_trigrams"), "lang")


def s10_sample_files(spark, d):
    folder = shared_folder(spark, "samples")
    W.write_samples(A.samples(spark, d), folder)
    return R.read_samples(spark, folder, P.CLASSES).groupBy("label").agg(F.count("*").alias("n"))


def s11_append_by_language(spark, d):
    lines, folder = C.phrases(documents(spark, d).select("lang", "text")), shared_folder(spark, "corpus")
    W.append_by_language(lines.where("line_no % 2 = 0"), folder)
    W.append_by_language(lines.where("line_no % 2 = 1"), folder)
    return spark.read.schema(lines.schema).parquet(folder).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def s12_decision_log(spark, d):
    folder = shared_folder(spark, "log")
    found = Q.tokens(spark, d)
    W.write_decision_log(D.route(found, Q.models(spark, d), Q.rules(found)), folder)
    log = spark.read.schema("shape string, path string, lang string, confidence double").json(folder)
    counts = F.from_json("shape", "latin long, cyrillic long, hebrew long, other long, total long")
    return log.select(counts.alias("s"), "path", "lang").select("s.*", "path", "lang").groupBy("latin", "cyrillic", "hebrew", "other", "total", "path", "lang").agg(F.count("*").alias("n"))


def s13_correction_log(spark, d):
    """Events as corrections, logged and read back: the newest lines, with the shapes of what was typed."""
    folder, texts = shared_folder(spark, "corrections"), F.col("event_type")
    seen = table(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), texts.alias("original"), F.concat(texts, F.lit(" 1")).alias("final"), (F.col("event_id") % 2 == 0).alias("attempted"), F.lit("en").alias("selected"), F.col("user_id").cast("string").alias("app")
    )
    W.write_correction_log(seen, folder)
    log = spark.read.schema("ts timestamp, original string, final string, attempted boolean, selected string, app string").json(folder)
    newest = B.retain_latest(log.withColumn("latin", F.get_json_object("original", "$.latin").cast("long")), 10_000, order=("ts", "app", "latin"))
    return newest.groupBy("latin", F.get_json_object("final", "$.digits").cast("long").alias("digits"), "attempted").agg(F.count("*").alias("n"))


def d14_choose_variant(spark, d):
    typed = Q.typed_words(spark, d).where("typed_on = 'ru'").select("token")
    return D.choose_variant(V.convert_variants(typed, ("ru_phonetic", "ru"), ("us",), col="token"), lexicon_of(all_words(spark, d)).where("lang = 'en'"))


QUERIES = {f.__name__: f for f in (s8_unigram_files, s9_trigram_files, s10_sample_files, s11_append_by_language, s12_decision_log, s13_correction_log, d14_choose_variant)}

S = r"[ \t\n\x0B\f\r]"
_N = {"latin": Q.SCRIPTS["en"], "cyrillic": Q.SCRIPTS["ru"], "hebrew": Q.SCRIPTS["he"], "digits": "0-9", "spaces": r" \t\n\x0B\f\r"}
_COUNTS = ", ".join(f"length(token) - length(regexp_replace(token, '[{c}]', '', 'g')) AS {n}" for n, c in _N.items())
SQL = {
    "s12_decision_log": f"""WITH {Q.routed(with_model=False)}, c AS (SELECT path, lang, length(token) AS total, {_COUNTS} FROM routed)
        SELECT latin, cyrillic, hebrew, total - latin - cyrillic - hebrew - digits - spaces AS other, total, path, lang, count(*) AS n FROM c GROUP BY ALL""",
    "s8_unigram_files": f"WITH {DOCS}, {unigrams('u')} SELECT lang, word, cnt, rank FROM u WHERE rank <= 200000",
    "s9_trigram_files": f"WITH {DOCS}, {trigrams('m')} SELECT m.lang, gram, cnt, logprob, floor, unique_trigrams FROM m JOIN m_h ON m_h.lang = m.lang",
    "s13_correction_log": """WITH l AS (SELECT ts, CAST(user_id AS VARCHAR) AS app, length(event_type) AS latin, 1 AS digits, event_id % 2 = 0 AS attempted FROM events ORDER BY date_trunc('millisecond', ts) DESC, app DESC, latin DESC LIMIT 10000)
        SELECT latin, digits, attempted, count(*) AS n FROM l GROUP BY ALL""",
    "s10_sample_files": f"WITH {A.SAMPLE} SELECT label, count(*) AS n FROM sm GROUP BY label",
    "s11_append_by_language": f"""WITH {DOCS}, l AS (SELECT lang, regexp_replace(unnest(string_split(text, chr(10))), '^{S}+|{S}+$', '', 'g') AS line FROM docs) SELECT lang, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM l WHERE length(line) > 0 GROUP BY lang""",
    "d14_choose_variant": f"""WITH {Q.TYPED_WORDS}, {LEXICON}, {Q.variants("SELECT token FROM tyw WHERE typed_on = 'ru'", ('ru_phonetic', 'ru'), ('us',))}, b AS (SELECT DISTINCT word FROM lexicon WHERE kind = 'builtin' AND lang = 'en')
        SELECT token, src, dst, result, b.word IS NOT NULL AS in_lexicon FROM va LEFT JOIN b ON b.word = lower(result) QUALIFY row_number() OVER (PARTITION BY token ORDER BY b.word IS NOT NULL DESC, priority) = 1""",
}
