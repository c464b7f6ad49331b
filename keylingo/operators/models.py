"""Language models from phrase tables: trigrams, word frequencies, their headers and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import rounded

LANGS = ("en", "fr", "de", "es")


def count_words(phrases: DataFrame, min_len: int = 2, langs=LANGS) -> DataFrame:
    """(lang, word, cnt) over all words of each language's letters."""
    words = phrases.select("lang", F.explode(T.words_by_language(F.col("text"), F.col("lang"), langs, min_len)).alias("word"))
    return words.groupBy("lang", "word").agg(F.count("*").alias("cnt"))


def train_unigrams(phrases: DataFrame, top_n: int = 200_000, min_len: int = 2, langs=LANGS) -> DataFrame:
    """(lang, word, cnt, rank): exact counts, the most frequent of each language, ties by word."""
    return most_frequent(count_words(phrases, min_len, langs), top_n)


def most_frequent(counted: DataFrame, top_n: int) -> DataFrame:
    """``counted`` (lang, word, cnt) with rank, cut to the most frequent of each language, ties by word."""
    best = Window.partitionBy("lang").orderBy(F.desc("cnt"), "word")
    # the bare row number lets every task drop all but its first top_n rows before the shuffle
    return counted.withColumn("__at", F.row_number().over(best)).where(F.col("__at") <= top_n).withColumn("rank", F.col("__at").cast("long")).drop("__at")


def count_trigrams(phrases: DataFrame, langs=LANGS) -> DataFrame:
    """(lang, gram, cnt) over the language's letters."""
    text = T.normalize_by_language(F.col("text"), F.col("lang"), langs)
    return phrases.select("lang", F.explode(T.trigrams(text)).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("cnt"))


def count_trigrams_of(phrases: DataFrame, part: Column, langs=LANGS) -> DataFrame:
    """(lang, gram, cnt, part): ``count_trigrams`` of all phrases and of those of a part, from one pass over the texts."""
    text = T.normalize_by_language(F.col("text"), F.col("lang"), langs)
    grams = phrases.select("lang", part.alias("__in"), F.explode(T.trigrams(text)).alias("gram"))
    return grams.groupBy("lang", "gram").agg(F.count("*").alias("cnt"), F.count_if("__in").alias("part"))


def train_trigrams(phrases: DataFrame, k: float = 1.0, places: int | None = 2, langs=LANGS) -> DataFrame:
    """(lang, gram, cnt, logprob): ln((c + k) / (T + k V)), rounded to ``places``."""
    return smoothed(count_trigrams(phrases, langs), k, places)


def smoothed(counted: DataFrame, k: float = 1.0, places: int | None = 2) -> DataFrame:
    """``train_trigrams`` from counts."""
    totals = counted.groupBy("lang").agg(F.sum("cnt").alias("t"), F.count("*").alias("v"))
    logprob = F.log((F.col("cnt") + k) / (F.col("t") + k * F.col("v")))
    out = counted.join(totals, "lang")
    return out.select("lang", "gram", "cnt", (logprob if places is None else rounded(logprob, places)).alias("logprob"))


def trigram_header(trigrams: DataFrame, k: float = 1.0) -> DataFrame:
    """A row per language: counts, floor = least - 2, and nearest-rank p05, p50 and p95."""
    ordered = Window.partitionBy("lang").orderBy("logprob", "gram")
    ranked = trigrams.withColumn("at", F.row_number().over(ordered) - 1).withColumn("n", F.count("*").over(Window.partitionBy("lang")))
    pick = {name: F.max(F.when(F.col("at") == F.floor((F.col("n") - 1) * p + 0.5), F.col("logprob"))).alias(name) for name, p in (("p05", 0.05), ("p50", 0.50), ("p95", 0.95))}
    return ranked.groupBy("lang").agg(
        F.lit(3).cast("long").alias("n_gram"), F.lit(k).alias("smoothing_k"), F.sum("cnt").alias("total_count"), F.count("*").alias("unique_trigrams"),
        F.round(F.min("logprob") - 2, 2).alias("floor"), *pick.values(), F.min("logprob").alias("least"), F.max("logprob").alias("most"),
    )


def unigram_scores(unigrams: DataFrame) -> DataFrame:
    """``unigrams`` with log_cnt and freq_score = log1p(count) / log1p(top count); of repeated words the first by rank counts, without ranks the most frequent."""
    first = Window.partitionBy("lang", "word").orderBy("rank" if "rank" in unigrams.columns else F.desc("cnt"))
    kept = unigrams.withColumn("__at", F.row_number().over(first)).where("__at = 1").drop("__at")
    top = unigrams.groupBy(F.col("lang").alias("__lang")).agg(F.max("cnt").alias("__top"))  # a row a language
    return kept.join(F.broadcast(top), F.col("lang").eqNullSafe(F.col("__lang"))).withColumn("log_cnt", F.log1p("cnt")).withColumn("freq_score", F.log1p("cnt") / F.log1p("__top")).drop("__lang", "__top")


def validate_model(trigrams: DataFrame, header: DataFrame) -> DataFrame:
    """A row per language of checks: entries, keys of another length, positive and missing log-probabilities, and whether it is valid."""
    checks = trigrams.groupBy("lang").agg(
        F.count("*").alias("entries"), F.count_if(F.length("gram") != 3).alias("bad_keys"), F.count_if(F.col("logprob") > 0).alias("positive"), F.count_if(F.col("logprob").isNull()).alias("missing")
    )
    both = header.select("lang", "n_gram").join(checks, "lang", "left")
    valid = (F.col("n_gram") == 3) & (F.coalesce("entries", F.lit(0)) > 0) & (F.col("bad_keys") + F.col("positive") + F.col("missing") == 0)
    return both.select("lang", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("entries", "bad_keys", "positive", "missing")), F.coalesce(valid, F.lit(False)).alias("valid"))


def corpus_report(phrases: DataFrame, langs=LANGS) -> DataFrame:
    """Per language: lines, tokens, unique tokens, trigrams, unique trigrams."""
    lines = phrases.groupBy("lang").agg(F.count("*").alias("lines"))
    words = count_words(phrases, 2, langs).groupBy("lang").agg(F.sum("cnt").alias("tokens"), F.count("*").alias("unique_tokens"))
    grams = count_trigrams(phrases, langs).groupBy("lang").agg(F.sum("cnt").alias("trigrams"), F.count("*").alias("unique_trigrams"))
    out = lines.join(words, "lang", "left").join(grams, "lang", "left")
    return out.select("lang", "lines", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "unique_tokens", "trigrams", "unique_trigrams")))


def stale_models(corpora: DataFrame, models: DataFrame) -> DataFrame:
    """(lang, changed, built, stale): models that are missing or older than the newest part of their corpus."""
    newest = corpora.groupBy("lang").agg(F.max("changed").alias("changed"))
    built = models.groupBy("lang").agg(F.max("built").alias("built"))
    out = newest.join(built, "lang", "left")
    return out.withColumn("stale", F.col("built").isNull() | (F.col("built") < F.col("changed")))


def rank_bands(unigrams: DataFrame) -> DataFrame:
    """``unigrams`` with the band of the word's rank: head, middle, tail, or none of them."""
    rank = F.col("rank")
    band = F.when(rank <= 4000, "head").when(rank.between(20_000, 40_000), "middle").when(rank >= 150_000, "tail").otherwise("between")
    return unigrams.withColumn("band", band)


def ambiguous_layouts(keys: DataFrame) -> DataFrame:
    """(layout_id, letters): layouts on which some letter sits on more than one key."""
    letters = keys.where(F.col("ch").rlike(r"^\p{L}$")).groupBy("layout_id", F.lower("ch").alias("ch")).agg(F.countDistinct("key").alias("keys"))
    return letters.where("keys > 1").groupBy("layout_id").agg(F.count("*").alias("letters"))
