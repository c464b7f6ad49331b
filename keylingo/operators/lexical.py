"""Lexical scores: texts against lexicons, word frequencies and trigram models.

Texts are exploded once, equal pieces of a text are counted before the join, and
the model side is small for a language; its broadcast is left to the optimizer,
which checks the size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import kept
from .models import LANGS

#: Words of a model that are brought to the texts; the others are joined.
HEAD = 131_072


def _by_language(df: DataFrame, langs) -> DataFrame:
    """Every row once for each language."""
    return df.withColumn("lang", F.explode(F.array(*(F.lit(x) for x in langs))))


def word_sums(df: DataFrame, model: DataFrame, values: list[str], key: str, col: str) -> DataFrame:
    """(key, total, values): how many words the texts of a key have, and the sum over them of each of the model's (word, values, weight), a row a word.

    The model's ``HEAD`` words of most weight come to the texts, whose words are
    summed where they are. What is left of a text, its rare and unknown words,
    is written once and meets the rest of the model in a join.
    """
    model = kept(model.where("word is not null").select("word", "weight", *values), "word-model")
    head = kept(model.orderBy(F.desc("weight"), "word").limit(HEAD).select("word", *values, F.lit(True).alias("__met")), "word-head")
    each = df.select(key, F.explode(T.letter_words(F.col(col))).alias("word")).join(F.broadcast(head), "word", "left")
    rest = F.when(F.col("__met").isNull(), F.col("word")).alias("word")
    met = kept(each.groupBy(key, rest).agg(F.count("*").alias("total"), *(F.sum(v).alias(v) for v in values)), "words-met")
    tail = model.join(F.broadcast(head.select("word")), "word", "left_anti")
    more = met.where("word is not null").select(key, "word", F.col("total").alias("__n")).join(tail, "word")
    more = more.select(key, F.lit(0).cast("long").alias("total"), *((F.col("__n") * F.col(v)).alias(v) for v in values))
    return met.select(key, "total", *values).unionByName(more).groupBy(key).agg(F.sum("total").alias("total"), *(F.sum(v).alias(v) for v in values))


def _shares(sums: DataFrame, key: str, of: dict[str, Column], name: str) -> DataFrame:
    """(key, lang, name): the sum of each language by the number of words; null keys have none."""
    share = lambda c: F.when(F.col(key).isNotNull(), F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0)) / F.col("total")
    each = F.array(*(F.struct(F.lit(x).alias("lang"), share(c.cast("double")).alias(name)) for x, c in of.items()))
    return sums.select(key, F.explode(each).alias("s")).select(key, "s.*")


def word_confidence(df: DataFrame, lexicon: DataFrame, key: str = "doc_id", col: str = "text", langs=LANGS) -> DataFrame:
    """(key, lang, word_conf): the share of a text's words in each language's list, the best of its kinds. A column cnt of the lexicon tells which words are frequent."""
    kinds = [r["kind"] for r in lexicon.select("kind").distinct().orderBy("kind").collect()]  # a row a kind
    flags = {f"f{n}_{k}": F.max(F.when((F.col("lang") == x) & F.col("kind").eqNullSafe(F.lit(kind)), 1)) for n, x in enumerate(langs) for k, kind in enumerate(kinds)}
    weight = F.sum("cnt") if "cnt" in lexicon.columns else F.count("*")
    model = lexicon.groupBy("word").agg(weight.alias("weight"), *(c.alias(name) for name, c in flags.items()))
    sums = word_sums(df, model, list(flags), key, col)
    best = {x: F.greatest(F.lit(0), *(F.coalesce(F.col(f"f{n}_{k}"), F.lit(0)) for k in range(len(kinds)))) if kinds else F.lit(0) for n, x in enumerate(langs)}
    return _shares(sums, key, best, "word_conf")


def whitelisted_language(df: DataFrame, whitelist: DataFrame, order=("en", "ru", "he"), key: str = "doc_id", col: str = "text") -> DataFrame:
    """(key, lang): the first language whose list holds every space-separated word, without outer punctuation."""
    words = df.select(key, F.explode(F.split(F.lower(col), " +")).alias("word"))
    words = words.withColumn("word", F.regexp_replace("word", r"^\p{P}+|\p{P}+$", "")).where("word <> ''")
    total = words.groupBy(key).agg(F.count("*").alias("total"))
    hits = words.join(whitelist.select("lang", "word").distinct(), "word").groupBy(key, "lang").agg(F.count("*").alias("hits"))
    full = total.join(hits, key).where("hits = total")
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("lang"))
    return full.groupBy(key).agg(F.min_by("lang", place).alias("lang"))


def trigram_score(df: DataFrame, trigrams: DataFrame, header: DataFrame, key: str = "doc_id", col: str = "text", langs=LANGS) -> DataFrame:
    """(key, lang, grams, score): mean log-probability under each language, the floor for unseen trigrams.

    Texts of under three letters score floor * max(1, letters).
    """
    return trigram_scores(df, {"score": (trigrams, header)}, key, col, langs)


def trigram_scores(df: DataFrame, models: dict[str, tuple[DataFrame, DataFrame]], key: str = "doc_id", col: str = "text", langs=LANGS) -> DataFrame:
    """(key, lang, grams, names): ``trigram_score`` by several models (trigrams, header), each under its name; the texts are gone over once for all."""
    letters = df.select(key, F.regexp_replace(F.lower(col), r"[^\p{L}]", "").alias("letters"))
    # a text's trigrams are summed where they are: the models, small and of known size when they are tables, come to them
    named = [t.select("gram", "lang", "logprob", F.lit(n).alias("__model")) for n, (t, _) in enumerate(models.values())]
    each = [(n, x) for n in range(len(named)) for x in langs]
    here = lambda n, x: (F.col("lang") == x) & (F.col("__model") == n)
    by_gram = reduce(DataFrame.unionByName, named).groupBy("gram").agg(*(F.max(F.when(here(n, x), F.col("logprob"))).alias(f"m{n}_{x}") for n, x in each))
    found = letters.select(key, F.explode(T.trigrams(F.col("letters"))).alias("gram")).join(by_gram, "gram")
    sums = found.groupBy(key).agg(*(f(F.col(f"m{n}_{x}")).alias(f"{c}{n}_{x}") for n, x in each for c, f in (("hit", F.count), ("sum", F.sum))))
    per = F.array(*(F.struct(F.lit(x).alias("lang"), *(F.col(f"{c}{n}_{x}").alias(f"{c}{n}") for n in range(len(named)) for c in ("hit", "sum"))) for x in langs))
    seen = sums.select(key, F.explode(per).alias("s")).select(key, "s.*")
    out = _by_language(letters.select(key, F.length("letters").cast("long").alias("size")), langs)
    for n, (_, header) in enumerate(models.values()):
        out = out.join(header.select("lang", F.col("floor").alias(f"floor{n}")), "lang")
    out = out.join(seen, [key, "lang"], "left")
    count = F.greatest(F.col("size") - 2, F.lit(0))

    def score(n: int) -> Column:
        floor, missed = F.col(f"floor{n}"), (count - F.coalesce(f"hit{n}", F.lit(0))) * F.col(f"floor{n}")
        return F.when(F.col("size") < 3, floor * F.greatest(F.lit(1), F.col("size"))).otherwise((F.coalesce(f"sum{n}", F.lit(0.0)) + missed) / count)

    return out.select(key, "lang", count.alias("grams"), *(score(n).alias(name) for n, name in enumerate(models)))


def normalized_score(scores: DataFrame, header: DataFrame) -> DataFrame:
    """``scores`` with norm = sigmoid((score - p50) / max(0.5, (p95 - p50) / 2))."""
    scale = F.greatest(F.lit(0.5), (F.col("p95") - F.col("p50")) / 2)
    out = scores.join(header.select("lang", "p50", "p95"), "lang")
    return out.withColumn("norm", 1 / (1 + F.exp(-(F.col("score") - F.col("p50")) / scale))).drop("p50", "p95")


def frequency_score(df: DataFrame, scored_words: DataFrame, key: str = "doc_id", col: str = "text", langs=LANGS) -> DataFrame:
    """(key, lang, freq): mean frequency score of a text's words in each language, 0 for unknown words."""
    values = {f"f{n}": F.sum(F.when(F.col("lang") == x, F.col("freq_score"))) for n, x in enumerate(langs)}
    model = scored_words.groupBy("word").agg(F.max("freq_score").alias("weight"), *(c.alias(name) for name, c in values.items()))
    return _shares(word_sums(df, model, list(values), key, col), key, {x: F.col(f"f{n}") for n, x in enumerate(langs)}, "freq")


def language_posterior(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """``scores`` with the softmax of a text's scores over the languages."""
    whole = Window.partitionBy(key)
    weight = F.exp(F.col("score") - F.max("score").over(whole))
    return scores.withColumn("__w", weight).withColumn("posterior", F.col("__w") / F.sum("__w").over(whole)).drop("__w")


def best_language(scores: DataFrame, key: str = "doc_id", by: str = "score") -> DataFrame:
    """(key, predicted, margin): the language with the best score, ties by name, and its lead."""
    ranked = scores.withColumn("__at", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), "lang")))
    first, second = (F.max(F.when(F.col("__at") == n, F.col(by))) for n in (1, 2))
    return ranked.where("__at <= 2").groupBy(key).agg(F.max(F.when(F.col("__at") == 1, F.col("lang"))).alias("predicted"), (first - F.coalesce(second, first)).alias("margin"))


def quality_score(letters, word, freq, norm):
    """Weighted word confidence, frequency and trigram fit; short tokens go by words and frequency alone."""
    return F.when(letters <= 3, 1.6 * word + 1.6 * freq).otherwise(1.2 * word + 1.0 * freq + 0.6 * norm)
