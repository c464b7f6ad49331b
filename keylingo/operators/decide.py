"""Scoring layout hypotheses of tokens and deciding between them.

Everything works on a table of distinct tokens: natural text repeats few tokens
very often, so each is scored once and joined back by whoever needs it. A token
and its readings on other layouts are exploded into words and trigrams once,
looked up in one table that holds all languages side by side, and gathered into
one row again. From there on stages are columns of that row, and the cascade is
one ordered ``coalesce`` over them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CORRECTIONS, DEFAULT, HYPOTHESES, PREPOSITIONS, Thresholds
from ..functions import layouts as L
from ..functions import text as T
from ..functions.numbers import rounded
from ..sources.scratch import kept
from . import lexical as X

LANGS = ("en", "ru", "he")
ACTIVE = {"en": "us", "ru": "ru", "he": "he"}
#: Priors of hypotheses; Hebrew letters that a word doesn't end in, as they have final forms.
PRIORS = {"he_from_ru": -0.28, "ru_from_he": 0.06, "en_from_he": 0.08}
NON_FINAL = "כמנפצ"
#: One-letter words of Russian that always count as words.
RUSSIAN_PREPOSITIONS = (*PREPOSITIONS.values(), "с")
CORRECTION_NAMES = tuple(h[0] for h in CORRECTIONS)


@dataclass
class Models:
    """pieces(kind, piece, and for each language a struct of freq, builtin, listed, white, logprob), header(lang, floor, p50, p95)."""

    pieces: DataFrame
    header: DataFrame

    @classmethod
    def of(cls, lexicon: DataFrame, words: DataFrame, trigrams: DataFrame, header: DataFrame) -> Models:
        """From lexicon(lang, kind, word), words(lang, word, freq_score), trigrams(lang, gram, logprob) and their header."""
        kind = F.col("kind")
        none = F.lit(None)
        rows = lexicon.select(
            "lang", F.lit("w").alias("sort"), F.col("word").alias("piece"), none.cast("double").alias("freq"), (kind == "builtin").cast("int").alias("builtin"),
            F.lit(1).alias("listed"), (kind == "whitelist").cast("int").alias("white"), none.cast("double").alias("logprob"),
        )
        empty = [none.cast("int").alias(c) for c in ("builtin", "listed", "white")]
        rows = rows.unionByName(words.select("lang", F.lit("w").alias("sort"), F.col("word").alias("piece"), F.col("freq_score").alias("freq"), *empty, none.cast("double").alias("logprob")))
        rows = rows.unionByName(trigrams.select("lang", F.lit("g").alias("sort"), F.col("gram").alias("piece"), none.cast("double").alias("freq"), *empty, "logprob"))
        best = {x: F.struct(*(F.max(F.when(F.col("lang") == x, F.col(c))).alias(c) for c in ("freq", "builtin", "listed", "white", "logprob"))).alias(x) for x in LANGS}
        pieces = rows.where(F.col("lang").isin(*LANGS)).groupBy(F.col("sort").alias("kind"), "piece").agg(*best.values())
        return cls(pieces, header.where(F.col("lang").isin(*LANGS)).select("lang", "floor", "p50", "p95"))

    def kept(self, folder: str) -> Models:
        """The models written to a shared folder once: jobs read them, and their size is known to the optimizer."""
        out = []
        for name, df in (("pieces", self.pieces), ("header", self.header)):
            df.write.parquet(f"{folder}/{name}")
            out.append(df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}"))
        return Models(*out)


def _options(token: Column, script: Column, active=ACTIVE) -> Column:
    """All corrections of a token as an array, those that its script allows and that change it."""
    options = F.array(
        *(F.struct(F.lit(h).alias("hyp"), F.lit(s).alias("source"), F.lit(t).alias("target"), F.lit(n).alias("place"), L.convert(token, active[s], active[t]).alias("text")) for h, t, s, n in CORRECTIONS)
    )
    return F.filter(options, lambda o: (script.isNull() | (script == o["source"])) & (o["text"] != token))


def _busy(tokens: DataFrame) -> DataFrame:
    """Distinct tokens with their script, in more partitions than other shuffles have.

    They are little data, but much work a row, so adaptive execution shall not
    merge them; it would, in a shuffle of the usual number of partitions.
    """
    spread = 2 * int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = tokens.where(F.col("token").isNotNull()).select("token").repartition(spread, "token").distinct()
    return named.withColumn("script", T.dominant_script(F.col("token")))


def candidates(tokens: DataFrame, active=ACTIVE) -> DataFrame:
    """(token, script, hyp, source, target, place, text) of distinct tokens: corrections that the token's script allows and that change it."""
    return _busy(tokens).select("token", "script", F.explode(_options(F.col("token"), F.col("script"), active)).alias("o")).select("token", "script", "o.*")


def _prior(hyp: Column) -> Column:
    out = F.lit(0.0)
    for name, value in PRIORS.items():
        out = F.when(hyp == name, value).otherwise(out)
    return out


def _words(text: Column) -> Column:
    """The words of a text that are looked up, as (role, piece): runs of letters, and what stands between spaces without outer punctuation; once where these are the same."""

    def piece(role: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.lit(role).alias("role"), x.alias("piece"))

    runs = T.letter_words(text)
    spaced = F.filter(F.transform(F.split(F.lower(text), " +"), lambda w: F.regexp_replace(w, r"^\p{P}+|\p{P}+$", "")), lambda w: w != "")
    return F.when(runs == spaced, F.transform(runs, piece("both"))).otherwise(F.concat(F.transform(runs, piece("word")), F.transform(spaced, piece("spaced"))))


def scored_tokens(tokens: DataFrame, models: Models, active=ACTIVE, readings: bool = True) -> DataFrame:
    """(token, script, own, cands) of distinct tokens; null tokens are left out.

    ``own`` has for each language the token's scores in it: builtin, word and
    freq (shares and mean over its words), tri and norm (its trigrams), white
    (all of its words are whitelisted), nl (its posterior) and quality. ``cands``
    has the corrections with the scores of their text in their target language,
    the token's in their source (src_), quality with the hypothesis' prior, and q;
    without ``readings`` it is empty, for those who look at the token alone.
    Languages without a model have word and freq 0, tri -10 and norm 0.

    Trigrams are no more than a language's letters allow, so they come to the
    texts, which are in order of their token's hash and are summed where they
    are. Only words travel, one or few a text, as the lexicon may be of any size.
    """
    headers = {r["lang"]: r for r in models.header.collect()}  # a row a language
    token = F.col("token")
    as_is = F.array(F.struct(F.lit("as_is").alias("hyp"), F.lit("").alias("source"), F.lit("").alias("target"), F.lit(-1).alias("place"), token.alias("text")))
    busy = _busy(tokens)
    spread = 2 * int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = busy.select("token", "script", F.explode(F.concat(as_is, _options(token, F.col("script"), active)) if readings else as_is).alias("o"))
    rows = named.select("token", "script", "o.place", "o.text", F.regexp_replace(F.lower("o.text"), r"[^\p{L}]", "").alias("l"))
    grams = models.pieces.where("kind = 'g'").select(F.col("piece").alias("gram"), *(F.col(f"{x}.logprob").alias(f"{x}_logprob") for x in LANGS))
    rows = rows.select("token", "script", "place", "text", F.length("l").cast("long").alias("letters"), F.explode_outer(T.trigrams(F.col("l"))).alias("gram")).join(F.broadcast(grams), "gram", "left")
    keys = ["token", "script", "place", "text", "letters"]
    fits = [f(F.col(f"{x}_logprob")).alias(f"{x}_{n}") for x in LANGS for n, f in (("hit", F.count), ("sum", F.sum))]
    rows = rows.groupBy(*keys).agg(*fits)
    words = models.pieces.where("kind = 'w'").select("piece", *(F.col(f"{x}.{c}").alias(f"m_{x}_{c}") for x in LANGS for c in ("builtin", "listed", "freq", "white")))
    found = rows.select("*", F.explode_outer(_words(F.col("text"))).alias("p")).select("*", "p.*").drop("p").join(words, "piece", "left").repartition(spread, "token")
    spoken, spaced = F.col("role").isin("word", "both"), F.col("role").isin("spaced", "both")
    sums = [F.count_if(spoken).alias("n_words"), F.count_if(spaced).alias("n_spaced")]
    for x in LANGS:
        sums += [F.sum(F.when(spoken, F.col(f"m_{x}_{c}"))).alias(f"{x}_{c}") for c in ("builtin", "listed", "freq")]
        sums += [F.sum(F.when(spaced, F.col(f"m_{x}_white"))).alias(f"{x}_white"), *(F.max(f"{x}_{n}").alias(f"{x}_{n}") for n in ("hit", "sum"))]
    each = found.groupBy(*keys).agg(*sums)
    names = {"hyp": F.lit("as_is"), "source": F.lit(""), "target": F.lit("")}
    for h, t, s, n in CORRECTIONS:
        names = {c: F.when(F.col("place") == n, v).otherwise(names[c]) for c, v in (("hyp", h), ("source", s), ("target", t))}
    each = each.withColumns(names)
    size = F.col("letters")

    def zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    scores = []
    for x in LANGS:
        shares = [F.when(F.col("n_words") > 0, zero(f"{x}_{c}") / F.col("n_words")).otherwise(F.lit(0.0)).alias(name) for c, name in (("builtin", "builtin"), ("listed", "word"), ("freq", "freq"))]
        tri, norm = F.lit(-10.0), F.lit(0.0)
        if x in headers:
            floor, p50, p95 = (float(headers[x][c]) for c in ("floor", "p50", "p95"))
            tri = F.when(size < 3, floor * F.greatest(F.lit(1), size)).otherwise((F.coalesce(F.col(f"{x}_sum"), F.lit(0.0)) + (size - 2 - F.col(f"{x}_hit")) * floor) / (size - 2))
            norm = 1 / (1 + F.exp(-(tri - p50) / max(0.5, (p95 - p50) / 2)))
        scores.append(F.struct(*shares, tri.alias("tri"), norm.alias("norm"), ((F.col("n_spaced") > 0) & (zero(f"{x}_white") == F.col("n_spaced"))).alias("white")).alias(x))
    each = each.select("token", "script", "hyp", "source", "target", "place", "text", "letters", *scores)
    top = F.greatest(*(F.col(f"{x}.tri") for x in LANGS))
    whole = sum((F.exp(F.col(f"{x}.tri") - top) for x in LANGS), F.lit(0.0))
    rated = [
        F.struct(f"{x}.*", (F.exp(F.col(f"{x}.tri") - top) / whole).alias("nl"), X.quality_score(size, F.col(f"{x}.word"), F.col(f"{x}.freq"), F.col(f"{x}.norm")).alias("quality")).alias(x) for x in LANGS
    ]
    each = each.select("token", "script", "hyp", "source", "target", "place", "text", "letters", F.struct(*rated).alias("by"))
    gathered = each.groupBy("token", "script").agg(F.sort_array(F.collect_list(F.struct("place", "hyp", "source", "target", "text", "letters", "by"))).alias("all"))  # seven at most
    gathered = gathered.select("token", "script", F.element_at("all", 1)["by"].alias("own"), F.slice("all", 2, len(CORRECTIONS)).alias("rest"))

    def candidate(c: Column) -> Column:
        to, of = _under(c["by"], c["target"]), _under(F.col("own"), c["source"])
        quality = to["quality"] + _prior(c["hyp"])
        bonus = F.when((c["target"] == "ru") & token.rlike("[.,]") & ((to["word"] >= 0.8) | (to["freq"] >= 0.1)), 0.35).otherwise(0.0)
        return F.struct(
            c["place"].alias("place"), c["hyp"].alias("hyp"), c["source"].alias("source"), c["target"].alias("target"), c["text"].alias("text"), c["letters"].alias("letters"),
            *(to[f].alias(f) for f in ("builtin", "word", "freq", "tri", "norm", "white", "nl")), *(of[f].alias(f"src_{f}") for f in ("builtin", "word", "freq", "norm")),
            quality.alias("quality"), (quality - 0.05 + bonus).alias("q"),
        )

    return gathered.select("token", "script", "own", F.transform("rest", candidate).alias("cands"))


def _under(by: Column, lang: Column) -> Column:
    """The scores under a language that varies by row."""
    out = F.when(lang == LANGS[0], by[LANGS[0]])
    for x in LANGS[1:]:
        out = out.when(lang == x, by[x])
    return out


def _own(lang: Column | str, field: str) -> Column:
    own = F.col("own")
    return (own[lang] if isinstance(lang, str) else _under(own, lang))[field]


def _letters(token: Column) -> Column:
    return F.length(F.regexp_replace(token, r"[^\p{L}]", ""))


def _first(of: Column, *order: Callable[[Column], Column]) -> Column:
    """The element of an array that is greatest by an order."""
    return F.array_max(F.transform(of, lambda c: F.struct(*(f(c).alias(f"k{n}") for n, f in enumerate(order)), c.alias("c"))))["c"]


def _immediate(c: Column) -> Column:
    return (c["builtin"] >= 0.99) & (c["src_builtin"] <= 0.01)


def _best() -> Column:
    return _first(F.col("cands"), _immediate, lambda c: F.when(_immediate(c), -c["place"]), lambda c: rounded(c["q"], 9), lambda c: -c["place"])


def best_correction(scored: DataFrame) -> DataFrame:
    """(token, best, immediate): the first candidate that is all in a lexicon while nothing of the token is, else the best by q, ties by order."""
    out = scored.withColumn("best", _best()).where("best is not null")
    return out.withColumn("immediate", _immediate(F.col("best")))


def _collision(best: Column, automatic: bool) -> tuple[Column, Column]:
    """Rule and confidence by which a reading of a Hebrew token wins although the token is a Hebrew word."""
    strong = (best["src_builtin"] >= 0.99) | ((best["src_word"] >= 0.95) & (best["src_freq"] >= 0.55))
    by_list = best["white"] & (~strong if automatic else F.lit(True))
    weak = ~((best["src_builtin"] >= 0.99) & (best["src_word"] >= 0.95))
    odd = (_letters(F.col("token")) <= 4) | F.trim("token").rlike(f"[{NON_FINAL}]$") | (best["src_word"] < 0.90)
    by_frequency = weak & (best["word"] >= 0.90) & (best["freq"] >= 0.25) & (best["freq"] - best["src_freq"] >= (0.10 if automatic else 0.08)) & odd
    here = (F.col("script") == "he") & (best["source"] == "he")
    rule = F.when(here & by_list, "whitelist").when(here & by_frequency, "frequency")
    return rule, F.when(rule == "whitelist", 0.85 if automatic else 0.95).when(rule == "frequency", 0.82 if automatic else 0.90)


def resolve_hebrew_collision(scored: DataFrame, automatic: bool = True) -> DataFrame:
    """(token, hyp, text, rule, confidence) of Hebrew tokens whose best reading wins although the token is a Hebrew word.

    A whitelisted reading wins, unless in automatic mode the Hebrew word is
    strong; else a frequent enough reading of a weak, short or artefact-like
    Hebrew token does.
    """
    best = best_correction(scored)
    rule, sure = _collision(F.col("best"), automatic)
    return best.select("token", "best.hyp", "best.text", rule.alias("rule"), sure.alias("confidence")).where("rule is not null")


def _accepted(scored: DataFrame, th: Thresholds, automatic: bool) -> DataFrame:
    """``scored`` with best, immediate, as_is, margin, win and win_sure: the rule that accepts the best candidate, and its confidence, or nulls."""
    best, letters = F.col("best"), _letters(F.col("token"))
    margin = F.when(letters <= 3, th.short_word_margin).otherwise(th.long_word_margin)
    hebrew = F.when(letters <= 3, 0.10).otherwise(max(0.25, th.long_word_margin - 0.40))
    hebrew = F.when(F.trim("token").rlike(f"[{NON_FINAL}]$"), F.greatest(F.lit(0.10), hebrew - 0.10)).otherwise(hebrew)
    out = scored.withColumn("best", _best()).withColumn("immediate", _immediate(best)).withColumn("as_is", F.greatest(*(_own(x, "quality") for x in LANGS)))
    rule, sure = _collision(best, automatic)
    out = out.withColumns({"margin": F.when(F.col("script") == "he", hebrew).otherwise(margin), "collision": rule, "collision_sure": sure})
    wins = (best["q"] >= F.col("as_is") + F.col("margin")) & (best["word"] >= th.word_confidence_min)
    out = out.withColumn("win", F.when(F.col("immediate"), "immediate").when(F.col("collision").isNotNull(), F.col("collision")).when(wins, "margin"))
    sure = F.when(F.col("win").isin("immediate", "margin"), 0.95).when(F.col("win").isNotNull(), F.col("collision_sure"))
    return out.withColumn("win_sure", sure).drop("collision", "collision_sure")


def accept_correction(scored: DataFrame, th: Thresholds = DEFAULT, automatic: bool = True) -> DataFrame:
    """(token, hyp, text, as_is, margin, rule, confidence) of each token's best candidate; rule and confidence are null where it isn't accepted.

    Rules in order: immediate, the Hebrew collision rules, margin.
    """
    out = _accepted(scored, th, automatic).where("best is not null")
    return out.select("token", "best.hyp", "best.text", "as_is", "margin", F.col("win").alias("rule"), F.col("win_sure").alias("confidence"))


def _fast() -> Column:
    """struct(lang, confidence) where one trigram model is clearly best and script and lexicon agree, else null."""
    ranked = F.reverse(F.array_sort(F.array(*(F.struct(rounded(_own(x, "tri"), 9).alias("r"), F.lit(-n).alias("n"), F.lit(x).alias("lang"), _own(x, "tri").alias("tri")) for n, x in enumerate(LANGS)))))
    top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    good = (top["tri"] >= -8) & (F.col("script") == top["lang"]) & (top["lang"] != "he") & (_own(top["lang"], "word") >= 0.8) & (F.length("token") >= 4)
    return F.when(good, F.struct(top["lang"].alias("lang"), F.least(F.lit(1.0), 0.5 + 0.2 * (top["tri"] - second["tri"])).alias("confidence")))


def fast_language(scored: DataFrame) -> DataFrame:
    """(token, lang, confidence) where one model is clearly best (ties: en, ru, he) and script and lexicon agree; tokens of four characters or more."""
    return scored.select("token", _fast().alias("f")).where("f is not null").select("token", "f.*")


def _charsets(text: Column) -> Column:
    """For each language 1 if the text is of its characters, else 0."""
    return F.struct(*(F.when(T.charset_match(text, x), 1.0).otherwise(0.0).alias(x) for x in LANGS))


def _charset(text: Column, lang: Column) -> Column:
    """``_charsets`` under a language that varies by row, without looking at the others."""
    out = F.when(lang == LANGS[0], F.when(T.charset_match(text, LANGS[0]), 1.0).otherwise(0.0))
    for x in LANGS[1:]:
        out = out.when(lang == x, F.when(T.charset_match(text, x), 1.0).otherwise(0.0))
    return out


#: Names of hypotheses in order, which breaks ties.
_BY_NAME = sorted(h[0] for h in HYPOTHESES)


def _ensemble(context: Column) -> Column:
    """struct(hyp, lang, confidence): as-is and mapped hypotheses by weighted posterior, script, trigram and word scores; ``charset`` has the token's ``_charsets``."""
    token = F.col("token")

    def entry(hyp, name, lang, letters, scores, charset, mapped: int) -> Column:
        short = 0.05 * scores("nl") + 0.25 * charset + 0.55 * scores("word")
        long = 0.15 * scores("nl") + 0.20 * charset + 0.35 * scores("norm") + 0.30 * scores("word")
        total = F.when(letters <= 3, short).otherwise(long) - 0.2 * mapped + F.when(lang == context, 0.15).otherwise(0.0)
        return F.struct(F.lit(-mapped).alias("m"), (-name).alias("n"), hyp.alias("hyp"), lang.alias("lang"), total.alias("total"))

    def place(hyp: Column) -> Column:
        out = F.lit(len(_BY_NAME))
        for n, name in enumerate(_BY_NAME):
            out = F.when(hyp == name, n).otherwise(out)
        return out

    # what a lambda is given is computed once, what it names in an expression as often as it does
    as_is = F.get(F.transform(F.array(_letters(F.lower(token))), lambda n: F.array(*(entry(F.lit(x), F.lit(_BY_NAME.index(x)), F.lit(x), n, lambda f, x=x: _own(x, f), F.col("charset")[x], 0) for x in LANGS))), F.lit(0))
    pure = F.filter("cands", lambda c: _under(F.col("charset"), c["source"]) > 0)
    mapped = F.transform(pure, lambda c: entry(c["hyp"], place(c["hyp"]), c["target"], c["letters"], lambda f: c[f], _charset(c["text"], c["target"]), 1))
    # greatest first; of equal ones as-is before mapped, then by name
    by_rank = F.sort_array(F.transform(F.concat(as_is, mapped), lambda e: F.struct(rounded(e["total"], 9).alias("r"), *(e[c].alias(c) for c in ("m", "n", "hyp", "lang", "total")))), False)
    first = F.transform(F.array(by_rank), lambda r: F.struct(r[0]["hyp"].alias("hyp"), r[0]["lang"].alias("lang"), F.least(F.lit(1.0), 2 * (r[0]["total"] - r[1]["total"]) + 0.5).alias("confidence")))
    one = F.struct(F.lit("en").alias("hyp"), F.coalesce(context, F.lit("en")).alias("lang"), F.lit(0.5).alias("confidence"))
    return F.when(F.length(token) == 1, one).otherwise(F.get(first, F.lit(0)))


def ensemble_language(scored: DataFrame, context: str | None = None) -> DataFrame:
    """(token, hyp, lang, confidence) of the best hypothesis; ``context`` names a column with the language before the token, which counts 0.15 more."""
    return scored.withColumn("charset", _charsets(F.col("token"))).select("token", _ensemble(F.col(context) if context else F.lit(None).cast("string")).alias("e")).select("token", "e.*")


def _rule(c: Column, th: Thresholds) -> Column:
    """The first rule that accepts a candidate, or null."""
    prepositions = F.lower(c["text"]).isin(*RUSSIAN_PREPOSITIONS) & (c["target"] == "ru")
    word = (c["word"] >= th.target_word_min) & ((c["word"] >= c["src_word"] + th.target_word_margin) | (c["freq"] >= c["src_freq"] + th.target_word_margin))
    short = (c["freq"] >= 0.45) & (c["freq"] >= c["src_freq"] + th.target_freq_margin) & (_letters(F.col("token")) <= 3)
    fits = (c["norm"] >= th.target_norm_min) & (c["norm"] >= c["src_norm"] + th.target_norm_margin) & ((c["freq"] >= c["src_freq"]) | (c["word"] >= 0.60))
    return F.when(prepositions, "preposition").when(_immediate(c), "lexicon").when(word, "word").when(short, "short").when(fits, "trigrams")


def _ruled(th: Thresholds) -> Column:
    """``cands`` with the rule that accepts each."""
    return F.transform("cands", lambda c: c.withField("rule", _rule(c, th)))


def _sure(rule: Column, base: Column) -> Column:
    floor = F.when(rule.isin("preposition", "lexicon"), 0.90).when(rule.isin("word", "short"), 0.85).when(rule == "trigrams", 0.80)
    return F.when(rule.isNotNull(), F.greatest(base, floor))


def validate_correction(scored: DataFrame, base: float = 0.0, th: Thresholds = DEFAULT) -> DataFrame:
    """(token, hyp, text, rule, confidence) of every candidate: the first rule that accepts it; both null if none does."""
    each = scored.select("token", F.explode("cands").alias("c")).withColumn("rule", _rule(F.col("c"), th))
    return each.select("token", "c.hyp", "c.text", "rule", _sure(F.col("rule"), F.lit(base)).alias("confidence"))


def _heuristic(base: Column, th: Thresholds) -> Column:
    """struct(hyp, lang, confidence, text, rule) of the first valid candidate, as ``_ruled`` has them, of a token that is no word of its script's language, else null."""
    weak = F.col("script").isNotNull() & (_own(F.col("script"), "word") < th.source_word_conf_max)
    valid = F.get(F.filter("cands", lambda c: ((c["source"] != "ru") | (c["target"] == "en")) & c["rule"].isNotNull()), F.lit(0))
    made = F.struct(valid["hyp"].alias("hyp"), valid["target"].alias("lang"), _sure(valid["rule"], F.greatest(F.lit(th.base_conf_min), base)).alias("confidence"), valid["text"].alias("text"), valid["rule"].alias("rule"))
    return F.when(weak & valid.isNotNull(), made)


def heuristic_correction(scored: DataFrame, th: Thresholds = DEFAULT, base: Column | float = 0.0) -> DataFrame:
    """(token, hyp, text, target, rule, confidence): the first valid candidate, in order, of tokens that are no words of their script's language; from ru only to en."""
    found = scored.withColumn("cands", _ruled(th)).select("token", _heuristic(base if isinstance(base, Column) else F.lit(base), th).alias("h")).where("h is not null")
    return found.select("token", "h.hyp", "h.text", F.col("h.lang").alias("target"), "h.rule", "h.confidence")


def _model(predicted: Column, sure: Column, baseline: Column, th: Thresholds) -> tuple[Column, Column]:
    """struct(hyp, lang, confidence, text) that a classifier's prediction leads to, or null; and whether its script forbids any other correction."""
    source = F.lit(None).cast("string")
    for h, _, s, _ in CORRECTIONS:
        source = F.when(predicted == h, s).otherwise(source)
    asked = source.isNotNull() & (sure > th.correction)
    forbidden = F.coalesce(asked & (F.col("script") != source), F.lit(False))

    def valid(c: Column) -> Column:
        preposition = F.lower(c["text"]).isin(*RUSSIAN_PREPOSITIONS) & (c["target"] == "ru")
        short = (c["word"] >= th.target_word_min) & (c["freq"] >= c["src_freq"] + th.target_freq_margin)
        longer = (
            ((c["word"] >= th.target_word_min) & (c["word"] >= c["src_word"] + th.target_word_margin))
            | ((c["freq"] >= c["src_freq"] + th.target_freq_margin) & (c["word"] >= 0.60))
            | ((c["norm"] >= th.target_norm_min) & (c["norm"] >= c["src_norm"] + th.target_norm_margin) & ((c["freq"] >= c["src_freq"]) | (c["word"] >= 0.60)))
        )
        return preposition | F.when(c["letters"] <= 3, short).otherwise(longer)

    # of an unknown script only the predicted correction counts
    rivals = F.filter("cands", lambda c: (c["source"] == source) & (F.col("script").isNotNull() | (c["hyp"] == predicted)) & valid(c))
    pick = _first(rivals, lambda c: rounded(c["quality"] + F.when(c["hyp"] == predicted, 0.12).otherwise(0.0), 9), lambda c: (c["hyp"] != predicted), lambda c: -c["place"])
    corrected = F.when(asked & ~forbidden & pick.isNotNull(), F.struct(pick["hyp"].alias("hyp"), pick["target"].alias("lang"), F.greatest(sure, F.lit(0.90)).alias("confidence"), pick["text"].alias("text")))
    plain = predicted.isin(*LANGS) & (sure > baseline) & (sure > th.deep_min)
    as_is = F.when(plain, F.struct(predicted.alias("hyp"), predicted.alias("lang"), sure.alias("confidence"), F.col("token").alias("text")))
    return F.coalesce(corrected, as_is), forbidden


def model_correction(scored: DataFrame, predictions: DataFrame, baseline: float = 0.5, th: Thresholds = DEFAULT) -> DataFrame:
    """(token, hyp, lang, confidence, text) from a classifier's (token, predicted, confidence), a row a token.

    A predicted correction needs confidence, a script that allows it and a valid
    reading; another valid reading takes its place if it is better by 0.12. A
    predicted language as it is counts only when it is surer than the baseline
    and than ``deep_min``.
    """
    seen = predictions.select("token", "predicted", F.col("confidence").alias("sure"))
    made, _ = _model(F.col("predicted"), F.col("sure"), F.lit(baseline), th)
    return scored.join(seen, "token").select("token", made.alias("m")).where("m is not null").select("token", "m.*")


def rule_key(token: Column) -> Column:
    """What rules are looked up by: the token without white space and line ends around it, in lower case."""
    return F.lower(F.regexp_replace(token, r"(?U)^\s+|\s+$", ""))


def apply_rules(tokens: DataFrame, rules: DataFrame, automatic: bool = True, active=ACTIVE) -> DataFrame:
    """``tokens`` with rule: struct(path, hyp, lang, confidence, text) where a dictionary rule (token, action, hyp) decides, else null.

    Rules are looked up by the trimmed token in lower case, on either side. ``keepAsIs`` keeps the
    token, in automatic mode only; ``preferHypothesis`` converts it if that
    changes it; ``none`` and ``preferLanguage`` decide nothing. Of several rules
    of a token the greatest by (action, hyp) counts. Scope and match mode don't
    matter for the lookup.
    """
    token = F.col("token")
    known = rules.where("token is not null").groupBy(rule_key(F.col("token")).alias("__rule")).agg(F.max(F.struct("action", "hyp")).alias("__r"))
    out = tokens.join(known, rule_key(token) == F.col("__rule"), "left")
    keeps = F.col("__r.action") == "keepAsIs"
    script = F.coalesce(T.dominant_script(token), F.lit("en"))
    converted, target = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, t, s, _ in HYPOTHESES:
        converted = F.when(F.col("__r.hyp") == h, L.convert(token, active[s or "en"], active[t])).otherwise(converted)
        target = F.when(F.col("__r.hyp") == h, t).otherwise(target)
    keep = F.when(keeps & F.lit(automatic), F.struct(F.lit("rule_keep").alias("path"), script.alias("hyp"), script.alias("lang"), F.lit(1.0).alias("confidence"), token.alias("text")))
    prefer = F.when(
        (F.col("__r.action") == "preferHypothesis") & (converted != token),
        F.struct(F.lit("rule_prefer").alias("path"), F.col("__r.hyp").alias("hyp"), target.alias("lang"), F.lit(1.0).alias("confidence"), converted.alias("text")),
    )
    return out.withColumn("rule", F.coalesce(keep, prefer)).drop("__rule", "__r")


def override_events(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, event) for every token that a user corrects by hand although a rule keeps it: overrides, from which rules are unlearned."""
    kept = rules.where("action = 'keepAsIs'").select(rule_key(F.col("token")).alias("__rule")).distinct()
    return tokens.join(kept, rule_key(F.col("token")) == F.col("__rule"), "left_semi").select("token", F.lit("override").alias("event"))


def preposition_map(tokens: DataFrame, dim: DataFrame, col: str = "token") -> DataFrame:
    """``tokens`` that are one-letter prepositions of another layout, with word: the dim's (token, word), in the token's case."""
    pairs = dim.select(F.col("token").alias("__typed"), F.col("word").alias("__word"))
    out = tokens.join(pairs, F.lower(F.col(col)) == F.col("__typed"))
    return out.withColumn("word", F.when(F.col(col) == F.col("__typed"), F.col("__word")).otherwise(F.upper("__word"))).drop("__typed", "__word")


def route(tokens: DataFrame, models: Models, rules: DataFrame, th: Thresholds = DEFAULT, predictions: DataFrame | None = None, automatic: bool = True) -> DataFrame:
    """(token, path, hyp, lang, confidence, text) of distinct tokens: the first stage of the cascade that decides, and the text it gives.

    Order: rules, mixed script, technical token, whitelist, Russian lock, scored
    correction, then a baseline (fast language, else the ensemble, standard or
    fallback), which if it is a correction must be valid; the classifier's
    prediction, heuristic correction, and the baseline as it is. In manual mode
    kept tokens, technical ones and Russian words are corrected too. With a
    column ``last_lang`` tokens are distinct by it as well, and the language of
    the last correction counts in the ensemble. ``predictions`` is (token,
    predicted, confidence), a row a token at most.
    """
    token, script = F.col("token"), F.col("script")
    keys = ["token", "last_lang"] if "last_lang" in tokens.columns else ["token"]
    # rules come first, and what they decide needs no scores; they and predictions meet the bare tokens, as scores are wide
    ruled = kept(apply_rules(tokens.where("token is not null").select(*keys).distinct(), rules, automatic), "ruled")
    left = ruled.where("rule is null").select(*keys)
    frame = scored_tokens(left, models)
    if len(keys) > 1 or predictions is not None:
        if predictions is not None:
            left = left.join(predictions.select("token", "predicted", F.col("confidence").alias("sure")), "token", "left")
        frame = left.join(frame, "token")
    if len(keys) == 1:
        frame = frame.withColumn("last_lang", F.lit(None).cast("string"))
    if predictions is None:
        frame = frame.withColumns({"predicted": F.lit(None).cast("string"), "sure": F.lit(None).cast("double")})
    frame = _accepted(frame.withColumn("cands", _ruled(th)), th, automatic)
    win = F.struct(F.col("best.hyp").alias("hyp"), F.col("best.target").alias("lang"), F.col("win_sure").alias("confidence"), F.col("best.text").alias("text"))
    frame = frame.withColumn("scored", F.when(F.col("win_sure") >= th.standard_path, win))
    frame = frame.withColumns({"fast": _fast(), "charset": _charsets(token)}).withColumn("ensemble", F.when(F.coalesce(F.col("fast.confidence") >= th.fast_path, F.lit(False)), F.lit(None)).otherwise(_ensemble(F.col("last_lang"))))
    named = lambda path, s: F.struct(path.alias("path"), s["hyp"].alias("hyp"), s["lang"].alias("lang"), s["confidence"].alias("confidence"), s["text"].alias("text"))
    of_fast = F.struct(F.lit("fast").alias("path"), F.col("fast.lang").alias("hyp"), F.col("fast.lang").alias("lang"), F.col("fast.confidence").alias("confidence"), token.alias("text"))
    chosen = F.get(F.filter("cands", lambda c: c["hyp"] == F.col("ensemble.hyp")), F.lit(0))
    frame = frame.withColumn("chosen", chosen)
    level = F.when(F.col("ensemble.confidence") >= th.standard_path, "standard").otherwise("fallback")
    of_both = F.struct(level.alias("path"), F.col("ensemble.hyp").alias("hyp"), F.col("ensemble.lang").alias("lang"), F.col("ensemble.confidence").alias("confidence"), F.coalesce("chosen.text", "token").alias("text"))
    frame = frame.withColumn("base", F.when(F.col("ensemble").isNull(), of_fast).otherwise(of_both))
    frame = frame.withColumn("chosen_rule", F.col("chosen.rule"))
    valid = F.struct(F.lit("validated").alias("path"), F.col("base.hyp").alias("hyp"), F.col("base.lang").alias("lang"), _sure(F.col("chosen_rule"), F.col("base.confidence")).alias("confidence"), F.col("base.text").alias("text"))
    model, forbidden = _model(F.col("predicted"), F.col("sure"), F.col("base.confidence"), th)
    frame = frame.withColumns({"model": model, "forbidden": forbidden, "guess": _heuristic(F.col("base.confidence"), th)})

    def keep(path: str, when: Column, lang: Column) -> Column:
        return F.when(when, F.struct(F.lit(path).alias("path"), lang.alias("hyp"), lang.alias("lang"), F.lit(1.0).alias("confidence"), token.alias("text")))

    listed = F.lit(None).cast("string")
    for x in reversed(LANGS):
        listed = F.when(_own(x, "white"), x).otherwise(listed)
    stages = (
        keep("mixed", T.mixed_script(token).isNotNull(), T.mixed_script(token)),
        keep("technical", T.technical_kind(token).isNotNull() & F.lit(automatic), F.lit("en")),
        keep("whitelist", listed.isNotNull(), listed),
        keep("russian", (script == "ru") & (_own("ru", "word") >= th.source_word_conf_max) & F.lit(automatic), F.lit("ru")),
        F.when(F.col("scored").isNotNull(), named(F.lit("scored"), F.col("scored"))),
        F.when(F.col("base.hyp").isin(*CORRECTION_NAMES) & F.col("chosen_rule").isNotNull(), valid),
        F.when(F.col("model").isNotNull(), named(F.lit("model"), F.col("model"))),
        F.when(F.col("guess").isNotNull() & ~F.col("forbidden"), named(F.lit("heuristic"), F.col("guess"))),
        F.col("base"),
    )
    return frame.select(*keys, F.coalesce(*stages).alias("d")).select(*keys, "d.*").unionByName(ruled.where("rule is not null").select(*keys, "rule.*"))


def apply_decision(decisions: DataFrame, threshold: float = DEFAULT.correction) -> DataFrame:
    """``decisions`` with the output: the converted text where a correction is confident enough, else the token."""
    corrects = F.col("hyp").isin([h[0] for h in CORRECTIONS]) & (F.col("confidence") >= threshold)
    return decisions.withColumn("output", F.when(corrects, F.col("text")).otherwise(F.col("token")))


def choose_variant(variants: DataFrame, lexicon: DataFrame, key: str = "token") -> DataFrame:
    """(key, src, dst, result, in_lexicon): among a token's readings (priority, result) the first that is a builtin word, else the first."""
    builtin = lexicon.where("kind = 'builtin'").select(F.col("word").alias("__word")).distinct()
    marked = variants.join(builtin, F.lower("result") == F.col("__word"), "left").withColumn("in_lexicon", F.col("__word").isNotNull())
    best = Window.partitionBy(key).orderBy(F.desc("in_lexicon"), "priority")
    return marked.withColumn("__at", F.row_number().over(best)).where("__at = 1").select(key, "src", "dst", "result", "in_lexicon")
