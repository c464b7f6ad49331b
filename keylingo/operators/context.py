"""Neighbouring tokens: sentences, the language around a token, second thoughts about the one before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions import layouts as L
from ..functions import text as T
from ..sources.scratch import kept
from . import blocks as S
from . import lexical as X


#: Places of the broadcast table that tells which segments may have another choice than the usual one; it never has more rows.
SLOTS = 1_048_576


def _keys(by: str | Sequence[str]) -> tuple[str, ...]:
    return (by,) if isinstance(by, str) else tuple(by)


def sentence_ids(tokens: DataFrame, by: str = "stream_id", order=("seq",), pause: float = 2.0, parts: int | None = None) -> DataFrame:
    """``tokens`` with sentence: counted up after a token that ends one and after a pause (``ts`` in seconds)."""
    keys = _keys(by)
    rows, at = S.dealt(tokens, keys, order, parts), F.struct(*order)
    ends = F.coalesce(F.col("token").rlike(r"[.!?][\p{P}]*$"), F.lit(False))
    edge = F.struct(ends.alias("ends"), F.col("ts").alias("ts"))
    last = S.summaries(rows, keys, F.max_by(edge, at).alias("__edge")).withColumn("__edge", F.lag("__edge").over(S.along(keys)))
    before = F.coalesce(F.lag(edge).over(S.inside(keys, order)), F.col("__edge"))
    new = F.coalesce(before["ends"], F.lit(False)) | F.coalesce(F.col("ts") - before["ts"] > pause, F.lit(False))
    flagged = S.carried(rows, last, keys).withColumn("__new", new.cast("long")).drop("__edge")
    local = kept(flagged.withColumn("__local", F.sum("__new").over(S.inside(keys, order).rowsBetween(Window.unboundedPreceding, 0))).drop("__new"), "sentences")
    earlier = S.along(keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = S.summaries(local, keys, F.max("__local").alias("__n")).withColumn("__n", F.sum("__n").over(earlier))
    out = S.carried(local, sums, keys).withColumn("sentence", F.col("__local") + F.coalesce("__n", F.lit(0)))
    return out.drop("__local", "__n", *_own(tokens))


def last_language(tokens: DataFrame, by: str = "stream_id", order=("seq",), parts: int | None = None) -> DataFrame:
    """``tokens`` with last_lang: the target of the latest applied correction before."""
    keys = _keys(by)
    rows, applied = S.dealt(tokens, keys, order, parts), F.when(F.col("applied"), F.col("lang"))
    latest = S.summaries(rows, keys, F.max_by(applied, F.when(applied.isNotNull(), F.struct(*order))).alias("__lang"))
    latest = latest.withColumn("__lang", F.last_value("__lang", True).over(S.along(keys).rowsBetween(Window.unboundedPreceding, -1)))
    here = F.last_value(applied, True).over(S.inside(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    return S.carried(rows, latest, keys).withColumn("last_lang", F.coalesce(here, "__lang")).drop("__lang", *_own(tokens))


def sentence_dominant(tokens: DataFrame, by: str = "stream_id", order=("seq",), threshold: float = DEFAULT.correction, parts: int | None = None) -> DataFrame:
    """``tokens`` with sentence_lang, the first confident language so far, and agreeing, how many confident words are of it."""
    keys = (*_keys(by), "sentence")
    rows = S.dealt(tokens, _keys(by), order, parts).withColumn("__sure", F.when(F.col("confidence") > threshold, F.col("lang")))
    counted = S.summaries(rows, keys, F.min_by("__sure", F.when(F.col("__sure").isNotNull(), F.struct(*order))).alias("__first"))
    earlier = S.along(keys).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("__own", F.first_value("__first", True).over(S.along(keys).rowsBetween(Window.unboundedPreceding, 0)))
    # how often each block has the language that leads by then; a later block has the same one
    led = S.carried(rows, counted.select(*keys, S.BLOCK, "__own"), keys).where(F.col("__sure") == F.col("__own")).groupBy(*keys, S.BLOCK).agg(F.count("*").alias("__n"))
    carries = S.carried(counted, led, keys).select(
        *keys, S.BLOCK, F.first_value("__first", True).over(earlier).alias("__lead"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n")
    )
    so_far = S.inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    out = S.carried(rows, carries, keys).withColumn("sentence_lang", F.coalesce("__lead", F.first_value("__sure", True).over(so_far)))
    same = F.coalesce(F.col("__sure") == F.col("sentence_lang"), F.lit(False)).cast("long")
    out = out.withColumn("__same", same).withColumn("agreeing", F.coalesce("__n", F.lit(0)) + F.sum("__same").over(so_far))
    return out.drop("__sure", "__same", "__lead", "__n", *_own(tokens))


def context_boost(tokens: DataFrame, by: str = "stream_id", order=("seq",), th: Thresholds = DEFAULT, threshold: float | None = None, parts: int | None = None) -> DataFrame:
    """``tokens`` with decision: applied, boosted by the next word, preposition before a Russian word, or null.

    A word below the threshold waits if it is sure enough or may be a one-letter
    preposition; the next word of the sentence decides within the timeout.
    """
    limit = th.correction if threshold is None else threshold
    keys = (*_keys(by), "sentence")
    rows, edge = S.dealt(tokens, _keys(by), order, parts), F.struct("lang", "confidence", "ts")
    nexts = S.summaries(rows, keys, F.min_by(edge, F.struct(*order)).alias("__next")).withColumn("__next", F.lead("__next").over(S.along(keys)))
    rows = S.carried(rows, nexts, keys).withColumn("__next", F.coalesce(F.lead(edge).over(S.inside(keys, order)), F.col("__next")))
    following, sure, ts = (F.col(f"__next.{c}") for c in ("lang", "confidence", "ts"))
    soon = ts - F.col("ts") <= th.pending_timeout
    prep = F.lower("token").isin(list("fdrjebz"))
    decision = (
        F.when(F.col("confidence") > limit, "applied")
        .when(soon & prep & (following == "ru"), "preposition")
        .when(soon & (F.col("confidence") >= th.pending_min) & (sure > limit) & (following == F.col("lang")) & (F.col("confidence") + th.context_boost > limit), "boosted")
    )
    return rows.withColumn("decision", decision).drop("__next", *_own(tokens))


def _own(tokens: DataFrame) -> tuple[str, ...]:
    """The block column, if it isn't the caller's."""
    return () if S.BLOCK in tokens.columns else (S.BLOCK,)


def dominant_override(tokens: DataFrame, least: int = 2) -> DataFrame:
    """``tokens`` with override: short words inside a sentence of another language whose reading in that language is much more common."""
    letters = F.length(F.regexp_replace("token", r"[^\p{L}]", ""))
    turns = (letters <= 2) & (letters > 0) & (F.col("agreeing") >= least) & (F.col("sentence_lang") != F.col("lang"))
    good = (F.col("target_score") >= 0.70) & (F.col("target_score") >= F.col("source_score") + 0.25)
    return tokens.withColumn("override", F.coalesce(turns & good, F.lit(False)))


def useful_words(scored_words: DataFrame) -> DataFrame:
    """(word, best): the best language's score of each word; English hits under 0.20 don't count."""
    return scored_words.where((F.col("lang") != "en") | (F.col("freq_score") >= 0.20)).groupBy("word").agg(F.max("freq_score").alias("best"))


def phrase_frequency_score(texts: DataFrame, scored_words: DataFrame, key: str = "key", col: str = "text") -> DataFrame:
    """(key, score): the sum over words of the best language's score; English hits under 0.20 don't count."""
    hits = X.word_sums(texts, useful_words(scored_words).withColumn("weight", F.col("best")), ["best"], key, col).select(key, F.col("best").alias("score"))
    return texts.select(key).join(hits, key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))


def scored_readings(tokens: DataFrame, scored_words: DataFrame, src: str, dst: str) -> DataFrame:
    """(token, whole, split, s_token, s_whole, s_split): distinct tokens of ``tokens``, their readings, and the phrase frequency scores of all three.

    Tokens are shuffled once, to be distinct, and scored where they are then:
    the words, which a cut lexicon bounds (200,000 a language), come to them.
    """
    read = lambda df: df.withColumns({"whole": L.convert(F.col("token"), src, dst), "split": split_reading(F.col("token"), src, dst)})
    same = F.col("split") == F.col("whole")
    texts = [F.col("token"), F.col("whole"), F.when(~same, F.col("split")).otherwise("")]
    words = lambda n, text: F.transform(T.letter_words(text), lambda w: F.struct(F.lit(n).alias("at"), w.alias("word")))
    found = F.explode_outer(F.concat(*(words(n, text) for n, text in enumerate(texts))))
    each = read(tokens.select("token").distinct()).select("token", found.alias("w")).groupBy("token", "w.at", "w.word").agg(F.count("*").alias("n"))
    met = each.join(F.broadcast(useful_words(scored_words)), "word", "left").groupBy("token")
    sums = met.agg(*(F.coalesce(F.sum(F.when(F.col("at") == n, F.col("n") * F.col("best"))), F.lit(0.0)).alias(f"s{n}") for n in range(len(texts))))
    scores = (F.col("s0").alias("s_token"), F.col("s1").alias("s_whole"), F.when(same, F.col("s1")).otherwise(F.col("s2")).alias("s_split"))
    return read(sums).select("token", "whole", "split", *scores)


def split_reading(token: Column, src: str, dst: str) -> Column:
    """The token with its letter runs converted and what is between them kept."""
    return F.array_join(F.transform(T.runs(token), lambda r: F.when(r.rlike(r"^[\p{L}\p{N}]"), L.convert(r, src, dst)).otherwise(r)), "")


def split_or_whole(df: DataFrame, margin: float = 0.25) -> DataFrame:
    """``df`` (token, whole, split, s_token, s_whole, s_split, confidence) with chosen: the better reading, or null if neither beats the token.

    An unsure whole reading yields to the split one around a separator that has
    two letters or more on each side; else the split one must score more by the
    margin, or at least as much where the whole reading changes nothing.
    """
    has_whole = F.col("whole") != F.col("token")
    separated = F.col("token").rlike(r"\p{L}{2,}[.,]\p{L}{2,}")
    split = F.when(has_whole, ((F.col("confidence") < 0.9) & separated) | (F.col("s_split") > F.col("s_whole") + margin)).otherwise(F.col("s_split") >= F.col("s_whole"))
    text, score = F.when(split, F.col("split")).otherwise(F.col("whole")), F.when(split, F.col("s_split")).otherwise(F.col("s_whole"))
    better = (score > F.col("s_token")) | ((F.col("s_token") == 0) & has_whole)
    return df.withColumn("chosen", F.when((text != F.col("token")) & better, text))


def correct_segments(docs: DataFrame, choices: DataFrame, key: str = "doc_id", col: str = "text", usual: tuple[str, str] | None = None) -> DataFrame:
    """(key, changed, text): texts with their segments replaced by the choice (token, chosen) for each, null where nothing changes or the text is one segment.

    ``usual`` are two layouts: most segments that conversion between them changes
    get that reading, which texts give where they are. ``choices`` must then have
    a row for every segment of the texts that conversion changes. Segments with
    another choice travel, as their places, and texts only where those are too
    many to come to them; a text is put together again from its own segments
    between them. Rows are told apart by their key, which must not repeat; texts
    without segments give no rows.
    """
    read = lambda c: L.convert(c, *usual) if usual else c
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    token, count = F.col("token"), lambda c: c.cast("int")
    other = choices.where(~F.col("chosen").eqNullSafe(F.when(read(token) != token, read(token))))
    more = count(F.col("chosen").isNotNull()) - count(read(token) != token)
    odd = kept(other.select(token.alias("segment"), F.coalesce("chosen", token).alias("new"), more.alias("more")), "odd-choices")
    each = docs.select(key, F.posexplode(T.segments(F.col(col))).alias("at", "segment")).withColumn("__slot", slot(F.col("segment")))
    near = each.join(F.broadcast(odd.select(slot(F.col("segment")).alias("__slot")).distinct()), "__slot", "left_semi")
    changes = near.join(odd, "segment").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "new", "more"))).alias("changes"))
    # a filter would be pushed to where the text is made and make it twice
    own = docs.select(key, F.explode(F.when(F.col(col) != "", F.array(col))).alias("__text")).join(kept(changes, "changes"), key, "left")
    plain = F.size(T.segments_with(F.col("__text"), L.pair(*usual)[0])) if usual else F.lit(0)
    changed = plain + F.coalesce(F.aggregate("changes", F.lit(0), lambda n, c: n + c["more"]), F.lit(0))

    def spliced(segments: Column) -> Column:
        after = lambda n: F.when(n > 0, F.get("changes", n - 1)["at"] + 1).otherwise(0)
        between = F.flatten(F.transform("changes", lambda c, n: F.concat(F.slice(segments, after(n) + 1, c["at"] - after(n)), F.array(c["new"]))))
        return F.array_join(F.concat(between, F.slice(segments, F.element_at("changes", -1)["at"] + 2, F.size(segments))), "")

    whole = read(F.col("__text"))
    text = F.when(F.col("changes").isNull(), whole).otherwise(F.get(F.transform(F.array(T.segments(whole)), spliced), F.lit(0)))
    own = own.withColumn("changed", changed.cast("long"))
    return own.select(key, "changed", F.when((F.col("changed") > 0) & T.segmented(F.col("__text")), text).alias("text"))


def rank_alternatives(df: DataFrame) -> DataFrame:
    """(token, place, text): the token, then its readings: the preferred of split and whole, the other, the rest by score; each text once.

    Where split and whole agree they gain 0.20; the split one has 0.05 in its favour.
    """
    agree = F.when(F.col("split") == F.col("whole"), 0.20).otherwise(0.0)
    first = F.col("s_split") + agree + 0.05 >= F.col("s_whole") + agree
    options = F.array(
        F.struct(F.lit(0).alias("step"), F.lit(0.0).alias("less"), F.col("token").alias("text")),
        F.struct(F.lit(1).alias("step"), F.lit(0.0).alias("less"), F.when(first, F.col("split")).otherwise(F.col("whole")).alias("text")),
        F.struct(F.lit(2).alias("step"), F.lit(0.0).alias("less"), F.when(first, F.col("whole")).otherwise(F.col("split")).alias("text")),
    )
    others = F.transform("others", lambda o: F.struct(F.lit(3).alias("step"), (-o["score"]).alias("less"), o["text"].alias("text")))
    every = df.select("token", F.explode(F.concat(options, others)).alias("o")).select("token", "o.*")
    once = every.groupBy("token", "text").agg(F.min(F.struct("step", "less")).alias("at"))
    return once.select("token", (F.row_number().over(Window.partitionBy("token").orderBy("at.step", "at.less", "text")) - 1).cast("long").alias("place"), "text")
