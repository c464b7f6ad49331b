"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, compatibility forms, look-alike letters,
digits and signs that stand for letters, and invisible characters. Entries are
whole words or beginnings of words with a weight each, exception phrases are
longer entries of weight zero, and of the matches that begin first the longest
counts. The sum of weights is set against the text's length, and a logistic
curve makes it a score.

Weights are log odds of labelled training rows: document counts of every word
and word beginning, gathered by Spark over a bounded sample of rows. Exceptions
are learned from the same rows: pairs of neighbouring words that hold an entry
and yet are commoner in clean documents. A few known ones are always there.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, small

#: Bounds of the fit: labelled rows, entries of the lexicon and learned exceptions, lengths of word beginnings, least count
#: (of toxic documents for an entry, of clean ones for an exception) and log odds of an entry.
FIT_ROWS, ENTRIES, BEGINNINGS, LEAST_DOCS, LEAST_WEIGHT = 12_000, 20_000, range(4, 9), 4, 3.0

#: Letters that look like Latin ones, and the Latin ones.
LOOKALIKES = str.maketrans(
    "авекмнорстухіјѕԁɡαορτυικν" + "ıɑƖ",
    "abekmhopctyxijsdgaoptuikv" + "ial",
)
#: Digits and signs that stand for letters inside words.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Characters that can't be seen.
HIDDEN = re.compile("[­​-‏⁠﻿]")
#: Harmless phrases with a word that may be in a lexicon.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "sore loser rule", "clown fish", "pond scum")

_SIGN = re.compile(r"[0134578@$](?=[0134578@$]*[^\W\d_])")
_MIXED = re.compile(r"[^\W\d_][0134578@$]|[0134578@$][^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile("[a-z]")


def folded_words(text: str) -> list[str]:
    """The words of a text after folding. Words wholly in another script keep their letters."""
    if not text.isascii():
        if HIDDEN.search(text):
            text = HIDDEN.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if _MIXED.search(text):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    found = _WORD.findall(text)
    if text.isascii():
        return found
    return [w if w.isascii() else _latin(w) for w in found]


def _latin(word: str) -> str:
    """The word with look-alikes in Latin letters, if it has Latin letters or becomes wholly Latin."""
    seen = word.translate(LOOKALIKES)
    return seen if seen.isascii() or _LATIN.search(word) else word


@dataclass(frozen=True)
class Lexicon:
    """Entries as (text, whole word?, weight) and the curve's coefficients (bias, total, density)."""

    entries: tuple[tuple[str, bool, float], ...]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]

    def measures(self, text: str) -> tuple[float, float]:
        """log(1 + total weight), and weight by the square root of the words."""
        found = folded_words(text)
        total = 0.0
        if found and len(self.entries):
            for _, weight in _automaton(self).iter_long("  " + "  ".join(found) + "  "):
                total += weight
        return math.log1p(total), total / math.sqrt(max(1, len(found)))

    def score(self, text: str) -> float:
        total, density = self.measures(text)
        bias, by_total, by_density = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, bias + by_total * total + by_density * density))))


@lru_cache(maxsize=4)
def _automaton(lexicon: Lexicon) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for text, whole, weight in lexicon.entries:
        made.add_word(f" {text} " if whole else f" {text}", weight)
    for phrase in lexicon.exceptions:
        made.add_word(" " + "  ".join(folded_words(phrase)) + " ", 0.0)
    made.make_automaton()
    return made


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, text, toxic) of at most ``rows`` labelled documents whose crc32(doc_id) mod 5 isn't 0, chosen by hash.

    A document with several labels has the largest, one with several rows the
    largest text; null labels and ids don't count. ``labels`` names documents by
    ``id_col`` too.
    """
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(fold != 0)
    known = known.groupBy(F.col(id_col).alias("labelled")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    sample = known.orderBy(F.xxhash64("labelled"), "labelled").limit(rows)
    # no more than `rows` ids: bounded by the parameter, so a broadcast is safe
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("labelled"))
    return found.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))


def _odds(bad: int, good: int):
    """Log odds of a feature's documents ``bad`` and ``good``, of so many in all."""
    return F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))


def _counted(sample: DataFrame, features) -> DataFrame:
    """(feature, bad, good): in how many toxic and clean texts ``features(words)`` lists each feature."""

    def run(batches):
        for batch in batches:
            counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[int(toxic > 0)].update(features(folded_words(text or "")))
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string())] + [pa.array([counts[k][x] for x in names], pa.int64()) for k in (1, 0)], ["feature", "bad", "good"]
            )

    made = sample.select("text", "toxic").mapInArrow(run, "feature string, bad long, good long")
    return made.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _words_and_beginnings(found: list[str]) -> set[str]:
    seen = {w + " " for w in found}
    for n in BEGINNINGS:
        seen.update(w[:n] for w in found if len(w) >= n)
    return seen


def _phrases(lexicon: Lexicon):
    """Lists the pairs of neighbouring words of which one holds an entry."""
    whole = {word for word, alone, _ in lexicon.entries if alone}
    begin = {word for word, alone, _ in lexicon.entries if not alone}

    def listed(found: list[str]) -> set[str]:
        hit = {w for w in set(found) if w in whole or any(w[:n] in begin for n in BEGINNINGS)}
        return {f"{a} {b}" for a, b in zip(found, found[1:]) if a in hit or b in hit} if hit else set()

    return listed


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """A lexicon from labelled rows. Without labels of both kinds it has no entries and scores every text alike, below 0.5."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.keep(training_rows(docs, labels, rows, id_col, text_col, label_col), "sample")
    totals = sample.agg(F.count_if(F.expr("toxic > 0")).alias("bad"), F.count_if(F.expr("toxic <= 0")).alias("good")).first()
    if not totals["bad"] or not totals["good"]:
        scratch.drop("sample")
        return Lexicon((), EXCEPTIONS, (-2.0, 0.0, 0.0))
    odds = _odds(totals["bad"], totals["good"])
    strong = _counted(sample, _words_and_beginnings).where(F.col("bad") >= LEAST_DOCS).withColumn("weight", odds).where(F.col("weight") >= LEAST_WEIGHT)
    best = strong.orderBy(F.desc("bad"), F.desc("weight"), "feature").limit(ENTRIES).collect()  # bounded by ENTRIES
    entries = _thinned({r["feature"]: (r["bad"], r["weight"]) for r in best})
    harmless = _counted(sample, _phrases(Lexicon(entries, (), (0.0, 0.0, 0.0)))).where(F.col("good") >= LEAST_DOCS).where(odds < 0)
    learned = harmless.orderBy(F.desc("good"), "feature").limit(ENTRIES).collect()  # bounded by ENTRIES
    exceptions = (*EXCEPTIONS, *sorted(r["feature"] for r in learned))
    draft = Lexicon(entries, exceptions, (0.0, 0.0, 0.0))

    def measured(batches):
        for batch in batches:
            both = [draft.measures(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b[0] for b in both], pa.float64()), pa.array([b[1] for b in both], pa.float64()), batch.column("toxic")], ["total", "density", "toxic"]
            )

    rows_seen = sorted(sample.select("text", "toxic").mapInArrow(measured, "total double, density double, toxic int").collect())  # bounded by `rows`
    scratch.drop("sample")
    return Lexicon(entries, exceptions, _logistic(np.array([[1.0, r[0], r[1]] for r in rows_seen]), np.array([float(r[2] > 0) for r in rows_seen])))


def _thinned(found: dict[str, tuple[int, float]]) -> tuple[tuple[str, bool, float], ...]:
    """Drops beginnings that nearly always go on alike, then entries that a kept shorter beginning covers as well."""
    longer: dict[str, int] = {}
    for name, (bad, _) in found.items():
        stem = name[:-1]
        longer[stem] = max(longer.get(stem, 0), bad)
    kept = {n: v for n, v in found.items() if n.endswith(" ") or longer.get(n, 0) < 0.95 * v[0]}
    out = []
    for name, (_, weight) in sorted(kept.items()):
        word = name.rstrip(" ")
        if not any(word[:n] != name and kept.get(word[:n], (0, -1.0))[1] >= weight for n in BEGINNINGS if n <= len(word)):
            out.append((word, name.endswith(" "), weight))
    return tuple(out)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - 0.1 * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1 in a last column called ``out_col``, with underscores behind where ``docs`` has that one; null counts as empty."""
    out_col = free_name(docs, out_col)

    def run(batches):
        for batch in small(batches):
            made = [lexicon.score(t or "") for t in batch.column(text_col).to_pylist()]
            yield batch.append_column(out_col, pa.array(made, pa.float64()))

    return docs.mapInArrow(run, _scored(docs, out_col))


def _scored(docs: DataFrame, out_col: str):
    return docs.withColumn(out_col, F.lit(None).cast("double")).schema


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    The lexicon is learned from labelled rows whose crc32(doc_id) mod 5 isn't 0.
    Null and empty texts score as texts without a match. Rows with null ids
    aren't held out; repeated rows stay. Only the text enters a score.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels), out_col="score")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return scored.select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more.

    Each row is judged by its own text, whatever its id: repeated rows go or stay
    together, rows with null ids or texts are kept unless their text is toxic,
    and null and empty texts stay. Columns keep their names and order, whatever
    they are called. An empty table gives an empty result; without labels all
    rows stay.
    """
    added = free_name(docs, "toxicity")
    return score(docs, fit(docs, labels), out_col=added).where(F.col(added) < 0.5).drop(added)
