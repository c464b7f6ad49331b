"""A hidden Markov language model by distributed Baum-Welch.

Observations are the ``HEAD`` most frequent training words, one class for all
other words, known or not, and the end of a text. A word of that class is drawn
from the smoothed counts of its words, so the model is a distribution over all
texts. Emissions times transitions are re-estimated by Baum-Welch: each task
turns its share of the training texts into expected counts of the words it saw,
and Spark sums them by word. Both the forward-backward recursion of training and
the likelihood of a text run over whole texts; long ones are bracketed into
pieces whose matrices are multiplied, which is the same recursion.

Word counts, rare words included, stay in Spark: frequent words are a bounded
table, the others are joined by word, and none of those is frequent.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, small, words

#: Frequent words with an emission of their own, latent states, passes of Baum-Welch over all training texts.
HEAD, STATES, PASSES = 65_000, 8, 4
#: Recursions over longer texts are put together from pieces of this length.
PIECE = 1024
#: Cells (pieces times length) worked on at once.
CELLS = 1 << 19
#: The end of a text as a word; no word holds white space.
END = b"\n"


@dataclass
class Model:
    """start: (states), move: (states, states), emit: (observations, states)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(counts: np.ndarray, states: int = STATES) -> Model:
    """Sticky states, each with the words' frequencies and a quarter of the words (by hash) four times as likely."""
    ids = np.arange(len(counts), dtype=np.uint64)
    mixed = (ids[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, states + 1, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
    emit = (counts[:, None] + 1.0) * np.where(mixed % np.uint64(4) == 0, 4.0, 1.0)
    move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _padded(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces as columns, longest first, and how many are that long at each step."""
    lengths = np.array([len(p) for p in pieces])
    grid = np.zeros((lengths[0], len(pieces)), np.int32)
    for at, piece in enumerate(pieces):
        grid[: len(piece), at] = piece
    return grid, np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")


def _groups(pieces: list, key=len):
    """Pieces by length, longest first, in groups of about ``CELLS`` cells."""
    pieces = sorted(pieces, key=key, reverse=True)
    at = 0
    while at < len(pieces):
        step = max(1, CELLS // max(1, key(pieces[at])))
        yield pieces[at : at + step]
        at += step


@dataclass
class Counts:
    """Expected counts of one Baum-Welch pass: start, move, emit of the observations ``seen``, and the log-likelihood."""

    start: np.ndarray
    move: np.ndarray
    seen: np.ndarray
    emit: np.ndarray
    total: float


def expected_counts(texts: list[np.ndarray], model: Model) -> Counts:
    """Expected counts over whole texts.

    Every piece of a text runs forward from what comes before it and backward
    from what comes after it, so cuts change nothing.
    """
    k, v = len(model.start), len(model.emit)
    start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((v, k)), 0.0
    # single precision does within a piece, sums over pieces are double
    emits, moves = model.emit.astype(np.float32), model.move.astype(np.float32)
    back, ones = np.ascontiguousarray(moves.T), np.ones(k, np.float32)
    pieces = [(t[:PIECE], None, np.ones(k)) for t in texts if 0 < len(t) <= PIECE]
    pieces += _bracketed([t for t in texts if len(t) > PIECE], model)
    for group in _groups(pieces, lambda p: len(p[0])):
        grid, active = _padded([p[0] for p in group])
        steps, n = grid.shape
        later = np.array([p[1] is not None for p in group])
        before = np.array([p[1] if p[1] is not None else model.start for p in group])
        likely = emits.take(grid, axis=0)  # (steps, n, k)
        forward = np.empty((steps, n, k), np.float32)
        scale = np.ones((steps, n), np.float32)
        alpha = np.where(later[:, None], before @ model.move, before).astype(np.float32)
        for t in range(steps):
            m = active[t]
            alpha = alpha[:m] @ moves if t else alpha[:m]
            alpha *= likely[t, :m]
            scale[t, :m] = norm = alpha @ ones
            alpha *= (1 / norm)[:, None]
            forward[t, :m] = alpha
        total += np.log(scale).sum(dtype=np.float64)
        beta = np.array([p[2] for p in group])
        beta /= (forward[np.array([len(p[0]) for p in group]) - 1, np.arange(n)] * beta).sum(axis=1)[:, None]
        beta = beta.astype(np.float32)
        for t in range(steps - 1, -1, -1):
            m = active[t]
            now = beta[:m]
            forward[t, :m] *= now  # from here on the posterior: each row sums to 1
            now *= likely[t, :m]
            now *= (1 / scale[t, :m])[:, None]
            if t:  # the move into this place, undone from the posterior of the place before
                move += model.move * (forward[t - 1, :m].T @ now)
                beta[:m] = now @ back
        move += model.move * (before[later].T @ beta[later])
        start += forward[0, ~later].sum(axis=0)
        there = np.arange(n)[None, :] < active[:, None]
        flat, weight = grid[there], forward[there]
        for s in range(k):
            emit[:, s] += np.bincount(flat, weight[:, s], minlength=v)
    seen = np.flatnonzero(emit.any(axis=1))
    return Counts(start, move, seen, emit[seen], total)


def _bracketed(texts: list[np.ndarray], model: Model) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
    """(piece, states before it or None, likelihood of what follows by the state at its end) of every piece of long texts."""
    alphas, _ = _ends([t[:PIECE] for t in texts], model)
    places = [(i, a) for i, t in enumerate(texts) for a in range(PIECE, len(t), PIECE)]
    whole, _ = _matrices([texts[i][a : a + PIECE] for i, a in places], model)
    at = {place: n for n, place in enumerate(places)}
    out = []
    for i, t in enumerate(texts):
        cuts = list(range(PIECE, len(t), PIECE))
        before: list[np.ndarray | None] = [None, alphas[i]]
        for a in cuts[:-1]:
            ahead = before[-1] @ whole[at[i, a]]
            before.append(ahead / ahead.sum())
        after = [np.ones(len(model.start))]
        for a in reversed(cuts):
            behind = whole[at[i, a]] @ after[-1]
            after.append(behind / behind.sum())
        out += [(t[a : a + PIECE], b, c) for a, b, c in zip([0, *cuts], before, reversed(after), strict=True)]
    return out


def next_model(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
    """The model of expected counts, smoothed towards even moves and the words' frequencies."""
    start, move, emit = start + 0.1, move + 0.1, emit + 10.0 * prior[:, None]
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _ends(pieces: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The states at the end of pieces that begin a text, and the logarithms of their likelihoods."""
    ends, logs = np.tile(model.start, (len(pieces), 1)), np.zeros(len(pieces))
    for group in _groups([(i, p) for i, p in enumerate(pieces) if len(p)], lambda p: len(p[1])):
        grid, active = _padded([p for _, p in group])
        index = np.array([i for i, _ in group])
        alpha, log = np.tile(model.start, (len(group), 1)), np.zeros(len(group))
        for t in range(len(grid)):
            m = active[t]
            now = (alpha[:m] @ model.move if t else alpha[:m]) * model.emit[grid[t, :m]]
            norm = now.sum(axis=1)
            alpha[:m] = now / norm[:, None]
            log[:m] += np.log(norm)
        ends[index], logs[index] = alpha, log
    return ends, logs


def _matrices(pieces: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For pieces inside a text, from each state before to each state at the end; scaled, with the logarithms of the scales."""
    k = len(model.start)
    whole, logs = np.zeros((len(pieces), k, k)), np.zeros(len(pieces))
    for group in _groups(list(enumerate(pieces)), lambda p: len(p[1]) * k):
        grid, active = _padded([p for _, p in group])
        index = np.array([i for i, _ in group])
        made, log = np.tile(np.eye(k), (len(group), 1, 1)), np.zeros(len(group))
        for t in range(len(grid)):
            m = active[t]
            now = (made[:m].reshape(m * k, k) @ model.move).reshape(m, k, k) * model.emit[grid[t, :m]][:, None, :]
            norm = now.max(axis=(1, 2))
            made[:m] = now / norm[:, None, None]
            log[:m] += np.log(norm)
        whole[index], logs[index] = made, log
    return whole, logs


def log_likelihoods(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """Natural log-likelihood of each text by the scaled forward recursion.

    A long text is cut into pieces that are worked on side by side: the first
    from the start, the others from each state in turn, and the pieces' matrices
    are then multiplied in order. That is the same recursion, put in brackets.
    """
    alphas, out = _ends([t[:PIECE] for t in texts], model)
    places = [(i, a) for i, t in enumerate(texts) for a in range(PIECE, len(t), PIECE)]
    whole, logs = _matrices([texts[i][a : a + PIECE] for i, a in places], model)
    for (i, _), w, log in zip(places, whole, logs, strict=True):
        alpha = alphas[i] @ w
        norm = alpha.sum()
        alphas[i] = alpha / norm
        out[i] += log + math.log(norm)
    return out


def _word_counts(batches):
    for batch in small(batches):
        counts: Counter = Counter()
        for text in batch.column("raw").to_pylist():
            counts.update(words(text))
            counts[END] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``head`` words have an emission of their own; with as many as there are, every
    word has. Trained on all rows whose crc32(doc_id as text) mod 7 isn't 2; rows with a
    null id are trained on. Scores are log10 probabilities. Null and empty texts
    are one token, the end. Without training rows every word is unknown, and the
    model is its first guess. Repeated rows count and are scored each. Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "hmm")
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % 7
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"), as_bytes(text_col).alias("raw"))

    counted = source.where("not held_out").select("raw").mapInArrow(_word_counts, "word binary, n long")
    vocabulary = scratch.keep(counted.groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    sums = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, kinds = int(sums["n"]), int(sums["v"])
    # the top of every partition meets in a task, and only the top of all comes here: bounded by `head`
    frequent = scratch.keep(vocabulary.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(head), "frequent").orderBy(F.desc("c"), "word").toArrow().to_pylist()
    end = vocabulary.where(F.col("word") == END).first()
    ends = int(end["c"]) if end else 0
    top = np.array([r["c"] for r in frequent], np.int64)
    other_total = total - int(top.sum()) - ends
    other_kinds = kinds - len(frequent) - (ends > 0)
    table = {bytes(r["word"]): i for i, r in enumerate(frequent)}
    other, end_at = len(table), len(table) + 1
    shared = spark.sparkContext.broadcast(table)  # `head` words at most
    base = np.log10((np.concatenate([top, [0, ends]]) + 1.0) / (total + kinds + 1))
    known = np.concatenate([np.ones(len(top)), [0, float(ends > 0)]]).astype(np.int64)
    kind = np.dtype("<u2" if end_at < 1 << 16 else "<u4")

    def encoded(batches):
        index = shared.value
        for batch in small(batches):
            observed, sizes, sure, score, rare, times = [], [], [], [], [], []
            for text in batch.column("raw").to_pylist():
                found = words(text)
                ids = np.array([index.get(w, other) for w in found] + [end_at], np.int64)
                unseen = Counter(found[i] for i in np.flatnonzero(ids == other).tolist())
                observed.append(ids.astype(kind).tobytes())
                sizes.append(len(ids))
                sure.append(int(known[ids].sum()))
                score.append(float(base[ids[ids != other]].sum()))
                rare.append(list(unseen))
                times.append(list(unseen.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(observed, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sure, pa.int64()),
                 pa.array(score, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", "held_out", "observed", "n_tokens", "head_known", "head_base", "rare", "times"],
            )

    schema = "doc_id long, held_out boolean, observed binary, n_tokens long, head_known long, head_base double, rare array<binary>, times array<long>"
    rows = scratch.keep(source.mapInArrow(encoded, schema).withColumn("row_key", F.monotonically_increasing_id()), "rows")

    # rare words: joined by word, summed by row
    each = rows.select("row_key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row_key", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = each.join(vocabulary, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = found.groupBy("row_key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(float(total + kinds + 1)))).alias("rare_base"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(float(other_total + other_kinds + 1)))).alias("rare_score"),
    )

    seen = np.concatenate([top, [other_total + 1, ends]]).astype(float)
    prior = (seen + 0.5) / (seen + 0.5).sum()
    model = first_model(seen, states)
    training = rows.where("not held_out").select("observed")
    columns = [f"c{n}" for n in range(states)]
    for _ in range(passes if ends else 0):
        now = spark.sparkContext.broadcast(model)

        def count(batches, now=now):
            k = len(now.value.start)
            start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((len(now.value.emit), k))
            for batch in small(batches, 1 << 20):
                part = expected_counts([np.frombuffer(o, kind) for o in batch.column("observed").to_pylist()], now.value)
                start, move = start + part.start, move + part.move
                emit[part.seen] += part.emit
            seen = np.flatnonzero(emit.any(axis=1))
            # observations from 0, before them the start and the rows of moves
            at = np.concatenate([seen, np.arange(-1 - k, 0)])
            values = np.concatenate([emit[seen], move, start[None, :]]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(np.ascontiguousarray(values[:, s])) for s in range(k))], ["at", *columns])

        parts = training.mapInArrow(count, "at int, " + ", ".join(f"{c} float" for c in columns))
        sums = parts.groupBy("at").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()  # a row for each of `head` words at most
        at, values = sums.column("at").to_numpy(), np.stack([sums.column(c).to_numpy() for c in columns], axis=1)
        emit = np.zeros_like(model.emit)
        emit[at[at >= 0]] = values[at >= 0]
        moves = np.zeros_like(model.move)
        moves[at[(at < -1)] + 1 + states] = values[at < -1]
        model = next_model(values[at == -1].sum(axis=0), moves, emit, prior)
        now.unpersist()
    final = spark.sparkContext.broadcast(model)

    def scored(batches):
        for batch in small(batches, 1 << 20):
            texts = [np.frombuffer(o, kind) for o in batch.column("observed").to_pylist()]
            made = log_likelihoods(texts, final.value) / math.log(10)
            kept = [batch.column(c) for c in ("row_key", "doc_id", "held_out", "n_tokens", "head_known", "head_base")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(made, pa.float64())], ["row_key", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_score"])

    head_scores = rows.select("row_key", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "observed").mapInArrow(
        scored, "row_key long, doc_id long, held_out boolean, n_tokens long, head_known long, head_base double, head_score double"
    )
    out = head_scores.join(rare, "row_key", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("head_score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
