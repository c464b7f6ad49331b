"""Nearest neighbours by score-aware anisotropic quantisation, with a certificate.

Vectors are scaled to length one. A vector is the nearest of ``CENTRES`` coarse
centres plus a residual, and the residual is quantised in ``WIDTH``-dimensional
subspaces with 16 codewords each: four bits. Codes and codewords are fitted to
a loss that weighs the error along the vector ``eta`` times the error across
it, since that part changes the inner product with near queries most.

What the codes miss of a row x is split into a part along x, known as a factor,
and a part across it of known length m. So a score s = x·q lies within
m * sqrt(1 - s²) of what the 16-entry tables say, and rows whose bound is under
the k-th best so far are left out for sure. The others are refined by a second
code of a byte a dimension, whose own error is small and known too, and those
that may still be among the k nearest of all blocks are ranked by the exact
measure. Every answer is that of a full comparison, however rows cluster; how
many rows are refined depends on the data, and there is no cap.

The index is fitted on a bounded sample and every row is indexed. A task holds a
block of codes once and walks over all queries, which it reads in batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, filesystem, small

#: Bound of the sample that the index is fitted on, coarse centres, dimensions a subspace, rounds of fitting.
FIT_ROWS, CENTRES, WIDTH, ROUNDS = 8192, 64, 2, 6
#: The score from which on errors along a vector matter; it sets eta.
THRESHOLD = 0.2
#: Rows of a block of codes, at most and, where there are too few for all cores, at least; queries of a batch.
CODE_BLOCK, LEAST_BLOCK, QUERY_BATCH = 1 << 16, 1 << 12, 128
#: What rounding may add to a score.
ROUNDING = 2e-5


@dataclass
class Index:
    centres: np.ndarray  # (centres, dims)
    words: np.ndarray  # (subspaces, 16, width)
    eta: float

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    def assign(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T - (self.centres**2).sum(axis=1) / 2).argmax(axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centre, codes) of unit vectors."""
        centre = self.assign(x)
        return centre, _codes(_cut(x - self.centres[centre], self.words), _cut(x, self.words), self.words, self.eta)

    def decode(self, centre: np.ndarray, codes: np.ndarray) -> np.ndarray:
        parts = self.words[np.arange(len(self.words))[None, :], codes]
        return self.centres[centre] + parts.reshape(len(codes), -1)[:, : self.dims]


def refinement(x: np.ndarray, coded: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gain, miss, fine, scale, off): a score is gain * what the code says, within ``miss`` * sqrt(1 - score²); or what the code and ``fine * scale`` say, within ``off``."""
    rest = x - coded
    along = (x * rest).sum(axis=1)
    across = _length(rest - along[:, None] * x)
    fits = along < 0.75  # else the factor is of no use, and the row is always refined
    gain = np.where(fits, 1 / np.where(fits, 1 - along, 1), 1)
    scale = np.maximum(np.abs(rest).max(axis=1, initial=0), 1e-30) / 127
    fine = np.rint(rest / scale[:, None]).astype(np.int8)
    return gain, np.where(fits, gain * across, np.inf), fine, scale, _length(rest - fine * scale[:, None])


class Block:
    """A block of codes, and the rows in it that may be among the k nearest of a query."""

    def __init__(self, index: Index, rows: pd.DataFrame):
        self.index, self.ids, self.keys = index, rows["vec_id"].to_numpy(), rows["row_key"].to_numpy()
        subspaces = len(index.words)
        packed = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
        nibbles = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(rows), -1)[:, :subspaces]
        self.at = (nibbles.T + 16 * np.arange(subspaces)[:, None]).astype(np.intp)
        self.centre = rows["centre"].to_numpy()
        self.gain, self.miss, self.scale, self.off = (rows[c].to_numpy(np.float64) for c in ("gain", "miss", "scale", "off"))
        self.fine = np.frombuffer(b"".join(rows["fine"]), np.int8).reshape(len(rows), -1)

    def near(self, unit: np.ndarray, query_ids: np.ndarray, k: int):
        """For each query its place, the places of rows, and the least and most that each may score."""
        tables = np.einsum("qmw,mkw->qmk", _cut(unit, self.index.words), self.index.words).reshape(len(unit), -1)
        coarse = unit @ self.index.centres.T
        for n, q in enumerate(unit):
            rough = tables[n].take(self.at).sum(axis=0) + coarse[n].take(self.centre)
            guess = self.gain * rough
            guess[self.ids == query_ids[n]] = -np.inf
            first = np.argpartition(guess, -3 * k)[-3 * k :] if len(guess) > 3 * k else np.arange(len(guess))
            least, _ = self._refined(q, rough, first[guess[first] > -np.inf])
            beat = np.partition(least, -k)[-k] if len(least) >= k else -np.inf
            # a row that scores at least ``beat`` is across its code by sqrt(1 - beat²) at most
            slack = math.sqrt(max(0.0, 1 - max(0.0, beat) ** 2))
            may = np.flatnonzero((guess + self.miss * slack + ROUNDING >= beat) & (guess > -np.inf))
            least, most = self._refined(q, rough, may)
            if len(least) > k:
                kept = most >= np.partition(least, -k)[-k]
                may, least, most = may[kept], least[kept], most[kept]
            yield n, may, least, most

    def _refined(self, q: np.ndarray, rough: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = rough[at] + self.scale[at] * (self.fine[at].astype(np.float32) @ q.astype(np.float32))
        return score - self.off[at] - ROUNDING, score + self.off[at] + ROUNDING


def _cut(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(rows, subspaces, width), zero-padded."""
    subspaces, _, width = words.shape
    return np.pad(x, ((0, 0), (0, subspaces * width - x.shape[1]))).reshape(len(x), subspaces, width)


def _codes(rest: np.ndarray, along: np.ndarray, words: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes that minimise |error|^2 + (eta - 1) * (error along the vector)^2 by coordinate descent over subspaces."""
    square = ((rest[:, :, None, :] - words[None]) ** 2).sum(axis=3)  # (rows, subspaces, 16)
    shift = np.einsum("nmw,nmw->nm", rest, along)[:, :, None] - np.einsum("mkw,nmw->nmk", words, along)
    codes = square.argmin(axis=2)
    rows = np.arange(len(rest))
    total = np.take_along_axis(shift, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
    for _ in range(sweeps):
        for m in range(words.shape[0]):
            others = total - shift[rows, m, codes[:, m]]
            codes[:, m] = (square[:, m] + (eta - 1) * (others[:, None] + shift[:, m]) ** 2).argmin(axis=1)
            total = others + shift[rows, m, codes[:, m]]
    return codes.astype(np.uint8)


def fit(x: np.ndarray, centres: int = CENTRES, width: int = WIDTH, threshold: float = THRESHOLD, rounds: int = ROUNDS, seed: int = 7) -> Index:
    """An index from a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    n, dims = x.shape
    if not n:
        return Index(np.zeros((1, dims)), np.zeros((math.ceil(dims / width), 16, width)), 1.0)
    mid = x[rng.permutation(n)[: min(centres, n)]].copy()
    for _ in range(2 * rounds):
        near = (x @ mid.T - (mid**2).sum(axis=1) / 2).argmax(axis=1)
        for c in np.unique(near):
            mid[c] = x[near == c].mean(axis=0)
    eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
    subspaces = math.ceil(dims / width)
    index = Index(mid, np.zeros((subspaces, 16, width)), eta)
    rest, along = _cut(x - mid[index.assign(x)], index.words), _cut(x, index.words)
    picks = rng.integers(0, n, (subspaces, 16))
    index.words = np.stack([rest[picks[m], m] for m in range(subspaces)])
    for _ in range(rounds):
        codes = _codes(rest, along, index.words, eta)
        error = np.einsum("nmw,nmw->nm", rest - index.words[np.arange(subspaces)[None, :], codes], along)
        for m in range(subspaces):
            others = error.sum(axis=1) - error[:, m]
            for k in range(16):
                mine = codes[:, m] == k
                if not mine.any():
                    index.words[m, k] = rest[rng.integers(n), m]
                    continue
                r, a, s = rest[mine, m], along[mine, m], others[mine]
                left = np.eye(width) * len(r) + (eta - 1) * a.T @ a
                right = r.sum(axis=0) + (eta - 1) * (a * ((r * a).sum(axis=1) + s)[:, None]).sum(axis=0)
                index.words[m, k] = np.linalg.solve(left, right)
    return index


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of rows that take part: an id and a finite vector of doubles that isn't zero."""
    v = F.col("v")
    made = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return made.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda e: e != 0))


def nearest(vectors: DataFrame, queries_every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest by cosine for every id divisible by ``queries_every``: query_id, rank, vec_id, score.

    Candidates are all other rows; scores are exact cosines in double precision,
    ties go to the smaller id. Vectors that are null, zero, or hold null or
    non-finite components take no part; nor do those of another length than the
    most frequent one (ties to the longer). Repeated ids are rows of their own,
    and a query leaves out all rows of its id. An empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "ann")
    rows = scratch.keep(usable(vectors, id_col, vector_col), "rows")
    common = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = common["dims"] if common else 1
    rows = rows.where(F.size("v") == dims)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").collect()  # bounded by FIT_ROWS
    x = np.array([r["v"] for r in sample], float).reshape(-1, dims)
    index = vectors.sparkSession.sparkContext.broadcast(fit(x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x))

    def encoded(batches):
        for batch in small(batches):
            v = np.array(batch.column("v").to_pylist(), float).reshape(-1, dims)
            unit = v / _length(v)[:, None]
            centre, found = index.value.encode(unit)
            gain, miss, fine, scale, off = refinement(unit, index.value.decode(centre, found))
            raw = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (v, fine)]
            nibbles = pa.array([_nibbles(c) for c in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), raw[0], pa.array(centre, pa.int32()), nibbles, raw[1], *map(pa.array, (gain, miss, scale, off))], columns)

    columns = ["vec_id", "vector", "centre", "codes", "fine", "gain", "miss", "scale", "off"]
    made = rows.mapInArrow(encoded, "vec_id long, vector binary, centre int, codes binary, fine binary, gain double, miss double, scale double, off double")
    # the row key tells rows of one id apart; written down, it can't change on a retry
    codes = scratch.keep(made.withColumn("row_key", F.monotonically_increasing_id()), "codes")
    asked = scratch.keep(codes.where(F.col("vec_id") % queries_every == 0).select(F.col("row_key").alias("query_key"), F.col("vec_id").alias("query_id"), F.col("vector").alias("query")), "asked")
    if asked.isEmpty():
        return codes.where("false").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    # of equal vectors only those with the smallest ids can be among the nearest; one more may be the query's own
    of_id, of_vector = Window.partitionBy("vector", "vec_id").orderBy("row_key"), Window.partitionBy("vector").orderBy("vec_id")
    may = codes.withColumn("at", F.row_number().over(of_id)).where(F.col("at") <= k)
    may = may.withColumn("at", F.dense_rank().over(of_vector)).where(F.col("at") <= k + 1).drop("at", "vector")
    block = min(CODE_BLOCK, max(LEAST_BLOCK, math.ceil(codes.count() / (2 * vectors.sparkSession.sparkContext.defaultParallelism))))
    blocks = max(1, math.ceil(codes.count() / block))
    queries = f"{scratch.path}/asked"

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        held, out = Block(index.value, rows), []
        store, path = filesystem(queries)
        for batch in ds.dataset(path, filesystem=store, format="parquet").to_batches(batch_size=QUERY_BATCH):
            if not batch.num_rows:
                continue
            q = np.frombuffer(b"".join(batch.column("query").to_pylist()), np.float64).reshape(-1, dims)
            keys, ids = (batch.column(c).to_numpy() for c in ("query_key", "query_id"))
            for n, places, least, most in held.near(q / _length(q)[:, None], ids, k):
                out.append((np.full(len(places), keys[n]), held.keys[places], least, most))
        return pd.DataFrame(dict(zip(("query_key", "row_key", "least", "most"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    dealt = may.withColumn("block", F.pmod(F.xxhash64("row_key"), F.lit(blocks)).cast("int"))
    found = scratch.keep(dealt.groupBy("block").applyInPandas(scan, "query_key long, row_key long, least double, most double"), "found")
    best = Window.partitionBy("query_key").orderBy(F.desc("least"))
    beat = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k).groupBy("query_key").agg(F.min("least").alias("least"), F.count("*").alias("n"))
    beat = beat.select("query_key", F.when(F.col("n") >= k, F.col("least")).otherwise(float("-inf")).alias("beat"))
    both = found.join(beat, "query_key").where("most >= beat").select("query_key", "row_key")
    both = both.join(codes.select("row_key", "vec_id", "vector"), "row_key").join(asked, "query_key")

    def ranked(batches):
        for batch in small(batches):
            v, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float64).reshape(-1, dims) for c in ("vector", "query"))
            exact = (v * q).sum(axis=1) / (_length(v) * _length(q))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query_key", "query_id", "row_key", "vec_id")), pa.array(exact)], ["query_key", "query_id", "row_key", "vec_id", "score"])

    exact = both.mapInArrow(ranked, "query_key long, query_id long, row_key long, vec_id long, score double")
    # rows of one query id are one query with several vectors: its nearest are those of any of them
    exact = exact.groupBy("query_id", "row_key", "vec_id").agg(F.max("score").alias("score"))
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row_key")
    return exact.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _length(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def _nibbles(codes: np.ndarray) -> bytes:
    """Two codes a byte."""
    even = np.pad(codes, (0, len(codes) % 2))
    return (even[::2] | (even[1::2] << 4)).astype(np.uint8).tobytes()
