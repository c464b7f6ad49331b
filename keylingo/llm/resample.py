"""Target-distribution importance resampling on hashed word runs, by a head-tail vocabulary.

A feature is a run of 1 to ``max_n`` words, joined by a space; its bucket is the
CRC32 of its bytes modulo ``buckets``. A CRC can be carried on, so the frequent
words (the head) travel with their CRC states: the bucket of a single one is
looked up, and a longer run starts from its first word's state. The frequent
pairs of head words travel with their buckets. Words and pairs of the tail take
the CRC of their bytes. Both feed the same exact totals, so where the line
between head and tail lies changes no result.

Texts are read twice, for the words' counts and for the buckets, and then never
again: a document's buckets are written in two bytes a feature. Documents are
drawn by weight plus Gumbel noise, the largest sums first.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, small

#: Words, and pairs, of the head at most; longer words are always in the tail. Proven bound of a broadcast: some 6 MB.
HEAD, LONGEST = 65_536, 64
#: A task gives its counts away when it holds so many; texts are cut into words in pieces of so many bytes, at separators.
HELD, PIECE = 300_000, 1 << 20
#: Steps of the histogram that finds the head, in an octave of counts.
STEPS = 64
#: Fixed values of the contract: documents with fewer words aren't drawn, so many of a hundred are, and the name of the noise.
MIN_WORDS, DRAWN, OF, SEED = 20, 10, 100, "2024"

#: Bytes outside words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ become spaces, A-Z lower case.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``size`` bytes; no word is cut."""
    plain, at = text.translate(_PLAIN), 0
    while at < len(plain):
        end = plain.find(b" ", at + size)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _word_counts(batches):
    counts: Counter = Counter()

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return made

    for texts in small(batches):
        for text in texts.column("raw").to_pylist():
            for words in pieces(text):
                counts.update(words)
                if len(counts) > HELD:
                    yield batch()
    if counts:
        yield batch()


def frequent(counted: DataFrame, head: int, scratch: Scratch, name: str) -> list:
    """The most frequent rows of ``counted(..., n)``, as many as fit into ``head``, without sorting the table.

    A histogram over the logarithm of the counts tells from which count on the
    rows fit; rows of the step that doesn't are left to the tail.
    """
    table = scratch.keep(counted, name)
    step = F.floor(F.log2(F.col("n")) * STEPS).cast("int")
    least, room = None, head
    for row in sorted(table.groupBy(step.alias("step")).count().collect(), reverse=True):  # 64 octaves at most
        room -= row["count"]
        if room < 0:
            break
        least = row["step"]
    found = [] if least is None else table.where(step >= least).collect()  # `head` rows at most
    scratch.drop(name)
    return found


class Vocabulary:
    """The head: CRC states of frequent words, and buckets of frequent pairs of them."""

    def __init__(self, words: list[bytes], buckets: int):
        self.index = {w: i for i, w in enumerate(words)}
        self.buckets = buckets
        self.kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
        states = [crc32(w) for w in words]
        # the last place stands for words of the tail
        self.bucket = np.array([s % buckets for s in states] + [0], np.int64)
        self.ahead = [crc32(b" ", s) for s in states]
        self.pairs = self.pair_buckets = np.zeros(0, np.int64)

    def with_pairs(self, keys: list[int]) -> Vocabulary:
        """``keys`` are first place * ``HEAD`` + second place."""
        words, n = list(self.index), max(HEAD, len(self.index))
        self.pairs = np.array(sorted(keys), np.int64)
        self.pair_buckets = np.array([crc32(words[k % n], self.ahead[k // n]) % self.buckets for k in self.pairs.tolist()], np.int64)
        return self

    def places(self, words: list[bytes]) -> np.ndarray:
        tail = len(self.index)
        return np.array([self.index.get(w, tail) for w in words], np.int64)

    def pair_keys(self, places: np.ndarray) -> np.ndarray:
        """Keys of neighbours that are both in the head, -1 for others."""
        tail, n = len(self.index), max(HEAD, len(self.index))
        first, second = places[:-1], places[1:]
        return np.where((first < tail) & (second < tail), first * n + second, -1)

    def features(self, words: list[bytes], max_n: int, new: int) -> np.ndarray:
        """Buckets of the runs that end in one of the last ``new`` words."""
        places, tail, made = self.places(words), len(self.index), []
        out = self.bucket[places]
        rare = np.flatnonzero(places == tail).tolist()
        out[rare] = [crc32(words[i]) % self.buckets for i in rare]
        made.append(out[len(words) - new :])
        if max_n > 1 and len(words) > 1:
            ahead, extended = self.ahead, []
            start = max(0, len(words) - new - 1)
            keys = self.pair_keys(places)[start:]
            at = np.minimum(np.searchsorted(self.pairs, keys), max(0, len(self.pairs) - 1))
            hit = self.pairs[at] == keys if len(self.pairs) else np.zeros(len(keys), bool)
            out = np.zeros(len(keys), np.int64)
            out[hit] = self.pair_buckets[at[hit]] if len(self.pairs) else 0
            for i in np.flatnonzero(~hit).tolist():
                word, place = words[start + i], int(places[start + i])
                state = ahead[place] if place < tail else crc32(b" ", crc32(word))
                out[i] = crc32(words[start + i + 1], state) % self.buckets
            made.append(out)
            for n in range(3, max_n + 1):
                first = max(0, len(words) - new - n + 1)
                for i in range(first, len(words) - n + 1):
                    place = int(places[i])
                    state = ahead[place] if place < tail else crc32(b" ", crc32(words[i]))
                    extended.append(crc32(b" ".join(words[i + 1 : i + n]), state) % self.buckets)
            made.append(np.array(extended, np.int64))
        return np.concatenate(made)

    def encode(self, text: bytes, max_n: int) -> tuple[int, np.ndarray]:
        """The number of words of a text, and the buckets of its features."""
        total, made, before = 0, [], []
        for words in pieces(text):
            if words:
                made.append(self.features(before + words, max_n, len(words)).astype(self.kind))
                before = (before + words)[len(before) + len(words) - max_n + 1 :] if max_n > 1 else []
                total += len(words)
        return total, np.concatenate(made) if made else np.zeros(0, self.kind)


def _totals(rows: DataFrame, read, buckets: int) -> np.ndarray:
    """How many features of all rows fall into each bucket; a task sends a row a bucket at most."""

    def count(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in small(batches):
            for found in read(batch):
                sums += np.bincount(found, minlength=buckets)
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(sums[full], pa.int64())], ["bucket", "n"])

    found = rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in found:
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket floor(1000 * ln of its share in the target over its share in the raw texts), one added to every bucket."""
    s_all, t_all, n = int(raw.sum()), int(target.sum()), len(raw)
    each = zip(raw.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + n)) / ((s + 1) * (t_all + n)))) for s, t in each], np.int64)


def noise(name: str) -> int:
    """floor(1000 * a Gumbel number) from a hash of the name."""
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def ranks(rows: DataFrame, order: list, scratch: Scratch) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the given order, by range partitions: the rank in the partition after the sizes of those before."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("inside"))
    placed = scratch.keep(placed, "ranked")
    at, starts = 0, []
    for part, n in sorted(map(tuple, placed.groupBy("part").count().collect())):  # a row a partition
        starts.append((part, at))
        at += n
    first = spark.createDataFrame(starts, "part int, before long")
    out = placed.join(F.broadcast(first), "part")
    return out.select(*rows.columns, (F.col("before") + F.col("inside") + 1).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_n: int = 1, buckets: int = 10_000, min_words: int = MIN_WORDS,
    drawn: tuple[int, int] = (DRAWN, OF), seed: str = SEED, head: int = HEAD,
) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_features, weight, score, rank; rank is null for rows that aren't drawn.

    ``target(text)`` is the distribution to draw towards. A row's weight is the
    mean of its features' gains, rounded down; score adds Gumbel noise of
    ``seed:id``. Of the N rows with ``min_words`` words or more the highest scores
    are drawn, floor(drawn[0] * N / drawn[1]) of them, ties to smaller ids.

    Null and empty texts have no words, weight 0, and are never drawn while
    ``min_words`` is positive. Repeated rows count each; rows with the same id and
    text tie in everything and are ranked in the order in which they were
    written. A null id is named by an empty string and comes last in ties. An
    empty table gives an empty result, an empty target even gains. Long texts are
    read in pieces, whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resample")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("raw"))

    counted = source.select("raw").mapInArrow(_word_counts, "word binary, n long").where(F.octet_length("word") <= LONGEST)
    common = frequent(counted.groupBy("word").agg(F.sum("n").alias("n")), min(head, HEAD), scratch, "words")
    made = Vocabulary([bytes(r["word"]) for r in sorted(common, key=lambda r: (-r["n"], bytes(r["word"])))], buckets)
    if max_n > 1:
        words_only = spark.sparkContext.broadcast(made)

        def pair_counts(batches):
            vocabulary = words_only.value
            for texts in small(batches):
                for text in texts.column("raw").to_pylist():
                    last = np.zeros(0, np.int64)
                    for words in pieces(text):
                        places = np.concatenate([last, vocabulary.places(words)])
                        keys, n = np.unique(vocabulary.pair_keys(places), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(keys[keys >= 0], pa.int64()), pa.array(n[keys >= 0], pa.int64())], ["pair", "n"])
                        last = places[-1:]

        counted = source.select("raw").mapInArrow(pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        made = made.with_pairs([r["pair"] for r in frequent(counted, min(head, HEAD), scratch, "pairs")])
    shared = spark.sparkContext.broadcast(made)  # `HEAD` words and pairs at most
    kind = made.kind

    def encoded(batches):
        vocabulary = shared.value
        for batch in small(batches):
            found = [vocabulary.encode(text, max_n) for text in batch.column("raw").to_pylist()]
            columns = [pa.array([n for n, _ in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "buckets"])

    def unpacked(batch):
        return (np.frombuffer(b, kind) for b in batch.column("buckets").to_pylist())

    def fresh(batch):
        return (shared.value.encode(text, max_n)[1] for text in batch.column("raw").to_pylist())

    rows = source.mapInArrow(encoded, "doc_id long, n_words long, buckets binary").withColumn("row_key", F.monotonically_increasing_id())
    rows = scratch.keep(rows, "rows")
    gain = gains(_totals(rows.select("buckets"), unpacked, buckets), _totals(target.select(as_bytes(text_col).alias("raw")), fresh, buckets))

    def weighed(batches):
        for batch in small(batches):
            weight, n = [], []
            for found in unpacked(batch):
                n.append(len(found))
                weight.append(int(gain[found].sum()) // len(found) if len(found) else 0)
            names = ["" if i is None else str(i) for i in batch.column("doc_id").to_pylist()]
            score = [w + noise(f"{seed}:{name}") for w, name in zip(weight, names, strict=True)]
            kept = [batch.column(c) for c in ("row_key", "doc_id", "n_words")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.int64()) for x in (n, weight, score))], ["row_key", "doc_id", "n_words", "n_features", "weight", "score"])

    scored = rows.select("row_key", "doc_id", "n_words", "buckets").mapInArrow(weighed, "row_key long, doc_id long, n_words long, n_features long, weight long, score long")
    scored = scratch.keep(scored, "scored")
    scratch.drop("rows")
    may = scored.where(F.col("n_words") >= min_words).select("row_key", "doc_id", "score")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row_key")]
    chosen = ranks(may, order, scratch).where(F.col("rank") <= may.count() * drawn[0] // drawn[1]).select("row_key", "rank")
    return scored.join(chosen, "row_key", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")
