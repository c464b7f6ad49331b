"""Which tokens of two tokenizers meet on the same bytes of a text.

Each tokenizer cuts the bytes of a text into tokens, which is an incidence
matrix: a row a token, a column a byte, a one where the token holds the byte.
With both in compressed sparse rows, row i of A·Bᵀ lists the tokens of B that
overlap token i of A, and how many bytes they share; it is the sum of those
rows of Bᵀ that row i of A names (Gustavson). Where tokens of both end at the
same byte a group ends; groups × tokens matrices multiply alike into the links
between tokens that share a group.

White space parts a text into chunks that no token of either crosses, so
chunks are encoded and aligned once a worker and remembered. Links are counted
corpus-wide by id pair. The frequent pairs travel with their counts to the
documents; links of other pairs go to their counts by a join.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small
from .resample import frequent

#: A worker remembers so many chunks of so many characters at most; other chunks are aligned anew each time.
MEMO, LONGEST = 400_000, 48
#: So many new chunks are encoded in one call.
TOGETHER = 2_000
#: Pairs that travel with their counts at most; proven bound of a broadcast: 4 MB.
HEAD = 262_144

#: A token may only end here for sure: at a single space or line feed between characters that no tokenizer takes for white space.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: White space of another kind or in another place.
_ODD = re.compile(r"[^\S \n]|[ \n]{2}|[ \n]\Z")


class CSR(NamedTuple):
    """A sparse matrix by rows: row i holds values[indptr[i]:indptr[i+1]] at columns indices[...]."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def of_lengths(cls, lengths: np.ndarray) -> CSR:
        """Rows of ones over neighbouring columns, so many each: tokens over bytes, or groups over tokens."""
        indptr = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return cls(indptr, np.arange(indptr[-1]), np.ones(indptr[-1], np.int64), int(indptr[-1]))

    def transposed(self) -> CSR:
        """The columns as rows, by counting sort."""
        order = np.argsort(self.indices, kind="stable")
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.width))])
        return CSR(indptr, rows[order], self.values[order], len(self.indptr) - 1)

    def __matmul__(self, other: CSR) -> CSR:
        """Gustavson's product: each row sums the rows of ``other`` that its columns name."""
        sizes = np.diff(other.indptr)[self.indices]
        ends = np.cumsum(sizes)
        # place of every addend in `other`, row by row of this matrix
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(other.indptr[self.indices] - (ends - sizes), sizes)
        rows = np.repeat(np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr)), sizes)
        columns, values = other.indices[at], np.repeat(self.values, sizes) * other.values[at]
        keys = rows * max(1, other.width) + columns
        if len(keys) and (np.diff(keys) < 0).any():
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        rows, columns = np.divmod(keys[first], max(1, other.width))
        summed = np.add.reduceat(values, first) if len(first) else np.zeros(0, np.int64)
        indptr = np.searchsorted(rows, np.arange(len(self.indptr)))
        return CSR(indptr, columns, summed, other.width)


class Alignment(NamedTuple):
    """Of texts laid end to end: overlap links as rows of tokens of A, group of each token, links of shared groups by group."""

    overlap: CSR
    group_a: np.ndarray
    group_b: np.ndarray
    shared: np.ndarray


def align(lengths_a: np.ndarray, lengths_b: np.ndarray) -> Alignment:
    """``lengths`` of the tokens of A and of B, in bytes; both sum to the same."""
    a, b = CSR.of_lengths(lengths_a), CSR.of_lengths(lengths_b)
    ends = np.intersect1d(a.indptr[1:], b.indptr[1:], assume_unique=True)
    # a group's tokens are those that end after the group before and no later than it
    upto_a, upto_b = np.searchsorted(a.indptr[1:], ends, "right"), np.searchsorted(b.indptr[1:], ends, "right")
    groups_a, groups_b = (CSR.of_lengths(np.diff(upto, prepend=0)) for upto in (upto_a, upto_b))
    shared = groups_a.transposed() @ groups_b
    rows = np.diff(shared.indptr)  # of each token of A: how many tokens of B share its group
    group_a, group_b = groups_a.transposed().indices, groups_b.transposed().indices
    return Alignment(a @ b.transposed(), group_a, group_b, np.bincount(group_a, rows, len(ends)).astype(np.int64))


class Aligned(NamedTuple):
    """A text's tokens: (a, b) of its links in two bytes each, its groups as text, and sizes."""

    links: bytes
    groups: str
    n_a: int
    n_b: int
    n_groups: int
    n_shared: int


NOTHING = Aligned(b"", "", 0, 0, 0, 0)


class Chunks(NamedTuple):
    """Aligned chunks: a row of n_a, n_b, n_groups, n_shared, links each; their links end to end; their groups, each with a semicolon behind."""

    sizes: np.ndarray
    links: np.ndarray
    groups: list[str]
    same: np.ndarray


class Aligner:
    """Tokenizer A is a byte-level BPE file of the tokenizers library, B a sentencepiece model that adds a space.

    Remembered chunks have a place in arrays. When these are full, the chunks
    that were met most often since stay.
    """

    def __init__(self, path_a: str, path_b: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        # byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in spec["model"]["vocab"].items():
            self.bytes_a[i] = bytes(map(byte_of.__getitem__, token))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # chunks are exact if no piece of B goes on after white space, and A splits by the byte-level pattern alone
        splits = spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["pre_tokenizer"]["use_regex"] and spec.get("normalizer") is None
        spans = any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        self.by_chunk = splits and not spans and self.b.encode("aﬁ  a") == self.b.encode("aﬁ") + self.b.encode(" a")
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.width = np.dtype("<u2" if most <= 1 << 16 else "<u4")
        self.said = {mark: np.array([f"{i}{mark}" for i in range(most)], object) for mark in ",|;"}
        self.most = memo
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.known = Chunks(np.zeros((0, 5), np.int64), np.zeros((0, 2), self.width), [], np.zeros(0, bool))
        self.met = np.zeros(0, np.int64)

    def chunks(self, text: str) -> list[str]:
        """Parts of space + ``text`` that begin with a space or line feed."""
        whole = " " + text
        if not self.by_chunk:
            return [whole]
        if _ODD.search(whole):
            return _CUT.split(whole)
        if "\n" not in text:
            return [f" {c}" for c in text.split(" ")]
        return [c if c[0] == "\n" else f" {c}" for c in text.replace("\n", " \n").split(" ")]

    def _ids_a(self, chunks: list[str]) -> np.ndarray:
        """Of all chunks end to end: those without white space at odd places are encoded many together, as neighbours in a text."""
        texts, run = [], []
        for c in chunks:
            if self.by_chunk and not c[-1].isspace() and not c[1:2].isspace():
                run.append(c)
                if len(run) == TOGETHER:
                    texts.append("".join(run))
                    run = []
            else:
                texts += ["".join(run), c] if run else [c]
                run = []
        texts += ["".join(run)] if run else []
        return np.array([i for e in self.a.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.int64)

    def _ids_b(self, chunks: list[str]) -> list[list[int]]:
        """A chunk that begins with a space is encoded without it, one with a line feed loses the space that B adds."""
        found = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [ids if c[0] == " " else ids[1:] for c, ids in zip(chunks, found, strict=True)]

    def align(self, chunks: list[str]) -> Chunks:
        """Each chunk's tokens and links, all chunks in one product. ``same`` tells which chunks the bytes of A and B give back; others are empty."""
        raws = [c.encode() for c in chunks]
        whole, ends = b"".join(raws), np.cumsum(list(map(len, raws)))
        ids_a, ids_b = self._ids_a(chunks), self._ids_b(chunks)
        flat_b = np.array([i for ids in ids_b for i in ids], np.int64)
        counts_b = np.array(list(map(len, ids_b)), np.int64)
        ends_a = np.cumsum(self.length_a[ids_a])
        upto = np.searchsorted(ends_a, ends, "right")
        even = len(ends_a) > 0 and (upto > 0).all() and (ends_a[upto - 1] == ends).all() and (np.cumsum(self.length_b[flat_b])[np.cumsum(counts_b) - 1] == ends).all()
        if not even or b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) != whole or b"".join(map(self.bytes_b.__getitem__, flat_b.tolist())) != whole:
            return self._align_each(chunks, raws, ids_b)
        return self._linked(ids_a, np.diff(upto, prepend=0), flat_b, counts_b, np.ones(len(chunks), bool))

    def _align_each(self, chunks: list[str], raws: list[bytes], ids_b: list[list[int]]) -> Chunks:
        ids_a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        joined = lambda table, ids: b"".join(map(table.__getitem__, ids))
        same = [joined(self.bytes_a, a) == raw == joined(self.bytes_b, b) for a, b, raw in zip(ids_a, ids_b, raws, strict=True)]
        ids_a, ids_b = ([ids if ok else [] for ids, ok in zip(x, same, strict=True)] for x in (ids_a, ids_b))
        flat_a, flat_b = (np.array([i for ids in x for i in ids], np.int64) for x in (ids_a, ids_b))
        return self._linked(flat_a, np.array(list(map(len, ids_a)), np.int64), flat_b, np.array(list(map(len, ids_b)), np.int64), np.array(same, bool))

    def _linked(self, flat_a: np.ndarray, counts_a: np.ndarray, flat_b: np.ndarray, counts_b: np.ndarray, same: np.ndarray) -> Chunks:
        made = align(self.length_a[flat_a], self.length_b[flat_b])
        links = np.stack([np.repeat(flat_a, np.diff(made.overlap.indptr)), flat_b[made.overlap.indices]], axis=1).astype(self.width)
        # where each chunk ends among tokens, links and groups
        end_a, end_b = np.cumsum(counts_a), np.cumsum(counts_b)
        end_link = made.overlap.indptr[end_a]
        group_ends = np.concatenate([[0], made.group_a + 1])[end_a]
        shared = np.concatenate([[0], np.cumsum(made.shared)])[group_ends]
        sizes = np.stack([counts_a, counts_b, np.diff(group_ends, prepend=0), np.diff(shared, prepend=0), np.diff(end_link, prepend=0)], axis=1)
        # the tokens' decimals in the order of the text: a group's of A, then its of B
        of_a, of_b = (np.bincount(g, minlength=len(made.shared)) for g in (made.group_a, made.group_b))
        said = np.empty(len(flat_a) + len(flat_b), object)
        last_a, last_b = (np.diff(g, append=-1) != 0 for g in (made.group_a, made.group_b))
        before_b, upto_a = np.concatenate([[0], np.cumsum(of_b)]), np.cumsum(of_a)
        said[np.arange(len(flat_a)) + before_b[made.group_a]] = np.where(last_a, self.said["|"][flat_a], self.said[","][flat_a])
        said[np.arange(len(flat_b)) + (upto_a[made.group_b] if len(flat_b) else 0)] = np.where(last_b, self.said[";"][flat_b], self.said[","][flat_b])
        parts, ends = said.tolist(), [0, *(end_a + end_b).tolist()]
        return Chunks(sizes, links, ["".join(parts[i:j]) for i, j in zip(ends, ends[1:], strict=False)], same)

    def _remember(self, chunks: list[str]) -> None:
        """Gives new chunks places after the known ones."""
        made, at, known = self.align(chunks), len(self.memo), self.known
        self.memo.update(zip(chunks, range(at, at + len(chunks)), strict=True))
        parts = ((known.sizes, made.sizes), (known.links, made.links), known.groups + made.groups, (known.same, made.same))
        self.known = Chunks(*(x if isinstance(x, list) else np.concatenate(x) for x in parts))
        self.met = np.concatenate([self.met, np.zeros(len(chunks), np.int64)])

    def _keep(self, at: np.ndarray) -> None:
        """Keeps the chunks at these places, in ascending order, and no others."""
        names, known, starts = list(self.memo), self.known, self._starts()
        self.memo = {names[i]: n for n, i in enumerate(at.tolist())}
        links = known.links[_ranges(starts[at], known.sizes[at, 4])]
        self.known = Chunks(known.sizes[at], links, [known.groups[i] for i in at.tolist()], known.same[at])
        self.met = self.met[at] // 2

    def _starts(self) -> np.ndarray:
        return np.cumsum(self.known.sizes[:, 4]) - self.known.sizes[:, 4]

    def texts(self, texts: list[str | None]) -> list[Aligned]:
        """Whole texts; those that are null or empty, or whose bytes A or B doesn't give back, have no tokens."""
        split = [self.chunks(t) if t else [] for t in texts]
        memo = self.memo
        new = list({c for chunks in split for c in chunks if c not in memo})
        if memo and len(memo) + len(new) > self.most:
            often = np.flatnonzero(self.met > 1)
            self._keep(np.sort(often[np.argsort(-self.met[often], kind="stable")[: self.most // 2]]))
            memo = self.memo
            new = list({c for chunks in split for c in chunks if c not in memo})
        if new:
            self._remember(new)
        known, starts, groups = self.known, self._starts(), self.known.groups
        places = [np.fromiter(map(memo.__getitem__, chunks), np.int64, len(chunks)) for chunks in split]
        out = []
        for at in places:
            if not len(at) or not known.same[at].all():
                out.append(NOTHING)
                continue
            n_a, n_b, n_groups, n_shared, _ = known.sizes[at].sum(axis=0).tolist()
            links = known.links[_ranges(starts[at], known.sizes[at, 4])].tobytes()
            out.append(Aligned(links, "".join(map(groups.__getitem__, at.tolist()))[:-1], n_a, n_b, n_groups, n_shared))
        if places:
            self.met += np.bincount(np.concatenate(places), minlength=len(memo))
        if any(len(c) > LONGEST for c in new) or len(memo) > self.most:
            short = np.array([len(c) <= LONGEST for c in memo], bool)
            self._keep(np.flatnonzero(short) if short.sum() <= self.most else np.zeros(0, np.int64))
        return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One a worker; its memo outlives a task."""
    return Aligner(path_a, path_b)


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_shared, groups_sha256, links.

    ``links`` packs the (a, b) ids of all overlapping tokens in order, in two
    bytes an id (four for larger vocabularies). ``n_shared`` counts the pairs of
    tokens that share a group. Texts that are null, empty or not given back by
    both have none, and '' as ``groups_sha256``. Rows stand for themselves,
    repeated or not; other columns are ignored; an empty table gives an empty result.
    """

    def encoded(batches):
        own = aligner(path_a, path_b)
        for batch in small(batches, 2 << 20):
            found = own.texts(batch.column("text").to_pylist())
            digests = [hashlib.sha256(x.groups.encode()).hexdigest() if x.n_a else "" for x in found]
            sizes = [pa.array([getattr(x, name) for x in found], pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_shared")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *sizes, pa.array(digests, pa.string()), pa.array([x.links for x in found], pa.binary())], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_shared", "groups_sha256", "links"]
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_shared long, groups_sha256 string, links binary"
    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encoded, schema)
    # tokens that overlap or share an end make a staircase in each group
    return made.withColumn("n_links", F.col("n_a") + F.col("n_b") - F.col("n_groups"))


def link_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """``aligned_texts`` without links, with n_best and count_sum from the corpus-wide counts of id pairs.

    A pair's count is how many links of all rows hold it. ``n_best`` counts a
    row's links whose pair is the most frequent of its B id, ties included;
    ``count_sum`` sums the counts over its links. The ``head`` most frequent pairs
    are looked up where the links are, the others joined; both are exact.
    Rows without links have zeros.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    rows = aligned_texts(docs, path_a, path_b, id_col, text_col).withColumn("row_key", F.monotonically_increasing_id())
    rows = scratch.keep(rows, "rows")
    width = aligner(path_a, path_b).width
    bits = 8 * width.itemsize

    def keys_of(raw: bytes) -> np.ndarray:
        both = np.frombuffer(raw, width).astype(np.int64).reshape(-1, 2)
        return (both[:, 0] << bits) | both[:, 1]

    def pairs(batches):
        for batch in small(batches, 16 << 20):
            found, n = np.unique(np.concatenate([np.zeros(0, np.int64), *map(keys_of, batch.column("links").to_pylist())]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    counted = rows.select("links").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counted, "counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << bits) - 1))
    # a row for each id of B at most: the vocabulary bounds it
    most = scratch.keep(counts.groupBy(b.alias("b")).agg(F.max("n").alias("most")), "most")
    counts = scratch.keep(counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "judged")
    top = sorted((r["pair"], r["n"], r["best"]) for r in frequent(counts, head, scratch, "top"))  # `head` rows at most
    shared = spark.sparkContext.broadcast(tuple(np.array(x, np.int64) for x in (zip(*top, strict=True) if top else ((), (), ()))))

    def looked_up(batches):
        known, count, best = shared.value
        for batch in small(batches, 16 << 20):
            out: dict[str, list] = {name: [] for name in ("n_best", "count_sum", "rare", "times")}
            for raw in batch.column("links").to_pylist():
                keys = keys_of(raw)
                at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
                hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
                at = at[hit]
                rare, times = np.unique(keys[~hit], return_counts=True)
                for name, x in (("n_best", int(best[at].sum())), ("count_sum", int(count[at].sum())), ("rare", rare), ("times", times)):
                    out[name].append(x)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), pa.array(out["n_best"], pa.int64()), pa.array(out["count_sum"], pa.int64()), pa.array(out["rare"], longs), pa.array(out["times"], longs)],
                ["row_key", *out],
            )

    schema = "row_key long, n_best long, count_sum long, rare array<long>, times array<long>"
    judged = scratch.keep(rows.select("row_key", "links").mapInArrow(looked_up, schema), "looked-up")
    each = judged.select("row_key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row_key", F.col("x.rare").alias("pair"), F.col("x.times").alias("times"))
    rest = each.join(counts, "pair").groupBy("row_key").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"), F.sum(F.col("times") * F.col("n")).alias("rare_sum")
    )
    sums = judged.select("row_key", "n_best", "count_sum").join(rest, "row_key", "left")
    sums = sums.select(
        "row_key", (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum")
    )
    out = rows.drop("links").join(sums, "row_key")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")
