"""Byte-level BPE by a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Every adjacent pair that some merge
rank joins waits in that rank's bucket, and a two-level bitmap over the ranks
tells by find-first-set which bucket is next; entries whose pair has changed
since are skipped. A pre-token of n bytes takes O(n log n), however long.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small

#: A worker keeps the ids of this many pre-tokens before it starts anew.
MEMO = 500_000


class BytePairEncoder:
    """Encodes and decodes by merge ranks. ``pattern`` splits a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        # the rank files' pattern means Unicode white space, Python's \s adds four control characters
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        top = max(ranks.values(), default=0) + 1
        self.tokens = [b""] * top
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimals = [str(n) for n in range(top)]
        self.buckets: list[list[int]] = [[] for _ in range(top)]
        self.leaves = [0] * ((top >> 8) + 1)
        self.memo: dict[str, tuple[int, ...]] = {}

    @classmethod
    def read(cls, path: str, pattern: str) -> BytePairEncoder:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        rank_of, buckets, leaves = self.ranks.get, self.buckets, self.leaves
        n, top = len(piece), 0
        after, before = list(range(1, n + 2)), list(range(-1, n))
        # the rank of the pair that starts at each byte, as of now
        due = [rank_of(piece[at : at + 2], -1) for at in range(n)]
        due[n - 1] = -1
        for at, rank in enumerate(due):
            if rank >= 0:
                buckets[rank].append(at)  # ascending, so already a heap
                leaf = rank >> 8
                leaves[leaf] |= 1 << (rank & 255)
                top |= 1 << leaf
        while top:
            leaf = (top & -top).bit_length() - 1
            bits = leaves[leaf]
            rank = (leaf << 8) | ((bits & -bits).bit_length() - 1)
            bucket = buckets[rank]
            at = heappop(bucket)
            if not bucket:
                bits &= bits - 1
                leaves[leaf] = bits
                if not bits:
                    top &= top - 1
            if due[at] != rank:
                continue  # stale: one of the two parts has been merged since
            gone = after[at]
            end = after[gone]
            due[gone] = due[at] = -1
            after[at], before[end] = end, at
            if end < n:
                rank = rank_of(piece[at : after[end]], -1)
                if rank >= 0:
                    due[at] = rank
                    heappush(buckets[rank], at)
                    leaf = rank >> 8
                    leaves[leaf] |= 1 << (rank & 255)
                    top |= 1 << leaf
            left = before[at]
            if left >= 0:
                rank = rank_of(piece[left:end], -1)
                if rank != due[left]:
                    due[left] = rank
                    if rank >= 0:
                        heappush(buckets[rank], left)
                        leaf = rank >> 8
                        leaves[leaf] |= 1 << (rank & 255)
                        top |= 1 << leaf
        ids, at = [], 0
        while at < n:
            ids.append(self.ranks[piece[at : after[at]]])
            at = after[at]
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        memo, ids = self.memo, []
        known, extend = memo.get, ids.extend
        for token in self.split(text):
            found = known(token)
            if found is None:
                found = self.merge(token.encode())
                if len(token) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[token] = found
            extend(found)
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def spelled(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.decimals.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One encoder a worker; its memo outlives a task."""
    return BytePairEncoder.read(path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids; null and empty texts have none.

    The rank file must be at the same path on every executor. The added column is
    the last and called ``out_col``, with underscores behind where ``docs`` has
    that one. Texts of any length are encoded whole; repeated rows stay; an empty
    table gives an empty result.
    """
    out_col = free_name(docs, out_col)

    def run(batches):
        bpe = encoder(ranks_path, pattern)
        for batch in small(batches):
            ids = [bpe.encode(t or "") for t in batch.column(text_col).to_pylist()]
            yield batch.append_column(out_col, pa.array(ids, pa.list_(pa.int32())))

    return docs.mapInArrow(run, _with(docs, out_col, "array<int>"))


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for, in a last column that is named as ``encode_documents`` names its own; null ids give empty bytes."""
    out_col = free_name(encoded, out_col)

    def run(batches):
        bpe = encoder(ranks_path, pattern)
        for batch in small(batches):
            made = [bpe.decode(ids or ()) for ids in batch.column(ids_col).to_pylist()]
            yield batch.append_column(out_col, pa.array(made, pa.binary()))

    return encoded.mapInArrow(run, _with(encoded, out_col, "binary"))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Digests of encoding and decoding every text: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` the ids.

    One pass in which each text is encoded, and its ids are decoded again. Null
    counts as empty: no tokens, and the digests of nothing. Rows stay as they
    are, repeated ids and null ids included; an empty table gives an empty
    result; other columns are ignored.
    """
    sha = lambda raw: hashlib.sha256(raw).hexdigest()

    def run(batches):
        bpe = encoder(ranks_path, pattern)
        for batch in small(batches):
            n, ids_sha, decoded_sha, kept = [], [], [], []
            for text in batch.column("text"):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(sha(bpe.spelled(ids).encode()))
                decoded_sha.append(sha(bpe.decode(ids)))
                if with_ids:
                    kept.append(np.array(ids, np.int32))
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())}
            if with_ids:
                out["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return narrow.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def _with(df: DataFrame, name: str, kind: str):
    return df.withColumn(name, F.lit(None).cast(kind)).schema
