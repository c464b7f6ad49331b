"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within 4 bits of each other share a 64-bit value within
2 bits of both. So every distinct fingerprint emits the 1 + 64 + 2,016 = 2,081
values of its ball of radius 2, and fingerprints that emit the same value are
linked: each is within 2 bits of it, hence within 4 of the other. Linking all of
them to the smallest keeps every component and never lists a group's pairs; a
value is shared by at most 2,081 distinct fingerprints.

Nearly all values are emitted once. They are shuffled twice so that those need
not travel whole: first as sorted, delta-coded prefixes of a 64-bit mix of the
value, which find all that might be shared; then the shared values themselves,
on which fingerprints meet. The first pass can only name too many values.

Blocks hold about ``BLOCK`` fingerprints and buckets about ``BUCKET`` values,
so a task's memory doesn't grow with the input.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, as_bytes, small, words
from .components import components

RADIUS, SHINGLE, SEED = 4, 4, 42
BLOCK, BUCKET = 1024, 1 << 21
#: Tasks of a shuffle at most: beyond it a task takes several blocks or buckets, one after the other.
TASKS = 8192
#: Prefixes have so many bits more than it takes to count all values: one value in 2**SPARE is named in vain.
SPARE = 7


def _ball() -> np.ndarray:
    """Differences of up to half the radius."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    return np.concatenate([np.zeros(1, np.uint64), one, one[i] | one[j]])


def fingerprint(text: bytes | None) -> int:
    """The 64-bit SimHash of a text's 4-word shingles, as a signed integer; 0 without words."""
    found = words(text)
    if not found:
        return 0
    if len(found) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    else:
        joined = b" ".join(found)
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    raw = np.array(hashes, np.uint64)
    for at in range(0, len(raw), 65536):
        part = raw[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = (bits * 2 > len(raw)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long. ``carry`` adds the whole row."""

    def run(batches):
        for batch in small(batches):
            made = [fingerprint(t) for t in batch.column("raw").to_pylist()]
            kept = {name: batch.column(name) for name in batch.schema.names if name != "raw"}
            yield pa.RecordBatch.from_pydict(kept | {"fp": pa.array(made, pa.int64())})

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("raw"), *([F.struct("*").alias("row")] if carry else []))
    return narrow.mapInArrow(run, StructType(list(narrow.drop("raw").schema)).add("fp", "long"))


def _mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose high bits depend on all bits."""
    x = values ^ (values >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xBF58476D1CE4E5B9)


def _pack(values: np.ndarray, bits: int) -> bytes:
    """A sorted array of values of ``bits`` bits: whole low bytes, then odd low bits, then the rest in unary (Elias-Fano)."""
    n = len(values)
    low = max(0, bits - max(0, math.ceil(math.log2(n))))
    parts = [np.array([n], np.uint64).tobytes(), bytes([low])]
    for byte in range(low // 8):
        parts.append((values >> np.uint64(8 * byte)).astype(np.uint8).tobytes())
    if low % 8:
        odd = (values >> np.uint64(low // 8 * 8)).astype(np.uint8)
        parts.append(np.packbits(np.unpackbits(odd[:, None], axis=1, count=low % 8, bitorder="little").ravel(), bitorder="little").tobytes())
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    parts.append(np.packbits(high, bitorder="little").tobytes())
    return b"".join(parts)


def _unpack(packed: bytes) -> np.ndarray:
    n, low = int(np.frombuffer(packed, np.uint64, 1)[0]), packed[8]
    at, values = 9, np.zeros(n, np.uint64)
    for byte in range(low // 8):
        values |= np.frombuffer(packed, np.uint8, n, at).astype(np.uint64) << np.uint64(8 * byte)
        at += n
    if low % 8:
        size = -(-n * (low % 8) // 8)
        odd = np.unpackbits(np.frombuffer(packed, np.uint8, size, at), count=n * (low % 8), bitorder="little").reshape(n, low % 8)
        values |= np.packbits(odd, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(low // 8 * 8)
        at += size
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=at), bitorder="little"))[:n]
    return values | ((ones - np.arange(n)).astype(np.uint64) << np.uint64(low))


def near_links(points: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect all of the distinct ``fp`` of ``points`` within the radius.

    Each link is a pair within the radius, and two fingerprints within it are
    connected by links. Pairs that meet more than once are listed once.
    """
    n = points.count()
    values = max(1, n) * len(_ball())
    blocks = max(1, math.ceil(n / BLOCK))
    bits = min(64, math.ceil(math.log2(values)) + SPARE)
    buckets = 1 << max(0, math.ceil(math.log2(values / BUCKET)))
    rest_bits = bits - int(math.log2(buckets))
    block_bits = max(1, math.ceil(math.log2(blocks + 1)))
    if rest_bits + block_bits > 64:
        raise ValueError("too many fingerprints for 64-bit keys")
    shift, low = np.uint64(64 - bits), np.uint64(rest_bits)
    blocked = scratch.keep(points.select("fp", F.pmod(F.xxhash64("fp"), F.lit(blocks)).cast("int").alias("block")), "points")

    def emit(key, part):
        mine = part["fp"].to_numpy().astype(np.int64).view(np.uint64)
        prefixes = _mix((mine[:, None] ^ _ball()[None, :]).ravel()) >> shift
        prefixes.sort()
        edges = np.searchsorted(prefixes, np.arange(buckets + 1, dtype=np.uint64) << low)
        made = []
        for bucket in np.flatnonzero(np.diff(edges)):
            own = prefixes[edges[bucket] : edges[bucket + 1]] & ((np.uint64(1) << low) - np.uint64(1))
            made.append((int(bucket), int(key[0]), _pack(own, rest_bits)))
        return pd.DataFrame(made, columns=["bucket", "block", "packed"])

    def meet(key, part):
        tag = np.uint64(block_bits)
        keys = np.concatenate([(_unpack(p) << tag) | np.uint64(b) for b, p in zip(part["block"], part["packed"], strict=True)])
        keys.sort()
        prefix = keys >> tag
        same = prefix[1:] == prefix[:-1]
        shared = np.zeros(len(keys), bool)
        shared[1:] |= same
        shared[:-1] |= same
        found = np.unique(keys[shared])
        block = (found & ((np.uint64(1) << tag) - np.uint64(1))).astype(np.int64)
        whole = (found >> tag) | (np.uint64(int(key[0])) << low)
        order = np.argsort(block, kind="stable")
        block, whole = block[order], whole[order]
        edges = np.flatnonzero(np.diff(block, prepend=-1))
        return pd.DataFrame(
            {"block": block[edges].astype(np.int32), "shared": [x.tobytes() for x in np.split(whole, edges[1:])] if len(edges) else []}
        )

    def share(key, part, hits):
        none = pd.DataFrame({"value": pd.Series([], dtype="int64"), "fp": pd.Series([], dtype="int64"), "link": pd.Series([], dtype="bool")})
        if not len(hits) or not len(part):
            return none
        wanted = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in hits["shared"]]))
        mine = np.sort(part["fp"].to_numpy().astype(np.int64).view(np.uint64))
        ball, mask = _ball(), np.uint64((1 << 22) - 1)
        maybe = np.zeros(1 << 22, bool)
        maybe[(wanted & mask).astype(np.int64)] = True
        value, owner = [], []
        for at in range(0, len(mine), 256):
            own = mine[at : at + 256]
            emitted = (own[:, None] ^ ball[None, :]).ravel()
            prefixes = _mix(emitted) >> shift
            hit = np.flatnonzero(maybe[(prefixes & mask).astype(np.int64)])
            where = np.searchsorted(wanted, prefixes[hit])
            hit = hit[(where < len(wanted)) & (wanted[np.minimum(where, len(wanted) - 1)] == prefixes[hit])]
            value.append(emitted[hit])
            owner.append(own[hit // len(ball)])
        value, owner = np.concatenate(value), np.concatenate(owner)
        # fingerprints of this block that meet here are linked here, and one of them stands for them elsewhere
        order = np.lexsort((owner.view(np.int64), value))
        value, owner = value[order], owner[order]
        new = np.concatenate([[True], value[1:] != value[:-1]])[: len(value)]
        hub = owner[np.flatnonzero(new)][np.cumsum(new) - 1] if len(value) else owner
        pairs = np.unique(np.stack([hub[~new], owner[~new]]).view(np.int64), axis=1)
        return pd.concat(
            [
                pd.DataFrame({"value": value[new].view(np.int64), "fp": owner[new].view(np.int64), "link": False}),
                pd.DataFrame({"value": pairs[0], "fp": pairs[1], "link": True}),
            ]
        )

    # small inputs, much work: partitions by block and bucket, which adaptive execution doesn't merge
    blocked = blocked.repartition(min(blocks, TASKS), "block")
    sent = blocked.groupBy("block").applyInPandas(emit, "bucket int, block int, packed binary")
    hits = sent.repartition(min(buckets, TASKS), "bucket").groupBy("bucket").applyInPandas(meet, "block int, shared binary")
    hits = hits.repartition(min(blocks, TASKS), "block")
    met = blocked.groupBy("block").cogroup(hits.groupBy("block")).applyInPandas(share, "value long, fp long, link boolean")
    met = scratch.keep(met, "met")
    inside = met.where("link").select(F.col("value").alias("a"), F.col("fp").alias("b"))
    across = met.where("not link").groupBy("value").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))
    across = across.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")
    return inside.unionByName(across).distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    The component is that of fingerprints linked at 4 or fewer differing bits,
    named by its smallest doc_id (null if all its ids are null). Null, empty and
    blank texts have fingerprint zero and are linked like any other; texts of
    fewer than four words hash as a whole. Rows with repeated or null ids stay as
    they are; an empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, id_col, text_col), "rows")
    out = rows.join(_placed(rows, scratch), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _placed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, root, component_id) of every fingerprint: a member that names its component, and the smallest id."""
    points = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = near_links(points.select("fp"), scratch)
    placed = scratch.keep(components(links, scratch), "placed")
    # fingerprints without a link keep their own smallest id
    rooted = scratch.keep(points.join(placed, points["fp"] == placed["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = scratch.keep(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    by_fp = scratch.keep(rooted.join(named, "root").select("fp", "root", "component_id"), "by-fp")
    scratch.drop("distinct", "points", "met", "placed", "rooted", "named")
    return by_fp


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one whole row of each component: that with the smallest id, null ids last.

    Rows are told apart by an internal row key, also where ids repeat or are null.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    # the row key names a row from here on; written down, it can't change on a retry
    rows = scratch.keep(fingerprints(docs, id_col, text_col, carry=True).withColumn("row_key", F.monotonically_increasing_id()), "rows")
    members = rows.select("row_key", "doc_id", "fp").join(_placed(rows, scratch), "fp")
    members = scratch.keep(members.select("row_key", "doc_id", "root"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row_key").alias("key"))
    best = scratch.keep(members.groupBy("root").agg(F.min(order)["key"].alias("keep_key")), "best")
    gone = members.join(best, "root").where("row_key <> keep_key").select("row_key")
    return rows.select("row_key", "row").join(gone, "row_key", "left_anti").select("row.*")
