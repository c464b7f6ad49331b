"""Exact duplicates by distributed most-significant-digit radix partitioning.

Texts are split by successive runs of bytes until every group is a single text
or has ended; equality is decided by the bytes themselves, never by a digest.
A round splits each open group by the next digit. A digit is one run of bytes,
and runs grow from ``FIRST`` by ``GROWTH`` up to ``WIDEST``, so a text of n
bytes takes O(log n) rounds and few texts go beyond the first.

A round is one aggregation of (group, digit), combined before its shuffle, so a
hot group of copies sends a row per task, and one plain equi-join that hands
the new group back to its rows, where adaptive execution may split hot keys.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import SPACES, Scratch, as_bytes, small

FIRST, GROWTH, WIDEST = 256, 8, 1 << 21


def _rests(batches):
    """What follows the first digit, of rows whose text hasn't ended there."""
    for batch in small(batches):
        rest = [t.translate(None, SPACES)[FIRST:] for t in batch.column("raw").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("gid"), pa.array(rest, pa.binary())], ["row_key", "gid", "rest"])


def _normalised(batches):
    for batch in small(batches):
        texts = batch.column("raw").to_pylist()
        plain = [t.translate(None, SPACES) for t in texts]
        made = {
            "n_points": pa.array([len(t.decode("utf-8", "replace")) for t in texts], pa.int64()),
            "text_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in plain], pa.string()),
            "digit": pa.array([p[:FIRST] for p in plain], pa.binary()),
        }
        kept = {name: batch.column(name) for name in batch.schema.names}
        yield pa.RecordBatch.from_pydict(kept | made)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``;
    null counts as empty, and all empty texts form one group. Of a group the row
    with the most code points in its original text stays, then the smallest id
    (null ids last); rows equal in both are told apart by an internal row key,
    so exactly one row of each group stays even where ids repeat. An empty
    table gives an empty result; other columns are ignored. Very long texts
    take more rounds and are never cut. The SHA-256 is reported, not compared.
    """
    rows, placed, _ = _solve(docs, id_col, text_col, carry=False)
    out = rows.select("row_key", "doc_id", "text_sha256").join(placed, "row_key", "left")
    return out.select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("keep_key") == F.col("row_key"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one whole row of each group of equal texts, in its own columns.

    The row that stays is the one that ``duplicate_groups`` keeps, also where
    ids are null or repeat.
    """
    rows, placed, _ = _solve(docs, id_col, text_col, carry=True)
    dropped = placed.where(F.col("keep_key") != F.col("row_key")).select("row_key")
    return rows.select("row_key", "row").join(dropped, "row_key", "left_anti").select("row.*")


def _solve(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> tuple[DataFrame, DataFrame, Scratch]:
    """The numbered rows, and for rows of groups of two or more the row that stays."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("raw"), *([F.struct("*").alias("row")] if carry else [])
    )
    schema = StructType(list(source.schema))
    for name, kind in (("n_points", "long"), ("text_sha256", "string"), ("digit", "binary")):
        schema = schema.add(name, kind)
    # the row key names a row from here on; written down, it can't change on a retry
    numbered = source.mapInArrow(_normalised, schema).withColumn("row_key", F.monotonically_increasing_id())
    rows = scratch.keep(numbered.drop("raw") if carry else numbered, "rows")
    raw = as_bytes(f"row.{text_col}") if carry else F.col("raw")

    # first round: no rest of a text moves, and most rows end here as groups of one
    groups = scratch.keep(_groups(rows.select(F.lit(0).alias("gid"), "digit", "row_key")).drop("gid"), "groups0")
    first = rows.select("row_key", "digit").join(groups, "digit")
    first = scratch.keep(first.select("row_key", F.col("new_gid").alias("gid"), (F.octet_length("digit") < FIRST).alias("ended")), "first")
    done = first.where("ended").select("row_key", "gid")
    going_on = first.where("not ended").select("row_key", "gid").join(rows.select("row_key", raw.alias("raw")), "row_key")
    state = scratch.keep(going_on.mapInArrow(_rests, "row_key long, gid long, rest binary"), "state0")
    scratch.drop("groups0")

    number, width = 0, FIRST * GROWTH
    while not state.isEmpty():
        number += 1
        parts = state.select(
            "row_key", "gid", F.expr(f"substring(rest, 1, {width})").alias("digit"), F.expr(f"substring(rest, {width + 1})").alias("rest")
        )
        groups = scratch.keep(_groups(parts), f"groups{number}")
        split = parts.join(groups, ["gid", "digit"])
        split = split.select("row_key", F.col("new_gid").alias("gid"), (F.octet_length("digit") < width).alias("ended"), "rest")
        split = scratch.keep(split, f"state{number}")
        done = done.unionByName(split.where("ended").select("row_key", "gid"))
        state = split.where("not ended").select("row_key", "gid", "rest")
        scratch.drop(f"groups{number}")
        width = min(width * GROWTH, WIDEST)

    members = scratch.keep(rows.select("row_key", "doc_id", "n_points").join(done, "row_key"), "members")
    scratch.drop(*(f"state{n}" for n in range(number + 1)), "first")
    order = F.struct(
        (-F.col("n_points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row_key").alias("key")
    )
    best = members.groupBy("gid").agg(F.min(order).alias("best"), F.count("*").alias("size"))
    # written first, so that the join below shuffles both sides and hot groups can be split
    best = scratch.keep(best.select("gid", F.col("best.id").alias("keep_id"), F.col("best.key").alias("keep_key"), "size"), "best")
    placed = scratch.keep(members.join(best, "gid").select("row_key", "keep_id", "keep_key", "size"), "placed")
    scratch.drop("members", "best")
    return rows, placed, scratch


def _groups(rows: DataFrame) -> DataFrame:
    """The groups of two rows or more after a split, named by their smallest row key."""
    found = rows.groupBy("gid", "digit").agg(F.min("row_key").alias("new_gid"), F.count("*").alias("n"))
    return found.where("n > 1").drop("n")
