"""Mixing sources to target weights along a time-varying curriculum.

A source's documents, in a hashed order, form a stream of words. Its target
says how many words of the stream training takes (a second pass repeats the
first documents), its schedule when: the schedule's weight over training time
is integrated, and the inverse of that cumulative demand turns a word's place
in the stream into a training position in [0, 1]. Documents are range-sorted
by position.

Only DataFrame operations are used. Places in a stream are prefix sums, taken
in two levels: sums of about sqrt(n) blocks for each source, then within a
block, so no task holds a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Weights by rank of the source, repeating; shapes of schedules as (time, weight) knots, one for each of the weights.
WEIGHTS = (5, 2, 1)
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (0.5, 1.25), (1.0, 0.75)), ((0.0, 0.5), (1.0, 1.5)))
SHARE, MOST = 1.5, 2.0
#: A word as the contract has it.
WORD = r"[^\x20\x09-\x0D]+"


def segments(knots) -> list[tuple[float, float, float, float]]:
    """(demand before, start, weight at start, slope) of each piece of a schedule scaled to a demand of 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append((before, t0, w0 / area, (w1 - w0) / area / (t1 - t0)))
        before += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def position_at(share: Column, knots) -> Column:
    """The time at which the schedule's cumulative demand reaches ``share``."""
    at = None
    for before, start, weight, slope in segments(knots):
        more = share - F.lit(before)
        if abs(slope) < 1e-12:
            time = F.lit(start) + more / F.lit(weight)
        else:
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(weight * weight) + F.lit(2 * slope) * more))
            time = F.lit(start) + (root - F.lit(weight)) / F.lit(slope)
        at = time if at is None else F.when(share >= before, time).otherwise(at)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), at))


def targets(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size).

    Sources by code point, null last, get the weights in turn. They share
    ``SHARE`` of all words by weight; none gets over ``MOST`` times its size, and
    what it leaves is shared by the others by weight: target = min(MOST * size,
    level * weight), where the level is found from running sums over the sources
    by the level at which each is full.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", (F.row_number().over(by_name) - 1) % len(weights))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("rank") + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(MOST))
    ranked = ranked.withColumn("full_at", F.col("most") / F.col("weight"))
    up, whole = Window.orderBy("full_at", F.col("source").isNull(), "source"), Window.partitionBy()
    earlier = up.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(SHARE) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level)
    # valid from the first source that isn't full at its level, and falling from there on
    levels = levels.withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(whole))
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return levels.select("source", "source_size", "rank", target.alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, schedules=SCHEDULES, carry: bool = False
) -> DataFrame:
    """A row for each row of ``docs``: doc_id, source, size, source_size, target, taken, passes, position; with ``carry`` the whole row too.

    ``passes`` lists (words, position) of the first and second time the mix
    comes to the document; ``taken`` sums its words, at most twice its size. A
    source's words sum to its target, rounded down, because the document at the
    end of the stream is taken in part. ``position`` is the first of them; rows
    that aren't taken have none. Null texts have size 0 and null sources form one
    source. Rows with repeated or null ids are placed one by one; rows equal in
    id, source and size are interchangeable. Reruns agree. An empty table gives
    an empty result. Other columns of ``docs`` are ignored or carried as ``row``.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), *([F.struct("*").alias("row")] if carry else [])
    )
    scratch = Scratch(docs.sparkSession, "mix")
    narrow = scratch.keep(rows.select("doc_id", "source", "size"), "sizes")
    per_source = max(1, math.ceil(math.sqrt(narrow.count())))
    order = F.pmod(F.xxhash64("doc_id", "size"), F.lit(1 << 31))
    block = F.shiftright(order * F.lit(per_source), 31)

    blocks = narrow.groupBy("source", block.alias("block")).agg(F.sum("size").alias("words"))
    goal = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    start = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("start", start).withColumnRenamed("source", "in_source")
    plan = blocks.join(goal, F.col("in_source").eqNullSafe(F.col("source")))
    plan = scratch.keep(plan.select("in_source", F.col("block").alias("in_block"), "start", "source_size", "rank", "target"), "plan")

    rows = rows if carry else narrow
    inside = Window.partitionBy("source", "block").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("order", order).withColumn("block", block).withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("block") == F.col("in_block")))
    offset, wanted = F.col("start") + F.col("before"), F.floor("target")

    def one_pass(number: int) -> Column:
        at = offset + F.lit(number) * F.col("source_size")
        taken = F.greatest(F.lit(0), F.least(F.col("size"), wanted - at)).cast("long")
        share = at / F.greatest(F.col("target"), F.lit(1e-9))
        when = position_at(share, schedules[0])
        for rank in range(1, len(schedules)):
            when = F.when(F.col("rank") % len(schedules) == rank, position_at(share, schedules[rank])).otherwise(when)
        return F.struct(taken.alias("words"), when.alias("position"))

    passes = F.filter(F.array(*(one_pass(n) for n in range(math.ceil(MOST)))), lambda p: p["words"] > 0)
    placed = placed.withColumn("passes", passes)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda total, p: total + p["words"])
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "passes", F.get("passes", F.lit(0))["position"].alias("position"), *(["row"] if carry else [])
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """``mixed`` with a row for each pass (words, position), range-sorted by training position.

    Rows of one position are in the order of their ids, null ids first; those equal
    in both are in any order. Rows that aren't taken have no pass and go. Repeated
    rows are passes of their own; an empty table gives an empty result.
    """
    each = mixed.drop("position").select("*", F.explode("passes").alias("pass")).select("*", "pass.words", "pass.position").drop("pass", "passes")
    return each.orderBy("position", "doc_id")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` in training order, a row for each pass that takes at least half of the document's words.

    Texts stay whole: the document at the end of a source's stream is taken or
    left by where its middle falls. Documents without words go, so null and empty
    texts do. Null sources are one source, rows with repeated or null ids are
    placed one by one, a document may come twice, and columns stay as they are,
    whatever they are called. An empty table gives an empty result.
    """
    each = training_order(mix(docs, carry=True)).where(F.col("words") * 2 >= F.col("size"))
    return each.select("row.*")
