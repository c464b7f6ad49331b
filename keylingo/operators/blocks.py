"""Running values along one long sequence, in many tasks: a segmented scan over range partitions.

``dealt`` cuts rows into blocks by (key, order), as ranges of about equal size, so
a key that holds most rows lies in many neighbouring blocks. A scan then works
inside each (key, block), sums each up in one row, runs over these summaries,
and carries what came before a block, or comes behind it, into the block. Only
keys that span blocks have carries: less than two for each block, so they are
joined by broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import kept

BLOCK = "__block"


def dealt(df: DataFrame, by: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` with its block, written down so that blocks stay as they are; ``df`` itself if it has blocks.

    Without ``parts`` the session's shuffle partitions, joined to fit by adaptive
    execution, are the blocks.
    """
    if BLOCK in df.columns:
        return df
    ranges = [F.asc(c) for c in (*by, *order)]
    spread = df.repartitionByRange(*ranges) if parts is None else df.repartitionByRange(parts, *ranges)
    return kept(spread.withColumn(BLOCK, F.spark_partition_id()), "blocks")


def inside(by: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*by, BLOCK).orderBy(*order)


def along(by: Sequence[str]) -> Window:
    """The blocks of a key."""
    return Window.partitionBy(*by).orderBy(BLOCK)


def summaries(blocks: DataFrame, by: Sequence[str], *aggregates: Column) -> DataFrame:
    """A row for each (key, block) of keys that span blocks."""
    made = blocks.groupBy(*by, BLOCK).agg(*aggregates)
    return made.withColumn("__of", F.count("*").over(Window.partitionBy(*by))).where("__of > 1").drop("__of")


def carried(blocks: DataFrame, carries: DataFrame, by: Sequence[str]) -> DataFrame:
    """``blocks`` with the columns of ``carries``, null for keys within a block. Null keys are keys too."""
    names = {c: f"__k{n}" for n, c in enumerate((*by, BLOCK))}
    small = F.broadcast(carries.withColumnsRenamed(names))  # less than two rows a block
    same = reduce(Column.__and__, (blocks[c].eqNullSafe(F.col(k)) for c, k in names.items()))
    return blocks.join(small, same, "left").drop(*names.values())


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``, the rows of each key counted from 1 in an order: a block's own count after those of the blocks before it."""
    ranges = [F.asc(c) for c in by] + list(order)
    spread = df.repartitionByRange(*ranges) if parts is None else df.repartitionByRange(parts, *ranges)
    blocks = kept(spread.withColumn(BLOCK, F.spark_partition_id()), "blocks")
    counts = summaries(blocks, by, F.count("*").alias("__n")).withColumn("__n", F.sum("__n").over(along(by).rowsBetween(Window.unboundedPreceding, -1)))
    here = F.row_number().over(Window.partitionBy(*by, BLOCK).orderBy(*order))
    return carried(blocks, counts, by).withColumn(name, here + F.coalesce("__n", F.lit(0))).drop("__n", BLOCK)


def folded(
    blocks: DataFrame, by: str, order: Sequence[str], summary: Callable, summary_type: str, carry: Callable, carry_type: str, run: Callable, schema: T.StructType
) -> DataFrame:
    """Folds in Python that run over a key's rows in order, one task a block.

    ``summary(rows)`` gives what a block does, as a tuple of ``summary_type``, for
    an iterator of its rows; ``carry(state, summary)`` gives the state after a
    block, a tuple of ``carry_type``, from the state before it (None at first);
    ``run(state, rows)`` gives the output rows of a block. Rows are streamed from
    a sort, and so are the summaries of a key.
    """
    columns = blocks.columns

    def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[int, ...]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
        from itertools import groupby

        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        return groupby(rows, key=lambda r: tuple(r[k] for k in keys))

    def emit(rows: Iterator[tuple], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) == 10_000:
                yield batch_of(held, kind)
                held = []
        if held:
            yield batch_of(held, kind)

    def batch_of(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    def typed(kind: T.StructType) -> pa.Schema:
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(kind)

    key, block = blocks.schema[by], T.StructField(BLOCK, T.IntegerType())
    summed = T.StructType([key, block, T.StructField("s", T._parse_datatype_string(summary_type))])
    states = T.StructType([key, block, T.StructField("state", T._parse_datatype_string(carry_type))])
    at = (columns.index(by), columns.index(BLOCK))

    def summarise(batches):
        yield from emit(((*k, summary(rows)) for k, rows in grouped(batches, at)), typed(summed))

    def states_before(rows):
        state = None
        for of, number, done in rows:
            yield of, number, state
            state = carry(state, tuple(done.values()))

    def scan(batches):
        yield from emit((out for _, rows in grouped(batches, (0,)) for out in states_before(rows)), typed(states))

    def fold(batches):
        def outputs():
            for _, rows in grouped(batches, at):
                first = next(rows)
                state = first[-1]
                yield from run(None if state is None else tuple(state.values()), (row for part in ((first,), rows) for row in part))

        yield from emit(outputs(), typed(schema))

    placed = lambda df: df.repartition(by, BLOCK).sortWithinPartitions(by, BLOCK, *order)
    done = kept(placed(blocks).mapInArrow(summarise, summed), "summaries")
    done = done.withColumn("__of", F.count("*").over(Window.partitionBy(by))).where("__of > 1").drop("__of")
    carries = kept(done.repartition(by).sortWithinPartitions(by, BLOCK).mapInArrow(scan, states), "carries")
    return placed(carried(blocks, carries, (by,))).mapInArrow(fold, schema)
