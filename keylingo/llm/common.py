"""Shared pieces of the training-data operators: tables, scratch space, text."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space bytes that the contracts name, [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares, as ``spark.checkpoint.dir`` names it.

    Only a local master may go without the setting; it then gets a folder of
    its own. On a cluster a machine-local folder would lose data, so there the
    setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    ``keep`` writes a table and returns it reread; ``drop`` deletes tables that
    no later step reads. What a returned DataFrame still reads stays.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.path = f"{scratch_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration() if hasattr(self.spark, "_jsc") else self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            at.getFileSystem(conf).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores behind as it takes to be none of the columns, in either case."""
    taken = {c.lower() for c in df.columns}
    return next(c for c in (name + "_" * n for n in range(len(taken) + 1)) if c.lower() not in taken)


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text with A-Z in lower case; null has none.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, as the contracts do.
    """
    return text.lower().split() if text else []


def as_bytes(column: str):
    """A string column as its UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit("").cast("binary"))


def small(batches: Iterable[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes: what Python makes of a slice is many times larger."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size / max(size, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder that all executors share, and the path in it."""
    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def publish(store: fs.FileSystem, temporary: str, path: str) -> None:
    """Gives a finished file its name; a task that ran before may have left the same file."""
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_file(path)
    store.move(temporary, path)
