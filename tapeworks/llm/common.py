"""Helpers shared by the operators: shared storage, Arrow batches, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts define it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step looks at; bounds a worker's memory.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch, and rows of short keys that may be broadcast.
BATCH_BYTES, BROADCAST_ROWS = 4 << 20, 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only on one machine (master local, as in tests) a temporary one is set where none is named.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = context.getCheckpointDir()
    if named is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if named is None:
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of one job in a folder of its own within the shared one, dropped when the job is done.

    Each is written at once, as Parquet; the shuffle files that made it are given up then, so a job of many
    steps does not pile them up.  A lost executor costs no recomputation beyond the table at hand.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0
        self.kept: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path, name = f"{self.folder}/{self.count}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        self.count += 1
        before = self.spark.conf.get(name, None)
        self.spark.conf.set(name, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(name) if before is None else self.spark.conf.set(name, before)
        self.kept.append((self.spark.read.schema(df.schema).parquet(path), path))
        return self.kept[-1][0]

    def release(self, df: DataFrame) -> None:
        """Drop one table that nothing reads any more."""
        for path in [p for x, p in self.kept if x is df]:
            remove_folder(self.spark, path)
        self.kept = [(x, p) for x, p in self.kept if x is not df]

    def drop(self) -> None:
        remove_folder(self.spark, self.folder)


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes: texts are long, and a batch must fit a worker.

    Every operator sets the same value, so queries that wait to be run see no change.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def size_checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (short keys, written already) to be broadcast if it has ``rows`` rows at most; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` of about ``limit`` bytes each (one text at least)."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if i > first and held + len(text) > limit:
            yield first, i
            first, held = i, 0
        held += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """Columns (Arrow, numpy or lists) as a record batch of ``schema``."""
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once for a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def private(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken or f"{name}_of".lower() in taken:
        name = f"_{name}"
    return name
