"""A stored table that is loaded batch by batch without reading or moving all of it.

Rows are kept in parts by day and, inside a part, in buckets by key.  A batch touches the parts of its own days only;
these are read by bucket, so of a join between the batch and what is stored only the batch moves.  Every load writes
new folders beside the old ones and then a new list of folders, under the next number and only if nobody else has
taken it: readers see the version before or the one after, and a load that fails leaves nothing that is read.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ingest import first_per_key

DAY, LOAD = "__day", "__load"
#: Parts that one statement names.
PARTS_A_STATEMENT = 200


@contextmanager
def _joined_by_bucket(spark: SparkSession):
    """Sides that are dealt by some of a join's keys need not be dealt by all of them."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class VersionedTable:
    """Rows with unique ``keys``, one of which is ``time``; the first of the others deals them to ``buckets``.

    ``path`` is a folder that all executors share.  Rows with a null among the keys are never stored, as in a table
    whose keys must not be null.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], time: str, buckets: int = 16):
        self.spark, self.path, self.schema, self.keys, self.time, self.buckets = spark, path, schema, keys, time, buckets
        self.bucket = next(k for k in keys if k != time)
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")

    # -- versions -------------------------------------------------------------------------

    def _files(self):
        return self._folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the newest version; 0: nothing has been loaded."""
        fs = self._files()
        found = fs.listStatus(self._folder) if fs.exists(self._folder) else []
        return max((int(f.getPath().getName()[:-5]) for f in found if f.getPath().getName().endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """parts: folders by day; batches: names of the batches loaded so far."""
        version = self.version() if version is None else version
        if version == 0:
            return {"parts": {}, "batches": []}
        text = self.spark.read.text(f"{self.path}/versions/{version:08}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, version: int, manifest: dict) -> None:
        """Write the list of ``version``; an error if there is one already."""
        jvm, fs = self.spark._jvm, self._files()
        hadoop = jvm.org.apache.hadoop.fs
        draft, final = hadoop.Path(f"{self.path}/versions/{uuid.uuid4().hex}.draft"), hadoop.Path(f"{self.path}/versions/{version:08}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        files = hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(draft, final, self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))  # fails where the number is taken

    # -- reading --------------------------------------------------------------------------

    def read(self, version: int | None = None, days: list[str] | None = None) -> DataFrame:
        """The rows of a version (the newest), of ``days`` (yyyy-mm-dd) only if given."""
        return self._table(self.manifest(version)["parts"], days).select(*self.schema.names)

    def _table(self, parts: dict[str, list[str]], days: list[str] | None = None) -> DataFrame:
        """The parts as one table of buckets, its folders named one by one."""
        wanted = [(day, load) for day, loads in sorted(parts.items()) if days is None or day in days for load in loads]
        name = f"versioned_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        self.spark.sql(f"create table {name} ({columns}, {DAY} string, {LOAD} string) using parquet partitioned by ({DAY}, {LOAD}) clustered by (`{self.bucket}`) into {self.buckets} buckets location '{self.path}/none'")
        for first in range(0, len(wanted), PARTS_A_STATEMENT):
            named = " ".join(f"partition ({DAY}='{day}', {LOAD}='{load}') location '{self.path}/data/{load}/{DAY}={day}'" for day, load in wanted[first : first + PARTS_A_STATEMENT])
            self.spark.sql(f"alter table {name} add {named}")
        return self.spark.table(name)

    # -- loading --------------------------------------------------------------------------

    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """The folder that ``rows`` (with their day) went to, and the days that it has."""
        load, name = uuid.uuid4().hex, f"loading_{uuid.uuid4().hex}"
        target = f"{self.path}/data/{load}"
        rows.select(*self.schema.names, DAY).write.format("parquet").partitionBy(DAY).bucketBy(self.buckets, self.bucket).option("path", target).saveAsTable(name)
        self.spark.sql(f"drop table {name}")  # the files stay
        fs, folder = self._files(), self.spark._jvm.org.apache.hadoop.fs.Path(target)
        return load, [f.getPath().getName().split("=", 1)[1] for f in fs.listStatus(folder) if f.isDirectory()]

    def _prepared(self, incoming: DataFrame, order: list[str | Column]) -> tuple[DataFrame, list[str]]:
        """The first row of each key by ``order``, with its day, dealt as the buckets are; and the days, a few strings."""
        rows = incoming.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields)).dropna(subset=self.keys)
        rows = rows.withColumn(DAY, F.date_format(self.time, "yyyy-MM-dd"))
        days = [r[0] for r in rows.select(DAY).distinct().collect()]
        return first_per_key(rows.repartition(self.buckets, self.bucket), self.keys, order), days

    def missing(self, incoming: DataFrame, order: list[str | Column]) -> DataFrame:
        """Rows of ``incoming`` (with their day) whose key is not stored; of equal keys, the first by ``order``."""
        rows, days = self._prepared(incoming, order)
        stored = self._table(self.manifest()["parts"], days)
        return rows.join(stored.select(*self.keys), self.keys, "left_anti")

    def append(self, incoming: DataFrame, order: list[str | Column], batch: str | None = None) -> int:
        """Insert the rows whose key is not stored yet; the version after it.  Without such rows there is no new one.

        ``batch``: its name; a batch that has been loaded is not loaded again.
        """
        version = self.version()
        manifest = self.manifest(version)
        if batch is not None and batch in manifest["batches"]:
            return version
        with _joined_by_bucket(self.spark):
            load, days = self._write(self.missing(incoming, order))
        if not days:
            return version
        for day in days:
            manifest["parts"].setdefault(day, []).append(load)
        return self._next(version, manifest, batch)

    def upsert(self, incoming: DataFrame, order: list[str | Column], batch: str | None = None) -> int:
        """Put the rows in place of those with equal keys (of equal keys in the batch the first by ``order``).

        The days of the batch are written anew, others are not touched.
        """
        version = self.version()
        manifest = self.manifest(version)
        if batch is not None and batch in manifest["batches"]:
            return version
        rows, days = self._prepared(incoming, order)
        if not days:
            return version
        with _joined_by_bucket(self.spark):
            stored = self._table(manifest["parts"], days)
            kept = stored.join(rows.select(*self.keys), self.keys, "left_anti")
            load, days = self._write(kept.select(*self.schema.names, DAY).unionByName(rows.select(*self.schema.names, DAY)))
        manifest["parts"] |= {day: [load] for day in days}
        return self._next(version, manifest, batch)

    def expire(self, days: int, now: str) -> int:
        """Drop rows older than ``days`` before ``now`` (a time); how many were dropped.

        Whole days go from the list of folders; the day in which the limit falls is written anew.
        """
        version = self.version()
        manifest = self.manifest(version)
        limit = F.lit(now).cast("timestamp") - F.expr(f"interval {days} days")
        edge = self.spark.range(1).select(F.date_format(limit, "yyyy-MM-dd")).first()[0]
        old = [day for day in manifest["parts"] if day <= edge]
        if not old:
            return 0
        stored = self._table(manifest["parts"], old)
        dropped = stored.where(F.col(self.time) < limit).count()
        if not dropped:
            return 0
        on_edge = self._table(manifest["parts"], [edge]).where(F.col(self.time) >= limit)
        load, left = self._write(on_edge)
        manifest["parts"] = {day: loads for day, loads in manifest["parts"].items() if day > edge} | {day: [load] for day in left}
        self._next(version, manifest, None)
        return dropped

    def _next(self, version: int, manifest: dict, batch: str | None) -> int:
        manifest["batches"] += [batch] if batch is not None else []
        self._publish(version + 1, manifest)
        return version + 1

    def sink(self, order: list[str | Column], name: str):
        """A ``foreachBatch`` function that appends; a batch that is run again after a failure changes nothing."""
        return lambda batch, number: self.append(batch, order, f"{name}-{number}") and None
