"""A database table as a Spark source and sink, by any module of Python's database interface.

Reading is cut into ranges of a column, one connection each, and comparisons of columns with values are handed to
the database.  A writing task fills a staging table of its own; the job's commit moves all of them into the table in one
transaction, so a job that fails, or a task that is run twice, leaves no rows behind.

    spark.dataSource.register(database.DatabaseSource)
    spark.read.format("tapeworks_database").schema("id long, x double").options(module="sqlite3", dsn=path, table="t", column="id", low=0, high=1000, parts=4).load()
"""

from __future__ import annotations

import datetime
import importlib
import uuid
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

NAME = "tapeworks_database"
#: Rows of one insert statement's batch.
BATCH = 10_000
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _name(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


def _stored(value, instant: bool = False):
    """A value as the database keeps it: dates and times as ISO text, instants in UTC."""
    if instant and value is not None:
        value = value.astimezone(datetime.UTC)
    return value.isoformat(sep=" ") if isinstance(value, datetime.datetime) else value.isoformat() if isinstance(value, datetime.date) else value


def _condition(pushed: Filter) -> tuple[str, list] | None:
    """A filter as SQL and its values; None where it stays with Spark, as comparisons of times do."""
    values = pushed.value if isinstance(pushed, In) else [getattr(pushed, "value", None)]
    if len(pushed.attribute) != 1 or any(isinstance(v, datetime.date) for v in values):
        return None
    column = _name(pushed.attribute[0])
    if type(pushed) in _SIGNS:
        return f"{column} {_SIGNS[type(pushed)]} ?", values
    if isinstance(pushed, In) and pushed.value:
        return f"{column} in ({', '.join('?' * len(pushed.value))})", list(pushed.value)
    if isinstance(pushed, IsNull | IsNotNull):
        return f"{column} is {'not ' * isinstance(pushed, IsNotNull)}null", []
    return None


@dataclass
class _Range(InputPartition):
    """Rows with ``low`` <= column < ``high``; None is open, and both None with ``nulls`` are rows without a value."""

    low: int | None
    high: int | None
    nulls: bool = False


@dataclass
class _Staged(WriterCommitMessage):
    table: str
    rows: int


class _Database:
    """How to reach the table; options are strings."""

    def __init__(self, options: dict, schema: T.StructType):
        self.module, self.dsn, self.table = options.get("module", "sqlite3"), options["dsn"], options["table"]
        self.schema, self.names = schema, ", ".join(_name(f.name) for f in schema.fields)

    def connect(self):
        module = importlib.import_module(self.module)
        return closing(module.connect(self.dsn, timeout=60) if self.module == "sqlite3" else module.connect(self.dsn))


class _Reader(DataSourceReader, _Database):
    def __init__(self, options: dict, schema: T.StructType):
        _Database.__init__(self, options, schema)
        self.column, self.parts = options.get("column"), int(options.get("parts", 1))
        self.low, self.high = int(options.get("low", 0)), int(options.get("high", 0))
        self.conditions: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for pushed in filters:
            if (found := _condition(pushed)) is None:
                yield pushed
            else:
                self.conditions.append(found)

    def partitions(self) -> list[InputPartition]:
        if self.column is None or self.parts < 2:
            return [_Range(None, None)]
        cuts = [self.low + (self.high - self.low) * i // self.parts for i in range(1, self.parts)]
        return [_Range(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)] + [_Range(None, None, True)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        conditions = list(self.conditions)
        if partition.nulls:
            conditions.append((f"{_name(self.column)} is null", []))
        elif self.column is not None and self.parts > 1:
            conditions += [(f"{_name(self.column)} {sign} ?", [bound]) for sign, bound in ((">=", partition.low), ("<", partition.high)) if bound is not None]
        where = " where " + " and ".join(c for c, _ in conditions) if conditions else ""
        times = [i for i, f in enumerate(self.schema.fields) if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType)]
        flags = [i for i, f in enumerate(self.schema.fields) if isinstance(f.dataType, T.BooleanType)]
        with self.connect() as connection, closing(connection.cursor()) as cursor:
            cursor.execute(f"select {self.names} from {_name(self.table)}{where}", [v for _, values in conditions for v in values])
            while rows := cursor.fetchmany(BATCH):
                for row in rows:
                    row = list(row)
                    for i in times:
                        row[i] = datetime.datetime.fromisoformat(row[i]) if isinstance(row[i], str) else row[i]
                    for i in flags:
                        row[i] = None if row[i] is None else bool(row[i])
                    yield tuple(row)


class _Writer(DataSourceWriter, _Database):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        _Database.__init__(self, options, schema)
        self.overwrite, self.job = overwrite, uuid.uuid4().hex[:12]

    def write(self, rows: Iterator) -> _Staged:
        table, n = f"{self.table}__{self.job}_{uuid.uuid4().hex[:12]}", 0
        insert = f"insert into {_name(table)} values ({', '.join('?' * len(self.schema.fields))})"
        with self.connect() as connection, closing(connection.cursor()) as cursor:
            cursor.execute(f"create table {_name(table)} as select {self.names} from {_name(self.table)} where 1 = 0")
            connection.commit()
            held, instants = [], [isinstance(f.dataType, T.TimestampType) for f in self.schema.fields]
            for row in rows:
                held.append([_stored(v, instant) for v, instant in zip(row, instants, strict=True)])
                if len(held) == BATCH:
                    cursor.executemany(insert, held)
                    n, held = n + len(held), []
            cursor.executemany(insert, held)
            connection.commit()
        return _Staged(table, n + len(held))

    def commit(self, messages: list) -> None:
        with self.connect() as connection, closing(connection.cursor()) as cursor:
            if self.overwrite:
                cursor.execute(f"delete from {_name(self.table)}")
            for message in messages:
                cursor.execute(f"insert into {_name(self.table)} ({self.names}) select {self.names} from {_name(message.table)}")
                cursor.execute(f"drop table {_name(message.table)}")
            connection.commit()

    def abort(self, messages: list) -> None:
        with self.connect() as connection, closing(connection.cursor()) as cursor:
            for message in messages:
                if message is not None:
                    cursor.execute(f"drop table if exists {_name(message.table)}")
            connection.commit()


class DatabaseSource(DataSource):
    """The table must be there; its columns are those of the given schema."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema, overwrite)


def read_database(spark: SparkSession, schema: str | T.StructType, **options) -> DataFrame:
    """A database table; filters on its columns reach the database."""
    spark.dataSource.register(DatabaseSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).schema(schema).options(**options).load()


def write_database(df: DataFrame, mode: str = "append", **options) -> None:
    """``df`` into a database table: all of it, or nothing."""
    df.sparkSession.dataSource.register(DatabaseSource)
    df.write.format(NAME).mode(mode).options(**options).save()
