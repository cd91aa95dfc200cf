"""Streams with state of their own: bars that late ticks correct, quotes whose source may fall silent.

State is kept by key in the state store (RocksDB, so it may outgrow memory) and dropped by event-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .streams import run_updates

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocksdb(spark: SparkSession):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_stateful(stream: DataFrame, path: str, checkpoint: str) -> None:
    """:func:`.streams.run_updates` with a state store that can hold typed state."""
    with _rocksdb(stream.sparkSession):
        run_updates(stream, path, checkpoint)


class _Dropped(StatefulProcessor):
    """State of a key that goes when the watermark has passed the key's end."""

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class _Bar(_Dropped):
    """One bar: its ticks so far, summed up."""

    def __init__(self, late_ms: int):
        self.late_ms = late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bar", "first long, first_tie long, open double, high double, low double, last long, last_tie long, close double, volume long, trade_count long, turnover double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        symbol, start, end = key
        held = self.state.get() if self.state.exists() else None
        for batch in rows:
            ticks = batch.assign(at=batch["ts"].astype("datetime64[us]").astype("int64")).sort_values(["at", "tie"])
            first, last = ticks.iloc[0], ticks.iloc[-1]
            part = (
                int(first["at"]), int(first["tie"]), float(first["price"]), float(ticks["price"].max()), float(ticks["price"].min()),
                int(last["at"]), int(last["tie"]), float(last["price"]), int(ticks["size"].sum()), len(ticks), float((ticks["price"] * ticks["size"]).sum()),
            )
            if held is None:
                held = part
            else:
                opening, closing = min(held, part, key=lambda x: x[:2]), max(held, part, key=lambda x: x[5:7])
                held = (*opening[:3], max(held[3], part[3]), min(held[4], part[4]), *closing[5:8], *(a + b for a, b in zip(held[8:], part[8:], strict=True)))
        self.state.update(tuple(held))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pd.Timestamp(end).timestamp() * 1000) + self.late_ms)
        vwap = held[10] / held[8] if held[8] else None
        yield pd.DataFrame({"symbol": [symbol], "price_timestamp": [start], "open": [held[2]], "high": [held[3]], "low": [held[4]], "close": [held[7]], "volume": [held[8]], "trade_count": [held[9]], "vwap": [vwap]})


def corrected_bars(ticks: DataFrame, freq: str = "1 hour", late: str = "10 minutes", tie: str | None = None) -> DataFrame:
    """Bars of a stream of ticks (symbol, ts, price, size), in update mode: a bar is given out again whenever ticks
    come in that belong to it, until the watermark (``late`` behind the newest tick) has passed its end by ``late`` again.

    A bar's key is its own, so no symbol is one task.  ``tie`` (a whole number) orders ticks of one time.
    """
    w = F.window("ts", freq)
    rows = ticks.select("symbol", "ts", F.col("price").cast("double").alias("price"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("tie"))
    rows = rows.withWatermark("ts", late).withColumns({"start": w.start, "end": w.end})
    late_ms = int(pd.Timedelta(late).total_seconds() * 1000)
    schema = "symbol string, price_timestamp timestamp, open double, high double, low double, close double, volume long, trade_count long, vwap double"
    found = rows.groupBy("symbol", "start", "end").transformWithStateInPandas(_Bar(late_ms), schema, "Update", "EventTime")
    return found.withColumn("vwap", F.round("vwap", 6))


class _Sources(_Dropped):
    """The last quote of each source of one symbol."""

    def __init__(self, silence_us: int, drop_ms: int):
        self.silence_us, self.drop_ms = silence_us, drop_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("quotes", "priority long", "at long, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        quotes = {p[0]: tuple(q) for p, q in self.state.iterator()} if self.state.exists() else {}
        spoke = set()
        for batch in rows:
            at = batch["ts"].astype("datetime64[us]").astype("int64")
            for t, price, priority in zip(at.tolist(), batch["price"].tolist(), batch["priority"].tolist(), strict=True):
                if priority not in quotes or (t, price) > quotes[priority]:
                    quotes[priority] = (t, price)
                    spoke.add(priority)
        for priority in spoke:
            self.state.updateValue((priority,), quotes[priority])
        newest = max(t for t, _ in quotes.values())
        for priority in [p for p, (t, _) in quotes.items() if t < newest - self.drop_ms * 1000]:
            self.state.removeKey((priority,))
            del quotes[priority]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest // 1000 + self.drop_ms)
        chosen = min(p for p, (t, _) in quotes.items() if t >= newest - self.silence_us)
        yield pd.DataFrame({"symbol": [key[0]], "ts": [pd.Timestamp(quotes[chosen][0], unit="us")], "price": [quotes[chosen][1]], "priority": [chosen]})


def _last_of_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last quote of each source (symbol and priority) in each batch; of those at one time, the highest."""
    for batch in batches:
        rows = batch.to_pandas().sort_values(["ts", "price"], na_position="first", kind="stable")
        yield batch.take(pa.array(rows.drop_duplicates(["symbol", "priority"], keep="last").index))


def stream_preferred_quotes(quotes: DataFrame, silence: str = "5 minutes", drop: str = "1 day", late: str = "1 day") -> DataFrame:
    """The quote to go by of each symbol (symbol, ts, price, priority), update mode: that of the source with the smallest
    priority which has spoken within ``silence`` of the newest quote; one that has fallen silent gives way to the next.

    A source (and a symbol) without quotes for ``drop`` is forgotten.  A symbol is one task, so only the last quotes
    of each Arrow batch reach it: earlier ones change nothing.
    """
    rows = quotes.select("symbol", "ts", F.col("price").cast("double").alias("price"), F.col("priority").cast("long").alias("priority"))
    rows = rows.mapInArrow(_last_of_sources, rows.schema).withWatermark("ts", late)
    spans = (pd.Timedelta(x).total_seconds() for x in (silence, drop))
    silence_us, drop_ms = int(next(spans) * 10**6), int(next(spans) * 1000)
    return rows.groupBy("symbol").transformWithStateInPandas(_Sources(silence_us, drop_ms), "symbol string, ts timestamp, price double, priority long", "Update", "EventTime")


def preferred_quotes(quotes: DataFrame, silence: str = "5 minutes") -> DataFrame:
    """What :func:`stream_preferred_quotes` comes to, of a table."""
    last = quotes.groupBy("symbol", "priority").agg(F.max(F.struct("ts", F.col("price").cast("double").alias("price"))).alias("q")).select("symbol", "priority", "q.*")
    newest = last.groupBy("symbol").agg(F.max("ts").alias("newest"))
    heard = last.join(newest, "symbol").where(F.col("ts") >= F.col("newest") - F.expr(f"interval {silence}"))
    return heard.groupBy("symbol").agg(F.min_by(F.struct("ts", "price", "priority"), "priority").alias("q")).select("symbol", "q.*")
