"""Continuous forms of the batch operators, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, freq: str = "1 hour", late: str = "10 minutes", tie: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling bars of a stream of ticks (symbol, ts, price, size), append mode; ``tie`` orders ticks of one time."""
    w = F.window("ts", freq)
    size, order = F.sum("size"), F.struct("ts", *tie)
    bars = ticks.withWatermark("ts", late).groupBy("symbol", w.alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), size.alias("volume"), F.count(F.lit(1)).alias("trade_count"),
    )
    return bars.select("symbol", F.col("w.start").alias("price_timestamp"), "open", "high", "low", "close", "volume", "trade_count")


def stream_unique_bars(bars: DataFrame, late: str = "2 days") -> DataFrame:
    """A stream of bars whose overlap with what came before is dropped."""
    return bars.withWatermark("price_timestamp", late).dropDuplicatesWithinWatermark(["symbol", "price_timestamp"])


def stream_articles(articles: DataFrame, score: Callable, time: str = "article_timestamp", late: str = "2 days") -> DataFrame:
    """A stream of articles without repeated (symbol, URL), scored."""
    rows = articles.withColumn("url_hash", F.sha2("url", 256)).withWatermark(time, late)
    return rows.dropDuplicatesWithinWatermark(["symbol", "url_hash"]).withColumn("score", score(F.col("text")))


def _micros(span: str) -> int:
    return pd.Timedelta(span).value // 1000


def stream_usage(logs: DataFrame, time: str = "request_timestamp", span: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Calls of each key in the buckets (license_id, bucket, calls) that sliding windows are made of, update mode.

    A call is one bucket's, not that of all windows over it, so the state has a row a bucket; :func:`sliding_usage` sums up.
    A bucket takes late calls for as long as one of its windows is open.
    """
    width = gcd(_micros(span), _micros(slide))
    open_us = _micros(late) + _micros(span) - width
    counted = logs.withWatermark(time, f"{open_us} microseconds").groupBy("license_id", F.window(time, f"{width} microseconds").alias("b")).agg(F.count(F.lit(1)).alias("calls"))
    return counted.select("license_id", F.col("b.start").alias("bucket"), "calls")


def sliding_usage(buckets: DataFrame, span: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """Calls of each key in sliding windows (license_id, w, calls), from what :func:`stream_usage` gave out.

    Counts only grow, so a bucket's largest is its last.  Rows are dealt by key once, before they multiply.
    """
    span_us, slide_us = _micros(span), _micros(slide)
    dealt = buckets.repartition(int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "license_id")
    last = dealt.groupBy("license_id", "bucket").agg(F.max("calls").alias("calls")).withColumn("at", F.unix_micros("bucket"))
    newest = F.col("at") - F.pmod(F.col("at"), F.lit(slide_us).cast("long"))
    back = F.sequence(F.lit(0).cast("long"), F.lit(-(-span_us // slide_us) - 1).cast("long"))
    starts = F.transform(back, lambda i: newest - i * slide_us)
    windows = last.select("license_id", "at", "calls", F.explode(starts).alias("start")).where(F.col("at") < F.col("start") + F.lit(span_us).cast("long"))
    calls = windows.groupBy("license_id", "start").agg(F.sum("calls").alias("calls"))
    w = F.struct(F.timestamp_micros("start").alias("start"), F.timestamp_micros(F.col("start") + F.lit(span_us).cast("long")).alias("end"))
    return calls.select("license_id", w.alias("w"), "calls")


def stream_latest_quotes(quotes: DataFrame) -> DataFrame:
    """The latest quote of each symbol (symbol, ts, price, priority), update mode; of those at
    one time, the source with the smallest priority."""
    return quotes.groupBy("symbol").agg(F.max_by(F.struct("ts", "price", "priority"), F.struct("ts", -F.col("priority"))).alias("q")).select("symbol", "q.*")


def upsert_batches(path: str, keys: list[str], time: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that appends rows with new keys; a batch repeated after a
    failure changes nothing, for its rows are there.

    ``time``: one of the keys; what is there is then read only within the batch's range of it.
    """

    def write(batch: DataFrame, _: int) -> None:
        try:
            known = batch.sparkSession.read.parquet(path).select(*keys)
            if time is not None:
                span = batch.agg(F.min(time).alias("first"), F.max(time).alias("last")).first()
                known = known.where(F.col(time).between(F.lit(span["first"]), F.lit(span["last"])))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        rows = batch.dropDuplicates(keys)
        (rows if known is None else rows.join(known, keys, "left_anti")).write.mode("append").parquet(path)

    return write


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what there is now, into Parquet at ``path``."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def keep_updates(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink for update mode: each batch's rows with its number, a repeated batch in place
    of what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last state of each key that :func:`keep_updates` has written."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (*keys, "batch"))), "batch").alias("row")).select(*keys, "row.*")


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream in update mode over what there is now, into :func:`keep_updates`."""
    stream.writeStream.foreachBatch(keep_updates(path)).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files below ``path``."""
    return spark.readStream.schema(schema).parquet(path)
