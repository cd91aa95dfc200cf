"""Registered streams: each runs over a table of the data folder to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import shared_dir
from ..streaming import stateful, streams
from .views import SQL, Views


def root(v: Views, kind: str = "stream") -> str:
    """A new folder within the shared one."""
    return f"{shared_dir(v.spark)}/{kind}-{uuid.uuid4().hex}"


def _source(v: Views, table: str) -> DataFrame:
    return v.spark.readStream.schema(v.table(table).schema).option("pathGlobFilter", "*.parquet").parquet(f"{v.sf_dir}/{table}*")


def ticks(v: Views) -> DataFrame:
    """The events as a stream of ticks."""
    size = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return _source(v, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("value") + 100).alias("price"), size.alias("size"))


def bars(v: Views) -> DataFrame:
    """Bars by a stream over the events: the hours that its watermark has closed."""
    path = root(v)
    streams.drain(streams.stream_bars(ticks(v), tie=("event_id",)), f"{path}/out", f"{path}/check")
    return v.spark.read.parquet(f"{path}/out")


def unique_bars(v: Views) -> DataFrame:
    """Times of ticks that a source sends twice, once each."""
    path = root(v)
    twice = ticks(v).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).select("symbol", F.col("ts").alias("price_timestamp"))
    streams.drain(streams.stream_unique_bars(twice), f"{path}/out", f"{path}/check")
    return v.spark.read.parquet(f"{path}/out")


def latest_quotes(v: Views) -> DataFrame:
    """The latest quote of each symbol."""
    path = root(v)
    streams.run_updates(streams.stream_latest_quotes(ticks(v).select("symbol", "ts", "price", F.col("event_id").alias("priority"))), f"{path}/out", f"{path}/check")
    return streams.latest_updates(v.spark, f"{path}/out", ["symbol"])


def corrected_bars(v: Views) -> DataFrame:
    """Bars by a stream that late ticks correct; its last word on each."""
    path = root(v)
    stateful.run_stateful(stateful.corrected_bars(ticks(v), late="40 days", tie="event_id"), f"{path}/out", f"{path}/check")
    return streams.latest_updates(v.spark, f"{path}/out", ["symbol", "price_timestamp"])


def _sourced(rows: DataFrame) -> DataFrame:
    """Ticks as quotes of seven sources by turns."""
    return rows.select("symbol", "ts", "price", (F.col("event_id") % 7).alias("priority"))


def preferred_quotes(v: Views) -> DataFrame:
    """The quote to go by of each symbol, by a stream."""
    path = root(v)
    stateful.run_stateful(stateful.stream_preferred_quotes(_sourced(ticks(v)), "30 minutes", "40 days", "40 days"), f"{path}/out", f"{path}/check")
    return streams.latest_updates(v.spark, f"{path}/out", ["symbol"])


def articles(v: Views, score, now: str, late: str = "20 days") -> DataFrame:
    """symbol and url_hash of the articles that a stream keeps and scores."""
    path = root(v)
    rows = v.spark.sql(SQL["articles"].replace("from documents", "from {documents}"), documents=_source(v, "documents"))
    hours = F.make_dt_interval(hours=F.pmod(F.col("article_id"), F.lit(400)).cast("int"))
    rows = rows.withColumn("article_timestamp", F.lit(now).cast("timestamp") - hours)
    streams.drain(streams.stream_articles(rows, score, late=late).select("symbol", "url_hash", "score"), f"{path}/out", f"{path}/check")
    return v.spark.read.parquet(f"{path}/out")


def usage(v: Views) -> DataFrame:
    """Calls of each key in sliding windows."""
    path = root(v)
    logs = _source(v, "events").select(F.col("user_id").alias("license_id"), F.col("ts").cast("timestamp").alias("request_timestamp"))
    stateful.run_stateful(streams.stream_usage(logs), f"{path}/out", f"{path}/check")
    return streams.sliding_usage(v.spark.read.parquet(f"{path}/out")).select("license_id", F.col("w.start").alias("window_start"), "calls")
