"""Price bars: building, rolling up, gaps, forward fill, profiles.

Bars have symbol, price_timestamp, open, high, low, close, volume, trade_count, vwap and
original (false: filled in).  ``keys`` name a series, ``step`` its bar length in seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunked import KEYS, ROWS, TIME, over_chunks
from .lookup import last_n


def series(keys: list[str] = KEYS) -> Window:
    return Window.partitionBy(*keys).orderBy(TIME)


def build_bars(ticks: DataFrame, freq: str = "hour", tie: tuple[str, ...] = ()) -> DataFrame:
    """Bars of ``freq`` from ticks (symbol, ts, price, size); ``tie`` orders ticks of one time."""
    size, order = F.sum("size"), F.struct("ts", *tie)
    return ticks.groupBy("symbol", F.date_trunc(freq, "ts").alias(TIME)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        size.cast("long").alias("volume"), F.count(F.lit(1)).alias("trade_count"),
        F.round(F.sum(F.col("price") * F.col("size")) / F.nullif(size, F.lit(0)), 6).alias("vwap"), F.lit(True).alias("original"),
    )


def rollup_bars(bars: DataFrame, freq: str = "day") -> DataFrame:
    """Coarser bars from finer ones; vwap weighted by volume."""
    return bars.groupBy("symbol", F.date_trunc(freq, TIME).alias(TIME)).agg(
        F.min_by("open", TIME).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", TIME).alias("close"),
        F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"),
        (F.sum(F.col("vwap") * F.col("volume")) / F.nullif(F.sum(F.when(F.col("vwap").isNotNull(), F.col("volume"))), F.lit(0))).alias("vwap"),
    )


def find_gaps(bars: DataFrame, step: int = 3600, keys: list[str] = KEYS, rows: int | None = ROWS) -> DataFrame:
    """A row for each gap: keys, gap_start, gap_end and the values of the bar just before it.

    A gap is where the next bar comes later than one step.  (The values are those of the
    preceding bar, not of the preceding gap.)  Series of over ``rows`` rows go by chunks, each with the bar after it.
    """
    lag = F.expr(f"interval {step} seconds")
    build = lambda df, k: df.withColumn("next_ts", F.lead(TIME).over(series(k)))
    found = over_chunks(bars, build, keys, after=1, rows=rows).where(F.col("next_ts") > F.col(TIME) + lag)
    return found.select(*keys, (F.col(TIME) + lag).alias("gap_start"), (F.col("next_ts") - lag).alias("gap_end"), "open", "high", "low", "close", "volume", "trade_count", "vwap")


def gap_points(step: int):
    """How many bars a gap lacks."""
    return F.greatest(F.lit(0), F.floor((F.unix_seconds("gap_end") - F.unix_seconds("gap_start")) / step) + 1).cast("long")


def gap_report(bars: DataFrame, step: int = 3600, keys: list[str] = KEYS, rows: int | None = ROWS) -> DataFrame:
    """Gaps and lacking bars of each series (those without a gap are not listed)."""
    return find_gaps(bars, step, keys, rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("gaps"), F.sum(gap_points(step)).alias("points"))


def forward_fill(bars: DataFrame, step: int = 3600, keys: list[str] = KEYS, rows: int | None = ROWS) -> DataFrame:
    """``bars`` and the bars that its gaps lack, which repeat the bar before the gap.

    Volume and trade count that are null become 0 in filled bars.  New times lie strictly
    between existing ones, so nothing needs to be checked against ``bars``.
    """
    gaps = find_gaps(bars, step, keys, rows).where("gap_start <= gap_end")
    times = F.sequence("gap_start", "gap_end", F.expr(f"interval {step} seconds"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    new = gaps.withColumn(TIME, F.explode(times)).select(*keys, TIME, "open", "high", "low", "close", zero("volume"), zero("trade_count"), "vwap", F.lit(False).alias("original"))
    return bars.select(*new.columns).unionByName(new)


def fill_ratio(bars: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Observed and filled bars of each series, with percentages."""
    out = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if("original").alias("observed"), F.count_if(~F.col("original")).alias("filled"))
    return out.withColumns({f"{c}_pct": F.col(c) * 100.0 / F.col("total") for c in ("observed", "filled")})


def prefer_original(bars: DataFrame, min_rows: int = 100, keys: list[str] = KEYS) -> DataFrame:
    """Observed bars only; all bars of series with ``min_rows`` observed ones or fewer."""
    n = F.sum(F.col("original").cast("int")).over(Window.partitionBy(*keys))
    return bars.withColumn("__n", n).where(F.col("original") | (F.col("__n") <= min_rows)).drop("__n")


def load_bars(bars: DataFrame, symbols: list[str] | DataFrame | None = None, timeframe: str | None = None, n: int | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Bars of ``symbols`` (a list, or a table with a column symbol; None: all) and ``timeframe``,
    observed ones where a series has enough of them, the last ``n`` of each series if given; by time."""
    if timeframe is not None:
        bars = bars.where(F.col("timeframe") == timeframe)
    if isinstance(symbols, DataFrame):
        bars = bars.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    elif symbols is not None:
        bars = bars.where(F.col("symbol").isin(*symbols))
    bars = prefer_original(bars, keys=keys)
    return (bars if n is None else last_n(bars, n, keys, [TIME])).orderBy(*keys, TIME)


def latest_bars(bars: DataFrame, n: int, keys: list[str] = KEYS) -> DataFrame:
    return last_n(bars, n, keys, [TIME])


def bars_between(bars: DataFrame, start, end) -> DataFrame:
    """Observed bars from ``start`` to ``end``, both included."""
    return bars.where(F.col("original") & F.col(TIME).between(start, end))


def available_symbols(bars: DataFrame, min_records: int, keys: list[str] = KEYS) -> DataFrame:
    """Series with ``min_records`` observed bars at least, most first."""
    out = bars.groupBy(*keys).agg(F.count_if("original").alias("records")).where(F.col("records") >= min_records)
    return out.orderBy(F.desc("records"), *keys)


def top_symbols(bars: DataFrame, n: int) -> DataFrame:
    """The ``n`` series with most observed bars (a top-k report)."""
    return available_symbols(bars, 1).limit(n)


def bar_counts(bars: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def profile_bars(bars: DataFrame) -> DataFrame:
    """Rows, observed rows, first and last time: for each symbol, and for all (symbol null)."""
    out = bars.rollup("symbol").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("original").alias("observed"), F.count_distinct("symbol").alias("symbols"),
        F.min(TIME).alias("earliest"), F.max(TIME).alias("latest"), F.grouping("symbol").alias("is_total"),
    )
    return out


def recent_quality(bars: DataFrame, n: int = 100, keys: list[str] = KEYS) -> DataFrame:
    """Range, mean volume, last close and span in days of the last ``n`` observed bars."""
    rows = last_n(bars.where("original"), n, keys, [TIME])
    return rows.groupBy(*keys).agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.avg("volume").alias("avg_volume"),
        F.max_by("close", TIME).alias("last_close"), F.datediff(F.max(TIME), F.min(TIME)).cast("long").alias("days"),
    )


def market_snapshot(bars: DataFrame, n: int = 24, keys: list[str] = KEYS) -> DataFrame:
    """Of the last ``n`` bars: times, latest close, change to the bar before, change to the
    first (if there are ``n``), latest volume and vwap."""
    w = Window.partitionBy(*keys).orderBy(F.desc(TIME))
    rows = bars.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    at = lambda c, i: F.max(F.when(F.col("rn") == i, F.col(c)))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(TIME).alias("first_ts"), F.max(TIME).alias("last_ts"), at("close", 1).alias("close"), at("close", 2).alias("before"),
        at("close", n).alias("first"), at("volume", 1).alias("volume"), at("vwap", 1).alias("vwap"),
    )
    change = lambda c: (F.col("close") - F.col(c)) / F.col(c) * 100
    return out.select(*keys, "n", "first_ts", "last_ts", "close", change("before").alias("change_pct"), change("first").alias("window_change_pct"), "volume", "vwap")


def partition_balance(df: DataFrame, n: int = 16, column: str = "symbol") -> DataFrame:
    """Rows in each of ``n`` partitions by the md5 of ``column``, and their share of all."""
    key = F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 8), 16, 10).cast("long")
    out = df.groupBy(F.pmod(key, F.lit(n)).alias("part")).agg(F.count(F.lit(1)).alias("n_rows"))
    return out.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(F.lit(1))))
