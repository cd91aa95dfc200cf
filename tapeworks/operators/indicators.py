"""Technical indicators per series.  Frame means are null until their frame is full.

Series of more than ``rows`` rows are worked on in chunks of time (:mod:`.chunked`): frames by a halo, running sums and
recursive means by what earlier chunks hand on.  None for ``rows`` takes each series as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import KEYS, TIME, series
from .chunked import ROWS, carried, chunk_keys, cut, is_cut, over_chunks, own_rows, size_checked, uncut
from .dedup import cut_lineage
from .recurrence import Mean, ewm


def frame(n: int, keys: list[str] = KEYS) -> Window:
    return series(keys).rowsBetween(-(n - 1), 0)


def full(value, column: str, n: int, keys: list[str] = KEYS) -> Column:
    """``value`` over the last ``n`` rows, null unless all have ``column``."""
    w = frame(n, keys)
    return F.when(F.count(column).over(w) == n, value(column).over(w))


#: Rows that the frames of all indicators together look back at.
BACK = 50


def averages(bars: DataFrame, spans: tuple[int, ...] = (10, 20, 50), keys: list[str] = KEYS, rows: int | None = ROWS) -> DataFrame:
    return over_chunks(bars, lambda df, k: df.withColumns({f"sma_{n}": full(F.avg, "close", n, k) for n in spans}), keys, max(spans), rows=rows)


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0, keys: list[str] = KEYS, rows: int | None = ROWS) -> DataFrame:
    """BBL, BBM, BBU, BBB, BBP from mean and population deviation of close.

    Names end in span and widths with ``_`` for the point: BBL_20_2_0_2_0.
    """
    tag = f"{n}_{width:.1f}_{width:.1f}".replace(".", "_")
    df = over_chunks(bars, lambda df, k: df.withColumns({"__m": full(F.avg, "close", n, k), "__s": full(F.stddev_pop, "close", n, k)}), keys, n, rows=rows)
    low, high = F.col("__m") - width * F.col("__s"), F.col("__m") + width * F.col("__s")
    cols = {f"BBL_{tag}": low, f"BBM_{tag}": F.col("__m"), f"BBU_{tag}": high, f"BBB_{tag}": 100 * (high - low) / F.col("__m"), f"BBP_{tag}": F.try_divide(F.col("close") - low, high - low)}
    return df.withColumns(cols).drop("__m", "__s")


def stochastic(bars: DataFrame, n: int = 14, keys: list[str] = KEYS, rows: int | None = ROWS) -> DataFrame:
    """STOCHk, STOCHd, STOCHh (14, 3, 3); a range of zero gives null."""

    def build(df: DataFrame, k: list[str]) -> DataFrame:
        df = df.withColumns({"__l": full(F.min, "low", n, k), "__h": full(F.max, "high", n, k)})
        df = df.withColumn("__r", F.try_divide(100 * (F.col("close") - F.col("__l")), F.col("__h") - F.col("__l")))
        df = df.withColumn("STOCHk_14_3_3", full(F.avg, "__r", 3, k))
        df = df.withColumn("STOCHd_14_3_3", full(F.avg, "STOCHk_14_3_3", 3, k))
        return df.withColumn("STOCHh_14_3_3", F.col("STOCHk_14_3_3") - F.col("STOCHd_14_3_3")).drop("__l", "__h", "__r")

    return over_chunks(bars, build, keys, n + 4, rows=rows)


def obv(bars: DataFrame, keys: list[str] = KEYS, rows: int | None = ROWS) -> DataFrame:
    """On-balance volume: volume with the sign of the change of close, added up."""

    def build(df: DataFrame, k: list[str]) -> DataFrame:
        w = series(k)
        sign = F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(1.0))
        df = own_rows(df.withColumn("__v", sign * F.coalesce("volume", F.lit(0))))
        df = carried(df, keys, {"__before": (F.sum("__v"), F.sum)})
        return df.withColumn("obv", F.sum("__v").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.col("__before").cast("double"), F.lit(0.0))).drop("__v", "__before")

    return over_chunks(bars, build, keys, 1, rows=rows)


def price_features(bars: DataFrame, keys: list[str] = KEYS, rows: int | None = ROWS) -> DataFrame:
    df = over_chunks(bars, lambda df, k: df.withColumn("price_change", F.col("close") / F.lag("close").over(series(k)) - 1), keys, 1, rows=rows)
    return df.withColumns({"high_low_pct": (F.col("high") - F.col("low")) / F.col("close"), "close_open_pct": (F.col("close") - F.col("open")) / F.col("open")})


def volume_features(bars: DataFrame, keys: list[str] = KEYS, rows: int | None = ROWS) -> DataFrame:
    df = over_chunks(bars, lambda df, k: df.withColumn("volume_sma", full(F.avg, "volume", 20, k)), keys, 20, rows=rows)
    return df.withColumn("volume_ratio", F.try_divide(F.col("volume").cast("double"), F.col("volume_sma")))


def close_ratios(df: DataFrame) -> DataFrame:
    """Close over its means; needs sma_20 and sma_50."""
    return df.withColumns({f"close_sma{n}_ratio": F.col("close") / F.col(f"sma_{n}") for n in (20, 50)})


def changes(bars: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Inputs of the recursive indicators: gain, loss, true range, directional movement."""
    before = lambda c: F.lag(c).over(series(keys))
    df = bars.withColumns({"__d": F.col("close") - before("close"), "__c": before("close"), "__up": F.col("high") - before("high"), "__dn": before("low") - F.col("low")})
    first = F.col("__c").isNull()
    none = F.lit(None).cast("double")
    return df.withColumns(
        {
            "gain": F.when(first, none).otherwise(F.greatest("__d", F.lit(0.0))),
            "loss": F.when(first, none).otherwise(F.greatest(-F.col("__d"), F.lit(0.0))),
            "true_range": F.when(first, none).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("__c")), F.abs(F.col("low") - F.col("__c")))),
            "plus_dm": F.when(first, none).otherwise(F.when((F.col("__up") > F.col("__dn")) & (F.col("__up") > 0), F.col("__up")).otherwise(0.0)),
            "minus_dm": F.when(first, none).otherwise(F.when((F.col("__dn") > F.col("__up")) & (F.col("__dn") > 0), F.col("__dn")).otherwise(0.0)),
        }
    ).drop("__d", "__c", "__up", "__dn")


FIRST_PASS = [
    *(Mean(f"ema_{n}", "close", n) for n in (10, 20, 50)), Mean("__e12", "close", 12), Mean("__e26", "close", 26),
    Mean("__gain", "gain", 14, True), Mean("__loss", "loss", 14, True), Mean("atr", "true_range", 14, True), Mean("__pdm", "plus_dm", 14, True), Mean("__mdm", "minus_dm", 14, True),
]


def _two_before(df: DataFrame, column: str, keys: list[str]) -> Column:
    """``column`` two rows earlier, for rows of a cut ``df`` with __tail: its last two values in earlier chunks."""
    w = series(chunk_keys(df, keys))
    inside = F.lag(column, 2).over(w)
    if not is_cut(df):
        return inside
    place = F.row_number().over(w)
    return F.when(place > 2, inside).otherwise(F.get("__tail", (F.size("__tail") - 3 + place).cast("int")))


def _with_tails(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """A cut ``df`` with __tail: the last two values (or fewer) that ``column`` has in earlier chunks."""
    if not is_cut(df):
        return df
    k = chunk_keys(df, keys)
    newest = Window.partitionBy(*k).orderBy(F.desc(TIME))
    last = df.select(*k, TIME, F.struct(F.col(column).alias("x")).alias("v"), F.row_number().over(newest).alias("rn")).where("rn <= 2")
    tails = last.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct(TIME, "v"))), lambda t: t["v"]).alias("tail"))
    two = Window.partitionBy(*keys).orderBy(k[-1]).rowsBetween(-2, -1)  # a row a chunk
    tails = tails.select(*k, F.slice(F.concat(F.array(F.lit(None), F.lit(None)), F.flatten(F.collect_list("tail").over(two))), -2, 2).alias("__tail"))
    tails = tails.withColumn("__tail", F.transform("__tail", lambda v: v["x"]))
    return df.join(size_checked(cut_lineage(tails)), k, "left")


def _recursive(df: DataFrame, keys: list[str]) -> DataFrame:
    """ema_10/20/50, MACD, rsi, atr, ADX of bars with :func:`changes`, without halo rows."""
    df = ewm(df, FIRST_PASS, keys, TIME)
    plus, minus = (F.try_divide(100 * F.col(c), F.col("atr")) for c in ("__pdm", "__mdm"))
    df = df.withColumns(
        {
            "rsi": F.try_divide(100 * F.col("__gain"), F.col("__gain") + F.col("__loss")),
            "MACD_12_26_9": F.col("__e12") - F.col("__e26"),
            "DMP_14": plus, "DMN_14": minus,
            "__dx": F.try_divide(100 * F.abs(plus - minus), plus + minus),
        }
    )
    df = ewm(df, [Mean("MACDs_12_26_9", "MACD_12_26_9", 9), Mean("ADX_14", "__dx", 14, True)], keys, TIME, dealt=True)
    df = _with_tails(df, "ADX_14", keys)
    df = df.withColumns({"MACDh_12_26_9": F.col("MACD_12_26_9") - F.col("MACDs_12_26_9"), "ADXR_14_2": (F.col("ADX_14") + _two_before(df, "ADX_14", keys)) / 2})
    made = [m.out for m in FIRST_PASS if m.out.startswith("__")]
    return df.drop(*made, "__dx", "__tail", "gain", "loss", "true_range", "plus_dm", "minus_dm")


def recursive_indicators(bars: DataFrame, keys: list[str] = KEYS, rows: int | None = ROWS) -> DataFrame:
    """ema_10/20/50, MACD, rsi, atr, ADX: two streamed passes over the same partitioning.

    The second pass smooths what the first has made (signal line, ADX), row by row as dealt.
    """
    df = cut(bars, keys, 1, rows=rows)
    return uncut(_recursive(own_rows(changes(df, chunk_keys(df, keys))), keys))


def add_indicators(bars: DataFrame, keys: list[str] = KEYS, rows: int | None = ROWS) -> DataFrame:
    """All indicators; the window columns share one partitioning and sort, then come the recursive ones."""
    df = cut(bars, keys, BACK, rows=rows)
    df = bollinger(averages(df, keys=keys, rows=None), keys=keys, rows=None)
    df = stochastic(df, keys=keys, rows=None)
    df = close_ratios(volume_features(price_features(df, keys, None), keys, None))
    df = changes(df, chunk_keys(df, keys))
    return uncut(_recursive(obv(df, keys, None), keys))


def market_conditions(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Trend, RSI and volume labels of each series' latest bar, and its extent, in one aggregation."""
    last = F.max_by(F.struct("close", "sma_20", "rsi", "volume", "volume_sma"), TIME).alias("l")
    out = df.groupBy(*keys).agg(last, F.min(TIME).alias("first_ts"), F.max(TIME).alias("last_ts"), F.count(F.lit(1)).alias("n_rows"))
    rsi = F.coalesce("l.rsi", F.lit(50.0))
    return out.select(
        *keys,
        F.when(F.col("l.close") > F.col("l.sma_20"), "Uptrend").otherwise("Downtrend").alias("trend"),
        F.when(rsi < 30, "Oversold").when(rsi > 70, "Overbought").otherwise("Neutral").alias("rsi_label"),
        F.when(F.col("l.volume") > 1.5 * F.col("l.volume_sma"), "High").otherwise("Normal").alias("volume_label"),
        "first_ts", "last_ts", "n_rows",
    )
