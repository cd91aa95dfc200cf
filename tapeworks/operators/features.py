"""Labels from future returns, feature matrices, splits and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bars import KEYS, TIME, series
from .chunked import ROWS, over_chunks
from .lookup import latest_per_key

NOT_FEATURES = ("symbol", "timeframe", "price_timestamp", "original", "target", "future_close", "future_return")


def add_labels(df: DataFrame, periods: int = 5, threshold: float = 1.0, keys: list[str] = KEYS, rows: int | None = ROWS) -> DataFrame:
    """future_close, future_return (percent) and target: 1 above the threshold, -1 below its
    negative, else 0; the last ``periods`` rows of a series are dropped.  Series of over ``rows`` rows go by chunks."""
    build = lambda x, k: x.withColumn("future_close", F.lead("close", periods).over(series(k))).where("future_close is not null")
    df = over_chunks(df, build, keys, after=periods, rows=rows)
    df = df.withColumn("future_return", (F.col("future_close") - F.col("close")) / F.col("close") * 100)
    return df.withColumn("target", F.when(F.col("future_return") > threshold, 1).when(F.col("future_return") < -threshold, -1).otherwise(0))


def label_distribution(df: DataFrame, by: list[str] | None = None, label: str = "target") -> DataFrame:
    """Rows and percentage of each label, within each ``by`` if given; sorted."""
    by = by or []
    out = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*(by or [F.lit(1)]))
    return out.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(whole)).orderBy(*by, label)


def feature_matrix(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows without null or NaN features, and the names of the features."""
    names = [c for c, t in df.dtypes if c not in NOT_FEATURES and t in ("double", "float", "int", "bigint")]
    return df.dropna("any", subset=names), names


def kept_report(df: DataFrame, names: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Rows of each series that a feature matrix keeps and drops."""
    good = F.lit(True)
    for c in names:
        good = good & F.col(c).isNotNull()
    return df.groupBy(*keys).agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped"))


def encode_symbol(df: DataFrame, mod: int = 1000, symbol: str = "symbol") -> DataFrame:
    """``symbol_encoded``: a number below ``mod`` from the md5, the same in every process."""
    return df.withColumn("symbol_encoded", F.pmod(F.conv(F.substring(F.md5(symbol), 1, 8), 16, 10).cast("long"), F.lit(mod)))


def training_table(df: DataFrame, per_symbol: int, total: int) -> DataFrame:
    """The newest ``per_symbol`` rows of each symbol, symbols with most rows first, ``total``
    rows at most; the last symbol taken is cut."""
    w = Window.partitionBy("symbol").orderBy(F.desc(TIME))
    rows = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= per_symbol)
    sizes = df.groupBy("symbol").agg(F.least(F.count(F.lit(1)), F.lit(per_symbol)).alias("n"), F.count(F.lit(1)).alias("n_all"))
    order = Window.orderBy(F.desc("n_all"), "symbol").rowsBetween(Window.unboundedPreceding, -1)  # one row a symbol
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).select("symbol", "before")
    return rows.join(sizes, "symbol").where(F.col("before") + F.col("__rn") <= total).drop("__rn", "before")


def require_rows(df: DataFrame, n: int, keys: list[str] = KEYS) -> DataFrame:
    """Rows of series that have ``n`` rows at least."""
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("__n") >= n).drop("__n")


def temporal_split(df: DataFrame, share: float = 0.8, keys: list[str] = KEYS) -> DataFrame:
    """``part``: ``train`` for the first rows of each series by time, else ``validation``."""
    place = F.row_number().over(series(keys)) <= F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) * share)
    return df.withColumn("part", F.when(place, "train").otherwise("validation"))


def split_at(df: DataFrame, end) -> DataFrame:
    return df.withColumn("part", F.when(F.col(TIME) <= end, "train").otherwise("validation"))


def class_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """label and weight n / (k * n_c) of each of k labels."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))
    return counts.withColumn("weight", F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n")))


def with_class_weights(df: DataFrame, label: str = "target") -> DataFrame:
    return df.join(class_weights(df, label).select(label, "weight"), label)


def prediction_features(df: DataFrame, names: list[str], keys: list[str] = KEYS, fill_zero: bool = False) -> DataFrame:
    """The latest usable row of each series: nulls repeat the last value, rows that still have
    one are dropped (or 0, if ``fill_zero``); names that ``df`` lacks are 0."""
    w = series(keys).rowsBetween(Window.unboundedPreceding, 0)
    have = [c for c in names if c in df.columns]
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(w).cast("double"), *([F.lit(0.0)] if fill_zero else [])) for c in have}
    df = df.select(*keys, TIME, *(e.alias(c) for c, e in filled.items())).dropna("any", subset=have)
    df = latest_per_key(df, keys, [TIME])
    return df.select(*keys, TIME, *(F.col(c) if c in have else F.lit(0.0).alias(c) for c in names))


def pipeline_report(bars: DataFrame, names: list[str], periods: int = 5, threshold: float = 1.0, share: float = 0.8, keys: list[str] = KEYS) -> DataFrame:
    """For each series: rows loaded, labelled and complete (no null among ``names``), the label counts,
    and size and first and last time of the training and the validation part.

    ``bars`` has the features.  All counts come from one pass over labelled rows.
    """
    good = F.lit(True)
    for c in names:
        good = good & F.col(c).isNotNull()
    loaded = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("loaded"), F.min(TIME).alias("first_ts"), F.max(TIME).alias("last_ts"))
    rows = add_labels(bars, periods, threshold, keys).withColumn("__good", good)
    labelled = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("labelled"), *(F.count_if(F.col("target") == t).alias(n) for t, n in ((-1, "sell"), (0, "hold"), (1, "buy"))))
    parts = temporal_split(rows.where("__good"), share, keys)
    sizes = parts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("complete"),
        *(x for p in ("train", "validation") for x in (F.count_if(F.col("part") == p).alias(p), F.min(F.when(F.col("part") == p, F.col(TIME))).alias(f"{p}_start"), F.max(F.when(F.col("part") == p, F.col(TIME))).alias(f"{p}_end"))),
    )
    out = loaded.join(labelled, keys, "left").join(sizes, keys, "left")
    return out.fillna(0, ["labelled", "sell", "hold", "buy", "complete", "train", "validation"])
