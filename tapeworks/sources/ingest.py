"""Loading: conforming rows, inserting what is new, upserts, quarantine, backfill plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def new_rows(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key ``target`` lacks; of equal keys inside it, the first."""
    return first_per_key(incoming, keys, order).join(target.select(*keys), keys, "left_anti")


def append_new(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``target`` and the new rows of ``incoming``; existing rows win."""
    return target.unionByName(new_rows(target, incoming, keys, order).select(*target.columns))


def upsert_overwrite(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``target`` with the rows of ``incoming`` in place of those with equal keys (last wins)."""
    both = target.withColumn("__new", F.lit(0)).unionByName(incoming.select(*target.columns).withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("__new"), *(F.desc(c) for c in order))
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def load_report(target: DataFrame, incoming: DataFrame, keys: list[str], by: str = "symbol") -> DataFrame:
    """For each ``by``: rows that come in, those with a new key, and duplicates left out."""
    known = target.select(*keys).distinct().withColumn("__known", F.lit(True))
    per_key = incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(known, keys, "left")
    out = per_key.groupBy(by).agg(F.sum("n").alias("total"), F.count_if(F.col("__known").isNull()).alias("new"))
    return out.withColumn("duplicates", F.col("total") - F.col("new"))


def bar_rules() -> dict[str, Column]:
    """Name of each rule and the condition that a good bar meets."""
    rules = {f"{c} > 0": F.col(c) > 0 for c in ("open", "high", "low", "close")}
    return rules | {"volume >= 0": F.coalesce(F.col("volume") >= 0, F.lit(True)), "symbol": F.col("symbol").isNotNull(), "time": F.col("price_timestamp").isNotNull()}


def between_rule(column: str, low: float, high: float, required: bool = False) -> dict[str, Column]:
    """The rule that ``column`` is from ``low`` to ``high``; a null is good unless ``required``."""
    return {f"{low:g} <= {column} <= {high:g}": F.coalesce(F.col(column).between(low, high), F.lit(not required) & F.col(column).isNull())}


def article_rules() -> dict[str, Column]:
    """Rules of articles: scores from -1 to 1, symbol, title and url hash not null."""
    rules = between_rule("polarity", -1, 1) | between_rule("compound", -1, 1)
    return rules | {c: F.col(c).isNotNull() for c in ("symbol", "title", "url_hash")}


def analysis_rules() -> dict[str, Column]:
    """Rules of industry analyses: score from -1 to 1, confidence from 0 to 1, names not null."""
    return between_rule("overall_sentiment", -1, 1) | between_rule("confidence_score", 0, 1) | {c: F.col(c).isNotNull() for c in ("industry", "company_symbol")}


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``reasons``, the names of the rules that a row breaks."""
    return df.withColumn("reasons", F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with the reasons."""
    rows = with_reasons(df, rules)
    return rows.where(F.size("reasons") == 0).drop("reasons"), rows.where(F.size("reasons") > 0)


def missing_symbols(source: DataFrame, target: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Symbols of ``source`` that neither ``target`` nor ``skip`` has, sorted."""
    out = source.select("symbol").distinct().join(target.select("symbol"), "symbol", "left_anti")
    return (out.join(skip.select("symbol"), "symbol", "left_anti") if skip is not None else out).orderBy("symbol")


def all_symbols(*tables: DataFrame) -> DataFrame:
    """Symbols of any of ``tables``, sorted."""
    out = tables[0].select("symbol")
    for t in tables[1:]:
        out = out.union(t.select("symbol"))
    return out.distinct().orderBy("symbol")


def backfill_plan(symbols: DataFrame, bars: DataFrame, today: Column, timeframes: tuple[str, ...] = ("day", "hour", "minute")) -> DataFrame:
    """What to fetch for each symbol and timeframe.

    ``bars`` has timeframe, symbol, price_timestamp.  Without bars: the last 30 days to
    tomorrow; else from a day before the newest bar to today, skipped if that is today.
    """
    wanted = symbols.select("symbol").withColumn("timeframe", F.explode(F.array(*map(F.lit, timeframes))))
    have = bars.groupBy("symbol", "timeframe").agg(F.to_date(F.max("price_timestamp")).alias("newest"), F.count(F.lit(1)).alias("n_rows"))
    out = wanted.join(have, ["symbol", "timeframe"], "left")
    none = F.col("newest").isNull()
    return out.select(
        "symbol", "timeframe", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.when(none, F.date_sub(today, 30)).otherwise(F.date_sub("newest", 1)).cast("string").alias("start"),
        F.when(none, F.date_add(today, 1)).otherwise(today).cast("string").alias("end"),
        F.coalesce(F.col("newest") >= today, F.lit(False)).alias("skip"), F.datediff(today, "newest").cast("long").alias("days_behind"),
    )


def apply_retention(df: DataFrame, days: int, now: Column, time: str = "created_at") -> DataFrame:
    """Rows that are not older than ``days``."""
    return df.where(F.col(time) >= now - F.expr(f"interval {days} days"))


def retention_report(df: DataFrame, days: int, now: Column, time: str = "created_at") -> DataFrame:
    """One row: how many rows :func:`apply_retention` keeps and drops (rows without a time are dropped)."""
    stays = F.coalesce(F.col(time) >= now - F.expr(f"interval {days} days"), F.lit(False))
    return df.agg(F.count_if(stays).alias("kept"), F.count_if(~stays).alias("dropped"))


def clean_price_table(df: DataFrame, columns: list[str], date: str = "date") -> DataFrame:
    """Numbers without thousands commas (bad: null); rows with a bad date are dropped."""
    numbers = {c: F.regexp_replace(F.col(c).cast("string"), ",", "").try_cast("double") for c in columns}
    return df.withColumns(numbers | {date: F.to_date(F.try_to_timestamp(F.col(date)))}).where(F.col(date).isNotNull()).orderBy(date)


PERIODS = {"30d": 30, "90d": 90, "1y": 365, "2y": 730}


def price_history(df: DataFrame, period: str, now: Column, time: str = "price_timestamp", closes: tuple[str, ...] = ("close", "adj_close", "price")) -> DataFrame:
    """Time and rounded close of the rows within ``period`` before ``now``."""
    found = [c for c in closes if c in df.columns]
    rows = df.where(F.col(time) >= now - F.expr(f"interval {PERIODS[period]} days"))
    return rows.select(*(c for c in ("symbol",) if c in df.columns), time, F.round(F.coalesce(*found), 2).alias("close"))
