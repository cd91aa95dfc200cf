"""Point lookups: latest rows, last N rows, fresh caches, joins with a dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order`` (ties: later order columns decide).

    ``max_by`` aggregates before the shuffle, so a key of any size moves as one row a task.
    """
    whole = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(whole).select("row.*")


def last_n(df: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """The last ``n`` rows of each key by ``order``; all columns."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def recent(df: DataFrame, time: str, now: Column, hours: int, n: int, keys: list[str], tie: str) -> DataFrame:
    """Rows of the last ``hours`` before ``now``, newest first, ``n`` for each key."""
    return last_n(df.where(F.col(time) > now - F.expr(f"interval {hours} hours")), n, keys, [time, tie])


def mark_known(candidates: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """``candidates`` with ``known``: whether ``stored`` has the key."""
    seen = stored.select(*keys).distinct().withColumn("known", F.lit(True))
    return candidates.join(seen, keys, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def cached_analysis(analyses: DataFrame, articles: DataFrame, hours: int, now: Column, target: int) -> DataFrame:
    """For each symbol with an analysis newer than ``hours``: its latest one, the articles as
    a JSON array in order of id, and ``hit`` where there are ``target`` articles at least."""
    fresh = analyses.where(F.col("created_at") > now - F.expr(f"interval {hours} hours"))
    latest = latest_per_key(fresh, ["symbol"], ["created_at", "id"])
    lists = articles.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_articles"), F.sort_array(F.collect_list(F.struct("article_id", "source"))).alias("items"))
    out = latest.join(lists, "symbol", "left")
    items = F.coalesce(F.to_json("items"), F.lit("[]"))
    return out.select("symbol", "id", F.coalesce("n_articles", F.lit(0)).alias("n_articles"), items.alias("articles"), (F.coalesce("n_articles", F.lit(0)) >= target).alias("hit"))


def with_company(df: DataFrame, companies: DataFrame, max_days: int = 30) -> DataFrame:
    """Name and industry of each row's symbol from companies at most ``max_days`` old;
    else the symbol itself and ``Unknown``."""
    fresh = companies.where(F.col("days_old") <= max_days).select("symbol", "company_name", "industry")
    out = df.join(fresh, "symbol", "left")
    return out.withColumns({"company_name": F.coalesce("company_name", "symbol"), "industry": F.coalesce("industry", F.lit("Unknown"))})
