"""Companies and industries: age, upserts, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import latest_per_key


def companies_by_industry(df: DataFrame) -> DataFrame:
    """Count, symbols and names (in order of symbol) and mean age of each industry, most first."""
    out = df.where("industry is not null").groupBy("industry").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("symbol", "company_name"))).alias("items"), F.avg("days_old").alias("avg_days"))
    return out.select("industry", "n", F.col("items.symbol").alias("symbols"), F.col("items.company_name").alias("names"), "avg_days").orderBy(F.desc("n"), "industry")


def with_age(df: DataFrame, now: Column, updated: str = "updated_at") -> DataFrame:
    """``days_old``: whole days since the update."""
    return df.withColumn("days_old", F.floor((F.unix_seconds(now) - F.unix_seconds(updated)) / 86400))


def company_status(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.when(F.col("days_old") > 30, "NEEDS_UPDATE").when(F.col("days_old") > 14, "AGING").otherwise("FRESH"))


def companies_to_refresh(df: DataFrame, days: int = 30) -> DataFrame:
    return df.where(F.col("days_old") > days).orderBy(F.desc("days_old"), "symbol")


def upsert_company(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """New values where they are not null, else the old ones; symbols in upper case."""
    rest = [c for c in target.columns if c != "symbol"]
    a = target.select(F.upper("symbol").alias("symbol"), *(F.col(c).alias(f"old_{c}") for c in rest))
    b = incoming.select(F.upper("symbol").alias("symbol"), *(F.col(c).alias(f"new_{c}") for c in rest))
    return a.join(b, "symbol", "full_outer").select("symbol", *(F.coalesce(f"new_{c}", f"old_{c}").alias(c) for c in rest))


def companies_in_industry(df: DataFrame, pattern: str) -> DataFrame:
    return df.where(F.col("industry").ilike(f"%{pattern}%"))


def display_names(df: DataFrame) -> DataFrame:
    """symbol and ``name (symbol)``, by name."""
    return df.select("symbol", F.format_string("%s (%s)", F.coalesce("company_name", "symbol"), "symbol").alias("label")).orderBy("label", "symbol")


def industry_overview(df: DataFrame) -> DataFrame:
    """The latest analysis of each industry, by industry."""
    return latest_per_key(df, ["industry"], ["created_at", "id"]).orderBy("industry")


def industry_dashboard(df: DataFrame, top: int = 3) -> DataFrame:
    """Industries, how many are positive, negative or neutral, and the best ``top`` names."""
    latest = latest_per_key(df, ["industry"], ["created_at", "id"])
    s, none = F.col("overall_sentiment"), F.lit(None)
    rows = latest.select(F.lit(1).alias("one"), s.alias("s"), none.cast("struct<overall_sentiment:double,industry:string>").alias("best"))
    first = latest.orderBy(F.desc("overall_sentiment"), F.desc("industry")).limit(top)
    rows = rows.unionByName(first.select(none.cast("int").alias("one"), none.cast("double").alias("s"), F.struct(s.cast("double").alias("overall_sentiment"), "industry").alias("best")))
    best = F.reverse(F.sort_array(F.collect_list("best")))  # ``top`` of them
    s = F.col("s")
    return rows.agg(F.count("one").alias("industries"), F.count_if(s > 0.05).alias("positive"), F.count_if(s < -0.05).alias("negative"), F.count_if((s <= 0.05) & (s >= -0.05)).alias("neutral"), F.array_join(best["industry"], ",").alias("best"))


def analysis_history(df: DataFrame, key: str, n: int, now: Column) -> DataFrame:
    """The last ``n`` analyses of each key with their age in hours."""
    from .lookup import last_n

    return last_n(df, n, [key], ["created_at", "id"]).withColumn("age_hours", (F.unix_seconds(now) - F.unix_seconds("created_at")) / 3600.0)
