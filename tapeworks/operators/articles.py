"""Summaries of scored articles (symbol, source, compound, polarity, times)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sentiment import CONSENT, any_of, overall_label, title_score
from ..functions.text import clean_for_analysis
from .lookup import last_n


def source_breakdown(df: DataFrame) -> DataFrame:
    """symbol, source, n, avg_compound."""
    return df.groupBy("symbol", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("compound").alias("avg_compound"))


def breakdown_map(df: DataFrame) -> DataFrame:
    """symbol and a map from source to count and mean."""
    rows = source_breakdown(df).groupBy("symbol").agg(F.collect_list(F.struct("source", F.struct("n", "avg_compound"))).alias("e"))
    return rows.select("symbol", F.map_from_entries("e").alias("source_breakdown"))


def sentiment_summary(df: DataFrame) -> DataFrame:
    """Counts, means, percentages and the overall label of each symbol; also the mean over
    sources weighted by their articles."""
    c = F.col("compound")
    out = df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total"), F.avg("polarity").alias("avg_polarity"), F.avg("compound").alias("avg_compound"),
        F.count_if(c > 0.01).alias("positive"), F.count_if(c < -0.01).alias("negative"), F.count_if((c <= 0.01) & (c >= -0.01)).alias("neutral"),
    )
    out = out.withColumns({f"{k}_pct": F.round(F.col(k) * 100.0 / F.col("total"), 1) for k in ("positive", "negative", "neutral")})
    weighted = source_breakdown(df).groupBy("symbol").agg((F.sum(F.col("avg_compound") * F.col("n")) / F.sum("n")).alias("weighted_avg"))
    return out.withColumn("overall", overall_label(F.round("avg_compound", 9))).join(weighted, "symbol")


def enhancement_stats(df: DataFrame) -> DataFrame:
    """Articles, enhanced ones and extracted characters for each symbol and (symbol, source)."""
    rows = df.withColumn("x", F.when(F.col("extraction_successful"), F.col("extracted_length")))
    return rows.rollup("symbol", "source").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("enhanced"), F.coalesce(F.sum("x"), F.lit(0)).alias("chars"), F.avg("x").alias("avg_chars")).where("symbol is not null")


def sentiment_trend(df: DataFrame, now: Column, time: str = "article_timestamp") -> DataFrame:
    """Mean compound and count of the last day, the last seven, and of all."""
    cols = []
    for name, hours in (("day", 24), ("week", 168), ("all", None)):
        inside = F.lit(True) if hours is None else F.col(time) > now - F.expr(f"interval {hours} hours")
        cols += [F.count_if(inside).alias(f"n_{name}"), F.avg(F.when(inside, F.col("compound"))).alias(f"avg_{name}")]
    return df.groupBy("symbol").agg(*cols)


def coverage(df: DataFrame, now: Column, time: str = "article_timestamp") -> DataFrame:
    """Source diversity and confidence classes of each symbol."""
    out = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.max(time).alias("newest"))
    return out.select(
        "symbol", "n", "sources", F.least(F.col("sources") / 8.0, F.lit(1.0)).alias("diversity"),
        F.when(F.col("n") >= 30, "High").when(F.col("n") >= 15, "Medium").otherwise("Low").alias("sample_class"),
        F.when(F.col("sources") >= 6, "High").when(F.col("sources") >= 4, "Medium").otherwise("Low").alias("source_class"),
        (F.col("newest") > now - F.expr("interval 1 day")).alias("is_recent"),
    )


def article_counts(df: DataFrame) -> DataFrame:
    """Articles by symbol, by source, by both and in all (null: any), in one job."""
    return df.cube("symbol", "source").agg(F.count(F.lit(1)).alias("n"), F.min("article_id").alias("first_id"), F.max("article_id").alias("last_id"))


def top_extreme(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` articles of each symbol with the largest absolute compound."""
    rows = df.withColumn("__a", F.abs("compound"))
    w = Window.partitionBy("symbol").orderBy(F.desc("__a"), "article_id")
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__a", "__rn")


def recent_sample(df: DataFrame, n: int = 5, time: str = "article_id") -> DataFrame:
    """The newest ``n`` articles of each symbol, texts over 200 characters cut."""
    short = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    return last_n(df, n, ["symbol"], [time]).withColumn("text", short)


def filter_articles(df: DataFrame, label: str | None = None, source: str | None = None) -> DataFrame:
    """Articles of a label (part of its name) and a source."""
    if label:
        df = df.where(F.contains(F.lower("label"), F.lit(label.lower())))
    return df.where(F.col("source") == source) if source else df


def match_symbols(df: DataFrame, companies: DataFrame, id: str = "article_id", text: str = "text") -> DataFrame:
    """id, symbol of each company whose name or symbol is a word of the text.

    Names of one word are met by an equi-join on the text's distinct words; longer names are
    met by their first word and then looked for as a phrase.
    """
    words = df.select(id, F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("word"))
    names = companies.select("symbol", F.explode(F.array_distinct(F.array(F.lower("symbol"), F.lower("common_name")))).alias("name"))
    names = names.where("name <> ''").withColumn("word", F.element_at(F.split("name", r"[^\p{L}\p{N}]+"), 1))
    hits = words.join(names, "word").select(id, "symbol", F.when(F.col("name") != F.col("word"), F.col("name")).alias("phrase")).distinct()
    phrases = hits.where("phrase is not null").join(df.select(id, F.lower(text).alias("low")), id).where(F.contains("low", "phrase"))
    return hits.where("phrase is null").select(id, "symbol").union(phrases.select(id, "symbol")).distinct()


def symbol_report(sentiment: DataFrame, industry: DataFrame, market: DataFrame, technical: DataFrame, companies: DataFrame) -> DataFrame:
    """All there is about each symbol of ``companies`` (symbol, industry); any part may lack.

    ``industry`` is by industry, the others by symbol; ``n_parts`` counts those found.
    """
    out = companies.select("symbol", "industry")
    parts = []
    for name, df, on in (("sentiment", sentiment, "symbol"), ("industry_view", industry, "industry"), ("market", market, "symbol"), ("technical", technical, "symbol")):
        rest = [c for c in df.columns if c != on]
        out = out.join(df.select(on, F.struct(*rest).alias(name)), on, "left")
        parts.append(F.col(name).isNotNull().cast("int"))
    return out.withColumn("n_parts", sum(parts[1:], parts[0]))


def sources(df: DataFrame) -> DataFrame:
    """The distinct sources of articles, sorted."""
    return df.select("source").where("source is not null").distinct().orderBy("source")


def score_articles(df: DataFrame, score: Callable[[Column], Column | tuple[Column, Column]], text: str = "text") -> DataFrame:
    """``df`` with ``polarity``, ``compound`` and ``scored_by``, ``title`` or ``main``.

    Texts that are short when cleaned (under 300 characters), and those with consent phrases, are scored as titles:
    by what comes before the first full stop, with consent phrases by the first 100 characters.
    A title whose compound is 0.1 or less says nothing; then, and for all other texts, ``score`` of the cleaned text
    counts: a polarity and a compound, or one column that is both.
    """
    clean = clean_for_analysis(F.col(text))
    consent = any_of(F.lower(clean), CONSENT)
    polarity, compound = title_score(F.when(consent, F.substring(clean, 1, 100)).when(F.contains(clean, F.lit(".")), F.substring_index(clean, ".", 1)).otherwise(clean))
    by_title = ((F.length(clean) < 300) | consent) & (F.abs(compound) > 0.1)
    main = score(clean)
    main = main if isinstance(main, tuple) else (main, main)
    both = {"polarity": F.when(by_title, polarity).otherwise(main[0]), "compound": F.when(by_title, compound).otherwise(main[1])}
    return df.withColumns(both | {"scored_by": F.when(by_title, "title").otherwise("main")})


def throughput_report(runs: DataFrame) -> DataFrame:
    """Articles a second, seconds an article and class of each run (articles, seconds)."""
    rate = F.try_divide(F.col("articles").cast("double"), F.col("seconds"))
    return runs.withColumns({"per_second": rate, "seconds_each": F.try_divide(F.col("seconds").cast("double"), F.col("articles")), "class": F.when(rate > 1, "HIGH").when(rate > 0.5, "MEDIUM").otherwise("LOW")})
