"""Reading and writing bars, analyses and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_CSV = "symbol string, timestamp timestamp, open double, high double, low double, close double, volume long, trade_count long, vwap double"
BAR_COLUMNS = ("symbol", "timestamp", "open", "high", "low", "close", "volume", "trade_count", "vwap")
ANALYSIS = (
    "symbol string, company_name string, analysis_timestamp timestamp, target_articles int, total_articles int, overall_sentiment string, "
    "sentiment_scores struct<average_sentiment: double, weighted_avg_from_sources: double>, "
    "source_breakdown map<string, struct<count: bigint, avg_sentiment: double>>, "
    "raw_articles array<struct<title: string, text: string, url: string, source: string, timestamp: string, polarity: double, compound: double>>"
)


def read_bars_csv(spark: SparkSession, path: str, timeframe: str) -> DataFrame:
    """Bars of per-symbol CSV files with a header; all are observed."""
    df = spark.read.schema(BAR_CSV).csv(path, header=True)
    return df.withColumnRenamed("timestamp", "price_timestamp").withColumns({"original": F.lit(True), "timeframe": F.lit(timeframe)})


def lacking_columns(df: DataFrame, required: tuple[str, ...] = BAR_COLUMNS) -> list[str]:
    """Required columns that ``df`` does not have."""
    return [c for c in required if c not in df.columns]


def rows_per_file(df: DataFrame) -> DataFrame:
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))


def bars_from_json(df: DataFrame, column: str) -> DataFrame:
    """Bars from a JSON array of objects with the columns of bars."""
    item = "array<struct<symbol: string, price_timestamp: timestamp, open: double, high: double, low: double, close: double, volume: bigint, trade_count: bigint, vwap: double>>"
    return df.select(F.explode(F.from_json(column, item)).alias("bar")).select("bar.*", F.lit(True).alias("original"))


def file_name_meta(df: DataFrame, name: str) -> DataFrame:
    """Symbol and time from names like ``sentiment_analysis_SYM_20250102_030405.json``."""
    part = lambda i: F.regexp_extract(name, r"sentiment_analysis_([^_/]+)_(\d{8})_(\d{6})\.json$", i)
    return df.withColumns({"file_symbol": F.nullif(part(1), F.lit("")), "file_time": F.try_to_timestamp(F.concat(part(2), part(3)), F.lit("yyyyMMddHHmmss"))})


def read_analysis_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Analyses and their articles from JSON documents; the file name stands in for a missing
    symbol or time."""
    df = spark.read.schema(ANALYSIS).json(path, multiLine=True).withColumn("file", F.input_file_name())
    df = file_name_meta(df, "file")
    df = df.withColumns({"symbol": F.coalesce("symbol", "file_symbol"), "analysis_timestamp": F.coalesce("analysis_timestamp", "file_time"), "total_articles": F.coalesce("total_articles", F.size("raw_articles"), F.lit(0)), "overall_sentiment": F.coalesce("overall_sentiment", F.lit("Neutral"))})
    articles = df.select("symbol", F.explode_outer("raw_articles").alias("a")).where("a is not null").select("symbol", "a.*")
    return df.drop("raw_articles", "file", "file_symbol", "file_time"), articles


def union_symbol_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """One article table from one for each symbol; of equal (url_hash, symbol) the first row by its values."""
    out = None
    for symbol, df in tables.items():
        df = df.withColumns({"symbol": F.lit(symbol), "url_hash": F.sha2("url", 256)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in ("symbol", "url_hash")]
    first = F.min(F.struct(*(c for c in rest if not out.schema[c].dataType.typeName() == "map"))).alias("row")
    return out.groupBy("symbol", "url_hash").agg(first).select("symbol", "url_hash", "row.*")


def union_report(tables: dict[str, DataFrame]) -> DataFrame:
    """symbol, rows that its table has, different ones, and duplicates, for each of ``tables``."""
    out = None
    for symbol, df in tables.items():
        n = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.sha2("url", 256)).alias("n_kept")).select(F.lit(symbol).alias("symbol"), "*")
        out = n if out is None else out.union(n)
    return out.withColumn("duplicates", F.col("n_rows") - F.col("n_kept"))


def read_symbol_files(spark: SparkSession, path: str, pattern: str = r"/symbol=([^/]+)/[^/]*$") -> DataFrame:
    """The article tables of all symbols below ``path`` in one plan, the symbol from each file's name, with url_hash."""
    files = spark.read.option("recursiveFileLookup", "true").parquet(path)
    symbol = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))
    return files.select("*", symbol.alias("symbol"), F.sha2("url", 256).alias("url_hash"))


def union_symbol_files(rows: DataFrame) -> DataFrame:
    """Of equal (url_hash, symbol) of :func:`read_symbol_files` the first row by its values."""
    rest = [c for c in rows.columns if c not in ("symbol", "url_hash")]
    return rows.groupBy("symbol", "url_hash").agg(F.min(F.struct(*rest)).alias("row")).select("symbol", "url_hash", "row.*")


def symbol_files_report(rows: DataFrame) -> DataFrame:
    """symbol, rows, different ones and duplicates, for each symbol of :func:`read_symbol_files`."""
    out = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("url_hash").alias("n_kept"))
    return out.withColumn("duplicates", F.col("n_rows") - F.col("n_kept"))


def summary_wide(articles: DataFrame, sources: list[str]) -> DataFrame:
    """A row for each symbol with count and mean compound of each source as columns."""
    name = lambda s: "".join(c if c.isalnum() else "_" for c in s)
    parts = [x for s in sources for x in (F.count_if(F.col("source") == s).alias(f"{name(s)}_Count"), F.avg(F.when(F.col("source") == s, F.col("compound"))).alias(f"{name(s)}_Avg_Sentiment"))]
    return articles.groupBy("symbol").agg(F.count(F.lit(1)).alias("total"), *parts)


def write_analysis(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write as ``parquet`` or ``json``, or as ``csv`` with nested columns in JSON."""
    if fmt == "csv":
        df = df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))})
    df.write.mode("overwrite").format(fmt).option("header", True).save(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **properties: str) -> DataFrame:
    """A database table read in ``parts`` ranges of ``column``."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)
