"""The driver's tables as bars, articles, companies and usage logs.

The SQL below runs unchanged in Spark and DuckDB; it is the common prefix of the oracle
SQL, and :class:`Views` gives the same relations as DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "ticks": "select event_type as symbol, ts, event_id, 100 + value as price, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as size from events",
    "bars_hour": "select symbol, date_trunc('hour', ts) as price_timestamp, min_by(price, (ts, event_id)) as open, max(price) as high, min(price) as low, max_by(price, (ts, event_id)) as close, cast(sum(size) as bigint) as volume, count(*) as trade_count, round(sum(price*size)/nullif(sum(size),0),6) as vwap, true as original from ticks group by 1,2",
    "articles": "select doc_id as article_id, concat('S', cast(cast(floor(doc_id/3) as bigint) % 10 as varchar(10))) as symbol, source, text, concat('https://news.example/', source, '/', md5(substring(text,1,60))) as url, n_chars as text_length from documents",
    "companies": "select concat('P', cast(p_partkey as varchar(12))) as symbol, p_name as company_name, p_brand as common_name, p_type as industry, p_size as days_old from part",
    "tiers": "select n_nationkey as tier_id, n_name as tier_name, n_nationkey % 4 as max_calls_per_hour, n_nationkey % 6 as max_calls_per_day from nation",
    "licenses": "select c_custkey as license_id, c_name as user_name, c_nationkey as tier_id, c_acctbal > 0 as is_active from customer",
    "usage_logs": "select event_id as log_id, user_id as license_id, event_type as endpoint, ts as request_timestamp, cast(floor(value) as bigint) as processing_time_ms, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as request_size, event_id % 7919 as response_size from events",
    "industry_analyses": "select o_orderkey as id, o_orderpriority as industry, concat('P', cast(o_custkey as varchar(12))) as company_symbol, cast(o_orderkey % 2001 - 1000 as double)/1000 as overall_sentiment, cast(o_orderkey % 101 as double)/100 as confidence_score, o_orderdate as created_at from orders",
}
_NEEDS = {"bars_hour": ("ticks",)}
_TABLES = {"ticks": "events", "bars_hour": "events", "articles": "documents", "companies": "part", "tiers": "nation", "licenses": "customer", "usage_logs": "events", "industry_analyses": "orders"}


def prefix(*names: str) -> str:
    """``with`` clause of DuckDB SQL that defines the views ``names``."""
    wanted = dict.fromkeys(x for n in names for x in (*_NEEDS.get(n, ()), n))
    return "with recursive " + ", ".join(f"{n} as ({SQL[n]})" for n in wanted)


class Views:
    """The views of one data folder as DataFrames, timestamps in UTC."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SQL:
            raise AttributeError(name)
        inner = SQL[name]
        for need in _NEEDS.get(name, ()):
            inner = inner.replace(f"from {need}", f"from ({SQL[need].replace('from ' + _TABLES[need], 'from {' + _TABLES[need] + '}')})")
        table = _TABLES[name]
        df = self.spark.sql(inner.replace(f"from {table}", f"from {{{table}}}"), **{table: self.table(table)})
        return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Times as epoch seconds, decimals as doubles, doubles rounded: the same in any engine."""
    out = {}
    for c, t in df.dtypes:
        if t.startswith("timestamp"):
            out[c] = F.unix_seconds(F.col(c).cast("timestamp"))
        elif t in ("double", "float") or t.startswith("decimal"):
            out[c] = F.round(F.col(c).cast("double"), digits) + F.lit(0.0)
    return df.withColumns(out) if out else df
