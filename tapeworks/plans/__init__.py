"""Registered queries and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import market, news
from .views import Views, plain

_ALL = market.SOURCES | news.SOURCES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.flagship(Views(spark, sf_dir))


def _query(build):
    return lambda spark, sf_dir: plain(build(Views(spark, sf_dir)))


def queries() -> dict:
    return {name: _query(build) for name, (build, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
