"""Removal of boilerplate lines by their frequency within a site.

A line's ratio is the number of its site's pages that contain it over all pages of the
site.  Lines above the ratio (and found on a least number of pages) are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut_lineage, private

RATIO, LEAST_PAGES = 0.02, 5
#: Pages of a site that meet its boilerplate lines in one part, where these are not broadcast.
PART_PAGES = 100_000


def _keys(text: Column) -> Column:
    """A 128-bit key for each line of ``text`` that is not blank."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("p"), F.xxhash64(F.lit(1), x).alias("q")))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies: bool = True) -> DataFrame:
    """site and key of each boilerplate line (a site has under lines a page / ratio of them).

    Without ``copies``, rows of one text on one site are one page.
    """
    whole = F.struct(F.xxhash64("text").alias("p"), F.xxhash64(F.lit(1), "text").alias("q"))
    pages = docs.select(F.col(host).alias("site"), F.col("text").alias("page"), whole.alias("whole"))
    lines = pages.select("site", "whole", F.explode(F.array_distinct(_keys(F.col("page")))).alias("key"))
    if not copies:
        pages, lines = pages.select("site", "whole").distinct(), lines.distinct()
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    counts = lines.groupBy("site", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    counts = counts.join(totals.withColumnRenamed("site", "t_site"), F.col("site").eqNullSafe(F.col("t_site")))
    return counts.where(F.col("n") > F.col("pages") * F.lit(ratio)).select("site", "key")


def remove_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies: bool = True) -> DataFrame:
    """``docs`` with kept_text, n_lines and n_removed; other columns stay.

    Lines are split at \\n and compared without outer spaces; blank lines are never
    removed and count in n_lines.  A null text stays null with no lines, an empty one is one
    blank line; the null host is one site; repeated rows count as pages each, or without
    ``copies`` as one page where their texts are equal.
    Columns of ``docs`` named like the new ones are replaced.

    A site has no more boilerplate lines than a page has on average, divided by the ratio.  Where all
    sites have ``BROADCAST_ROWS`` of them at most, they are broadcast and no page moves;
    else pages meet them by site, a large site's in parts of ``PART_PAGES``.
    """
    found = cut_lineage(boilerplate(docs, host, ratio, least_pages, copies))
    site, large_site, part, bad, kept = (private(docs, c) for c in ("site", "large_site", "part", "bad", "kept"))
    by_site = found.groupBy(F.col("site").alias(site)).agg(F.collect_list("key").alias(bad))
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = docs.join(F.broadcast(by_site), docs[host].eqNullSafe(by_site[site]), "left")
    else:
        parts = docs.groupBy(F.col(host).alias(large_site)).agg(F.ceil(F.count(F.lit(1)) / PART_PAGES).cast("int").alias(part)).where(F.col(part) > 1)
        large = F.broadcast(cut_lineage(parts))  # one row for PART_PAGES pages at most
        by_site = by_site.join(large, by_site[site].eqNullSafe(large[large_site]), "left").drop(large_site)
        by_site = by_site.withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(part, F.lit(1)) - 1)))
        dealt = docs.join(large, docs[host].eqNullSafe(large[large_site]), "left").drop(large_site)
        dealt = dealt.withColumn(part, F.pmod(F.xxhash64("text"), F.coalesce(part, F.lit(1))).cast("int"))
        rows = dealt.join(by_site, dealt[host].eqNullSafe(by_site[site]) & (dealt[part] == by_site[part]), "left").drop(by_site[part])
    lines = F.split(F.col("text"), "\n")

    def is_bad(line: Column) -> Column:
        key = F.struct(F.xxhash64(F.trim(line)).alias("p"), F.xxhash64(F.lit(1), F.trim(line)).alias("q"))
        return F.coalesce((F.trim(line) != "") & F.array_contains(F.col(bad), key), F.lit(False))

    rows = rows.withColumn(kept, F.when(F.col(bad).isNull(), lines).otherwise(F.filter(lines, lambda x: ~is_bad(x))))
    out = rows.withColumns(
        {
            "kept_text": F.array_join(kept, "\n"),
            "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size(lines) - F.size(kept), F.lit(0)).cast("long"),
        }
    )
    return out.drop(bad, site, part, kept)
