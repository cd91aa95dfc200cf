"""Long series cut into chunks of time, so that no series is one task.

A series of more rows than a chunk should have is cut into buckets of equal time, and runs of buckets
make chunks.  The buckets' counts tell, without looking at rows again, which buckets hold the last
(or next) rows that a chunk's frames look at: those are copied to it as its halo.  A window
frame of n rows over (series, chunk), halo included, then has what it has over the series; halo rows are dropped
afterwards.  Running values are carried from chunk to chunk by a window over one row a chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import cut_lineage

#: A series' name, and the time of its rows.
KEYS, TIME = ["symbol"], "price_timestamp"
#: Rows of a chunk; series with no more are one chunk each.  Buckets that a chunk has.
ROWS, BUCKETS = 100_000, 16
#: Rows of a table (one for each chunk or bucket) that may be broadcast.
BROADCAST_ROWS = 500_000
BUCKET, CHUNK, HALO = "__bucket", "__chunk", "__halo"


def size_checked(df: DataFrame) -> DataFrame:
    """``df`` (written already) to be broadcast if it is small; else joins shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _near(buckets: DataFrame, starts: DataFrame, keys: list[str], end: str, rows: int, after: bool) -> DataFrame:
    """Buckets that end (start, if ``after``) within ``rows`` rows of a chunk's start; both sides are counts of rows before.

    Positions meet by blocks of ``rows``, so it is a join on equal values.
    """
    block = F.floor(F.col(end) / rows)
    left = buckets.withColumn("block", F.explode(F.array(block, block + (-1 if after else 1))))
    right = starts.withColumn("block", F.floor(F.col("start") / rows))
    gap = F.col(end) - F.col("start") if after else F.col("start") - F.col(end)
    return left.join(right, [*keys, "block"]).where((gap >= 0) & (gap < rows))


def _places(counts: DataFrame, keys: list[str], rows: int, before: int, after: int) -> DataFrame:
    """keys, bucket, chunk, halo: which chunks each bucket goes to."""
    order = Window.partitionBy(*keys).orderBy(BUCKET)  # a row a bucket
    counts = counts.withColumn("from", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumns({"to": F.col("from") + F.col("n"), CHUNK: F.floor(F.col("from") / rows).cast("int")})
    counts = cut_lineage(counts.select(*keys, BUCKET, CHUNK, "from", "to"))
    starts = counts.groupBy(*keys, CHUNK).agg(F.min("from").alias("start"))
    starts = starts.withColumn("previous", F.lag(CHUNK).over(Window.partitionBy(*keys).orderBy(CHUNK)))
    own = counts.select(*keys, BUCKET, CHUNK, F.lit(False).alias(HALO))
    if before:
        near = _near(counts.drop(CHUNK), starts.where("previous is not null"), keys, "to", before, False)
        own = own.union(near.select(*keys, BUCKET, CHUNK, F.lit(True)))
    if after:
        near = _near(counts.drop(CHUNK), starts.where("previous is not null"), keys, "from", after, True)
        own = own.union(near.select(*keys, BUCKET, "previous", F.lit(True)))
    return cut_lineage(own)


def cut(df: DataFrame, keys: list[str] = KEYS, before: int = 0, after: int = 0, rows: int | None = ROWS, time: str = TIME) -> DataFrame:
    """``df`` with its chunk and the halo: copies of ``before`` rows at least that come
    before each chunk, and ``after`` that come after it.  Without a series of over ``rows`` rows, ``df`` as it is.

    With None for ``rows``, or where ``df`` is cut already, nothing is done.  Rows at one time are never parted.  A null time, or a null in a key, stays in chunk 0.
    """
    if rows is None or is_cut(df):
        return df
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(micros).alias("__t0"), F.max(micros).alias("t1")).where(F.col("n") > rows)
    width = F.greatest(F.lit(1), F.floor((F.col("t1") - F.col("__t0")) * rows / (F.col("n") * BUCKETS))).cast("long")
    sizes = cut_lineage(sizes.select(*keys, "__t0", width.alias("__width")))
    if sizes.isEmpty():
        return df
    df = df.join(size_checked(sizes), keys, "left").withColumn(BUCKET, F.floor((micros - F.col("__t0")) / F.col("__width")).cast("long")).drop("__t0", "__width")
    counts = df.where(F.col(BUCKET).isNotNull()).groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("n"))
    places = _places(counts, keys, rows, before, after)
    df = df.join(size_checked(places), [*keys, BUCKET], "left")
    return df.drop(BUCKET).withColumns({CHUNK: F.coalesce(CHUNK, F.lit(0)), HALO: F.coalesce(HALO, F.lit(False))})


def is_cut(df: DataFrame) -> bool:
    return CHUNK in df.columns


def chunk_keys(df: DataFrame, keys: list[str]) -> list[str]:
    """What windows over ``df`` are partitioned by."""
    return [*keys, CHUNK] if is_cut(df) else keys


def uncut(df: DataFrame) -> DataFrame:
    """``df`` without halo rows and the columns that :func:`cut` has added."""
    return own_rows(df).drop(CHUNK, HALO) if is_cut(df) else df


def own_rows(df: DataFrame) -> DataFrame:
    """``df`` without halo rows, still cut."""
    return df.where(~F.col(HALO)) if is_cut(df) else df


def over_chunks(df: DataFrame, build: Callable[[DataFrame, list[str]], DataFrame], keys: list[str] = KEYS, before: int = 0, after: int = 0, rows: int | None = ROWS) -> DataFrame:
    """``build(df, keys)``, whose frames reach ``before`` rows back and ``after`` ahead, by chunks.

    A ``df`` that is cut stays so; its halo must reach as far.
    """
    parts = cut(df, keys, before, after, rows)
    out = build(parts, chunk_keys(parts, keys))
    return out if is_cut(df) else uncut(out)


def carried(df: DataFrame, keys: list[str], values: dict[str, tuple[Column, Callable]]) -> DataFrame:
    """``df`` (cut) with what earlier chunks hand on: of each of ``values`` an aggregate of a chunk's own rows, and the function
    that makes one of those of all earlier chunks (null for a series' first chunk).  Where ``df`` is not cut, nulls of no type."""
    if not is_cut(df):
        return df.withColumns({name: F.lit(None) for name in values})
    parts = df.where(~F.col(HALO)).groupBy(*keys, CHUNK).agg(*(own.alias(name) for name, (own, _) in values.items()))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    parts = parts.select(*keys, CHUNK, *(fold(F.col(name)).over(earlier).alias(name) for name, (_, fold) in values.items()))
    parts = size_checked(cut_lineage(parts))
    same = reduce(and_, (df[k].eqNullSafe(parts[k]) for k in [*keys, CHUNK]))
    return df.join(parts, same, "left").select(df["*"], *values)
