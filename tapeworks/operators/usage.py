"""API usage: totals by key and tier, rate limits, sessions, source health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR, DAY = 3600 * 10**6, 86400 * 10**6


def _totals(logs: DataFrame, days: int, now: Column) -> DataFrame:
    """Logs of the last ``days`` added up by key, before any join."""
    rows = logs.where(F.col("request_timestamp") > now - F.expr(f"interval {days} days"))
    return rows.groupBy("license_id").agg(
        F.count(F.lit(1)).alias("calls"), F.count_distinct(F.to_date("request_timestamp")).alias("active_days"),
        F.sum("processing_time_ms").alias("ms"), F.sum(F.col("request_size") + F.col("response_size")).alias("bytes"),
    )


def usage_by_key(keys: DataFrame, tiers: DataFrame, logs: DataFrame, days: int, now: Column) -> DataFrame:
    """Calls, days with calls, mean latency and bytes of each key; 0 and null without calls."""
    out = keys.join(tiers.select("tier_id", "tier_name"), "tier_id").join(_totals(logs, days, now), "license_id", "left")
    return out.select("license_id", "tier_name", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("active_days", F.lit(0)).alias("active_days"), (F.col("ms") / F.col("calls")).alias("avg_ms"), "bytes")


def usage_by_tier(keys: DataFrame, tiers: DataFrame, logs: DataFrame, days: int, now: Column) -> DataFrame:
    """Keys, active keys, calls, mean latency and bytes of each tier."""
    rows = tiers.join(keys, "tier_id", "left").join(_totals(logs, days, now), "license_id", "left")
    return rows.groupBy("tier_id", "tier_name").agg(
        F.count_distinct("license_id").alias("keys"), F.count_distinct(F.when(F.col("is_active"), F.col("license_id"))).alias("active_keys"),
        F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), (F.sum("ms") / F.sum("calls")).alias("avg_ms"), F.sum("bytes").alias("bytes"),
    )


#: Micros of a bucket; an hour and a day are whole numbers of buckets.
MINUTE = 60 * 10**6


def calls_before(logs: DataFrame, spans: dict[str, int], key: str = "license_id", bucket: int = MINUTE) -> DataFrame:
    """``logs`` (with t, micros) and a column for each of ``spans`` (micros): how many calls of the key came less than that
    before each, calls at the same time left out.

    Calls are counted by (key, bucket); whole buckets are added up over those counts, a row a bucket.  What is left is
    inside two buckets: earlier calls of a call's own, and in the bucket a span before those that are later in it.
    For the latter a call sends its place there, so each (key, bucket) is a task's work by itself and a key with very many
    calls is spread over all its buckets.
    """
    points = logs.groupBy(key, "t").agg(F.count(F.lit(1)).alias("n"))  # calls at one time have equal counts
    points = points.withColumns({"bucket": F.floor(F.col("t") / bucket).cast("long"), "at": F.pmod(F.col("t"), F.lit(bucket))})
    order = Window.partitionBy(key).orderBy("bucket")  # a row a bucket
    sizes = points.groupBy(key, "bucket").agg(F.sum("n").alias("held"))
    whole = {f"whole_{i}": F.coalesce(F.sum("held").over(order.rangeBetween(-span // bucket + 1, -1)), F.lit(0)) for i, span in enumerate(spans.values())}
    sizes = sizes.select(F.col(key).alias("of_key"), F.col("bucket").alias("of_bucket"), *(c.alias(name) for name, c in whole.items()))

    # a call's own place, and where it asks how many of an earlier bucket are later in it
    places = [(-1, 0), *((i, span // bucket) for i, span in enumerate(spans.values()))]
    sent = points.withColumn("x", F.explode(F.array(*(F.struct(F.lit(i).alias("asks"), (F.col("bucket") - back).alias("to")) for i, back in places)))).select(key, "t", "n", "at", "x.*")
    own = F.when(F.col("asks") < 0, F.col("n")).otherwise(0)
    within = Window.partitionBy(key, "to").orderBy("at")
    sent = sent.withColumns({"upto": F.sum(own).over(within), "held": F.sum(own).over(Window.partitionBy(key, "to"))})
    sent = sent.join(sizes, sent[key].eqNullSafe(sizes["of_key"]) & (sent["to"] == sizes["of_bucket"]), "left")
    earlier = F.col("upto") - F.col("n")
    counts = sent.groupBy(F.col(key).alias("of_key"), F.col("t").alias("of_t")).agg(
        *(F.sum(F.when(F.col("asks") < 0, earlier + F.col(f"whole_{i}")).when(F.col("asks") == i, F.col("held") - F.col("upto")).otherwise(0)).alias(name) for i, name in enumerate(spans))
    )
    return logs.join(counts, logs[key].eqNullSafe(counts["of_key"]) & (logs["t"] == counts["of_t"])).drop("of_key", "of_t")


def rate_limit_audit(logs: DataFrame, keys: DataFrame, tiers: DataFrame) -> DataFrame:
    """Calls of the hour and the day before each request against the limits of its tier.

    A limit of 0 or less, and the tier ``master``, is unlimited.  The request itself does
    not count, nor one exactly an hour or a day before.
    """
    known = logs.join(keys.select("license_id", "tier_id"), "license_id")
    rows = calls_before(known.select("log_id", "license_id", "tier_id", F.unix_micros("request_timestamp").alias("t")), {"calls_hour": HOUR, "calls_day": DAY})
    rows = rows.join(tiers, "tier_id")
    free = F.lower("tier_name") == "master"
    over = lambda n, most: ~free & (F.col(most) > 0) & (F.col(n) >= F.col(most))
    verdict = F.when(over("calls_hour", "max_calls_per_hour"), "hour").when(over("calls_day", "max_calls_per_day"), "day").otherwise("ok")
    return rows.select("log_id", "license_id", "calls_hour", "calls_day", verdict.alias("verdict"))


def session_audit(sessions: DataFrame, keys: DataFrame, tiers: DataFrame, now: Column) -> DataFrame:
    """Live sessions of each key against what its tier allows (max_sessions; 0 or less: any)."""
    live = F.count_if(F.col("is_live") & (F.col("expires_at") > now)).alias("active")
    counts = sessions.groupBy("license_id").agg(live, F.count_if(F.col("expires_at") <= now).alias("expired"))
    out = keys.join(tiers.select("tier_id", "max_sessions"), "tier_id").join(counts, "license_id", "left")
    active = F.coalesce("active", F.lit(0))
    return out.select("license_id", active.alias("active"), F.coalesce("expired", F.lit(0)).alias("expired"), "max_sessions", ((F.col("max_sessions") <= 0) | (active < F.col("max_sessions"))).alias("may_open"))


def source_health(attempts: DataFrame) -> DataFrame:
    """Attempts, successes and rate of each source (source, success); disabled with ten
    attempts and a rate under a tenth.  Every source is judged, also one without success."""
    out = attempts.groupBy("source").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("successes"))
    return out.withColumns({"rate": F.col("successes") / F.col("attempts"), "disabled": (F.col("attempts") >= 10) & (F.col("successes") * 10 < F.col("attempts"))})
