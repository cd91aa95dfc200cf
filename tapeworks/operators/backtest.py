"""Backtest of signals by windows: positions, trades, equity, risk.

A signal of 1 turns long, -1 turns short, 0 keeps the position; so the position is the last
signal that was not 0, and no state machine is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import KEYS, TIME, series
from .chunked import ROWS, carried, chunk_keys, cut, is_cut, uncut

CAPITAL, COST, YEAR = 10_000.0, 0.001, 252


def _last(column: Column) -> Column:
    return F.last(column, ignorenulls=True)


def _positions(df: DataFrame, keys: list[str]) -> DataFrame:
    """position, changed and __was (the position before) of signals that may be cut; no halo is needed."""
    df = carried(df, keys, {"__signal": (F.max_by("prediction", F.when(F.col("prediction") != 0, F.col(TIME))), lambda c: _last(c))})
    w = series(chunk_keys(df, keys))
    before = F.coalesce(F.col("__signal").cast("int"), F.lit(0))
    held = _last(F.when(F.col("prediction") != 0, F.col("prediction"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("position", F.coalesce(held, before))
    df = df.withColumn("__was", F.coalesce(F.lag("position", 1).over(w), before)).drop("__signal")
    return df.withColumn("changed", F.col("position") != F.col("__was"))


def positions(df: DataFrame, keys: list[str] = KEYS, rows: int | None = ROWS) -> DataFrame:
    """``position`` from ``prediction``, and ``changed`` where it differs from the row before."""
    out = _positions(cut(df, keys, rows=rows), keys).drop("__was")
    return out if is_cut(df) else uncut(out)


def trades(df: DataFrame, keys: list[str] = KEYS, rows: int | None = ROWS) -> DataFrame:
    """Rows where the position changes, with side."""
    return positions(df, keys, rows).where("changed").select(*keys, TIME, F.when(F.col("position") > 0, "BUY").otherwise("SELL").alias("side"), "price")


def equity_curve(df: DataFrame, keys: list[str] = KEYS, capital: float = CAPITAL, cost: float = COST, realize_shorts: bool = False, rows: int | None = ROWS) -> DataFrame:
    """``equity`` at each row.

    Closing a long multiplies the capital by exit / entry less the cost; closing a short
    takes the cost only, unless ``realize_shorts``.  An open position is marked to price.

    Series of over ``rows`` rows go by chunks: position, entry price and the sum of the factors' logarithms are
    handed on from chunk to chunk.  Signals that are cut (:func:`.chunked.cut`) give a curve that is cut.
    """
    out = _positions(cut(df, keys, rows=rows), keys)
    out = carried(out, keys, {"__entry": (F.max_by("price", F.when(F.col("changed"), F.col(TIME))), lambda c: _last(c))})
    w = series(chunk_keys(out, keys))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("__entry").cast("double")
    out = out.withColumn("entry", F.coalesce(_last(F.when(F.col("changed"), F.col("price"))).over(run), before))
    out = out.withColumn("__from", F.coalesce(F.lag("entry").over(w), before))
    short = F.col("__from") / F.col("price") if realize_shorts else F.lit(1.0)
    factor = F.when(F.col("changed") & (F.col("__was") == 1), F.col("price") / F.col("__from") * (1 - cost)).when(F.col("changed") & (F.col("__was") == -1), short * (1 - cost)).otherwise(1.0)
    out = carried(out.withColumn("__f", F.log(factor)), keys, {"__made": (F.sum("__f"), F.sum)})
    value = F.lit(capital) * F.exp(F.sum("__f").over(run) + F.coalesce(F.col("__made").cast("double"), F.lit(0.0)))
    mark = F.when(F.col("position") == 1, F.col("price") / F.col("entry")).when(F.col("position") == -1, F.col("entry") / F.col("price")).otherwise(1.0)
    out = out.withColumn("equity", value * mark).drop("__was", "__from", "__f", "__entry", "__made")
    return out if is_cut(df) else uncut(out)


def risk_metrics(curve: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Returns, Sharpe, Sortino, drawdown, Calmar, R squared, accuracy and trades of each series.

    Undefined ratios are 0; so are all ratios with one return or none.  A curve that is cut goes by chunks:
    the last values and the peak are handed on.
    """
    last = lambda c: (F.max_by(c, TIME), lambda x: _last(x))
    df = carried(curve, keys, {"__equity": last("equity"), "__price": last("price")})
    w = series(chunk_keys(df, keys))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    earlier = lambda c: F.coalesce(F.lag(c).over(w), F.col(f"__{c}").cast("double"))
    df = df.withColumns({"r": F.col("equity") / earlier("equity") - 1, "m": F.col("price") / earlier("price") - 1})
    df = carried(df.withColumn("__e", F.when(F.col("r").isNotNull(), F.col("equity"))), keys, {"__top": (F.max("__e"), F.max)})
    df = df.withColumn("__peak", F.greatest(F.max("__e").over(run), F.col("__top").cast("double")))
    df = df.withColumn("dd", F.when(F.col("r").isNotNull(), F.col("equity") / F.col("__peak") - 1))
    out = df.groupBy(*keys).agg(
        F.min_by("equity", TIME).alias("e0"), F.max_by("equity", TIME).alias("final_value"), F.min_by("price", TIME).alias("p0"), F.max_by("price", TIME).alias("p1"),
        F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.stddev_pop(F.when(F.col("r") < 0, F.col("r"))).alias("down"),
        F.min("dd").alias("dd"), F.covar_pop("r", "m").alias("cov"), F.var_pop("r").alias("vr"), F.var_pop("m").alias("vm"), F.avg((F.col("prediction") == F.col("target")).cast("double")).alias("accuracy"), F.count_if("changed").alias("trades"),
    )
    root = F.lit(float(YEAR) ** 0.5)
    zero = lambda e: F.when(F.col("n") <= 1, 0.0).otherwise(F.coalesce(e, F.lit(0.0)))
    out = out.withColumns({"total_return": (F.col("final_value") / F.col("e0") - 1) * 100, "buy_hold": (F.col("p1") / F.col("p0") - 1) * 100, "max_drawdown": zero(F.col("dd") * 100)})
    return out.select(
        *keys, "total_return", "buy_hold", zero(F.try_divide(root * F.col("mean"), F.col("sd"))).alias("sharpe"), zero(F.try_divide(root * F.col("mean"), F.col("down"))).alias("sortino"),
        "max_drawdown", zero(F.try_divide(F.col("total_return"), F.abs("max_drawdown"))).alias("calmar"), zero(F.try_divide(F.col("cov") * F.col("cov"), F.col("vr") * F.col("vm"))).alias("r_squared"), "accuracy", "trades", "final_value",
    )


LABELS = {1: "Buy", 0: "Hold", -1: "Sell"}


def consensus(preds: DataFrame) -> DataFrame:
    """One label for each symbol from predictions (symbol, timeframe, prediction, confidence).

    Needs two timeframes at least, else null; the label with the largest sum of confidence
    wins (that is the unanimous one, if there is one), ties in the order Buy, Hold, Sell.
    """
    sums = preds.groupBy("symbol", "prediction").agg(F.sum("confidence").alias("weight"), F.count_distinct("timeframe").alias("n"))
    order = F.when(F.col("prediction") == "Buy", 2).when(F.col("prediction") == "Hold", 1).otherwise(0)
    out = sums.groupBy("symbol").agg(F.max_by("prediction", F.struct(F.round("weight", 9), order)).alias("best"), F.count(F.lit(1)).alias("labels"))
    frames = preds.groupBy("symbol").agg(F.count_distinct("timeframe").alias("timeframes"))
    out = out.join(frames, "symbol")
    return out.select("symbol", "timeframes", F.when(F.col("timeframes") >= 2, F.col("best")).alias("consensus"), ((F.col("timeframes") >= 2) & (F.col("labels") == 1)).alias("unanimous"))


def batch_summary(preds: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: totals, counts for each label, confidence, and mean risk metrics."""
    left = preds.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("prediction").isNull()).alias("failed"), *(F.count_if(F.col("prediction") == v).alias(v.lower()) for v in LABELS.values()),
        F.avg("confidence").alias("avg_confidence"), F.count_if(F.col("confidence") > 0.7).alias("confident"),
    )
    right = metrics.agg(F.avg("sharpe").alias("avg_sharpe"), F.avg(F.abs("max_drawdown")).alias("avg_drawdown"), F.avg("total_return").alias("avg_return"))
    return left.withColumn("__k", F.lit(1)).join(right.withColumn("__k", F.lit(1)), "__k").drop("__k")  # one row each


def prediction_document(preds: DataFrame, metrics: DataFrame) -> DataFrame:
    """symbol and a JSON document of its prediction and risk metrics."""
    rows = preds.join(metrics, "symbol", "left")
    risk = F.struct(*(c for c in metrics.columns if c != "symbol"))
    body = F.struct("symbol", F.struct("prediction", "confidence").alias("prediction"), risk.alias("risk_metrics"))
    return rows.select("symbol", F.to_json(body).alias("document"))
