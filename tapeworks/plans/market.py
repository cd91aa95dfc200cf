"""Queries over bars: loading, gaps, indicators, labels, backtest.

Each entry is a function of :class:`Views` and the same result as DuckDB SQL (or None).
"""

from __future__ import annotations

import sqlite3
from contextlib import closing

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import backtest, bars, chunked, features, indicators, lookup, model
from ..sources import database, files, ingest, versioned
from . import streamed
from .views import SQL, Views, plain, prefix

T = bars.TIME
#: End of series that have at most 100 observed bars.
SHORT = "2024-01-04"
TODAY, NOW = "2024-01-31", "2024-01-31 00:00:00"
B = prefix("bars_hour")
TS = "cast(epoch(price_timestamp) as bigint) as price_timestamp"
BAR = f"symbol, {TS}, round(open,6) as open, round(high,6) as high, round(low,6) as low, round(close,6) as close, volume, trade_count, round(vwap,6) as vwap"
BAR_COLS = ["symbol", T, "open", "high", "low", "close", "volume", "trade_count", "vwap"]
W = "partition by symbol order by price_timestamp"


def _even(v: Views) -> DataFrame:
    """Bars of even hours: the table that others are loaded into."""
    return v.bars_hour.where(F.hour(T) % 2 == 0)


def _shifted(v: Views) -> DataFrame:
    """All bars with closes one higher."""
    return v.bars_hour.withColumn("close", F.col("close") + 1)


def r(e: str, name: str = "") -> str:
    return f"round(cast({e} as double), 6) + 0.0 as {name or e}"


def _mean(n: int, column: str = "close", source: str = "bars_hour") -> str:
    f = f"over ({W} rows between {n - 1} preceding and current row)"
    return f"case when count({column}) {f} = {n} then avg({column}) {f} end"


GAPS = f"""{B}, n as (select *, lead(price_timestamp) over ({W}) as nxt from bars_hour),
gaps as (select symbol, price_timestamp + interval 1 hour as gap_start, nxt - interval 1 hour as gap_end, open, high, low, close, volume, trade_count, vwap
         from n where nxt > price_timestamp + interval 1 hour)"""
POINTS = "greatest(0, cast(floor((epoch(gap_end) - epoch(gap_start)) / 3600) as bigint) + 1)"
FILLED = f"""{GAPS}, filled as (select symbol, price_timestamp, open, high, low, close, volume, trade_count, vwap, true as original from bars_hour
 union all select symbol, unnest(generate_series(gap_start, gap_end, interval 1 hour)), open, high, low, close, coalesce(volume, 0), coalesce(trade_count, 0), vwap, false from gaps where gap_start <= gap_end)"""
LABELS = f"""{B}, l as (select *, lead(close, 5) over ({W}) as future_close from bars_hour),
lab as (select *, (future_close - close) / close * 100 as future_return, case when (future_close - close) / close * 100 > 1.0 then 1 when (future_close - close) / close * 100 < -1.0 then -1 else 0 end as target
        from l where future_close is not null)"""


def ewm_sql(name: str, source: str, column: str, n: int, wilder: bool = False) -> str:
    """CTEs of the weighted mean of ``column`` by recursion over its rows that are not null."""
    a = f"(1.0/{n})" if wilder else f"(2.0/({n}+1))"
    return f"""{name}_s as (select symbol, price_timestamp, {column} as x, row_number() over ({W}) as rn from {source} where {column} is not null),
{name}_r as (select symbol, rn, y from (select symbol, {n} as rn, avg(x) as y, count(*) as c from {name}_s where rn <= {n} group by symbol) where c = {n}
 union all select s.symbol, s.rn, (1 - {a}) * e.y + {a} * s.x from {name}_r e join {name}_s s on s.symbol = e.symbol and s.rn = e.rn + 1),
{name} as (select s.symbol, s.price_timestamp, e.y from {name}_s s join {name}_r e on s.symbol = e.symbol and s.rn = e.rn)"""


def joined(*names: str, source: str = "bars_hour") -> str:
    return f"from {source} b " + " ".join(f"left join {n} on {n}.symbol = b.symbol and {n}.price_timestamp = b.price_timestamp" for n in names)


KEYS = "b.symbol, cast(epoch(b.price_timestamp) as bigint) as price_timestamp"
CHANGES = f"""d as (select *, close - lag(close) over ({W}) as dc, lag(close) over ({W}) as pc, high - lag(high) over ({W}) as up, lag(low) over ({W}) - low as dn from bars_hour),
c as (select symbol, price_timestamp, greatest(dc, 0) as gain, greatest(-dc, 0) as loss, case when pc is null then null else greatest(high - low, abs(high - pc), abs(low - pc)) end as tr,
      case when pc is null then null when up > dn and up > 0 then up else 0 end as pdm, case when pc is null then null when dn > up and dn > 0 then dn else 0 end as mdm from d where pc is not null)"""
ADX = f"""{B}, {CHANGES}, {ewm_sql("atr", "c", "tr", 14, True)}, {ewm_sql("pd", "c", "pdm", 14, True)}, {ewm_sql("md", "c", "mdm", 14, True)},
dm as (select atr.symbol, atr.price_timestamp, 100 * pd.y / nullif(atr.y, 0) as p, 100 * md.y / nullif(atr.y, 0) as m from atr join pd using (symbol, price_timestamp) join md using (symbol, price_timestamp)),
dx as (select *, 100 * abs(p - m) / nullif(p + m, 0) as dx from dm), {ewm_sql("adx", "dx", "dx", 14, True)},
o as (select b.symbol, b.price_timestamp, dm.p, dm.m, adx.y as adx {joined("dm", "adx")})"""
SIGNALS = f"""{LABELS}, s0 as (select *, {_mean(20)} as sma_20 from bars_hour),
sig as (select b.symbol, b.price_timestamp, b.close as price, lab.target, cast(sign(b.close - b.sma_20) as int) as prediction from s0 b join lab using (symbol, price_timestamp) where b.sma_20 is not null),
p0 as (select *, coalesce(last_value(case when prediction <> 0 then prediction end ignore nulls) over ({W} rows between unbounded preceding and current row), 0) as position from sig),
pos as (select *, position <> lag(position, 1, 0) over ({W}) as changed from p0)"""
EQUITY = f"""{SIGNALS}, e0 as (select *, last_value(case when changed then price end ignore nulls) over ({W} rows between unbounded preceding and current row) as entry from pos),
e1 as (select *, lag(position, 1, 0) over ({W}) as was, lag(entry) over ({W}) as frm from e0),
e2 as (select *, case when changed and was = 1 then price / frm * (1 - 0.001) when changed and was = -1 then 1 - 0.001 else 1 end as f from e1),
eq as (select *, 10000 * exp(sum(ln(f)) over ({W} rows between unbounded preceding and current row)) * case when position = 1 then price / entry when position = -1 then entry / price else 1 end as equity from e2)"""


RISK = f"""{EQUITY}, a as (select *, equity / lag(equity) over ({W}) - 1 as rt, price / lag(price) over ({W}) - 1 as m from eq),
b as (select *, case when rt is not null then equity / max(case when rt is not null then equity end) over ({W} rows unbounded preceding) - 1 end as dd from a),
g as (select symbol, (max_by(equity, price_timestamp) / min_by(equity, price_timestamp) - 1) * 100 as total_return, (max_by(price, price_timestamp) / min_by(price, price_timestamp) - 1) * 100 as buy_hold, avg(rt) as mu, stddev_pop(rt) as sd, stddev_pop(case when rt < 0 then rt end) as dn,
      min(dd) * 100 as mdd, corr(rt, m) as co, avg(case when prediction = target then 1.0 else 0.0 end) as accuracy, count_if(changed) as trades, max_by(equity, price_timestamp) as final_value from b group by 1),
rm as (select symbol, total_return, buy_hold, coalesce(sqrt(252) * mu / nullif(sd, 0), 0) as sharpe, coalesce(sqrt(252) * mu / nullif(dn, 0), 0) as sortino, coalesce(mdd, 0) as max_drawdown, coalesce(total_return / nullif(abs(mdd), 0), 0) as calmar, coalesce(co * co, 0) as r_squared, accuracy, trades, final_value from g)"""
RISK_ROUNDED = ", ".join("trades" if c == "trades" else r(f"rm.{c}", c) for c in ("total_return", "buy_hold", "sharpe", "sortino", "max_drawdown", "calmar", "r_squared", "accuracy", "trades", "final_value"))


def signals(v: Views, rows: int | None = chunked.ROWS) -> DataFrame:
    """Signals of each bar, still cut into chunks if a series has over ``rows`` rows."""
    df = chunked.cut(v.bars_hour, before=20, after=5, rows=rows)
    df = features.add_labels(indicators.averages(df, (20,), rows=None), rows=None).where("sma_20 is not null")
    parts = [chunked.CHUNK, chunked.HALO] if chunked.is_cut(df) else []
    return chunked.own_rows(df).select("symbol", T, F.col("close").alias("price"), "target", F.signum(F.col("close") - F.col("sma_20")).cast("int").alias("prediction"), *parts)


def _curve(v: Views, rows: int | None = chunked.ROWS) -> DataFrame:
    return backtest.equity_curve(signals(v, rows), rows=None)


def _timeframes(v: Views) -> DataFrame:
    """A prediction of each user's activity for three ways of cutting it: the input of consensus."""
    rows = v.usage_logs.groupBy(F.col("license_id").cast("string").alias("symbol"), F.col("endpoint").alias("timeframe")).agg(F.avg("processing_time_ms").alias("a"), F.avg("request_size").alias("b"))
    label = F.when(F.col("a") > F.col("b") + 5, "Buy").when(F.col("a") < F.col("b") - 5, "Sell").otherwise("Hold")
    return rows.select("symbol", "timeframe", label.alias("prediction"), (F.pmod(F.floor(F.col("b")), F.lit(100)) / 100).alias("confidence")).where("timeframe <> 'error'")


FRAMES = """ f0 as (select cast(license_id as varchar) as symbol, endpoint as timeframe, avg(processing_time_ms) as a, avg(request_size) as b from usage_logs group by 1, 2),
preds as (select symbol, timeframe, case when a > b + 5 then 'Buy' when a < b - 5 then 'Sell' else 'Hold' end as prediction, (floor(b) % 100) / 100 as confidence from f0 where timeframe <> 'error')"""


def _all_frames(v: Views, df: DataFrame | None = None) -> DataFrame:
    return (v.bars_hour if df is None else df).withColumn("timeframe", F.lit("hour"))


def _indicator_frame(v: Views) -> DataFrame:
    return indicators.add_indicators(v.bars_hour)


def _model_parts(v: Views) -> tuple[DataFrame, DataFrame, list[str]]:
    df = features.encode_symbol(indicators.add_indicators(features.add_labels(v.bars_hour)))
    rows, names = features.feature_matrix(df)
    rows = features.temporal_split(rows)
    return rows.where("part = 'train'").drop("part"), rows.where("part = 'validation'").drop("part"), names


def _predict(v: Views, kind: str, **how) -> DataFrame:
    train, test, names = _model_parts(v)
    fitted = model.train_model(train, names, kind, **how)
    return model.predict_batch(fitted, test).select("symbol", T, "target", "predicted", "label_name", F.round("confidence", 6).alias("confidence"))


def _importance(v: Views) -> DataFrame:
    train, _, names = _model_parts(v)
    return model.feature_importance(v.spark, model.train_model(train, names), names)


def _feature_values(v: Views) -> DataFrame:
    """The ten features that matter most, with their latest values."""
    train, test, names = _model_parts(v)
    found = model.feature_importance(v.spark, model.train_model(train, names), names)
    return model.importance_with_values(found, test)


def _saved_models(v: Views) -> DataFrame:
    """Models by timeframe (days have too few rows for their features: an error), saved, listed and summed up."""
    train, test, names = _model_parts(v)
    folder = streamed.root(v, "models")
    made = model.train_all_timeframes(train.withColumn("timeframe", F.lit("hour")), names, ["hour", "day"])
    for timeframe, fitted, _ in made:
        if fitted is not None:
            score = model.accuracy(model.predict_batch(fitted, test)).first()["accuracy"]
            model.save_model(v.spark, fitted, {"timeframe": timeframe, "model_type": "random_forest", "training_samples": train.count(), "validation_accuracy": score, "features": names}, f"{folder}/{timeframe}")
    errors = v.spark.createDataFrame([(t, e) for t, _, e in made], "timeframe string, error string")
    listed = model.list_models(v.spark, folder).select("timeframe", "model_type", "training_samples", "validation_accuracy")
    return errors.select("timeframe", (F.col("error") == "").alias("trained")).join(listed, "timeframe", "left").crossJoin(F.broadcast(model.model_summary(listed)))  # two rows and one


def _rounds(v: Views) -> DataFrame:
    train, test, names = _model_parts(v)
    return model.compare_rounds(train, test, names)


def _stream_bars(v: Views) -> DataFrame:
    """Streamed bars, and the hours still open at the watermark from the batch."""
    closed = streamed.bars(v)
    last = closed.agg(F.max(T).alias("last"))
    still_open = v.bars_hour.crossJoin(F.broadcast(last)).where(F.col("last").isNull() | (F.col(T) > F.col("last")))
    return closed.unionByName(still_open.select(*closed.columns))


def _bars_by_csv(v: Views) -> DataFrame:
    """Hourly bars written as CSV files and read again."""
    path = streamed.root(v, "csv")
    v.bars_hour.withColumnRenamed(T, "timestamp").select(*files.BAR_COLUMNS).write.csv(path, header=True)
    return files.read_bars_csv(v.spark, path, "hour").select(*BAR_COLS)


def _bars_by_database(v: Views) -> DataFrame:
    """Hourly bars in a database file of the shared folder, and read from it in four ranges."""
    path = f"{streamed.root(v, 'database').removeprefix('file://')}.db"
    rows = v.bars_hour.select(*BAR_COLS)
    with closing(sqlite3.connect(path)) as connection:
        connection.execute(f"create table bars ({', '.join(BAR_COLS)})")
        connection.commit()
    database.write_database(rows, dsn=path, table="bars")
    return database.read_database(v.spark, rows.schema, dsn=path, table="bars", column="volume", low=0, high=1000, parts=4).where("trade_count > 0")


def _rows_per_file(v: Views) -> DataFrame:
    """Hourly bars written as one CSV file a symbol, and the rows of each file."""
    path = streamed.root(v, "csv")
    v.bars_hour.repartition("symbol").write.partitionBy("symbol").csv(path, header=True)
    rows = files.rows_per_file(v.spark.read.csv(path, header=True))
    return rows.groupBy(F.regexp_extract("file", "symbol=([^/]+)/", 1).alias("symbol")).agg(F.sum("n_rows").alias("n_rows"))


def _bars_by_json(v: Views) -> DataFrame:
    """Hourly bars as a JSON array for each day, and read from it."""
    days = v.bars_hour.groupBy("symbol", F.to_date(T).alias("day")).agg(F.to_json(F.collect_list(F.struct(*BAR_COLS))).alias("doc"))
    return files.bars_from_json(days, "doc").select(*BAR_COLS)


def _price_table(v: Views) -> DataFrame:
    """Prices as text with thousands commas, every fifth hour with a date that is none."""
    date = F.when(F.hour(T) % 5 == 0, "none").otherwise(F.date_format(T, "yyyy-MM-dd"))
    rows = v.bars_hour.select("symbol", F.hour(T).alias("hour"), date.alias("date"), F.format_number(F.col("close") * 1000, 3).alias("close"))
    return ingest.clean_price_table(rows, ["close"]).withColumn("date", F.col("date").cast("string"))


def _named_files(v: Views) -> DataFrame:
    name = F.concat(F.lit("data/sentiment_analysis_"), F.col("symbol"), F.date_format(T, "'_'yyyyMMdd'_'HHmmss"), F.lit(".json"))
    return files.file_name_meta(v.bars_hour.withColumn("name", name), "name").select("symbol", T, "file_symbol", "file_time")


def _documents(v: Views) -> DataFrame:
    """What the JSON documents of the latest signals hold."""
    latest = signals(v).groupBy("symbol").agg(F.max_by("prediction", T).alias("prediction"), F.lit(1.0).alias("confidence"))
    metrics = backtest.risk_metrics(_curve(v))
    docs = backtest.prediction_document(latest, metrics)
    get = lambda path: F.get_json_object("document", f"$.{path}")
    risks = {c: get(f"risk_metrics.{c}").cast("long" if c == "trades" else "double") for c in metrics.columns if c != "symbol"}
    return docs.select("symbol", get("prediction.prediction").cast("int").alias("prediction"), get("prediction.confidence").cast("double").alias("confidence"), *(e.alias(c) for c, e in risks.items()))


def _sized(v: Views) -> DataFrame:
    def prepare(bars_of):
        rows, names = features.feature_matrix(features.encode_symbol(indicators.add_indicators(features.add_labels(bars_of))))
        return rows, [n for n in names if n != "close"] + ["close"]

    return model.compare_sizes(v.bars_hour, prepare, kind="random_forest")


SOURCES = {
    "bars_from_ticks": (
        lambda v: bars.build_bars(v.ticks, tie=("event_id",)).select(*BAR_COLS),
        prefix("ticks") + """, o as (select *, date_trunc('hour', ts) as h, row_number() over (partition by symbol, date_trunc('hour', ts) order by ts, event_id) as i, count(*) over (partition by symbol, date_trunc('hour', ts)) as n from ticks)
        select symbol, cast(epoch(h) as bigint) as price_timestamp, round(max(case when i = 1 then price end), 6) as open, round(max(price), 6) as high, round(min(price), 6) as low, round(max(case when i = n then price end), 6) as close,
        cast(sum(size) as bigint) as volume, count(*) as trade_count, round(sum(price * size) / nullif(sum(size), 0), 6) as vwap from o group by symbol, h""",
    ),
    "bars_by_csv": (_bars_by_csv, f"{B} select {BAR} from bars_hour"),
    "bars_by_database": (_bars_by_database, f"{B} select {BAR} from bars_hour"),
    "rows_per_file": (_rows_per_file, f"{B} select symbol, count(*) as n_rows from bars_hour group by 1"),
    "bars_by_json": (_bars_by_json, f"{B} select {BAR} from bars_hour"),
    "load_bars": (
        lambda v: bars.load_bars(_all_frames(v, bars.forward_fill(v.bars_hour)), v.bars_hour.where("symbol >= 'p'"), "hour", 200).select("symbol", T, "close", "original"),
        f"{FILLED} select symbol, {TS}, {r('close')}, original from (select *, sum(case when original then 1 else 0 end) over (partition by symbol) as n from filled where symbol >= 'p') where original or n <= 100 qualify row_number() over (partition by symbol order by price_timestamp desc) <= 200",
    ),
    "clean_price_table": (_price_table, f"{B} select symbol, hour(price_timestamp) as hour, strftime(price_timestamp, '%Y-%m-%d') as date, {r('round(close * 1000, 3)', 'close')} from bars_hour where hour(price_timestamp) % 5 <> 0"),
    "file_name_meta": (_named_files, f"{B} select symbol, {TS}, symbol as file_symbol, cast(epoch(price_timestamp) as bigint) as file_time from bars_hour"),
    "bars_rollup_day": (
        lambda v: bars.rollup_bars(v.bars_hour),
        f"""{B} select symbol, cast(epoch(date_trunc('day', price_timestamp)) as bigint) as price_timestamp, {r("min_by(open, price_timestamp)", "open")}, {r("max(high)", "high")}, {r("min(low)", "low")}, {r("max_by(close, price_timestamp)", "close")},
        cast(sum(volume) as bigint) as volume, cast(sum(trade_count) as bigint) as trade_count, {r("sum(vwap * volume) / nullif(sum(case when vwap is not null then volume end), 0)", "vwap")} from bars_hour group by symbol, date_trunc('day', price_timestamp)""",
    ),
    "latest_bar": (lambda v: lookup.latest_per_key(v.bars_hour, ["symbol"], [T]).select(*BAR_COLS), f"{B} select {BAR} from bars_hour qualify row_number() over (partition by symbol order by price_timestamp desc) = 1"),
    "latest_n_bars": (lambda v: bars.latest_bars(v.bars_hour, 50).select(*BAR_COLS), f"{B} select {BAR} from bars_hour qualify row_number() over (partition by symbol order by price_timestamp desc) <= 50"),
    "bars_between": (
        lambda v: bars.bars_between(v.bars_hour, F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-10").cast("timestamp")).select(*BAR_COLS),
        f"{B} select {BAR} from bars_hour where price_timestamp between timestamp '2024-01-05' and timestamp '2024-01-10'",
    ),
    "available_symbols": (lambda v: bars.available_symbols(v.bars_hour, 100), f"{B} select symbol, count(*) as records from bars_hour where original group by 1 having count(*) >= 100"),
    "top_symbols": (lambda v: bars.top_symbols(v.bars_hour, 3), f"{B} select symbol, count(*) as records from bars_hour group by 1 order by 2 desc, 1 limit 3"),
    "bar_counts": (lambda v: bars.bar_counts(v.bars_hour), f"{B} select symbol, count(*) as n from bars_hour group by 1"),
    "profile_bars": (
        lambda v: bars.profile_bars(v.bars_hour).withColumn("is_total", F.col("is_total").cast("int")),
        f"{B} select symbol, count(*) as total, count_if(original) as observed, count(distinct symbol) as symbols, cast(epoch(min(price_timestamp)) as bigint) as earliest, cast(epoch(max(price_timestamp)) as bigint) as latest, cast(grouping(symbol) as int) as is_total from bars_hour group by rollup (symbol)",
    ),
    "recent_quality": (
        lambda v: bars.recent_quality(v.bars_hour),
        f"""{B}, l as (select * from bars_hour qualify row_number() over (partition by symbol order by price_timestamp desc) <= 100)
        select symbol, {r("min(low)", "low")}, {r("max(high)", "high")}, {r("avg(volume)", "avg_volume")}, {r("max_by(close, price_timestamp)", "last_close")}, date_diff('day', min(price_timestamp), max(price_timestamp)) as days from l group by 1""",
    ),
    "market_snapshot": (
        lambda v: bars.market_snapshot(v.bars_hour),
        f"""{B}, l as (select *, row_number() over (partition by symbol order by price_timestamp desc) as rn from bars_hour),
        g as (select symbol, count(*) as n, min(price_timestamp) as a, max(price_timestamp) as z, max(case when rn = 1 then close end) as close, max(case when rn = 2 then close end) as p, max(case when rn = 24 then close end) as f,
              max(case when rn = 1 then volume end) as volume, max(case when rn = 1 then vwap end) as vwap from l where rn <= 24 group by 1)
        select symbol, n, cast(epoch(a) as bigint) as first_ts, cast(epoch(z) as bigint) as last_ts, {r("close")}, {r("(close - p) / p * 100", "change_pct")}, {r("(close - f) / f * 100", "window_change_pct")}, volume, vwap from g""",
    ),
    "prefer_original_short": (
        lambda v: bars.prefer_original(bars.forward_fill(v.bars_hour.where(F.col(T) < F.lit(SHORT).cast("timestamp")))).select("symbol", T, "close", "original"),
        FILLED.replace("from bars_hour", f"from (select * from bars_hour where price_timestamp < timestamp '{SHORT}') bars_hour") + f" select symbol, {TS}, {r('close')}, original from (select *, sum(case when original then 1 else 0 end) over (partition by symbol) as n from filled) where original or n <= 100",
    ),
    "prefer_original": (
        lambda v: bars.prefer_original(bars.forward_fill(v.bars_hour)).select("symbol", T, "close", "original"),
        f"{FILLED} select symbol, {TS}, {r('close')}, original from (select *, sum(case when original then 1 else 0 end) over (partition by symbol) as n from filled) where original or n <= 100",
    ),
    "partition_balance": (
        lambda v: bars.partition_balance(v.usage_logs, 16, "license_id"),
        prefix("usage_logs") + f" select cast(concat('0x', substring(md5(cast(license_id as varchar)), 1, 8)) as bigint) % 16 as part, count(*) as n_rows, {r('count(*) / sum(count(*)) over ()', 'share')} from usage_logs group by 1",
    ),
    "gaps": (lambda v: bars.find_gaps(v.bars_hour), f"{GAPS} select symbol, cast(epoch(gap_start) as bigint) as gap_start, cast(epoch(gap_end) as bigint) as gap_end, {r('open')}, {r('high')}, {r('low')}, {r('close')}, volume, trade_count, vwap from gaps"),
    "gap_report": (lambda v: bars.gap_report(v.bars_hour), f"{GAPS} select symbol, count(*) as gaps, cast(sum({POINTS}) as bigint) as points from gaps group by 1"),
    "forward_fill": (lambda v: bars.forward_fill(v.bars_hour), f"{FILLED} select {BAR}, original from filled"),
    "fill_ratio": (
        lambda v: bars.fill_ratio(bars.forward_fill(v.bars_hour)),
        f"{FILLED} select symbol, count(*) as total, count_if(original) as observed, count_if(not original) as filled, {r('count_if(original) * 100.0 / count(*)', 'observed_pct')}, {r('count_if(not original) * 100.0 / count(*)', 'filled_pct')} from filled group by 1",
    ),
    "append_new": (lambda v: ingest.append_new(_even(v), _shifted(v), ["symbol", T], ["close"]).select("symbol", T, "close"), f"{B} select symbol, {TS}, {r('close + case when hour(price_timestamp) % 2 = 0 then 0 else 1 end', 'close')} from bars_hour"),
    "upsert_overwrite": (lambda v: ingest.upsert_overwrite(v.bars_hour, _shifted(v).where(F.hour(T) % 3 == 0), ["symbol", T], ["close"]).select("symbol", T, "close"), f"{B} select symbol, {TS}, {r('close + case when hour(price_timestamp) % 3 = 0 then 1 else 0 end', 'close')} from bars_hour"),
    "load_report": (
        lambda v: ingest.load_report(_even(v), v.bars_hour.unionByName(_even(v)), ["symbol", T]),
        f"{B}, i as (select symbol, price_timestamp from bars_hour union all select symbol, price_timestamp from bars_hour where hour(price_timestamp) % 2 = 0) select symbol, count(*) as total, count(distinct case when hour(price_timestamp) % 2 = 1 then price_timestamp end) as new, count(*) - count(distinct case when hour(price_timestamp) % 2 = 1 then price_timestamp end) as duplicates from i group by 1",
    ),
    "quarantine": (
        lambda v: ingest.with_reasons(v.bars_hour.withColumn("volume", F.col("volume") - 60), ingest.bar_rules()).select("symbol", T, F.array_join("reasons", ";").alias("reasons")),
        f"{B} select symbol, {TS}, case when volume - 60 < 0 then 'volume >= 0' else '' end as reasons from bars_hour",
    ),
    "quarantine_analyses": (
        lambda v: ingest.with_reasons(v.industry_analyses.withColumns({"overall_sentiment": F.col("overall_sentiment") * 1.5, "confidence_score": F.when(F.col("id") % 7 > 0, F.col("confidence_score") * 2)}), ingest.analysis_rules()).select("id", F.array_join("reasons", ";").alias("reasons")),
        prefix("industry_analyses") + """ select id, concat_ws(';', case when abs(overall_sentiment * 1.5) > 1 then '-1 <= overall_sentiment <= 1' end, case when id % 7 > 0 and confidence_score * 2 > 1 then '0 <= confidence_score <= 1' end) as reasons from industry_analyses""",
    ),
    "missing_symbols": (
        lambda v: ingest.missing_symbols(v.companies, v.companies.where("days_old <= 30"), v.companies.where("days_old > 45")),
        prefix("companies") + " select symbol from companies where days_old > 30 and days_old <= 45",
    ),
    "all_symbols": (lambda v: ingest.all_symbols(v.bars_hour, v.articles, v.companies), prefix("bars_hour", "articles", "companies") + " select symbol from bars_hour union select symbol from articles union select symbol from companies"),
    "backfill_plan": (
        lambda v: ingest.backfill_plan(v.ticks.select("symbol").distinct(), _all_frames(v), F.lit(TODAY).cast("date")),
        f"""{B}, w as (select symbol, unnest(['day', 'hour', 'minute']) as timeframe from (select distinct symbol from bars_hour)),
        h as (select symbol, 'hour' as timeframe, cast(max(price_timestamp) as date) as newest, count(*) as n from bars_hour group by 1)
        select symbol, timeframe, coalesce(n, 0) as n_rows, cast(case when newest is null then date '{TODAY}' - 30 else newest - 1 end as varchar) as start, cast(case when newest is null then date '{TODAY}' + 1 else date '{TODAY}' end as varchar) as "end",
        coalesce(newest >= date '{TODAY}', false) as skip, date_diff('day', newest, date '{TODAY}') as days_behind from w left join h using (symbol, timeframe)""",
    ),
    "retention_report": (
        lambda v: ingest.retention_report(v.industry_analyses, 400, F.lit("2001-08-01").cast("timestamp")),
        prefix("industry_analyses") + " select count_if(created_at >= timestamp '2001-08-01' - interval 400 days) as kept, count_if(created_at < timestamp '2001-08-01' - interval 400 days) as dropped from industry_analyses",
    ),
    "retention": (
        lambda v: ingest.apply_retention(v.industry_analyses, 400, F.lit("2001-08-01").cast("timestamp")).select("id", "industry"),
        prefix("industry_analyses") + " select id, industry from industry_analyses where created_at >= timestamp '2001-08-01' - interval 400 days",
    ),
    "price_history": (lambda v: ingest.price_history(v.bars_hour, "30d", F.lit("2024-02-10").cast("timestamp")), f"{B} select symbol, {TS}, round(close, 2) as close from bars_hour where price_timestamp >= timestamp '2024-02-10' - interval 30 days"),
    "sma_bollinger": (
        lambda v: indicators.bollinger(indicators.averages(v.bars_hour)).select("symbol", T, "sma_10", "sma_20", "sma_50", *(F.col(f"BB{x}_20_2_0_2_0").alias(f"BB{x}") for x in "LMUBP")),
        f"""{B}, m as (select *, {_mean(10)} as sma_10, {_mean(20)} as sma_20, {_mean(50)} as sma_50, {_mean(20).replace("avg(", "stddev_pop(")} as s from bars_hour)
        select symbol, {TS}, {r("sma_10")}, {r("sma_20")}, {r("sma_50")}, {r("sma_20 - 2 * s", "BBL")}, {r("sma_20", "BBM")}, {r("sma_20 + 2 * s", "BBU")}, {r("100 * 4 * s / sma_20", "BBB")}, {r("(close - (sma_20 - 2 * s)) / nullif(4 * s, 0)", "BBP")} from m""",
    ),
    "stochastic": (
        lambda v: indicators.stochastic(v.bars_hour).select("symbol", T, "STOCHk_14_3_3", "STOCHd_14_3_3", "STOCHh_14_3_3"),
        f"""{B}, a as (select *, {_mean(14, "low").replace("avg(", "min(")} as l, {_mean(14, "high").replace("avg(", "max(")} as h from bars_hour), b as (select *, 100 * (close - l) / nullif(h - l, 0) as q from a),
        k as (select *, {_mean(3, "q")} as k from b), d as (select *, {_mean(3, "k")} as d from k)
        select symbol, {TS}, {r("k", "STOCHk_14_3_3")}, {r("d", "STOCHd_14_3_3")}, {r("k - d", "STOCHh_14_3_3")} from d""",
    ),
    "obv": (
        lambda v: indicators.obv(v.bars_hour).select("symbol", T, "obv"),
        f"{B}, d as (select *, coalesce(sign(close - lag(close) over ({W})), 1) * coalesce(volume, 0) as x from bars_hour) select symbol, {TS}, {r(f'sum(x) over ({W} rows unbounded preceding)', 'obv')} from d",
    ),
    "price_features": (
        lambda v: indicators.price_features(v.bars_hour).select("symbol", T, "price_change", "high_low_pct", "close_open_pct"),
        f"{B} select symbol, {TS}, {r(f'close / lag(close) over ({W}) - 1', 'price_change')}, {r('(high - low) / close', 'high_low_pct')}, {r('(close - open) / open', 'close_open_pct')} from bars_hour",
    ),
    "close_ratios": (
        lambda v: indicators.close_ratios(indicators.averages(v.bars_hour)).select("symbol", T, "close_sma20_ratio", "close_sma50_ratio"),
        f"{B}, m as (select *, {_mean(20)} as a, {_mean(50)} as b from bars_hour) select symbol, {TS}, {r('close / a', 'close_sma20_ratio')}, {r('close / b', 'close_sma50_ratio')} from m",
    ),
    "volume_features": (
        lambda v: indicators.volume_features(v.bars_hour).select("symbol", T, "volume_sma", "volume_ratio"),
        f"{B}, m as (select *, {_mean(20, 'volume')} as s from bars_hour) select symbol, {TS}, {r('s', 'volume_sma')}, {r('volume / nullif(s, 0)', 'volume_ratio')} from m",
    ),
    "ema": (
        lambda v: indicators.ewm(v.bars_hour, [indicators.Mean(f"ema_{n}", "close", n) for n in (10, 20, 50)], ["symbol"], T).select("symbol", T, "ema_10", "ema_20", "ema_50"),
        f"{B}, {ewm_sql('e10', 'bars_hour', 'close', 10)}, {ewm_sql('e20', 'bars_hour', 'close', 20)}, {ewm_sql('e50', 'bars_hour', 'close', 50)} select {KEYS}, {r('e10.y', 'ema_10')}, {r('e20.y', 'ema_20')}, {r('e50.y', 'ema_50')} {joined('e10', 'e20', 'e50')}",
    ),
    "macd": (
        lambda v: indicators.recursive_indicators(v.bars_hour).select("symbol", T, "MACD_12_26_9", "MACDs_12_26_9", "MACDh_12_26_9"),
        f"""{B}, {ewm_sql("e12", "bars_hour", "close", 12)}, {ewm_sql("e26", "bars_hour", "close", 26)}, mac as (select e12.symbol, e12.price_timestamp, e12.y - e26.y as m from e12 join e26 using (symbol, price_timestamp)), {ewm_sql("sg", "mac", "m", 9)}
        select {KEYS}, {r("mac.m", "MACD_12_26_9")}, {r("sg.y", "MACDs_12_26_9")}, {r("mac.m - sg.y", "MACDh_12_26_9")} {joined("mac", "sg")}""",
    ),
    "rsi": (
        lambda v: indicators.recursive_indicators(v.bars_hour).select("symbol", T, "rsi"),
        f"{B}, {CHANGES}, {ewm_sql('g', 'c', 'gain', 14, True)}, {ewm_sql('l', 'c', 'loss', 14, True)} select {KEYS}, {r('100 * g.y / nullif(g.y + l.y, 0)', 'rsi')} {joined('g', 'l')}",
    ),
    "atr": (lambda v: indicators.recursive_indicators(v.bars_hour).select("symbol", T, "atr"), f"{B}, {CHANGES}, {ewm_sql('a', 'c', 'tr', 14, True)} select {KEYS}, {r('a.y', 'atr')} {joined('a')}"),
    "adx": (
        lambda v: indicators.recursive_indicators(v.bars_hour).select("symbol", T, "ADX_14", "ADXR_14_2", "DMP_14", "DMN_14"),
        f"{ADX} select symbol, {TS}, {r('adx', 'ADX_14')}, {r(f'(adx + lag(adx, 2) over ({W})) / 2', 'ADXR_14_2')}, {r('p', 'DMP_14')}, {r('m', 'DMN_14')} from o",
    ),
    "indicators_all": (_indicator_frame, None),
    "market_conditions": (
        lambda v: indicators.market_conditions(_indicator_frame(v)),
        f"""{B}, {CHANGES}, {ewm_sql("g", "c", "gain", 14, True)}, {ewm_sql("l", "c", "loss", 14, True)}, x as (select b.*, {_mean(20).replace("partition by symbol", "partition by b.symbol").replace("order by price_timestamp", "order by b.price_timestamp")} as sma, {_mean(20, "volume").replace("partition by symbol", "partition by b.symbol").replace("order by price_timestamp", "order by b.price_timestamp")} as vs,
        coalesce(100 * g.y / nullif(g.y + l.y, 0), 50) as rsi, min(b.price_timestamp) over (partition by b.symbol) as a, count(*) over (partition by b.symbol) as n {joined("g", "l")})
        select symbol, case when close > sma then 'Uptrend' else 'Downtrend' end as trend, case when rsi < 30 then 'Oversold' when rsi > 70 then 'Overbought' else 'Neutral' end as rsi_label, case when volume > 1.5 * vs then 'High' else 'Normal' end as volume_label,
        cast(epoch(a) as bigint) as first_ts, cast(epoch(price_timestamp) as bigint) as last_ts, n as n_rows from x qualify row_number() over (partition by symbol order by price_timestamp desc) = 1""",
    ),
    "labels": (lambda v: features.add_labels(v.bars_hour).select("symbol", T, "future_close", "future_return", "target"), f"{LABELS} select symbol, {TS}, {r('future_close')}, {r('future_return')}, target from lab"),
    "label_distribution": (
        lambda v: features.label_distribution(features.add_labels(v.bars_hour), ["symbol"]),
        f"{LABELS} select symbol, target, count(*) as n, {r('count(*) * 100.0 / sum(count(*)) over (partition by symbol)', 'pct')} from lab group by 1, 2",
    ),
    "feature_matrix": (
        lambda v: features.feature_matrix(features.add_labels(indicators.averages(v.bars_hour)))[0].select("symbol", T, "sma_10", "sma_20", "sma_50", "target"),
        f"{LABELS}, m as (select *, {_mean(10)} as sma_10, {_mean(20)} as sma_20, {_mean(50)} as sma_50 from bars_hour) select symbol, cast(epoch(price_timestamp) as bigint) as price_timestamp, {r('sma_10')}, {r('sma_20')}, {r('sma_50')}, target from m join lab using (symbol, price_timestamp) where sma_50 is not null and m.vwap is not null",
    ),
    "kept_report": (
        lambda v: features.kept_report(indicators.averages(v.bars_hour), ["sma_50", "vwap"]),
        f"{B}, m as (select *, {_mean(50)} as sma_50 from bars_hour) select symbol, count_if(sma_50 is not null and vwap is not null) as kept, count_if(sma_50 is null or vwap is null) as dropped from m group by 1",
    ),
    "pipeline_report": (
        lambda v: features.pipeline_report(indicators.averages(v.bars_hour), ["sma_50", "vwap"]),
        f"""{LABELS}, m as (select *, {_mean(50)} as sma_50 from bars_hour), a as (select symbol, count(*) as loaded, min(price_timestamp) as t0, max(price_timestamp) as t1 from bars_hour group by 1),
        b as (select symbol, count(*) as labelled, count_if(target = -1) as sell, count_if(target = 0) as hold, count_if(target = 1) as buy from lab group by 1),
        c as (select lab.symbol, lab.price_timestamp as t, row_number() over (partition by lab.symbol order by lab.price_timestamp) <= floor(count(*) over (partition by lab.symbol) * 0.8::double) as is_train from lab join m using (symbol, price_timestamp) where sma_50 is not null and m.vwap is not null),
        d as (select symbol, count(*) as complete, count_if(is_train) as train, min(case when is_train then t end) as a0, max(case when is_train then t end) as a1, count_if(not is_train) as validation, min(case when not is_train then t end) as v0, max(case when not is_train then t end) as v1 from c group by 1)
        select symbol, loaded, cast(epoch(t0) as bigint) as first_ts, cast(epoch(t1) as bigint) as last_ts, coalesce(labelled, 0) as labelled, coalesce(sell, 0) as sell, coalesce(hold, 0) as hold, coalesce(buy, 0) as buy, coalesce(complete, 0) as complete, coalesce(train, 0) as train,
        cast(epoch(a0) as bigint) as train_start, cast(epoch(a1) as bigint) as train_end, coalesce(validation, 0) as validation, cast(epoch(v0) as bigint) as validation_start, cast(epoch(v1) as bigint) as validation_end from a left join b using (symbol) left join d using (symbol)""",
    ),
    "require_rows": (lambda v: features.require_rows(v.ticks, 1990).select("symbol", "event_id"), prefix("ticks") + " select symbol, event_id from ticks where symbol in (select symbol from ticks group by 1 having count(*) >= 1990)"),
    "temporal_split": (
        lambda v: features.temporal_split(v.bars_hour).select("symbol", T, "part"),
        f"{B} select symbol, {TS}, case when row_number() over ({W}) <= floor(count(*) over (partition by symbol) * 0.8::double) then 'train' else 'validation' end as part from bars_hour",
    ),
    "class_weights": (
        lambda v: features.class_weights(features.add_labels(v.bars_hour)),
        f"{LABELS} select target, count(*) as n, {r('sum(count(*)) over () / (count(*) over () * count(*))', 'weight')} from lab group by 1",
    ),
    "encode_symbol": (
        lambda v: features.encode_symbol(v.companies.select("symbol")),
        prefix("companies") + " select symbol, cast(concat('0x', substring(md5(symbol), 1, 8)) as bigint) % 1000 as symbol_encoded from companies",
    ),
    "training_table": (
        lambda v: features.training_table(v.bars_hour, 500, 1200).select("symbol", T, "close"),
        f"""{B}, z as (select symbol, count(*) as n_all, least(count(*), 500) as n from bars_hour group by 1), o as (select *, coalesce(sum(n) over (order by n_all desc, symbol rows between unbounded preceding and 1 preceding), 0) as before from z),
        k as (select *, row_number() over (partition by symbol order by price_timestamp desc) as rn from bars_hour) select symbol, {TS}, {r("close")} from k join o using (symbol) where rn <= 500 and before + rn <= 1200""",
    ),
    "prediction_features": (
        lambda v: features.prediction_features(indicators.averages(v.bars_hour), ["sma_10", "vwap", "unknown"]),
        f"""{B}, m as (select symbol, price_timestamp, {_mean(10)} as s, vwap from bars_hour), f as (select symbol, price_timestamp, last_value(s ignore nulls) over ({W} rows unbounded preceding) as sma_10, last_value(vwap ignore nulls) over ({W} rows unbounded preceding) as vwap from m)
        select symbol, {TS}, {r("sma_10")}, {r("vwap")}, 0.0 as unknown from f where sma_10 is not null and vwap is not null qualify row_number() over (partition by symbol order by price_timestamp desc) = 1""",
    ),
    "prediction_features_zero": (
        lambda v: features.prediction_features(indicators.averages(v.bars_hour.where(F.col(T) < F.lit("2024-01-01 09:00:00").cast("timestamp"))), ["sma_10", "vwap", "unknown"], fill_zero=True),
        f"""{B}, m as (select symbol, price_timestamp, {_mean(10)} as s, vwap from bars_hour where price_timestamp < timestamp '2024-01-01 09:00:00'), f as (select symbol, price_timestamp, last_value(s ignore nulls) over ({W} rows unbounded preceding) as sma_10, last_value(vwap ignore nulls) over ({W} rows unbounded preceding) as vwap from m)
        select symbol, {TS}, {r("coalesce(sma_10, 0)", "sma_10")}, {r("coalesce(vwap, 0)", "vwap")}, 0.0 as unknown from f qualify row_number() over (partition by symbol order by price_timestamp desc) = 1""",
    ),
    "positions": (lambda v: backtest.positions(signals(v), rows=None).select("symbol", T, "prediction", "position", "changed"), f"{SIGNALS} select symbol, {TS}, prediction, position, changed from pos"),
    "trades": (lambda v: backtest.trades(signals(v), rows=None), f"{SIGNALS} select symbol, {TS}, case when position > 0 then 'BUY' else 'SELL' end as side, {r('price')} from pos where changed"),
    "equity_curve": (lambda v: _curve(v).select("symbol", T, "equity"), f"{EQUITY} select symbol, {TS}, {r('equity')} from eq"),
    "risk_metrics": (
        lambda v: backtest.risk_metrics(_curve(v)),
        f"{RISK} select symbol, {RISK_ROUNDED} from rm",
    ),
    "compare_symbols": (
        lambda v: model.compare_symbols(backtest.risk_metrics(_curve(v))),
        f"{RISK} select {r('avg(total_return)', 'avg_return')}, {r('avg(buy_hold)', 'avg_buy_hold')}, {r('avg(accuracy)', 'avg_accuracy')}, count_if(total_return > buy_hold) as outperform, count(*) as symbols from rm",
    ),
    "signal_accuracy": (
        lambda v: model.accuracy(signals(v).withColumnRenamed("prediction", "predicted"), ["symbol"]),
        f"{SIGNALS} select symbol, {r('avg(case when prediction = target then 1.0 else 0.0 end)', 'accuracy')}, count(*) as n from sig group by 1",
    ),
    "prediction_distribution": (
        lambda v: features.label_distribution(signals(v), None, "prediction"),
        f"{SIGNALS} select prediction, count(*) as n, {r('count(*) * 100.0 / sum(count(*)) over ()', 'pct')} from sig group by 1",
    ),
    "consensus": (
        lambda v: backtest.consensus(_timeframes(v)),
        prefix("usage_logs") + "," + FRAMES + """, s as (select symbol, prediction, sum(confidence) as w from preds group by 1, 2),
        b as (select symbol, prediction as best, count(*) over (partition by symbol) as k from s qualify row_number() over (partition by symbol order by round(w, 9) desc, case prediction when 'Buy' then 2 when 'Hold' then 1 else 0 end desc) = 1),
        t as (select symbol, count(distinct timeframe) as timeframes from preds group by 1)
        select symbol, timeframes, case when timeframes >= 2 then best end as consensus, timeframes >= 2 and k = 1 as unanimous from b join t using (symbol)""",
    ),
    "batch_summary": (
        lambda v: backtest.batch_summary(_timeframes(v), backtest.risk_metrics(_curve(v))),
        f"""{RISK}, usage_logs as ({SQL["usage_logs"]}),{FRAMES}, x as (select count(*) as total, count_if(prediction is null) as failed, count_if(prediction = 'Buy') as buy, count_if(prediction = 'Hold') as hold, count_if(prediction = 'Sell') as sell, {r("avg(confidence)", "avg_confidence")}, count_if(confidence > 0.7) as confident from preds),
        y as (select {r("avg(sharpe)", "avg_sharpe")}, {r("avg(abs(max_drawdown))", "avg_drawdown")}, {r("avg(total_return)", "avg_return")} from rm) select * from x, y""",
    ),
    "prediction_documents": (
        _documents,
        f"{RISK}, z as (select symbol, max_by(prediction, price_timestamp) as prediction, 1.0::double as confidence from sig group by 1) select z.symbol, z.prediction, z.confidence, {RISK_ROUNDED} from z join rm on rm.symbol = z.symbol",
    ),
    "train_forest": (lambda v: _predict(v, "random_forest"), None),
    "train_boosted": (lambda v: _predict(v, "boosted"), None),
    "feature_importance": (_importance, None),
    "feature_values": (_feature_values, None),
    "saved_models": (_saved_models, None),
    "compare_rounds": (_rounds, None),
    "compare_sizes": (_sized, None),
    "stream_unique_bars": (lambda v: streamed.unique_bars(v), prefix("ticks") + " select symbol, cast(floor(epoch(ts)) as bigint) as price_timestamp from (select distinct symbol, ts from ticks)"),
    "stream_corrected_bars": (
        lambda v: streamed.corrected_bars(v).select(*BAR_COLS).withColumn("turnover", F.round(F.col("vwap") * F.col("volume"), 2)).drop("vwap"),
        f"{B} select {BAR.replace('round(vwap,6) as vwap', 'round(vwap * volume, 2) as turnover')} from bars_hour",  # a stream adds in another order: the sixth digit of a mean may differ
    ),
    "stream_preferred_quotes": (
        lambda v: streamed.preferred_quotes(v),
        prefix("ticks") + f""", l as (select symbol, event_id % 7 as priority, max_by(ts, (ts, price)) as ts, max_by(price, (ts, price)) as price from ticks group by 1, 2), n as (select symbol, max(ts) as newest from l group by 1)
        select symbol, cast(floor(epoch(ts)) as bigint) as ts, {r('price')}, priority from l join n using (symbol) where ts >= newest - interval 30 minutes qualify row_number() over (partition by symbol order by priority) = 1""",
    ),
    "stream_latest_quotes": (
        lambda v: streamed.latest_quotes(v),
        prefix("ticks") + f" select symbol, cast(floor(epoch(ts)) as bigint) as ts, {r('price')}, event_id as priority from ticks qualify row_number() over (partition by symbol order by ts desc, event_id) = 1",
    ),
    "stream_bars": (_stream_bars, f"{B} select symbol, {TS}, {r('open')}, {r('high')}, {r('low')}, {r('close')}, volume, trade_count from bars_hour"),
    "stream_bars_all": (_stream_bars, f"{B} select symbol, {TS}, {r('open')}, {r('high')}, {r('low')}, {r('close')}, volume, trade_count from bars_hour"),
}


def _indicators_sql() -> str:
    """All indicators side by side, each by its own SQL."""
    names = ("sma_bollinger", "stochastic", "obv", "price_features", "volume_features", "close_ratios", "ema", "macd", "rsi", "atr", "adx")
    renamed = ", ".join(f"BB{x} as BB{x}_20_2_0_2_0" for x in "LMUBP")
    parts = " ".join(f"join ({SOURCES[n][1]}) {n} using (symbol, price_timestamp)" for n in names)
    return f"select * exclude (BBL, BBM, BBU, BBB, BBP), {renamed} from ({B} select {BAR}, original from bars_hour) bars {parts}"


SOURCES["indicators_all"] = (_indicator_frame, _indicators_sql())


#: Rows of a chunk where long series are tried out; each series of the test tables has several.
FEW = 100


def _of(name: str, build) -> tuple:
    """What ``name`` selects, with its SQL, from bars that are worked on in chunks."""
    return build, SOURCES[name][1]


def _stored(v: Views) -> versioned.VersionedTable:
    """A stored table of the bars of even hours."""
    bars_of = v.bars_hour
    table = versioned.VersionedTable(v.spark, streamed.root(v, "table"), bars_of.schema, ["symbol", T], T, buckets=4)
    table.append(_even(v), ["close"])
    return table


def _stored_append(v: Views) -> DataFrame:
    """All bars with closes one higher, loaded twice into the stored table: the second time nothing is new."""
    table = _stored(v)
    table.append(_shifted(v), ["close"])
    table.append(_shifted(v), ["close"])
    return table.read().select("symbol", T, "close")


def _stored_upsert(v: Views) -> DataFrame:
    """Every third hour's bars with closes one higher in place of those that are stored."""
    table = _stored(v)
    table.append(v.bars_hour, ["close"])
    table.upsert(_shifted(v).where(F.hour(T) % 3 == 0), [F.desc("close")])
    return table.read().select("symbol", T, "close")


SOURCES |= {
    "append_stored": _of("append_new", _stored_append),
    "upsert_stored": _of("upsert_overwrite", _stored_upsert),
    "indicators_chunked": _of("indicators_all", lambda v: indicators.add_indicators(v.bars_hour, rows=FEW)),
    "obv_chunked": _of("obv", lambda v: indicators.obv(v.bars_hour, rows=FEW).select("symbol", T, "obv")),
    "gaps_chunked": _of("gaps", lambda v: bars.find_gaps(v.bars_hour, rows=FEW)),
    "forward_fill_chunked": _of("forward_fill", lambda v: bars.forward_fill(v.bars_hour, rows=FEW)),
    "labels_chunked": _of("labels", lambda v: features.add_labels(v.bars_hour, rows=FEW).select("symbol", T, "future_close", "future_return", "target")),
    "trades_chunked": _of("trades", lambda v: backtest.trades(signals(v, FEW), rows=None)),
    "equity_curve_chunked": _of("equity_curve", lambda v: _curve(v, FEW).select("symbol", T, "equity")),
    "risk_metrics_chunked": _of("risk_metrics", lambda v: backtest.risk_metrics(_curve(v, FEW))),
}


def flagship(v: Views) -> DataFrame:
    """Ticks to hourly bars, indicators of frames, labels, and their distribution by symbol."""
    df = chunked.cut(bars.prefer_original(bars.build_bars(v.ticks, tie=("event_id",))), before=indicators.BACK, after=5)
    df = indicators.bollinger(indicators.averages(df, rows=None), rows=None)
    df = indicators.volume_features(indicators.price_features(df, rows=None), rows=None)
    df = features.add_labels(indicators.close_ratios(df), rows=None)
    return plain(features.label_distribution(chunked.uncut(df), ["symbol"]))
