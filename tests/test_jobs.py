"""Market, news and usage jobs on hand-made rows, and registered queries against DuckDB."""

import random
import re
import sqlite3
from contextlib import closing
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.functions import chunks, phrases, sentiment, text
from tapeworks.operators import articles, backtest, bars, chunked, companies, dedup, features, indicators, model, recurrence, sketches, usage
from tapeworks.operators.recurrence import run_mean
from tapeworks.sources import database, files, ingest, versioned
from tapeworks.streaming import stateful, streams

BAR = "symbol string, price_timestamp timestamp, open double, high double, low double, close double, volume long, trade_count long, vwap double, original boolean"
START = datetime(2024, 1, 1)


def bar(symbol, hour, close, volume=10, original=True):
    return (symbol, START + timedelta(hours=hour), close, close + 1, close - 1, close, volume, 1, close, original)


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(1)
    rows, price = [], 100.0
    for i in range(120):
        price = max(5.0, price + rng.uniform(-3, 3))
        rows.append(bar("A", i, round(price, 2)))
    return rows, spark.createDataFrame(rows + [bar("B", 0, 50.0)], BAR)


def test_gaps_and_fill(spark):
    df = spark.createDataFrame([bar("A", 0, 10.0, None), bar("A", 4, 12.0), bar("A", 5.5, 13.0), bar("B", 0, 1.0)], BAR)
    report = {r["symbol"]: (r["gaps"], r["points"]) for r in bars.gap_report(df).collect()}
    assert report == {"A": (2, 3)}
    filled = bars.forward_fill(df)
    new = [(r["price_timestamp"], r["close"], r["volume"]) for r in filled.where("not original").orderBy("price_timestamp").collect()]
    assert new == [(START + timedelta(hours=h), 10.0, 0) for h in (1, 2, 3)]
    assert bars.forward_fill(filled).count() == filled.count() == 7
    assert bars.forward_fill(df.limit(0)).count() == 0


def test_prefer_original(spark):
    rows = [bar("A", i, 1.0) for i in range(100)] + [bar("A", 200, 1.0, 1, False)] + [bar("B", i, 1.0) for i in range(101)] + [bar("B", 200, 1.0, 1, False)]
    got = {r["symbol"]: r["count"] for r in bars.prefer_original(spark.createDataFrame(rows, BAR)).groupBy("symbol").count().collect()}
    assert got == {"A": 101, "B": 101}


def test_ingest(spark):
    target = spark.createDataFrame([bar("A", 0, 1.0)], BAR)
    incoming = spark.createDataFrame([bar("A", 0, 2.0), bar("A", 1, 3.0), bar("A", 1, 4.0), bar("A", 2, -1.0)], BAR)
    keys = ["symbol", "price_timestamp"]
    out = ingest.append_new(target, incoming, keys, ["close"]).orderBy("price_timestamp")
    assert [r["close"] for r in out.collect()] == [1.0, 3.0, -1.0]
    assert [r["close"] for r in ingest.upsert_overwrite(target, incoming, keys, ["close"]).orderBy("price_timestamp").collect()] == [2.0, 4.0, -1.0]
    r = ingest.load_report(target, incoming, keys).first()
    assert (r["total"], r["new"], r["duplicates"]) == (4, 2, 2)
    good, bad = ingest.quarantine(incoming, ingest.bar_rules())
    assert good.count() == 3 and "close > 0" in bad.first()["reasons"]
    prices = ingest.clean_price_table(spark.createDataFrame([("2024-01-02", "1,234.5"), ("bad", "1"), ("2024-01-01", "x")], "date string, close string"), ["close"])
    assert [r["close"] for r in prices.collect()] == [None, 1234.5]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("symbol,timestamp,open,high,low,close,volume,trade_count,vwap\nA,2024-01-01 00:00:00,1,2,0.5,1.5,,3,1.2\n")
    df = files.read_bars_csv(spark, str(tmp_path / "a.csv"), "day")
    assert df.first()["volume"] is None and df.first()["original"] and files.lacking_columns(spark.read.csv(str(tmp_path / "a.csv"), header=True)) == []
    assert files.rows_per_file(df).first()["n_rows"] == 1
    (tmp_path / "sentiment_analysis_XY_20250102_030405.json").write_text('{"total_articles": 1, "raw_articles": [{"title": "t", "url": "u"}], "source_breakdown": {"s": {"count": 1, "avg_sentiment": 0.5}}}')
    analyses, items = files.read_analysis_json(spark, str(tmp_path / "sentiment_analysis_*.json"))
    row = analyses.first()
    assert row["symbol"] == "XY" and row["analysis_timestamp"] == datetime(2025, 1, 2, 3, 4, 5) and items.first()["url"] == "u"
    files.write_analysis(analyses, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1
    got = files.bars_from_json(spark.createDataFrame([('[{"symbol":"A","price_timestamp":"2024-01-01T00:00:00Z","close":1.5}]',)], "j string"), "j").first()
    assert got["close"] == 1.5
    tables = {s: spark.createDataFrame([("u1",), ("u1",), ("u2",)], "url string") for s in "AB"}
    assert files.union_symbol_tables(tables).count() == 4


def test_recursive_indicators(walk):
    rows, df = walk
    close = [r[5] for r in rows]
    got = indicators.add_indicators(df).where("symbol = 'A'").orderBy("price_timestamp").collect()
    y = sum(close[:10]) / 10
    for i in range(10, len(close)):
        y = y + 2 / 11 * (close[i] - y)
    assert got[-1]["ema_10"] == pytest.approx(y) and got[8]["ema_10"] is None and got[9]["ema_10"] == pytest.approx(sum(close[:10]) / 10)
    gain = [max(b - a, 0) for a, b in zip(close, close[1:])]
    loss = [max(a - b, 0) for a, b in zip(close, close[1:])]
    g, s = sum(gain[:14]) / 14, sum(loss[:14]) / 14
    for x, z in zip(gain[14:], loss[14:]):
        g, s = (g * 13 + x) / 14, (s * 13 + z) / 14
    assert got[-1]["rsi"] == pytest.approx(100 * g / (g + s)) and got[13]["rsi"] is None and got[14]["rsi"] is not None
    assert got[18]["sma_20"] is None and got[19]["sma_20"] == pytest.approx(sum(close[:20]) / 20)
    assert all(0 <= r["ADX_14"] <= 100 for r in got if r["ADX_14"] is not None)
    whole, _ = run_mean(close, 5, 0.3, (0, 0.0))
    first, state = run_mean(close[:7], 5, 0.3, (0, 0.0))
    assert first + run_mean(close[7:], 5, 0.3, state)[0] == whole


def sequential_backtest(rows, cost=0.001):
    value, position, entry, curve, trades = 10_000.0, 0, None, [], 0
    for price, signal in rows:
        if signal and signal != position:
            if position == 1:
                value *= price / entry * (1 - cost)
            elif position == -1:
                value *= 1 - cost
            position, entry, trades = signal, price, trades + 1
        curve.append(value * (price / entry if position == 1 else entry / price if position == -1 else 1))
    return curve, trades


@pytest.mark.parametrize("signals", [[0] * 5, [-1, 1, 1, 0, -1, -1, 1], [1], [0, 1, -1, 0, 1]])
def test_backtest(spark, signals):
    rng = random.Random(len(signals))
    rows = [(rng.uniform(50, 150), s) for s in signals]
    df = spark.createDataFrame([("A", START + timedelta(hours=i), p, s, s) for i, (p, s) in enumerate(rows)], "symbol string, price_timestamp timestamp, price double, prediction int, target int")
    curve = backtest.equity_curve(df)
    want, trades = sequential_backtest(rows)
    assert [r["equity"] for r in curve.orderBy("price_timestamp").collect()] == pytest.approx(want)
    r = backtest.risk_metrics(curve).first()
    assert r["trades"] == trades and r["max_drawdown"] <= 0 and r["accuracy"] == 1 and r["final_value"] == pytest.approx(want[-1])
    if len(rows) == 1:
        assert r["sharpe"] == r["sortino"] == r["calmar"] == 0


def test_labels_and_split(walk):
    rows, df = walk
    lab = features.add_labels(df)
    assert lab.count() == len(rows) - 5
    weights = features.with_class_weights(lab).agg(F.sum("weight")).first()[0]
    assert weights == pytest.approx(len(rows) - 5)
    parts = {r["part"]: r["count"] for r in features.temporal_split(df.where("symbol = 'A'")).groupBy("part").count().collect()}
    assert parts == {"train": 96, "validation": 24}
    latest = features.prediction_features(indicators.averages(df), ["sma_50", "nothing"], fill_zero=True).where("symbol = 'B'").first()
    assert latest["sma_50"] == 0 and latest["nothing"] == 0


def test_consensus(spark):
    rows = [("A", "day", "Buy", 0.6), ("A", "hour", "Sell", 0.6), ("B", "day", "Buy", 0.9), ("C", "day", "Hold", 0.5), ("C", "hour", "Hold", 0.1)]
    got = {r["symbol"]: r["consensus"] for r in backtest.consensus(spark.createDataFrame(rows, "symbol string, timeframe string, prediction string, confidence double")).collect()}
    assert got == {"A": "Buy", "B": None, "C": "Hold"}


def test_text(spark):
    def one(expr, value):
        return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]

    assert one(text.clean_text, " a \n b&amp;lt; &nbsp;c ") == "a b<  c"
    assert one(text.title_of, "First. Second") == "First" and one(text.title_of, "x" * 150) == "x" * 100
    assert one(lambda c: text.clean_for_analysis(c, 10), "see https://x.y/z now  and then") == "see now an"
    assert one(text.strip_markup, "<b>a</b> [more]  b") == "a b"
    good = "This sentence has enough letters. " * 3
    assert one(text.is_legitimate, good) and not one(text.is_legitimate, "Short. Text.") and not one(text.is_legitimate, good + "click here sign up follow us advertisement")
    assert one(lambda c: text.is_paywalled(c, F.lit("https://x/login")), "free") and not one(lambda c: text.is_paywalled(c, F.lit("https://x/")), "free")
    assert one(lambda c: text.truncate_sentences(c, 20), "One two. Three four. Five six. Seven") == "One two...."
    assert one(text.parse_published, "2024-01-02T03:04:05Z") == datetime(2024, 1, 2, 3, 4, 5) and one(text.parse_published, "soon") is None
    assert one(text.decode_redirect_url, "https://news.google.com/articles/!!!") is None


def test_sentiment(spark):
    def one(expr, value):
        return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]

    for title, polarity in (("Stock falls", -0.7), ("Stock falls, then soars", 0.0), ("A comeback", 0.4), ("Nothing", 0.0), (None, 0.0)):
        got = [one(lambda c, i=i: sentiment.title_score(c)[i], title) for i in (0, 1)]
        assert got == pytest.approx([polarity, 0.9 * polarity])
    assert one(sentiment.lexicon_score, "A lawsuit and fraud") == pytest.approx(0.8 * -1.8)
    assert one(sentiment.boost_score, "up 5%") == pytest.approx(0.6)
    labels = spark.createDataFrame([(x,) for x in (0.05, -0.05, 0.06, 0.75, 0.76, -0.76)], "c double").select(sentiment.sentiment_label(F.col("c"))).collect()
    assert [r[0] for r in labels] == ["Neutral", "Neutral", "Positive", "Positive", "Very Positive", "Very Negative"]


def test_greedy_titles(spark):
    # a ~ b, b ~ c, a not ~ c: c stays, for b is gone
    words = [f"w{i}" for i in range(12)]
    a, b, c = " ".join(words), " ".join(words[1:] + ["x"]), " ".join(words[2:] + ["x", "y"])
    rows = [(1, "S", a, "u1"), (2, "S", b, "u2"), (3, "S", c, "u3"), (4, "S", a, "u4"), (5, "T", a, "u1"), (6, "S", "", "u1"), (7, "S", "", "")]
    df = spark.createDataFrame(rows, "id long, symbol string, title string, url string")
    kept = dedup.dedupe_similar_titles(df, "symbol", "id", F.col("title"))
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 5, 6, 7]
    kept = dedup.dedupe_url_or_title(df, "symbol", "id", "url", F.col("title"))
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 3, 5, 7]


def test_url_or_title_matches_a_loop(spark):
    rng = random.Random(5)
    rows = [(0, "S", "u0", "z"), (1, "S", "u0", "t"), (2, "S", "u2", "t"), (3, "S", "u3", "t"), (4, "S", "u4", "t")]
    rows += [(i, rng.choice(["A", "B", None]), rng.choice(["", None, *(f"u{k}" for k in range(20))]), rng.choice(["", *(f"T{k}" for k in range(20))])) for i in range(10, 200)]
    taken, kept = set(), []
    for i, group, url, title in rows:
        values = {(group, k, v) for k, v in (("u", url), ("t", title.lower())) if v}
        if not values & taken:
            kept.append(i)
            taken |= values
    df = spark.createDataFrame(rows, "id long, symbol string, url string, title string")
    got = dedup.dedupe_url_or_title(df, "symbol", "id", "url", F.col("title")).collect()
    assert sorted(r["id"] for r in got) == kept and 4 not in kept


def test_title_classes(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "j i h g f e d c b a"), (3, "a b c d e f g h i j k"), (4, "x y"), (5, "y x"), (6, ""), (7, "")]
    df = spark.createDataFrame([(i, "S", t) for i, t in rows], "id long, symbol string, t string")
    got = dedup.title_classes(df.withColumn("w", dedup.title_words(F.col("t"))), "symbol", "id", "w").collect()
    assert sorted(map(tuple, got)) == [(1, "S", 1, 1), (2, "S", 1, 1), (3, "S", 3, 1), (4, "S", 4, 0), (5, "S", 4, 0), (6, "S", 6, 0), (7, "S", 7, 0)]


def test_greedy_matches_a_loop(spark):
    rng = random.Random(7)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    kept = []
    for i in range(60):
        if not any((j, i) in set(edges) for j in kept):
            kept.append(i)
    gone = {r["b"] for r in dedup.greedy_drops(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert gone == set(range(60)) - set(kept)


def test_chunks():
    parts = chunks.chunks("One two three. Four five! " + "long " * 30, 40)
    assert all(len(p) <= 40 for p in parts) and parts[0] == "One two three. Four five" and chunks.chunks(None, 10) == []
    assert "Body text" in chunks.article_text("<nav>menu</nav><article>" + "<p>Body text that is long enough to count.</p>" * 4 + "</article><footer>f</footer>")
    assert chunks.article_text(None) == ""


def test_usage(spark):
    rows = [(i, 1, START + timedelta(minutes=m)) for i, m in enumerate((0, 30, 60, 61))]
    logs = spark.createDataFrame(rows, "log_id long, license_id long, request_timestamp timestamp")
    keys = spark.createDataFrame([(1, 1)], "license_id long, tier_id long")
    tiers = spark.createDataFrame([(1, "basic", 2, 3)], "tier_id long, tier_name string, max_calls_per_hour long, max_calls_per_day long")
    got = [(r["calls_hour"], r["calls_day"], r["verdict"]) for r in usage.rate_limit_audit(logs, keys, tiers).orderBy("log_id").collect()]
    assert got == [(0, 0, "ok"), (1, 1, "ok"), (1, 2, "ok"), (2, 3, "hour")]
    tries = spark.createDataFrame([("a", False)] * 9 + [("b", False)] * 10 + [("c", i == 0) for i in range(10)], "source string, success boolean")
    assert {r["source"]: r["disabled"] for r in usage.source_health(tries).collect()} == {"a": False, "b": True, "c": False}


def test_companies(spark):
    df = spark.createDataFrame([("A", d) for d in (14, 15, 30, 31)], "symbol string, days_old int")
    assert [r["status"] for r in companies.company_status(df).collect()] == ["FRESH", "AGING", "AGING", "NEEDS_UPDATE"]
    old = spark.createDataFrame([("A", "x", "y")], "symbol string, name string, industry string")
    new = spark.createDataFrame([("a", None, "z"), ("b", "n", None)], old.schema)
    assert sorted(map(tuple, companies.upsert_company(old, new).collect())) == [("A", "x", "z"), ("B", "n", None)]
    assert articles.match_symbols(spark.createDataFrame([(1, "the Acme group")], "article_id long, text string"), spark.createDataFrame([("AC", "acme")], "symbol string, common_name string")).count() == 1


def test_streams(spark, walk, tmp_path):
    _, df = walk
    ticks = df.select("symbol", F.col("price_timestamp").alias("ts"), F.col("close").alias("price"), F.col("volume").alias("size"))
    ticks.write.parquet(f"{tmp_path}/ticks")
    source = streams.read_stream(spark, f"{tmp_path}/ticks", ticks.schema)
    streams.drain(streams.stream_bars(source, "1 day"), f"{tmp_path}/bars", f"{tmp_path}/c1")
    got = {(r["symbol"], r["price_timestamp"]): r["close"] for r in spark.read.parquet(f"{tmp_path}/bars").collect()}
    want = {(r["symbol"], r["price_timestamp"]): r["close"] for r in bars.rollup_bars(df).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    write = streams.upsert_batches(f"{tmp_path}/sink", ["symbol", "ts"])
    write(ticks, 0)
    write(ticks, 0)
    assert spark.read.parquet(f"{tmp_path}/sink").count() == ticks.count()


def test_models(walk, spark, tmp_path):
    _, df = walk
    rows, names = features.feature_matrix(features.add_labels(indicators.averages(df, (10,))))
    fitted = model.train_model(rows, names, rounds=3, depth=3)
    pred = model.predict_batch(fitted, rows)
    assert pred.where("confidence > 1 or confidence < 0.3").count() == 0 and model.accuracy(pred).first()["accuracy"] > 0.3
    model.save_model(spark, fitted, {"timeframe": "hour", "model_type": "random_forest", "training_samples": rows.count()}, f"{tmp_path}/m1")
    assert model.model_summary(model.list_models(spark, str(tmp_path))).first()["models"] == 1
    assert model.predict_batch(model.load_model(f"{tmp_path}/m1"), rows).count() == rows.count()
    assert model.feature_importance(spark, fitted, names, 3).count() == 3


def test_whole_articles_are_enriched(spark, tmp_path):
    from tapeworks import plans

    long = "word " * 200
    spark.createDataFrame([(1, long, "s", 1000), (2, long, "s", 1000)], "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "http://h/1", f"<article><p>{'page ' * 300}</p></article>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["article_id"]: (r["n"], r["extraction_successful"]) for r in plans.queries()["enrich_articles_whole"](spark, str(tmp_path)).collect()}
    assert got[1][0] > 2000 and got[1][1] and got[2] == (len(long), False)


def test_stream_bars_have_every_hour(spark, tmp_path):
    from tapeworks import plans

    rows = [(i, "a", datetime(2024, 1, 29, 20) + timedelta(hours=i), float(i), '{"k": 3}') for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    assert plans.queries()["stream_bars_all"](spark, str(tmp_path)).count() == 40


def plain_mean(values, n, alpha):
    out, seen, y = [], [], None
    for x in values:
        if x is not None:
            seen.append(x)
            y = sum(seen) / n if len(seen) == n else (1 - alpha) * y + alpha * x if len(seen) > n else None
        out.append(y)
    return out


def test_means_with_nulls_and_series_in_pieces(spark):
    rng = random.Random(2)
    for n in (1, 3, 9):
        values = [None if rng.random() < 0.3 else rng.uniform(1, 9) for _ in range(60)]
        want = plain_mean(values, n, 0.2)
        for cut in (0, 1, 7, 60):
            first, state = run_mean(values[:cut], n, 0.2, (0, 0.0))
            got = first + run_mean(values[cut:], n, 0.2, state)[0]
            assert [y is None for y in got] == [y is None for y in want] and [y for y in got if y is not None] == pytest.approx([y for y in want if y is not None])
    series = {s: [rng.uniform(1, 9) if rng.random() > 0.2 else None for _ in range(50)] for s in ("A", "B", None)}
    df = spark.createDataFrame([(s, i, x) for s, xs in series.items() for i, x in enumerate(xs)], "s string, i int, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = recurrence.ewm(df, [recurrence.Mean("y", "x", 4)], ["s"], "i").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s, xs in series.items():
        mine = [r["y"] for r in sorted(got, key=lambda r: r["i"]) if r["s"] == s]
        want = plain_mean(xs, 4, 0.4)
        assert [y or 0 for y in mine] == pytest.approx([y or 0 for y in want])


@pytest.fixture(scope="module")
def uneven(spark):
    """Bars of three series: one long with gaps of many lengths and nulls, one short, one of a single row."""
    rng = random.Random(9)
    rows, t = [], 0
    for _ in range(1500):
        t += rng.choice([1, 1, 1, 2, 90])
        rows.append(("A", t, 100 + rng.gauss(0, 3), rng.randrange(1, 50) if rng.random() > 0.05 else None))
    rows += [("B", i, 50.0 + i % 7, i) for i in range(40)] + [("C", 5, 1.0, 1)]
    df = spark.createDataFrame(rows, "symbol string, i long, close double, volume long")
    df = df.withColumns({"price_timestamp": F.timestamp_seconds(F.col("i") * 60), "open": F.col("close") + 0.5, "high": F.col("close") + 1, "low": F.col("close") - 1 - F.col("i") % 3, "trade_count": F.lit(1), "vwap": F.col("close"), "original": F.lit(True)})
    return df.cache()


def same_rows(got, want, keys=("symbol", "price_timestamp")):
    got, want = ({tuple(r[k] for k in keys): r.asDict() for r in x.collect()} for x in (got, want))
    assert got.keys() == want.keys() and len(want) > 1
    for key, row in want.items():
        assert got[key].keys() == row.keys()
        for name, x in row.items():
            assert got[key][name] == (pytest.approx(x, abs=1e-9, rel=1e-9) if isinstance(x, float) else x), (key, name)


@pytest.mark.parametrize(("name", "rows"), [("add_indicators", 60), ("add_indicators", 300), ("recursive_indicators", 100)])
def test_indicators_by_chunks(uneven, name, rows):
    build = getattr(indicators, name)
    same_rows(build(uneven, rows=rows), build(uneven, rows=None))


@pytest.mark.parametrize("rows", [2, 100])
def test_labels_and_gaps_by_chunks(uneven, rows):
    same_rows(features.add_labels(uneven, rows=rows), features.add_labels(uneven, rows=None))
    same_rows(bars.find_gaps(uneven, 60, rows=rows), bars.find_gaps(uneven, 60, rows=None), ("symbol", "gap_start"))


def test_backtest_by_chunks(uneven):
    rows = 100
    for every in (1, 40):  # many signals, and chunks without one
        sign = F.when(F.col("i") % every == 0, F.signum(F.sin(F.col("i") * 1.7))).otherwise(0).cast("int")
        signals = uneven.select("symbol", "price_timestamp", F.col("close").alias("price"), sign.alias("prediction"), F.lit(1).alias("target"))
        cut = chunked.cut(signals, rows=rows)
        assert cut.where("symbol = 'A'").select(chunked.CHUNK).distinct().count() > 3
        same_rows(backtest.equity_curve(signals, rows=rows), backtest.equity_curve(signals, rows=None))
        same_rows(backtest.positions(signals, rows=rows), backtest.positions(signals, rows=None))
        same_rows(backtest.risk_metrics(backtest.equity_curve(cut)), backtest.risk_metrics(backtest.equity_curve(signals, rows=None)), ("symbol",))


def test_chunks_and_their_halo(uneven):
    cut = chunked.cut(uneven, before=20, after=7, rows=100)
    of_a = {c: sorted(((r["i"], r[chunked.HALO]) for r in rows)) for c in range(40) if (rows := cut.where((F.col("symbol") == "A") & (F.col(chunked.CHUNK) == c)).collect())}
    times = sorted(r["i"] for r in uneven.where("symbol = 'A'").collect())
    assert sorted(i for rows in of_a.values() for i, halo in rows if not halo) == times
    assert max(sum(not halo for _, halo in rows) for rows in of_a.values()) < 200 and len(of_a) > 7  # no task has a series
    for rows in of_a.values():
        own = [i for i, halo in rows if not halo]
        first, last = times.index(own[0]), times.index(own[-1])
        got = [i for i, _ in rows]
        assert got == times[times.index(got[0]) : times.index(got[-1]) + 1]  # no holes
        assert got[0] <= times[max(first - 20, 0)] and got[-1] >= times[min(last + 7, len(times) - 1)]
    assert chunked.cut(uneven, rows=10_000) is uneven


def test_chunked_windows_are_partitioned_by_chunk(uneven):
    cut = chunked.cut(uneven, before=indicators.BACK, rows=100)
    k = chunked.chunk_keys(cut, ["symbol"])
    plan = indicators.stochastic(indicators.bollinger(indicators.averages(cut, rows=None), rows=None), rows=None)._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"Window \[.*\], \[([^\[\]]*)\], \[price_timestamp", plan)
    assert windows and all("__chunk" in w for w in windows) and k == ["symbol", chunked.CHUNK]


def test_summaries_compose():
    rng = random.Random(8)
    for n in (1, 3, 20):
        values = [None if rng.random() < 0.2 else rng.uniform(-5, 5) for _ in range(120)]
        state = whole = (0, 0.0)
        at = 0
        while at < len(values):
            part = values[at : at + rng.randrange(1, 25)]
            summary = recurrence._summary(recurrence.np.array(part, float), n, 0.3)
            state = recurrence._composed(summary, n, 0.3, state)
            whole = run_mean(part, n, 0.3, whole)[1]
            assert state[0] == whole[0] and state[1] == pytest.approx(whole[1], abs=1e-12)
            at += len(part)


def test_long_chains_take_few_jobs(spark):
    """10,000 links one after another: every second row goes, in a number of jobs that grows with the logarithm."""
    n = 10_000
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "")
    try:
        gone = {r["b"] for r in dedup.greedy_drops(edges).collect()}
        jobs = len(tracker.getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert gone == set(range(1, n + 1, 2)) and jobs < 400


def test_components_beyond_a_task_are_resolved_in_rounds(spark):
    rng = random.Random(14)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(80)})
    df = spark.createDataFrame(edges, "a long, b long")
    want = {r["b"] for r in dedup.greedy_drops(df).collect()}
    assert {r["b"] for r in dedup.greedy_drops(df, most=3).collect()} == want
    rows = [("s", i, f"u{rng.randrange(20)}", f"t{rng.randrange(20)}") for i in range(60)]
    table = spark.createDataFrame(rows, "g string, id long, url string, title string")
    keep = lambda **how: {r["id"] for r in dedup.dedupe_url_or_title(table, "g", "id", "url", F.col("title"), **how).collect()}
    assert keep(most=2) == keep()
    assert dedup.greedy_drops(df.limit(0)).collect() == []


@pytest.fixture
def table(spark, tmp_path):
    schema = spark.createDataFrame([], "symbol string, ts timestamp, close double").schema
    return versioned.VersionedTable(spark, f"file://{tmp_path}/bars", schema, ["symbol", "ts"], "ts", buckets=3)


def hours(spark, first, last, add=0.0, symbols="ab"):
    rows = [(s, START + timedelta(hours=h), h + add) for h in range(first, last) for s in symbols]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, close double")


def stored(table, **how):
    return sorted((r["symbol"], r["ts"], r["close"]) for r in table.read(**how).collect())


def test_stored_table(spark, table):
    assert table.version() == 0 and stored(table) == []
    assert table.append(hours(spark, 0, 50), ["close"]) == 1
    assert table.append(hours(spark, 0, 50, 0.5), ["close"]) == 1  # a repeated batch changes nothing
    odd = hours(spark, 40, 60, 0.25).union(hours(spark, 40, 60, 0.125)).union(spark.createDataFrame([(None, START, 1.0), ("a", None, 1.0)], "symbol string, ts timestamp, close double"))
    assert table.append(odd, ["close"], "load") == 2 and table.append(hours(spark, 90, 91), ["close"], "load") == 2
    want = {(r["symbol"], r["ts"]): r["close"] for r in hours(spark, 0, 50).union(hours(spark, 50, 60, 0.125)).collect()}
    assert stored(table) == sorted((*k, v) for k, v in want.items())
    before = table.manifest()["parts"]
    assert table.upsert(hours(spark, 45, 47, 100.0, "b"), ["close"]) == 3
    want |= {(r["symbol"], r["ts"]): r["close"] for r in hours(spark, 45, 47, 100.0, "b").collect()}
    assert stored(table) == sorted((*k, v) for k, v in want.items()) and len(stored(table, version=1)) == 100
    after = table.manifest()["parts"]
    assert sum(before[d] != after[d] for d in before) == 1  # other days are not written
    assert table.expire(1, str(START + timedelta(hours=54))) == 60 and table.expire(1, str(START + timedelta(hours=54))) == 0
    assert min(t for _, t, _ in stored(table)) == START + timedelta(hours=30)


def test_loads_do_not_move_what_is_stored(spark, table):
    table.append(hours(spark, 0, 200), ["close"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with versioned._joined_by_bucket(spark):
            plan = table.missing(hours(spark, 150, 160), ["close"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above, scan = plan.rsplit("FileScan parquet", 1)
    assert "Bucketed: true" in scan
    assert "Exchange" not in above.rsplit("+- Sort", 1)[1] and plan.count("Exchange") == 1  # the batch moves, once
    _, days = table._prepared(hours(spark, 150, 160), ["close"])
    files = table._table(table.manifest()["parts"], days).inputFiles()
    assert len(days) == 1 and files and all(f"__day={days[0]}" in f for f in files)  # days of the batch only


def test_two_loads_of_one_version(spark, table):
    """Of two loads that began at the same version the later fails and leaves nothing that is read."""
    table.append(hours(spark, 0, 5), ["close"])
    with pytest.raises(Exception, match="exist"):
        table._publish(1, {"parts": {}, "batches": []})
    assert len(stored(table)) == 10


def test_stream_into_a_stored_table(spark, table):
    write = table.sink(["close"], "quotes")
    write(hours(spark, 0, 5), 0)
    write(hours(spark, 3, 8), 1)
    write(hours(spark, 100, 101), 1)  # the same batch again
    assert len(stored(table)) == 16


def test_late_ticks_correct_bars(spark, tmp_path):
    """Ticks in files out of order, several batches: the last word on each bar is the batch's bar."""
    rng = random.Random(3)
    rows = [(rng.choice("AB"), START + timedelta(seconds=rng.randrange(4 * 3600)), float(rng.randrange(50, 60)), rng.randrange(3), i) for i in range(400)]
    schema = "symbol string, ts timestamp, price double, size long, event_id long"
    for i in range(4):
        spark.createDataFrame(rows[i::4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ticks")
    stateful.run_stateful(stateful.corrected_bars(source, late="1 day", tie="event_id"), f"{tmp_path}/out", f"{tmp_path}/check")
    given = spark.read.parquet(f"{tmp_path}/out")
    got = streams.latest_updates(spark, f"{tmp_path}/out", ["symbol", "price_timestamp"])
    want = bars.build_bars(spark.createDataFrame(rows, schema), tie=("event_id",)).drop("original")
    same_rows(got, want)
    assert given.count() > want.count() and given.select("batch").distinct().count() == 4  # bars were given out and corrected


def test_usage_keeps_a_bucket_a_call(spark, tmp_path):
    """Sliding windows over several batches, one with late calls: the state has a row for each bucket, not for each window."""
    rng = random.Random(8)
    calls = [(k, START + timedelta(seconds=rng.randrange(i * 1800, i * 1800 + 5400))) for i in range(3) for k in (1, 1, 2, None) for _ in range(30)]
    schema = "license_id long, request_timestamp timestamp"
    for i in range(3):
        spark.createDataFrame(calls[i * 120 : i * 120 + 120], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/logs")
    for span, slide, width in (("1 hour", "5 minutes", 300), ("10 minutes", "4 minutes", 120)):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/logs")
        folder = f"{tmp_path}/{width}"
        stateful.run_stateful(streams.stream_usage(source, span=span, slide=slide, late="2 hours"), f"{folder}/out", f"{folder}/check")
        rows = spark.read.parquet(f"{folder}/out")
        assert rows.drop("calls", "batch").distinct().count() == len({(k, (at - START) // timedelta(seconds=width)) for k, at in calls})
        want = spark.createDataFrame(calls, schema).groupBy("license_id", F.window("request_timestamp", span, slide).alias("w")).agg(F.count(F.lit(1)).alias("calls"))
        got, want = (sorted(map(repr, df.select("license_id", "w.start", "w.end", "calls").collect())) for df in (streams.sliding_usage(rows, span, slide), want))
        assert got == want


def test_silent_sources_give_way(spark, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    files = [
        [("A", at(0), 10.0, 1), ("A", at(1), 11.0, 2), ("B", at(0), 5.0, 2)],
        [("A", at(4), 12.0, 2), ("B", at(1), 6.0, 1)],  # source 1 of A spoke 4 minutes ago
        [("A", at(9), 13.0, 2)],  # now it has been silent too long
        [("A", at(3), 14.0, 1), ("A", at(10), 15.0, 3)],  # a late quote is no sign of life
    ]
    for rows in files:
        spark.createDataFrame(rows, "symbol string, ts timestamp, price double, priority long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/quotes")
    schema = spark.read.parquet(f"{tmp_path}/quotes").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/quotes")
    stateful.run_stateful(stateful.stream_preferred_quotes(source), f"{tmp_path}/out", f"{tmp_path}/check")
    words = {(r["symbol"], r["batch"]): (r["price"], r["priority"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert words == {("A", 0): (10.0, 1), ("B", 0): (5.0, 2), ("A", 1): (10.0, 1), ("B", 1): (6.0, 1), ("A", 2): (13.0, 2), ("A", 3): (13.0, 2)}
    got = sorted(map(tuple, streams.latest_updates(spark, f"{tmp_path}/out", ["symbol"]).collect()))
    assert got == sorted(map(tuple, stateful.preferred_quotes(spark.read.parquet(f"{tmp_path}/quotes")).collect()))


def test_only_last_quotes_reach_a_symbol(spark, tmp_path):
    """Of many quotes, ties among them, a symbol's task reads those that a batch of input ends with, and nothing changes."""
    rng = random.Random(9)
    rows = [("A" if i % 9 else "B", START + timedelta(seconds=rng.randrange(600)), float(rng.randrange(90)), rng.randrange(7)) for i in range(6000)]
    schema = "symbol string, ts timestamp, price double, priority long"
    for i in range(2):
        spark.createDataFrame(rows[i::2], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/quotes")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/quotes")
    stream = stateful.stream_preferred_quotes(source, silence="20 seconds")
    stateful.run_stateful(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert plan.index("TransformWithState") < plan.index("MapInArrow")
    got = sorted(map(tuple, streams.latest_updates(spark, f"{tmp_path}/out", ["symbol"]).collect()))
    assert got == sorted(map(tuple, stateful.preferred_quotes(spark.read.parquet(f"{tmp_path}/quotes"), "20 seconds").collect()))


def test_database_round_trip(spark, tmp_path):
    """Rows of all kinds into a local database and back in ranges; filters reach it; a failed job leaves nothing."""
    path = f"{tmp_path}/bars.db"
    with closing(sqlite3.connect(path)) as db:
        db.execute("create table bars (id integer, symbol text, ts text, close real, original integer)")
        db.commit()
    schema = "id long, symbol string, ts timestamp, close double, original boolean"
    rows = [(None if i % 50 == 7 else i, "AB"[i % 2], None if i % 9 == 0 else START + timedelta(minutes=i), i / 4, i % 3 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, schema).repartition(4)
    how = {"dsn": path, "table": "bars"}
    database.write_database(df, **how)
    ranged = database.read_database(spark, schema, column="id", low=0, high=200, parts=3, **how)
    assert ranged.rdd.getNumPartitions() == 4  # three ranges and the rows without an id
    assert sorted(map(tuple, ranged.collect()), key=repr) == sorted(rows, key=repr)
    picked = ranged.where("symbol = 'A' and id >= 100 and close < 40 and ts is not null")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, picked.collect()), key=repr) == sorted((r for r in rows if r[1] == "A" and r[0] and r[0] >= 100 and r[3] < 40 and r[2]), key=repr)
    assert "Filter" not in plan.split("BatchScan")[0]  # nothing is left for Spark to filter
    bad = df.withColumn("close", F.when(F.col("id") == 150, F.raise_error(F.lit("bad row")).cast("double")).otherwise(F.col("close")))
    with pytest.raises(Exception, match="bad row"):
        database.write_database(bad, **how)
    assert database.read_database(spark, schema, **how).count() == 200
    database.write_database(df.limit(3), mode="overwrite", **how)
    assert database.read_database(spark, schema, **how).count() == 3
    database.write_database(df.limit(0), **how)
    assert database.read_database(spark, schema, **how).count() == 3


def test_sketches_merge(spark):
    """Days loaded at different times come to what one load gives, and estimates are near the exact counts."""
    rows = spark.range(60_000).select((F.col("id") % 2).alias("tier"), (F.col("id") * 7919 % 20_011).alias("user"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 20 * 86400).alias("ts"))
    last = F.lit("2024-01-20").cast("date")
    whole = sketches.daily_sketches(rows, ["tier"], "ts", ["user"])
    parts = sketches.add_days(sketches.daily_sketches(rows.where("user % 3 > 0"), ["tier"], "ts", ["user"]), sketches.daily_sketches(rows.where("user % 3 = 0"), ["tier"], "ts", ["user"]), ["tier"])
    assert parts.count() == whole.count() == 20
    for days in (1, 7, 30):
        within = rows.where((F.to_date("ts") <= last) & (F.to_date("ts") > F.date_sub(last, days)))
        exact = {r["tier"]: (r["n"], r["u"]) for r in within.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user").alias("u")).collect()}
        for daily in (whole, parts):
            got = {r["tier"]: (r["n"], r["user"]) for r in sketches.over_days(daily, ["tier"], days, last).collect()}
            assert got.keys() == exact.keys()
            assert all(got[t][0] == n and abs(got[t][1] - u) <= 0.02 * u for t, (n, u) in exact.items())
    nothing = sketches.daily_sketches(rows.limit(0), ["tier"], "ts", ["user"])
    assert sketches.over_days(nothing, ["tier"], 7, last).collect() == []


def test_calls_before_against_a_loop(spark):
    """Ties, calls exactly a span apart, hot keys and a null key; other spans and buckets."""
    rng = random.Random(6)
    calls = [(rng.choice([1, 1, 1, 1, 2, None]), rng.choice([0, 1, 59, 60, 61, 600]) * 7 + rng.randrange(0, 900, 5)) for _ in range(400)]
    logs = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(calls)], "log_id int, license_id int, t long")
    spans = {"short": 120, "long": 600}
    got = {r["log_id"]: r for r in usage.calls_before(logs, spans, bucket=30).collect()}
    assert len(got) == len(calls)
    for i, (k, t) in enumerate(calls):
        for name, span in spans.items():
            assert got[i][name] == sum(k2 == k and t - span < t2 < t for k2, t2 in calls), (i, name)
    plan = usage.calls_before(logs, spans, bucket=30)._jdf.queryExecution().optimizedPlan().toString()
    assert all("bucket#" in part or "to#" in part for part in re.findall(r"Window \[[^\n]*", plan))


def test_articles_are_routed(spark):
    main = lambda c: F.lit(0.9)
    long = "Plain words here. " * 30
    rows = [(1, "Stock falls. More"), (2, "Nothing said. More"), (3, "Stock falls. " + long), (4, "Sign in to access. Stock falls. " + long), (5, None)]
    df = spark.createDataFrame(rows, "i long, text string")
    got = {r["i"]: (r["polarity"], round(r["compound"], 9), r["scored_by"]) for r in articles.score_articles(df, main).collect()}
    assert got == {1: (-0.7, -0.63, "title"), 2: (0.9, 0.9, "main"), 3: (0.9, 0.9, "main"), 4: (-0.7, -0.63, "title"), 5: (0.9, 0.9, "main")}
    both = articles.score_articles(df, lambda c: (F.lit(0.5), F.lit(0.25))).where("i = 3").first()
    assert (both["polarity"], both["compound"]) == (0.5, 0.25)


def test_long_texts(spark):
    df = spark.createDataFrame([(1, "Shares surge. " * 120), (2, ""), (3, None)], "i long, text string")
    got = {r["i"]: r for r in chunks.score_long(df, "i", "text", lambda c: F.lit(0.5), 1000).collect()}
    assert got[1]["n_chunks"] > 1 and got[1]["polarity"] == pytest.approx(0.5 + 0.3 * 0.4) and got[1]["compound"] == pytest.approx(0.5 + 0.2 * 0.4)
    assert got[2]["score"] is None and got[2]["polarity"] == got[3]["compound"] == 0.0


def widest_batch(spark, step):
    """Characters of the largest batch that ``step`` (a column of a column) gets, by a probe that shares its batches."""

    @F.pandas_udf("long")
    def probe(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("many words "), 18_000).alias("t"))
    got = df.select(step(F.col("t")).alias("a"), probe(F.col("t")).alias("b"))
    return got.agg(F.max("b"), F.count(F.col("a").cast("string"))).first()[0]


def test_pages_come_in_batches_of_bounded_bytes(spark):
    assert widest_batch(spark, chunks.extract_article) < 6 << 20


def test_texts_come_in_batches_of_bounded_bytes(spark):
    assert widest_batch(spark, lambda c: chunks.chunk_text(c, 1000)) < 6 << 20
    assert widest_batch(spark, lambda c: phrases.phrases_met(c, ("words", "none"))) < 6 << 20


def test_a_model_gets_batches_of_bounded_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("many words "), 18_000).alias("text"))
    got = chunks.score_with(df, lambda: lambda texts: [("all", float(sum(map(len, texts))))] * len(texts))
    assert got.agg(F.max("score")).first()[0] < 6 << 20 and got.count() == 60


def test_extraction_falls_back():
    p = lambda text, n: f"<p>{text * n}</p>"
    side = "<div class='sidebar'>" + p("Side matter. ", 60) * 9 + "</div>"
    assert chunks.article_text(f"<body>{side}<article>{p('Main words of it. ', 9) * 4}</article></body>").count("Main") == 36
    assert "Side" not in chunks.article_text(f"<body>{side}<div class='content'>{p('Main words of it. ', 9) * 4}</div></body>")
    body = '<script type="application/ld+json">{"@type": "NewsArticle", "articleBody": "' + "Body from data. " * 20 + '"}</script>'
    assert chunks.article_text(f"<head>{body}</head><body><p>Short</p></body>").startswith("Body from data.")
    other = '<script type="application/ld+json">[{"@type": "Article", "description": "' + "Told shortly. " * 9 + '"}]</script><script type="application/ld+json">broken</script>'
    assert chunks.article_text(other).startswith("Told shortly.")
    assert chunks.article_text("<div><main><p>A few words</p></main><p>Others</p></div>") == "A few words"
    assert chunks.article_text("<p>One</p><p>Two</p>") == "One Two"
    assert chunks.article_text("<p>" + "</p><p>".join(["We use a cookie for this and for that and more"] + ["Good paragraph of more than forty characters"] * 3)).count("Good") == 3


def test_more_rules_and_reports(spark, tmp_path):
    rows = [("S", "t", "h", 1.0, -1.0), ("S", None, "h", 1.1, None)]
    bad = ingest.with_reasons(spark.createDataFrame(rows, "symbol string, title string, url_hash string, polarity double, compound double"), ingest.article_rules()).collect()
    assert [r["reasons"] for r in bad] == [[], ["-1 <= polarity <= 1", "title"]]
    tables = {s: spark.createDataFrame([("u1", 2), ("u1", 1), ("u2", 3)], "url string, n long") for s in "AB"}
    assert sorted((r["symbol"], r["url"], r["n"]) for r in files.union_symbol_tables(tables).collect()) == [(s, u, n) for s in "AB" for u, n in (("u1", 1), ("u2", 3))]
    assert [tuple(r) for r in files.union_report(tables).orderBy("symbol").collect()] == [("A", 3, 2, 1), ("B", 3, 2, 1)]
    df = spark.createDataFrame([bar(s, h, 1.0) for s in "AB" for h in range(5)], BAR).withColumn("timeframe", F.lit("hour"))
    assert [(r["symbol"], r["price_timestamp"].hour) for r in bars.load_bars(df, ["B"], "hour", 2).collect()] == [("B", 3), ("B", 4)]
    assert bars.load_bars(df, timeframe="day").count() == 0
    write = streams.upsert_batches(f"{tmp_path}/sink", ["symbol", "price_timestamp"], "price_timestamp")
    for hours in ((0, 3), (2, 5), (2, 5)):
        write(df.where(F.hour("price_timestamp").between(*hours)), 0)
    assert spark.read.parquet(f"{tmp_path}/sink").count() == 10
    keep = streams.keep_updates(f"{tmp_path}/states")
    for number, value in ((0, 1), (1, 2), (1, 3)):
        keep(spark.createDataFrame([("A", value)], "symbol string, v long"), number)
    assert [tuple(r) for r in streams.latest_updates(spark, f"{tmp_path}/states", ["symbol"]).collect()] == [("A", 3)]


def test_lsh_finds_the_exact_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    titles = [rng.sample(words, 12) for _ in range(60)]
    titles += [t[:11] + ["x"] for t in titles[:30]] + [t[1:] for t in titles[10:20]]
    df = spark.createDataFrame([(i, "ST"[i % 2], t) for i, t in enumerate(titles)] + [(200, "S", [])], "i long, g string, w array<string>")
    exact, near = (sorted(map(tuple, f(df, "g", "i", "w").collect())) for f in (dedup.similar_pairs, dedup.similar_pairs_lsh))
    assert exact == near and len(exact) > 10


def test_frequent_words_make_no_lsh_candidates(spark):
    """Sets that share three frequent words of twelve: tables of one hash let nearly all pairs meet."""
    rng = random.Random(5)
    titles = [["the", "of", "a", *(f"w{rng.randrange(10**6)}" for _ in range(9))] for _ in range(600)]
    near = [t[:-1] + ["x"] for t in titles[:20]] + [t[:-1] for t in titles[20:40]]
    df = spark.createDataFrame([(i, "S", t) for i, t in enumerate(titles + near)], "i long, g string, w array<string>")
    met = dedup.lsh_candidates(df.select("g", "w", F.col("i").alias("first")), "g").count()
    assert met < 640 * 639 / 2 * 0.05
    exact, got = (sorted(map(tuple, f(df, "g", "i", "w").collect())) for f in (dedup.similar_pairs, dedup.similar_pairs_lsh))
    assert exact == got and len(got) == 40


def test_sizes_are_compared(walk):
    _, df = walk

    def prepare(rows):
        return features.feature_matrix(features.add_labels(indicators.averages(rows, (10,))))

    got = model.compare_sizes(df, prepare, (60, None), "random_forest", rounds=3, depth=3).collect()
    assert sorted(r["size"] or 0 for r in got) == [0, 60] and sum(r["best"] for r in got) == 1
    assert max(got, key=lambda r: r["strategy_return"])["best"]


def test_sizes_read_the_bars_once(spark):
    """What each size is prepared from is stored, not worked out again from the ticks."""
    seen = []

    def prepare(rows):
        seen.append(rows._jdf.queryExecution().analyzed().toString())
        raise ZeroDivisionError

    with pytest.raises(ZeroDivisionError):
        model.compare_sizes(spark.range(9).selectExpr("'A' as symbol", "timestamp_seconds(id) as price_timestamp"), prepare, (None,))
    assert "LogicalRDD" in seen[0] and "Range" not in seen[0]


def test_models_of_timeframes_and_rounds(walk, spark):
    _, df = walk
    rows, names = features.feature_matrix(features.add_labels(indicators.averages(df, (10,))))
    frames = rows.withColumn("timeframe", F.when(F.minute("price_timestamp") == 0, "hour"))
    got = {t: (m is not None, error) for t, m, error in model.train_all_timeframes(frames, names, ["hour", "day"], rounds=2, depth=2)}
    assert got["hour"] == (True, "") and not got["day"][0] and got["day"][1]
    two = rows.where("target <> 0")
    compared = model.compare_rounds(two, two, names, (2, 1), depth=2).collect()
    assert [r["rounds"] for r in compared] == [2, 1] and all(0.4 < r["accuracy"] <= 1 and r["n"] == two.count() for r in compared)


def test_a_model_is_loaded_once_a_worker(spark):
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda texts: [("positive" if "good" in t else "neutral", float(len(t))) for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["good", "", None] * 20)], "i long, text string").coalesce(1)
    got = {r["i"]: (r["label"], r["score"]) for r in chunks.score_with(df, load).collect()}
    assert got[0] == ("positive", 4.0) and got[1] == got[2] == ("neutral", 0.0) and loads.value == 1


def plain_chunks(text, most):
    """Sentences added word by word to what is held, and given out when the next does not fit."""
    out, held = [], ""
    for sentence in (x.strip() for x in re.split("[.!?]+", text)):
        if not sentence:
            continue
        if held and len(held) + 2 + len(sentence) > most:
            out, held = [*out, held], ""
        if len(sentence) <= most:
            held = f"{held}. {sentence}" if held else sentence
            continue
        for word in sentence.split():
            if held and len(held) + 1 + len(word) > most:
                out, held = [*out, held], ""
            held = f"{held} {word}" if held else word
        out, held = [*out, held], ""
    return [*out, held] if held else out


def test_chunks_of_random_texts():
    rng = random.Random(12)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bb", "ccc ccc", " ", " ", ". ", "! ", "dddddddddd "]) for _ in range(rng.randrange(60)))
        assert chunks.chunks(text, 20) == plain_chunks(text, 20), text


def test_passages(spark):
    page = "<body><p>Acme stock rose a lot on Monday, said ABC people</p><p>ABC stock</p><p>acme share prices were not named this way</p><p>Earnings of Bolt and others were out in the long morning</p></body>"
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    firms = spark.createDataFrame([("ABC", "Acme Group"), ("B", "Bolt")], "symbol string, common_name string")
    got = sorted(map(tuple, chunks.find_passages(pages, firms, "page_id", "html").collect()))
    first, last = "Acme stock rose a lot on Monday, said ABC people", "Earnings of Bolt and others were out in the long morning"
    # places among passages of over 30 characters; a symbol counts wherever it stands, here B in ABC
    assert got == [(1, 0, "ABC", first, first), (1, 0, "B", first, first), (1, 2, "B", last, last)]


def test_passages_of_symbols_with_a_point(spark, monkeypatch):
    monkeypatch.setattr(chunks, "NAMES", 2)
    said = ["AAPL stock went up in the long morning", "Analysts like BRK.B: its price is fair, they say", "BRK B has no such price in this passage here"]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(said)] + [(9, 0, None)], "id long, at int, passage string")
    firms = spark.createDataFrame([("AAPL", "Apple Inc"), ("BRK.B", "Berkshire Hathaway"), ("", None), (None, "Nobody"), ("X", "")], "symbol string, common_name string")
    assert sorted(tuple(r)[:3] for r in chunks.match_passages(rows, firms).collect()) == [(0, 0, "AAPL"), (1, 0, "BRK.B")]
    assert chunks.match_passages(rows, firms.limit(0)).collect() == []


def test_phrases_against_a_search_for_each():
    rng = random.Random(4)
    for _ in range(200):
        found = tuple({"".join(rng.choice("abcé$") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 12))})
        texts = ["".join(rng.choice("abcdé$ ") for _ in range(rng.choice([0, 1, 3, 511, 512, 513, 2000]))).encode() for _ in range(rng.randrange(6))]
        text, phrase = phrases.Automaton(found).met(texts)
        assert list(zip(text.tolist(), phrase.tolist(), strict=True)) == sorted((i, j) for i, t in enumerate(texts) for j, p in enumerate(found) if p.encode() in t)
    with pytest.raises(ValueError):
        phrases.Automaton(("a", ""))


def test_walks_take_bounded_bytes_together(monkeypatch):
    monkeypatch.setattr(phrases, "TOGETHER", 50)
    texts = [b"x" * i + b"needle" * (i % 3 > 0) for i in range(60)]
    text, phrase = phrases.Automaton(("needle", "xn")).met(texts)
    assert set(zip(text.tolist(), phrase.tolist(), strict=True)) == {(i, 0) for i in range(60) if i % 3} | {(i, 1) for i in range(1, 60) if i % 3}


def test_sentiment_plans_walk_once(spark):
    """All terms of a boost are met by one vectorised step; nothing is evaluated row by row."""
    df = spark.createDataFrame([("up 5%",)], "t string")
    plan = df.select(sentiment.boost_score(F.col("t")).alias("b"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and plan.count("run(lower(t") == 1 and "BatchEvalPython" not in plan


def test_registered_models_are_whole(monkeypatch):
    from tapeworks.plans import market

    how = []
    monkeypatch.setattr(market, "_model_parts", lambda v: (None, None, ["x"]))
    monkeypatch.setattr(model, "train_model", lambda train, names, kind="random_forest", rounds=100, depth=None: how.append((kind, rounds, depth)) or 1 / 0)
    for name in ("train_forest", "train_boosted", "feature_importance"):
        with pytest.raises(ZeroDivisionError):
            market.SOURCES[name][0](SimpleNamespace(spark=None))
    assert how == [("random_forest", 100, None), ("boosted", 100, None), ("random_forest", 100, None)]


def test_plans(walk):
    _, df = walk
    plan = indicators.bollinger(indicators.averages(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "CartesianProduct" not in plan and "BatchEvalPython" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert len(__spark_entry__.queries()) >= 110
