"""Classifiers of bars by Spark ML: training, evaluation, catalogues, batch prediction."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .backtest import equity_curve, risk_metrics
from .bars import KEYS, TIME
from .dedup import cut_lineage
from .features import temporal_split, with_class_weights
from .lookup import last_n

#: Label of each class index.
CLASSES = {0: "Sell", 1: "Hold", 2: "Buy"}


def with_index(df: DataFrame) -> DataFrame:
    """``label``: target -1, 0, 1 as 0, 1, 2."""
    return df.withColumn("label", (F.col("target") + 1).cast("double"))


def train_model(df: DataFrame, names: list[str], kind: str = "random_forest", rounds: int = 100, depth: int | None = None, seed: int = 42) -> PipelineModel:
    """A classifier of ``target`` on the features ``names``, classes weighted to be even."""
    rows = cut_lineage(with_class_weights(with_index(df)))  # trees read them many times
    if kind == "random_forest":
        model = RandomForestClassifier(numTrees=rounds, maxDepth=depth or 10, seed=seed, weightCol="weight")
    elif kind == "boosted":
        model = OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=depth or 6, stepSize=0.1, subsamplingRate=0.8, seed=seed), weightCol="weight", parallelism=len(CLASSES))
    else:
        raise ValueError(f"no such kind of model: {kind}")
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), model]).fit(rows)


def predict_batch(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Class, label, probabilities and confidence for each row."""
    out = model.transform(df)
    raw = vector_to_array("probability" if "probability" in out.columns else "rawPrediction")
    if "probability" not in out.columns:  # one against the rest gives margins
        raw = F.transform(raw, lambda x: 1 / (1 + F.exp(-2 * x)))
        out = out.withColumn("__p", raw)
        raw = F.transform("__p", lambda x: x / F.aggregate("__p", F.lit(0.0), lambda a, y: a + y))
    out = out.withColumn("probabilities", raw)
    index = F.col("prediction").cast("int")
    names = F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair))
    return out.withColumns({"predicted": index - 1, "label_name": F.element_at(names, index), "confidence": F.array_max("probabilities")}).drop("features", "rawPrediction", "probability", "prediction", "__p")


def accuracy(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    return pred.groupBy(*(by or [])).agg(F.avg((F.col("predicted") == F.col("target")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def feature_importance(spark: SparkSession, model: PipelineModel, names: list[str], n: int = 10) -> DataFrame:
    """The ``n`` features that matter most (a top-n report)."""
    last = model.stages[-1]
    parts = [last] if hasattr(last, "featureImportances") else last.models
    sums = [sum(float(p.featureImportances[i]) for p in parts) / len(parts) for i in range(len(names))]
    return spark.createDataFrame(list(zip(names, sums, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)


def importance_with_values(importances: DataFrame, rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, feature, importance and the feature's value in the newest of ``rows``, for each of ``importances``."""
    names = [r["feature"] for r in importances.select("feature").collect()]  # a top-n report
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*(F.col(n).cast("double").alias(n) for n in names)), TIME).alias("row"))
    values = F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), F.col("row")[n].alias("value")) for n in names)))
    return newest.select(*keys, values).join(F.broadcast(importances), "feature")


def save_model(spark: SparkSession, model: PipelineModel, info: dict, folder: str) -> None:
    """The model, and one row of metadata beside it."""
    model.write().overwrite().save(f"{folder}/model")
    row = [(info.get("timeframe"), info.get("model_type"), info.get("training_samples"), info.get("validation_accuracy"), json.dumps(info, sort_keys=True, default=str))]
    spark.createDataFrame(row, "timeframe string, model_type string, training_samples long, validation_accuracy double, info string").write.mode("overwrite").json(f"{folder}/info")


def load_model(folder: str) -> PipelineModel:
    return PipelineModel.load(f"{folder}/model")


def list_models(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("timeframe string, model_type string, training_samples long, validation_accuracy double, info string").json(f"{root}/*/info")


def model_summary(models: DataFrame) -> DataFrame:
    return models.agg(F.count(F.lit(1)).alias("models"), F.max("validation_accuracy").alias("best_accuracy"), F.sum("training_samples").alias("samples"))


def train_all_timeframes(df: DataFrame, names: list[str], timeframes: list[str], **how) -> list[tuple[str, PipelineModel | None, str]]:
    """(timeframe, model or None, error) for each timeframe; the jobs follow each other."""
    out = []
    for t in timeframes:
        try:
            out.append((t, train_model(df.where(F.col("timeframe") == t), names, **how), ""))
        except Exception as e:  # noqa: BLE001  an error is a row of the report
            out.append((t, None, str(e).splitlines()[0]))
    return out


def compare_rounds(train: DataFrame, test: DataFrame, names: list[str], rounds: tuple[int, ...] = (100, 1), **how) -> DataFrame:
    """Accuracy for each number of boosting rounds."""
    out = None
    for n in rounds:
        row = accuracy(predict_batch(train_model(train, names, "boosted", rounds=n, **how), test)).withColumn("rounds", F.lit(n))
        out = row if out is None else out.union(row)
    return out


def sized(df: DataFrame, sizes: tuple[int | None, ...] = (1000, 5000, 10_000, None), keys: list[str] = KEYS) -> DataFrame:
    """The last rows of each series once for each size, labelled ``size`` (null: all)."""
    out = None
    for n in sizes:
        part = (df if n is None else last_n(df, n, keys, [TIME])).withColumn("size", F.lit(n).cast("int"))
        out = part if out is None else out.unionByName(part)
    return out


def compare_sizes(bars: DataFrame, prepare: Callable[[DataFrame], tuple[DataFrame, list[str]]], sizes: tuple[int | None, ...] = (1000, 5000, 10_000, None), kind: str = "boosted", keys: list[str] = KEYS, **how) -> DataFrame:
    """For each size (null: all rows): a model trained on the last rows of each series, and what its
    signals would have earned; ``best`` marks the size with the highest return.

    ``prepare`` gives labelled rows with features (and close), and the features' names.  One job for each size.
    """
    bars, out = cut_lineage(bars), None  # every size reads them many times
    for n in sizes:
        rows, names = prepare(bars if n is None else last_n(bars, n, keys, [TIME]))
        rows = cut_lineage(temporal_split(rows, keys=keys))
        fitted = train_model(rows.where("part = 'train'"), names, kind, **how)
        pred = predict_batch(fitted, rows.where("part = 'validation'"))
        metrics = risk_metrics(equity_curve(pred.select(*keys, TIME, F.col("close").alias("price"), F.col("predicted").alias("prediction"), "target"), keys), keys)
        row = metrics.agg(F.avg("total_return").alias("strategy_return"), F.avg("buy_hold").alias("buy_hold"), F.avg("accuracy").alias("accuracy"), F.avg("sharpe").alias("sharpe"), F.min("max_drawdown").alias("max_drawdown"))
        row = row.select(F.lit(n).cast("int").alias("size"), "*")
        out = row if out is None else out.union(row)
    place = Window.partitionBy(F.lit(1)).orderBy(F.desc("strategy_return"), F.asc_nulls_last("size"))  # one row a size
    return out.withColumn("best", F.row_number().over(place) == 1)


def compare_symbols(metrics: DataFrame) -> DataFrame:
    """Means over symbols, and how many beat buying and holding."""
    return metrics.agg(F.avg("total_return").alias("avg_return"), F.avg("buy_hold").alias("avg_buy_hold"), F.avg("accuracy").alias("avg_accuracy"), F.count_if(F.col("total_return") > F.col("buy_hold")).alias("outperform"), F.count(F.lit(1)).alias("symbols"))
