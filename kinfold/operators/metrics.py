"""Regression and classification metrics as aggregations over (truth, prediction) columns; ranking metrics by windows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(t: Column, p: Column) -> Column:
    half = (F.abs(t) + F.abs(p)) / 2
    return F.when(half == 0, F.lit(0.0)).otherwise(F.abs(p - t) / F.when(half == 0, F.lit(1.0)).otherwise(half))


REGRESSION = {
    "smape": lambda t, p: 100 * F.avg(_ratio(t, p)),
    "mape": lambda t, p: 100 * F.avg(F.when(t != 0, F.abs((t - p) / F.when(t != 0, t)))),
    "rmsle": lambda t, p: F.sqrt(F.avg(F.pow(F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(F.greatest(t, F.lit(0.0))), 2))),
    "rmse": lambda t, p: F.sqrt(F.avg(F.pow(p - t, 2))),
    "mae": lambda t, p: F.avg(F.abs(p - t)),
}
# fixed values: whether more is better
GREATER_IS_BETTER = {"smape": False, "mape": False, "rmsle": False, "rmse": False, "mae": False, "f1_macro": True, "f1_micro": True, "f1_weighted": True, "exact_match": True}


def regression(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    t, p = F.col(truth).cast("double"), F.col(prediction).cast("double")
    return df.agg(*(f(t, p).alias(n) for n, f in REGRESSION.items()))


def classification(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """f1_macro, f1_micro, f1_weighted over the union of true and predicted classes; an undefined F1 is 0."""
    pairs = df.select(F.col(truth).cast("string").alias("t"), F.col(prediction).cast("string").alias("p")).groupBy("t", "p").agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("true"), F.lit(0).cast("long").alias("said")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("true"), F.col("n").alias("said")))).alias("x")).select("x.*")
    by = sides.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("true").alias("true"), F.sum("said").alias("said")).withColumn("f1", 2 * F.col("tp") / F.greatest(F.col("true") + F.col("said"), F.lit(1)))
    return by.agg(F.avg("f1").alias("f1_macro"), (F.sum("tp") / F.sum("true")).alias("f1_micro"), (F.sum(F.col("f1") * F.col("true")) / F.sum("true")).alias("f1_weighted"))


def exact_match(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    norm = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    return df.agg(F.avg((norm(truth) == norm(prediction)).cast("double")).alias("exact_match"))


def is_better(metric: str, new: float, old: float) -> bool:
    return new > old if GREATER_IS_BETTER[metric] else new < old


def score(df: DataFrame, metric: str, truth: str, prediction: str) -> DataFrame:
    if metric in REGRESSION:
        return df.agg(REGRESSION[metric](F.col(truth).cast("double"), F.col(prediction).cast("double")).alias(metric))
    if metric == "exact_match":
        return exact_match(df, truth, prediction)
    return classification(df, truth, prediction).select(metric)


def ranking(df: DataFrame, label: str, score_: str) -> DataFrame:
    """roc_auc (ties count half) and average precision, exact. Scores are first counted, so sorting is over distinct ones."""
    by = df.groupBy(F.col(score_).alias("s")).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    at = by.select("s", "pos", "n", F.sum("pos").over(w).alias("tp"), F.sum("n").over(w).alias("seen"))
    neg = F.col("n") - F.col("pos")
    below = F.sum("n") - F.sum("pos")  # all negatives
    wins = F.sum(neg * (F.col("tp") - F.col("pos") / 2))
    return at.agg((wins / (F.sum("pos") * below)).alias("roc_auc"), (F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.sum("pos")).alias("average_precision"))


def multiplier_sweep(df: DataFrame, truth: str, prediction: str, metric: str = "smape", low: float = 0.85, high: float = 1.25, n: int = 81) -> DataFrame:
    """(multiplier, metric) of prediction * multiplier for n multipliers, in one aggregation."""
    cells = F.broadcast(df.sparkSession.range(n).select(F.round(F.lit(low) + F.col("id") * ((high - low) / (n - 1)), 6).alias("multiplier")))
    t, p = F.col(truth).cast("double"), F.col(prediction).cast("double") * F.col("multiplier")
    return df.select(truth, prediction).crossJoin(cells).groupBy("multiplier").agg(REGRESSION[metric](t, p).alias(metric))


def eval_hook(metric: str) -> Callable[[np.ndarray, np.ndarray], tuple[str, float, bool]]:
    """(prediction, truth) -> (name, value, greater is better), as boosting libraries call it after a round."""

    def smape(p: np.ndarray, t: np.ndarray) -> float:
        half = (np.abs(t) + np.abs(p)) / 2
        return float(100 * np.where(half == 0, 0.0, np.abs(p - t) / np.where(half == 0, 1.0, half)).mean())

    values = {
        "smape": smape,
        "mape": lambda p, t: float(100 * np.abs((t - p)[t != 0] / t[t != 0]).mean()),
        "rmsle": lambda p, t: float(np.sqrt(((np.log1p(np.maximum(p, 0)) - np.log1p(np.maximum(t, 0))) ** 2).mean())),
        "rmse": lambda p, t: float(np.sqrt(((p - t) ** 2).mean())),
        "mae": lambda p, t: float(np.abs(p - t).mean()),
    }

    def hook(prediction: np.ndarray, truth: np.ndarray) -> tuple[str, float, bool]:
        return metric, values[metric](np.asarray(prediction, float), np.asarray(truth, float)), GREATER_IS_BETTER[metric]

    return hook
