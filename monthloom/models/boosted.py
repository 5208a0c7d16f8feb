"""Boosted trees over all products, and forecasting by feeding predictions back.

One distributed model serves every product; the product enters as its mean level over
the training rows, which identifies it to a tree without an unbounded category list.
"""

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthloom.functions.expressions import array_sum, uniform
from monthloom.operators.temporal import temporal_features
from monthloom.session import reuse
from monthloom.settings import LAGS, ROLLING_WINDOWS

TEMPORAL = (
    *[f"y_lag_{k}" for k in LAGS],
    *[f"y_roll_{s}_{k}" for k in ROLLING_WINDOWS for s in ("mean", "std")],
    "month",
    "quarter",
    "year",
    "month_sin",
    "month_cos",
)


def training_table(demand: DataFrame, lags=LAGS, windows=ROLLING_WINDOWS) -> DataFrame:
    """Temporal features plus ``level``; rows whose lags are incomplete are dropped."""
    leveled = demand.withColumn("level", F.avg("y").over(W.partitionBy("product")))
    return temporal_features(leveled, "y", lags, windows).dropna()


def gbt_fit(
    table: DataFrame,
    features=(*TEMPORAL, "level"),
    rounds: int = 100,
    depth: int = 6,
    rate: float = 0.1,
    min_child_weight: int = 1,
    subsample: float = 1.0,
    colsample: float = 1.0,
    seed: int = 42,
    rows_per_task: int = 50_000,
) -> PipelineModel:
    """One gradient-boosted model; distributed over rows, statistics aggregated per split.

    Every level of every tree is a pass over the rows, so a table of few rows is read in few
    tasks (``rows_per_task``): their overhead would outweigh the work.
    """
    table = table.coalesce(max(1, -(-table.count() // rows_per_task)))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    trees = GBTRegressor(
        labelCol="y",
        featuresCol="features",
        maxIter=rounds,
        maxDepth=depth,
        stepSize=rate,
        minInstancesPerNode=min_child_weight,
        subsamplingRate=subsample,
        featureSubsetStrategy=str(colsample) if colsample < 1 else "all",
        seed=seed,
    )
    return Pipeline(stages=[assembler, trees]).fit(table)


def _tail(hist: Column, k: int) -> Column:
    return F.slice(hist, F.greatest(F.size(hist) - (k - 1), F.lit(1)), k)


def _squares(values: Column, center: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + (v - center) * (v - center))


def _features_at(hist: Column, ds: Column, lags, windows) -> dict[str, Column]:
    """The features of the next month from the values so far; what is missing is 0."""
    n = F.size(hist)
    out = {f"y_lag_{k}": F.coalesce(F.get(hist, n - k), F.lit(0.0)) for k in lags}
    for k in windows:
        last = _tail(hist, k)
        mean = array_sum(last) / k
        full = n >= k
        out[f"y_roll_mean_{k}"] = F.when(full, mean).otherwise(0.0)
        out[f"y_roll_std_{k}"] = F.when(full, F.sqrt(_squares(last, mean) / (k - 1))).otherwise(0.0)
    angle = F.lit(2 * math.pi) * F.month(ds) / 12
    return out | {
        "month": F.month(ds),
        "quarter": F.quarter(ds),
        "year": F.year(ds),
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
    }


def recursive_fold(packed: DataFrame, score, horizon: int = 12, lags=LAGS, windows=ROLLING_WINDOWS) -> DataFrame:
    """Recursive forecast for a model that is a column expression: one fold per product.

    ``score`` maps the feature columns by name to the prediction of the next month.
    """
    need = max(*lags, *windows)
    last = F.add_months("start", F.col("n") - 1)
    seed = _tail(F.col("ys"), need)

    def step(values, k):
        return F.array_append(values, score(_features_at(values, F.add_months(last, k), lags, windows)))

    path = F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), seed, step), F.size(seed) + 1, horizon)
    flat = packed.select("product", last.alias("last"), F.posexplode(path).alias("_k", "yhat"))
    return flat.select(
        "product", (F.col("_k") + 1).alias("step"), F.add_months("last", F.col("_k") + 1).alias("ds"), "yhat"
    )


def tree_path(
    packed: DataFrame, model: PipelineModel, name: str, ys: Column, start: Column, horizon: Column, most: int,
    ahead: Column | None = None, exog: int = 0, lags=LAGS, windows=ROLLING_WINDOWS,
) -> DataFrame:
    """Adds ``name ARRAY<DOUBLE>``: predict a month, append it, rebuild the features, repeat.

    The model has been fitted on the temporal features, ``level`` and the ``exog`` columns of ``ahead
    ARRAY<ARRAY<DOUBLE>>`` (one array per future month, the last one repeated), in that order; a
    missing value counts as 0.  Every month is one ``transform`` of the fitted trees on the
    product's own row, so the whole horizon is narrow.  ``most`` is the longest horizon in the table.
    """
    trees = model.stages[-1]
    level = F.coalesce(array_sum(ys) / F.size(ys), F.lit(0.0))
    df = packed.withColumns({"_hist": ys, "_level": level, "_start": start, "_ahead": F.lit(None) if ahead is None else ahead})
    for k in range(most):
        at = F.add_months("_start", F.size("_hist"))
        cols = [F.coalesce(c.cast("double"), F.lit(0.0)) for c in _features_at(F.col("_hist"), at, lags, windows).values()]
        given = F.get("_ahead", F.least(F.lit(k), F.size("_ahead") - 1)) if exog else None
        cols += [F.col("_level"), *[F.coalesce(F.get(given, F.lit(j)).cast("double"), F.lit(0.0)) for j in range(exog)]]
        df = trees.transform(df.withColumn(trees.getFeaturesCol(), array_to_vector(F.array(*cols))))
        grown = F.array_append("_hist", F.col(trees.getPredictionCol()))
        df = df.withColumn("_hist", grown).drop(trees.getFeaturesCol(), trees.getPredictionCol())
    path = F.when(F.size(ys) > 0, F.slice("_hist", F.size(ys) + 1, horizon))
    return df.withColumn(name, path).drop("_hist", "_level", "_start", "_ahead")


def recursive_forecast(packed: DataFrame, model: PipelineModel, horizon: int = 12, **options) -> DataFrame:
    """``product, step, ds, yhat`` from :func:`tree_path`."""
    # kept, so that no filter sinks into the chain of months and repeats each of them
    done = reuse(tree_path(packed, model, "_path", F.col("ys"), F.col("start"), F.lit(horizon), horizon, **options))
    flat = done.select("product", "start", "n", F.posexplode("_path").alias("_k", "yhat"))
    return flat.select(
        "product",
        (F.col("_k") + 1).alias("step"),
        F.add_months("start", F.col("n") + F.col("_k")).alias("ds"),
        "yhat",
    )


def tree_gains(model: PipelineModel, features=(*TEMPORAL, "level")) -> Column:
    """Gain importance in percent, as a constant ``ARRAY<STRUCT<feature, pct>>`` of as many entries as the model has features."""
    gains = model.stages[-1].featureImportances.toArray()
    total = float(gains.sum()) or 1.0
    return F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(round(100.0 * float(v) / total, 2)).alias("pct")) for f, v in zip(features, gains)])


def tree_importance(spark, model: PipelineModel, features=(*TEMPORAL, "level")) -> DataFrame:
    """Gain importance in percent: one row per feature of the model."""
    return spark.range(1).select(F.inline(tree_gains(model, features)))
