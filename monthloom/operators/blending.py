"""Weights from backtest errors, and the blended forecast."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthloom.operators.joins import models_with_both
from monthloom.operators.metrics import evaluate_all


def top_models(metrics: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` models of lowest MAPE per product; ties go to the first name."""
    w = W.partitionBy("product").orderBy("mape", "model")
    return metrics.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def model_position(models=None) -> Column:
    """Place of a model in the configured list; by name where no list is given."""
    if models is None:
        return F.col("model")
    return F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))


def inverse_mape_weights(
    metrics: DataFrame, threshold: float = 0.5, max_models: int | None = None, models=None, keep=()
) -> DataFrame:
    """``product, model, mape, weight, used``; weights sum to 1 per product.

    Models with 0 < MAPE < threshold compete and share the weight in proportion to
    1/MAPE; if more than ``max_models`` compete, the best are kept.  If none qualifies,
    all models with a positive MAPE weigh the same.  ``used`` numbers the models: best
    first where the list had to be cut, in the order of ``models`` otherwise.
    A product has at most as many rows as there are models.  ``keep`` names further columns
    to carry along.
    """
    product = W.partitionBy("product")
    limit = F.lit(max_models if max_models is not None else 2**31 - 1)
    ok = (F.col("mape") > 0) & (F.col("mape") < threshold)
    ranked = (
        metrics.withColumn("_ok", F.coalesce(ok, F.lit(False)))
        .withColumn("_n_ok", F.count_if("_ok").over(product))
        .withColumn("_rank", F.row_number().over(product.orderBy(F.col("_ok").desc(), "mape", "model")))
    )
    passing = F.when(F.col("_ok") & (F.col("_rank") <= limit), 1 / F.col("mape"))
    equal = F.when(F.col("mape") > 0, F.lit(1.0))
    raw = F.when(F.col("_n_ok") > 0, passing).otherwise(equal)
    cut = F.col("_n_ok") > limit
    place = F.row_number().over(product.orderBy(F.when(cut, F.col("mape")), model_position(models), "model"))
    return (
        ranked.withColumn("_raw", raw)
        .filter(F.col("_raw").isNotNull())
        .withColumn("weight", F.col("_raw") / F.sum("_raw").over(product))
        .withColumn("used", place)
        .select("product", "model", "mape", "weight", "used", *keep)
    )


def ensemble_combine(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sum by step.

    The first used model sets the length; a model whose forecast has another
    length contributes nothing and the remaining weights are not rescaled.
    """
    used = predictions.join(weights, ["product", "model"])
    n = F.count(F.lit(1)).over(W.partitionBy("product", "model"))
    sized = used.withColumn("_n", n)
    want = F.min_by("_n", "used").over(W.partitionBy("product"))
    return (
        sized.withColumn("_want", want)
        .filter(F.col("step") <= F.col("_want"))
        .groupBy("product", "step", "ds")
        .agg(F.sum(F.when(F.col("_n") == F.col("_want"), F.col("weight") * F.col("yhat")).otherwise(0.0)).alias("yhat"))
    )


def evaluate_ensemble(ensemble: DataFrame, actuals: DataFrame) -> DataFrame:
    """Metrics over the steps both sides have."""
    pairs = ensemble.select("product", "step", "yhat").join(actuals.select("product", "step", "y"), ["product", "step"])
    return evaluate_all(pairs, keys=("product",))


def ensemble_record(ensemble: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per product: forecast map, the first used model's MAPE, models and weights."""
    order = F.array_sort(F.collect_list(F.struct("used", "mape", "model", "weight")))
    used = weights.groupBy("product").agg(order.alias("_u"))
    fc = ensemble.groupBy("product").agg(F.array_sort(F.collect_list(F.struct("ds", "yhat"))).alias("_f"))
    return fc.join(used, "product").select(
        "product",
        F.map_from_entries("_f").alias("forecast"),
        F.col("_u")[0]["mape"].alias("first_model_mape"),
        F.transform("_u", lambda u: u["model"]).alias("models_used"),
        F.map_from_entries(F.transform("_u", lambda u: F.struct(u["model"], u["weight"]))).alias("weights"),
    )
