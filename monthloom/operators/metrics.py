"""Error measures.  Input rows carry ``y`` and ``yhat``; keys default to (product, model)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions.expressions import ape, ape_eps, array_sum

KEYS = ("product", "model")


def rmse_of(y="y", yhat="yhat") -> Column:
    return F.sqrt(F.avg(F.pow(F.col(y) - F.col(yhat), F.lit(2.0))))


def mape_of(y="y", yhat="yhat") -> Column:
    """0.0 when every actual is zero."""
    return F.coalesce(F.avg(ape(F.col(y), F.col(yhat))), F.lit(0.0))


def mae_of(y="y", yhat="yhat") -> Column:
    return F.coalesce(F.avg(F.abs(F.col(y) - F.col(yhat))), F.lit(0.0))


def mape_eps_of(y="y", yhat="yhat") -> Column:
    return F.avg(ape_eps(F.col(y), F.col(yhat)))


def evaluate_all(pairs: DataFrame, keys=KEYS, strict: bool = False) -> DataFrame:
    """RMSE, MAPE and MAE per key.

    ``strict`` fails the job when an actual has no prediction or the other way round.
    """
    if strict:
        unmatched = F.col("y").isNull() | F.col("yhat").isNull()
        complaint = F.raise_error(F.lit("actuals and predictions differ in length"))
        pairs = pairs.withColumn("yhat", F.when(unmatched, complaint.cast("double")).otherwise(F.col("yhat")))
    return pairs.groupBy(*keys).agg(rmse_of().alias("rmse"), mape_of().alias("mape"), mae_of().alias("mae"))


def array_metrics(actual: Column, path: Column) -> dict[str, Column]:
    """The same three measures over two aligned arrays, for rows that hold a whole series."""
    n = F.size(actual)
    errs = F.zip_with(actual, path, lambda y, p: y - p)
    shares = F.filter(F.zip_with(actual, path, lambda y, p: ape(y, p)), lambda v: v.isNotNull())

    def mean(a):
        return array_sum(a) / F.nullif(F.size(a), F.lit(0))

    return {
        "rmse": F.sqrt(array_sum(F.transform(errs, lambda e: e * e)) / F.nullif(n, F.lit(0))),
        "mape": F.coalesce(mean(shares), F.lit(0.0)),
        "mae": F.coalesce(mean(F.transform(errs, F.abs)), F.lit(0.0)),
    }


def aggregate_metrics(metrics: DataFrame, names=("rmse", "mape", "mae"), by=("model",)) -> DataFrame:
    """Mean and population deviation of each metric over products."""
    aggs = []
    for m in names:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return metrics.groupBy(*by).agg(*aggs)


def component_summary(components: DataFrame, keys=("component",)) -> DataFrame:
    return components.groupBy(*keys).agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.max("value") - F.min("value")).alias("range"),
    )
