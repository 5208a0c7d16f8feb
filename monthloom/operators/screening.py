"""Which series to work on, and how a series is cut into train, validation and test."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthloom.operators.calendar import by_month


def _activity(demand: DataFrame, lookback: int) -> DataFrame:
    w = W.partitionBy("product").orderBy(F.col("ds").desc())
    active = F.when(F.col("y").isNull() | (F.col("y") != 0), 1.0).otherwise(0.0)
    return (
        demand.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= lookback)
        .groupBy("product")
        .agg(F.avg(active).alias("nonzero_share"), F.count(F.lit(1)).alias("n_seen"))
    )


def classify(demand: DataFrame, lookback: int = 24, min_share: float = 0.5) -> DataFrame:
    """One row per product with the verdict.  A missing month counts as active."""
    return _activity(demand, lookback).withColumn("forecastable", F.col("nonzero_share") >= min_share)


def classify_filter(
    demand: DataFrame, lookback: int = 24, min_share: float = 0.5, keep: bool = True
) -> DataFrame:
    """Rows of the forecastable products, or of the rejected ones with ``keep=False``.

    The share is a window aggregate over the rows ranked from the newest, so verdict
    and rows stay in the same partition and no join is needed.
    """
    newest = W.partitionBy("product").orderBy(F.col("ds").desc())
    seen = F.when(F.col("_rn") <= lookback, F.when(F.col("y").isNull() | (F.col("y") != 0), 1.0).otherwise(0.0))
    share = F.avg(seen).over(W.partitionBy("product"))
    verdict = F.col("_share") >= min_share
    ranked = demand.withColumn("_rn", F.row_number().over(newest)).withColumn("_share", share)
    return ranked.filter(verdict if keep else ~verdict).select(*demand.columns)


def require_nonempty(demand: DataFrame, what: str = "No forecastable series found") -> DataFrame:
    if demand.isEmpty():
        raise ValueError(what)
    return demand


def require_inputs(demand, features=None, needs_features: bool = False) -> None:
    if demand is None:
        raise ValueError("a demand table is required")
    if needs_features and features is None:
        raise ValueError("this run needs a feature table")


def split_sizes(n: Column, val: int = 12, test: int = 12) -> tuple[Column, Column]:
    """Sizes of the validation and test tails; a short series gives up at most a third to each."""
    third = F.floor(n / 3).cast("int")
    short = n < val + test + 12

    def size(k):
        return F.when(short, F.least(F.lit(k), third)).otherwise(F.lit(k)).cast("int")

    return size(val), size(test)


def split_label(demand: DataFrame, val: int = 12, test: int = 12, window: int = 60) -> DataFrame:
    """Adds ``i`` (0-based position), ``n`` and ``split`` in train/val/test."""
    everything = W.partitionBy("product")
    newest = W.partitionBy("product").orderBy(F.col("ds").desc())
    cut = demand.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= window)
    out = cut.withColumn("n", F.count(F.lit(1)).over(everything).cast("int"))
    v, t = split_sizes(F.col("n"), val, test)
    return out.select(
        *[c for c in demand.columns if c not in ("i", "n", "split")],
        (F.col("n") - F.col("_back")).cast("int").alias("i"),
        "n",
        F.when(F.col("_back") <= t, "test").when(F.col("_back") <= t + v, "val").otherwise("train").alias("split"),
    )


def holdout_split(demand: DataFrame, ratio: float = 0.2) -> DataFrame:
    """Chronological split inside the training rows: the last ``ratio`` share is held out."""
    w = by_month()
    n = F.count(F.lit(1)).over(W.partitionBy("product"))
    return (
        demand.withColumn("i", (F.row_number().over(w) - 1).cast("int"))
        .withColumn("n", n.cast("int"))
        .withColumn("part", F.when(F.col("i") < holdout_size(F.col("n"), ratio), "fit").otherwise("holdout"))
    )


def holdout_size(n: Column, ratio: float = 0.2) -> Column:
    """How many leading points are fitted on."""
    return F.floor(n * F.lit(1 - ratio)).cast("int")
