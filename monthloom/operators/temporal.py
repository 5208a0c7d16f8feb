"""Lag, rolling and calendar features, and carrying features into the future."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthloom.operators.calendar import by_month, future_rows
from monthloom.settings import LAGS, ROLLING_WINDOWS


def _lag_columns(target: str, lags) -> list[Column]:
    w = by_month()
    return [F.lag(target, k).over(w).alias(f"{target}_lag_{k}") for k in lags]


def _rolling_columns(target: str, windows) -> list[Column]:
    out = []
    for k in windows:
        past = by_month().rowsBetween(-k, -1)
        full = F.count(target).over(past) == k
        out.append(F.when(full, F.avg(target).over(past)).alias(f"{target}_roll_mean_{k}"))
        out.append(F.when(full, F.stddev_samp(target).over(past)).alias(f"{target}_roll_std_{k}"))
    return out


def _calendar_columns(ds: Column) -> list[Column]:
    angle = F.lit(2 * math.pi) * F.month(ds) / 12
    return [
        F.month(ds).alias("month"),
        F.quarter(ds).alias("quarter"),
        F.year(ds).alias("year"),
        F.sin(angle).alias("month_sin"),
        F.cos(angle).alias("month_cos"),
    ]


def lag_features(df: DataFrame, target: str = "y", lags=LAGS) -> DataFrame:
    return df.select("*", *_lag_columns(target, lags))


def rolling_features(df: DataFrame, target: str = "y", windows=ROLLING_WINDOWS) -> DataFrame:
    """Mean and sample deviation of the previous ``k`` values; NULL unless all are there."""
    return df.select("*", *_rolling_columns(target, windows))


def calendar_features(df: DataFrame) -> DataFrame:
    return df.select("*", *_calendar_columns(F.col("ds")))


def temporal_features(df: DataFrame, target: str = "y", lags=LAGS, windows=ROLLING_WINDOWS) -> DataFrame:
    """All of the above over one window specification: one shuffle, one sort."""
    return df.select(
        "*", *_lag_columns(target, lags), *_rolling_columns(target, windows), *_calendar_columns(F.col("ds"))
    )


def feature_columns(df: DataFrame, target: str = "y", exclude=()) -> list[str]:
    return [c for c in df.columns if c not in {target, "product", "ds", *exclude}]


def drop_na_rows(df: DataFrame) -> DataFrame:
    return df.dropna()


def target_and_exog(df: DataFrame, target: str = "demand") -> tuple[DataFrame, DataFrame | None]:
    """The target (``demand``, else the first value column) and everything else, if any."""
    values = [c for c in df.columns if c not in ("product", "ds")]
    name = target if target in values else values[0]
    rest = [c for c in values if c != name]
    exog = df.select("product", "ds", *rest) if rest else None
    return df.select("product", "ds", F.col(name).alias("y")), exog


def extrapolate_last(df: DataFrame, horizon: int = 12, target: str = "y") -> DataFrame:
    """Future months that repeat the last row of every feature (a NULL there stays NULL)."""
    feats = feature_columns(df, target)
    row = F.max_by(F.struct(*feats), "ds").alias("_f")
    last = df.groupBy("product").agg(F.max("ds").alias("last"), row)
    return future_rows(last, horizon).select("product", "step", "ds", *[F.col(f"_f.{c}").alias(c) for c in feats])


def extrapolate_trailing_mean(
    df: DataFrame, mean_columns, horizon: int = 12, months: int = 12, target: str = "y"
) -> DataFrame:
    """``mean_columns`` continue at the mean of their last ``months`` rows, others at the last row."""
    feats = feature_columns(df, target)
    means = [c for c in feats if c in set(mean_columns)]
    others = [c for c in feats if c not in set(mean_columns)]
    newest = W.partitionBy("product").orderBy(F.col("ds").desc())
    recent = df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= months)
    aggs = [F.avg(c).alias(c) for c in means]
    if others:
        aggs.append(F.max_by(F.struct(*others), "ds").alias("_f"))
    last = recent.groupBy("product").agg(F.max("ds").alias("last"), *aggs)
    return future_rows(last, horizon).select(
        "product", "step", "ds", *means, *[F.col(f"_f.{c}").alias(c) for c in others]
    )
