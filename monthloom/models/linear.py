"""Least squares on two regressors per product, in closed form from covariances.

Plain aggregates, so the fit is one partial aggregation and works as the exact stand-in
wherever an operator needs *some* fitted model (influence measures, recursive forecasts).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_fit(rows: DataFrame, x1: str, x2: str, y: str = "y", key: str = "product") -> DataFrame:
    """``key, b0, b1, b2``; collinear regressors fall back to the first one alone."""
    used = rows.filter(F.col(x1).isNotNull() & F.col(x2).isNotNull() & F.col(y).isNotNull())
    s = used.groupBy(key).agg(
        F.var_pop(x1).alias("v1"),
        F.var_pop(x2).alias("v2"),
        F.covar_pop(x1, x2).alias("c12"),
        F.covar_pop(x1, y).alias("c1y"),
        F.covar_pop(x2, y).alias("c2y"),
        F.avg(x1).alias("m1"),
        F.avg(x2).alias("m2"),
        F.avg(y).alias("my"),
    )
    det = F.col("v1") * F.col("v2") - F.col("c12") * F.col("c12")
    ok = F.abs(det) > 1e-9
    safe = F.when(ok, det)
    b1 = F.coalesce(
        (F.col("c1y") * F.col("v2") - F.col("c2y") * F.col("c12")) / safe,
        F.col("c1y") / F.nullif(F.col("v1"), F.lit(0.0)),
        F.lit(0.0),
    )
    b2 = F.coalesce((F.col("c2y") * F.col("v1") - F.col("c1y") * F.col("c12")) / safe, F.lit(0.0))
    out = s.withColumn("b1", b1).withColumn("b2", b2)
    return out.select(key, (F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("b0"), "b1", "b2")


def linear_score(x1: Column, x2: Column) -> Column:
    return F.col("b0") + F.col("b1") * x1 + F.col("b2") * x2
