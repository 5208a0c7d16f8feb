"""First-order autoregression on levels or on differences, as JVM array expressions.

The regression sums and the closed-form path need no Python and no shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.operators.calendar import by_month
from monthloom.settings import SEASON


def seasonal_diff(demand: DataFrame, d: int = 0, D: int = 0, season: int = SEASON, col: str = "y") -> DataFrame:
    """Adds ``w``: the series differenced ``d`` times at lag 1 and ``D`` times at the season."""
    out = demand.withColumn("w", F.col(col))
    for lag in [1] * d + [season] * D:
        out = out.withColumn("w", F.col("w") - F.lag("w", lag).over(by_month()))
    return out


def differenced(ys: Column) -> Column:
    n = F.size(ys)
    return F.zip_with(F.slice(ys, 2, F.greatest(n - 1, F.lit(0))), F.slice(ys, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)


def ar_column(ys: Column, order: int = 0) -> Column:
    """STRUCT<phi, const, last_y, last_w> of w[t] = const + phi * w[t-1] by least squares.

    One fold over the (previous, current) pairs collects the sums, shifted by the first
    value so that they stay small.  A constant regressor gives phi 0 and the mean; a series
    too short for a regression keeps its last value.
    """
    w = differenced(ys) if order else ys
    last_w = F.get(w, F.size(w) - 1)
    k = F.greatest(F.size(w) - 1, F.lit(0))
    base = F.coalesce(F.get(w, F.lit(0)), F.lit(0.0))
    pairs = F.zip_with(
        F.slice(w, 1, k), F.slice(w, 2, k), lambda x, t: F.struct((x - base).alias("x"), (t - base).alias("t"), base.alias("b"))
    )
    zero = F.lit(0.0)
    start = F.struct(*[zero.alias(c) for c in ("n", "x", "t", "xx", "xt", "b")])

    def add(s, p):
        return F.struct(
            (s["n"] + 1.0).alias("n"),
            (s["x"] + p["x"]).alias("x"),
            (s["t"] + p["t"]).alias("t"),
            (s["xx"] + p["x"] * p["x"]).alias("xx"),
            (s["xt"] + p["x"] * p["t"]).alias("xt"),
            p["b"].alias("b"),
        )

    def solve(s):
        sxx, sxt = s["n"] * s["xx"] - s["x"] * s["x"], s["n"] * s["xt"] - s["x"] * s["t"]
        phi = F.when(sxx > 1e-9, sxt / F.nullif(sxx, zero)).otherwise(0.0)
        return F.struct(phi.alias("phi"), (s["b"] * (1 - phi) + (s["t"] - phi * s["x"]) / F.nullif(s["n"], zero)).alias("const"))

    fit = F.aggregate(pairs, start, add, solve)
    fallback = F.coalesce(last_w, zero) if order == 0 else zero
    return F.struct(
        fit["phi"].alias("phi"),
        F.coalesce(fit["const"], fallback).alias("const"),
        F.get(ys, F.size(ys) - 1).alias("last_y"),
        F.coalesce(last_w, zero).alias("last_w"),
    )


def ar_fit(packed: DataFrame, order: int = 0, ys: Column | str = "ys") -> DataFrame:
    """Adds the struct ``fit``; ``order`` is the number of differences (0 or 1)."""
    return packed.withColumn("fit", ar_column(F.col(ys) if isinstance(ys, str) else ys, order))


def ar_path(horizon, order: int = 0, fit: Column | None = None) -> Column:
    """ARRAY<DOUBLE> of forecasts, in closed form, differences undone."""
    horizon = F.lit(horizon) if isinstance(horizon, int) else horizon
    fit = F.col("fit") if fit is None else fit
    phi, c, y, w = fit["phi"], fit["const"], fit["last_y"], fit["last_w"]
    unit = F.abs(phi - 1) < 1e-9
    mu = c / F.when(unit, F.lit(1.0)).otherwise(1 - phi)

    def value(k):
        kd = k.cast("double")
        power = F.pow(phi, kd)
        if order == 0:
            return F.when(unit, w + c * kd).otherwise(mu + power * (w - mu))
        drift = w * kd + c * kd * (kd + 1) / 2
        total = mu * kd + (w - mu) * phi * (1 - power) / F.when(unit, F.lit(1.0)).otherwise(1 - phi)
        return y + F.when(unit, drift).otherwise(total)

    return F.when((horizon > 0) & y.isNotNull(), F.transform(F.sequence(F.lit(1), horizon), value))


def ar_forecast(fitted: DataFrame, horizon: int = 12, order: int = 0) -> DataFrame:
    return fitted.select(
        "product", "start", "n", F.posexplode(ar_path(horizon, order)).alias("_k", "yhat")
    ).select(
        "product",
        (F.col("_k") + 1).alias("step"),
        F.add_months("start", F.col("n") + F.col("_k")).alias("ds"),
        "yhat",
    )
