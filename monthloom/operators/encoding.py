"""Category codes and scaling, fitted on the training rows of each product only.

Two ways to use them.  ``*_fit`` / ``*_transform`` keep the fitted values as a table, to be
stored or applied to other rows; they work on the long form ``product, ds, split, feature,
value`` and join on product and feature.  ``encode_and_scale`` fits and applies in one pass
over a wide table, where the fitted values are window aggregates and nothing is joined.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def melt(df: DataFrame, features, value: str = "value", keep=("product", "ds", "split")) -> DataFrame:
    return df.unpivot([c for c in keep if c in df.columns], list(features), "feature", value)


def encode_fit(long: DataFrame) -> DataFrame:
    """Sorted distinct training categories of each product and feature, numbered from 0."""
    cats = (
        long.filter((F.col("split") == "train") & F.col("value").isNotNull())
        .select("product", "feature", F.col("value").alias("category"))
        .distinct()
    )
    w = W.partitionBy("product", "feature").orderBy("category")
    return cats.withColumn("code", (F.row_number().over(w) - 1).cast("int"))


def encode_transform(long: DataFrame, fitted: DataFrame, unknown: int = -1) -> DataFrame:
    """Adds ``code``: unseen categories become ``unknown``, missing stays missing."""
    hit = fitted.withColumnRenamed("category", "value")
    joined = long.join(hit, ["product", "feature", "value"], "left")
    code = F.when(F.col("value").isNotNull(), F.coalesce("code", F.lit(unknown)))
    return joined.select(*long.columns, code.cast("double").alias("code"))


def scale_fit(long: DataFrame, kind: str = "robust") -> DataFrame:
    """``center`` and ``scale`` per product and feature so that x' = (x - center) / scale.

    A constant feature has scale 1.
    """
    train = long.filter(F.col("split") == "train").groupBy("product", "feature")
    if kind == "robust":
        q = train.agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
        center, scale = F.col("_q")[1], F.col("_q")[2] - F.col("_q")[0]
    elif kind == "minmax":
        q = train.agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        center, scale = F.col("_lo"), F.col("_hi") - F.col("_lo")
    else:
        raise ValueError(f"unknown scaler {kind!r}: use 'robust' or 'minmax'")
    scale = F.when(scale == 0, F.lit(1.0)).otherwise(scale)
    return q.select("product", "feature", center.alias("center"), scale.alias("scale"))


def scaler_params(fitted: DataFrame, kind: str = "robust") -> DataFrame:
    """Fitted values in export form: centre and scale, or the min-max offset and factor."""
    if kind == "robust":
        return fitted.select("product", F.lit(kind).alias("scaler_type"), "feature", "center", "scale")
    return fitted.select(
        "product",
        F.lit(kind).alias("scaler_type"),
        "feature",
        (-F.col("center") / F.col("scale")).alias("min"),
        (1 / F.col("scale")).alias("scale"),
    )


def scale_transform(long: DataFrame, fitted: DataFrame, out: str = "scaled") -> DataFrame:
    """Features without a fitted row pass through unchanged."""
    j = long.join(fitted, ["product", "feature"], "left")
    return j.select(*long.columns, ((F.col("value") - _center()) / _scale()).alias(out))


def scale_inverse(long: DataFrame, fitted: DataFrame, col: str = "scaled", out: str = "value") -> DataFrame:
    j = long.join(fitted, ["product", "feature"], "left")
    keep = [c for c in long.columns if c != out]
    return j.select(*keep, (F.col(col) * _scale() + _center()).alias(out))


def _center():
    return F.coalesce("center", F.lit(0.0))


def _scale():
    return F.coalesce("scale", F.lit(1.0))


def encode_columns(wide: DataFrame, categorical, unknown: int = -1) -> DataFrame:
    """Fit and apply codes in one pass over a wide table with a ``split`` column.

    The training categories of a column are a window aggregate over the product's rows (at
    most one per month), so a code is a position in a sorted array: no join, no shuffle
    beyond the placement by product.
    """
    w = W.partitionBy("product")

    def code(c):
        seen = F.array_sort(F.collect_set(F.when(F.col("split") == "train", F.col(c))).over(w))
        place = F.array_position(seen, F.col(c)).cast("int")
        return F.when(place > 0, place - 1).when(place == 0, F.lit(unknown)).cast("double")

    return wide.withColumns({c: code(c) for c in categorical}) if categorical else wide


def scale_columns(wide: DataFrame, names, kind: str = "robust") -> DataFrame:
    """Fit and apply the scaling in one pass, as window aggregates over the training rows."""
    w = W.partitionBy("product")

    def scaled(c):
        x = F.when(F.col("split") == "train", F.col(c))
        if kind == "robust":
            q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w)
            center, width = q[1], q[2] - q[0]
        elif kind == "minmax":
            center, width = F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w)
        else:
            raise ValueError(f"unknown scaler {kind!r}: use 'robust' or 'minmax'")
        return (F.col(c) - F.coalesce(center, F.lit(0.0))) / F.coalesce(F.nullif(width, F.lit(0.0)), F.lit(1.0))

    return wide.withColumns({c: scaled(c) for c in names})


def encode_and_scale(wide: DataFrame, categorical=(), numeric=(), scaler: str | None = None) -> DataFrame:
    """Encode, then optionally scale, the named columns of a wide table; the target is untouched.

    As the codes are numeric by then, scaling applies to them as well.
    """
    doubles = {c: F.col(c).cast("double") for c in numeric}
    out = encode_columns(wide.withColumns(doubles) if doubles else wide, categorical)
    names = [*categorical, *numeric]
    return scale_columns(out, names, scaler) if scaler and names else out
