"""Bringing feature tables, parameters and other products' demand to a series."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthloom.functions.expressions import normalize_name, starts_with_any
from monthloom.operators.screening import split_label


def feature_prefix_match(columns: DataFrame, products: DataFrame) -> DataFrame:
    """Assign feature-store columns ``<product>_<feature>`` to products.

    ``columns`` has one row per column name, ``products`` one per product.  Every prefix
    of a name that ends at an underscore is a candidate key, so the match is an equi-join
    on the prefix instead of a comparison of all names with all products.  The longest
    prefix wins, and it is stripped once.
    """
    cuts = F.transform(
        F.sequence(F.lit(1), F.size("_parts") - 1),
        lambda k: F.struct(
            F.array_join(F.slice("_parts", 1, k), "_").alias("prefix"),
            F.array_join(F.slice("_parts", k + 1, F.size("_parts")), "_").alias("feature"),
        ),
    )
    candidates = (
        columns.select("column", F.split("column", "_").alias("_parts"))
        .filter(F.size("_parts") > 1)
        .select("column", F.explode(cuts).alias("c"))
        .select("column", "c.prefix", "c.feature")
    )
    named = products.select("product", normalize_name(F.col("product")).alias("prefix"))
    hits = candidates.join(named, "prefix").filter(F.col("feature") != "")
    longest = F.row_number().over(W.partitionBy("column").orderBy(F.length("prefix").desc(), "product"))
    return hits.withColumn("_rn", longest).filter(F.col("_rn") == 1).select("product", "column", "feature")


def select_features(features: DataFrame, allowed: DataFrame) -> DataFrame:
    """Keep the listed features of products that have a list, all features of the others."""
    listed = allowed.select("product").distinct().withColumn("_listed", F.lit(True))
    hit = allowed.select("product", "feature").distinct().withColumn("_hit", F.lit(True))
    return (
        features.join(listed, "product", "left")
        .join(hit, ["product", "feature"], "left")
        .filter(F.col("_listed").isNull() | F.col("_hit"))
        .drop("_listed", "_hit")
    )


def feature_kinds(names: DataFrame, prefixes) -> DataFrame:
    kind = F.when(starts_with_any(F.col("feature"), prefixes), "categorical").otherwise("numeric")
    return names.withColumn("kind", kind)


def join_features(demand: DataFrame, features: DataFrame) -> DataFrame:
    """Demand rows with the feature columns of the same product and month."""
    return demand.join(features, ["product", "ds"], "left")


def split_with_features(demand: DataFrame, features: DataFrame, val: int = 12, test: int = 12, window: int = 60):
    """Attach features (never a second target) and label the splits."""
    usable = features.drop(*[c for c in ("y", "demand") if c in features.columns])
    return split_label(join_features(demand, usable), val, test, window)


def cross_product(demand: DataFrame, partners: DataFrame, slots, lag: int = 0) -> DataFrame:
    """For each row, the demand of the product's partners in that month as ``other_<slot>``.

    ``partners(product, slot, other)`` names who stands in which of the ``slots``; a product is no
    partner of its own, and an empty slot is NULL.  The width is the number of slots, however many
    products there are, and column names do not depend on labels.  ``lag`` shifts the others' demand back in time.
    """
    pairs = partners.select("product", "slot", "other").distinct()
    theirs = partner_demand(demand, pairs.select("product", "other").distinct(), lag)
    wide = (
        theirs.join(pairs, ["product", "other"])
        .groupBy("product", "ds")
        .pivot("slot", list(slots))
        .agg(F.max("other_y"))
        .select("product", "ds", *[F.col(f"`{k}`").alias(f"other_{k}") for k in slots])
    )
    return demand.join(wide, ["product", "ds"], "left").select("product", "ds", "y", *[f"other_{k}" for k in slots])


def partner_demand(demand: DataFrame, partners: DataFrame, lag: int = 0) -> DataFrame:
    """Long form for chosen pairs: ``partners(product, other)`` -> ``product, ds, other, other_y``.

    The demand of the partner is fetched by an equi-join on partner and month, which
    spreads even a partner shared by most products over its months.
    """
    pairs = partners.filter(F.col("product") != F.col("other"))
    months = demand.select("product", "ds").join(pairs, "product")
    theirs = demand.select(
        F.col("product").alias("other"), F.add_months("ds", lag).alias("ds"), F.col("y").alias("other_y")
    )
    return months.join(theirs, ["other", "ds"], "left").select("product", "ds", "other", "other_y")


def align_by_position(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """Pair the k-th prediction with the k-th actual; the actual's date is kept."""
    return predictions.drop("ds").join(actuals.select("product", "step", "ds", "y"), ["product", "step"])


def models_with_both(metrics: DataFrame, predictions: DataFrame) -> DataFrame:
    return metrics.join(predictions.select("product", "model").distinct(), ["product", "model"], "left_semi")


def complete_weights(forecast_models: DataFrame, weights: DataFrame) -> DataFrame:
    """Every forecasting model gets a weight; 0.0 if it was left out."""
    return (
        forecast_models.select("product", "model")
        .distinct()
        .join(weights, ["product", "model"], "left")
        .select("product", "model", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    )


def resolve_params(wanted: DataFrame, saved: DataFrame, config: DataFrame) -> DataFrame:
    """What each (product, model) should run with.

    ``config(model, optimize, defaults_json)``.  Tuning takes precedence; otherwise the
    saved parameters, else the configured defaults, else nothing.
    """
    j = wanted.join(config, "model", "left").join(saved, ["product", "model"], "left")
    tune = F.coalesce("optimize", F.lit(False))
    origin = (
        F.when(tune, "tune")
        .when(F.col("params_json").isNotNull(), "saved")
        .when(F.col("defaults_json").isNotNull(), "defaults")
        .otherwise("none")
    )
    params = F.when(~tune, F.coalesce("params_json", "defaults_json"))
    return j.select("product", "model", origin.alias("origin"), params.alias("params_json"))


def grid_cross(series: DataFrame, candidates: Column, name: str = "candidate") -> DataFrame:
    """One row per series and candidate; the candidates are a literal array, so nothing is joined."""
    return series.select("*", F.posexplode(candidates).alias("candidate_id", name))
