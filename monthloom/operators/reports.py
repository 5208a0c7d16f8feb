"""Report tables: what the result sheets and figures are made of."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthloom.functions.expressions import ape
from monthloom.operators.calendar import history_tail

METRICS = ("rmse", "mape", "mae")


def metrics_summary(metrics: DataFrame, models) -> DataFrame:
    """One row per product, columns ``<MODEL>_<METRIC>`` in name order, and an AGGREGATE row
    with the mean of the values present.  Both levels come from one grouping-sets pass."""
    long = metrics.unpivot(["product", "model"], list(METRICS), "metric", "v").select(
        "product", F.concat_ws("_", "model", F.upper("metric")).alias("mm"), "v"
    )
    both = long.groupingSets([[F.col("product"), F.col("mm")], [F.col("mm")]], "product", "mm").agg(
        F.avg("v").alias("v"), F.grouping("product").alias("_g")
    )
    names = sorted(f"{m}_{x.upper()}" for m in models for x in METRICS)
    label = F.when(F.col("_g") == 1, "AGGREGATE").otherwise(F.col("product"))
    return both.withColumn("product", label).groupBy("product").pivot("mm", names).agg(F.first("v"))


def monthly_detail(pairs: DataFrame, models) -> DataFrame:
    """Per product and month: actual, and each model's prediction and share error."""
    cells = pairs.select(
        "product", "ds", "y", "model", "yhat", ape(F.col("y"), F.col("yhat")).alias("err")
    )
    wide = cells.groupBy("product", "ds").pivot("model", list(models)).agg(
        F.first("yhat").alias("Pred"), F.first("err").alias("MAPE"), F.first("y").alias("y")
    )
    actual = F.coalesce(*[F.col(f"{m}_y") for m in models])
    cols = [F.col(f"{m}_{x}") for m in models for x in ("Pred", "MAPE")]
    return wide.select("product", F.date_format("ds", "yyyy-MM").alias("Month"), actual.alias("Actual"), *cols)


def _months_wide(forecasts: DataFrame, months, keys) -> DataFrame:
    labelled = forecasts.withColumn("_m", F.date_format("ds", "yyyy-MM"))
    return labelled.groupBy(*keys).pivot("_m", list(months)).agg(F.first("yhat"))


def month_labels(forecasts: DataFrame) -> list[str]:
    """The distinct months of a forecast table: a handful, whatever the number of products."""
    rows = forecasts.select(F.date_format("ds", "yyyy-MM").alias("m")).distinct().sort("m").collect()
    return [r["m"] for r in rows]


def ensemble_wide(ensemble: DataFrame, weights: DataFrame, months) -> DataFrame:
    """One row per product: its months, the first model's MAPE, the models and their weights."""
    entries = F.array_sort(F.collect_list(F.struct("used", "mape", "model", "weight")))
    used = weights.groupBy("product").agg(entries.alias("_u"))
    text = F.transform("_u", lambda u: F.format_string("%s:%.3f", u["model"], u["weight"]))
    info = used.select(
        "product",
        F.col("_u")[0]["mape"].alias("Ensemble_MAPE"),
        F.array_join(F.transform("_u", lambda u: u["model"]), ",").alias("Models_Used"),
        F.array_join(text, ", ").alias("Weights"),
    )
    return _months_wide(ensemble, months, ["product"]).join(info, "product")


def model_forecast_wide(forecasts: DataFrame, months) -> DataFrame:
    """One row per model and product; write it with ``partitionBy('model')``."""
    return _months_wide(forecasts, months, ["model", "product"])


def report_cleaning(cleaned: DataFrame, labelled: DataFrame) -> DataFrame:
    """Original and cleaned values with the reason, the split, and padded axis limits."""
    w = W.partitionBy("product")
    lo = F.least(F.min("y").over(w), F.min("clean").over(w))
    hi = F.greatest(F.max("y").over(w), F.max("clean").over(w))
    pad = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) * 0.1).otherwise(1.0)
    j = cleaned.join(labelled.select("product", "ds", "split"), ["product", "ds"], "left")
    j = j.withColumn("_lo", lo).withColumn("_hi", hi)
    boundary = F.col("split") != F.lag("split").over(W.partitionBy("product").orderBy("ds"))
    return j.select(
        "product",
        "i",
        "ds",
        F.col("y").alias("original"),
        "clean",
        "reason",
        F.when(boundary, F.col("split")).alias("starts"),
        (F.col("_lo") - pad).alias("y_lo"),
        (F.col("_hi") + pad).alias("y_hi"),
    )


def report_comparison(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Test months with each model's line, labelled with its MAPE."""
    label = F.format_string("%s (MAPE: %.1f%%)", F.col("model"), F.col("mape") * 100)
    return pairs.join(metrics.select("product", "model", "mape"), ["product", "model"]).select(
        "product", "ds", "y", "yhat", label.alias("label")
    )


def report_forecast(history: DataFrame, forecasts: DataFrame, ensemble: DataFrame, weights: DataFrame, months: int = 36):
    """The last months of history, every model's line with its weight, and the blend with a 10% band."""
    past = history_tail(history, months).select(
        "product", "ds", F.lit("history").alias("line"), F.col("y").alias("value")
    )
    text = F.format_string("%s (%.1f%%)", F.col("model"), F.coalesce("weight", F.lit(0.0)) * 100)
    lines = forecasts.join(weights.select("product", "model", "weight"), ["product", "model"], "left").select(
        "product", "ds", text.alias("line"), F.col("yhat").alias("value")
    )
    blend = ensemble.select("product", "ds", F.lit("ensemble").alias("line"), F.col("yhat").alias("value"))
    out = past.unionByName(lines).unionByName(blend)
    band = F.col("line") == "ensemble"
    return out.withColumn("band_lo", F.when(band, F.col("value") * 0.9)).withColumn(
        "band_hi", F.when(band, F.col("value") * 1.1)
    )
