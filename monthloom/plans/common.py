"""Stages shared by the runs."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthloom.models.autoreg import ar_column, ar_path
from monthloom.models.regress import with_regression
from monthloom.models.sarima import sarima_path
from monthloom.models.smoothing import hw_column, hw_forecast_column, hw_resolved_column, hw_trial_scores
from monthloom.operators.blending import inverse_mape_weights
from monthloom.operators.calendar import last_n_window, unpack
from monthloom.operators.cleaning import clean_packed, clean_rows
from monthloom.operators.joins import complete_weights, resolve_params
from monthloom.operators.metrics import array_metrics
from monthloom.operators.screening import classify_filter, split_sizes
from monthloom.operators.tuning import smoothing_trials
from monthloom.settings import Settings
from monthloom.sources import store


class Extras(dict):
    """Further tables of a run.  One given as a function is put together when it is asked for, and then kept."""

    def __getitem__(self, name):
        value = super().__getitem__(name)
        if callable(value):
            value = self[name] = value()
        return value


@dataclass
class Outlook:
    """The tables a run produces; all of them are lazy."""

    cleaned: DataFrame
    pairs: DataFrame
    metrics: DataFrame
    forecasts: DataFrame
    weights: DataFrame
    ensemble: DataFrame
    params: DataFrame | None = None
    extras: Extras = field(default_factory=Extras)

    @property
    def complete_weights(self) -> DataFrame:
        return complete_weights(self.forecasts, self.weights)


def prepare(demand: DataFrame, s: Settings, screen: DataFrame | None = None) -> DataFrame:
    """classify -> window -> clean, in that order; packed, one row per product.

    All three steps work on the same partitioning by product.  ``screen`` may hold other
    values to classify by (for instance with gaps as zeros); its products are then kept.
    """
    if screen is None:
        kept = classify_filter(demand, s.lookback_months, s.min_nonzero_share)
    else:
        alive = classify_filter(screen, s.lookback_months, s.min_nonzero_share).select("product").distinct()
        kept = demand.join(alive, "product", "left_semi")
    return clean_packed(last_n_window(kept, s.window_months), s.outlier_multiplier)


def _autoreg(order: int):
    return (lambda ys, start, h, most: ar_column(ys, order)), (lambda fit, ys, h: ar_path(h, order, fit))


# name -> (fitted column from history, start, horizon and the longest horizon asked for,
#          or None for the regression, which is several columns;
#          ARRAY<DOUBLE> of forecasts from that column)
FORECASTERS = {
    "SARIMA": ((lambda ys, start, h, most: sarima_path(ys, h)), (lambda fit, ys, h: fit)),
    "HoltWinters": ((lambda ys, start, h, most: hw_column(ys)), (lambda fit, ys, h: hw_forecast_column(h, fit))),
    "AR1": _autoreg(0),
    "ARI1": _autoreg(1),
    "Prophet": (None, (lambda fit, ys, h: F.slice(fit["yhat"], F.size(ys) + 1, h))),
}


def split_arrays(packed: DataFrame, s: Settings, fit_on: str = "train+val") -> DataFrame:
    """Adds ``n_val, n_test``, the history ``head`` a backtest may see, and the ``actual`` test values."""
    val, test = split_sizes(F.col("n"), s.val_months, s.test_months)
    cut = F.col("n") - test
    head = cut if fit_on != "train" else cut - val
    return packed.withColumns(
        {
            "n_val": val,
            "n_test": test,
            "head": F.slice("ys", 1, F.greatest(head, F.lit(0))),
            "actual": F.slice("ys", cut + 1, test),
        }
    )


# models whose parameters can be given: how to fit with a struct of them, and its fields
GIVEN = {"HoltWinters": (hw_resolved_column, ("alpha", "beta", "gamma"))}


def with_params(df: DataFrame, models, saved: DataFrame | None, config: DataFrame, trials: int = 5) -> DataFrame:
    """Adds ``origin_<model>`` and the struct ``given_<model>`` for the models that take parameters.

    ``config(model, optimize, defaults_json)`` and ``saved(product, model, params_json)`` are resolved
    per product: searched on the history before the test months, else saved, else the
    configured defaults, else none.  One join by product for all models.
    """
    names = [m for m in models if m in GIVEN]
    if not names:
        return df
    wanted = df.select("product", F.explode(F.array(*[F.lit(m) for m in names])).alias("model"))
    if saved is None:
        saved = df.sparkSession.createDataFrame([], "product string, model string, params_json string")
    resolved = resolve_params(wanted, saved.select("product", "model", "params_json"), config)
    entry = F.struct("model", F.struct("origin", "params_json").alias("r"))
    per = resolved.groupBy("product").agg(F.map_from_entries(F.collect_list(entry)).alias("_params"))
    df = df.join(per, "product", "left")
    for m in names:
        r, fields = F.try_element_at("_params", F.lit(m)), GIVEN[m][1]
        text = F.struct(*[F.get_json_object(r["params_json"], f"$.{f}").try_cast("double").alias(f) for f in fields])
        df = smoothing_trials(df, trials).withColumn("_score", hw_trial_scores(F.col("head"), F.col("trials")))
        best = F.array_min(F.arrays_zip(F.col("_score").alias("s"), F.col("trials").alias("t")))["t"]
        found = F.struct(*[best[f].alias(f) for f in fields])
        df = df.withColumns({f"origin_{m}": r["origin"], f"given_{m}": F.when(r["origin"] == "tune", found).otherwise(text)})
        df = df.drop("trials", "_score")
    return df.drop("_params")


def params_used(fitted: DataFrame, models, trials: int) -> DataFrame:
    """``product, model, origin, params_json, retrained, trials`` of the final fits."""
    rows = [
        F.struct(F.lit(m).alias("model"), F.col(f"origin_{m}").alias("origin"), F.to_json(F.col(f"used_{m}")).alias("params_json"))
        for m in models
        if m in GIVEN
    ]
    empty = "array<struct<model:string,origin:string,params_json:string>>"
    long = fitted.select("product", F.inline(F.array(*rows) if rows else F.array().cast(empty)))
    tuned = F.col("origin") == "tune"
    return long.withColumns({"retrained": F.lit(True), "trials": F.when(tuned, trials).otherwise(0)})


def record_run(out, folder: str, run_ts: str, project: str, run_date: str, config: dict | None = None) -> None:
    """Appends the parameters of a run to ``<folder>/params`` and writes its record to ``<folder>/runs/<run_ts>``."""
    store.param_store_save(out.params.filter("params_json is not null"), f"{folder}/params", run_ts)
    summary = store.run_summary(out.metrics, project, run_ts, run_date, config, out.params)
    store.run_summary_json(summary, f"{folder}/runs/{run_ts}")


def fit_packed(df: DataFrame, s: Settings, models) -> DataFrame:
    """Adds ``bt_<model>`` (test months) and ``fc_<model>`` (future) to each product's row.

    Every model reads the arrays of the row it sits in, so backtests and refits of all
    models need no shuffle.
    """
    head, ys, start = F.col("head"), F.col("ys"), F.col("start")
    fits, paths, done, most = {}, {}, [], max(s.horizon, s.test_months)
    for m in models:
        fit, path = FORECASTERS[m]
        for tag, history, h in (("bt", head, F.col("n_test")), ("fc", ys, F.lit(s.horizon))):
            given = f"given_{m}" in df.columns
            if fit is None:
                df = with_regression(df, f"_{tag}_{m}", history, start, most)
                done.append(f"_{tag}_{m}")
            else:
                fits[f"_{tag}_{m}"] = GIVEN[m][0](history, F.col(f"given_{m}")) if given else fit(history, start, h, most)
            if given and tag == "fc":
                paths[f"used_{m}"] = F.struct(*[F.col(f"_fc_{m}")[f].alias(f) for f in GIVEN[m][1]])
            paths[f"{tag}_{m}"] = path(F.col(f"_{tag}_{m}"), history, h)
    # two projections whatever the number of models: first all fits, then all paths
    if fits:
        df = df.withColumns(fits)
    return df.withColumns(paths).drop(*fits, *done) if models else df


def model_rows(fitted: DataFrame, models) -> DataFrame:
    """One row per product and fitted model: ``actual, bt, fc`` arrays and the error measures.

    A model that could not be fitted has no row, so every row has both a backtest and a
    forecast.  The rows stay partitioned by product.
    """
    runs = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(f"bt_{m}").alias("bt"), F.col(f"fc_{m}").alias("fc")) for m in models]
    )
    test_at, future_at = F.add_months("start", F.col("n") - F.col("n_test")), F.add_months("start", F.col("n"))
    rows = fitted.select(
        "product", "actual", test_at.alias("test_at"), future_at.alias("future_at"), F.inline(runs)
    ).filter("bt is not null and fc is not null")
    return rows.withColumns(array_metrics(F.col("actual"), F.col("bt")))


def backtest_pairs(rows: DataFrame) -> DataFrame:
    """``product, model, step, ds, y, yhat`` over the test months."""
    z = F.arrays_zip(F.col("actual").alias("y"), F.col("bt").alias("yhat"))
    return rows.select("product", "model", "test_at", F.posexplode(z).alias("k", "z")).select(
        "product", "model", (F.col("k") + 1).alias("step"), F.add_months("test_at", F.col("k")).alias("ds"), "z.y", "z.yhat"
    )


def future_paths(rows: DataFrame, *keep: str) -> DataFrame:
    """``product, model, step, ds, yhat`` after the last month."""
    return rows.select("product", "model", *keep, "future_at", F.posexplode("fc").alias("k", "yhat")).select(
        "product", "model", *keep, (F.col("k") + 1).alias("step"), F.add_months("future_at", F.col("k")).alias("ds"), "yhat"
    )


def blend(cleaned: DataFrame, rows: DataFrame, s: Settings, models, **extras) -> Outlook:
    """Metrics, weights and the blended path from :func:`model_rows`, without joins.

    Weights are window expressions over the few rows of a product, and the blend groups by
    product and step, so everything keeps the partitioning the rows came with.
    """
    metrics = rows.select("product", "model", "rmse", "mape", "mae")
    weighted = inverse_mape_weights(rows, s.mape_threshold, s.max_models, models, keep=("fc", "future_at"))
    want = F.min_by(F.size("fc"), "used").over(W.partitionBy("product"))
    usable = weighted.withColumn("_want", want)
    counted = future_paths(usable.withColumn("_n", F.size("fc")), "weight", "_n", "_want")
    share = F.when(F.col("_n") == F.col("_want"), F.col("weight") * F.col("yhat")).otherwise(0.0)
    ensemble = (
        counted.filter(F.col("step") <= F.col("_want")).groupBy("product", "step", "ds").agg(F.sum(share).alias("yhat"))
    )
    return Outlook(
        cleaned, backtest_pairs(rows), metrics, future_paths(rows), weighted.drop("fc", "future_at"), ensemble, extras=Extras(extras)
    )


def cleaned_long(packed: DataFrame) -> DataFrame:
    return unpack(packed)


def cleaned_report(packed: DataFrame) -> DataFrame:
    return clean_rows(packed)
