"""Metrics, weights, blends and report tables, on backtests of the two autoregressions."""

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks.q_flagship import outlook
from checks.q_sources import SAVED, saved_params
from checks.registry import final, query
from checks.tables import SUPPLIER, bounds, supplier, supplier_raw
from monthloom.operators import blending, joins, metrics, reports
from monthloom.operators.calendar import unpack
from monthloom.sources import store

TWO = ("AR1", "ARI1")
RUN = SUPPLIER + "," + S.outlook("supplier_d", hw=False)


def two(spark, sf):
    return outlook(spark, sf, TWO)


def of_pairs(expr: str) -> str:
    return final(RUN + f",\nt AS (SELECT product, model, {expr} AS v FROM pairs GROUP BY 1, 2)", "t", "product model v:f")


def by_key(spark, sf, measure):
    return two(spark, sf).pairs.groupBy("product", "model").agg(measure.alias("v"))


@query("rmse", of_pairs("sqrt(avg((y - yhat) ** 2))"))
def q_rmse(spark, sf):
    return by_key(spark, sf, metrics.rmse_of())


@query("mape", of_pairs("coalesce(avg(abs((y - yhat) / nullif(y, 0))), 0)"))
def q_mape(spark, sf):
    return by_key(spark, sf, metrics.mape_of())


@query("mae", of_pairs("avg(abs(y - yhat))"))
def q_mae(spark, sf):
    return by_key(spark, sf, metrics.mae_of())


@query("mape_eps", of_pairs("avg(abs((y - yhat) / (y + 1e-8)))"))
def q_mape_eps(spark, sf):
    return by_key(spark, sf, metrics.mape_eps_of())


@query("evaluate_all", final(RUN, "met", "product model rmse:f mape:f mae:f"))
def q_evaluate_all(spark, sf):
    return metrics.evaluate_all(two(spark, sf).pairs, strict=True)


@query("backtest", final(RUN, "pairs", "product model step:i ds:d y:f yhat:f"))
def q_backtest(spark, sf):
    return two(spark, sf).pairs


@query("refit_forecast", final(RUN, "fc", "product model step:i ds:d yhat:f"))
def q_refit(spark, sf):
    return two(spark, sf).forecasts


@query("run_metrics", final(RUN, "met", "product model rmse:f mape:f mae:f"))
def q_run_metrics(spark, sf):
    return two(spark, sf).metrics


AGG = ", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std" for m in ("rmse", "mape", "mae"))


@query("aggregate_metrics", final(RUN + f",\nt AS (SELECT model, {AGG} FROM met GROUP BY 1)", "t", "model " + " ".join(f"{m}_{s}:f" for m in ("rmse", "mape", "mae") for s in ("mean", "std"))))
def q_aggregate(spark, sf):
    return metrics.aggregate_metrics(two(spark, sf).metrics)


@query("inverse_mape_weights", final(RUN, "wt", "product model mape:f weight:f used:i"))
def q_weights(spark, sf):
    return blending.inverse_mape_weights(two(spark, sf).metrics, 0.5, 3, TWO)


# error levels around the threshold, zeros included: whole and fractional parts of brand-month demand
LEVELS = """
lv AS (SELECT p_brand AS product, p_type AS model, CAST((sum(p_size) % 100) AS DOUBLE) / 100 AS mape FROM part GROUP BY 1, 2)"""


def levels(spark, sf):
    from checks.tables import read

    share = (F.sum("p_size") % 100).cast("double") / 100
    return read(spark, sf, "part").groupBy(F.col("p_brand").alias("product"), F.col("p_type").alias("model")).agg(share.alias("mape"))


@query("inverse_mape_weights_cut", final(LEVELS + "," + S.weights("lv", "t", threshold=0.4, cap=2), "t", "product model mape:f weight:f used:i"))
def q_weights_cut(spark, sf):
    return blending.inverse_mape_weights(levels(spark, sf), 0.4, 2)


@query("inverse_mape_weights_equal", final(LEVELS + "," + S.weights("lv", "t", threshold=0.0, cap=2), "t", "product model mape:f weight:f used:i"))
def q_weights_equal(spark, sf):
    return blending.inverse_mape_weights(levels(spark, sf), 0.0, 2)


@query("top_models", final(LEVELS, "(SELECT product, model, mape, row_number() OVER (PARTITION BY product ORDER BY mape, model) AS rank FROM lv QUALIFY rank <= 3)", "product model mape:f rank:i"))
def q_top_models(spark, sf):
    return blending.top_models(levels(spark, sf), 3)


@query("models_with_both", final(LEVELS + ", f AS (SELECT DISTINCT p_brand AS product, p_type AS model FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R')", "(SELECT lv.* FROM lv JOIN f USING (product, model))", "product model mape:f"))
def q_models_with_both(spark, sf):
    """The right side: models of which something was returned."""
    from checks.tables import read

    back = read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    j = read(spark, sf, "part").join(back, "p_partkey", "left_semi")
    return joins.models_with_both(levels(spark, sf), j.select(F.col("p_brand").alias("product"), F.col("p_type").alias("model")))


@query("complete_weights", final(LEVELS + "," + S.weights("lv", "w", threshold=0.4, cap=2) + ", t AS (SELECT lv.product, lv.model, coalesce(weight, 0.0) AS weight FROM lv LEFT JOIN w ON w.product = lv.product AND w.model = lv.model)", "t", "product model weight:f"))
def q_complete_weights(spark, sf):
    lv = levels(spark, sf)
    return joins.complete_weights(lv, blending.inverse_mape_weights(lv, 0.4, 2))


# forecasts of unequal length: ARI1 loses its last steps for some products
SHORT = RUN + ",\nfc2 AS (SELECT * FROM fc WHERE NOT (model = 'ARI1' AND step > 9 AND (ends_with(product, '2') OR ends_with(product, '4')))), " + S.combine("fc2", "wt", "t")


def shortened(o):
    lost = (F.col("model") == "ARI1") & (F.col("step") > 9) & (F.col("product").endswith("2") | F.col("product").endswith("4"))
    return o.forecasts.filter(~lost)


@query("ensemble_combine", final(SHORT, "t", "product step:i ds:d yhat:f"))
def q_combine(spark, sf):
    o = two(spark, sf)
    return blending.ensemble_combine(shortened(o), o.weights)


@query(
    "evaluate_ensemble",
    final(
        RUN + """,
bl AS (SELECT p.product, p.step, sum(weight * p.yhat) AS yhat FROM pairs p JOIN wt ON wt.product = p.product AND wt.model = p.model WHERE p.step <= 10 GROUP BY 1, 2),
pr AS (SELECT bl.product, 'x' AS model, t.y, bl.yhat FROM bl JOIN test_rows t ON t.product = bl.product AND t.step = bl.step)""" + "," + S.metrics("pr", "t"),
        "t",
        "product rmse:f mape:f mae:f",
    ),
)
def q_evaluate_ensemble(spark, sf):
    o = two(spark, sf)
    blend = blending.ensemble_combine(o.pairs.filter("step <= 10").drop("y"), o.weights)
    actual = o.pairs.select("product", "step", "y").distinct()
    return blending.evaluate_ensemble(blend, actual)


@query(
    "ensemble_record",
    final(
        RUN + """,
u AS (SELECT product, arg_min(mape, used) AS first_model_mape, string_agg(model, ',' ORDER BY used) AS models_used FROM wt GROUP BY 1),
t AS (SELECT e.product, e.ds, e.yhat, first_model_mape, models_used, w.model, w.weight FROM ens e JOIN u ON u.product = e.product JOIN wt w ON w.product = e.product)""",
        "t",
        "product ds:d yhat:f first_model_mape:f models_used model weight:f",
    ),
)
def q_record(spark, sf):
    o = two(spark, sf)
    r = blending.ensemble_record(o.ensemble, o.weights)
    flat = r.select("product", "first_model_mape", F.array_join("models_used", ",").alias("models_used"), "weights", F.explode("forecast").alias("ds", "yhat"))
    return flat.select("product", "ds", "yhat", "first_model_mape", "models_used", F.explode("weights").alias("model", "weight"))


@query(
    "align_by_position",
    final(RUN + ",\nt AS (SELECT f.product, f.model, f.step, r.ds, f.yhat, r.y FROM fc f JOIN test_rows r ON r.product = f.product AND r.step = f.step)", "t", "product model step:i ds:d yhat:f y:f"),
)
def q_align(spark, sf):
    o = two(spark, sf)
    actual = o.pairs.filter("model = 'AR1'").select("product", "step", "ds", "y")
    return joins.align_by_position(o.forecasts, actual)


CONFIG = """
cfg AS (SELECT * FROM (VALUES ('SARIMA', false, '{"order":[1,1,1]}'), ('HoltWinters', false, NULL), ('Prophet', true, '{"a":1}')) v(model, optimize, defaults_json)),
wanted AS (SELECT DISTINCT 'Supplier ' || l_suppkey AS product, model FROM lineitem, (SELECT unnest(['SARIMA', 'HoltWinters', 'Prophet']) AS model)),
t AS (SELECT w.product, w.model,
  CASE WHEN coalesce(optimize, false) THEN 'tune' WHEN l.params_json IS NOT NULL THEN 'saved' WHEN defaults_json IS NOT NULL THEN 'defaults' ELSE 'none' END AS origin,
  CASE WHEN NOT coalesce(optimize, false) THEN coalesce(l.params_json, defaults_json) END AS params_json
  FROM wanted w LEFT JOIN cfg c ON c.model = w.model LEFT JOIN late l ON l.product = w.product AND l.model = w.model)"""


@query("resolve_params", final(SAVED + ",\nlate AS (SELECT * FROM latest WHERE NOT ends_with(product, '1'))," + CONFIG, "t", "product model origin params_json"))
def q_resolve(spark, sf):
    config = spark.createDataFrame(
        [("SARIMA", False, '{"order":[1,1,1]}'), ("HoltWinters", False, None), ("Prophet", True, '{"a":1}')],
        "model string, optimize boolean, defaults_json string",
    )
    names = F.explode(F.array(F.lit("SARIMA"), F.lit("HoltWinters"), F.lit("Prophet"))).alias("model")
    wanted = supplier_raw(spark, sf).select("product").distinct().select("product", names)
    saved = store.param_store_latest(saved_params(spark, sf)).filter(~F.col("product").endswith("1")).drop("run_ts")
    return joins.resolve_params(wanted, saved, config)


# ------------------------------------------------------------------------- report tables

COLS = [f"{m}_{x}" for m in sorted(TWO) for x in ("MAE", "MAPE", "RMSE")]
SUMMARY = ", ".join(f"max(CASE WHEN model = '{c.split('_')[0]}' THEN {c.split('_')[1].lower()} END) AS \"{c}\"" for c in COLS)
MEANS = ", ".join(f"avg(\"{c}\") AS \"{c}\"" for c in COLS)


@query("metrics_summary", final(RUN + f",\ns AS (SELECT product, {SUMMARY} FROM met GROUP BY 1), t AS (SELECT * FROM s UNION ALL SELECT 'AGGREGATE', {MEANS} FROM s)", "t", "product " + " ".join(f"{c}:f" for c in COLS)))
def q_summary(spark, sf):
    return reports.metrics_summary(two(spark, sf).metrics, TWO)


DETAIL = ", ".join(
    f"max(CASE WHEN model = '{m}' THEN yhat END) AS \"{m}_Pred\", max(CASE WHEN model = '{m}' THEN abs((y - yhat) / nullif(y, 0)) END) AS \"{m}_MAPE\"" for m in TWO
)


@query("monthly_detail", final(RUN + f",\nt AS (SELECT product, strftime(ds, '%Y-%m') AS \"Month\", max(y) AS \"Actual\", {DETAIL} FROM pairs GROUP BY 1, 2)", "t", "product Month Actual:f " + " ".join(f"{m}_{x}:f" for m in TWO for x in ("Pred", "MAPE"))))
def q_detail(spark, sf):
    return reports.monthly_detail(two(spark, sf).pairs, TWO)


def future_months(spark, sf):
    """Labels of the twelve months after the calendar ends (one row collected)."""
    hi = bounds(spark, sf).select("b.hi").first()["hi"]
    at = hi.year * 12 + hi.month - 1
    return [f"{(at + k) // 12}-{(at + k) % 12 + 1:02d}" for k in range(1, 13)]


# the twelve months that follow the last month of the tables
MONTHS = [f"{2001 + (10 + k) // 12}-{(10 + k) % 12 + 1:02d}" for k in range(1, 13)]
PIVOT = ", ".join(f"max(CASE WHEN strftime(ds, '%Y-%m') = '{m}' THEN yhat END) AS \"{m}\"" for m in MONTHS)
MONTH_COLS = " ".join(f"{m}:f" for m in MONTHS)


@query(
    "ensemble_wide",
    final(
        RUN + f""",
u AS (SELECT product, arg_min(mape, used) AS "Ensemble_MAPE", string_agg(model, ',' ORDER BY used) AS "Models_Used",
      string_agg(model || ':' || printf('%.3f', weight), ', ' ORDER BY used) AS "Weights" FROM wt GROUP BY 1),
m AS (SELECT product, {PIVOT} FROM ens GROUP BY 1), t AS (SELECT * FROM m JOIN u USING (product))""",
        "t",
        f"product {MONTH_COLS} Ensemble_MAPE:f Models_Used Weights",
    ),
)
def q_ensemble_wide(spark, sf):
    o = two(spark, sf)
    return reports.ensemble_wide(o.ensemble, o.weights, future_months(spark, sf))


@query("model_forecast_wide", final(RUN + f",\nt AS (SELECT model, product, {PIVOT} FROM fc GROUP BY 1, 2)", "t", f"model product {MONTH_COLS}"))
def q_model_wide(spark, sf):
    return reports.model_forecast_wide(two(spark, sf).forecasts, future_months(spark, sf))


@query(
    "report_comparison",
    final(RUN + ",\nt AS (SELECT p.product, ds, y, yhat, p.model || printf(' (MAPE: %.1f%%)', 100 * mape) AS label FROM pairs p JOIN met ON met.product = p.product AND met.model = p.model)", "t", "product ds:d y:f yhat:f label"),
)
def q_comparison(spark, sf):
    o = two(spark, sf)
    return reports.report_comparison(o.pairs, o.metrics)


@query(
    "report_forecast",
    final(
        RUN + """,
h AS (SELECT product, ds, 'history' AS line, clean AS value FROM sp WHERE i >= n - 36),
l AS (SELECT f.product, f.ds, f.model || printf(' (%.1f%%)', coalesce(weight, 0) * 100) AS line, yhat AS value FROM fc f LEFT JOIN wt ON wt.product = f.product AND wt.model = f.model),
e AS (SELECT product, ds, 'ensemble' AS line, yhat AS value FROM ens),
t AS (SELECT *, CASE WHEN line = 'ensemble' THEN value * 0.9 END AS band_lo, CASE WHEN line = 'ensemble' THEN value * 1.1 END AS band_hi FROM (SELECT * FROM h UNION ALL SELECT * FROM l UNION ALL SELECT * FROM e))""",
        "t",
        "product ds:d line value:f band_lo:f band_hi:f",
    ),
)
def q_report_forecast(spark, sf):
    o = two(spark, sf)
    history = unpack(o.extras["packed"]).drop("i")
    return reports.report_forecast(history, o.forecasts, o.ensemble, o.weights)


SUMMARY_JSON = RUN + ",\nt AS (SELECT product, model, round(mape, 9) AS mape, 'supply' AS project, '12' AS horizon, '1' AS d, 'true' AS retrained, '3' AS trials FROM met)"


@query("run_summary_json", final(SUMMARY_JSON, "t", "product model mape:f project horizon d retrained trials"))
def q_run_summary(spark, sf):
    """The record's JSON, taken apart again."""
    o = two(spark, sf)
    params = o.metrics.select("product", "model", F.lit('{"d":1}').alias("params_json"), F.lit(True).alias("retrained"), F.lit(3).alias("trials"))
    s = store.run_summary(o.metrics, "supply", "20011101_000000", "2001-11-01T00:00:00", {"horizon": 12}, params)
    part = {"project": F.to_json("run_info").alias("info"), "horizon": F.to_json("config").alias("config")}
    flat = s.select("product", *part.values(), F.explode("models").alias("model", "record"))
    field = {"d": "$.params.d", "retrained": "$.retrained", "trials": "$.optuna_trials_used"}
    return flat.select(
        "product",
        "model",
        F.get_json_object("record", "$.metrics.backtest.mape").cast("double").alias("mape"),
        F.get_json_object("info", "$.project_name").alias("project"),
        F.get_json_object("config", "$.horizon").alias("horizon"),
        *[F.get_json_object("record", path).alias(name) for name, path in field.items()],
    )


SUMMARY_READ = RUN + ",\nt AS (SELECT product, model, round(mape, 9) AS mape, 'supply' AS project FROM met)"


@query("run_summary_read", final(SUMMARY_READ, "t", "product model mape:f project"))
def q_run_summary_read(spark, sf):
    """Written as JSON lines into the shared folder, read back, and taken apart."""
    from checks.q_sources import fresh_folder

    o = two(spark, sf)
    path = fresh_folder(spark, "run-summary")
    store.run_summary_json(store.run_summary(o.metrics, "supply", "20011101_000000", "2001-11-01T00:00:00"), path)
    back = store.run_summary_read(spark, path)
    flat = back.select("product", F.col("run_info.project_name").alias("project"), F.explode("models").alias("model", "record"))
    mape = F.get_json_object("record", "$.metrics.backtest.mape").cast("double")
    return flat.select("product", "model", mape.alias("mape"), "project")


@query("write_reports", final(RUN + f",\nt AS (SELECT model, product, {PIVOT} FROM fc GROUP BY 1, 2)", "t", f"model product {MONTH_COLS}"))
def q_write_reports(spark, sf):
    """The per-model tables written one folder per model, and read back."""
    from checks.q_sources import fresh_folder

    path = fresh_folder(spark, "forecasts")
    wide = reports.model_forecast_wide(two(spark, sf).forecasts, future_months(spark, sf))
    store.write_report(wide, path, "parquet", "model")
    return spark.read.parquet(path)


@query(
    "component_summary",
    final(SUPPLIER + "," + S.indexed("supplier_d", "x") + """,
co AS (SELECT product, 'level' AS component, y AS value FROM x UNION ALL SELECT product, 'position', CAST(i AS DOUBLE) FROM x),
t AS (SELECT component, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, max(value) - min(value) AS range FROM co GROUP BY 1)""", "t", "component mean:f std:f min:f max:f range:f"),
)
def q_component_summary(spark, sf):
    from monthloom.operators.calendar import pack

    rows = unpack(pack(supplier(spark, sf)))
    long = rows.select("product", F.col("y").alias("level"), F.col("i").cast("double").alias("position")).unpivot(
        ["product"], ["level", "position"], "component", "value"
    )
    return metrics.component_summary(long)
