"""Whole runs on the four synthetic patterns."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from monthloom.models.boosted import training_table
from monthloom.plans.multivariate import encoded_table, run_cross, run_default, run_features
from monthloom.plans.univariate import run_univariate
from monthloom.settings import Settings

SHORT = {"val_months": 6, "test_months": 6, "horizon": 6}
TREES = {"rounds": 4, "depth": 3}


def features_of(demand):
    promo = F.when(F.month("ds") % 4 == 0, "discount").when(F.month("ds") % 4 == 1, "bundle").otherwise("none")
    return demand.select("product", "ds", (50 + F.month("ds") % 5).cast("double").alias("price"), promo.alias("promo"))


def check(out, products, models, horizon):
    ens = out.ensemble.collect()
    assert len(ens) == products * horizon
    assert all(r["yhat"] is not None for r in ens)
    sums = out.weights.groupBy("product").agg(F.sum("weight").alias("s")).collect()
    assert len(sums) == products and all(r["s"] == pytest.approx(1) for r in sums)
    assert {r["model"] for r in out.metrics.collect()} == set(models)
    return {(r["product"], r["step"]): r["yhat"] for r in ens}


def test_univariate(spark, long, patterns):
    s = Settings(**SHORT)
    out = run_univariate(long(patterns | {"Dead": [0] * 60}), s, cache=True)
    path = check(out, 4, s.models, 6)
    assert path[("Trending", 1)] > 150 and path[("Declining", 1)] < 150
    assert out.metrics.filter("mape < 0.35").count() == 8
    assert out.complete_weights.count() == 8
    assert out.pairs.count() == 4 * 2 * 6


def test_fit_on_train_only_changes_the_backtest(spark, long, patterns):
    s = Settings(models=("AR1",), **SHORT)
    demand = long(patterns)
    late = run_univariate(demand, s).pairs.agg(F.sum("yhat")).first()[0]
    early = run_univariate(demand, s, fit_on="train").pairs.agg(F.sum("yhat")).first()[0]
    assert late != pytest.approx(early)


def test_short_series_are_forecast_too(spark, long):
    out = run_univariate(long({"s": [5, 6, 9, 8, 12, 10, 11, 14]}), Settings(models=("HoltWinters", "ARI1")))
    assert out.ensemble.count() == 12


def test_features(spark, long, patterns):
    demand = long(patterns)
    s = Settings(models=("XGBoost", "Prophet"), scaler="robust", **SHORT)
    out = run_features(demand, features_of(demand), ["promo"], ["price"], s, tree_options=TREES)
    check(out, 4, s.models, 6)
    shares = out.extras["ensemble_importance"].groupBy("product").agg(F.sum("pct").alias("s")).collect()
    assert len(shares) == 4 and all(r["s"] == pytest.approx(100, abs=0.5) for r in shares)
    with pytest.raises(ValueError):
        run_features(demand, None)


def test_cross(spark, long, patterns):
    demand = long(patterns)
    pairs = [("Trending", 1, "Seasonal"), ("Seasonal", 1, "Trending"), ("Seasonal", 2, "Declining")]
    partners = spark.createDataFrame(pairs, "product string, slot int, other string")
    s = Settings(models=("Prophet",), **SHORT)
    out = run_cross(demand, features_of(demand), partners, [1, 2], ["promo"], ["price"], s)
    check(out, 4, ["Prophet"], 6)
    named = {r["feature"] for r in out.extras["importances"].select("feature").distinct().collect()}
    assert named == {"other_1", "other_2", "price", "promo"}


def test_nothing_left_to_forecast(long):
    with pytest.raises(ValueError, match="forecastable"):
        run_features(long({"dead": [0] * 60}), features_of(long({"dead": [0] * 60})), ["promo"], ["price"])


def test_missing_features_are_left_out_of_training(spark, long, patterns):
    demand = long(patterns)
    gaps = features_of(demand).withColumn("price", F.when(F.month("ds") % 2 == 0, F.col("price")))
    table = encoded_table(demand, gaps, ["promo"], ["price"], Settings(**SHORT))
    assert table.filter("price is null").count() == 4 * 30
    known = training_table(table.select("product", "ds", "y", "promo", "price"))
    assert known.count() > 0 and known.filter(F.month("ds") % 2 == 1).count() == 0


def test_default(spark, long, patterns):
    demand = long(patterns)
    models = ("HoltWinters", "Prophet", "XGBoost", "SARIMA")
    out = run_default(demand, features_of(demand), ["promo"], ["price"], Settings(models=models, **SHORT), tree_options=TREES)
    check(out, 4, models, 6)
    assert out.weights.groupBy("product").count().agg(F.max("count")).first()[0] <= 3


def test_parameters_are_searched_saved_and_used_again(spark, long, patterns):
    from monthloom.plans.common import record_run
    from monthloom.session import shared_folder
    from monthloom.sources import store

    demand, s = long(patterns), Settings(models=("HoltWinters", "ARI1"), **SHORT)
    kind = "model string, optimize boolean, defaults_json string"
    first = run_univariate(demand, s, config=spark.createDataFrame([("HoltWinters", True, None)], kind))
    used = {r["product"]: r for r in first.params.collect()}
    assert len(used) == 4 and {r["origin"] for r in used.values()} == {"tune"} and {r["trials"] for r in used.values()} == {5}
    folder = f"{shared_folder(spark)}/params-{uuid.uuid4().hex}"
    record_run(first, folder, "20200101_000000", "tests", "2020-01-01")
    saved = store.param_store_latest(store.param_store_read(spark, f"{folder}/params"))
    again = run_univariate(demand, s, params=saved, config=spark.createDataFrame([("HoltWinters", False, None)], kind))
    assert {r["origin"] for r in again.params.collect()} == {"saved"}
    path = lambda o: {(r["product"], r["model"], r["step"]): r["yhat"] for r in o.forecasts.collect()}
    assert path(again) == pytest.approx(path(first))
    assert store.run_summary_read(spark, f"{folder}/runs/20200101_000000").count() == 4
    plain = run_univariate(demand, s, config=spark.createDataFrame([("HoltWinters", False, None)], kind))
    assert {r["origin"] for r in plain.params.collect()} == {"none"}
    assert path(plain) == pytest.approx(path(run_univariate(demand, s)))


def test_modes_searches_and_switches_of_trees(spark, long, patterns):
    demand = long(patterns)
    feats = features_of(demand)
    s = Settings(models=("XGBoost",), **SHORT)
    pooled = run_features(demand, feats, ["promo"], ["price"], s, tree_options=TREES, product_mode="multi_product")
    check(pooled, 4, ["XGBoost"], 6)
    assert {r["imp_type"] for r in pooled.extras["importances"].select("imp_type").distinct().collect()} == {"builtin"}
    with pytest.raises(ValueError, match="product_mode"):
        run_features(demand, feats, ["promo"], ["price"], s, product_mode="all")

    space = {
        "n_estimators": ("int", 4, 8), "max_depth": ("int", 1, 3), "learning_rate": ("float", 0.1, 0.5), "min_child_weight": ("int", 1, 3),
        "subsample": ("float", 0.7, 1.0), "colsample_bytree": ("float", 0.7, 1.0),
    }
    tuned = run_features(demand, feats, ["promo"], ["price"], s, tree_trials=4, tree_space=space)
    check(tuned, 4, ["XGBoost"], 6)
    used = {r["product"]: json.loads(r["params_json"]) for r in tuned.params.collect()}
    assert len(used) == 4 and all(4 <= u["rounds"] <= 8 and 1 <= u["depth"] <= 3 for u in used.values())

    kinds = lambda o: {r["imp_type"] for r in o.extras["importances"].select("imp_type").distinct().collect()}
    own = run_features(demand, feats, ["promo"], ["price"], s, tree_options=TREES)
    assert kinds(own) == {"builtin", "shap"}
    plain = run_features(demand, feats, ["promo"], ["price"], Settings(models=("XGBoost", "Prophet"), shap=False, **SHORT), tree_options=TREES)
    assert kinds(plain) == {"builtin", "regressor_coefficients", "permutation"}
    off = run_features(demand, feats, ["promo"], ["price"], Settings(models=("XGBoost",), importance=False, **SHORT), tree_options=TREES)
    assert off.extras["importances"].isEmpty()


def test_trees_stay_in_the_pass_that_grows_them(spark, long, patterns):
    """The backtest's and the final trees were columns of the plan, and importances grew the final ones twice more."""
    demand = long({k: patterns[k] for k in ("Trending", "Seasonal")})
    s = Settings(models=("XGBoost", "Prophet"), **SHORT)
    out = run_features(demand, features_of(demand), ["promo"], ["price"], s, tree_options=TREES)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    for rows in (out.extras["fitted"], out.extras["explained"]):
        assert plan(rows).count("MapInArrow") == 1 and "_first#" not in plan(rows) and "_final#" not in plan(rows)
    assert "shap_XGBoost" in out.extras["explained"].columns and "shap_XGBoost" not in out.extras["fitted"].columns
    assert out.extras["explained"].storageLevel.useDisk
    assert plan(out.extras["importances"]).count("MapInArrow") == 4  # each of the four measures reads the kept rows
    kept = {r["product"]: r for r in out.extras["fitted"].select("product", "bt_XGBoost", "fc_XGBoost", "gain_XGBoost").collect()}
    again = {r["product"]: r for r in out.extras["explained"].select("product", "bt_XGBoost", "fc_XGBoost", "gain_XGBoost").collect()}
    assert kept == again
