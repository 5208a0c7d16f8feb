"""Kernels against plain loops, and properties of the fitted models."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthloom.models import autoreg, boosted, regress, sarima, smoothing
from monthloom.operators import tuning
from monthloom.operators.calendar import pack, unpack


def plain_smoothing(y, a, b, g, m=12):
    level, trend = np.mean(y[:m]), (np.mean(y[m : 2 * m]) - np.mean(y[:m])) / m
    season = [v - level for v in y[:m]]
    sse = 0.0
    for v in y[m:]:
        s = season.pop(0)
        sse += (v - level - trend - s) ** 2
        new = a * (v - s) + (1 - a) * (level + trend)
        season.append(g * (v - level - trend) + (1 - g) * s)
        trend = b * (new - level) + (1 - b) * trend
        level = new
    return sse, level, trend, season


def test_smoothing_kernel_matches_plain_loop(patterns):
    y = patterns["Seasonal"]
    grid = np.array(smoothing.GRID)[:10]
    sse, level, trend, season = smoothing.smooth(np.array([y]), *grid.T)
    for c, (a, b, g) in enumerate(grid):
        want = plain_smoothing(y, a, b, g)
        assert (sse[0, c], level[0, c], trend[0, c]) == pytest.approx(want[:3])
        assert season[0, c] == pytest.approx(want[3])


def test_smoothing_variants_by_length(spark, long):
    p = pack(long({f"n{n}": [10 + k % 5 for k in range(n)] for n in (1, 2, 3, 23, 24, 60)}))
    kinds = {r["product"]: r["kind"] for r in smoothing.hw_fit(p).select("product", "fit.kind").collect()}
    assert kinds == {"n1": "none-none", "n2": "none-none", "n3": "add-none", "n23": "add-none", "n24": "add-add", "n60": "add-add"}
    steps = smoothing.hw_forecast(smoothing.hw_fit(p), 12).groupBy("product").count().collect()
    assert {r["count"] for r in steps} == {12}


def test_multiplicative_failure_falls_back(spark, long):
    zeros = pack(long({"z": [0.0] * 30}))
    fit = smoothing.hw_fit(zeros, trend="mul", seasonal="mul").select("fit.*").first()
    assert fit["kind"] in ("add-none", "none-none") and fit["sse"] == 0


def test_jvm_projection_matches_kernel(spark, long, patterns):
    p = smoothing.hw_fit(pack(long(patterns)), trend="add", seasonal="mul")
    for r in p.select("product", "fit.*", smoothing.hw_forecast_column(15).alias("path")).collect():
        want = smoothing.project(np.array(r["level"]), np.array(r["trend"]), np.array(r["season"]), 15, "add", "mul")
        assert r["path"] == pytest.approx(want.tolist())


@pytest.mark.parametrize("order", [0, 1])
def test_autoregression(spark, long, patterns, order):
    series = patterns | {"constant": [7.0] * 20, "one": [3.0], "two": [3.0, 5.0]}
    got = {r["product"]: r for r in autoreg.ar_fit(pack(long(series)), order).select("product", "fit.*", autoreg.ar_path(6, order).alias("path")).collect()}
    for name, y in patterns.items():
        w = np.diff(y) if order else np.array(y)
        phi, c = np.polyfit(w[:-1], w[1:], 1)
        assert (got[name]["phi"], got[name]["const"]) == pytest.approx((phi, c))
        last, level, want = w[-1], y[-1], []
        for _ in range(6):
            last = c + phi * last
            level = level + last if order else last
            want.append(level)
        assert got[name]["path"] == pytest.approx(want)
    assert got["constant"]["path"] == pytest.approx([7.0] * 6)
    assert got["one"]["path"] == pytest.approx([3.0] * 6)


def test_sarima_recovers_parameters():
    rng = np.random.default_rng(1)
    e = rng.standard_normal((8, 600))
    y = np.zeros_like(e)
    for t in range(1, 600):
        y[:, t] = 0.6 * y[:, t - 1] + e[:, t] + 0.4 * e[:, t - 1]
    theta, sse, _, _ = sarima.fit_css(y, [(1, 0, 1, 0, 0, 0)])
    assert np.abs(theta[0][:, 0] - 0.6).mean() < 0.1 and np.abs(theta[0][:, 2] - 0.4).mean() < 0.1
    assert sse[0] / 600 == pytest.approx(np.ones(8), abs=0.2)


def test_sarima_stacked_fit_equals_single_fits():
    rng = np.random.default_rng(2)
    y = 100 + rng.standard_normal((3, 60)).cumsum(axis=1)
    family = [(0, 1, 1, 0, 0, 0), (1, 1, 0, 0, 0, 0), (2, 1, 2, 0, 0, 0)]
    stacked = sarima.fit_css(y, family, burn=3)
    for c, o in enumerate(family):
        # errors start where the longest of the stacked orders has all its lags
        alone = sarima.fit_css(y, [o], burn=3)
        assert stacked[1][c] == pytest.approx(alone[1][0], rel=0.05)


def test_sarima_undoes_differencing():
    y = np.array([[10.0 + 2 * t + 5 * (t % 12) for t in range(60)]])
    order = (0, 1, 0, 0, 1, 0)
    theta, _, e, W = sarima.fit_css(y, [order])
    path = sarima.forecast_css(y, theta[0], e[0], W, order, 12)
    assert path[0] == pytest.approx([10.0 + 2 * t + 5 * (t % 12) for t in range(60, 72)])


def test_sarima_short_series_and_holdout(spark, long, patterns):
    p = pack(long({"a": [1.0], "b": [1.0, 2.0], "c": list(range(1, 15)), **patterns}))
    rows = p.select("product", sarima.sarima_path(F.col("ys"), F.lit(12)).alias("path")).collect()
    assert all(len(r["path"]) == 12 and np.isfinite(r["path"]).all() for r in rows)
    Y = np.array([patterns["Trending"]])
    assert np.isfinite(sarima.holdout_error(Y, (0, 1, 1, 0, 0, 0))).all()
    assert np.isinf(sarima.holdout_error(Y[:, :6], (2, 1, 2, 1, 1, 1))).all()


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_components_sum_to_the_fit(spark, long, patterns, mode):
    d = long(patterns).withColumn("xs", F.array(F.month("ds") % 3 * 1.0, F.col("y") * 0 + 4.0))
    f = regress.trend_season_regress(pack(d, "xs"), 0, "xs", mode=mode)
    wide = regress.components(f, ["a", "b"], mode).groupBy("product", "ds").pivot("component").agg(F.first("value")).collect()
    assert len(wide) == 4 * 60
    for r in wide:
        if mode == "additive":
            assert r["trend"] + r["additive_terms"] == pytest.approx(r["yhat"])
        else:
            assert r["trend"] * (1 + r["multiplicative_terms"]) == pytest.approx(r["yhat"])
        assert r["b"] == pytest.approx(0)  # a constant regressor explains nothing


def test_regression_follows_a_season(spark, long, patterns):
    f = regress.trend_season_regress(pack(long({"Seasonal": patterns["Seasonal"]})), 12)
    path = [r["yhat"] for r in regress.regress_forecast(f).orderBy("step").collect()]
    truth = [150 + 50 * np.sin(2 * np.pi * t / 12) for t in range(60, 72)]
    assert np.abs(np.array(path) - truth).mean() < 12


def test_boosted_trees_and_recursion(spark, long, patterns):
    p = pack(long(patterns))
    table = boosted.training_table(long(patterns))
    assert table.count() == 4 * 48
    model = boosted.gbt_fit(table, rounds=5, depth=3)
    path = boosted.recursive_forecast(p, model, 4).collect()
    assert len(path) == 16 and all(50 < r["yhat"] < 250 for r in path)
    # the first step by Spark's own scoring: features of the month after the last
    extended = long({k: v + [None] for k, v in patterns.items()})
    ahead = boosted.temporal_features(extended.withColumn("level", F.avg("y").over(W.partitionBy("product"))))
    by_spark = model.transform(ahead.filter("y is null").na.fill(0)).collect()
    mine = {r["product"]: r["yhat"] for r in path if r["step"] == 1}
    assert mine == pytest.approx({r["product"]: r["prediction"] for r in by_spark})
    gains = boosted.tree_importance(spark, model).collect()
    assert sum(r["pct"] for r in gains) == pytest.approx(100, abs=0.2)


def test_recursive_fold_handles_short_history(spark, long):
    p = pack(long({"s": [5.0, 6.0]}))
    rows = boosted.recursive_fold(p, lambda x: x["y_lag_1"] + x["y_lag_12"], 3).orderBy("step").collect()
    assert [r["yhat"] for r in rows] == [6.0, 6.0, 6.0]


def test_best_trial_directions(spark):
    nan = float("nan")
    rows = [("a", 1, nan, 0.1), ("a", 2, 3.0, 0.2), ("a", 3, 1.0, 0.3), ("a", 4, 1.0, 0.4), ("b", 1, None, 0.5)]
    t = spark.createDataFrame(rows, "product string, trial int, score double, alpha double")
    low = {r["product"]: r for r in tuning.best_trial(t).collect()}
    high = {r["product"]: r for r in tuning.best_trial(t, "maximize").collect()}
    assert (low["a"]["trial"], low["a"]["best_value"], low["a"]["trials_used"]) == (3, 1.0, 4)
    assert (high["a"]["trial"], high["a"]["best_value"]) == (2, 3.0)
    assert low["b"]["best_value"] == float("inf") and high["b"]["best_value"] == float("-inf")


def test_tuning_picks_the_lowest_holdout_error(spark, long, patterns):
    p = pack(long(patterns))
    for tuned in (tuning.tune_sarima(p, 4), tuning.tune_regression(p, 4), tuning.tune_smoothing(p, 4)):
        rows = tuned.collect()
        assert len(rows) == 4 and all(0 < r["best_value"] < 1 and r["trials_used"] == 4 for r in rows)
    for r in tuning.tune_sarima(p, 4).collect():
        order = tuple(r[c] for c in sarima.NAMES)
        assert r["best_value"] == pytest.approx(sarima.holdout_error(np.array([patterns[r["product"]]]), order)[0])


def test_tuning_the_shared_trees(spark, long, patterns, monkeypatch):
    space = {**tuning.SEARCH_SPACES["XGBoost"], "n_estimators": ("int", 2, 4), "max_depth": ("int", 2, 3)}
    monkeypatch.setitem(tuning.SEARCH_SPACES, "XGBoost", space)
    table = boosted.training_table(long(patterns))
    best = tuning.tune_boosted(table, (*boosted.TEMPORAL, "level"), 2)
    assert best["trials_used"] == 2 and 0 < best["best_value"] < 1
    assert 2 <= best["params"]["rounds"] <= 4


def test_unpack_is_the_inverse_of_pack(spark, long, patterns):
    d = long(patterns)
    back = unpack(pack(d)).select("product", "ds", "y")
    assert back.exceptAll(d).isEmpty() and d.exceptAll(back).isEmpty()
