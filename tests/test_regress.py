"""The regression of many rows at once: shapes side by side in a batch, missing values, and its place in the plan."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthloom.models import regress

SCHEMA = "product string, start date, n int, ys array<double>, xs array<array<double>>, cps double, mode string"


def row(name, n, seed, month=1, months=None, width=2, **other):
    r = np.random.default_rng(seed)
    ys = (100 + 20 * np.sin(np.arange(n) * np.pi / 6) + np.arange(n) + r.normal(size=n)).tolist()
    xs = r.normal(size=(n if months is None else months, width)).tolist()
    return {"product": name, "start": datetime.date(2020, month, 1), "n": n, "ys": ys, "xs": xs, "cps": 0.05, "mode": "additive"} | other


def fits(spark, rows, horizon=3):
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = regress.with_regression(df, "fit", F.col("ys"), F.col("start"), horizon, F.col("xs"), F.col("cps"), 10.0, F.col("mode"))
    return {r["product"]: r["fit"] and r["fit"].asDict() for r in got.collect()}


def test_rows_of_a_batch_do_not_touch_each_other(spark):
    rows = [row("a", 48, 1), row("b", 30, 2, month=5), row("c", 48, 3, mode="multiplicative"), row("d", 48, 4, months=20, cps=0.5), row("e", 5, 5, width=0), row("f", 48, 6)]
    rows.append(row("short", 2, 7))
    rows.append(row("hole", 48, 8) | {"ys": [None, *[1.0] * 47]})
    rows.append(row("none", 48, 9) | {"ys": None, "xs": None})
    rows.append(row("turned", 48, 10, mode="multiplicative") | {"xs": [[1.0, None], [float("nan")], [float("inf"), 2.0]]})
    together = fits(spark, rows)
    assert together["short"] is None and together["none"] is None
    assert set(together["hole"]["yhat"]) == {None} and set(together["hole"]["coef"]) == {None}
    for r in rows:
        alone, mixed = fits(spark, [r])[r["product"]], together[r["product"]]
        if alone is None or r["product"] == "hole":
            assert alone == mixed
            continue
        assert len(mixed["yhat"]) == r["n"] + 3 and len(mixed["effects"]) == len(mixed["coef"])
        for part in ("trend", "yearly", "yhat", "coef", "trend_coef"):
            assert mixed[part] == pytest.approx(alone[part], rel=1e-9, abs=1e-9)
        terms = np.array(mixed["yearly"]) + np.sum(mixed["effects"], axis=0) if mixed["effects"] else np.array(mixed["yearly"])
        whole = np.array(mixed["trend"]) + terms if r["mode"] == "additive" else np.array(mixed["trend"]) * (1 + terms)
        assert mixed["yhat"] == pytest.approx(whole.tolist()) and mixed["converged"]


def test_coefficients_solve_the_normal_equations(spark):
    r = row("a", 48, 1)
    fit = fits(spark, [r], 0)["a"]
    x, y = np.array(r["xs"]), np.array(r["ys"]) / np.max(np.abs(r["ys"]))
    t = regress._trend_columns(48, 48)
    design = np.column_stack([t, regress._season_columns(1, 48), (x - x.mean(axis=0)) / x.std(axis=0)])
    penalty = [1e-6, 1e-6, *[4.0] * 25, *[1e-4 + 1e-8] * 12]
    want = np.linalg.solve(design.T @ design + np.diag(penalty), design.T @ y)
    assert fit["trend_coef"] == pytest.approx(want[:27].tolist(), abs=1e-8)
    assert fit["coef"] == pytest.approx(want[-2:].tolist(), abs=1e-8)


def test_a_fit_is_one_step_of_the_plan(spark):
    """Written as nested array functions, each product's fit was interpreted term by term and five trials planned ten fits."""
    df = spark.createDataFrame([row("a", 48, 1)], SCHEMA).select("*", F.array(*[F.struct("cps", F.lit(10.0).alias("sps"), "mode")] * 5).alias("trials"))
    scored = regress.with_trial_scores(df, "s", F.col("ys"), F.col("start"), "trials", 5, 0.2, F.col("xs"))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "aggregate(" not in plan.split("ArrowEvalPython")[1]
    used = regress.with_regression(df, "fit", F.col("ys"), F.col("start"), 3).filter("fit is not null").select(F.explode("fit.yhat"), "fit.coef")
    assert used._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
