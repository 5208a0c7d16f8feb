"""Trees of many products at once: scores, paths and attribution of a whole row, and no influence of the company."""

import datetime
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthloom.models import grown as G
from tests.test_grown import make


def forest(spark, sizes=(30, 5, 48), seed=1, **options):
    rows, df = make(spark, sizes, seed=seed)
    df = df.unionByName(spark.createDataFrame([("none", None, None), ("empty", [], [])], df.schema))
    return rows, G.grow_trees(df, 4, {"t": F.size("target")}, **({"rounds": 6, "depth": 4, "rate": 0.5} | options))


def test_scores_of_arrays_are_those_of_their_rows(spark):
    _, df = forest(spark)
    extra = F.concat("x", F.array(F.array(F.lit(0.1), F.lit(None), F.lit(float("nan")), F.lit(2.0))))
    both = df.select("product", G.tree_scores(F.col("t"), extra).alias("a"), F.transform(extra, lambda v: G.tree_score(F.col("t"), v)).alias("b"))
    for r in both.collect():
        assert (r["a"] is None) == (r["b"] is None)
        for a, b in zip(r["a"] or [], r["b"] or [], strict=True):
            assert (a is None and b is None) or a == pytest.approx(b)


def test_trees_do_not_depend_on_the_other_products_of_a_batch():
    r = np.random.default_rng(2)
    x, y = np.round(r.normal(size=(3, 40, 6)), 2), r.normal(size=(3, 40))
    x[:, :, 5] = -x[:, :, 0]  # the same cuts from the other side: equal gains, the first feature wins
    y[0] *= 1e12
    y[1] *= 1e-9
    real = np.ones((3, 40), bool)

    def options(n):
        return {"rounds": np.full(n, 20), "depth": np.full(n, 6)} | {o: np.ones(n) * v for o, v in zip(G.OPTION_NAMES[2:], (0.3, 1.0, 1.0, 1.0))}

    _, together = G.grow(x, y, real, options(3))
    for s in range(3):
        _, alone = G.grow(x[s : s + 1], y[s : s + 1], real[:1], options(1))
        for a, b in zip(alone, together, strict=True):
            assert 5 not in a[1] and all(np.array_equal(p[0], q[s], equal_nan=p.dtype.kind == "f") for p, q in zip(a, b, strict=True))


def predict(trees, x):
    total = trees["base"]
    for tree in trees["trees"]:
        node = tree[0]
        while node["left"] is not None:
            node = tree[node["left"] + int(x[node["feature"]] > node["at"])]
        total += node["value"]
    return total


def test_path_follows_the_definition(spark):
    r = np.random.default_rng(3)
    rows = []
    for name, n, month in (("long", 30, 11), ("short", 7, 2), ("one", 1, 12)):
        rows.append((name, datetime.date(2020, month, 1), r.normal(size=n).tolist(), r.normal(size=(20, 17)).tolist(), r.normal(size=20).tolist(), 3 if name == "short" else 5, [[1.0], [None], [0.3]]))
    rows.append(("gone", datetime.date(2020, 1, 1), [], rows[0][3], rows[0][4], 4, None))
    df = spark.createDataFrame(rows, "product string, start date, ys array<double>, x array<array<double>>, target array<double>, h int, ahead array<array<double>>")
    grown = G.grow_trees(df, 17, {"t": F.size("target")}, rounds=10, depth=4, rate=0.5)
    got = grown.select("*", G.grown_path(F.col("t"), F.col("ys"), F.col("start"), F.col("h"), F.col("ahead"), 1).alias("p")).collect()
    for row in got:
        if not row["ys"]:
            assert row["p"] is None
            continue
        hist, date, path = row["ys"][-12:], row["start"].year * 12 + row["start"].month - 1 + len(row["ys"]), []
        for k in range(row["h"]):
            m = (date + k) % 12 + 1
            x = [hist[-j] if len(hist) >= j else 0.0 for j in (1, 2, 3, 6, 12)]
            for w in (3, 6, 12):
                x += [statistics.fmean(hist[-w:]), statistics.stdev(hist[-w:])] if len(hist) >= w else [0.0, 0.0]
            x += [m, (m + 2) // 3, (date + k) // 12, math.sin(2 * math.pi * m / 12), math.cos(2 * math.pi * m / 12)]
            x.append(row["ahead"][min(k, 2)][0] or 0.0)
            path.append(predict(row["t"], x))
            hist = hist + path[-1:]
        assert row["p"] == pytest.approx(path)


def test_attribution_stays_in_the_row(spark):
    """As a join of rows and leaves every product became rows times leaves times depth rows of a shuffle."""
    rows, df = forest(spark)
    df = df.cache()
    shares = G.tree_shapley(df, "t", 4)
    plan = shares._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    total = {}
    for r in shares.collect():
        total[r["product"], r["row"]] = total.get((r["product"], r["row"]), 0.0) + r["phi"]
    trees = {r["product"]: r["t"] for r in df.collect()}
    for name, x, _ in rows:
        leaves = [[(n["cover"], n["value"]) for n in t if n["left"] is None] for t in trees[name]["trees"]]
        mean = trees[name]["base"] + sum(sum(c * v for c, v in t) / sum(c for c, _ in t) for t in leaves)
        for i, v in enumerate(x):
            assert total.get((name, i), 0.0) == pytest.approx(predict(trees[name], v) - mean, abs=1e-9)
    df.unpersist()


def test_paths_and_gains_of_both_fits_are_one_step(spark):
    """As nested array functions each month of each tree was interpreted node by node."""
    rows, df = make(spark, [30, 5])
    df = df.select("*", F.col("target").alias("ys"), F.lit(datetime.date(2020, 1, 1)).alias("start"))
    grown = G.grow_trees(df, 4, {"first": F.lit(4), "final": F.size("target")}, rounds=3, depth=2)
    paths = {name: G.grown_path(F.col(name), F.col("ys"), F.col("start"), F.lit(12)) for name in ("first", "final")}
    both = grown.select(*[c.alias(f"p_{name}") for name, c in paths.items()], G.gain_shares(F.col("final"), list("abcd")).alias("gain"))
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and all(len(r["p_final"]) == 12 and len(r["gain"]) == 4 for r in both.collect())


def test_gains_are_worked_out_for_cuts_near_the_best_only(monkeypatch):
    """Every cut of every feature went through all the arithmetic of its gain, rounded at the end."""
    r = np.random.default_rng(4)
    x, y = np.round(r.normal(size=(6, 48, 19)), 1), r.normal(size=(6, 48))
    x[:, :, 7] = -x[:, :, 2]
    options = {o: np.full(6, v) for o, v in zip(G.OPTION_NAMES, (1, 1, 0.3, 3.0, 1.0, 1.0), strict=True)}
    rint, rounded = np.rint, []
    monkeypatch.setattr(np, "rint", lambda v, *a, **k: rounded.append(np.size(v)) or rint(v, *a, **k))
    _, ((_, feature, at, *_, gains),) = G.grow(x, y, np.ones((6, 48), bool), options)
    assert sum(rounded) < x.size / 2
    for s in range(6):
        rest, found = y[s] - y[s].mean(), []
        for k in range(19):
            for v in np.unique(x[s, :, k])[:-1]:
                low, high = rest[x[s, :, k] <= v], rest[x[s, :, k] > v]
                if min(len(low), len(high)) >= 3:
                    gain = (low.sum() ** 2 / (len(low) + 1) + high.sum() ** 2 / (len(high) + 1) - rest.sum() ** 2 / 49) / (rest**2).sum()
                    found.append((-round(gain * 1e9), k, v))
        gain, k, v = min(found)
        above = x[s, :, k][x[s, :, k] > v].min()
        assert feature[s, 0] == k and at[s, 0] == pytest.approx((v + above) / 2) and gains[s, 0] == pytest.approx(-gain / 1e9, abs=2e-9)


def test_trees_are_read_where_they_grow(spark):
    """As a column, a product's trees went through the JVM and a second Python process: half a megabyte for some hundred numbers."""
    _, df = make(spark, [30, 5, 48], seed=6)
    df = df.unionByName(spark.createDataFrame([("none", None, None), ("empty", [], [])], df.schema))
    df = df.select("*", F.col("target").alias("ys"), F.lit(datetime.date(2020, 1, 1)).alias("start"))
    fits, options, names = {"first": F.lit(4), "final": F.size("target")}, {"rounds": 5, "depth": 4, "rate": 0.5}, list("abcd")
    readings = {
        "path": ("first", G.path_reading(F.col("ys"), F.col("start"), F.lit(3))), "gain": ("final", G.gain_reading(names)),
        "shap": ("final", G.shapley_shares(4, names)), "phi": ("final", G.shapley_reading(4, F.col("x"))),
    }
    read = G.grow_trees(df, 4, fits, reads=readings, **options)
    assert read.columns == [*df.columns, *readings]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    apart = G.grow_trees(df, 4, fits, **options).select("product", *[r.over(F.col(fit)).alias(c) for c, (fit, r) in readings.items()])
    want = {r["product"]: r for r in apart.collect()}
    got = {r["product"]: r for r in read.select(*apart.columns).collect()}
    assert got == want and abs(sum(s["pct"] for s in got["p0"]["shap"]) - 100) < 0.05 and got["empty"]["path"] is None


def test_importance_grows_its_trees_once(spark):
    """Rows were counted from a second copy of the trees, and totals joined to them."""
    _, df = make(spark, [30, 12], seed=7)
    trees = G.grow_trees(df, 4, {"t": F.size("target")}, rounds=5, depth=4, rate=0.5)
    shares = G.shapley_importance(trees, "t", 4, list("abcd"))
    plan = shares._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Exchange" not in plan
    total = {}
    for r in G.tree_shapley(trees, "t", 4).collect():
        total[r["product"], r["feature"]] = total.get((r["product"], r["feature"]), 0.0) + abs(r["phi"])
    for r in shares.collect():
        every = sum(v for (p, _), v in total.items() if p == r["product"])
        assert r["pct"] == pytest.approx(100 * total.get((r["product"], "abcd".index(r["feature"])), 0.0) / every, abs=0.006)


def test_sums_of_cuts_are_compared_by_their_extremes(monkeypatch):
    """Every sum to the left of a cut was turned into a distance, in passes of its own over rows times features."""
    r = np.random.default_rng(8)
    x, y = np.round(r.normal(size=(6, 48, 19)), 1), r.normal(size=(6, 48))
    options = {o: np.full(6, v) for o, v in zip(G.OPTION_NAMES, (1, 6, 0.3, 1.0, 1.0, 1.0), strict=True)}
    absolute, turned = np.abs, []
    monkeypatch.setattr(np, "abs", lambda v, *a, **k: turned.append(np.size(v)) or absolute(v, *a, **k))
    G.grow(x, y, np.ones((6, 48), bool), options)
    assert sum(turned) < x.size
