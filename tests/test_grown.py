"""Trees per product: the kernel against growing one tree at a time, attribution against all subsets."""

import datetime
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthloom.models import grown as G


def plain_trees(x, y, rounds, depth, rate, least=1):
    """Node tuples (feature, at, left, value, cover, gain) per tree, numbered level by level."""
    base = y.mean()
    rest = y - base
    scale = max((rest**2).sum(), 1e-300)
    trees = []
    for _ in range(rounds):
        nodes, open_ = [{"rows": np.arange(len(y)), "depth": 0}], [0]
        while open_:
            node = nodes[open_.pop(0)]
            rows, best = node["rows"], (0, None, None)
            if node["depth"] < depth and len(rows) >= 2 * least:
                whole = rest[rows].sum()
                for k in range(x.shape[1]):
                    levels = np.unique(x[:, k])
                    for a, b in zip(levels, levels[1:]):
                        low = x[rows, k] <= (a + b) / 2
                        c = low.sum()
                        if c < least or len(rows) - c < least or c in (0, len(rows)):
                            continue
                        g = rest[rows][low].sum()
                        gain = g * g / (c + 1) + (whole - g) ** 2 / (len(rows) - c + 1) - whole * whole / (len(rows) + 1)
                        gain = round(gain / scale, 9)
                        if gain > best[0]:
                            best = (gain, k, (a + b) / 2)
            node |= {"gain": best[0], "feature": best[1], "at": best[2], "value": rate * rest[rows].sum() / (len(rows) + 1)}
            if best[1] is not None:
                node["left"] = len(nodes)
                low = x[rows, best[1]] <= best[2]
                for part in (rows[low], rows[~low]):
                    open_.append(len(nodes))
                    nodes.append({"rows": part, "depth": node["depth"] + 1})
        for node in nodes:
            if "left" not in node:
                rest[node["rows"]] -= node["value"]
        trees.append([(n["feature"], n["at"], n.get("left"), n["value"], len(n["rows"]), n["gain"]) for n in nodes])
    return base, trees


def predict(base, trees, row):
    total = base
    for tree in trees:
        m = 0
        while tree[m][2] is not None:
            m = tree[m][2] + int(row[tree[m][0]] > tree[m][1])
        total += tree[m][3]
    return total


def make(spark, sizes, features=4, seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for p, n in enumerate(sizes):
        x = np.round(r.normal(size=(n, features)), 2)
        x[:, -1] = np.arange(n) % 3
        y = x[:, 0] * 3 + (x[:, -1] == 1) * 2 + r.normal(size=n) if n else np.zeros(0)
        rows.append((f"p{p}", x.tolist(), y.tolist()))
    return rows, spark.createDataFrame(rows, "product string, x array<array<double>>, target array<double>")


@pytest.mark.parametrize("depth, least", [(2, 1), (4, 3)])
def test_trees_against_growing_them_one_by_one(spark, depth, least):
    rows, df = make(spark, [30, 48, 5, 1, 12])
    got = G.grow_trees(df, 4, {"all_rows": F.size("target"), "some": F.lit(9)}, rounds=4, depth=depth, rate=0.5, min_child_weight=float(least))
    for r, (_, x, y) in zip(sorted(got.collect(), key=lambda r: r["product"]), rows, strict=True):
        for name, n in (("all_rows", len(y)), ("some", min(9, len(y)))):
            base, trees = plain_trees(np.array(x)[:n], np.array(y)[:n], 4, depth, 0.5, least)
            assert abs(r[name]["base"] - base) < 1e-9 and len(r[name]["trees"]) == len(trees)
            for tree, want in zip(r[name]["trees"], trees, strict=True):
                assert [(s["feature"], s["left"], s["cover"]) for s in tree] == [(w[0], w[2], w[4]) for w in want]
                for s, w in zip(tree, want, strict=True):
                    assert abs(s["value"] - w[3]) < 1e-9 and (s["at"] is None) == (w[1] is None) and (w[1] is None or abs(s["at"] - w[1]) < 1e-9)
    scored = got.select("product", F.transform("x", lambda v: G.tree_score(F.col("all_rows"), v)).alias("p")).collect()
    for r, (_, x, y) in zip(sorted(scored, key=lambda r: r["product"]), rows, strict=True):
        base, trees = plain_trees(np.array(x), np.array(y), 4, depth, 0.5, least)
        assert np.allclose(r["p"], [predict(base, trees, v) for v in x])


def test_parameters_per_row_and_empty_rows(spark):
    rows, df = make(spark, [20, 0, 20], seed=3)
    df = df.unionByName(spark.createDataFrame([("none", None, None)], df.schema))
    options = F.struct(
        F.when(F.col("product") == "p0", 2).otherwise(5).alias("rounds"), F.lit(3).alias("depth"), F.lit(0.3).alias("rate"),
        F.lit(1.0).alias("min_child_weight"), F.when(F.col("product") == "p2", 0.6).otherwise(1.0).alias("subsample"), F.lit(0.5).alias("colsample"),
    )
    got = {r["product"]: r["t"] for r in G.grow_trees(df, 4, {"t": F.size("target")}, options=options).collect()}
    assert len(got["p0"]["trees"]) == 2 and len(got["p2"]["trees"]) == 5 and got["p1"] is None and got["none"] is None
    assert all(t[0]["cover"] == 20 for t in got["p0"]["trees"]) and all(t[0]["cover"] < 20 for t in got["p2"]["trees"])
    # draws belong to the product and not to the batch it is in
    again = G.grow_trees(df.orderBy(F.col("product").desc()).coalesce(1), 4, {"t": F.size("target")}, options=options)
    assert {r["product"]: r["t"] for r in again.collect()} == got
    assert G.grow_trees(df.limit(0), 4, {"t": F.size("target")}).collect() == []


def subsets_value(tree, row, known):
    """Expected leaf value if only ``known`` features are looked at; others go both ways by cover."""

    def walk(m):
        feature, at, left, value, cover, _ = tree[m]
        if left is None:
            return value
        if feature in known:
            return walk(left + int(row[feature] > at))
        return (tree[left][4] * walk(left) + tree[left + 1][4] * walk(left + 1)) / cover

    return walk(0)


def test_attribution_against_all_subsets(spark):
    rows, df = make(spark, [40, 25], seed=5)
    depth = 4
    trees = G.grow_trees(df, 4, {"t": F.size("target")}, rounds=3, depth=depth, rate=0.5)
    phi = {}
    for r in G.tree_shapley(trees, "t", depth).collect():
        phi[r["product"], r["row"], r["feature"]] = r["phi"]
    for name, x, y in rows:
        base, forest = plain_trees(np.array(x), np.array(y), 3, depth, 0.5)
        for i, v in enumerate(x):
            shares = []
            for f in range(4):
                others, share = [g for g in range(4) if g != f], 0.0
                for k in range(4):
                    for s in itertools.combinations(others, k):
                        w = math.factorial(k) * math.factorial(3 - k) / math.factorial(4)
                        share += w * sum(subsets_value(t, v, {*s, f}) - subsets_value(t, v, set(s)) for t in forest)
                shares.append(share)
                assert abs(phi.get((name, i, f), 0.0) - share) < 1e-9
            mean = base + sum(subsets_value(t, v, set()) for t in forest)
            assert abs(sum(shares) - (predict(base, forest, v) - mean)) < 1e-9


def test_path_and_gains(spark):
    ys = [100 + 10 * math.sin(k * math.pi / 6) + k for k in range(48)]
    long = spark.createDataFrame([("a", datetime.date(2020 + k // 12, k % 12 + 1, 1), y) for k, y in enumerate(ys)], "product string, ds date, y double")
    from monthloom.models.boosted import TEMPORAL
    from monthloom.operators.temporal import temporal_features

    packed = G.pack_rows(temporal_features(long), TEMPORAL, F.col("ds") < "2023-01-01")
    row = packed.first()
    assert (row["n"], len(row["target"]), row["n_known"]) == (48, 36, 24)
    trees = G.grow_trees(packed, len(TEMPORAL), {"t": F.size("target")}, rounds=30, depth=3)
    got = trees.select(G.grown_path(F.col("t"), F.col("ys"), F.col("start"), F.lit(12)).alias("p"), G.gain_shares(F.col("t"), TEMPORAL).alias("g")).first()
    assert len(got["p"]) == 12 and all(90 < v < 170 for v in got["p"])
    assert abs(sum(s["pct"] for s in got["g"]) - 100) < 0.2 and [s["feature"] for s in got["g"]] == list(TEMPORAL)
