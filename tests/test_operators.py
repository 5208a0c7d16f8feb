"""Edge cases the driver's tables do not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from monthloom.functions.expressions import coerce_numeric, parse_period, safe_name
from monthloom.operators import blending, encoding, influence, joins, metrics, screening, temporal
from monthloom.operators.calendar import reindex_calendar
from monthloom.sources import store, wide
from monthloom.session import shared_folder


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_parse_period(spark):
    cases = {
        "01.2020": dt.date(2020, 1, 1),
        "1.2020": dt.date(2020, 1, 1),
        " 12.1999 ": dt.date(1999, 12, 1),
        "2020-03-05": dt.date(2020, 3, 5),
        "05.03.2020": dt.date(2020, 3, 5),
        "03/05/2020": dt.date(2020, 3, 5),
        "2020/03/05": dt.date(2020, 3, 5),
        "43831": dt.date(2020, 1, 1),
        "122019": dt.date(2019, 12, 1),
        "2020-03-05 10:00:00": dt.date(2020, 3, 5),
        "13.2020": dt.date(1900, 1, 12),  # no month 13, so it counts as a day number
        "total": None,
        "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", parse_period(F.col("t")).alias("d")).collect()}
    assert got == cases


def test_names_and_numbers(spark):
    df = spark.createDataFrame([("Größe/3 (x)",)], "t string")
    assert df.select(safe_name(F.col("t"))).first()[0] == "Größe_3__x_"
    n = spark.createDataFrame([("1.5",), ("x",), (" 2 ",), ("NaN",), (None,)], "t string")
    assert [r[0] for r in n.select(coerce_numeric(F.col("t"))).collect()] == [1.5, None, 2.0, None, None]


def test_wide_sheet(spark):
    rows = [("A", "x", "1", "2", "9"), ("B", "x", None, "n/a", "9"), (" ", "x", "1", "1", "9"), (None, "x", "1", "1", "9"), ("A", "x", "3", None, "9")]
    sheet = spark.createDataFrame(rows, "name string, unit string, `01.2020` string, `02.2020` string, comment string")
    got = wide.wide_to_long(sheet, "A", "C", last_wins=True).orderBy("ds").collect()
    # B has a number only under a header that is no date, so it has no value at all
    assert [(r["product"], r["ds"].month, r["y"]) for r in got] == [("A", 1, 3.0), ("A", 2, None)]
    assert wide.column_index("A") == 0 and wide.column_index("AB") == 27


def test_read_csv_sheet(spark, tmp_path):
    (tmp_path / "d.csv").write_text(",01.2020,02.2020\nP 1,10,\nP 2,x,7\n")
    got = wide.wide_to_long(wide.read_table(spark, str(tmp_path / "d.csv"))).collect()
    assert {(r["product"], r["ds"].month): r["y"] for r in got} == {("P 1", 1): 10.0, ("P 1", 2): None, ("P 2", 1): None, ("P 2", 2): 7.0}


def test_reindex_fills_both_ends(spark):
    d = spark.createDataFrame(
        [("a", dt.date(2020, 1, 1), 1.0), ("a", dt.date(2020, 4, 1), 4.0), ("b", dt.date(2020, 3, 1), 3.0)],
        "product string, ds date, y double",
    )
    got = by(reindex_calendar(d), "product", "ds")
    assert len(got) == 8
    assert [got[("b", dt.date(2020, m, 1))]["y"] for m in range(1, 5)] == [None, None, 3.0, None]


def test_classification(long):
    d = long({"zeros": [0] * 30, "missing": [None] * 30, "half": [0, 1] * 15, "late": [9] * 6 + [0] * 24, "short": [1, 0]})
    kept = {r["product"] for r in screening.classify_filter(d).select("product").distinct().collect()}
    gone = {r["product"] for r in screening.classify_filter(d, keep=False).select("product").distinct().collect()}
    assert kept == {"missing", "half", "short"} and gone == {"zeros", "late"}
    with pytest.raises(ValueError):
        screening.require_nonempty(screening.classify_filter(long({"z": [0] * 5})))
    with pytest.raises(ValueError):
        screening.require_inputs(d, None, needs_features=True)


@pytest.mark.parametrize("n,train,val,test", [(60, 36, 12, 12), (36, 12, 12, 12), (35, 13, 11, 11), (10, 4, 3, 3), (2, 2, 0, 0), (80, 36, 12, 12)])
def test_split_sizes(long, n, train, val, test):
    got = {r["split"]: r["count"] for r in screening.split_label(long({"a": list(range(n))})).groupBy("split").count().collect()}
    assert got == {k: v for k, v in {"train": train, "val": val, "test": test}.items() if v}


def test_feature_prefixes_do_not_collide(spark):
    cols = spark.createDataFrame([("A_price",), ("A_B_price",), ("A_B_A_B_x",), ("A_",), ("C_price",)], "column string")
    products = spark.createDataFrame([("A",), ("A B",)], "product string")
    got = {r["column"]: (r["product"], r["feature"]) for r in joins.feature_prefix_match(cols, products).collect()}
    assert got == {"A_price": ("A", "price"), "A_B_price": ("A B", "price"), "A_B_A_B_x": ("A B", "A_B_x")}


def test_cross_product_by_partner_table(spark, long):
    d = long({"A B": [1, 2], "A_B": [3, 4], "ab": [5, 6], "AB": [7, 8]})
    table = [("A B", 1, "A_B"), ("A B", 2, "ab"), ("ab", 1, "AB"), ("ab", 2, "ab"), ("AB", 2, "nobody"), ("ab", 1, "AB")]
    partners = spark.createDataFrame(table, "product string, slot int, other string")
    got = by(joins.cross_product(d, partners, [1, 2]), "product", "ds")
    second = dt.date(2020, 2, 1)
    assert len(got) == 8
    assert [(got[(p, second)]["other_1"], got[(p, second)]["other_2"]) for p in ("A B", "A_B", "ab", "AB")] == [(4, 6), (None, None), (8, None), (None, None)]
    lagged = by(joins.cross_product(d, partners, [1, 2], lag=1), "product", "ds")
    assert lagged[("A B", second)]["other_1"] == 3 and lagged[("A B", dt.date(2020, 1, 1))]["other_1"] is None


def test_repeated_months_keep_the_largest_value(spark):
    months = [("p", "2020-01-01", 1.0), ("p", "2020-01-01", 3.0), ("p", "2020-03-01", None), ("p", "2020-03-01", 2.0), ("q", "2020-02-01", 5.0)]
    d = spark.createDataFrame(months, "product string, ds string, y double").withColumn("ds", F.col("ds").cast("date"))
    got = {(r["product"], r["ds"].month): r["y"] for r in reindex_calendar(d).collect()}
    assert got == {("p", 1): 3.0, ("p", 2): None, ("p", 3): 2.0, ("q", 1): None, ("q", 2): 5.0, ("q", 3): None}


def test_metric_edges(spark):
    rows = [("a", "m", 0.0, 3.0), ("a", "m", 0.0, 1.0), ("b", "m", 2.0, 1.0), ("b", "m", 0.0, 5.0)]
    t = spark.createDataFrame(rows, "product string, model string, y double, yhat double")
    got = by(metrics.evaluate_all(t), "product")
    assert got["a"]["mape"] == 0.0 and got["b"]["mape"] == 0.5
    assert got["a"]["rmse"] == pytest.approx(5**0.5) and got["a"]["mae"] == 2.0
    gap = t.union(spark.createDataFrame([("b", "m", 1.0, None)], t.schema))
    with pytest.raises(Exception, match="differ in length"):
        metrics.evaluate_all(gap, strict=True).collect()
    arrays = spark.createDataFrame([([2.0, 0.0], [1.0, 5.0]), ([0.0], [1.0])], "y array<double>, p array<double>")
    out = arrays.select(*[c.alias(k) for k, c in metrics.array_metrics(F.col("y"), F.col("p")).items()]).collect()
    assert out[0]["mape"] == 0.5 and out[1]["mape"] == 0.0


def test_weights(spark):
    rows = [("a", "x", 0.2), ("a", "y", 0.2), ("a", "z", 0.1), ("a", "w", 0.9), ("b", "x", 0.0), ("b", "y", 0.7), ("b", "z", 0.8), ("c", "x", 0.0)]
    t = spark.createDataFrame(rows, "product string, model string, mape double")
    got = by(blending.inverse_mape_weights(t, 0.5, 2), "product", "model")
    assert got[("a", "z")]["weight"] == pytest.approx(2 / 3) and got[("a", "x")]["weight"] == pytest.approx(1 / 3)
    assert ("a", "y") not in got and got[("a", "z")]["used"] == 1
    assert got[("b", "y")]["weight"] == got[("b", "z")]["weight"] == 0.5
    assert not any(k[0] == "c" for k in got)
    free = by(blending.inverse_mape_weights(t, 0.5, None, ["w", "y", "x", "z"]), "product", "model")
    assert [free[("a", m)]["used"] for m in ("y", "x", "z")] == [1, 2, 3]


def test_encoding_unseen_and_missing(spark):
    rows = [("p", "train", "b"), ("p", "train", "a"), ("p", "train", None), ("p", "test", "c"), ("p", "test", None), ("p", "test", "b")]
    t = spark.createDataFrame(rows, "product string, split string, value string").withColumn("feature", F.lit("f"))
    out = encoding.encode_transform(t, encoding.encode_fit(t)).collect()
    assert sorted((r["split"], r["value"] or "", -9 if r["code"] is None else r["code"]) for r in out) == sorted(
        [("train", "b", 1.0), ("train", "a", 0.0), ("train", "", -9), ("test", "c", -1.0), ("test", "", -9), ("test", "b", 1.0)]
    )


def test_scaling_constant_feature_and_round_trip(spark):
    rows = [("p", "train", "c", 5.0), ("p", "train", "c", 5.0), ("p", "test", "c", 7.0), ("p", "train", "v", 1.0), ("p", "train", "v", 3.0), ("p", "test", "v", 9.0), ("p", "test", "new", 4.0)]
    t = spark.createDataFrame(rows, "product string, split string, feature string, value double")
    for kind in ("robust", "minmax"):
        fitted = encoding.scale_fit(t, kind)
        scaled = encoding.scale_transform(t, fitted)
        assert {r["scaled"] for r in scaled.filter("feature = 'c'").collect()} == {0.0, 2.0}
        back = encoding.scale_inverse(scaled.drop("value"), fitted).collect()
        assert sorted((r["feature"], r["value"]) for r in back) == sorted((f, v) for _, _, f, v in rows)
    with pytest.raises(ValueError):
        encoding.scale_fit(t, "other")


def test_extrapolation_keeps_a_missing_last_value(long):
    d = long({"a": [1, 2, 3]}).withColumn("f", F.when(F.col("y") < 3, F.col("y")))
    assert {r["f"] for r in temporal.extrapolate_last(d, 2).collect()} == {None}


def test_permutations_keep_the_values(long):
    d = long({"a": list(range(20)), "b": [1, 2, 3, 4]}).withColumn("f", F.col("y") * 2)
    for fn in (influence.permute_column, influence.permute_blocks):
        rows = fn(d, "f").collect()
        for p in ("a", "b"):
            part = [r for r in rows if r["product"] == p]
            assert sorted(r["original"] for r in part) == sorted(r["permuted"] for r in part)
    blocks = [r["permuted"] for r in sorted(influence.permute_blocks(d, "f").filter("product = 'a'").collect(), key=lambda r: r["i"])]
    assert blocks[18:] == [36.0, 38.0]
    assert all(blocks[k + 1] - blocks[k] == 2 for b in range(6) for k in (3 * b, 3 * b + 1))


def test_importance_of_an_unused_feature_is_zero(long):
    d = long({"a": [10 + k % 7 for k in range(40)]}).withColumn("u", F.col("y") * 3).withColumn("v", F.col("y") + 1)
    p = influence.pack_features(d, ["u", "v"])
    got = by(influence.permutation_importance(p, ["u", "v"], lambda x: x["u"] / 3), "feature")
    assert got["u"]["pct"] == 100.0 and got["v"]["pct"] == 0.0


def test_router():
    r = influence.importance_router
    assert r("XGBoost") == () and r("XGBoost", True, True, True) == ("builtin", "shap")
    assert r("XGBoost", True) == ("builtin",)
    assert r("Prophet", True, True) == ("regressor_coefficients", "permutation")
    assert r("Chronos", True) == () and r("Other", True) == ("permutation",)
    assert influence.importance_router_generic(shap=False) == ("permutation",)
    assert influence.importance_router_generic(False) == ()


def test_stores(spark):
    path = shared_folder(spark) + "/nothing-here"
    assert store.param_store_read(spark, path).isEmpty()
    assert store.run_summary_read(spark, path) is None
    m = spark.createDataFrame([("a", "x", 1.0, 0.1, 0.5)], "product string, model string, rmse double, mape double, mae double")
    text = store.run_summary(m, "p", "t", "d").select(F.to_json("models")).first()[0]
    assert "validation" not in text and "feature_importance" not in text and "backtest" in text
