"""Encoding and scaling on training rows only."""

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks.q_windows import JOINED
from checks.registry import final, query
from checks.tables import supplier, supplier_features
from monthloom.operators import encoding as E
from monthloom.operators.joins import split_with_features

BASE = JOINED + ",\nw AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY product ORDER BY ds DESC) <= 60), x AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY product) AS n FROM w)," + S.split("x", "b") + """,
txt AS (SELECT product, ds, split, 'promo' AS feature, promo AS value FROM b UNION ALL SELECT product, ds, split, 'band', CASE WHEN price > 1500 THEN 'high' WHEN price > 1300 THEN 'mid' WHEN price IS NOT NULL THEN 'low' END FROM b),
num AS (SELECT product, ds, split, 'discount' AS feature, discount AS value FROM b UNION ALL SELECT product, ds, split, 'price', price FROM b),
cats AS (SELECT product, feature, category, row_number() OVER (PARTITION BY product, feature ORDER BY category) - 1 AS code FROM (SELECT DISTINCT product, feature, value AS category FROM txt WHERE split = 'train' AND value IS NOT NULL)),
coded AS (SELECT t.*, CASE WHEN t.value IS NOT NULL THEN CAST(coalesce(c.code, -1) AS DOUBLE) END AS code FROM txt t LEFT JOIN cats c ON c.product = t.product AND c.feature = t.feature AND c.category = t.value),
rob AS (SELECT product, feature, quantile_cont(value, 0.5) AS center, CASE WHEN quantile_cont(value, 0.75) = quantile_cont(value, 0.25) THEN 1.0 ELSE quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END AS scale FROM num WHERE split = 'train' GROUP BY 1, 2),
mm AS (SELECT product, feature, min(value) AS center, CASE WHEN max(value) = min(value) THEN 1.0 ELSE max(value) - min(value) END AS scale FROM num WHERE split = 'train' GROUP BY 1, 2),
both_long AS (SELECT product, ds, split, feature, code AS value FROM coded UNION ALL SELECT * FROM num),
both_mm AS (SELECT product, feature, min(value) AS center, CASE WHEN max(value) = min(value) THEN 1.0 ELSE max(value) - min(value) END AS scale FROM both_long WHERE split = 'train' GROUP BY 1, 2)"""


def table(spark, sf):
    t = split_with_features(supplier(spark, sf), supplier_features(spark, sf))
    band = F.when(F.col("price") > 1500, "high").when(F.col("price") > 1300, "mid").when(F.col("price").isNotNull(), "low")
    return t.withColumn("band", band)


TEXT, NUMBERS = ["promo", "band"], ["discount", "price"]


def text(spark, sf):
    return E.melt(table(spark, sf), TEXT)


def numbers(spark, sf):
    return E.melt(table(spark, sf), NUMBERS)


@query("encode_fit", final(BASE, "cats", "product feature category code:i"))
def q_encode_fit(spark, sf):
    return E.encode_fit(text(spark, sf))


@query("encode_transform", final(BASE, "coded", "product ds:d split feature value code:f"))
def q_encode_transform(spark, sf):
    t = text(spark, sf)
    return E.encode_transform(t, E.encode_fit(t))


@query("scale_fit_robust", final(BASE, "rob", "product feature center:f scale:f", 9), 9)
def q_robust(spark, sf):
    return E.scale_fit(numbers(spark, sf), "robust")


@query("scale_fit_minmax", final(BASE, "mm", "product feature center:f scale:f"))
def q_minmax(spark, sf):
    return E.scale_fit(numbers(spark, sf), "minmax")


@query("scaler_params", final(BASE, "(SELECT product, 'minmax' AS scaler_type, feature, -center / scale AS min, 1 / scale AS scale FROM mm)", "product scaler_type feature min:f scale:f"))
def q_scaler_params(spark, sf):
    return E.scaler_params(E.scale_fit(numbers(spark, sf), "minmax"), "minmax")


@query("scale_transform", final(BASE, "(SELECT n.*, (value - center) / scale AS scaled FROM num n JOIN rob USING (product, feature))", "product ds:d split feature value:f scaled:f"))
def q_scale_transform(spark, sf):
    n = numbers(spark, sf)
    return E.scale_transform(n, E.scale_fit(n))


@query("scale_inverse", final(BASE, "num", "product ds:d split feature value:f"))
def q_scale_inverse(spark, sf):
    n = numbers(spark, sf)
    fitted = E.scale_fit(n)
    return E.scale_inverse(E.scale_transform(n, fitted).drop("value"), fitted).drop("scaled")


@query("encode_and_scale", final(BASE, "(SELECT l.product, l.ds, l.split, l.feature, (value - center) / scale AS value FROM both_long l JOIN both_mm m ON m.product = l.product AND m.feature = l.feature)", "product ds:d split feature value:f"))
def q_encode_and_scale(spark, sf):
    return E.melt(E.encode_and_scale(table(spark, sf), TEXT, NUMBERS, "minmax"), [*TEXT, *NUMBERS])


@query("encode_and_scale_robust", final(BASE + ",\nboth_rob AS (SELECT product, feature, quantile_cont(value, 0.5) AS center, CASE WHEN quantile_cont(value, 0.75) = quantile_cont(value, 0.25) THEN 1.0 ELSE quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END AS scale FROM both_long WHERE split = 'train' GROUP BY 1, 2)", "(SELECT l.product, l.ds, l.split, l.feature, (value - center) / scale AS value FROM both_long l JOIN both_rob m ON m.product = l.product AND m.feature = l.feature)", "product ds:d split feature value:f"))
def q_encode_and_scale_robust(spark, sf):
    return E.melt(E.encode_and_scale(table(spark, sf), TEXT, NUMBERS, "robust"), [*TEXT, *NUMBERS])


@query("encode_only", final(BASE, "both_long", "product ds:d split feature value:f"))
def q_encode_only(spark, sf):
    return E.melt(E.encode_and_scale(table(spark, sf), TEXT, NUMBERS), [*TEXT, *NUMBERS])
