"""Influence measures on the two-regressor linear model, and their blends."""

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks.q_blend import LEVELS, levels
from checks.registry import final, query
from checks.tables import SUPPLIER, read, supplier
from monthloom.models.linear import linear_fit, linear_score
from monthloom.operators import influence as I
from monthloom.operators.blending import inverse_mape_weights
from monthloom.operators.temporal import lag_features

FEATURES = ["y_lag_1", "y_lag_12"]

ROWS = SUPPLIER + """,
lagged AS (SELECT product, ds, y, lag(y, 1) OVER w AS y_lag_1, lag(y, 12) OVER w AS y_lag_12 FROM supplier_d WINDOW w AS (PARTITION BY product ORDER BY ds)),
r AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY product) AS n FROM lagged WHERE y IS NOT NULL AND y_lag_1 IS NOT NULL AND y_lag_12 IS NOT NULL),
mo AS (SELECT product, var_pop(y_lag_1) AS v1, var_pop(y_lag_12) AS v2, covar_pop(y_lag_1, y_lag_12) AS c12, covar_pop(y_lag_1, y) AS c1y, covar_pop(y_lag_12, y) AS c2y, avg(y_lag_1) AS m1, avg(y_lag_12) AS m2, avg(y) AS my FROM r GROUP BY 1),
be AS (SELECT *, (c1y * v2 - c2y * c12) / (v1 * v2 - c12 * c12) AS b1, (c2y * v1 - c1y * c12) / (v1 * v2 - c12 * c12) AS b2 FROM mo),
lm AS (SELECT product, my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM be),
base AS (SELECT r.product, avg(abs((y - (b0 + b1 * y_lag_1 + b2 * y_lag_12)) / (y + 1e-8))) AS baseline FROM r JOIN lm USING (product) GROUP BY 1),
reps AS (SELECT unnest(generate_series(1, 10)) AS rep),
cells AS (SELECT product, i, n, 'y_lag_1' AS feature, y_lag_1 AS v FROM r UNION ALL SELECT product, i, n, 'y_lag_12', y_lag_12 FROM r)"""


def rows(spark, sf):
    return lag_features(supplier(spark, sf), lags=(1, 12)).dropna()


def modelled(spark, sf):
    t = rows(spark, sf)
    fitted = linear_fit(t, *FEATURES)
    return I.pack_features(t, FEATURES).join(fitted, "product")


def score(x):
    return linear_score(x["y_lag_1"], x["y_lag_12"])


@query("linear_fit", final(ROWS, "lm", "product b0:f b1:f b2:f"))
def q_linear(spark, sf):
    return linear_fit(rows(spark, sf), *FEATURES)


def _shuffled(feature, rep):
    """Rows at place ``i`` with the value that the md5 order puts there."""
    return f"""SELECT a.product, a.feature, a.rep, a.i, b.v FROM
 (SELECT c.product, c.feature, {rep} AS rep, i FROM cells c{', reps' if rep == 'rep' else ''}{feature}) a JOIN
 (SELECT c.product, c.feature, {rep} AS rep, v, row_number() OVER (PARTITION BY c.product, c.feature, {rep} ORDER BY md5(c.product || '|' || i || '|' || c.feature || '|' || {rep})) - 1 AS i
  FROM cells c{', reps' if rep == 'rep' else ''}{feature}) b ON b.product = a.product AND b.feature = a.feature AND b.rep = a.rep AND b.i = a.i"""


def _blocked(rep):
    more = ", reps" if rep == "rep" else ""
    return f"""SELECT c.product, c.feature, {rep} AS rep, CASE WHEN i < (n // 3) * 3 THEN o.place * 3 + i % 3 ELSE i END AS i, c.v
 FROM cells c{more} LEFT JOIN (SELECT product AS p2, feature AS f2, {rep} AS r2, blk, row_number() OVER (PARTITION BY product, feature, {rep} ORDER BY md5(product || '|' || blk || '|' || feature || '|' || {rep})) - 1 AS place
   FROM (SELECT DISTINCT product, feature, i // 3 AS blk FROM cells WHERE i < (n // 3) * 3){more}) o
 ON o.p2 = c.product AND o.f2 = c.feature AND o.r2 = {rep} AND o.blk = i // 3"""


ONE = " WHERE feature = 'y_lag_1'"


@query("permute_column", final(ROWS + f",\np AS ({_shuffled(ONE, '1')}), t AS (SELECT p.product, p.i, c.v AS original, p.v AS permuted FROM p JOIN cells c ON c.product = p.product AND c.feature = p.feature AND c.i = p.i)", "t", "product i:i original:f permuted:f"))
def q_permute(spark, sf):
    return I.permute_column(rows(spark, sf), "y_lag_1")


@query("permute_blocks", final(ROWS + f",\np AS ({_blocked('1')}), t AS (SELECT p.product, p.i, c.v AS original, p.v AS permuted FROM p JOIN cells c ON c.product = p.product AND c.feature = p.feature AND c.i = p.i WHERE p.feature = 'y_lag_1')", "t", "product i:i original:f permuted:f"))
def q_permute_blocks(spark, sf):
    return I.permute_blocks(rows(spark, sf), "y_lag_1")


def _errors(permutation):
    return f""",
p AS ({permutation}),
e AS (SELECT p.product, p.feature, p.rep, avg(abs((y - (b0 + b1 * CASE WHEN p.feature = 'y_lag_1' THEN p.v ELSE y_lag_1 END + b2 * CASE WHEN p.feature = 'y_lag_12' THEN p.v ELSE y_lag_12 END)) / (y + 1e-8))) AS err
  FROM p JOIN r ON r.product = p.product AND r.i = p.i JOIN lm ON lm.product = p.product GROUP BY 1, 2, 3),
m AS (SELECT e.product, feature, baseline, avg(err) AS mean_error FROM e JOIN base USING (product) GROUP BY 1, 2, 3)"""


@query(
    "permutation_importance",
    final(ROWS + _errors(_shuffled("", "rep")) + ", s AS (SELECT product, feature, greatest(0, mean_error - baseline) AS s FROM m), t AS (SELECT product, feature, CASE WHEN sum(s) OVER (PARTITION BY product) > 0 THEN round(100 * s / sum(s) OVER (PARTITION BY product), 2) ELSE s END AS pct FROM s)", "t", "product feature pct:f"),
)
def q_permutation_importance(spark, sf):
    return I.permutation_importance(modelled(spark, sf), FEATURES, score)


@query("block_importance", final(ROWS + _errors(_blocked("rep")) + ", t AS (SELECT product, feature, (mean_error - baseline) / baseline AS importance FROM m)", "t", "product feature importance:f"))
def q_block_importance(spark, sf):
    return I.block_importance(modelled(spark, sf), FEATURES, score)


SHAP = ROWS + """,
a AS (SELECT r.product, abs(b1 * (y_lag_1 - avg(y_lag_1) OVER w)) AS a1, abs(b2 * (y_lag_12 - avg(y_lag_12) OVER w)) AS a2 FROM r JOIN lm USING (product) WINDOW w AS (PARTITION BY r.product)),
s AS (SELECT product, avg(a1) AS s1, avg(a2) AS s2 FROM a GROUP BY 1),
t AS (SELECT product, 'y_lag_1' AS feature, round(100 * s1 / (s1 + s2), 2) AS pct FROM s UNION ALL SELECT product, 'y_lag_12', round(100 * s2 / (s1 + s2), 2) FROM s)"""


@query("shapley_importance_linear", final(SHAP, "t", "product feature pct:f"))
def q_shapley_linear(spark, sf):
    t = rows(spark, sf)
    j = t.join(linear_fit(t, *FEATURES), "product")
    return I.shapley_linear(j, {"y_lag_1": F.col("b1"), "y_lag_12": F.col("b2")})


# ---------------------------------------------------- importances spread over brands and types

IMPS = LEVELS + """,
imps AS (SELECT p_brand AS product, p_type AS model, ['builtin', 'shap', 'permutation', 'regressor_coefficients', 'covariates_used'][p_size % 5 + 1] AS imp_type, p_name AS feature, CAST(sum(p_size) AS DOUBLE) AS pct FROM part GROUP BY 1, 2, 3, 4),
pri AS (SELECT * EXCLUDE (rk) FROM (SELECT *, list_position(['builtin', 'shap', 'permutation', 'regressor_coefficients'], imp_type) AS rk FROM imps) WHERE rk > 0 QUALIFY rk = min(rk) OVER (PARTITION BY product, model)),
""" + S.weights("lv", "w", threshold=0.4, cap=2) + """,
tot AS (SELECT product, sum(weight) AS total FROM (SELECT DISTINCT product, model FROM pri) JOIN w USING (product, model) GROUP BY 1),
sc AS (SELECT f.product, f.feature, coalesce((SELECT sum(w.weight * q.pct) FROM pri q JOIN w ON w.product = q.product AND w.model = q.model WHERE q.product = f.product AND q.feature = f.feature), 0) / total AS s
  FROM (SELECT DISTINCT product, feature FROM pri) f JOIN tot USING (product)),
ei AS (SELECT product, feature, CASE WHEN sum(s) OVER (PARTITION BY product) > 0 THEN round(100 * s / sum(s) OVER (PARTITION BY product), 2) ELSE s END AS pct FROM sc)"""


def importances(spark, sf):
    types = F.array(*[F.lit(t) for t in (*I.IMPORTANCE_ORDER, "covariates_used")])
    p = read(spark, sf, "part")
    return p.groupBy(
        F.col("p_brand").alias("product"),
        F.col("p_type").alias("model"),
        F.get(types, F.col("p_size") % 5).alias("imp_type"),
        F.col("p_name").alias("feature"),
    ).agg(F.sum("p_size").cast("double").alias("pct"))


def weights(spark, sf):
    return inverse_mape_weights(levels(spark, sf), 0.4, 2)


@query("importance_priority", final(IMPS, "pri", "product model imp_type feature pct:f"))
def q_priority(spark, sf):
    return I.importance_priority(importances(spark, sf))


@query("ensemble_importance", final(IMPS, "ei", "product feature pct:f"))
def q_ensemble_importance(spark, sf):
    return I.ensemble_importance(I.importance_priority(importances(spark, sf)), weights(spark, sf))


@query(
    "feature_union",
    final(IMPS + ",\nt AS (SELECT m.product, m.model, f.feature, coalesce(p.pct, 0) AS pct FROM (SELECT DISTINCT product, model FROM pri) m JOIN (SELECT DISTINCT product, feature FROM pri) f ON f.product = m.product LEFT JOIN pri p ON p.product = m.product AND p.model = m.model AND p.feature = f.feature)", "t", "product model feature pct:f"),
)
def q_feature_union(spark, sf):
    return I.feature_union(I.importance_priority(importances(spark, sf)))


@query(
    "pct_normalize",
    final(IMPS + ",\nt AS (SELECT product, model, feature, round(100 * pct / sum(pct) OVER (PARTITION BY product, model), 2) AS share FROM pri)", "t", "product model feature share:f"),
)
def q_pct(spark, sf):
    p = I.importance_priority(importances(spark, sf))
    return I.pct_normalize(p, "pct", ("product", "model"), "share").select("product", "model", "feature", "share")


@query("equal_importance", final(IMPS + ",\nt AS (SELECT product, feature, round(100.0::DOUBLE / count(*) OVER (PARTITION BY product), 2) AS pct FROM (SELECT DISTINCT product, feature FROM imps))", "t", "product feature pct:f"))
def q_equal(spark, sf):
    return I.equal_importance(importances(spark, sf).select("product", "feature").distinct())


@query("top_features", final(IMPS + ",\nt AS (SELECT product, feature, pct, row_number() OVER (PARTITION BY product ORDER BY pct DESC, feature) AS rank FROM ei QUALIFY rank <= 10)", "t", "product feature pct:f rank:i"))
def q_top_features(spark, sf):
    return I.top_features(I.ensemble_importance(I.importance_priority(importances(spark, sf)), weights(spark, sf)))


REPORT = IMPS + """,
mo AS (SELECT DISTINCT product, model FROM imps),
t AS (SELECT i.product, i.model, i.imp_type AS part, i.feature, i.pct, round(100 * coalesce(w.weight, 0), 2) AS weight FROM imps i LEFT JOIN w ON w.product = i.product AND w.model = i.model
 UNION ALL SELECT e.product, 'ensemble', 'inverse_mape_weighted', e.feature, e.pct, NULL FROM ei e)"""


@query("importance_report", final(REPORT, "t", "product model part feature pct:f weight:f"))
def q_importance_report(spark, sf):
    """The nested report, taken apart again."""
    r = I.importance_report(importances(spark, sf), weights(spark, sf))
    models = r.select("product", F.explode("models").alias("model", "entry")).select(
        "product", "model", "entry.weight", F.explode("entry.measures").alias("part", "values")
    )
    flat = models.select("product", "model", "part", F.explode("values").alias("feature", "pct"), "weight")
    blend = r.select("product", F.lit("ensemble").alias("model"), F.col("ensemble.method").alias("part"), F.explode("ensemble.importance").alias("feature", "pct"))
    return flat.unionByName(blend.withColumn("weight", F.lit(None).cast("double")))
