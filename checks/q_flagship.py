"""The runs end to end."""

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks.registry import final, query
from checks.q_windows import CAL_COLS, CALENDAR, LAG_COLS, LAGS, ROLL_COLS, ROLLS
from checks.sqltrees import DEEP_TWO, leaf_of
from checks.sqltrees import boosted as boosted_sql
from checks.tables import SUPPLIER, SUPPLIER_FEATURES, bounds, read, supplier_features, supplier_raw
from monthloom.plans.multivariate import run_cross, run_default, run_features
from monthloom.plans.univariate import run_univariate
from monthloom.settings import Settings

EXACT = ("AR1", "ARI1", "HoltWinters")


def outlook(spark, sf, models=EXACT):
    return run_univariate(supplier_raw(spark, sf), Settings(models=models), bounds=bounds(spark, sf))


@query("outlook_univariate", final(SUPPLIER + "," + S.outlook("supplier_d"), "ens", "product step:i ds:d yhat:f", 4), 4)
def outlook_univariate(spark, sf):
    return outlook(spark, sf).ensemble


# saved parameters for products that do not end in 1, defaults for the others
GIVEN = SUPPLIER + "," + S.prepared("supplier_d") + """,
whole AS (SELECT product, i, clean AS y FROM cl), last_row AS (SELECT product, max(ds) AS last FROM cl GROUP BY 1),
own AS (SELECT 'Supplier ' || l_suppkey AS product, CASE WHEN l_suppkey % 10 <> 1 THEN 'saved' ELSE 'defaults' END AS origin,
  CAST(CASE WHEN l_suppkey % 10 <> 1 THEN '0.' || (1 + count(*) % 8) ELSE '0.3' END AS DOUBLE) AS alpha, CAST(0.1 AS DOUBLE) AS beta, CAST(0.2 AS DOUBLE) AS gamma
  FROM lineitem GROUP BY l_suppkey),""" + S.hw_run("whole", "own", "hw") + "," + S.hw_best("hw", "best") + "," + S.hw_path("best", "path") + """,
t AS (SELECT p.product, origin, o.alpha, step, CAST(last + to_months(CAST(step AS INTEGER)) AS DATE) AS ds, y AS yhat FROM path p JOIN last_row USING (product) JOIN own o ON o.product = p.product)"""


@query("run_params", final(GIVEN, "t", "product origin alpha:f step:i ds:d yhat:f", 4), 4)
def run_params(spark, sf):
    """A run on saved and configured parameters: where they came from, and the forecasts they give."""
    k, rows = F.col("l_suppkey"), F.count(F.lit(1))
    text = F.concat(F.lit('{"alpha":0.'), (1 + rows % 8).cast("string"), F.lit(',"beta":0.1,"gamma":0.2}')).alias("params_json")
    per = read(spark, sf, "lineitem").filter("l_suppkey % 10 <> 1").groupBy(k).agg(text)
    product = F.concat(F.lit("Supplier "), k.cast("string")).alias("product")
    saved = per.select(product, F.lit("HoltWinters").alias("model"), "params_json")
    config = spark.createDataFrame([("HoltWinters", False, '{"alpha":0.3,"beta":0.1,"gamma":0.2}')], "model string, optimize boolean, defaults_json string")
    o = run_univariate(supplier_raw(spark, sf), Settings(models=("HoltWinters",)), bounds=bounds(spark, sf), params=saved, config=config)
    used = o.params.select("product", "origin", F.get_json_object("params_json", "$.alpha").cast("double").alias("alpha"))
    return o.forecasts.drop("model").join(used, "product")


FEATURE_RUN = {"categorical": ["promo"], "numeric": ["discount", "price"]}
def feature_run(spark, sf):
    return run_features(supplier_raw(spark, sf), supplier_features(spark, sf), bounds=bounds(spark, sf), **FEATURE_RUN)


@query("outlook_features")
def outlook_features(spark, sf):
    """The default run: 100 rounds of trees of depth 6 for each product, and the regression."""
    return feature_run(spark, sf).ensemble


@query("outlook_features_importance")
def outlook_features_importance(spark, sf):
    return feature_run(spark, sf).extras["ensemble_importance"]


@query("outlook_features_measures")
def outlook_features_measures(spark, sf):
    """Every importance that the switches allow, per product and model."""
    return feature_run(spark, sf).extras["importances"]


@query("outlook_cross")
def outlook_cross(spark, sf):
    """Suppliers as products, each with two partners."""
    from checks.q_windows import partners

    o = run_cross(
        supplier_raw(spark, sf), supplier_features(spark, sf), partners(spark, sf), [1, 2], bounds=bounds(spark, sf), **FEATURE_RUN
    )
    return o.ensemble


@query("outlook_default")
def outlook_default(spark, sf):
    o = run_default(supplier_raw(spark, sf), supplier_features(spark, sf), bounds=bounds(spark, sf), **FEATURE_RUN)
    return o.ensemble


# The run on few small trees: backtest, forecast, error measures, weights and blend against SQL.
FEW = {"rounds": 3, "depth": 2, "rate": 0.3}
PREPARED = SUPPLIER + "," + S.prepared("supplier_d") + ", " + SUPPLIER_FEATURES.strip()
TEMPORAL_NAMES = [c.split(":")[0] for c in (LAG_COLS + " " + ROLL_COLS + " " + CAL_COLS).split()]


def _exact_run():
    lagged = f"""
lagged AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ds) - 1 AS r FROM (SELECT product, ds, i, y, d, {LAGS}, {ROLLS}, {CALENDAR} FROM (
  SELECT c.product, c.ds, c.i, c.clean AS y, discount AS d FROM cl c LEFT JOIN feats f ON f.product = c.product AND f.ds = c.ds)) WHERE y_lag_12 IS NOT NULL AND y_roll_std_12 IS NOT NULL AND d IS NOT NULL)"""
    x = ", ".join([f"round(CAST({c} AS DOUBLE), 9)" for c in TEMPORAL_NAMES] + ["d"])
    return lagged, x


def exact_features():
    lagged, x = _exact_run()
    n = len(TEMPORAL_NAMES) + 1
    ahead = f"""[{", ".join(f"hist[{13 - k}]" for k in (1, 2, 3, 6, 12))}, {", ".join(f"list_avg(hist[{13 - k}:12]), list_stddev_samp(hist[{13 - k}:12])" for k in (3, 6, 12))},
        month(at_ds), quarter(at_ds), year(at_ds), sin(2 * pi() * month(at_ds) / 12), cos(2 * pi() * month(at_ds) / 12), at_d]"""

    def path(rows, begin, given):
        """A sub-query with product, step, ds, yhat."""
        return f"""(WITH RECURSIVE seen AS MATERIALIZED (SELECT product, y, row_number() OVER (PARTITION BY product ORDER BY ds) - 1 AS r, [{x}] AS x FROM lagged WHERE {rows}),
{boosted_sql("seen", n, FEW["rounds"], FEW["depth"], FEW["rate"])},
{DEEP_TWO},
h0 AS (SELECT product, list(clean ORDER BY i)[{begin} - 11:{begin}] AS hist, max(ds) FILTER (WHERE i = {begin} - 1) AS last FROM cl GROUP BY 1),
p AS (SELECT product, 0 AS step, hist, last, CAST(NULL AS DATE) AS ds, CAST(NULL AS DOUBLE) AS yhat FROM h0
  UNION ALL SELECT product, step + 1, list_append(hist[2:12], v), last, at_ds, v FROM (
    SELECT q.product, step, hist, last, at_ds, base + list_sum(list_transform(trees, lambda t: {leaf_of("t", "x")})) AS v FROM (
      SELECT product, step, hist, last, at_ds, {ahead} AS x FROM (SELECT p.product, p.step, p.hist, p.last, CAST(last + to_months(CAST(p.step + 1 AS INTEGER)) AS DATE) AS at_ds, coalesce(g.d, 0) AS at_d
        FROM p LEFT JOIN (SELECT product, step AS g_step, d FROM ({given})) g ON g.product = p.product AND g.g_step = p.step + 1 WHERE p.step < 12)) q
    JOIN forest f ON f.product = q.product JOIN base b ON b.product = q.product))
SELECT product, step, ds, yhat FROM p WHERE step > 0)"""

    known = "SELECT c.product, c.i - 47 AS step, f.discount AS d FROM cl c LEFT JOIN feats f ON f.product = c.product AND f.ds = c.ds WHERE c.i >= 48"
    repeat = "SELECT c.product, unnest(range(1, 13)) AS step, f.discount AS d FROM cl c LEFT JOIN feats f ON f.product = c.product AND f.ds = c.ds WHERE c.i = 59"
    return f"""{PREPARED},{lagged},
bt AS MATERIALIZED {path("i < 48", 48, known)},
fc AS MATERIALIZED {path("TRUE", 60, repeat)},
err AS (SELECT b.product, sqrt(avg((c.clean - yhat) ** 2)) AS rmse, avg(abs((c.clean - yhat) / nullif(c.clean, 0))) AS mape FROM bt b JOIN cl c ON c.product = b.product AND c.ds = b.ds GROUP BY 1),
t AS (SELECT fc.product, step, ds, yhat, rmse FROM fc JOIN err USING (product))"""


@query("outlook_trees", final(exact_features(), "t", "product step:i ds:d yhat:f rmse:f", 4), 4)
def outlook_trees(spark, sf):
    """A feature run with few small trees per product: its forecasts and the error of its backtest."""
    o = run_features(
        supplier_raw(spark, sf), supplier_features(spark, sf), [], ["discount"], Settings(models=("XGBoost",)), bounds(spark, sf), tree_options=FEW
    )
    return o.forecasts.drop("model").join(o.metrics.select("product", "rmse"), "product")
