"""Model fits, forecasts and parameter search on the cleaned supplier series."""

import pandas as pd
from pyspark.sql import functions as F

from checks import sqlparts as S
from checks.q_flagship import outlook
from checks.q_windows import CALENDAR, LAGS, ROLLS
from checks.registry import final, query
from checks.sqltrees import DEEP_TWO, leaf_of
from checks.sqltrees import boosted as boosted_sql
from checks.tables import SUPPLIER, SUPPLIER_FEATURES, supplier, supplier_features, supplier_raw
from monthloom.models import autoreg, boosted, grown, regress, sarima, smoothing
from monthloom.models.catalog import model_select, model_table
from monthloom.models.custom import plug_forecaster
from monthloom.operators import influence, tuning
from monthloom.operators.calendar import unpack
from monthloom.operators.joins import join_features
from monthloom.operators.temporal import temporal_features
from monthloom.plans.common import prepare
from monthloom.session import reuse
from monthloom.settings import Settings


def packed(spark, sf):
    return prepare(supplier(spark, sf), Settings()).select("product", "start", "n", "ys")


WHOLE = SUPPLIER + "," + S.prepared("supplier_d") + ",\nwhole AS (SELECT product, i, clean AS y FROM cl), last_row AS (SELECT product, max(ds) AS last FROM cl GROUP BY 1)"
DATED = "CAST(last + to_months(CAST(step AS INTEGER)) AS DATE) AS ds"
HW = WHOLE + "," + S.GRID + "," + S.hw_run("whole", "hw_grid", "hw") + "," + S.hw_best("hw", "best")


@query("hw_fit", final(HW, "(SELECT *, 'add-add' AS kind, season[1] AS s1, season[12] AS s12 FROM best)", "product kind alpha:f beta:f gamma:f sse:f level:f trend:f s1:f s12:f", 4), 4)
def q_hw_fit(spark, sf):
    f = smoothing.hw_fit(packed(spark, sf))
    return f.select("product", "fit.*").select("*", F.col("season")[0].alias("s1"), F.col("season")[11].alias("s12")).drop("season")


@query("hw_forecast", final(HW + "," + S.hw_path("best", "path"), f"(SELECT p.product, step, {DATED}, y AS yhat FROM path p JOIN last_row USING (product))", "product step:i ds:d yhat:f", 4), 4)
def q_hw_forecast(spark, sf):
    return smoothing.hw_forecast(smoothing.hw_fit(packed(spark, sf)))


# twenty months are too few for a season: level and trend only
SHORT = WHOLE + """,
cut AS (SELECT product, i - 40 AS i, y FROM whole WHERE i >= 40),
ab AS (SELECT a.v::DOUBLE AS alpha, b.v::DOUBLE AS beta FROM (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS v) a, (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS v) b),
ys AS (SELECT product, list(y ORDER BY i) AS ys FROM cut GROUP BY 1),
r AS (
  SELECT product, alpha, beta, 1 AS i, ys[1] AS level, ys[2] - ys[1] AS trend, CAST(0.0 AS DOUBLE) AS sse FROM ys, ab
  UNION ALL
  SELECT product, alpha, beta, i + 1, lv, beta * (lv - level) + (1 - beta) * trend, sse + (y - level - trend) ** 2
  FROM (SELECT r.*, ys[r.i + 1] AS y, alpha * ys[r.i + 1] + (1 - alpha) * (level + trend) AS lv FROM r JOIN ys ON ys.product = r.product WHERE r.i < len(ys))),
t AS (SELECT *, 'add-none' AS kind FROM r WHERE i = 20 QUALIFY row_number() OVER (PARTITION BY product ORDER BY sse, alpha, beta) = 1)"""


@query("hw_nonseasonal", final(SHORT, "t", "product kind alpha:f beta:f sse:f level:f trend:f", 4), 4)
def q_hw_short(spark, sf):
    f = smoothing.hw_fit(packed(spark, sf).withColumn("ys", F.slice("ys", 41, 20)))
    return f.select("product", "fit.kind", "fit.alpha", "fit.beta", "fit.sse", "fit.level", "fit.trend")


MUL = WHOLE + "," + S.GRID + """,
up AS (SELECT product, list(y + 1.0 ORDER BY i) AS ys FROM whole GROUP BY 1),
up_0 AS (SELECT product, ys, list_avg(ys[1:12]) AS l0, list_avg(ys[13:24]) AS l1 FROM up),
hm AS (
  SELECT s.product, g.alpha, g.beta, g.gamma, 12 AS i, len(ys) AS n, l0 AS level, pow(l1 / l0, 1.0::DOUBLE / 12) AS trend,
         list_transform(ys[1:12], lambda v: v / l0) AS season, CAST(0.0 AS DOUBLE) AS sse
  FROM up_0 s, hw_grid g
  UNION ALL
  SELECT product, alpha, beta, gamma, i + 1, n, lv, beta * (lv / level) + (1 - beta) * trend,
         list_append(season[2:12], gamma * (y / (level * trend)) + (1 - gamma) * season[1]), sse + (y - level * trend * season[1]) ** 2
  FROM (SELECT r.*, o.ys[r.i + 1] AS y, r.alpha * (o.ys[r.i + 1] / r.season[1]) + (1 - r.alpha) * (r.level * r.trend) AS lv
        FROM hm r JOIN up_0 o ON o.product = r.product WHERE r.i < r.n)),""" + S.hw_best("hm", "mb") + f""",
t AS (SELECT product, step, {DATED}, level * pow(trend, step) * season[(step - 1) % 12 + 1] AS yhat
  FROM mb JOIN last_row USING (product), (SELECT unnest(generate_series(1, 12)) AS step) k)"""


@query("hw_multiplicative", final(MUL, "t", "product step:i ds:d yhat:f", 3), 3)
def q_hw_mul(spark, sf):
    p = packed(spark, sf).withColumn("ys", F.transform("ys", lambda v: v + 1.0))
    return smoothing.hw_forecast(smoothing.hw_fit(p, trend="mul", seasonal="mul"))


AR = WHOLE + "," + S.ar_fit("whole", "a0", 0) + "," + S.ar_fit("whole", "a1", 1)


@query("ar_fit", final(AR, "(SELECT product, 0 AS d, phi, c AS const FROM a0 UNION ALL SELECT product, 1, phi, c FROM a1)", "product d:i phi:f const:f"))
def q_ar_fit(spark, sf):
    p = packed(spark, sf).withColumns({"f0": autoreg.ar_column(F.col("ys"), 0), "f1": autoreg.ar_column(F.col("ys"), 1)})
    both = F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"f{d}.phi").alias("phi"), F.col(f"f{d}.const").alias("const")) for d in (0, 1)])
    return p.select("product", F.inline(both))


@query("ar_forecast", final(AR + "," + S.ar_path("a1", "path", 1), f"(SELECT p.product, step, {DATED}, y AS yhat FROM path p JOIN last_row USING (product))", "product step:i ds:d yhat:f"))
def q_ar_forecast(spark, sf):
    return autoreg.ar_forecast(autoreg.ar_fit(packed(spark, sf), 1), 12, 1)


@query("sarima_fit")
def q_sarima_fit(spark, sf):
    """One given order per series: the configured default (1,1,1)(1,1,1)12."""
    f = sarima.sarima_fit(packed(spark, sf), [(1, 1, 1, 1, 1, 1)])
    return f.select("product", "fit.p", "fit.d", "fit.q", "fit.sp", "fit.sd", "fit.sq", "fit.aic", "fit.sse", F.array_join(F.transform("fit.params", lambda v: F.round(v, 4).cast("string")), ",").alias("params"))


@query("sarima_grid")
def q_sarima_grid(spark, sf):
    return sarima.best_order(sarima.sarima_grid(packed(spark, sf)))


@query("outlook_sarima")
def q_outlook_sarima(spark, sf):
    return outlook(spark, sf, ("SARIMA", "HoltWinters")).ensemble


def _uniform(*parts):
    text = " || '|' || ".join(parts)
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _trial(name):
    return f"round(0.05::DOUBLE + 0.9::DOUBLE * {_uniform('product', chr(39) + name + chr(39), 'trial')}, 9) AS {name}"


TUNE = WHOLE + f""",
sizes AS (SELECT product, CAST(floor(count(*) * 0.8) AS INTEGER) AS cut FROM whole GROUP BY 1),
own_trials AS (SELECT product, trial, {_trial('alpha')}, {_trial('beta')}, {_trial('gamma')} FROM sizes, (SELECT unnest(generate_series(1, 5)) AS trial)),
fit_rows AS (SELECT w.* FROM whole w JOIN sizes s ON s.product = w.product AND w.i < s.cut),
{S.hw_run('fit_rows', 'own_trials', 'hw')},
ends AS (SELECT * FROM hw WHERE i = n),
sc AS (SELECT e.product, o.trial, e.alpha, e.beta, e.gamma,
  avg(abs((w.y - (level + (w.i - cut + 1) * trend + season[(w.i - cut) % 12 + 1])) / (w.y + 1e-8))) AS score
  FROM ends e JOIN own_trials o ON o.product = e.product AND o.alpha = e.alpha AND o.beta = e.beta AND o.gamma = e.gamma
  JOIN sizes s ON s.product = e.product JOIN whole w ON w.product = e.product AND w.i >= s.cut GROUP BY 1, 2, 3, 4, 5),
t AS (SELECT product, trial, alpha, beta, gamma, score AS best_value, 5 AS trials_used FROM sc QUALIFY row_number() OVER (PARTITION BY product ORDER BY score, trial) = 1)"""


@query("tune_search", final(TUNE, "t", "product trial:i alpha:f beta:f gamma:f best_value:f trials_used:i"))
def q_tune(spark, sf):
    return tuning.tune_smoothing(packed(spark, sf), 5)


@query("tune_search_sarima")
def q_tune_sarima(spark, sf):
    return tuning.tune_sarima(packed(spark, sf), 5)


@query("tune_search_regression")
def q_tune_regression(spark, sf):
    return tuning.tune_regression(with_regressors(spark, sf), 5, xs="xs")


def _space_sql():
    from monthloom.settings import SEARCH_SPACES

    rows = []
    for family, space in SEARCH_SPACES.items():
        for name, spec in space.items():
            u = _uniform("product", f"'{name}'", "trial")
            num, txt = "NULL::DOUBLE", "NULL::VARCHAR"
            if spec[0] == "int":
                num = f"(floor({u} * {spec[2] - spec[1] + 1}) + {spec[1]})::DOUBLE"
            elif spec[0] == "float":
                num = f"{spec[1]}::DOUBLE + {u} * {spec[2] - spec[1]!r}::DOUBLE"
            elif spec[0] == "logfloat":
                num = f"{spec[1]!r}::DOUBLE * pow({spec[2] / spec[1]!r}::DOUBLE, {u})"
            else:
                txt = f"CASE floor({u} * {len(spec[1])}) WHEN 0 THEN '{spec[1][0]}' ELSE '{spec[1][1]}' END"
            rows.append(f"SELECT product, '{family}' AS family, trial, '{name}' AS param, {num} AS num, {txt} AS txt FROM p")
    return (
        "p AS (SELECT DISTINCT 'Supplier ' || l_suppkey AS product, trial FROM lineitem, (SELECT unnest(generate_series(1, 5)) AS trial)),"
        " t AS (" + " UNION ALL ".join(rows) + ")"
    )


@query("search_space", final(_space_sql(), "t", "product family trial:i param num:f txt"))
def q_space(spark, sf):
    from monthloom.settings import SEARCH_SPACES

    products = supplier_raw(spark, sf).select("product").distinct()
    out = None
    for family in SEARCH_SPACES:
        part = tuning.search_space(products, family, 5).withColumn("family", F.lit(family))
        out = part if out is None else out.unionByName(part)
    num = F.col("value").try_cast("double")
    return out.select("product", "family", "trial", "param", num.alias("num"), F.when(num.isNull(), F.col("value")).alias("txt"))


@query(
    "decompose_classic",
    final(
        WHOLE + """,
f AS (SELECT product, regr_slope(clean, i) AS b, regr_intercept(clean, i) AS a FROM cl GROUP BY 1),
d AS (SELECT product, ds, clean AS y, a + b * i AS trend, clean - (a + b * i) AS dt FROM cl JOIN f USING (product)),
m AS (SELECT product, month(ds) AS mo, avg(dt) AS seasonal FROM d GROUP BY 1, 2),
w AS (SELECT d.product, d.ds, trend, seasonal, dt - seasonal AS remainder FROM d JOIN m ON m.product = d.product AND m.mo = month(d.ds)),
t AS (SELECT product, ds, 'trend' AS component, trend AS value FROM w UNION ALL SELECT product, ds, 'seasonal', seasonal FROM w UNION ALL SELECT product, ds, 'remainder', remainder FROM w)""",
        "t",
        "product ds:d component value:f",
    ),
)
def q_decompose(spark, sf):
    return regress.decompose_classic(unpack(packed(spark, sf)))


RECURSIVE = WHOLE + """,
h AS (SELECT product, list(y ORDER BY i)[49:60] AS hist FROM whole GROUP BY 1),
p AS (
  SELECT product, 0 AS step, hist, CAST(NULL AS DOUBLE) AS yhat FROM h
  UNION ALL
  SELECT product, step + 1, list_append(hist[2:12], v), v FROM (
    SELECT p.product, step, hist, 0.2 * hist[12] + 0.3 * hist[1] + 0.4 * list_avg(hist[10:12]) + 0.1 * list_stddev_samp(hist[7:12])
       + 2 * sin(2 * pi() * month(CAST(last + to_months(CAST(step + 1 AS INTEGER)) AS DATE)) / 12) AS v
    FROM p JOIN last_row l ON l.product = p.product WHERE step < 12)),
t AS (SELECT p.product, step, CAST(last + to_months(CAST(step AS INTEGER)) AS DATE) AS ds, yhat FROM p JOIN last_row l ON l.product = p.product WHERE step > 0)"""


@query("recursive_forecast_linear", final(RECURSIVE, "t", "product step:i ds:d yhat:f"))
def q_recursive_linear(spark, sf):
    def score(x):
        return (
            F.lit(0.2) * x["y_lag_1"]
            + F.lit(0.3) * x["y_lag_12"]
            + F.lit(0.4) * x["y_roll_mean_3"]
            + F.lit(0.1) * x["y_roll_std_6"]
            + F.lit(2.0) * x["month_sin"]
        )

    return boosted.recursive_fold(packed(spark, sf), score)


# Trees are compared with their definition: few rounds of small trees, as chained histograms in SQL.
FEW = {"rounds": 3, "depth": 2, "rate": 0.3}
TEMPORAL_X = ", ".join(f"round({c}, 6)" for c in boosted.TEMPORAL)
TREES = (
    WHOLE
    + f""",
lagged AS (SELECT * FROM (SELECT product, ds, y, {LAGS}, {ROLLS}, {CALENDAR} FROM (SELECT product, ds, clean AS y FROM cl)) WHERE y_lag_12 IS NOT NULL AND y_roll_std_12 IS NOT NULL),
seen AS MATERIALIZED (SELECT product, ds, y, row_number() OVER (PARTITION BY product ORDER BY ds) - 1 AS r, [{TEMPORAL_X}] AS x FROM lagged),
"""
    + boosted_sql("seen", len(boosted.TEMPORAL), FEW["rounds"], FEW["depth"], FEW["rate"])
)


def tree_table(spark, sf):
    """Packed training rows of every supplier; features rounded, so that equal ones are equal in both engines."""
    table = temporal_features(unpack(packed(spark, sf)).select("product", "ds", "y"))
    rounded = [F.round(F.col(c).cast("double"), 6).alias(c) for c in boosted.TEMPORAL]
    return grown.pack_rows(table.select("product", "ds", "y", *rounded), boosted.TEMPORAL)


def grown_few(spark, sf):
    return grown.grow_trees(tree_table(spark, sf), len(boosted.TEMPORAL), {"trees": F.size("target")}, **FEW)


def fitted_rows(df):
    df = df.withColumn("yhat", grown.tree_scores(F.col("trees"), F.col("x")))
    z = F.arrays_zip(F.col("target").alias("y"), "yhat")
    return df.select("product", F.posexplode(z).alias("r", "z")).select("product", "r", "z.y", "z.yhat")


@query("gbt_fit", final(TREES, "(SELECT f.product, f.r, y, yhat FROM fitted f JOIN seen USING (product, r))", "product r:i y:f yhat:f", 5), 5)
def q_gbt(spark, sf):
    """Trees of each product: the fitted value of every training row."""
    return fitted_rows(grown_few(spark, sf))


@query("gbt_fit_full")
def q_gbt_full(spark, sf):
    """The same with the default 100 rounds of depth 6."""
    return fitted_rows(grown.grow_trees(tree_table(spark, sf), len(boosted.TEMPORAL), {"trees": F.size("target")}))


@query(
    "gbt_nodes",
    final(
        TREES,
        """(SELECT s.product, s.t AS tree, count(*) AS splits, sum(gain) AS gain, sum(cut) AS mid, any_value(w.value) AS leaf_mass
  FROM splits s JOIN (SELECT product, t, sum(cover * value) AS value FROM leaves GROUP BY ALL) w ON w.product = s.product AND w.t = s.t GROUP BY 1, 2)""",
        "product tree:i splits:i gain:f mid:f leaf_mass:f",
        5,
    ),
    5,
)
def q_gbt_nodes(spark, sf):
    """The fitted trees as a table of nodes, summed up per tree."""
    rows = grown.tree_rows(grown_few(spark, sf), "trees", "product")
    leaf = F.col("left").isNull()
    return rows.groupBy("product", "tree").agg(
        F.count("left").alias("splits"), F.sum(F.when(~leaf, F.col("gain"))).alias("gain"), F.sum("at").alias("mid"),
        F.sum(F.when(leaf, F.col("cover") * F.col("value"))).alias("leaf_mass"),
    ).filter("splits > 0")


# twelve months ahead with the trees as a list per product, rebuilding the features each month
AHEAD = (
    TREES
    + "," + DEEP_TWO
    + f""",
h0 AS (SELECT product, list(y ORDER BY i)[49:60] AS hist FROM whole GROUP BY 1),
p AS (
  SELECT product, 0 AS step, hist, CAST(NULL AS DOUBLE) AS yhat FROM h0
  UNION ALL
  SELECT product, step + 1, list_append(hist[2:12], v), v FROM (
    SELECT product, step, hist, base + list_sum(list_transform(trees, lambda t: {leaf_of("t", "x")})) AS v FROM (
      SELECT p.product, step, hist, base, trees, [{", ".join(f"hist[{13 - k}]" for k in (1, 2, 3, 6, 12))},
        {", ".join(f"list_avg(hist[{13 - k}:12]), list_stddev_samp(hist[{13 - k}:12])" for k in (3, 6, 12))},
        month(d), quarter(d), year(d), sin(2 * pi() * month(d) / 12), cos(2 * pi() * month(d) / 12)] AS x
      FROM (SELECT p.*, CAST(last + to_months(CAST(step + 1 AS INTEGER)) AS DATE) AS d FROM p JOIN last_row l ON l.product = p.product) p
      JOIN forest f ON f.product = p.product JOIN base b ON b.product = p.product WHERE step < 12))),
t AS (SELECT p.product, step, CAST(last + to_months(CAST(step AS INTEGER)) AS DATE) AS ds, yhat FROM p JOIN last_row l ON l.product = p.product WHERE step > 0)"""
)


def ahead_rows(df):
    path = grown.grown_path(F.col("trees"), F.col("ys"), F.col("start"), F.lit(12))
    flat = df.select("product", "start", "n", F.posexplode(path).alias("k", "yhat"))
    return flat.select("product", (F.col("k") + 1).alias("step"), F.add_months("start", F.col("n") + F.col("k")).alias("ds"), "yhat")


@query("recursive_forecast", final(AHEAD, "t", "product step:i ds:d yhat:f", 5), 5)
def q_recursive(spark, sf):
    return ahead_rows(grown_few(spark, sf))


@query("recursive_forecast_full")
def q_recursive_full(spark, sf):
    """Default trees, fitted and followed for twelve months."""
    return ahead_rows(grown.grow_trees(tree_table(spark, sf), len(boosted.TEMPORAL), {"trees": F.size("target")}))


FEATURE_NAMES = f"(SELECT unnest({list(boosted.TEMPORAL)}) AS feature, unnest(range(0, {len(boosted.TEMPORAL)})) AS j)"


@query(
    "tree_importance",
    final(
        TREES + f",\ng AS (SELECT product, j, sum(gain) AS g FROM splits GROUP BY ALL), t AS (SELECT b.product, f.feature, coalesce(round(100 * g / sum(g) OVER (PARTITION BY b.product), 2), 0) AS pct FROM base b CROSS JOIN {FEATURE_NAMES} f LEFT JOIN g ON g.product = b.product AND g.j = f.j)",
        "t",
        "product feature pct:f",
        2,
    ),
    2,
)
def q_tree_importance(spark, sf):
    """Share of the gains of each product's trees."""
    return grown.gain_importance(grown_few(spark, sf), "trees", boosted.TEMPORAL)


# a leaf of a tree of depth two has at most two players; with both, a player's share is the mean over the two orders
SHAPLEY = (
    TREES
    + """,
paths AS (SELECT l.product, l.t, l.node, l.value, a.j AS ja, a.cut AS aa, l.node IN (2, 4, 5) AS wa, CASE WHEN l.node IN (2, 4, 5) THEN a.cl ELSE a.ca - a.cl END / a.ca AS ra,
    b.j AS jb, b.cut AS ab, l.node IN (4, 6) AS wb, CASE WHEN l.node IN (4, 6) THEN b.cl ELSE b.ca - b.cl END / b.ca AS rb
  FROM leaves l JOIN splits a ON a.product = l.product AND a.t = l.t AND a.node = 1 LEFT JOIN splits b ON b.product = l.product AND b.t = l.t AND b.node = l.node // 2 AND l.node > 3),
met AS (SELECT s.product, s.r, value, ja, jb, CAST((x[ja + 1] <= aa) = wa AS INTEGER) AS oa, ra, CAST((x[jb + 1] <= ab) = wb AS INTEGER) AS ob, rb FROM seen s JOIN paths p ON p.product = s.product),
phi AS (
  SELECT product, r, ja AS j, value * (oa - ra) AS v FROM met WHERE jb IS NULL
  UNION ALL SELECT product, r, ja, value * (oa * ob - ra * rb) FROM met WHERE ja = jb
  UNION ALL SELECT product, r, ja, value * (oa - ra) * (rb + ob) / 2 FROM met WHERE ja <> jb
  UNION ALL SELECT product, r, jb, value * (ob - rb) * (ra + oa) / 2 FROM met WHERE ja <> jb),
each AS (SELECT product, r, j, sum(v) AS v FROM phi GROUP BY ALL)"""
)


@query(
    "shapley_importance",
    final(
        SHAPLEY + f",\ng AS (SELECT product, j, sum(abs(v)) AS g FROM each GROUP BY ALL), t AS (SELECT b.product, f.feature, coalesce(round(100 * g / sum(g) OVER (PARTITION BY b.product), 2), 0) AS pct FROM base b CROSS JOIN {FEATURE_NAMES} f LEFT JOIN g ON g.product = b.product AND g.j = f.j)",
        "t",
        "product feature pct:f",
        2,
    ),
    2,
)
def q_shapley(spark, sf):
    """Exact attribution: share of each feature in the mean absolute value."""
    return grown.shapley_importance(grown_few(spark, sf), "trees", FEW["depth"], boosted.TEMPORAL)


@query(
    "shapley_sums",
    final(
        TREES
        + """,
means AS (SELECT product, any_value(base) + sum(v) AS mean FROM (SELECT b.product, base, t, sum(cover * value) / sum(cover) AS v FROM base b JOIN leaves l ON l.product = b.product GROUP BY ALL) GROUP BY 1),
t AS (SELECT f.product, f.r AS row, yhat - mean AS total FROM fitted f JOIN means m ON m.product = f.product)""",
        "t",
        "product row:i total:f",
        5,
    ),
    5,
)
def q_shapley_sums(spark, sf):
    """The shares of a row sum to its prediction minus the mean prediction of the trees."""
    df = reuse(grown_few(spark, sf))  # read for the rows and for their shares
    rows = df.select("product", F.posexplode("x").alias("row", "_x")).drop("_x")
    sums = grown.tree_shapley(df, "trees", FEW["depth"]).groupBy("product", "row").agg(F.sum("phi").alias("total"))
    return rows.join(sums, ["product", "row"], "left").select("product", "row", F.coalesce("total", F.lit(0.0)).alias("total"))


SMALL_SPACE = {
    "n_estimators": ("int", 2, 4), "max_depth": ("int", 2, 2), "learning_rate": ("float", 0.1, 0.9), "min_child_weight": ("int", 1, 1),
    "subsample": ("float", 1.0, 1.0), "colsample_bytree": ("float", 1.0, 1.0),
}
HALVING = (
    WHOLE
    + f""",
lagged AS (SELECT * FROM (SELECT product, ds, y, {LAGS}, {ROLLS}, {CALENDAR} FROM (SELECT product, ds, clean AS y FROM cl)) WHERE y_lag_12 IS NOT NULL AND y_roll_std_12 IS NOT NULL),
every AS MATERIALIZED (SELECT product, y, row_number() OVER (PARTITION BY product ORDER BY ds) - 1 AS r, CAST(floor(count(*) OVER (PARTITION BY product) * 0.8) AS INTEGER) AS cut, [{TEMPORAL_X}] AS x FROM lagged),
drawn AS MATERIALIZED (SELECT product, trial, CAST(floor({_uniform("product", "'rounds'", "trial")} * 3) + 2 AS INTEGER) AS rounds, CAST(0.1 AS DOUBLE) + {_uniform("product", "'rate'", "trial")} * CAST(0.8 AS DOUBLE) AS rate
   FROM (SELECT DISTINCT product FROM every), (SELECT unnest(generate_series(1, 4)) AS trial)),
seen AS MATERIALIZED (SELECT e.product || '#' || trial AS product, r, y, x FROM every e JOIN drawn d ON d.product = e.product WHERE r < cut),
rates AS MATERIALIZED (SELECT product || '#' || trial AS product, rate FROM drawn),
"""
    + boosted_sql("seen", len(boosted.TEMPORAL), 4, 2, "rates")
    + "," + DEEP_TWO
    + f""",
held AS (SELECT e.product, trial, rounds, y, x, base, trees FROM every e JOIN drawn d ON d.product = e.product JOIN forest f ON f.product = e.product || '#' || trial JOIN base b ON b.product = f.product WHERE r >= cut),
scores AS (SELECT product, trial, budget, rung, avg(abs((y - (base + list_sum(list_transform(trees[1:budget], lambda t: {leaf_of("t", "x")})))) / (y + 1e-8))) AS score
   FROM (SELECT *, 1 AS rung, CAST(ceil(rounds / 2) AS INTEGER) AS budget FROM held UNION ALL SELECT *, 2, rounds FROM held) GROUP BY 1, 2, 3, 4),
one AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY score, trial) AS rank FROM scores WHERE rung = 1),
two AS (SELECT s.*, row_number() OVER (PARTITION BY s.product ORDER BY s.score, s.trial) AS rank FROM scores s JOIN one o ON o.product = s.product AND o.trial = s.trial AND o.rank <= 2 WHERE s.rung = 2),
t AS (SELECT product, rung, trial, budget, score, rank FROM one UNION ALL SELECT product, rung, trial, budget, score, rank FROM two)"""
)


@query("tune_search_trees", final(HALVING, "t", "product rung:i trial:i budget:i score:f rank:i", 5), 5)
def q_tune_trees(spark, sf):
    """Four trials of each supplier's trees, the better half with all their rounds."""
    found = tuning.tune_trees(tree_table(spark, sf), len(boosted.TEMPORAL), 4, 2, 2, space=SMALL_SPACE)
    return found.select("product", "rung", "trial", "budget", "score", "rank")


REGRESSORS = ["discount", "price"]


def with_regressors(spark, sf):
    cleaned = unpack(packed(spark, sf)).drop("i")
    j = join_features(cleaned, supplier_features(spark, sf).drop("promo"))
    xs = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in REGRESSORS])
    from monthloom.operators.calendar import pack

    return pack(j.withColumn("xs", xs), "xs")


# the ridge regression from its definition: the design as rows, its cross products, elimination and substitution
REGRESSION = (
    WHOLE
    + ", " + SUPPLIER_FEATURES.strip()
    + """,
known AS MATERIALIZED (SELECT c.product, c.i, c.ds, c.clean AS y, coalesce(discount, 0.0) AS d, coalesce(price, 0.0) AS p FROM cl c LEFT JOIN feats f ON f.product = c.product AND f.ds = c.ds),
dims AS MATERIALIZED (SELECT product, count(*) AS n, max(abs(y)) AS size, month(min(ds)) AS m, CAST(least(25, greatest(floor(count(*) * 0.8) - 1, 0)) AS INTEGER) AS k, avg(d) AS md, avg(p) AS mp,
   stddev_pop(d) AS sd, stddev_pop(p) AS sp, arg_max(d, i) AS ld, arg_max(p, i) AS lp FROM known GROUP BY 1),
span AS MATERIALIZED (SELECT s.*, (coalesce(d, ld) - md) / CASE WHEN sd > 1e-9 * abs(md) THEN sd ELSE 1 END AS xd, (coalesce(p, lp) - mp) / CASE WHEN sp > 1e-9 * abs(mp) THEN sp ELSE 1 END AS xp, y / size AS ys
   FROM (SELECT *, unnest(range(0, n + 12)) AS i FROM dims) s LEFT JOIN known ON known.product = s.product AND known.i = s.i),
design AS MATERIALIZED (
   SELECT product, i, ys, n, size, 1 AS c, CAST(1.0 AS DOUBLE) AS v, CAST(1e-6 AS DOUBLE) AS pen, 'trend' AS part FROM span
   UNION ALL SELECT product, i, ys, n, size, 2, i / greatest(n - 1, 1), 1e-6, 'trend' FROM span
   UNION ALL SELECT product, i, ys, n, size, 2 + j, greatest(i / greatest(n - 1, 1) - CAST(0.8 AS DOUBLE) * j / k, 0), 4.0, 'trend' FROM (SELECT *, unnest(range(1, k + 1)) AS j FROM span)
   UNION ALL SELECT product, i, ys, n, size, k + 1 + 2 * j + o, CASE o WHEN 0 THEN sin(j * 2 * pi() * ((i + m - 1) % 12) / 12) ELSE cos(j * 2 * pi() * ((i + m - 1) % 12) / 12) END, CAST(1e-4 AS DOUBLE) + CAST(1e-8 AS DOUBLE), 'yearly'
     FROM (SELECT *, unnest(range(1, 6)) AS j FROM span), (VALUES (0), (1)) v(o)
   UNION ALL SELECT product, i, ys, n, size, k + 13, xd, CAST(1e-4 AS DOUBLE) + CAST(1e-8 AS DOUBLE), 'discount' FROM span
   UNION ALL SELECT product, i, ys, n, size, k + 14, xp, CAST(1e-4 AS DOUBLE) + CAST(1e-8 AS DOUBLE), 'price' FROM span),
past AS MATERIALIZED (SELECT product, i, c, v, pen, ys FROM design WHERE i < n),
gram AS (SELECT a.product, a.c AS c1, b.c AS c2, sum(a.v * b.v) + CASE WHEN a.c = b.c THEN any_value(a.pen) ELSE 0 END AS g FROM past a JOIN past b ON a.product = b.product AND a.i = b.i GROUP BY 1, 2, 3
   UNION ALL SELECT product, c, 1000, sum(v * ys) FROM past GROUP BY 1, 2),
matrix AS (SELECT product, list(r ORDER BY c1) AS rows FROM (SELECT product, c1, list(g ORDER BY c2) AS r FROM gram GROUP BY 1, 2) GROUP BY 1),
elim AS (SELECT product, CAST([] AS DOUBLE[][]) AS done, rows AS rest FROM matrix
   UNION ALL SELECT product, list_append(done, rest[1]),
     list_transform(rest[2:], lambda r: list_transform(range(2, len(r) + 1), lambda z: r[z] - r[1] / rest[1][1] * rest[1][z])) FROM elim WHERE len(rest) > 0),
back AS (SELECT product, done, len(done) AS q, CAST([] AS DOUBLE[]) AS beta FROM elim WHERE len(rest) = 0
   UNION ALL SELECT product, done, q - 1,
     list_prepend((done[q][len(done[q])] - coalesce(list_sum(list_transform(range(1, len(beta) + 1), lambda z: done[q][z + 1] * beta[z])), 0)) / done[q][1], beta) FROM back WHERE q > 0),
coefs AS MATERIALIZED (SELECT product, beta FROM back WHERE q = 0),
parts AS MATERIALIZED (SELECT d.product, d.i, d.n, part, sum(v * beta[c]) * any_value(size) AS value FROM design d JOIN coefs ON coefs.product = d.product GROUP BY 1, 2, 3, 4),
made AS (SELECT product, i, n, sum(value) AS yhat, sum(value) FILTER (WHERE part <> 'trend') AS terms FROM parts GROUP BY 1, 2, 3)"""
)


def regression(spark, sf, horizon=12, **options):
    return regress.trend_season_regress(with_regressors(spark, sf), horizon, "xs", **options)


@query(
    "trend_season_regress",
    final(REGRESSION, "(SELECT product, n, beta[1] AS intercept, beta[2] AS slope, beta[3] AS change, beta[k + 13] AS c_discount, beta[k + 14] AS c_price FROM dims JOIN coefs USING (product))", "product n:i intercept:f slope:f change:f c_discount:f c_price:f", 5),
    5,
)
def q_regress(spark, sf):
    """Coefficients of the scaled history."""
    trend = [F.get("fit.trend_coef", F.lit(k)).alias(c) for k, c in enumerate(("intercept", "slope", "change"))]
    own = [F.get("fit.coef", F.lit(k)).alias(c) for k, c in enumerate(("c_discount", "c_price"))]
    return regression(spark, sf).select("product", "n", *trend, *own)


@query("regress_forecast", final(REGRESSION, f"(SELECT product, i - n + 1 AS step, CAST(last + to_months(CAST(i - n + 1 AS INTEGER)) AS DATE) AS ds, yhat FROM made JOIN last_row USING (product) WHERE i >= n)", "product step:i ds:d yhat:f", 4), 4)
def q_regress_forecast(spark, sf):
    return regress.regress_forecast(regression(spark, sf))


@query(
    "components",
    final(
        REGRESSION
        + """,
t AS (SELECT a.product, ds, part AS component, value FROM parts a JOIN known USING (product, i)
  UNION ALL SELECT m.product, ds, 'additive_terms', terms FROM made m JOIN known USING (product, i)
  UNION ALL SELECT m.product, ds, 'yhat', yhat FROM made m JOIN known USING (product, i))""",
        "t",
        "product ds:d component value:f",
        4,
    ),
    4,
)
def q_components(spark, sf):
    return regress.components(regression(spark, sf, 0), REGRESSORS)


# the multiplicative form alternates; compared is that its parts make up the fit and that it came to rest
ADDS_UP = final(WHOLE, "(SELECT product, ds, 6 AS parts, TRUE AS adds_up FROM cl)", "product ds:d parts:i adds_up")


@query("components_multiplicative", ADDS_UP)
def q_components_mul(spark, sf):
    f = regression(spark, sf, 0, mode="multiplicative")
    rows = regress.components(f, REGRESSORS, "multiplicative")
    wide = rows.groupBy("product", "ds").pivot("component", ["trend", "yearly", *REGRESSORS, "multiplicative_terms", "yhat"]).agg(F.first("value"))
    inner = F.abs(F.col("yearly") + F.col("discount") + F.col("price") - F.col("multiplicative_terms")) < 1e-6
    outer = F.abs(F.col("trend") * (1 + F.col("multiplicative_terms")) - F.col("yhat")) <= 1e-6 * (1 + F.abs("yhat"))
    counted = rows.groupBy("product", "ds").agg(F.count("value").alias("parts"))
    wide = wide.join(f.select("product", "fit.converged"), "product")
    return wide.select("product", "ds", (inner & outer & F.col("converged")).alias("adds_up")).join(counted, ["product", "ds"])


COEFFICIENTS = ",\nco AS (SELECT product, unnest(['discount', 'price']) AS feature, abs(unnest([beta[k + 13], beta[k + 14]])) AS s FROM dims JOIN coefs USING (product))"
SHARES = "SELECT product, feature, CASE WHEN sum(s) OVER (PARTITION BY product) > 0 THEN round(100 * s / sum(s) OVER (PARTITION BY product), 2) ELSE s END AS pct FROM"


@query("coef_importance", final(REGRESSION + COEFFICIENTS + f", t AS ({SHARES} co)", "t", "product feature pct:f", 2), 2)
def q_coef(spark, sf):
    """Share of each regressor's absolute coefficient."""
    return influence.coef_importance(regression(spark, sf, 0), REGRESSORS)


EFFECTS = (
    REGRESSION
    + f""",
reps AS (SELECT unnest(generate_series(1, 5)) AS rep),
effects AS (SELECT product, i, part AS feature, value AS e FROM parts WHERE part IN ('discount', 'price') AND i < n),
moved AS (SELECT product, feature, rep, e, row_number() OVER (PARTITION BY product, feature, rep ORDER BY md5(product || '|' || i || '|' || feature || '|' || rep)) - 1 AS i FROM effects, reps),
errors AS (SELECT f.product, f.feature, m.rep, avg(abs((y - (yhat - f.e + m.e)) / (y + 1e-8))) AS err FROM effects f JOIN moved m ON m.product = f.product AND m.feature = f.feature AND m.i = f.i
   JOIN made ON made.product = f.product AND made.i = f.i JOIN known ON known.product = f.product AND known.i = f.i GROUP BY 1, 2, 3),
plain AS (SELECT made.product, avg(abs((y - yhat) / (y + 1e-8))) AS err FROM made JOIN known USING (product, i) GROUP BY 1),
sc AS (SELECT e.product, feature, greatest(0, avg(e.err) - any_value(plain.err)) AS s FROM errors e JOIN plain ON plain.product = e.product GROUP BY 1, 2)"""
)


@query("effect_importance", final(EFFECTS + f", t AS ({SHARES} sc)", "t", "product feature pct:f", 2), 2)
def q_effects(spark, sf):
    """Permutation of the fitted effects: for models whose coefficients say nothing by themselves."""
    return influence.effect_importance(regression(spark, sf, 0), REGRESSORS)


@query(
    "model_select",
    final(
        "s AS (SELECT DISTINCT l_suppkey AS k FROM lineitem), t AS (SELECT 'Supplier ' || k AS product, model FROM s, (VALUES ('SARIMA', false), ('HoltWinters', false), ('XGBoost', true), ('Prophet', true)) v(model, multi) WHERE (k % 2 = 0) = multi)",
        "t",
        "product model",
    ),
)
def q_model_select(spark, sf):
    """Series without own features (odd keys) get the univariate models, the others the multivariate."""
    series = supplier_raw(spark, sf).select("product").distinct()
    has = F.regexp_extract("product", r"(\d+)$", 1).cast("int") % 2 == 0
    chosen = model_select(model_table(spark), ["SARIMA", "HoltWinters", "Chronos", "XGBoost", "Prophet"])
    typed = series.withColumn("multivariate", has)
    return typed.join(chosen, "multivariate").select("product", "model")


def last_year_mean(pdf: pd.DataFrame) -> pd.DataFrame:
    value = pdf["y"].tail(12).mean()
    ahead = pd.date_range(pd.Timestamp(pdf["ds"].max()) + pd.DateOffset(months=1), periods=12, freq="MS")
    return pd.DataFrame({"product": pdf["product"].iloc[0], "step": range(1, 13), "ds": ahead.date, "yhat": value})


@query(
    "plug_forecaster",
    final(WHOLE + f",\nm AS (SELECT product, avg(y) AS yhat FROM whole WHERE i >= 48 GROUP BY 1), t AS (SELECT product, step, {DATED}, yhat FROM m JOIN last_row USING (product), (SELECT unnest(generate_series(1, 12)) AS step))", "t", "product step:i ds:d yhat:f"),
)
def q_plug(spark, sf):
    return plug_forecaster(unpack(packed(spark, sf)).select("product", "ds", "y"), last_year_mean)
