"""Grids, windows, splits, temporal features, joins on the calendar."""

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks.registry import final, query
from checks.tables import (
    NET_WHOLE,
    PART,
    SUPPLIER,
    SUPPLIER_FEATURES,
    net_whole,
    part,
    part_raw,
    supplier,
    supplier_features,
    supplier_raw,
)
from monthloom.models.autoreg import seasonal_diff
from monthloom.operators import calendar as C
from monthloom.operators import cleaning, joins, screening, temporal


@query("reindex_calendar", final(PART, "part_d", "product ds:d y:f"))
def q_reindex(spark, sf):
    return part(spark, sf)


@query("last_n_window", final(PART + "," + S.windowed("part_d", "t"), "t", "product ds:d y:f"))
def q_last_n(spark, sf):
    return C.last_n_window(part(spark, sf), 60)


@query("history_tail", final(PART + "," + S.windowed("part_d", "t", 36), "t", "product ds:d y:f"))
def q_history_tail(spark, sf):
    return C.history_tail(part(spark, sf))


ZERO = PART + ",\npart_z AS (SELECT product, ds, coalesce(y, 0) AS y FROM part_d)"


def part_zero(spark, sf):
    return part(spark, sf).fillna(0.0, ["y"])


@query("classify_filter", final(ZERO + "," + S.classified("part_z", "t"), "t", "product ds:d y:f"))
def q_classify(spark, sf):
    return screening.classify_filter(part_zero(spark, sf))


@query("classify_reject", final(ZERO + "," + S.classified("part_z", "t", keep=False), "t", "product ds:d y:f"))
def q_reject(spark, sf):
    return screening.classify_filter(part_zero(spark, sf), keep=False)


@query(
    "classify_missing_is_active",
    final(PART + "," + S.classified("part_d", "t"), "(SELECT product, share, share >= 0.5 AS forecastable FROM t_share)", "product share:f forecastable"),
)
def q_classify_verdict(spark, sf):
    v = screening.classify(part(spark, sf))
    return v.select("product", F.col("nonzero_share").alias("share"), "forecastable")


@query("split_label", final(PART + "," + S.windowed("part_d", "w") + "," + S.indexed("w", "x") + "," + S.split("x", "t"), "t", "product ds:d y:f i:i n:i split"))
def q_split(spark, sf):
    return screening.split_label(part(spark, sf))


# series of different lengths: only the months that exist, so n varies between parts
@query(
    "split_label_short",
    final(PART + "," + S.windowed("part_raw2", "w") + "," + S.indexed("w", "x") + "," + S.split("x", "t"), "t", "product ds:d i:i n:i split").replace(
        "\nw AS", "\npart_raw2 AS (SELECT * FROM part_d_raw),\nw AS"
    ),
)
def q_split_short(spark, sf):
    return screening.split_label(part_raw(spark, sf)).drop("y")


@query(
    "holdout_split",
    final(SUPPLIER + "," + S.indexed("supplier_d", "x") + ",\nt AS (SELECT *, CASE WHEN i < CAST(floor(n * 0.8) AS INT) THEN 'fit' ELSE 'holdout' END AS part FROM x)", "t", "product ds:d y:f i:i n:i part"),
)
def q_holdout(spark, sf):
    return screening.holdout_split(supplier(spark, sf))


W = "OVER (PARTITION BY product ORDER BY ds)"
LAGS = ", ".join(f"lag(y, {k}) {W} AS y_lag_{k}" for k in (1, 2, 3, 6, 12))


def _roll(k):
    over = f"OVER (PARTITION BY product ORDER BY ds ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return (
        f"CASE WHEN count(y) {over} = {k} THEN avg(y) {over} END AS y_roll_mean_{k},"
        f" CASE WHEN count(y) {over} = {k} THEN stddev_samp(y) {over} END AS y_roll_std_{k}"
    )


ROLLS = ", ".join(_roll(k) for k in (3, 6, 12))
CALENDAR = "month(ds) AS month, quarter(ds) AS quarter, year(ds) AS year, sin(2 * pi() * month(ds) / 12) AS month_sin, cos(2 * pi() * month(ds) / 12) AS month_cos"
LAG_COLS = " ".join(f"y_lag_{k}:f" for k in (1, 2, 3, 6, 12))
ROLL_COLS = " ".join(f"y_roll_{s}_{k}:f" for k in (3, 6, 12) for s in ("mean", "std"))
CAL_COLS = "month:i quarter:i year:i month_sin:f month_cos:f"


@query("lag_features", final(NET_WHOLE + f",\nt AS (SELECT *, {LAGS} FROM net_d)", "t", "product ds:d y:f " + LAG_COLS))
def q_lags(spark, sf):
    return temporal.lag_features(net_whole(spark, sf))


@query("rolling_features", final(SUPPLIER + f",\nt AS (SELECT *, {ROLLS} FROM supplier_d)", "t", "product ds:d y:f " + ROLL_COLS))
def q_rolling(spark, sf):
    return temporal.rolling_features(supplier(spark, sf))


@query("calendar_features", final(NET_WHOLE + f",\nt AS (SELECT *, {CALENDAR} FROM net_d)", "t", "product ds:d y:f " + CAL_COLS))
def q_calendar(spark, sf):
    return temporal.calendar_features(net_whole(spark, sf))


TEMPORAL = f"t AS (SELECT *, {LAGS}, {ROLLS}, {CALENDAR} FROM net_d)"
TEMPORAL_COLS = f"product ds:d y:f {LAG_COLS} {ROLL_COLS} {CAL_COLS}"


@query("temporal_features", final(NET_WHOLE + ",\n" + TEMPORAL, "t", TEMPORAL_COLS))
def q_temporal(spark, sf):
    return temporal.temporal_features(net_whole(spark, sf))


ALL_PRESENT = " AND ".join(c.split(":")[0] + " IS NOT NULL" for c in TEMPORAL_COLS.split())


@query("drop_na_rows", final(SUPPLIER + f",\nt AS (SELECT *, {LAGS}, {ROLLS}, {CALENDAR} FROM supplier_d)", f"(SELECT * FROM t WHERE {ALL_PRESENT})", TEMPORAL_COLS))
def q_drop_na(spark, sf):
    return temporal.drop_na_rows(temporal.temporal_features(supplier(spark, sf)))


@query("diffs", final(NET_WHOLE + f",\nt AS (SELECT *, y - lag(y) {W} AS d FROM net_d)", "t", "product ds:d y:f d:f"))
def q_diffs(spark, sf):
    return cleaning.diffs(net_whole(spark, sf))


@query(
    "seasonal_diff",
    final(SUPPLIER + f",\na AS (SELECT *, y - lag(y) {W} AS w1 FROM supplier_d), t AS (SELECT product, ds, y, w1 - lag(w1, 12) {W} AS w FROM a)", "t", "product ds:d y:f w:f"),
)
def q_seasonal_diff(spark, sf):
    return seasonal_diff(supplier(spark, sf), 1, 1)


@query(
    "future_calendar",
    final(PART + ",\nt AS (SELECT product, step, CAST(max(ds) + to_months(CAST(step AS INTEGER)) AS DATE) AS ds FROM part_d_raw, (SELECT unnest(generate_series(1, 12)) AS step) GROUP BY 1, 2)", "t", "product step:i ds:d"),
)
def q_future_calendar(spark, sf):
    return C.future_calendar(part_raw(spark, sf))


JOINED = SUPPLIER + "," + SUPPLIER_FEATURES + ",\nj AS (SELECT d.*, discount, price, promo FROM supplier_d d LEFT JOIN feats f ON f.product = d.product AND f.ds = d.ds)"
JOINED_COLS = "product ds:d y:f discount:f price:f promo"


@query("join_features", final(JOINED, "j", JOINED_COLS))
def q_join_features(spark, sf):
    return joins.join_features(supplier(spark, sf), supplier_features(spark, sf))


@query(
    "split_with_features",
    final(JOINED + ",\nw AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY product ORDER BY ds DESC) <= 60), x AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY product) AS n FROM w)," + S.split("x", "t"), "t", JOINED_COLS + " i:i n:i split"),
)
def q_split_with_features(spark, sf):
    return joins.split_with_features(supplier(spark, sf), supplier_features(spark, sf))


@query("target_and_exog", final(JOINED, "j", JOINED_COLS))
def q_target_and_exog(spark, sf):
    whole = joins.join_features(supplier(spark, sf), supplier_features(spark, sf)).withColumnRenamed("y", "demand")
    target, exog = temporal.target_and_exog(whole)
    return target.join(exog, ["product", "ds"])


FUTURE = "(SELECT unnest(generate_series(1, 12)) AS step)"


@query(
    "extrapolate_last",
    final(JOINED + f",\nl AS (SELECT product, max(ds) AS last FROM j GROUP BY 1), t AS (SELECT l.product, step, CAST(last + to_months(CAST(step AS INTEGER)) AS DATE) AS ds, discount, price, promo FROM l JOIN j ON j.product = l.product AND j.ds = l.last, {FUTURE})", "t", "product step:i ds:d discount:f price:f promo"),
)
def q_extrapolate_last(spark, sf):
    return temporal.extrapolate_last(joins.join_features(supplier(spark, sf), supplier_features(spark, sf)))


@query(
    "extrapolate_trailing_mean",
    final(JOINED + f",\nl AS (SELECT product, max(ds) AS last FROM j GROUP BY 1), r AS (SELECT product, avg(price) AS price FROM (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY product ORDER BY ds DESC) <= 12) GROUP BY 1), t AS (SELECT l.product, step, CAST(last + to_months(CAST(step AS INTEGER)) AS DATE) AS ds, r.price, discount, promo FROM l JOIN r ON r.product = l.product JOIN j ON j.product = l.product AND j.ds = l.last, {FUTURE})", "t", "product step:i ds:d price:f discount:f promo"),
)
def q_extrapolate_mean(spark, sf):
    whole = joins.join_features(supplier(spark, sf), supplier_features(spark, sf))
    return temporal.extrapolate_trailing_mean(whole, ["price"])


# two partners each: the supplier of half the number, and the first one
PARTNERS = (
    "\nk AS (SELECT DISTINCT l_suppkey AS k FROM lineitem), pairs AS (SELECT 'Supplier ' || k AS product, 1 AS slot, 'Supplier ' || (k // 2) AS other FROM k"
    " UNION ALL SELECT 'Supplier ' || k, 2, 'Supplier 1' FROM k)"
)


def partners(spark, sf):
    k = supplier_raw(spark, sf).select("product").distinct()
    number = F.regexp_extract("product", r"(\d+)$", 1).cast("int")
    half = F.concat(F.lit("Supplier "), F.floor(number / 2).cast("string"))
    slots = F.array(F.struct(F.lit(1).alias("slot"), half.alias("other")), F.struct(F.lit(2).alias("slot"), F.lit("Supplier 1").alias("other")))
    return k.select("product", F.inline(slots))


@query(
    "cross_product",
    final(
        SUPPLIER + "," + PARTNERS + """,
o AS (SELECT d.product, d.ds, slot, x.y FROM supplier_d d JOIN pairs p ON p.product = d.product AND p.other <> d.product JOIN supplier_d x ON x.product = p.other AND x.ds = d.ds),
w AS (SELECT product, ds, max(CASE WHEN slot = 1 THEN y END) AS other_1, max(CASE WHEN slot = 2 THEN y END) AS other_2 FROM o GROUP BY 1, 2),
t AS (SELECT d.*, other_1, other_2 FROM supplier_d d LEFT JOIN w USING (product, ds))""",
        "t",
        "product ds:d y:f other_1:f other_2:f",
    ),
)
def q_cross(spark, sf):
    return joins.cross_product(supplier(spark, sf), partners(spark, sf), [1, 2])


@query(
    "partner_demand",
    final(
        SUPPLIER + "," + PARTNERS + ", few AS (SELECT DISTINCT product, other FROM pairs),"
        " t AS (SELECT d.product, d.ds, p.other, o.y AS other_y FROM supplier_d d JOIN few p ON p.product = d.product AND p.other <> d.product LEFT JOIN supplier_d o ON o.product = p.other AND o.ds = CAST(d.ds - INTERVAL 1 MONTH AS DATE))",
        "t",
        "product ds:d other other_y:f",
    ),
)
def q_partner(spark, sf):
    return joins.partner_demand(supplier(spark, sf), partners(spark, sf).select("product", "other").distinct(), lag=1)


@query(
    "concat_splits",
    final(SUPPLIER + "," + S.indexed("supplier_d", "x") + "," + S.split("x", "t"), "(SELECT product, ds, y FROM t)", "product ds:d y:f"),
)
def q_concat_splits(spark, sf):
    s = screening.split_label(supplier(spark, sf), window=10**6)
    return C.concat_splits(*[s.filter(F.col("split") == p) for p in ("train", "val", "test")]).select("product", "ds", "y")


@query(
    "append_future",
    final(SUPPLIER + f",\nl AS (SELECT product, max(ds) AS last FROM supplier_d GROUP BY 1), t AS (SELECT product, ds, y FROM supplier_d UNION ALL SELECT product, CAST(last + to_months(CAST(step AS INTEGER)) AS DATE), NULL FROM l, {FUTURE})", "t", "product ds:d y:f"),
)
def q_append_future(spark, sf):
    d = supplier(spark, sf)
    return C.append_future(d, C.future_calendar(d))


@query(
    "grid_cross",
    final(SUPPLIER + ",\np AS (SELECT DISTINCT product FROM supplier_d), a AS (SELECT unnest([0, 1, 2]) AS v), b AS (SELECT unnest([0, 1]) AS v), t AS (SELECT product, p1.v AS p, d1.v AS d, q1.v AS q, p2.v AS sp, d2.v AS sd, q2.v AS sq FROM p, a p1, b d1, a q1, b p2, b d2, b q2)", "t", "product p:i d:i q:i sp:i sd:i sq:i"),
)
def q_grid_cross(spark, sf):
    from monthloom.models.sarima import NAMES, ORDERS

    grid = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(NAMES, o)]) for o in ORDERS])
    series = supplier_raw(spark, sf).select("product").distinct()
    return joins.grid_cross(series, grid).select("product", "candidate.*")
