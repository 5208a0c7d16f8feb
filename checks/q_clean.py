"""Repair of bad values, against recursion over the months."""

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks.registry import final, query
from checks.tables import NET, NET_WHOLE, net, net_whole
from monthloom.functions.expressions import neighbor_mean
from monthloom.operators import cleaning, reports, screening
from monthloom.operators.calendar import by_month

X = NET + "," + S.indexed("net_d", "x")
CLEAN = X + "," + S.cleaned("x", "cl")


@query(
    "neighbor_mean",
    final(NET_WHOLE + "," + S.indexed("net_d", "x") + f",\nb AS (SELECT product, ds, lag(y) OVER w AS p, lead(y) OVER w AS q FROM x WINDOW w AS (PARTITION BY product ORDER BY ds)), t AS (SELECT product, ds, {S.nm('p', 'q')} AS v FROM b)", "t", "product ds:d v:f"),
)
def q_neighbor_mean(spark, sf):
    w = by_month()
    return net_whole(spark, sf).select("product", "ds", neighbor_mean(F.lag("y").over(w), F.lead("y").over(w)).alias("v"))


@query("clean_negative", final(X + "," + S.negatives("x", "n1"), "(SELECT x.product, ds, y, v AS c1 FROM n1 JOIN x USING (product, i))", "product ds:d y:f c1:f"))
def q_clean_negative(spark, sf):
    return cleaning.clean_negative(net(spark, sf)).select("product", "ds", "y", "c1")


@query(
    "clean_missing",
    final(X + "," + S.negatives("x", "n1") + "," + S.gaps("n1", "n2"), "(SELECT x.product, ds, y, n2.v AS c2 FROM n2 JOIN x USING (product, i))", "product ds:d y:f c2:f"),
)
def q_clean_missing(spark, sf):
    return cleaning.clean_missing(cleaning.clean_negative(net(spark, sf))).select("product", "ds", "y", "c2")


@query(
    "outlier_bounds",
    final(X + "," + S.negatives("x", "n1") + "," + S.gaps("n1", "n2") + ",\nd AS (SELECT product, v - lag(v) OVER (PARTITION BY product ORDER BY i) AS d FROM n2), t AS (SELECT product, count(d) AS n_diffs, quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.75) AS q3, q1 - 3.0 * (q3 - q1) AS lower, q3 + 3.0 * (q3 - q1) AS upper FROM d GROUP BY 1)", "t", "product n_diffs:i q1:f q3:f lower:f upper:f"),
)
def q_outlier_bounds(spark, sf):
    staged = cleaning.clean_missing(cleaning.clean_negative(net(spark, sf)))
    return cleaning.outlier_bounds(staged, "c2")


@query("clean_outlier", final(CLEAN, "cl", "product i:i c2:f clean:f lower:f upper:f"))
def q_clean_outlier(spark, sf):
    p = cleaning.clean_packed(net(spark, sf))
    rows = cleaning.clean_rows(p).select("product", "i", "c2", "clean")
    return rows.join(p.select("product", "lower", "upper"), "product")


@query("clean_all", final(CLEAN, "cl", "product i:i ds:d y:f clean:f reason"))
def q_clean_all(spark, sf):
    return cleaning.clean_all(net(spark, sf)).drop("c2")


@query(
    "change_log",
    final(CLEAN, "(SELECT product, i, ds, reason, CASE WHEN reason = 'outlier' THEN c2 ELSE y END AS original, clean AS \"new\" FROM cl WHERE reason IS NOT NULL)", "product i:i ds:d reason original:f new:f"),
)
def q_change_log(spark, sf):
    return cleaning.change_log(cleaning.clean_all(net(spark, sf)))


@query(
    "change_counts",
    final(CLEAN, "(SELECT product, count(*) FILTER (reason = 'negative') AS n_negative, count(*) FILTER (reason = 'missing') AS n_missing, count(*) FILTER (reason = 'outlier') AS n_outlier, count(reason) AS n_total FROM cl GROUP BY 1)", "product n_negative:i n_missing:i n_outlier:i n_total:i"),
)
def q_change_counts(spark, sf):
    return cleaning.change_counts(cleaning.clean_all(net(spark, sf)))


@query(
    "report_cleaning",
    final(
        CLEAN + "," + S.split("cl", "sp") + """,
lim AS (SELECT product, least(min(y), min(clean)) AS lo, greatest(max(y), max(clean)) AS hi FROM cl GROUP BY 1),
t AS (SELECT s.product, i, ds, y AS original, clean, reason, CASE WHEN split <> lag(split) OVER (PARTITION BY s.product ORDER BY ds) THEN split END AS starts,
  lo - CASE WHEN hi > lo THEN (hi - lo) * 0.1 ELSE 1 END AS y_lo, hi + CASE WHEN hi > lo THEN (hi - lo) * 0.1 ELSE 1 END AS y_hi FROM sp s JOIN lim USING (product))""",
        "t",
        "product i:i ds:d original:f clean:f reason starts y_lo:f y_hi:f",
    ),
)
def q_report_cleaning(spark, sf):
    demand = net(spark, sf)
    return reports.report_cleaning(cleaning.clean_all(demand), screening.split_label(demand))
