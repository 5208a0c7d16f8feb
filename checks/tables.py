"""Binds the driver's tables to monthly demand, in Spark and as DuckDB text.

Three demand tables, each derived from all of ``lineitem``:

* suppliers: dense, and as many series as there are suppliers;
* parts: sparse, as many series as there are parts;
* net: parts with returns counted negative, on the grid with gaps, whole or its last 60 months.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.operators.calendar import last_n_window, month_bounds, reindex_calendar, to_monthly


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bounds(spark, sf):
    return month_bounds(read(spark, sf, "lineitem"), "l_shipdate")


def _labelled(df: DataFrame, prefix: str) -> DataFrame:
    # group by the integer key, spell the label only once per month
    return df.withColumn("product", F.concat(F.lit(prefix), F.col("product").cast("string")))


def supplier_raw(spark, sf):
    return _labelled(to_monthly(read(spark, sf, "lineitem"), "l_suppkey", "l_shipdate", "l_quantity"), "Supplier ")


def supplier(spark, sf):
    return reindex_calendar(supplier_raw(spark, sf), bounds(spark, sf))


def part_raw(spark, sf):
    return _labelled(to_monthly(read(spark, sf, "lineitem"), "l_partkey", "l_shipdate", "l_quantity"), "Part ")


def part(spark, sf):
    return reindex_calendar(part_raw(spark, sf), bounds(spark, sf))


def net(spark, sf):
    """The last 60 months, as the cleaning steps get them."""
    return last_n_window(net_whole(spark, sf), 60)


def net_whole(spark, sf):
    signed = F.when(F.col("l_returnflag") == "R", -2 * F.col("l_quantity")).otherwise(F.col("l_quantity"))
    li = read(spark, sf, "lineitem").withColumn("q", signed)
    monthly = _labelled(to_monthly(li, "l_partkey", "l_shipdate", "q"), "Part ")
    return reindex_calendar(monthly, bounds(spark, sf))


def brand_raw(spark, sf):
    li = read(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_quantity")
    by_part = to_monthly(li, "l_partkey", "l_shipdate", "l_quantity")  # reduce before the join
    p = read(spark, sf, "part").select("p_partkey", "p_brand")
    j = by_part.join(p, by_part["product"] == p["p_partkey"])
    return j.groupBy(F.col("p_brand").alias("product"), "ds").agg(F.sum("y").alias("y"))


def brand(spark, sf):
    return reindex_calendar(brand_raw(spark, sf), bounds(spark, sf))


def supplier_features(spark, sf):
    """Monthly mean discount and unit price, and the most frequent order priority as ``promo``.

    Means are taken over whole millionths, so they do not depend on the order of the rows.
    """
    li = read(spark, sf, "lineitem")
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    keyed = li.select(
        "l_orderkey",
        F.col("l_suppkey").alias("k"),
        F.trunc("l_shipdate", "month").alias("ds"),
        (F.round(F.col("l_discount") * 100).cast("long") * 10_000).alias("discount"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 1e6).cast("long").alias("unit"),
    )

    def mean(c):
        return F.expr(f"sum({c}) div count({c})") / 1e6

    prices = keyed.groupBy("k", "ds").agg(mean("discount").alias("discount"), mean("unit").alias("price"))
    tally = keyed.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("k", "ds", "o_orderpriority").count()
    promo = tally.groupBy("k", "ds").agg(
        F.min_by("o_orderpriority", F.struct(-F.col("count"), F.col("o_orderpriority"))).alias("promo")
    )
    return prices.join(promo, ["k", "ds"]).select(
        F.concat(F.lit("Supplier "), F.col("k").cast("string")).alias("product"), "ds", "discount", "price", "promo"
    )


# ---------------------------------------------------------------- the same in DuckDB

CAL = """
cal AS (SELECT CAST(date_trunc('month', min(l_shipdate)) AS DATE) AS lo,
               CAST(date_trunc('month', max(l_shipdate)) AS DATE) AS hi FROM lineitem),
months AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS ds FROM cal)"""


def _sql(name: str, raw: str) -> str:
    return f"""{CAL},
{name}_raw AS ({raw}),
{name}_grid AS (SELECT p.product, m.ds FROM (SELECT DISTINCT product FROM {name}_raw, cal WHERE ds BETWEEN lo AND hi) p, months m),
{name} AS (SELECT g.product, g.ds, r.y FROM {name}_grid g LEFT JOIN {name}_raw r ON r.product = g.product AND r.ds = g.ds)"""


def _facts(label: str, value: str = "l_quantity") -> str:
    return (
        f"SELECT {label} AS product, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds, sum({value}) AS y"
        " FROM lineitem GROUP BY 1, 2"
    )


SUPPLIER = _sql("supplier_d", _facts("'Supplier ' || l_suppkey"))
PART = _sql("part_d", _facts("'Part ' || l_partkey"))
BRAND = _sql(
    "brand_d",
    "SELECT p_brand AS product, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds, sum(l_quantity) AS y"
    " FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2",
)
_SIGNED = _facts("'Part ' || l_partkey", "CASE WHEN l_returnflag = 'R' THEN -2 * l_quantity ELSE l_quantity END")
NET_WHOLE = _sql("net_d", _SIGNED)
NET = (
    _sql("net_all", _SIGNED)
    + """,
net_d AS (SELECT product, ds, y FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ds DESC) rn FROM net_all) WHERE rn <= 60)"""
)
SUPPLIER_FEATURES = """
feats AS (
 WITH keyed AS (SELECT l_orderkey, l_suppkey AS k, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds, CAST(round(l_discount * 100) AS BIGINT) * 10000 AS discount,
                       CAST(floor(l_extendedprice / l_quantity * 1e6) AS BIGINT) AS unit FROM lineitem),
 prices AS (SELECT k, ds, (sum(discount) // count(*)) / CAST(1e6 AS DOUBLE) AS discount, (sum(unit) // count(*)) / CAST(1e6 AS DOUBLE) AS price FROM keyed GROUP BY 1, 2),
 tally AS (SELECT k, ds, o_orderpriority, count(*) AS c FROM keyed JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
 promo AS (SELECT k, ds, o_orderpriority AS promo FROM tally
           QUALIFY row_number() OVER (PARTITION BY k, ds ORDER BY c DESC, o_orderpriority) = 1)
 SELECT 'Supplier ' || k AS product, ds, discount, price, promo FROM prices JOIN promo USING (k, ds))"""
