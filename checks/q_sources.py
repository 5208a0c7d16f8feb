"""Inputs, names and stores."""

from pyspark.sql import functions as F

from checks.registry import final, query
from checks.tables import SUPPLIER, bounds, part_raw, read, supplier_raw
from monthloom.functions.expressions import coerce_numeric, normalize_name, parse_period, safe_name
from monthloom.operators.joins import feature_kinds, feature_prefix_match, select_features
from monthloom.session import shared_folder
from monthloom.sources import store
from monthloom.sources.wide import drop_empty_series, feature_store_long, product_features, wide_to_long


def month_headers(spark, sf):
    """The calendar as header labels, e.g. 1.1995 (one row collected)."""
    b = bounds(spark, sf).select("b.*").first()
    count = (b["hi"].year - b["lo"].year) * 12 + b["hi"].month - b["lo"].month + 1
    start = b["lo"].year * 12 + b["lo"].month - 1
    return [f"{(start + k) % 12 + 1}.{(start + k) // 12}" for k in range(count)]


def wide_demand(spark, sf):
    """The supplier table as a wide sheet of text: some cells unreadable, some labels blank."""
    d = supplier_raw(spark, sf)
    text = F.when(F.col("y") % 7 == 0, "n/a").otherwise(F.col("y").cast("string"))
    label = F.when(F.col("product").endswith("5"), F.lit(" ")).otherwise(F.col("product"))
    header = F.concat_ws(".", F.month("ds"), F.year("ds"))
    cells = d.select(F.col("product").alias("k"), label.alias("product"), header.alias("h"), text.alias("v"))
    wide = cells.groupBy("k", "product").pivot("h", month_headers(spark, sf)).agg(F.first("v"))
    return wide.drop("k")


WIDE = SUPPLIER + """,
sheet AS (SELECT product, ds, CASE WHEN y % 7 = 0 THEN NULL ELSE y END AS y FROM supplier_d WHERE NOT ends_with(product, '5')),
t AS (SELECT * FROM sheet WHERE product IN (SELECT product FROM sheet WHERE y IS NOT NULL))"""


@query("wide_to_long", final(WIDE, "t", "product ds:d y:f"))
def q_wide_to_long(spark, sf):
    return wide_to_long(wide_demand(spark, sf), "A", "B")


PERIODS = """
s AS (SELECT o_orderkey % 9 AS k, CAST(o_orderdate AS DATE) AS d FROM orders),
l AS (SELECT k, d, CASE k
   WHEN 0 THEN month(d) || '.' || year(d)
   WHEN 1 THEN strftime(d, '%Y-%m-%d')
   WHEN 2 THEN strftime(d, '%d.%m.%Y')
   WHEN 3 THEN strftime(d, '%m/%d/%Y')
   WHEN 4 THEN strftime(d, '%Y/%m/%d')
   WHEN 5 THEN CAST(date_diff('day', DATE '1899-12-30', d) AS VARCHAR)
   WHEN 6 THEN strftime(d, '%m%Y')
   WHEN 7 THEN strftime(d, ' %m.%Y ')
   ELSE 'Q' || quarter(d) END AS label FROM s),
t AS (SELECT label, CASE WHEN k IN (0, 6, 7) THEN date_trunc('month', d) WHEN k = 8 THEN NULL ELSE d END AS ds, count(*) AS n FROM l GROUP BY 1, 2)"""


@query("parse_period", final(PERIODS, "t", "label ds:d n:i"))
def q_parse_period(spark, sf):
    o = read(spark, sf, "orders").select((F.col("o_orderkey") % 9).alias("k"), F.col("o_orderdate").cast("date").alias("d"))
    d, k = F.col("d"), F.col("k")
    label = (
        F.when(k == 0, F.concat_ws(".", F.month(d), F.year(d)))
        .when(k == 1, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 2, F.date_format(d, "dd.MM.yyyy"))
        .when(k == 3, F.date_format(d, "MM/dd/yyyy"))
        .when(k == 4, F.date_format(d, "yyyy/MM/dd"))
        .when(k == 5, F.date_diff(d, F.lit("1899-12-30").cast("date")).cast("string"))
        .when(k == 6, F.date_format(d, "MMyyyy"))
        .when(k == 7, F.concat(F.lit(" "), F.date_format(d, "MM.yyyy"), F.lit(" ")))
        .otherwise(F.concat(F.lit("Q"), F.quarter(d).cast("string")))
    )
    # distinct labels first: a label repeats once per row, its parse is needed once
    counted = o.select(label.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("label", parse_period(F.col("label")).alias("ds"), "n")


@query(
    "coerce_numeric",
    final(
        "c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN CAST(o_totalprice AS VARCHAR) ELSE o_orderkey || 'x' END AS raw, o_totalprice FROM orders),"
        " t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice END AS v FROM c)",
        "t",
        "o_orderkey v:f",
    ),
)
def q_coerce_numeric(spark, sf):
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey")
    raw = (
        F.when(k % 3 == 0, F.col("o_orderpriority"))
        .when(k % 3 == 1, F.col("o_totalprice").cast("string"))
        .otherwise(F.concat(k.cast("string"), F.lit("x")))
    )
    return o.select("o_orderkey", coerce_numeric(raw).alias("v"))


def holes(spark, sf):
    """Part demand where some parts have no value at all and some no label."""
    p = part_raw(spark, sf)
    empty = p.product.endswith("3")
    label = F.when(F.col("product").endswith("4"), F.lit("  ")).otherwise(F.col("product"))
    return p.select(label.alias("product"), "ds", F.when(~empty, F.col("y")).alias("y"))


@query(
    "drop_empty_series",
    final(
        "r AS (SELECT 'Part ' || l_partkey AS product, date_trunc('month', l_shipdate) AS ds, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2),"
        " t AS (SELECT * FROM r WHERE NOT ends_with(product, '3') AND NOT ends_with(product, '4'))",
        "t",
        "product ds:d y:f",
    ),
)
def q_drop_empty(spark, sf):
    return drop_empty_series(holes(spark, sf))


def supplier_names(spark, sf):
    """Products wide enough to be columns of a feature store: the suppliers of one nation."""
    s = read(spark, sf, "supplier")
    return s.select(F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("product")).distinct()


def nation_features(spark, sf):
    """Monthly features per nation of the supplier, long."""
    li = read(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_discount", "l_extendedprice")
    ds = F.trunc("l_shipdate", "month").alias("ds")
    per = li.groupBy("l_suppkey", ds).agg(
        F.max("l_discount").alias("d"), F.min("l_extendedprice").alias("p"), F.count(F.lit(1)).alias("c")
    )
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    j = per.join(s, "l_suppkey").groupBy("s_nationkey", "ds").agg(
        F.max("d").alias("discount"), F.min("p").alias("price_level"), F.sum("c").alias("c")
    )
    promo = F.when(F.col("c") % 3 == 0, "none").when(F.col("c") % 3 == 1, "bundle").otherwise("discount")
    return j.select(
        F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("product"),
        "ds", "discount", "price_level", promo.alias("promo"),
    )


def feature_sheet(spark, sf):
    """The nation features as a wide sheet: one row per date, ``<product>_<feature>`` columns."""
    f = nation_features(spark, sf)
    names = sorted(r["product"] for r in supplier_names(spark, sf).collect())
    cols = [n.replace(" ", "_") for n in names]
    keyed = f.withColumn("product", normalize_name(F.col("product")))
    return keyed.groupBy(F.date_add("ds", 14).alias("Date")).pivot("product", cols).agg(
        F.first("discount").alias("discount"), F.first("price_level").alias("price_level"), F.first("promo").alias("promo")
    )


NATION_FEATURES = """
nf AS (SELECT s_nationkey AS k, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds, max(l_discount) AS discount,
   min(l_extendedprice) AS price_level, CASE count(*) % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'bundle' ELSE 'discount' END AS promo
   FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
nk AS (SELECT DISTINCT s_nationkey AS k FROM supplier),
nd AS (SELECT DISTINCT ds FROM nf),
ng AS (SELECT k, ds FROM nk, nd)"""


@query(
    "feature_store_long",
    final(
        NATION_FEATURES + """,
 t AS (SELECT g.ds, 'Nation_' || g.k || '_' || f.feature AS "column", CASE f.feature WHEN 'discount' THEN round(discount, 6) + 0.0 ELSE round(price_level, 6) + 0.0 END AS num,
   CASE WHEN f.feature = 'promo' THEN promo END AS txt
   FROM ng g CROSS JOIN (VALUES ('discount'), ('price_level'), ('promo')) f(feature) LEFT JOIN nf ON nf.k = g.k AND nf.ds = g.ds)""",
        "(SELECT ds, \"column\", CASE WHEN txt IS NULL AND NOT ends_with(\"column\", 'promo') THEN num END AS num, txt FROM t)",
        "ds:d column num:f txt",
    ),
)
def q_feature_store_long(spark, sf):
    long = feature_store_long(feature_sheet(spark, sf))
    num = F.col("value").try_cast("double")
    return long.select("ds", "column", num.alias("num"), F.when(num.isNull(), F.col("value")).alias("txt"))


@query(
    "feature_prefix_match",
    final(
        "p AS (SELECT p_brand AS product FROM part UNION SELECT p_brand || ' ' || p_type FROM part),"
        " c AS (SELECT replace(product, ' ', '_') || '_' || f AS col FROM p, (VALUES ('price'), ('promo_kind')) v(f) UNION SELECT 'nobody_price'),"
        " m AS (SELECT p.product, c.col, substr(c.col, length(p.product) + 2) AS feature, row_number() OVER (PARTITION BY c.col ORDER BY length(p.product) DESC) AS rn"
        " FROM c JOIN p ON starts_with(c.col, replace(p.product, ' ', '_') || '_'))",
        "(SELECT product, col AS \"column\", feature FROM m WHERE rn = 1 AND feature <> '')",
        "product column feature",
    ),
)
def q_feature_prefix_match(spark, sf):
    p = read(spark, sf, "part")
    products = (
        p.select(F.col("p_brand").alias("product"))
        .union(p.select(F.concat_ws(" ", "p_brand", "p_type")))
        .distinct()
    )
    suffixes = F.explode(F.array(F.lit("price"), F.lit("promo_kind")))
    cols = products.select(normalize_name(F.col("product")).alias("n"), suffixes.alias("f")).select(
        F.concat_ws("_", "n", "f").alias("column")
    )
    cols = cols.union(p.limit(1).select(F.lit("nobody_price"))).distinct()
    return feature_prefix_match(cols, products)


@query(
    "product_features",
    final(
        NATION_FEATURES,
        "(SELECT 'Nation ' || g.k AS product, g.ds, discount, price_level, promo FROM ng g LEFT JOIN nf ON nf.k = g.k AND nf.ds = g.ds)",
        "product ds:d discount:f price_level:f promo",
    ),
)
def q_product_features(spark, sf):
    store_long = feature_store_long(feature_sheet(spark, sf))
    kinds = {"discount": "double", "price_level": "double", "promo": "string"}
    return product_features(store_long, supplier_names(spark, sf), kinds)


def feature_names(spark, sf):
    return read(spark, sf, "part").select(
        F.col("p_brand").alias("product"), F.concat_ws("_", F.col("p_type"), F.col("p_size").cast("string")).alias("feature")
    ).distinct()


def allow_list(spark, sf):
    return read(spark, sf, "part").filter("p_retailprice > 1000 and p_brand like '%1%'").select(
        F.col("p_brand").alias("product"), F.concat_ws("_", F.col("p_type"), F.col("p_size").cast("string")).alias("feature")
    ).distinct()


@query(
    "select_features",
    final(
        "f AS (SELECT DISTINCT p_brand AS product, p_type || '_' || p_size AS feature FROM part),"
        " a AS (SELECT DISTINCT p_brand AS product, p_type || '_' || p_size AS feature FROM part WHERE p_retailprice > 1000 AND p_brand LIKE '%1%'),"
        " t AS (SELECT * FROM f WHERE product NOT IN (SELECT product FROM a) OR EXISTS (SELECT 1 FROM a WHERE a.product = f.product AND a.feature = f.feature))",
        "t",
        "product feature",
    ),
)
def q_select_features(spark, sf):
    return select_features(feature_names(spark, sf), allow_list(spark, sf))


@query(
    "feature_kinds",
    final(
        "f AS (SELECT DISTINCT p_brand AS product, p_type || '_' || p_size AS feature FROM part),"
        " t AS (SELECT *, CASE WHEN starts_with(feature, 'ECO') OR starts_with(feature, 'SMALL') THEN 'categorical' ELSE 'numeric' END AS kind FROM f)",
        "t",
        "product feature kind",
    ),
)
def q_feature_kinds(spark, sf):
    return feature_kinds(feature_names(spark, sf), ["ECO", "SMALL"])


@query("normalize_name", "SELECT p_partkey, replace(p_name, ' ', '_') AS name FROM part")
def q_normalize_name(spark, sf):
    return read(spark, sf, "part").select("p_partkey", normalize_name(F.col("p_name")).alias("name"))


@query(
    "safe_name",
    "SELECT p_partkey, substr(regexp_replace(p_brand || '/' || p_name || ' (' || p_type || ') nr. ' || p_partkey, '[^\\p{L}\\p{N}_-]', '_', 'g'), 1, 28) AS name FROM part",
)
def q_safe_name(spark, sf):
    text = F.concat(
        "p_brand", F.lit("/"), "p_name", F.lit(" ("), "p_type", F.lit(") nr. "), F.col("p_partkey").cast("string")
    )
    return read(spark, sf, "part").select("p_partkey", safe_name(text).alias("name"))


def saved_params(spark, sf):
    """Parameters as yearly runs would have left them, some unreadable."""
    d = supplier_raw(spark, sf)
    per = d.groupBy("product", F.year("ds").cast("string").alias("run_ts")).agg(F.max("y").cast("bigint").alias("m"))
    good = F.concat(F.lit('{"level":'), F.col("m").cast("string"), F.lit("}"))
    text = F.when(F.col("m") % 4 == 0, F.lit('{"level":')).otherwise(good)
    model = F.explode(F.array(F.lit("SARIMA"), F.lit("HoltWinters")))
    return per.select("product", model.alias("model"), text.alias("params_json"), "run_ts", "m")


SAVED = """
saved AS (SELECT product, model, CASE WHEN m % 4 = 0 THEN '{"level":' ELSE '{"level":' || m || '}' END AS params_json, run_ts FROM (
  SELECT product, CAST(year(ds) AS VARCHAR) AS run_ts, CAST(max(y) AS BIGINT) AS m FROM (
    SELECT 'Supplier ' || l_suppkey AS product, date_trunc('month', l_shipdate) AS ds, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2)
  GROUP BY 1, 2), (VALUES ('SARIMA'), ('HoltWinters')) v(model)),
latest AS (SELECT product, model, arg_max(params_json, run_ts) AS params_json, max(run_ts) AS run_ts FROM saved WHERE json_valid(params_json) GROUP BY 1, 2)"""


@query("param_store_latest", final(SAVED, "latest", "product model params_json run_ts"))
def q_param_store_latest(spark, sf):
    return store.param_store_latest(saved_params(spark, sf))


@query("param_store_exists", final(SAVED, "(SELECT s.product, s.model, l.product IS NOT NULL AS \"exists\" FROM (SELECT DISTINCT product, model FROM saved) s LEFT JOIN latest l USING (product, model))", "product model exists"))
def q_params_exist(spark, sf):
    p = saved_params(spark, sf)
    return store.params_exist(p, p.select("product", "model").distinct())


@query("run_list", final(SAVED, "(SELECT DISTINCT run_ts FROM saved)", "run_ts"))
def q_run_list(spark, sf):
    return store.run_list(saved_params(spark, sf))


def fresh_folder(spark, name):
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("param_store_save", final(SAVED, "latest", "product model params_json run_ts"))
def q_param_store_save(spark, sf):
    """A run appended for every year, read back, latest readable parameters."""
    path = fresh_folder(spark, "params")
    saved = saved_params(spark, sf)
    for run in sorted(r[0] for r in saved.select("run_ts").distinct().collect()):  # one row per year
        store.param_store_save(saved.filter(F.col("run_ts") == run).drop("run_ts"), path, run)
    return store.param_store_latest(store.param_store_read(spark, path))
