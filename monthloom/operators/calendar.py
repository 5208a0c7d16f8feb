"""Month grids: building them, filling them, and the two table shapes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthloom.functions.expressions import month_of
from monthloom.session import spread


def by_month(*cols: str):
    """The one window every per-product operator shares (one shuffle, one sort)."""
    return W.partitionBy("product", *cols).orderBy("ds")


def to_monthly(facts: DataFrame, product, when: str, value, how=F.sum) -> DataFrame:
    """Aggregate raw facts to one row per product and month.

    The key is (product, month) and the aggregate is partial, so a product holding a
    large share of the facts is reduced before anything is shuffled.
    """
    product = F.col(product) if isinstance(product, str) else product
    return facts.groupBy(product.alias("product"), month_of(F.col(when)).alias("ds")).agg(
        how(value).alias("y")
    )


def month_bounds(facts: DataFrame, when: str, drop_last: bool = False) -> DataFrame:
    """One row ``b STRUCT<lo, hi>``: first and last month; ``drop_last`` skips a partial one."""
    hi = F.add_months(month_of(F.max(when)), -1 if drop_last else 0)
    return facts.agg(F.struct(month_of(F.min(when)).alias("lo"), hi.alias("hi")).alias("b"))


def reindex_calendar(demand: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Put every product on the same month grid; months without a row get NULL.

    Each row generates the months up to the product's next row, so the fill needs the
    one shuffle by product (which everything after it reuses) and no join against a
    generated grid.  ``bounds`` (from :func:`month_bounds`) is a single row and enters as a scalar
    subquery.  Of several rows for one product and month the one with the largest value stays.
    """
    if bounds is None:
        bounds = demand.agg(F.struct(F.min("ds").alias("lo"), F.max("ds").alias("hi")).alias("b"))
    b = bounds.scalar()
    w = by_month()
    placed = spread(demand)
    framed = placed.select("product", "ds", "y", b.getField("lo").alias("_lo"), b.getField("hi").alias("_hi"))
    framed = framed.filter(F.col("ds").between(F.col("_lo"), F.col("_hi")))
    later = F.lead("ds").over(W.partitionBy("product").orderBy("ds", "y"))
    framed = framed.withColumn("_later", later).filter(F.col("_later").isNull() | (F.col("_later") != F.col("ds")))
    first = F.when(F.lag("ds").over(w).isNull(), F.col("_lo")).otherwise(F.col("ds"))
    until = F.coalesce(F.add_months(F.lead("ds").over(w), -1), F.col("_hi"))
    framed = framed.select("product", "ds", "y", F.sequence(first, until, F.expr("interval 1 month")).alias("_s"))
    months = framed.select("product", F.explode("_s").alias("_m"), F.col("ds").alias("_ds"), "y")
    return months.select("product", F.col("_m").alias("ds"), F.when(F.col("_m") == F.col("_ds"), F.col("y")).alias("y"))


def last_n_window(demand: DataFrame, n: int = 60, keep_rank: str | None = None) -> DataFrame:
    """The ``n`` most recent rows of each product (planned as a window group limit)."""
    w = W.partitionBy("product").orderBy(F.col("ds").desc())
    out = demand.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", keep_rank) if keep_rank else out.drop("_rn")


def history_tail(demand: DataFrame, n: int = 36) -> DataFrame:
    return last_n_window(demand, n)


def pack(demand: DataFrame, *extra: str) -> DataFrame:
    """Long to packed.  A group is one product's months, bounded by the window."""
    rows = F.array_sort(F.collect_list(F.struct("ds", "y", *extra)))
    packed = demand.groupBy("product").agg(rows.alias("_r"))
    cols = [F.col("_r").getField(c).alias(c) for c in extra]
    return packed.select(
        "product",
        F.col("_r")[0]["ds"].alias("start"),
        F.size("_r").alias("n"),
        F.col("_r").getField("y").alias("ys"),
        *cols,
    )


def unpack(packed: DataFrame, values: Column | str = "ys", name: str = "y") -> DataFrame:
    values = F.col(values) if isinstance(values, str) else values
    return packed.select("product", "start", F.posexplode(values).alias("i", name)).select(
        "product", "i", F.add_months("start", F.col("i")).alias("ds"), name
    )


def future_calendar(demand: DataFrame, horizon: int = 12) -> DataFrame:
    """``horizon`` month starts after each product's last date."""
    last = demand.groupBy("product").agg(F.max("ds").alias("last"))
    return future_rows(last, horizon)


def future_rows(last: DataFrame, horizon: int) -> DataFrame:
    """Explode a table holding ``last DATE`` into ``step, ds`` rows, other columns kept."""
    keep = [c for c in last.columns if c != "last"]
    return last.select(*keep, "last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")).select(
        *keep, "step", F.add_months("last", F.col("step")).alias("ds")
    )


def concat_splits(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def append_future(history: DataFrame, future: DataFrame) -> DataFrame:
    """History followed by future rows whose target is still unknown."""
    missing = [c for c in history.columns if c not in future.columns]
    filled = future.select(*[c for c in future.columns if c in history.columns])
    for c in missing:
        filled = filled.withColumn(c, F.lit(None).cast(history.schema[c].dataType))
    return history.unionByName(filled)
