"""Repair of negative, missing and outlying values.

The repairs are defined left to right: a bad value becomes the mean of its already
repaired predecessor and its raw successor.

* For negatives and for gaps that recursion has a closed form.  Inside a run of bad
  values every successor is bad too, so all but the last of the run take the value
  before the run (0.0 if there is none), and the last one takes the mean of that and
  the good value after the run.  Window functions say this directly.
* An outlier is judged against the *repaired* predecessor, which has no closed form.
  It is a fold over the product's months, and only products that have at least one
  step outside the bounds pay for it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthloom.functions.expressions import neighbor_mean
from monthloom.operators.calendar import by_month


def _repair_runs(df: DataFrame, col: str, is_bad: Column, out: str, flag: str) -> DataFrame:
    w = by_month()
    before = w.rowsBetween(W.unboundedPreceding, -1)
    good = F.when(~F.col(flag), F.struct(F.col(col).alias("v")))
    marked = df.withColumn(flag, is_bad).withColumns(
        {
            "_prev": F.lag(col).over(w),
            "_prev_bad": F.coalesce(F.lag(flag).over(w), F.lit(False)),
            "_next": F.lead(col).over(w),
            "_before_run": F.last(good, ignorenulls=True).over(before)["v"],
        }
    )
    prev = F.when(F.col("_prev_bad"), F.coalesce("_before_run", F.lit(0.0))).otherwise(F.col("_prev"))
    fixed = F.when(F.col(flag), neighbor_mean(prev, F.col("_next"))).otherwise(F.col(col))
    return marked.select(*df.columns, flag, fixed.alias(out))


def clean_negative(demand: DataFrame, col: str = "y", out: str = "c1") -> DataFrame:
    """First repair: negative values.  Adds ``out`` and the flag ``neg``."""
    return _repair_runs(demand, col, F.coalesce(F.col(col) < 0, F.lit(False)), out, "neg")


def clean_missing(demand: DataFrame, col: str = "c1", out: str = "c2") -> DataFrame:
    """Second repair: missing values.  Adds ``out`` and the flag ``mis``."""
    return _repair_runs(demand, col, F.col(col).isNull(), out, "mis")


def diffs(demand: DataFrame, col: str = "y", out: str = "d") -> DataFrame:
    return demand.withColumn(out, F.col(col) - F.lag(col).over(by_month()))


def _bounds(q1: Column, q3: Column, count: Column, multiplier: float) -> tuple[Column, Column]:
    iqr = q3 - q1
    enough = count > 3
    return (
        F.when(enough, q1 - F.lit(multiplier) * iqr),
        F.when(enough, q3 + F.lit(multiplier) * iqr),
    )


def outlier_bounds(demand: DataFrame, col: str = "y", multiplier: float = 3.0) -> DataFrame:
    """Per product: quartiles of the first differences and the accepted range of a step."""
    q = diffs(demand, col).groupBy("product").agg(
        F.percentile("d", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"), F.count("d").alias("n_diffs")
    )
    lo, hi = _bounds(F.col("_q")[0], F.col("_q")[1], F.col("n_diffs"), multiplier)
    return q.select(
        "product", "n_diffs", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"), lo.alias("lower"), hi.alias("upper")
    )


def _fold_outliers(rows: Column, lo: Column, hi: Column) -> Column:
    """Array of repaired values; ``rows`` carries ``cur, nxt, done, lo, hi``."""

    def step(acc, x):
        prev = F.get(acc, F.size(acc) - 1)
        jump = x["cur"] - prev
        out = ((jump < x["lo"]) | (jump > x["hi"])) & ~x["done"]
        return F.array_append(acc, F.when(out, neighbor_mean(prev, x["nxt"])).otherwise(x["cur"]))

    return F.aggregate(rows, F.array().cast("array<double>"), step)


def clean_packed(demand: DataFrame, multiplier: float = 3.0) -> DataFrame:
    """All three repairs; one row per product.

    ``rows ARRAY<STRUCT<ds, y, c1, c2, neg, mis>>`` holds the stages, ``ys`` the result.
    Everything from the first window to the fold shares the partitioning by product.
    """
    w = by_month()
    staged = clean_missing(clean_negative(demand))
    staged = staged.withColumns({"d": F.col("c2") - F.lag("c2").over(w), "_nxt": F.lead("c2").over(w)})
    packed = staged.groupBy("product").agg(
        F.array_sort(F.collect_list(F.struct("ds", "y", "c1", "c2", "neg", "mis", "d", "_nxt"))).alias("rows"),
        F.percentile("d", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"),
        F.count("d").alias("_nd"),
    )
    lo, hi = _bounds(F.col("_q")[0], F.col("_q")[1], F.col("_nd"), multiplier)
    packed = packed.withColumns({"lower": lo, "upper": hi})
    suspicious = F.exists(
        "rows",
        lambda r: ((r["d"] < F.col("lower")) | (r["d"] > F.col("upper"))) & ~r["neg"] & ~r["mis"],
    )
    fold_rows = F.transform(
        "rows",
        lambda r: F.struct(
            r["c2"].alias("cur"),
            r["_nxt"].alias("nxt"),
            (r["neg"] | r["mis"]).alias("done"),
            F.col("lower").alias("lo"),
            F.col("upper").alias("hi"),
        ),
    )
    ys = F.when(suspicious, _fold_outliers(fold_rows, F.col("lower"), F.col("upper"))).otherwise(
        F.transform("rows", lambda r: r["c2"])
    )
    return packed.select(
        "product",
        F.col("rows")[0]["ds"].alias("start"),
        F.size("rows").alias("n"),
        ys.alias("ys"),
        "rows",
        "lower",
        "upper",
    )


def clean_rows(packed: DataFrame) -> DataFrame:
    """Packed to long: ``product, i, ds, y (raw), c2, clean, reason``."""
    # the repaired predecessor of each value, which is what an outlier was judged against
    before = F.concat(F.array(F.lit(None).cast("double")), F.slice("ys", 1, F.size("ys") - 1))
    zipped = F.arrays_zip(F.col("rows").alias("r"), F.col("ys").alias("v"), before.alias("p"))
    flat = packed.select("product", "lower", "upper", F.posexplode(zipped).alias("i", "z"))
    r = F.col("z.r")
    jump = r["c2"] - F.col("z.p")
    reason = (
        F.when(r["neg"], "negative")
        .when(r["mis"], "missing")
        .when((jump < F.col("lower")) | (jump > F.col("upper")), "outlier")
    )
    return flat.select(
        "product",
        "i",
        r["ds"].alias("ds"),
        r["y"].alias("y"),
        r["c2"].alias("c2"),
        F.col("z.v").alias("clean"),
        reason.alias("reason"),
    )


def clean_all(demand: DataFrame, multiplier: float = 3.0) -> DataFrame:
    return clean_rows(clean_packed(demand, multiplier))


def change_log(cleaned: DataFrame) -> DataFrame:
    """One row per replacement."""
    return cleaned.filter(F.col("reason").isNotNull()).select(
        "product",
        "i",
        "ds",
        "reason",
        F.when(F.col("reason") == "outlier", F.col("c2")).otherwise(F.col("y")).alias("original"),
        F.col("clean").alias("new"),
    )


def change_counts(cleaned: DataFrame) -> DataFrame:
    def tally(reason):
        return F.count_if(F.col("reason") == reason).alias(f"n_{reason}")

    return cleaned.groupBy("product").agg(
        tally("negative"), tally("missing"), tally("outlier"), F.count("reason").alias("n_total")
    )
