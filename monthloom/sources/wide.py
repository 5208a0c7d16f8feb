"""Wide inputs (one column per month, or one per product feature) to long tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthloom.functions.expressions import coerce_numeric, month_of, parse_period
from monthloom.operators.joins import feature_prefix_match


#: Between column names where they are one text.
_MARK = "\x01"


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """CSV (first row = headers, everything text), JSON or Parquet."""
    fmt = fmt or ("csv" if path.endswith((".csv", ".csv.gz")) else "json" if path.endswith(".json") else "parquet")
    reader = spark.read.format(fmt)
    return reader.option("header", True).load(path) if fmt == "csv" else reader.load(path)


def column_index(column: str | int) -> int:
    """Position of a column given as a spreadsheet letter (A, B, ..., AA) or a number."""
    if isinstance(column, int):
        return column
    place = 0
    for ch in column.upper():
        place = place * 26 + "ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(ch) + 1
    return place - 1


def wide_to_long(
    wide: DataFrame, product_column="A", first_data_column="B", date_format: str = "M.yyyy", last_wins: bool = True, row_number: str | None = None
) -> DataFrame:
    """``product, ds, y`` from one row per product and one column per month.

    Headers that are no dates are dropped with their values; rows without a label or
    without any number are dropped while still wide, which needs no shuffle.  The header
    dates are constants, so the optimizer parses each once.  Of several rows with
    one label the last is kept: by the column ``row_number`` where there is one, else by the
    order in which one file is read.  ``last_wins=False`` keeps all of them.
    """
    cols = wide.columns
    name = cols[column_index(product_column)]
    label = F.col(f"`{name}`").cast("string")
    months = [c for c in cols[column_index(first_data_column) :] if c != row_number]
    if last_wins:
        place = F.monotonically_increasing_id() if row_number is None else F.col(f"`{row_number}`")
        rows = wide.select(label.alias(name), *[F.col(f"`{h}`").cast("string") for h in months], place.alias("_at"))
        whole = F.max_by(F.struct(*[F.col(f"`{h}`") for h in months]), "_at").alias("_row")
        wide = rows.filter(F.trim(F.col(f"`{name}`")) != "").groupBy(F.col(f"`{name}`")).agg(whole).select(f"`{name}`", "_row.*")
    cells = F.array(
        *[
            F.struct(
                parse_period(F.lit(h), date_format).alias("ds"),
                coerce_numeric(F.col(f"`{h}`").cast("string")).alias("y"),
            )
            for h in months
        ]
    )
    rows = wide.select(label.alias("product"), cells.alias("_c")).filter(
        (F.trim("product") != "") & F.exists("_c", lambda c: c["ds"].isNotNull() & c["y"].isNotNull())
    )
    return rows.select("product", F.inline("_c")).filter(F.col("ds").isNotNull())


def drop_empty_series(demand: DataFrame) -> DataFrame:
    """Long form of the same rule: blank labels and series without any value go."""
    labelled = demand.filter(F.trim("product") != "")
    alive = labelled.filter(F.col("y").isNotNull()).select("product").distinct()
    return labelled.join(alive, "product", "left_semi")


def feature_store_long(wide: DataFrame, date_column: str | int = 0) -> DataFrame:
    """``ds, column, value`` from one row per date; dates snap to the month start.

    The header is one value and the cells of a row are one array of text, taken apart by position, so
    nothing is written per column but the cells themselves.
    """
    date = wide.columns[column_index(date_column)]
    names = [c for c in wide.columns if c != date]
    text = T.StructType([T.StructField(c, T.StringType()) for c in (date, *names)])
    cells = wide.to(text).withColumnRenamed(date, "_date").selectExpr("trunc(CAST(_date AS DATE), 'month') AS ds", "array(* EXCEPT (_date)) AS _cells")
    header = F.split(F.lit(_MARK.join(names)), _MARK)
    return cells.select("ds", F.posexplode("_cells").alias("_at", "value")).select("ds", F.get(header, F.col("_at")).alias("column"), "value")


def product_features(store: DataFrame, products: DataFrame, kinds: dict) -> DataFrame:
    """``product, ds, <feature>...`` from the long store; ``kinds`` maps a feature to its type."""
    names = store.select("column").distinct()
    owned = feature_prefix_match(names, products)
    matched = store.join(owned, "column")
    wide = matched.groupBy("product", "ds").pivot("feature", list(kinds)).agg(F.first("value"))
    return wide.select("product", "ds", *[F.col(f).try_cast(t).alias(f) for f, t in kinds.items()])
