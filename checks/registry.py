"""Where the checked queries are collected, and how their results are put in comparable form."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict = {}
RAW: dict = {}  # the same without rounding, for timing
ORACLES: dict = {}


def presentable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, dates as text; both engines then print the same values."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("date").cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.LongType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a function (spark, sf_dir) -> DataFrame, with its DuckDB equivalent if there is one."""

    def register(fn):
        RAW[name] = fn
        QUERIES[name] = lambda spark, sf: presentable(fn(spark, sf), digits)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def final(ctes: str, source: str, columns: str, digits: int = 6) -> str:
    """``WITH RECURSIVE <ctes> SELECT ...``; a column spec is ``name``, ``name:f`` (rounded
    double), ``name:d`` (date as text) or ``name:i`` (integer)."""
    parts = []
    for spec in columns.split():
        name, _, kind = spec.partition(":")
        q = f'"{name}"'
        parts.append(
            {
                "f": f"round(CAST({q} AS DOUBLE), {digits}) + 0.0 AS {q}",
                "d": f"CAST(CAST({q} AS DATE) AS VARCHAR) AS {q}",
                "i": f"CAST({q} AS BIGINT) AS {q}",
                "": q,
            }[kind]
        )
    head = f"WITH RECURSIVE {ctes}\n" if ctes else ""
    return f"{head}SELECT {', '.join(parts)} FROM {source}"
