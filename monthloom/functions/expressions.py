"""Column expressions shared by the operators.  All of them run inside the JVM."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from monthloom.settings import EPS

# Header formats tried after the configured one, in this order.
PERIOD_FORMATS = ("yyyy-M-d", "d.M.yyyy", "M/d/yyyy", "yyyy/M/d")


def month_of(c) -> Column:
    """First day of the month."""
    return F.trunc(c, "month")


def parse_period(c: Column, fmt: str = "M.yyyy") -> Column:
    """Header text to DATE; NULL when nothing fits.

    Tried in turn: ``fmt``, the alternates above, ``M.YYYY`` within 1900-2100, ``MMYYYY``,
    a spreadsheet serial day number (at most five digits), and any ISO timestamp.
    """
    t = F.trim(c)
    by_format = [F.try_to_timestamp(t, F.lit(f)).cast("date") for f in (fmt, *PERIOD_FORMATS)]
    mm, yy = F.regexp_extract(t, r"^(\d+)\.(\d+)$", 1), F.regexp_extract(t, r"^(\d+)\.(\d+)$", 2)
    month, year = mm.try_cast("int"), yy.try_cast("int")
    dotted = F.when(month.between(1, 12) & year.between(1900, 2100), F.make_date(year, month, F.lit(1)))
    number = F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double"))
    serial = F.when(
        (number > 1) & (number < 100000),
        F.date_add(F.lit("1899-12-30").cast("date"), F.floor(number).cast("int")),
    )
    compact = F.when(t.rlike(r"^(0[1-9]|1[0-2])\d{4}$"), F.try_to_timestamp(t, F.lit("MMyyyy")).cast("date"))
    generic = F.when(~t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("timestamp").cast("date"))
    return F.coalesce(*by_format, dotted, compact, serial, generic)


def coerce_numeric(c: Column) -> Column:
    """Text to DOUBLE; anything that is not a finite or infinite number becomes NULL."""
    v = F.trim(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def normalize_name(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def safe_name(c: Column, width: int = 28) -> Column:
    """Label usable as a file or sheet name: letters, digits, ``-`` and ``_`` only."""
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_"), 1, width)


def neighbor_mean(prev: Column, nxt: Column) -> Column:
    """Mean of the usable (present, not negative) neighbours; 0.0 when there is none."""
    p, q = F.when(prev >= 0, prev), F.when(nxt >= 0, nxt)
    return F.coalesce((p + q) / 2, p, q, F.lit(0.0))


def ape(y: Column, yhat: Column) -> Column:
    """Absolute percentage error; NULL where the actual is zero."""
    return F.abs((y - yhat) / F.nullif(y, F.lit(0.0)))


def ape_eps(y: Column, yhat: Column) -> Column:
    """The tuning variant: the denominator is shifted instead of guarded."""
    return F.abs((y - yhat) / (y + F.lit(EPS)))


def uniform(*parts) -> Column:
    """A reproducible draw from [0, 1): the first 32 bits of an md5 over the parts."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def starts_with_any(c: Column, prefixes) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes], F.lit(False))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def months_after(start: Column, k: Column) -> Column:
    return F.add_months(start, k)
