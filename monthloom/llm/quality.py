"""Quality rules with thresholds taken from the data of each language and source.

For every (lang, source) the values of a measure are kept in a sketch: counts in bins whose width
grows with the value, three significant bits each.  Sketches merge by adding counts, so they are
built before the shuffle and a group of any size arrives as a few hundred numbers.  A document is
an outlier if a measure lies far outside the middle half of its group.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from monthloom.llm.common import stored

SPACE = r"[\x20\x09-\x0D]"
MEASURES = ("m_word_length", "m_symbols", "m_dup_lines")
#: How far beyond the quartiles a value must lie at least to be an outlier, in the measure's units:
#: one character per word, 0.25 symbols per word, a quarter of the lines.
SLACK = {"m_word_length": 100, "m_symbols": 250, "m_dup_lines": 250}
REACH = 3
MIN_ROWS = 50
MIN_WORDS = 20
MAX_REPEATED = 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_starts(h8: Column) -> Column:
    """Where windows begin that occur twice or more, in order, from the hashes of all windows."""
    m = F.size(h8)
    pairs = F.sort_array(F.zip_with(h8, F.sequence(F.lit(1), m), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    before = F.concat(none, F.slice(pairs, F.lit(1), m - 1))
    after = F.concat(F.slice(pairs, F.lit(2), m - 1), none)
    with_before = F.zip_with(pairs, before, lambda x, y: F.struct(x.h.alias("h"), x.i.alias("i"), (x.h == y.h).alias("same")))
    starts = F.zip_with(
        with_before, after, lambda x, y: F.when(F.coalesce(x.same, F.lit(False)) | F.coalesce(x.h == y.h, F.lit(False)), x.i)
    )
    return F.array_sort(F.filter(starts, lambda i: i.isNotNull()))


BASE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")


def measured(docs: DataFrame, repeats: bool = True) -> DataFrame:
    """``docs`` with the counts of each whole text, names with two leading underscores.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_lines`` (with a word),
    ``n_dup_lines`` (equal to an earlier one) and, if asked for, ``n_repeat_words`` (words in windows of
    eight words that occur twice or more).  A null text has none of them.  Windows are told
    apart by 64-bit hashes.  Only texts with a repeated window pay for finding its words.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.array_remove(F.split(text, SPACE + "+"), "")
    d = docs.select(*keep, lines.alias("__lines"), words.alias("__w"))
    base = [
        F.size("__w").cast("long").alias("__n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("__word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("__n_symbols"),
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__n_dup_lines"),
    ]
    if not repeats:
        return d.select(*keep, *base)
    keep += [F.col(f"__{c}") for c in BASE]

    def joined(step: int, less: int) -> Column:
        size = F.greatest(F.col("__n_words") - less, F.lit(0)).cast("int")
        a, b = F.slice("__h", F.lit(1), size), F.slice("__h", F.lit(1 + step), size)
        return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))

    # windows of 2, 4 and 8 words from pairs of shorter ones
    d = d.select("*", *base).select(*keep, F.transform("__w", lambda x: F.xxhash64(x)).alias("__h"))
    for step, less in ((1, 1), (2, 3), (4, 7)):
        d = d.select(*keep, joined(step, less).alias("__h"))
    some = F.size("__h") > F.size(F.array_distinct("__h"))
    d = d.select(*keep, F.when(some, F.col("__h")).alias("__h"))
    d = d.select(*keep, F.when(F.col("__h").isNotNull(), _repeated_starts(F.col("__h"))).alias("__s"))
    gaps = F.zip_with(F.slice("__s", F.lit(2), F.size("__s") - 1), F.slice("__s", F.lit(1), F.size("__s") - 1), lambda b, a: F.least(b - a, F.lit(8)))
    covered = F.when(F.col("__s").isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(8), lambda x, y: x + y))
    return d.select(*keep, covered.cast("long").alias("__n_repeat_words"))


def _measures() -> list[Column]:
    """Integers: word length in hundredths, symbols per thousand words, repeated lines per thousand lines."""
    values = (
        F.expr("100 * __word_chars div greatest(__n_words, 1)"),
        F.expr("1000 * __n_symbols div greatest(__n_words, 1)"),
        F.expr("1000 * __n_dup_lines div greatest(__n_lines, 1)"),
    )
    return [v.cast("long").alias(f"__{m}") for v, m in zip(values, MEASURES, strict=True)]


def bin_of(v: Column) -> Column:
    """The bin of a number from 0 on: exact below 16, then eight bins to each doubling."""
    e = F.greatest(F.length(F.bin(v)) - 4, F.lit(0))
    return (e * 8 + F.floor(v / F.pow(F.lit(2), e))).cast("long")


def bin_bounds(b: Column) -> tuple[Column, Column]:
    e = F.when(b < 16, F.lit(0)).otherwise(F.floor(b / 8) - 1)
    low = (b - 8 * e) * F.pow(F.lit(2), e)
    return low.cast("long"), (low + F.pow(F.lit(2), e) - 1).cast("long")


def sketch(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``measure``, ``bin``, ``c``: of all texts of ``MIN_WORDS`` words or more."""
    rows = measured(docs.select("text", "lang", "source"), repeats=False)
    rows = rows.where(F.col("__n_words") >= MIN_WORDS).select("lang", "source", *_measures())
    long = rows.select(
        "lang",
        "source",
        F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(F.col(f"__{m}")).alias("bin")) for m in MEASURES])).alias("x"),
    )
    return long.groupBy("lang", "source", "x.measure", "x.bin").agg(F.count("*").alias("c"))


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups."""
    return sketches.groupBy(*keys, "measure", "bin").agg(F.sum("c").alias("c"))


def fences(sketches: DataFrame, *keys: str) -> DataFrame:
    """Per group and measure ``total``, ``low`` and ``high``: the quartiles widened by ``REACH`` times
    their distance, or by the measure's slack if that is more."""
    group = Window.partitionBy(*keys, "measure")
    below = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    s = sketches.withColumn("below", F.sum("c").over(below)).withColumn("total", F.sum("c").over(group))
    low, high = bin_bounds(F.col("bin"))
    q = s.groupBy(*keys, "measure").agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("below") >= F.col("total"), low)).alias("q1"),
        F.min(F.when(4 * F.col("below") >= 3 * F.col("total"), high)).alias("q3"),
    )
    slack = F.coalesce(*[F.when(F.col("measure") == m, F.lit(v)) for m, v in SLACK.items()])
    reach = F.greatest(REACH * (F.col("q3") - F.col("q1")), slack)
    return q.select(*keys, "measure", "total", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def thresholds(docs: DataFrame) -> DataFrame:
    """A row per (lang, source) with ``<measure>_low`` and ``<measure>_high``.

    A group of fewer than ``MIN_ROWS`` texts takes those of its language, and a language of
    fewer those of the whole table.
    """
    own = stored(sketch(docs), "sketches")  # a few hundred rows per group
    by_lang = merged(own, "lang")
    overall = fences(merged(own)).select("measure", F.col("low").alias("low0"), F.col("high").alias("high0"))
    lang = fences(by_lang, "lang").select(
        F.col("lang").alias("lang1"), F.col("measure").alias("measure1"), F.col("total").alias("n1"), F.col("low").alias("low1"), F.col("high").alias("high1")
    )
    groups = fences(own, "lang", "source")
    j = groups.join(lang, F.col("lang").eqNullSafe(F.col("lang1")) & (F.col("measure") == F.col("measure1"))).join(overall, "measure")

    def pick(name):
        return (
            F.when(F.col("total") >= MIN_ROWS, F.col(name)).when(F.col("n1") >= MIN_ROWS, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
        )

    j = j.select("lang", "source", "measure", pick("low").alias("low"), pick("high").alias("high"))
    cols = [
        F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("low", "high")
    ]
    return j.groupBy("lang", "source").agg(*cols)


def judged(docs: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` with a struct ``__q``: the counts, the measures, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ``MIN_WORDS`` words, or more than ``MAX_REPEATED`` per cent of them in
    repeated windows (see ``measured``).  ``kept``: not that, and no measure outside its
    group's thresholds.  Null text counts as empty; null lang and source are groups of their own;
    repeated rows are judged each by itself.  ``docs`` needs ``text``, ``lang`` and ``source``.
    Thresholds are broadcast if there are at most ``broadcast_rows`` groups.
    """
    limits = stored(thresholds(docs), "thresholds")
    names = [f"{m}_{side}" for m in MEASURES for side in ("low", "high")]
    limits = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.struct(*names).alias("__t"))
    if limits.count() <= broadcast_rows:
        limits = F.broadcast(limits)
    m = measured(docs)
    own = [F.col(f"`{c}`") for c in docs.columns]
    j = m.join(limits, m["lang"].eqNullSafe(F.col("__lang")) & m["source"].eqNullSafe(F.col("__source")), "left")
    failed = (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEATED * F.col("__n_words"))
    counts = [*BASE, "n_repeat_words"]
    j = j.select(*own, *[f"__{c}" for c in counts], *_measures(), failed.alias("__base_failed"), "__t")
    inside = ~F.col("__base_failed")
    for x in MEASURES:
        inside &= F.coalesce(F.col(f"__{x}").between(F.col(f"__t.{x}_low"), F.col(f"__t.{x}_high")), F.lit(True))
    verdict = [F.col(f"__{c}").alias(c) for c in (*counts, *MEASURES, "base_failed")]
    return j.select(*own, F.struct(*verdict, inside.alias("kept")).alias("__q"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    # a filter that sank below the steps of `measured` would repeat each of them several times:
    # the row number, which it cannot pass, keeps it above
    numbered = judged(docs).select(*own, F.col("__q.kept").alias("__kept"), F.monotonically_increasing_id().alias("__row"))
    return numbered.where(F.col("__kept") & (F.col("__row") >= 0)).select(*own)
