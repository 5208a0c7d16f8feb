"""URL filters: written rules by host and path, and mined rules from labelled pages.

FP-growth finds combinations of URL tokens that are frequent among labelled pages; those that
go with the bad label often enough (confidence) and in enough pages (support) become rules.  They
are matched through an inverted index from token to rule.  DataFrame functions only.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.llm.common import stored

#: Marks a bad page in a basket; every token of a URL has a ``=``, so none can be equal to it.
BAD = "bad"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, the host and its parents, its labels, path segments, kind of file, query keys."""
    host, path = url_host(url), url_path(url)
    labels = F.array_remove(F.split(host, r"\."), "")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
        lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.greatest(F.size(labels), F.lit(1))), ".")),
    )
    segments = F.array_remove(F.split(path, "/"), "")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
            F.when(F.size(labels) > 0, parents).otherwise(F.array().cast("array<string>")),
            F.transform(labels, lambda x: F.concat(F.lit("label="), x)),
            F.transform(segments, lambda x: F.concat(F.lit("segment="), x)),
            F.transform(
                F.filter(segments, lambda x: x.contains(".")),
                lambda x: F.concat(F.lit("kind="), F.substring_index(x, ".", -1)),
            ),
            F.transform(keys, lambda p: F.concat(F.lit("key="), F.substring_index(p, "=", 1))),
        )
    )


def written_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``host``, ``path`` and ``found`` (rule, verdict), the longest rule that fits, for each distinct host and path with one.

    ``rules`` are (verdict, ``host/path``).  A rule fits its host and all subdomains where the path
    begins with the rule's.  Of rules of one length the first in alphabetical order wins.  Rules are met by
    a join on the host and its parents, however many there are.
    """
    rows = [(rule.partition("/")[0], "".join(rule.partition("/")[1:]), rule, verdict, -len(rule)) for verdict, rule in rules]
    schema = "name string, prefix string, rule string, verdict string, rank int"
    known = pages.sparkSession.createDataFrame(rows, schema)
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = pages.select("host", "path").distinct().select("host", "path", F.explode(parents).alias("name")).join(known, "name")
    fits = met.where(F.col("path").startswith(F.col("prefix")))
    best = fits.groupBy("host", "path").agg(F.min(F.struct("rank", "rule", "verdict")).alias("b"))
    return best.select("host", "path", F.struct("b.rule", "b.verdict").alias("found"))


def _same_rows(tokens: DataFrame, least: int) -> DataFrame:
    """``token``, ``item``: tokens in at least ``least`` rows, and the one that stands for all in the same rows.

    Tokens of one host always come together: as single items their combinations would double with every
    token.  Which rows a token is in is told by their number and three sums over hashes of their urls.
    """
    h = F.xxhash64("url")
    sums = [F.sum(F.pmod(x, F.lit(m))) for x, m in ((h, 1_000_000_007), (h, 998_244_353), (F.xxhash64(F.lit(7), "url"), 1_000_000_007))]
    where = tokens.groupBy("token").agg(F.count("*").alias("rows"), F.array(*sums).alias("sums")).where(F.col("rows") >= least)
    first = where.groupBy("rows", "sums").agg(F.min("token").alias("item"))
    return where.join(first, ["rows", "sums"]).select("token", "item")


def mine(
    labelled: DataFrame, min_support: float = 0.0005, min_rows: int = 30, min_confidence: float = 0.6
) -> DataFrame:
    """Rules ``rule_id``, ``tokens``, ``support`` (rows with tokens and bad label) and ``confidence``.

    ``labelled`` has ``url`` and a boolean ``bad``; rows where one is null are left out.  A
    combination counts if it stands in ``min_support`` of the rows and ``min_rows`` of them.  A rule
    that adds tokens to another rule without a higher confidence is dropped.  Tokens that stand in the
    same rows are one item: ``tokens`` names the first of each item in alphabetical order, ``any_of`` all of them, and a
    rule fits where some token of each item is, as if there were a rule for each choice.  Ids are hashes of
    ``tokens``.  Without labelled rows there are no rules.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("url").isNotNull() & F.col("bad").isNotNull()).select("url", "bad")
    n = rows.count()
    if n == 0:
        return spark.createDataFrame([], "rule_id long, tokens array<string>, support long, confidence double, any_of array<array<string>>")
    least = max(min_support * n, min_rows)
    urls = rows.select("url").distinct()
    same = stored(_same_rows(rows.select("url", F.explode(url_tokens(F.col("url"))).alias("token")), math.ceil(least)), "url-items")
    items = (
        urls.select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
        .join(same, "token")
        .groupBy("url")
        .agg(F.collect_set("item").alias("items"))  # one url's tokens
    )
    mark = F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    baskets = rows.join(items, "url", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), mark).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n), minConfidence=1.0).fit(baskets)
    sets = model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    joint = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(
        F.array_remove("items", BAD).alias("items"), F.col("freq").alias("support")
    )
    rules = joint.join(sets, "items").withColumn("confidence", F.col("support") / F.col("freq"))
    sure = (F.col("confidence") >= min_confidence) & (F.col("support") >= min_rows)
    kept = _needed(rules.select("items", "support", "confidence", sure.alias("sure")))
    # any token of an item is as good as the item
    spelled = same.groupBy("item").agg(F.array_sort(F.collect_set("token")).alias("any"))
    full = kept.select("items", "support", "confidence", F.explode("items").alias("item")).join(spelled, "item")
    full = full.groupBy("items", "support", "confidence").agg(F.collect_list("any").alias("any_of"))
    return full.select(F.xxhash64("items").alias("rule_id"), F.col("items").alias("tokens"), "support", "confidence", "any_of")


def _needed(rules: DataFrame) -> DataFrame:
    """The sure rules without those of which a part is a rule that is as sure.

    What a part of a set can do is handed on from size to size, one item less at a time, so the work
    grows with the sets and their sizes and not with the pairs of sets.
    """
    spark = rules.sparkSession
    rules = stored(rules.withColumn("size", F.size("items")), "url-rules")
    own = F.when(F.col("sure"), F.col("confidence"))
    out, below = None, None
    for size in range(1, (rules.agg(F.max("size")).first()[0] or 0) + 1):
        here = rules.where(F.col("size") == size)
        if below is None:
            level = here.withColumn("part", F.lit(None).cast("double"))
        else:
            less = here.select("items", F.explode("items").alias("one")).select("items", F.array_remove("items", F.col("one")).alias("less"))
            parts = less.join(below, "less").groupBy("items").agg(F.max("best").alias("part"))
            level = here.join(parts, "items", "left")
        level = stored(level, f"url-rules-{size}")
        below = level.select(F.col("items").alias("less"), F.greatest(own, F.col("part")).alias("best")).where(F.col("best").isNotNull())
        good = level.where(F.col("sure") & (F.col("part").isNull() | (F.col("part") < F.col("confidence"))))
        good = good.select("items", "support", "confidence")
        out = good if out is None else out.unionByName(good)
    return out if out is not None else spark.createDataFrame([], "items array<string>, support long, confidence double")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url``, ``confidence`` and ``tokens`` of the surest rule for each distinct url that has one.

    A url and a rule meet in the inverted index once per token they share; the rule fits if every item
    of it was met.  Rules without ``any_of`` need each of their tokens.
    """
    if "any_of" not in rules.columns:
        rules = rules.withColumn("any_of", F.transform("tokens", lambda t: F.array(t)))
    items = rules.select("rule_id", F.size("any_of").alias("size"), F.posexplode("any_of").alias("item", "any"))
    index = items.select("rule_id", "size", "item", F.explode("any").alias("token"))
    met = (
        urls.select("url")
        .where(F.col("url").isNotNull())
        .distinct()
        .select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
        .join(index, "token")
        .select("url", "rule_id", "size", "item")
        .distinct()
        .groupBy("url", "rule_id", "size")
        .agg(F.count("*").alias("met"))
        .where(F.col("met") == F.col("size"))
    )
    return (
        met.join(rules, "rule_id")
        .groupBy("url")
        .agg(F.max(F.struct("confidence", "tokens")).alias("best"))
        .select("url", "best.confidence", "best.tokens")
    )


def judge(pages: DataFrame, rules: list[tuple[str, str]], mined: DataFrame) -> DataFrame:
    """Per page ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``mined_confidence`` and ``mined_tokens``.

    A written rule decides; otherwise a page is blocked if a mined rule fits its url and allowed if
    none does.  A null url has empty host and path, fits no rule and is allowed.  Every row of
    ``pages`` gives a row.  Mined rules are matched on distinct urls, so that a repeated
    url is no group of its own.
    """
    parsed = pages.select("page_id", "url").select(
        "page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")
    )
    hits = match(pages, mined).withColumnsRenamed({"confidence": "mined_confidence", "tokens": "mined_tokens"})
    return (
        parsed.join(written_rules(parsed, rules), ["host", "path"], "left")
        .join(hits, "url", "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("found.rule").alias("rule"),
            F.coalesce(
                F.col("found.verdict"), F.when(F.col("mined_confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
            ).alias("verdict"),
            "mined_confidence",
            F.array_join("mined_tokens", " ").alias("mined_tokens"),
        )
    )
