"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm.common import stored


def _towards_smaller(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node of the links ``a``, ``b`` (long).

    In turn all larger, then all smaller neighbours of a node are linked to the smallest of its
    neighbourhood, until nothing changes; rounds grow with the logarithm of the longest path.  A
    neighbourhood is never gathered: its minimum is aggregated and joined back to the links, and
    a join can be split where one node has very many.  Every round is stored in the shared folder.
    """
    e = stored(_towards_smaller(edges), "links")
    before = _state(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(_towards_smaller(large), "links")
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        e = stored(_towards_smaller(small), "links")
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
