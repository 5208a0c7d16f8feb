"""A corpus from raw documents to packed sequences, in stages that are stored in between.

Every stage takes the documents its predecessor kept; its rows are written as Parquet and read
again.  ``run`` applies all of them to the table ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.llm import decontaminate, jaccard, langid, packing, quality
from monthloom.llm.common import stored
from monthloom.llm.queries import with_length
from monthloom.llm.registry import table


def _columns(docs: DataFrame):
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told from their text."""
    learned = langid.learn(docs.where(langid.fold_of(F.col("doc_id")) != 2).select("text", "lang"))
    verdict = langid.identify(docs.select(F.struct(*_columns(docs)).alias("d"), "text"), learned)
    return verdict.where(~F.col("rejected")).select("d.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that no quality rule fails."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return jaccard.keep_first(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of a document goes in the training sequences."""
    return packing.pack(with_length(docs))


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_copies", one_of_each),
    ("benchmark", unseen),
    ("packing", packed),
]

#: The first stage compresses, which SQL cannot express; see the tests for the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
