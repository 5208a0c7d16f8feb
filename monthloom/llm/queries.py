"""The operators of this package applied to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthloom.llm import (
    conversations,
    decontaminate,
    htmltext,
    jaccard,
    langid,
    licenses,
    linededup,
    packing,
    quality,
    spelling,
    tokenbin,
    tokencounts,
    urlrules,
)
from monthloom.llm.common import stored
from monthloom.llm.oracles import SQL
from monthloom.llm.registry import ORACLES, QUERIES, query, table

# Written rules (verdict, host and path prefix).
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_decontaminate", SQL["op1"])
def op1(spark, sf_dir):
    return decontaminate.digest(decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op2_token_files")
def op2(spark, sf_dir):
    return tokenbin.write_and_read(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query("op3_language")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = langid.fold_of(F.col("doc_id")) == 2
    learned = langid.learn(docs.where(~held_out).select("text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query("op4_jaccard", SQL["op4"])
def op4(spark, sf_dir):
    return jaccard.grouped(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op5_token_counts")
def op5(spark, sf_dir):
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def with_length(docs):
    """Tokens and the end id, as op2 writes them: the length that is packed; stored, as packing reads it several times."""
    return stored(tokenbin.token_lengths(docs, tokenizer_file("byte_bpe_50k.json")), "lengths")


@query("op6_best_fit")
def op6(spark, sf_dir):
    return packing.pack(with_length(table(spark, sf_dir, "documents")))


@query("op7_url_filter", None)
def op7(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad")
    )
    labelled = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", "bad")
    return urlrules.judge(pages, URL_RULES, urlrules.mine(labelled))


@query("op8_quality", SQL["op8"])
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judged(docs).select("doc_id", *[f"__q.{c}" for c in quality.COUNTS], "__q.base_failed", "__q.kept")


@query("op9_main_text")
def op9(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query("op10_licenses")
def op10(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op11_line_dedup", SQL["op11"])
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.digest(linededup.kept(docs, linededup.build(docs)))


@query("op12_conversations", SQL["op12"])
def op12(spark, sf_dir):
    return conversations.report(table(spark, sf_dir, "conversations"))


@query("op13_spelling", SQL["op13"])
def op13(spark, sf_dir):
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents"), misspell_every=97))


def load():
    return QUERIES, ORACLES
