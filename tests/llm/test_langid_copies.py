"""Copies of a text do not fill the sample of a language."""

from pyspark.sql import functions as F

from monthloom.llm import langid


def test_copies_that_hash_first(spark):
    texts = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)} text" for i in range(60)]
    one = spark.createDataFrame([("aa", t) for t in texts], "lang string, text string")
    first = one.orderBy(F.xxhash64("text")).first()["text"]
    copies = spark.createDataFrame([("aa", first)] * 1000 + [("bb", first)] * 3, "lang string, text string").repartition(4)
    found = langid.learn(one.union(copies), sample_rows=20)
    assert found["aa"] == langid.learn(one, sample_rows=20)["aa"]
    assert found["aa"].count(b"word") == 20 and found["bb"].count(b"word") == 1
