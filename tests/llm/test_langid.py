import pytest
from pyspark.sql import functions as F

from monthloom.llm import langid
from monthloom.llm.queries import op3

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op3(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    held = [r for r in got if r["held_out"]]
    assert 150 < len(held) < 350
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["rejected"] for r in got) <= 0.02 * len(got)


@pytest.fixture(scope="module")
def samples():
    return {"xx": b"kala mana sula tira pona waku " * 40, "yy": b"brid strom glund krast plomb frent " * 40}


def test_rules(spark, samples):
    rows = [
        (1, "Kala mana, SULA tira!", 0.5),
        (2, None, 0.5),
        (3, "", 0.5),
        (4, "123 -- 45 \n", 0.5),
        (5, "strom " * 20_000, 0.5),
        (None, "glund krast plomb", 0.5),
        (1, "Kala mana, SULA tira!", 0.5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = langid.identify(docs, samples)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "margin", "rejected"]
    found = [(r["doc_id"], r["lang_pred"], r["rejected"]) for r in got.collect()]
    assert found == [(1, "xx", False), (2, "und", True), (3, "und", True), (4, "und", True), (5, "yy", False), (None, "yy", False), (1, "xx", False)]


def test_narrow_margin_is_rejected(spark, samples):
    both = " ".join((samples["xx"] + samples["yy"]).decode().split()[::7])
    docs = spark.createDataFrame([(1, both), (2, "qqqq"), (3, "qzvj " * 200)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(docs, samples, min_margin=0.3).collect()}
    assert got[1]["rejected"] and got[3]["rejected"]
    assert got[2]["lang_pred"] == "xx" and got[2]["score"] == 0.5 and not got[2]["rejected"]  # a tie over few bytes


def test_learning(spark):
    rows = [("aa", f"word{chr(97 + i % 26)}{chr(97 + i // 26)} text", "s") for i in range(50)] + [("bb", "Ünder 12 the", "s"), (None, "no", "s"), ("cc", None, "s"), ("dd", "123", "s")] * 3
    labelled = spark.createDataFrame(rows, "lang string, text string, source string")
    found = langid.learn(labelled, sample_rows=10)
    assert set(found) == {"aa", "bb", "dd"} and found["bb"] == "ünder the".encode() and found["dd"] == b""
    assert found["aa"].count(b"word") == 10
    assert langid.learn(labelled.limit(0)) == {}
    none = langid.identify(spark.createDataFrame([(1, "text")], "doc_id long, text string"), {})
    assert [(r["lang_pred"], r["rejected"]) for r in none.collect()] == [("und", True)]
    assert langid.identify(labelled.limit(0).withColumn("doc_id", F.lit(1)), {"a": b"x"}).collect() == []
