"""The mark of a bad page is no token of any URL."""

from pyspark.sql import functions as F

from monthloom.llm import urlrules as U


def test_hosts_with_the_label_bad(spark):
    rows = [(f"http://bad.example.net/{'spam' if i % 2 else 'fine'}/{i}", i % 2 == 1) for i in range(80)]
    rows += [(f"http://good.example.org/fine/{i}", False) for i in range(80)]
    rows += [("bad", False), ("bad://bad/bad?bad=bad", True)]
    pages = spark.createDataFrame(rows, "url string, bad boolean")
    tokens = {t for r in pages.select(U.url_tokens(F.col("url")).alias("t")).collect() for t in r["t"]}
    assert "label=bad" in tokens and U.BAD not in tokens and all("=" in t for t in tokens)
    rules = U.mine(pages, min_support=0.01, min_rows=10, min_confidence=0.6).collect()
    found = {tuple(r["tokens"]): (r["support"], r["confidence"]) for r in rules}
    assert found[("segment=spam",)] == (40, 1.0)
    assert ("label=bad",) not in found and ("segment=fine",) not in found
    low = {tuple(r["tokens"]): (r["support"], r["confidence"]) for r in U.mine(pages, 0.01, 10, 0.4).collect()}
    assert low[("label=bad",)] == (41, 41 / 81)
