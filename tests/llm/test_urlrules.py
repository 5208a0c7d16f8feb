from pyspark.sql import functions as F

from monthloom.llm import urlrules as U
from monthloom.llm.queries import URL_RULES, op7

CASES = [
    # url, host, path, rule
    ("https://A.example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/"),
    ("http://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/"),
    ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/"),
    ("http://x.com/de/1", "x.com", "/de/1", "com/de/"),
    ("http://x.com/DE/1", "x.com", "/DE/1", None),
    ("http://x.org", "x.org", "", None),
    ("http://x.org?y=/a", "x.org", "", None),
    ("http://xorg/", "xorg", "/", None),
    ("no scheme", "", "", None),
    ("", "", "", None),
    (None, "", "", None),
    ("a://b://c/d", "b:", "//c/d", None),
    ("ftp://x.com/fr/\n?", "x.com", "/fr/\n", "com/fr/"),
]
VERDICTS = {r: v for v, r in URL_RULES}


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")


def no_rules(spark):
    return spark.createDataFrame([], "rule_id long, tokens array<string>, support long, confidence double")


def test_written_rules(spark):
    got = U.judge(pages_of(spark, [c[0] for c in CASES]), URL_RULES, no_rules(spark)).collect()
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert found == {i: (h, p, r, VERDICTS.get(r, "allow")) for i, (_, h, p, r) in enumerate(CASES)}


def labelled(spark):
    rows = []
    for i in range(400):
        rows.append((f"http://{'spam' if i % 4 == 0 else 'good'}{i % 3}.net/{'buy' if i % 2 == 0 else 'read'}/{i}?ref={i}", i % 4 == 0 and i % 40 != 0))
    return spark.createDataFrame([*rows, (None, True), ("http://x.net/", None)], "url string, bad boolean")


def test_mined_rules_against_counting(spark):
    rows = [(r["url"], r["bad"]) for r in labelled(spark).collect() if r["url"] and r["bad"] is not None]
    tokens = {r["url"]: r["t"] for r in labelled(spark).where("url is not null").select("url", U.url_tokens(F.col("url")).alias("t")).collect()}
    rules = U.mine(labelled(spark), min_support=0.01, min_rows=10, min_confidence=0.8).collect()
    assert rules
    for rule in rules:
        having = [bad for url, bad in rows if set(rule["tokens"]) <= set(tokens[url])]
        assert sum(having) == rule["support"] and abs(sum(having) / len(having) - rule["confidence"]) < 1e-12
        assert rule["support"] >= 10 and rule["confidence"] >= 0.8
    singles = [r["tokens"] for r in rules if len(r["tokens"]) == 1]
    assert not any(set(s) < set(r["tokens"]) and r["confidence"] <= x["confidence"] for r in rules for x in rules for s in [x["tokens"]])
    urls = ["http://spam0.net/x", "http://good1.net/buy/7", "http://spam0.net/x", None]
    got = U.judge(pages_of(spark, urls), [], U.mine(labelled(spark), 0.01, 10, 0.8)).collect()
    assert len(got) == 4 and {r["page_id"]: r["verdict"] for r in got} == {0: "block", 1: "allow", 2: "block", 3: "allow"}
    assert singles


def test_empty(spark):
    assert U.mine(labelled(spark).limit(0)).collect() == []
    assert U.judge(pages_of(spark, ["u"]).limit(0), URL_RULES, no_rules(spark)).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = op7(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(r["verdict"] == VERDICTS[r["rule"]] for r in got if r["rule"])
