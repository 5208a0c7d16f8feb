"""Tokens that always come together do not multiply the rules; many written rules are a join."""

import itertools

from pyspark.sql import functions as F

from monthloom.llm import urlrules as U

LONG = "https://www.shop.co.uk/" + "/".join(f"part{k}" for k in range(15)) + "/page.html?" + "&".join(f"key{k}={k}" for k in range(10))


def judged(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r["page_id"]: r["verdict"] for r in U.judge(pages, [], rules).collect()}


def test_one_host_with_thirty_tokens(spark):
    rows = [(LONG, k < 27) for k in range(30)] + [("http://fine.org/a", False)] * 30
    df = spark.createDataFrame(rows, "url string, bad boolean")
    assert spark.createDataFrame([(LONG,)], "url string").select(F.size(U.url_tokens(F.col("url"))).alias("n")).first()["n"] >= 30
    rules = U.mine(df, min_support=0.01, min_rows=20).collect()
    assert [(r["support"], r["confidence"], len(r["tokens"])) for r in rules] == [(27, 0.9, 1)]
    assert len(rules[0]["any_of"][0]) >= 30
    # any of the tokens is the rule, as it would be if each had one of its own
    got = judged(spark, [LONG, "http://x.net/part3", "http://x.net/y?key9=1", "http://fine.org/a", "http://other.net/"], U.mine(df, 0.01, 20))
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow"}


def plain_rules(rows, tokens, least, confidence):
    """All combinations of tokens, without those of which a part is as sure."""
    seen = {t for url, _ in rows for t in tokens[url]}
    rules = {}
    for k in range(1, 4):
        for combo in itertools.combinations(sorted(seen), k):
            having = [bad for url, bad in rows if set(combo) <= tokens[url]]
            if sum(having) >= least and sum(having) / len(having) >= confidence:
                rules[combo] = (sum(having), sum(having) / len(having))
    return {c: v for c, v in rules.items() if not any(set(d) < set(c) and rules[d][1] >= v[1] for d in rules)}


def test_same_rules_as_all_combinations(spark):
    urls = [f"http://{a}.net/{b}/{c}" for a in ("spam", "news") for b in ("buy", "read") for c in ("x", "y")]
    rows = []
    for k, u in enumerate(urls):
        bad = 12 if "spam" in u and "buy" in u else 7 if "spam" in u else 2 if u.endswith("/y") else 0
        rows += [(u, j < bad) for j in range(12)]
    tokens = {r["url"]: set(r["t"]) for r in spark.createDataFrame(rows, "url string, bad boolean").select("url", U.url_tokens(F.col("url")).alias("t")).distinct().collect()}
    rules = U.mine(spark.createDataFrame(rows, "url string, bad boolean"), 0.01, 10, 0.5)
    want = plain_rules(rows, tokens, 10, 0.5)
    got = {}
    for r in rules.collect():
        for choice in itertools.product(*r["any_of"]):
            got[tuple(sorted(choice))] = (r["support"], r["confidence"])
    assert got == want and any(len(c) > 1 for c in want)
    asked = [*urls, "http://spam.org/buy", "http://spam.net/", "http://a.b/buy/x", "http://news.net/buy/y", None]
    verdicts = judged(spark, asked, rules)
    for k, u in enumerate(asked):
        mine = set(spark.createDataFrame([(u,)], "url string").select(U.url_tokens(F.col("url")).alias("t")).first()["t"] or ()) if u else set()
        assert verdicts[k] == ("block" if any(set(c) <= mine for c in want) else "allow")


def test_many_written_rules(spark):
    rules = [("block" if k % 2 else "allow", f"h{k}.net/p{k}") for k in range(20_000)] + [("allow", "net/"), ("block", "net/")]
    pages = spark.createDataFrame([(1, "http://a.h7.net/p7/x"), (2, "http://h8.net/p8"), (3, "http://h8.net/q"), (4, "http://h9.org/")], "page_id long, url string")
    none = spark.createDataFrame([], "rule_id long, tokens array<string>, support long, confidence double")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge(pages, rules, none).collect()}
    assert got == {1: ("h7.net/p7", "block"), 2: ("h8.net/p8", "allow"), 3: ("net/", "allow"), 4: (None, "allow")}
