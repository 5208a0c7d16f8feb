import hashlib
import random
import re

import pytest

from monthloom.llm import decontaminate as D

DOCS = "doc_id long, text string, items string"
ITEMS = "item_id long, text string, n_hit int"


def words_of(text):
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, window):
    wins = {}
    for i, text in items:
        w = words_of(text)
        k = min(window, len(w))
        for a in range(len(w) - k + 1) if w else ():
            wins.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for d, text in docs:
        w, hit, found = words_of(text), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in wins:
                    hit |= set(range(a, a + k))
                    found |= wins[tuple(w[a : a + k])]
        out.append((d, len(w), len(hit), sorted(found)))
    return out


@pytest.fixture(scope="module")
def case():
    r = random.Random(3)
    common = ["the", "of", "a", "und", "é", "12"]
    word = lambda: r.choice(common) if r.random() < 0.6 else f"w{r.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(r.choice([1, 2, 4, 5, 12, 13, 14, 40])))) for i in range(40)]
    items += [(90, None), (91, ""), (92, "--- !!"), (7, items[3][1]), (93, items[3][1].upper()), (94, "the the the the the the the the the the the the the the")]
    docs = []
    for d in range(120):
        parts = [" ".join(word() for _ in range(r.randrange(0, 60)))]
        for _ in range(r.randrange(0, 4)):
            w = words_of(r.choice(items)[1])
            a = r.randrange(max(1, len(w)))
            parts.append(r.choice([", ", "\n", "..."]).join(w[a : a + r.randrange(1, 30)]))
            parts.append(" ".join(word() for _ in range(r.randrange(0, 20))))
        docs.append((d, r.choice(["; ", " "]).join(parts)))
    docs += [(500, None), (501, ""), (502, "the " * 500), (5, docs[5][1]), (None, docs[6][1])]
    return docs, items


@pytest.mark.parametrize(("window", "limit"), [(13, 32_000_000), (13, 0), (6, 32_000_000)])
def test_against_all_windows(spark, case, window, limit):
    docs, items = case
    d = spark.createDataFrame([(*x, "") for x in docs], DOCS).repartition(3)
    i = spark.createDataFrame([(*x, 0) for x in items], ITEMS)
    got = D.matches(d, i, window=window, broadcast_bytes=limit)
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items, window), key=key)


def test_digest_and_clean(spark, case):
    docs, items = case
    d = spark.createDataFrame([(*x, "z") for x in docs], DOCS)
    i = spark.createDataFrame([(*x, 0) for x in items], ITEMS)
    want = {}
    for doc, n, hit, found in brute(docs, items, 13):
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        want[doc] = (doc, n, hit, len(found), sha, hit > 0 and 20 * hit >= n)
    got = {r["doc_id"]: tuple(r) for r in D.digest(D.matches(d, i)).collect()}
    assert got == want
    for limit in (32_000_000, 0):
        kept = D.clean(d, i, broadcast_bytes=limit)
        assert kept.columns == d.columns
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted((x is None, x or 0) for x, _ in docs if not want[x][-1])


def test_partial_containment(spark):
    item = " ".join(f"i{k}" for k in range(13))
    near = item.split()
    near[12] = "other"
    d = spark.createDataFrame([(1, "a " + item + " b", ""), (2, "a " + " ".join(near) + " b", ""), (3, "x", "")], DOCS)
    i = spark.createDataFrame([(1, item, 0)], ITEMS)
    for limit in (32_000_000, 0):
        got = {r["doc_id"]: r["items"] for r in D.matches(d, i, containment=0.8, broadcast_bytes=limit).collect()}
        assert got == {1: [1], 2: [1], 3: []}


@pytest.mark.parametrize("limit", [32_000_000, 0])
def test_empty_tables(spark, limit):
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    d, i = spark.createDataFrame([(1, "a b", "")], DOCS), spark.createDataFrame([(1, "a b", 0)], ITEMS)
    assert D.matches(none_d, i, broadcast_bytes=limit).collect() == []
    assert [tuple(r) for r in D.matches(d, none_i, broadcast_bytes=limit).collect()] == [(1, 2, 0, [])]
