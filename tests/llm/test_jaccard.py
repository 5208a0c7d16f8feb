import random
import re

import numpy as np
import pytest

from monthloom.llm import jaccard
from monthloom.llm.components import components


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, k, percent):
    """Component of each row, by comparing all pairs."""
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    up[max(top(i), top(j))] = min(top(i), top(j))
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[top(i)] = min(smallest.get(top(i), doc), doc)
    return [(doc, len(sets[i]), smallest.get(top(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(100_000)
    passage = [word() for _ in range(60)]
    texts = []
    for group, size, length in ((0, 70, 150), (1, 25, 40), (2, 12, 700), (3, 30, 12), (4, 8, 1500)):
        base = [word() for _ in range(length)]
        texts.append(" ".join(base))
        for _ in range(size):  # from nearly equal to far beyond the limit
            w = list(base)
            for _ in range(r.randrange(0, max(2, length // 25))):
                kind, at = r.randrange(3), r.randrange(len(w))
                if kind == 0:
                    w[at] = word()
                elif kind == 1:
                    del w[at]
                else:
                    w.insert(at, word())
            texts.append(" ".join(w))
    chain = [word() for _ in range(300)]  # each similar to the next, the ends are not
    for i in range(12):
        texts.append(" ".join(chain[i * 8 : i * 8 + 200]))
    for i in range(60):  # a passage that many share
        own = [word() for _ in range(r.randrange(0, 50))]
        texts.append(" ".join(own + passage[: r.randrange(5, 61)]))
    texts += texts[:10] + [t.upper() for t in texts[10:15]]
    texts += ["", "  \n ", None, "one", "ONE", "one two", "one two three", "one two three", "a b c d e f g h i j"] * 2
    texts += [" ".join(f"w{i}" for i in range(n)) for n in (6, 7, 8, 9, 10, 11, 12, 13)]
    r.shuffle(texts)
    ids = r.sample(range(10**12), len(texts))
    ids[3] = None
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("seed", "frequent", "percent", "k"), [(1, 256, 85, 4), (2, 6, 85, 4), (3, 12, 80, 5)])
def test_against_all_pairs(spark, monkeypatch, seed, frequent, percent, k):
    monkeypatch.setattr(jaccard, "SCREENED_WHOLE", 64)  # so that the quarter is used here too
    rows = corpus(seed)
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, component string").repartition(4)
    got = jaccard.grouped(docs, shingle=k, percent=percent, frequent=frequent).select("doc_id", "n_shingles", "component_id")
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, k, percent), key=key)


def test_keep_first(spark):
    rows = [(5, "a b c d e"), (2, "A b c d e"), (2, "A b c d e"), (2, "other words stand here now"), (9, ""), (8, None), (9, ""), (None, "x y z q w"), (None, "x y z q w")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, t int")
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert found == sorted([(2, "A b c d e"), (2, "other words stand here now"), (9, ""), (9, ""), (8, None), (None, "x y z q w")], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.grouped(docs).collect() == [] and jaccard.keep_first(docs).collect() == []


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    up = {n: n for e in edges for n in e}
    for _ in range(500):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in up.items() if n in linked}


def test_parities_bound_the_difference():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 2**63, 40 * i + 1).astype(np.uint64)) for i in range(12)]
    sets += [np.union1d(s[: len(s) // 2], sets[0]) for s in sets]
    p = jaccard._parity(np.concatenate(sets), np.array([len(s) for s in sets]))
    for i in range(len(sets)):
        for j in range(len(sets)):
            bits = sum(int(x).bit_count() for x in p[i] ^ p[j])
            assert bits <= len(np.setxor1d(sets[i], sets[j]))
